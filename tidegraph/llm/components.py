"""Connected components of an undirected link table, by alternating star contraction.

Each round points every node and its neighbours at the smallest node near it. A round is two partially
aggregated minimums and two joins; the number of rounds grows with the logarithm of the longest chain. Rounds
are staged in the shared folder, so a lost executor costs one round's tasks. The few nodes that hold a good part of all
links are found first, and their rows are dealt over many tasks; no group is gathered in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import drop_folder, hot_keys, looked_up, staged_at

def _hot(links: DataFrame, count: int) -> list[int]:
    """Nodes that many of the ``count`` links end in."""
    ends = links.select(F.explode(F.array("high", "low")).alias("node"))
    return hot_keys(ends.groupBy("node").agg(F.count("*").alias("n")), ["node"], "n", count)


def _large_star(links: DataFrame, hot: list[int]) -> DataFrame:
    """Links (high, low): the larger neighbours of each node are linked to its smallest neighbour."""
    both = links.union(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return looked_up(both.where(F.col("v") > F.col("u")), least, ["u"], hot).select(F.col("v").alias("high"), F.col("m").alias("low"))


def _small_star(links: DataFrame, hot: list[int]) -> DataFrame:
    """Links (high, low): each node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("m"))
    moved = looked_up(links, least, ["high"], hot).where(F.col("low") != F.col("m")).select(F.col("low").alias("high"), F.col("m").alias("low"))
    return moved.union(least.select("high", F.col("m").alias("low"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is named by its smallest node.

    ``links``: two columns of one orderable type, by position. Rows with a null, loops, repeated and turned links
    are allowed. An empty table gives an empty result.
    """
    spark = links.sparkSession
    a, b = links.columns
    clean = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows, path = staged_at(spark, clean.where(F.col("high") != F.col("low")).distinct(), "links")
    before, count = None, rows.count()
    while True:
        hot = _hot(rows, count)
        after, new_path = staged_at(spark, _small_star(_large_star(rows, hot), hot), "star")
        now = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("s")).first()
        drop_folder(spark, path)
        rows, path = after, new_path
        if now == before or now["n"] == 0:
            break
        before, count = now, now["n"]
    return rows.select(F.col("high").alias("node"), F.col("low").alias("component")).union(rows.select("low", "low").distinct())
