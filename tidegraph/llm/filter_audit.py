"""How filters of a corpus interact: what each removes in every order of application, from counts of failure masks.

A document fails some of the filters; the set of these is its mask. The corpus is read once and reduced to cells, the counts per
part and mask. A recursive common table expression then extends prefixes of filter orders by one unused letter a level, joins the
mask cells and carries the bits applied so far: each level says for every mask whether the new filter removes it, fails it too
late, or keeps it. Its size depends on the number of filters alone, so it is joined to the cells of all parts as a broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegraph.llm.common import staged_at

#: Filters an audit can have: 1956 prefixes of up to 6 letters for 64 masks are 125,184 rows of the enumeration.
MOST = 6


def quality_failures(text: Column) -> dict[str, Column]:
    """Failure of the fixed filters that look at one text: A few words, B repeated words, C capitals, D symbols."""
    words = F.transform(F.array(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("different")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": words["n"] < 200,
        "B": 100 * words["different"] < 50 * words["n"],
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters A to E they fail, A being the lowest bit.

    E is failed by a text that some row with a smaller id has too; null is the larger of two ids, and rows of one id do not fail
    for each other. A null text is the empty text, a null part the empty string. A document is good or toxic if any row of
    ``labels`` with its id says quality = 1 or toxic = 1; a null id has no labels. Copies are counted per (text, part, labels)
    before the texts meet, so a group of copies is not gathered. Extra columns are not looked at. Empty tables: no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(quality_failures(text).values())]
    rows = documents.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"),
    )
    said = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(said, "id", "left").fillna(0, ["good", "toxic"])
    # one row per document, though an id may repeat; then one per text and kind of document, with how many have its smallest id
    single = rows.groupBy("id", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    kinds = single.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    first = F.min("first").over(Window.partitionBy("digest"))  # as many rows as there are parts, times labels
    stays = F.when(first.isNull(), F.col("n")).when(F.col("first") == first, F.col("n_first")).otherwise(0)
    parted = kinds.withColumn("stays", stays)
    both = F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))
    cells = parted.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


WALK = """
WITH RECURSIVE walk(prefix, step, letter, mask, applied, alive, fails) AS (
  SELECT DISTINCT '', 0, '', mask, 0, true, false FROM {moves}
  UNION ALL
  SELECT concat(w.prefix, m.letter), w.step + 1, m.letter, w.mask, w.applied | m.bit, (w.mask & w.applied) = 0, m.fails
  FROM walk w JOIN {moves} m ON w.mask = m.mask WHERE (w.applied & m.bit) = 0
)
SELECT prefix, step, letter, mask, alive, fails FROM walk WHERE step > 0
"""


def enumerated(cells: DataFrame, letters: str) -> DataFrame:
    """(prefix, step, letter, mask, alive, fails) of every mask in ``cells`` and every prefix of an order of ``letters``.

    ``alive``: no filter before this step removed the mask; ``fails``: it fails the filter of this step.
    """
    if not 1 <= len(letters) <= MOST or len(set(letters)) < len(letters):
        raise ValueError(f"an audit has 1 to {MOST} filters of different letters")
    moves = F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.lit(1 << k).alias("bit"), (F.col("mask").bitwiseAND(F.lit(1 << k)) != 0).alias("fails")) for k, c in enumerate(letters)]))
    moves, _ = staged_at(cells.sparkSession, cells.select(F.col("mask").cast("int").alias("mask")).distinct().select("mask", moves.alias("m")).select("mask", "m.*"), "moves")
    return staged_at(cells.sparkSession, cells.sparkSession.sql(WALK, moves=moves), "walk")[0]


def audited(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row per part, order of all ``letters`` and step, zeros included, from ``mask_cells`` or other cells of its columns.

    filter_order, step from 1; of the part's documents: kept after this step, removed here, redundant (fail this filter, removed
    before), unique_fails (fail this filter only), good_lost and toxic_lost of those removed here, and shapley, what this step's
    filter removes summed over all orders. Parts are those of ``cells``; no cells, no rows.
    """
    cells, _ = staged_at(cells.sparkSession, cells, "cells")
    walk = enumerated(cells, letters)
    count = lambda column, when: F.sum(F.when(when, F.col(column)).otherwise(0)).cast("long")
    alive, fails = F.col("alive"), F.col("fails")
    bit = F.element_at(F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << k))]), F.col("letter"))
    steps = cells.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "step", "letter").agg(
        count("n", alive & ~fails).alias("kept"), count("n", alive & fails).alias("removed"), count("n", ~alive & fails).alias("redundant"),
        count("n", F.col("mask") == bit).alias("unique_fails"), count("good", alive & fails).alias("good_lost"), count("toxic", alive & fails).alias("toxic_lost"),
    )
    followers = F.element_at(F.array(*[F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    steps = steps.withColumn("shapley", F.sum(F.col("removed") * followers).over(Window.partitionBy("part", "letter")).cast("long"))
    orders = walk.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    return steps.join(F.broadcast(orders.drop("step")), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
