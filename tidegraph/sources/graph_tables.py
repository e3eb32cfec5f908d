"""The stored graph: three Parquet tables, merged by id; named snapshots and checkpoints of it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegraph.functions.ids import canonical_json
from tidegraph.model import ASSERTIONS, EDGES, NODES, PROVENANCE_NAMES, SCHEMA_VERSION, SNAPSHOT_META
from tidegraph.plans.resolve import change_counts
from tidegraph.plans.view import Graph
from tidegraph.session import setting, stage, together
from tidegraph.sources import files
from tidegraph.sources.levels import KnownIds

TABLES = {"nodes": NODES, "edges": EDGES, "assertions": ASSERTIONS}
#: Further tables that a stored graph keeps of its log: its rows by target, and their number for each target.
BY_TARGET, COUNTS = "by_target", "change_counts"
#: Bytes of a row group in a log that each task sorts for itself, and of the input of such a task, whose rows must fit its memory.
GROUP, SHARE = 8 << 20, 16 << 20
#: Order of the log, for reads as of a time.
LOG_ORDER = ["context", "target_kind", "valid_from", "id"]
#: Leaves of the hash tree of each table.
BUCKETS = 256
COUNTED = "context string, target_kind string, target_id string, changes long"
NAME = re.compile(r"[A-Za-z0-9_-]+")


def _typed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(*[spark.createDataFrame([], schema) for schema in TABLES.values()])


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The graph stored at a path; a missing table is empty."""
    _finish(spark, path)

    def table(name: str) -> DataFrame:
        if not files.exists(spark, f"{path}/{name}"):
            return spark.createDataFrame([], TABLES[name])
        return _typed(spark.read.schema(TABLES[name]).parquet(f"{path}/{name}"), name)
    more = [
        spark.read.schema(schema).parquet(f"{path}/{name}") if files.exists(spark, f"{path}/{name}") else None
        for name, schema in ((BY_TARGET, ASSERTIONS), (COUNTS, COUNTED))
    ]
    return Graph(*[table(name) for name in TABLES], *more)


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """A graph document with the arrays ``nodes``, ``edges`` and ``assertions`` (one document per line)."""
    arrays = ", ".join([
        "nodes array<struct<id:string,type:string,key:string>>",
        "edges array<struct<id:string,type:string,src:string,dst:string,context:string>>",
        "assertions array<struct<id:string,target_kind:string,target_id:string,value:string,provenance:string,confidence:double,source:string,context:string,"
        "valid_from:double,valid_to:double,observed_at:double,evidence:array<string>,inferred_depth:int,ttl:double>>",
    ])
    pages = spark.read.schema(arrays).json(path)
    nodes = pages.select(F.inline("nodes")).select("id", "type", canonical_json(F.col("key")).alias("key_json"))
    rank = F.array_position(F.array(*[F.lit(x) for x in PROVENANCE_NAMES]), F.col("provenance")) - 1
    log = pages.select(F.inline("assertions")).withColumn("value_json", canonical_json(F.col("value"))).withColumn("provenance", rank)
    return Graph(_typed(nodes, "nodes"), _typed(pages.select(F.inline("edges")), "edges"), _typed(log, "assertions"))


def write_graph_json(graph: Graph, path: str) -> None:
    """The graph as JSON lines that ``read_graph_json`` reads: one node, edge or assertion a line, so that no line grows with it.

    The lines are compressed by gzip; a file holds what a task reads of one share of the input, so that it is read by one task again.
    """
    names = F.array(*[F.lit(x) for x in PROVENANCE_NAMES])
    nodes = graph.nodes.select(F.struct("id", "type", F.parse_json("key_json").alias("key")).alias("nodes"))
    edges = graph.edges.select(F.struct(*[f.name for f in EDGES.fields]).alias("edges"))
    log = _typed(graph.assertions, "assertions").withColumns({"value": F.parse_json("value_json"), "provenance": F.get(names, F.col("provenance"))})
    log = log.select(F.struct(*["value" if f.name == "value_json" else f.name for f in ASSERTIONS.fields]).alias("assertions"))
    with setting(log.sparkSession, "spark.sql.files.maxPartitionBytes", str(SHARE)):
        for rows in (nodes, edges, log):
            rows.select(F.to_json(F.struct(*[F.array(c).alias(c) for c in rows.columns])).alias("value")).write.mode("append").text(path, compression="gzip")


def _put(rows: DataFrame, where: str, mode: str, order: list[str], bloom: str | None = None, by: str | None = None, dealt: bool = True) -> None:
    """Store rows in an order, so that each file and row group has a narrow range of it; ``bloom``: a column to look values up in.

    The Bloom filters tell which of the files whose ranges overlap, as those of later merges do, cannot hold a value. Rows that are not
    ``dealt`` by range stay in their tasks, each of which sorts its own: the row groups of a file have narrow ranges then.
    """
    if dealt:
        writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode)
    else:
        writer = (rows.sortWithinPartitions(*order) if order else rows).write.mode(mode).option("parquet.block.size", GROUP)
    if bloom is not None:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    (writer if by is None else writer.partitionBy(by)).parquet(where)


def _write(graph: Graph, path: str, mode: str, points: bool = False) -> None:
    """The log lies by context, kind and time, so that a read as of a time skips the row groups after it, and nodes and edges have
    Bloom filters of their ids. With ``points`` the files have narrow ranges too, nodes and edges by id; the log lies by target
    as well, and the numbers of assertions per target are kept. Without, nothing is shuffled."""
    log = _typed(graph.assertions, "assertions")
    jobs = [
        lambda name=name: _put(_typed(getattr(graph, name), name), f"{path}/{name}", mode, ["id"] if points else [], "id", dealt=points)
        for name in ("nodes", "edges")
    ]
    jobs.append(lambda: _put(log, f"{path}/assertions", mode, LOG_ORDER, by="context", dealt=points))
    if points:
        jobs.append(lambda: _put(log, f"{path}/{BY_TARGET}", mode, ["target_id", "id"], "target_id"))
        jobs.append(lambda: change_counts(log).write.mode(mode).parquet(f"{path}/{COUNTS}"))
        together(jobs)
    else:
        with setting(log.sparkSession, "spark.sql.files.maxPartitionBytes", str(SHARE)):
            together(jobs)


def _finish(spark: SparkSession, path: str) -> None:
    """Put the tables that are complete beside a stored graph in the place of its own; can be repeated at any point."""
    side = f"{path}/_next"
    if not files.exists(spark, f"{side}/_complete"):
        return
    for name in files.folders(spark, side):
        files.delete(spark, f"{path}/{name}")
        files.move(spark, f"{side}/{name}", f"{path}/{name}")
    files.delete(spark, side)


def _complete(spark: SparkSession, path: str, points: bool) -> None:
    """Put the tables beside a stored graph, all of them written, in its place."""
    if not points:  # those of an earlier graph would not fit
        for name in (BY_TARGET, COUNTS):
            files.delete(spark, f"{path}/{name}")
    files.write_small(spark, f"{path}/_next/_complete", [])
    _finish(spark, path)


def store_graph(graph: Graph, path: str, points: bool = True) -> None:
    """Store the graph in the place of what is there; ``points``: dealt by range, with the copy of its log by target and the numbers
    per target, without which readers take both from the log.

    The tables are complete beside the old ones before the first of those goes, so a graph may be stored where it was read
    from, and a reader after a failure finds the old graph or the new one.
    """
    spark = graph.nodes.sparkSession
    _finish(spark, path)
    files.delete(spark, f"{path}/_next")
    _write(graph, f"{path}/_next", "errorifexists", points)
    _complete(spark, path, points)


def store_grown(nodes: DataFrame, edges: DataFrame, log: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Store a graph whose log is made from its edges, as ``store_graph`` does without ``points``.

    The edges are written once: further columns that the log needs stay in the files, where readers pass over them, and ``log`` is given
    the edges as stored.
    """
    spark = nodes.sparkSession
    _finish(spark, path)
    side = f"{path}/_next"
    files.delete(spark, side)
    more = [c for c in edges.columns if c not in EDGES.names]
    shaped = edges.select(*[F.col(f.name).cast(f.dataType) for f in EDGES.fields], *more)
    _put(shaped, f"{side}/edges", "errorifexists", [], "id", dealt=False)
    made = _typed(log(spark.read.schema(shaped.schema).parquet(f"{side}/edges")), "assertions")
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(SHARE)):
        together([
            lambda: _put(_typed(nodes, "nodes"), f"{side}/nodes", "errorifexists", [], "id", dealt=False),
            lambda: _put(made, f"{side}/assertions", "errorifexists", LOG_ORDER, by="context", dealt=False),
        ])
    _complete(spark, path, points=False)


def write_graph(graph: Graph, path: str, points: bool = True) -> str:
    """Store the graph as ``store_graph`` does and return its content digest, which is taken from the stored rows."""
    store_graph(graph, path, points)
    return content_digest(read_graph(graph.nodes.sparkSession, path)).first()["digest"]


def row_sums(row: Column) -> list[Column]:
    """Sums of the four quarters of the rows' SHA-256, as decimals: equal rows do not cancel, and order does not matter.

    A quarter is read once, as a signed long. Its halves are added up as longs, which hold the sum of 2^31 of them; decimals are
    made once per sum.
    """
    digest = F.sha2(row.cast("binary"), 256)

    def total(half: Column) -> Column:
        return F.sum(half).cast("decimal(19,0)")

    def whole(k: int) -> Column:
        quarter = F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long")
        high, low = F.shiftrightunsigned(quarter, 32), quarter.bitwiseAND(F.lit((1 << 32) - 1))
        return total(high) * F.lit(1 << 32).cast("decimal(10,0)") + total(low)

    return [whole(k).cast("decimal(30,0)").alias(f"s{k}") for k in range(4)]


def in_bucket(graph: Graph, name: str) -> DataFrame:
    """(bucket, row) of a table: the row as JSON, and a bucket by its id."""
    rows = _typed(getattr(graph, name), name)
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.to_json(F.struct(*rows.columns)).alias("row"))


def bucket_digests(graph: Graph) -> DataFrame:
    """(table, bucket, digest): the lower level of the hash tree, one row per table and bucket that has rows."""
    parts = [in_bucket(graph, name).withColumn("table", F.lit(name)) for name in TABLES]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sums = rows.groupBy("table", "bucket").agg(F.count("*").alias("n"), *row_sums(F.col("row")))
    return sums.select("table", "bucket", F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3").cast("binary"), 256).alias("digest"))


def content_digest(graph: Graph) -> DataFrame:
    """One row ``digest``: the top of the hash tree, which does not depend on the rows' order or partitioning."""
    leaves = F.array_sort(F.collect_list(F.concat_ws(":", "table", "bucket", "digest")))  # BUCKETS for each table at most
    return bucket_digests(graph).agg(F.sha2(F.array_join(leaves, ",").cast("binary"), 256).alias("digest"))


def merge_graph(spark: SparkSession, path: str, new: Graph) -> DataFrame:
    """Append what the stored graph does not have yet; per table the number of rows added.

    Rows are compared by id only, and the existing ones stay as they are; the known ids are in an index beside the tables, of
    which a merge opens the files that can hold its ids. The new rows are staged
    before the append, as they are computed from the tables appended to. They are laid out as ``write_graph`` does.
    """
    _finish(spark, path)

    def fresh(name: str) -> DataFrame:
        rows = stage(_typed(getattr(new, name), name).dropDuplicates(["id"]), f"new_{name}")
        known = KnownIds(spark, f"{path}/_ids/{name}", f"{path}/{name}", lambda paths: spark.read.schema("id string").parquet(*paths))
        return stage(_typed(known.without(rows), name), f"fresh_{name}")

    added = Graph(*together([lambda name=name: fresh(name) for name in TABLES]))
    points = files.exists(spark, f"{path}/{BY_TARGET}") or not files.exists(spark, f"{path}/assertions")  # a part of a copy would not do
    _write(added, path, "append", points)
    counts = [getattr(added, name).agg(F.lit(name).alias("table"), F.count("*").alias("added")) for name in TABLES]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _checked(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"name {name!r} may have letters, digits, _ and - only")
    return name


def save_snapshot(graph: Graph, root: str, name: str, created_at: float = 0.0) -> DataFrame:
    """Store an immutable named snapshot and return its metadata row; an existing name is an error."""
    spark = graph.nodes.sparkSession
    path = f"{root}/snapshots/{_checked(name)}"
    if files.exists(spark, path):
        raise ValueError(f"snapshot {name!r} exists")
    _write(graph, path, "errorifexists")
    stored = read_graph(spark, path)
    counts = [getattr(stored, t).select(F.lit(t).alias("t")) for t in TABLES]
    sizes = counts[0].unionByName(counts[1]).unionByName(counts[2]).agg(*[
        F.count_if(F.col("t") == t).alias(c) for t, c in (("nodes", "node_count"), ("edges", "edge_count"), ("assertions", "assertion_count"))
    ])
    digest = content_digest(stored).first()["digest"]
    meta = sizes.select(
        F.lit(name).alias("name"), F.lit(float(created_at)).alias("created_at"), "node_count", "edge_count", "assertion_count",
        F.lit(digest).alias("content_hash"), F.lit(SCHEMA_VERSION).alias("schema_version"))
    meta.write.parquet(f"{path}/metadata")
    return spark.read.schema(SNAPSHOT_META).parquet(f"{path}/metadata")


def load_snapshot(spark: SparkSession, root: str, name: str) -> Graph:
    path = f"{root}/snapshots/{_checked(name)}"
    if not files.exists(spark, path):
        raise ValueError(f"no snapshot {name!r}")
    return read_graph(spark, path)


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all snapshots, by name."""
    paths = [f"{root}/snapshots/{n}/metadata" for n in files.folders(spark, f"{root}/snapshots") if n != "archive"]
    paths = [p for p in paths if files.exists(spark, p)]
    rows = spark.read.schema(SNAPSHOT_META).parquet(*paths) if paths else spark.createDataFrame([], SNAPSHOT_META)
    return rows.orderBy("name")


def snapshot_metadata(spark: SparkSession, root: str, name: str) -> DataFrame:
    return list_snapshots(spark, root).where(F.col("name") == _checked(name))


def delete_snapshot(spark: SparkSession, root: str, name: str) -> bool:
    return files.delete(spark, f"{root}/snapshots/{_checked(name)}")


def save_checkpoint(graph: Graph, root: str, name: str) -> str:
    """Store a named state of the graph, replacing an earlier one of the name; as a snapshot, without the copy by target."""
    return write_graph(graph, f"{root}/checkpoints/{_checked(name)}", points=False)


def restore_checkpoint(spark: SparkSession, root: str, name: str) -> Graph:
    path = f"{root}/checkpoints/{_checked(name)}"
    if not files.exists(spark, path):
        raise ValueError(f"no checkpoint {name!r}")
    return read_graph(spark, path)


def list_checkpoints(spark: SparkSession, root: str) -> list[str]:
    return files.folders(spark, f"{root}/checkpoints")
