"""Retention, and integrity checks of the event log, the graph and its snapshots."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegraph.model import DAY, SCHEMA_VERSION
from tidegraph.plans.view import Graph
from tidegraph.session import stage, unstage
from tidegraph.sources import files
from tidegraph.sources.graph_tables import bucket_digests, content_digest, in_bucket, list_snapshots, read_graph, row_sums, snapshot_metadata, write_graph

# Days kept, 0 keeps everything --------------------------------
DAYS_7, DAYS_30, DAYS_90, DAYS_365, FOREVER = 7, 30, 90, 365, 0
REQUIRED_FIELDS = ("event_type", "timestamp", "source")
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Retained:
    archived: int
    remaining: int
    archive_path: str | None


def expired(lines: DataFrame, policy: int, now: float) -> DataFrame:
    """Log lines (``value``) with ``expired``; a line without a time is at 0, an unreadable one never expires."""
    parsed = F.try_parse_json("value")
    time = F.coalesce(F.try_variant_get(parsed, "$.timestamp", "double"), F.lit(0.0))
    old = (time < F.lit(now - policy * DAY)) if policy != FOREVER else F.lit(False)
    return lines.where(F.trim("value") != "").withColumn("expired", F.coalesce(parsed.isNotNull() & old, F.lit(False)))


def retention_counts(lines: DataFrame, policy: int, now: float) -> DataFrame:
    return expired(lines, policy, now).agg(F.count_if("expired").alias("archived"), F.count_if(~F.col("expired")).alias("remaining"))


def apply_event_retention(spark: SparkSession, path: str, archive: str, policy: int, now: float) -> Retained:
    """Move expired lines of the log at ``path`` to ``archive``; nothing is moved under FOREVER.

    Only the files there at the start are read and replaced: what is appended meanwhile stays as it is. The expired lines of
    these files go to a folder named by their names, so a repeated run writes it anew. The kept lines are complete in a
    folder beside the log, with a list of the files they replace, before the first of those goes; a run that finds such a
    list first completes it.
    """
    folder = path.rstrip("/")
    side = f"{folder}.kept"
    _swap(spark, folder, side)
    old = files.data_files(spark, folder)
    if not old:
        return Retained(0, 0, None)
    marked = stage(expired(spark.read.text([f"{folder}/{n}" for n in old]), policy, now), "retention")
    counts = marked.agg(F.count_if("expired").alias("a"), F.count_if(~F.col("expired")).alias("r")).first()
    if counts["a"] == 0:
        unstage(marked)
        return Retained(0, counts["r"], None)
    run = hashlib.sha256("\n".join(old).encode()).hexdigest()[:16]
    target = f"{archive}/events_{int(now - policy * DAY)}/run_{run}"
    marked.where("expired").select("value").write.mode("overwrite").text(target)
    marked.where(~F.col("expired")).select("value").write.mode("overwrite").text(side)
    files.write_small(spark, f"{side}/_replaces", old)
    _swap(spark, folder, side)
    unstage(marked)
    return Retained(counts["a"], counts["r"], target)


def _swap(spark: SparkSession, folder: str, side: str) -> None:
    """Replace the listed files of ``folder`` by those beside it, if they are complete; can be repeated at any point."""
    if not files.exists(spark, f"{side}/_replaces"):
        files.delete(spark, side)
        return
    for name in files.read_small(spark, f"{side}/_replaces"):  # as many lines as the log had files
        files.delete(spark, f"{folder}/{name}")
    for name in files.data_files(spark, side):
        files.move(spark, f"{side}/{name}", f"{folder}/{name}")
    files.delete(spark, side)


def apply_snapshot_retention(spark: SparkSession, root: str, policy: int, now: float) -> Retained:
    """Move snapshots created before the cutoff to ``snapshots/archive``."""
    known = list_snapshots(spark, root)
    total = len([n for n in files.folders(spark, f"{root}/snapshots") if n != "archive"])
    if policy == FOREVER:
        return Retained(0, total, None)
    # snapshot names are folder names: as many rows as there are folders
    old = [r["name"] for r in known.where(F.col("created_at") < now - policy * DAY).collect()]
    for name in old:
        target = f"{root}/snapshots/archive/{name}"
        files.delete(spark, target)
        files.move(spark, f"{root}/snapshots/{name}", target)
    return Retained(len(old), total - len(old), f"{root}/snapshots/archive" if old else None)


def event_issues(lines: DataFrame) -> DataFrame:
    """Faulty lines as (level, problem, event_id, lines): bad JSON, missing id or field, repeated ids.

    Repeated ids are warnings, everything else an issue. A line without an id is reported for that only.
    """
    parsed = lines.where(F.trim("value") != "").select(F.try_parse_json("value").alias("v"))
    v = F.col("v")
    event = F.try_variant_get(v, "$.id", "string")
    missing = [
        F.when(F.try_variant_get(v, f"$.{f}", "variant").isNull(), F.lit(f"missing required field '{f}'")) for f in REQUIRED_FIELDS
    ]
    problems = F.when(v.isNull(), F.array(F.lit("invalid JSON"))).when(event.isNull(), F.array(F.lit("missing event id"))).otherwise(F.array_compact(F.array(*missing)))
    issues = parsed.select(event.alias("event_id"), F.explode(problems).alias("problem")).groupBy("problem", "event_id").agg(F.count("*").alias("lines"))
    repeated = parsed.where(event.isNotNull()).groupBy(event.alias("event_id")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return issues.select(F.lit("issue").alias("level"), "problem", "event_id", "lines").unionByName(
        repeated.select(F.lit("warning").alias("level"), F.lit("duplicate event id").alias("problem"), "event_id", (F.col("n") - 1).alias("lines")))


def lines_digest(lines: DataFrame) -> DataFrame:
    """Order-free hash of a text table; repeated lines count."""
    sums = lines.agg(F.count("*").alias("n"), *row_sums(F.col("value")))
    return sums.select(F.sha2(F.concat_ws("|", "n", *[F.coalesce(c, F.lit(0)) for c in ("s0", "s1", "s2", "s3")]).cast("binary"), 256).alias("digest"))


def unknown_entities(graph: Graph, events: DataFrame) -> DataFrame:
    """Affected entities that are neither a node nor an edge, with the number of events naming them."""
    known = graph.nodes.select("id").unionByName(graph.edges.select("id"))
    named = events.select(F.explode("affected_entities").alias("id")).groupBy("id").agg(F.count("*").alias("events"))
    return named.join(known, "id", "left_anti")


def is_consistent(graph: Graph, events: DataFrame) -> bool:
    return unknown_entities(graph, events).isEmpty()


def unequal_buckets(a: Graph, b: Graph) -> list[tuple[str, int]]:
    """Leaves of the two graphs' hash trees that differ: (table, bucket)."""
    left, right = bucket_digests(a), bucket_digests(b).withColumnRenamed("digest", "other")
    both = left.join(right, ["table", "bucket"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("other")))
    return sorted((r["table"], r["bucket"]) for r in both.collect())  # one row per leaf at most


def differences(a: Graph, b: Graph) -> DataFrame:
    """Rows that one graph has, or has more often, and the other has not: (table, side, row).

    The hash trees are compared first; only rows of leaves that differ are compared one by one.
    """
    found = unequal_buckets(a, b)
    out = None
    for name in sorted({t for t, _ in found}):
        buckets = [k for t, k in found if t == name]
        x, y = (in_bucket(g, name).where(F.col("bucket").isin(buckets)).select("row") for g in (a, b))
        for side, p, q in (("left", x, y), ("right", y, x)):
            part = p.exceptAll(q).select(F.lit(name).alias("table"), F.lit(side).alias("side"), "row")
            out = part if out is None else out.unionByName(part)
    return a.nodes.sparkSession.createDataFrame([], "table string, side string, row string") if out is None else out


def _report(spark: SparkSession, issues: list[str], digest: str | None) -> DataFrame:
    return spark.createDataFrame([(not issues, issues, digest)], "valid boolean, issues array<string>, digest string")


def validate_graph(graph: Graph, path: str) -> DataFrame:
    """Write the graph, read it back and compare: valid, issues, digest."""
    spark = graph.nodes.sparkSession
    digest = write_graph(graph, path)
    issues = [] if differences(graph, read_graph(spark, path)).isEmpty() else ["stored graph differs from the written one"]
    return _report(spark, issues, digest)


def validate_checkpoint(spark: SparkSession, path: str, expected_digest: str | None = None) -> DataFrame:
    """A stored graph is readable, and has the expected digest where one is given."""
    if not files.exists(spark, path):
        return _report(spark, ["missing"], None)
    digest = content_digest(read_graph(spark, path)).first()["digest"]
    return _report(spark, [] if expected_digest in (None, digest) else ["content hash differs"], digest)


def validate_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Both parts exist, and the stored hash and schema version are those of the content."""
    path = f"{root}/snapshots/{name}"
    issues = [f"missing {part}" for part in ("nodes", "metadata") if not files.exists(spark, f"{path}/{part}")]
    if issues:
        return _report(spark, issues, None)
    meta = snapshot_metadata(spark, root, name).first()
    digest = content_digest(read_graph(spark, path)).first()["digest"]
    if meta["content_hash"] != digest:
        issues.append("content hash differs")
    if meta["schema_version"] != SCHEMA_VERSION:
        issues.append("schema version differs")
    return _report(spark, issues, digest)


