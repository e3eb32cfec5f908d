"""State of every node and edge as of a time, from the append-only assertion log.

An assertion applies at ``t`` when ``valid_from <= t`` and ``t`` is before its end, the earlier of
``valid_to`` and ``valid_from + ttl``. Of the applicable ones the highest provenance wins, then the
highest confidence, then the latest observation, then the smallest id.

Everything is a partially aggregated arg-min, so a target that holds a large part of the log is
reduced before the shuffle. Per-assertion results (contributors, contradictions, evidence) are long
tables, never arrays that grow with a target's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.functions.bands import provenance_name
from tidegraph.model import INFERRED, UNKNOWN
from tidegraph.plans.ranking import numbered
from tidegraph.session import stage

TARGET = ["context", "target_kind", "target_id"]
LATEST = float("inf")


def moment(as_of: float | None) -> float:
    """The time a view is taken at; ``None`` is after everything, so any finite end has passed."""
    return LATEST if as_of is None else float(as_of)


def effective_end() -> Column:
    """Earlier of ``valid_to`` and the ttl expiry; NULL is open-ended (``least`` skips NULLs)."""
    return F.least(F.col("valid_to"), F.col("valid_from") + F.col("ttl"))


def applies_at(as_of: Column | float) -> Column:
    t = F.lit(as_of) if isinstance(as_of, float) else as_of
    return (F.col("valid_from") <= t) & (effective_end().isNull() | (t < effective_end()))


def rank_columns() -> list[Column]:
    return [F.col("provenance").desc(), F.col("confidence").desc(), F.col("observed_at").desc(), F.col("id").asc()]


def rank_key() -> Column:
    """Struct that is smallest for the winning assertion."""
    return F.struct(-F.col("provenance"), -F.col("confidence"), -F.col("observed_at"), F.col("id"))


def winner_fields() -> Column:
    return F.struct(
        F.col("id").alias("winner"), "value_json", "provenance", "confidence", "source", "valid_from",
        effective_end().alias("valid_to"), "observed_at",
    )


def in_scope(log: DataFrame, context: str | None, kind: str | None) -> DataFrame:
    if context is not None:
        log = log.where(F.col("context") == context)
    if kind is not None:
        log = log.where(F.col("target_kind") == kind)
    return log


def applicable(log: DataFrame, as_of: float | None = None, context: str | None = None, kind: str | None = None) -> DataFrame:
    """Assertions valid at ``as_of``."""
    return in_scope(log, context, kind).where(applies_at(moment(as_of)))


def resolve(log: DataFrame, as_of: float | None = None, context: str | None = None, kind: str | None = None) -> DataFrame:
    """Winning state per target, UNKNOWN winners included (``is_unknown`` marks them)."""
    states = applicable(log, as_of, context, kind).groupBy(*TARGET).agg(
        F.min_by(winner_fields(), rank_key()).alias("w"), F.count("*").alias("contributors")
    )
    return states.select(*TARGET, "w.*", "contributors").withColumn(
        "is_unknown", F.col("provenance") == UNKNOWN
    )


def computable(log: DataFrame, as_of: float | None = None, context: str | None = None, kind: str | None = None) -> DataFrame:
    """Resolved states without the targets whose best assertion is UNKNOWN."""
    return resolve(log, as_of, context, kind).where(~F.col("is_unknown")).drop("is_unknown")


class States:
    """Winning states of the targets of one kind and context at several times, from one look at the log.

    Most targets have a single assertion that applies at any of the times; these rows are states as they are. A narrow count finds
    the others, and only their rows meet in an arg-min, once for all times. Both passes read what begins by the latest
    time only. The contested targets are a staged table, so the planner knows whether it is small.
    """

    def __init__(self, log: DataFrame, times: list[float | None], context: str, kind: str):
        self.times = [moment(t) for t in times]
        some = applies_at(self.times[0])
        for t in self.times[1:]:
            some = some | applies_at(t)
        rows = in_scope(log, context, kind).where((F.col("valid_from") <= max(self.times)) & some)
        several = rows.groupBy("target_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        contested = stage(several.select("target_id"), "contested")
        self.alone, self.best = rows, None
        if not contested.isEmpty():
            self.alone = rows.join(contested, "target_id", "left_anti")
            valid = F.array_compact(F.array(*[F.when(applies_at(t), F.lit(n)) for n, t in enumerate(self.times)]))
            met = rows.join(contested, "target_id", "left_semi").withColumn("n", F.explode(valid))
            best = met.groupBy("target_id", "n").agg(F.min_by(winner_fields(), rank_key()).alias("w"), F.count("*").alias("contributors"))
            self.best = stage(best.select("target_id", "n", "w.*", "contributors"), "best")

    def at(self, n: int) -> DataFrame:
        """The states at the ``n``-th time: target_id, the winner's fields and contributors; UNKNOWN winners included."""
        alone = self.alone.where(applies_at(self.times[n])).select("target_id", winner_fields().alias("w"), F.lit(1).cast("long").alias("contributors"))
        alone = alone.select("target_id", "w.*", "contributors")
        return alone if self.best is None else alone.unionByName(self.best.where(F.col("n") == n).drop("n"))


def change_counts(log: DataFrame, context: str | None = None) -> DataFrame:
    """Number of assertions per target and context, not bounded in time."""
    return in_scope(log, context, None).groupBy(*TARGET).agg(F.count("*").alias("changes"))


def contributing(log: DataFrame, as_of: float | None = None, context: str | None = None, kind: str | None = None) -> DataFrame:
    """Applicable assertions in rank order, one row each; rank 1 is the winner."""
    rows = applicable(log, as_of, context, kind).select(
        *TARGET, "id", "provenance", "confidence", "observed_at", "source"
    )
    return numbered(rows, TARGET, rank_columns()).withColumnRenamed("id", "assertion_id")


def contradictions(log: DataFrame, as_of: float | None = None, context: str | None = None, kind: str | None = None) -> DataFrame:
    """Applicable assertions whose value differs from the winner's."""
    rows = applicable(log, as_of, context, kind)
    best = rows.groupBy(*TARGET).agg(
        F.min_by(F.struct(F.col("id").alias("winner"), F.col("value_json").alias("winner_value")), rank_key()).alias("b"),
        F.min("value_json").alias("low"), F.max("value_json").alias("high"),
    )
    disputed = best.where(F.col("low") != F.col("high")).select(*TARGET, "b.*")
    return (
        rows.join(disputed, TARGET)
        .where(F.col("value_json") != F.col("winner_value"))
        .select(
            *TARGET, "winner", F.col("id").alias("assertion_id"),
            provenance_name(F.col("provenance")).alias("provenance"), "confidence", "value_json",
        )
    )


def evidence(log: DataFrame, as_of: float | None = None, context: str | None = None, kind: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Distinct evidence references of the applicable assertions, one row each.

    ``wanted`` (target_kind, target_id) keeps the assertions of these targets before their references are listed.
    """
    rows = applicable(log, as_of, context, kind).select(*TARGET, "evidence")
    if wanted is not None:
        rows = rows.join(wanted.select("target_kind", "target_id"), ["target_kind", "target_id"], "left_semi")
    return rows.select(*TARGET, F.explode("evidence").alias("ref")).distinct()


def inferred(log: DataFrame, as_of: float | None = None, context: str | None = None) -> DataFrame:
    """Targets whose winning assertion is inferred."""
    return resolve(log, as_of, context).where(F.col("provenance") == INFERRED).select(*TARGET)


def point_lookup(log: DataFrame, target_id: str, context: str = "default", as_of: float | None = None, kind: str = "node") -> DataFrame:
    """State of one target; UNKNOWN winners are returned, an absent target gives no row."""
    return resolve(log.where(F.col("target_id") == target_id), as_of, context, kind)


def history(log: DataFrame, target_id: str, context: str = "default", kind: str = "node") -> DataFrame:
    """Every assertion of one target in a context, in id order."""
    return in_scope(log, context, kind).where(F.col("target_id") == target_id).orderBy("id")
