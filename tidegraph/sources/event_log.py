"""The immutable event log: JSON lines, read in (timestamp, id) order, appended idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidegraph.model import EVENTS
from tidegraph.plans.ranking import page
from tidegraph.session import stage, unstage
from tidegraph.sources import files
from tidegraph.sources.levels import KnownIds

# on disk the metadata is a JSON object under "metadata"
STORED = T.StructType([f if f.name != "metadata_json" else T.StructField("metadata", T.StringType()) for f in EVENTS.fields])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the log, unreadable lines skipped; a missing log is empty. Not yet ordered."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], EVENTS)
    rows = spark.read.schema(STORED).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("id").isNotNull()).withColumnRenamed("metadata", "metadata_json")


def to_lines(events: DataFrame) -> DataFrame:
    """One JSON text per event, in column ``value``."""
    shown = events.withColumn("metadata", F.try_parse_json("metadata_json")).drop("metadata_json")
    return shown.select(F.to_json(F.struct(*sorted(shown.columns))).alias("value"))


def append_events(spark: SparkSession, path: str, events: DataFrame) -> None:
    """Append the events whose id the log does not have yet, whatever their time.

    The ids are in an index beside the log that follows its files, so only new files are parsed.
    """
    batch = stage(events.dropDuplicates(["id"]).where(F.col("id").isNotNull()), "batch")
    known = KnownIds(spark, f"{path.rstrip('/')}/_ids", path, lambda paths: spark.read.schema(STORED).option("mode", "DROPMALFORMED").json(paths))
    to_lines(known.without(batch).select(*[f.name for f in EVENTS.fields])).write.mode("append").text(path)
    unstage(batch)


def replay(events: DataFrame) -> DataFrame:
    return events.orderBy("timestamp", "id")


def events_as_of(events: DataFrame, t: float) -> DataFrame:
    return events.where(F.col("timestamp") <= t)


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("count"))


def list_events(events: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of the log in replay order."""
    return page(events, [F.col("timestamp").asc(), F.col("id").asc()], offset, limit)
