"""Session settings and the shared staging folder.

Intermediate tables that several operators read, and every round of an iterative operator, are
written as Parquet below ``spark.checkpoint.dir``. That cuts the lineage, survives the loss of any
executor, and gives the planner true sizes, so a side is broadcast only when it is known to be small.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_counter = itertools.count()
_roots: dict[str, str] = {}
_given: dict[str, str] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # dictionary-coded and compressed ids are many times larger in memory than in Parquet: do not take them for small
    "spark.sql.sources.fileCompressionFactor": "8.0",
    # enough partitions that a sort of a large table stays in memory; small ones are put together again
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    # results are staged, so shuffle files are of no use once their query has ended
    FILE_CLEANUP: "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # staged tables and stored graphs take less disk
    "spark.sql.parquet.compression.codec": "zstd",
    # a list of nodes reaches the scan as single values, not as the range from the least to the greatest
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are written for."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def share_folder(spark: SparkSession, path: str) -> None:
    """Name the folder that all executors share, for a session that has no ``spark.checkpoint.dir``."""
    _given[spark.sparkContext.applicationId] = path


def staging_root(spark: SparkSession) -> str:
    """Folder for this application's staged tables, below the cluster's checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or _given.get(app)
        if not base:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share, or name one by share_folder")
        root = f"{base.rstrip('/')}/tidegraph-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the staging folder and return the stored table."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{next(_counter):06d}_{name}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _paths[id(stored)] = stored, path
    return stored


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; what is no staged table is passed over, and so is a repetition."""
    for df in tables:
        held = _paths.pop(id(df), None)
        if held is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(held[1])
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def together(jobs: list[Callable[[], object]]) -> list[object]:
    """Run independent jobs at the same time, so that their small stages share the executors."""
    target = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(target(job)) for job in jobs]]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def drop_staged(spark: SparkSession) -> None:
    """Remove every staged table of this application; results read from them become unreadable."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        for key in [k for k, (_, p) in _paths.items() if p.startswith(root)]:
            del _paths[key]
