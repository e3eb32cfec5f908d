"""What the training-data operators share: session settings, files in the shared folder, local components."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from tidegraph.session import FILE_CLEANUP, setting, staging_root, tune

SETTINGS = {
    # texts can be long: a Python worker gets few rows at once, and fewer still if they are large
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Tasks that the rows of a hot key are dealt over; a key is hot if it has more than one of so many of all rows.
SALTS = 64
_counter = itertools.count()
_held: dict[str, object] = {}
_owner: list[str] = [""]


def prepare(spark: SparkSession) -> SparkSession:
    """The runtime settings these operators are written for."""
    tune(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return f"{staging_root(spark)}/{next(_counter):06d}_{name}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``own_folder`` or ``stage`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged_at(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to a folder of its own; the stored table, and the folder for ``drop_folder``."""
    path = own_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def local_rows(df: DataFrame) -> Iterator[Row]:
    """The rows of ``df``, one partition at a time. For Spark this query has ended before its last shuffle is read, so that the files of
    that shuffle have to stay."""
    with setting(df.sparkSession, FILE_CLEANUP, "false"):
        return df.select("*").toLocalIterator()


def hot_keys(counted: DataFrame, keys: list[str], count: str, total: int) -> list[int]:
    """Hashes of the keys with more than a ``SALTS``-th of ``total`` rows, so fewer than ``SALTS``; ``counted`` has each key once."""
    return [r.h for r in counted.where(F.col(count) * SALTS > total).select(F.xxhash64(*keys).alias("h")).collect()]


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], hot: list[int], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``values``, which has each key once; rows of a hot key are dealt by a salt and its values are repeated.

    The salt is a hash of the row, so that a task that runs again deals its rows alike; equal rows stay together.
    """
    if not hot:
        return rows.join(values, keys, how)
    is_hot, salt = F.xxhash64(*keys).isin(hot), free_name(rows, "salt")
    told = [f"`{c}`" for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = rows.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*told), F.lit(SALTS).cast("long"))).otherwise(F.lit(0).cast("long")))
    salts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(values.withColumn(salt, F.explode(salts)), [*keys, salt], how).drop(salt)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a shared folder or file, for reads and writes inside tasks."""
    for scheme, other in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if path.startswith(scheme):
            path = other + path[len(scheme):]
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[5:]
    return fs.LocalFileSystem(), path


def attempt_name(prefix: str) -> str:
    """A file name no other attempt of the same task takes: only names that a task has returned are read."""
    return f"{prefix}-{uuid.uuid4().hex}"


def only(owner: str) -> None:
    """To be called at the start of a task: a Python worker serves one stage after another, and gives back what operators other
    than ``owner`` have kept in it."""
    if _owner[0] != owner:
        _held.clear()
        _owner[0] = owner


def held(owner: str, key: str, make: Callable[[], object]):
    """An object that a worker makes once and keeps for later tasks of the same operator."""
    only(owner)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        differ = low != high
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label
