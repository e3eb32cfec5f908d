"""Small file-system helpers over the Hadoop API, for any storage Spark can write to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path, sorted."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files directly below a path, sorted; markers and hidden files are left out."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isFile()]
    return sorted(n for n in names if n[0] not in "._")


def below(spark: SparkSession, path: str) -> list[str]:
    """Data files at any depth below a path, as paths relative to it, sorted; markers and hidden files and folders are left out."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    root = fs.getFileStatus(where).getPath().toString().rstrip("/")
    found, listed = [], fs.listFiles(where, True)
    while listed.hasNext():
        name = listed.next().getPath().toString()[len(root) + 1:]
        if not any(step[0] in "._" for step in name.split("/")):
            found.append(name)
    return sorted(found)


def write_small(spark: SparkSession, path: str, lines: list[str]) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    source = fs.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    source.close()
    return text.split("\n") if text else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, src = _fs(spark, source)
    dst = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {target}")
