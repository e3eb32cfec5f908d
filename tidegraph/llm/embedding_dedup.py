"""Embedding near-duplicates by collision counting over one-dimensional projections.

The projections are orthonormal directions. Two unit vectors with cosine ``c`` lie at distance r, r^2 = 2 - 2c, and the squares
of their differences along the directions sum to at most r^2. So at most ``floor(r^2 / w^2)`` of ``m`` directions can
differ by more than ``w``: a pair at the threshold shares at least ``m - floor(r^2 / w^2)`` windows of half-width w around the query's
projections. That count is calibrated to a recall of one - no linked pair is lost - while random pairs rarely reach it.
Pairs that do are verified by their cosine in double precision.

Vectors of one label are numbered by their first projection and cut into slabs of ``slab`` vectors; a task holds two
slabs, sorts one of them along every direction, and counts window by window. It gives back what each vector has gained (a number of
links) and a forest of the links, so a group of near copies leaves as many rows as it has members, not pairs. Slabs
further apart than r along the first direction are not compared. Exact copies are one vector with a weight.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidegraph.llm.common import local_roots, staged_at
from tidegraph.llm.components import connected
from tidegraph.plans.ranking import numbered

DIRECTIONS, MISSES, SLAB, SEED = 48, 13, 2048, 7
_AT_ONCE, _ROWS = 1 << 18, 256


@lru_cache(maxsize=64)
def directions(dimension: int, count: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    """Orthonormal columns; no more than the dimension has."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, min(count, dimension))))
    return q


def window(cosine: float, count: int, misses: int = MISSES) -> tuple[float, int]:
    """Half-width of the windows and the collisions that every pair with at least this cosine has."""
    misses = min(misses, count - 1)
    return math.sqrt(max(0.0, 2 - 2 * cosine) / (misses + 1)) + 1e-9, count - misses


def collisions(query: np.ndarray, other: np.ndarray, width: float) -> np.ndarray:
    """Number of directions along which each of ``other`` falls into the window around each query (rows: queries)."""
    counts = np.zeros((len(query), len(other)), np.uint8)
    kind = np.uint16 if len(other) < 1 << 16 else np.uint32
    rank = np.empty(len(other), kind)
    for k in range(query.shape[1]):
        order = np.argsort(other[:, k])
        line = other[order, k]
        rank[order] = np.arange(len(other), dtype=kind)
        low, high = (np.searchsorted(line, query[:, k] + move, side).astype(kind) for move, side in ((-width, "left"), (width, "right")))
        for a in range(0, len(query), _ROWS):  # a rank before the window wraps around to a large number
            some = slice(a, a + _ROWS)
            counts[some] += (rank[None, :] - low[some, None]) < (high - low)[some, None]
    return counts


def linked(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with at least this cosine; each pair once if both sides are the same vectors."""
    base = directions(x.shape[1])
    width, least = window(cosine, base.shape[1])
    px, py = x @ base, y @ base
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (8 << 20) // max(1, len(y)))
    for k in range(0, len(x), step):
        counts = collisions(px[k:k + step], py, width)
        i, j = np.nonzero(counts >= least)
        i += k
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), _AT_ONCE):
            a, b = i[s:s + _AT_ONCE], j[s:s + _AT_ONCE]
            near = np.einsum("nd,nd->n", x[a], y[b]) >= cosine
            left.append(a[near])
            right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def _matrix(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _compare(cosine: float):
    """(place, links, root) of the vectors of two slabs, or of one with itself, that have a link."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        pdf = pdf.sort_values("place")  # so a root is the smallest place of its tree
        weight, place = pdf["weight"].to_numpy(np.int64), pdf["place"].to_numpy(np.int64)
        mine = pdf["slab"].to_numpy() == i
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine) if i != j else np.flatnonzero(mine)
        if not len(a) or not len(b):
            return pd.DataFrame({"place": [], "links": [], "root": []}, dtype="int64")
        x = _matrix(pdf["vector"])
        left, right = linked(x[a], x[b], cosine, i == j)
        left, right = a[left], b[right]
        links = np.bincount(left, weight[right], len(pdf)).astype(np.int64) + np.bincount(right, weight[left], len(pdf)).astype(np.int64)
        some = np.flatnonzero(links)
        return pd.DataFrame({"place": place[some], "links": links[some], "root": place[local_roots(len(pdf), left, right)[some]]})
    return run


def near_duplicates(
    embeddings: DataFrame, cosine: float = 0.93, slab: int = SLAB, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; rows link within a label if their cosine is at least ``cosine``.

    ``component_id`` is the smallest id reachable; ``kept``: it is the row's own. Vectors that are null, empty, zero or hold
    a null or non-finite component, and those without a label, link with nothing. Vectors of different lengths do not
    link. Repeated rows are vectors of their own and link with each other; a null id is returned, counts as a link, and
    names no component (component_id is null and kept false if no member has an id). An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vector = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), vector.alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y))))  # no square under- or overflows
    rows = rows.withColumn("vector", F.when(F.coalesce(sound, F.lit(False)), scaled)).drop("v")
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(",", F.size("vector").cast("string"), F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    rows, _ = staged_at(spark, rows, "vectors")
    able = rows.where(F.col("vector").isNotNull())

    @F.pandas_udf(T.DoubleType())
    def first_projection(vectors: pd.Series) -> pd.Series:
        return pd.Series([float(v @ directions(len(v), 1)[:, 0] / np.sqrt(v @ v)) for v in vectors], dtype="float64")

    single = able.groupBy("label", "digest").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("weight"))
    single = single.withColumn("size", F.size("vector")).withColumn("along", first_projection("vector"))
    single, _ = staged_at(spark, numbered(single, ["label", "size"], [F.col("along"), F.col("digest")], "rank"), "single")
    single = single.withColumn("slab", F.floor((F.col("rank") - 1) / slab)).withColumn("place", F.xxhash64("label", "digest", "size"))
    single, _ = staged_at(spark, single, "placed")

    # pairs of slabs within reach of each other: one row per slab on each side
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    slabs = single.groupBy("label", "size", "slab").agg(F.min("along").alias("low"), F.max("along").alias("high"))
    later = slabs.select("label", "size", F.col("slab").alias("j"), F.col("low").alias("next_low"))
    pairs = slabs.withColumnRenamed("slab", "i").join(later, ["label", "size"]).where((F.col("j") >= F.col("i")) & (F.col("next_low") <= F.col("high") + reach)).select("label", "size", "i", "j")
    pairs, _ = staged_at(spark, pairs, "slab_pairs")
    sides = pairs.withColumn("slab", F.explode(F.array_distinct(F.array("i", "j"))))
    held = single.select("label", "size", "slab", "place", "weight", "vector").join(sides, ["label", "size", "slab"])
    compared = held.groupBy("label", "size", "i", "j").applyInPandas(_compare(cosine), "place long, links long, root long")
    compared, _ = staged_at(spark, compared, "compared")

    links = compared.groupBy("place").agg(F.sum("links").alias("links"))
    groups = connected(compared.where("place != root").select("place", "root"))
    named = single.select("label", "digest", "place", "least", "weight").join(links, "place", "left").join(groups.withColumnRenamed("node", "place"), "place", "left")
    named = named.select("label", "digest", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "place").alias("component"))
    named, _ = staged_at(spark, named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(least, "component").select("label", "digest", "n_links", "component_id")
    out = able.select("id", "label", "digest").join(found, ["label", "digest"]).select("id", "n_links", "component_id")
    alone = rows.where(F.col("vector").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
