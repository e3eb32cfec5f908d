import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import vector_codes
from tidegraph.llm.common import prepare
from tidegraph.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = [[math.floor(Fraction(x) * 4096) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    nearest = lambda v, book: min(range(len(book)), key=lambda k: (apart(v, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(v[p], books[p]), []).append(v[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else b for k, b in enumerate(books[p])]
    out = []
    for (i, _, label), v in zip(kept, cut):
        code = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k in code), min(sum(apart(v[p], books[p][k]) for p, k in enumerate(code)), 2 ** 63 - 1), label))
    sums = {}
    for *_, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, c, e, min(sums[label], 2 ** 63 - 1)) for i, c, e, label in out), key=str), books


def check(spark, rows, **how):
    prepare(spark)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "code": F.lit(1), "v": F.lit(2)}).repartition(3)
    found, books = vector_codes.compressed(df, **how)
    want, want_books = brute(rows, **how)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found.collect()), key=str) == want
    assert [b.tolist() for b in books] == want_books or not rows


def vectors(rng, n, length=16, spread=1.0):
    centres = [[rng.gauss(0, spread) for _ in range(length)] for _ in range(5)]
    return [[x + rng.gauss(0, 0.05 * spread) for x in rng.choice(centres)] for _ in range(n)]


def test_equals_plain_rounds(spark):
    rng = random.Random(1)
    rows = [(k, v, rng.choice([1, 2, None])) for k, v in enumerate(vectors(rng, 300))]
    rows += [(rng.choice([400, None]), rows[5][1], 1) for _ in range(100)]  # a group of copies
    rows += [(500, None, 1), (501, [float("nan")] * 16, 2), (502, [float("inf")] + [0.0] * 15, 2), (503, [None] + [0.0] * 15, None), rows[0], rows[0]]
    check(spark, rows)


def test_ties_and_equal_entries(spark):
    rng = random.Random(2)
    check(spark, [(k, [rng.choice([0.0, 1.0, -1 / 4096]) for _ in range(16)], 0) for k in range(200)])
    check(spark, [(k, [1.5] * 16, None) for k in range(40)])


def test_few_short_and_uneven_vectors(spark):
    check(spark, [(3, [0.5, -0.5, 0.25], 1), (1, [], 1), (2, [1.0] * 11, None)], entries=16)
    check(spark, [(1, [], None)])
    rng = random.Random(3)
    check(spark, [(k, v, k % 3) for k, v in enumerate(vectors(rng, 90, 10))], parts=3, entries=7, rounds=2)


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([1e30, -1e200, 1.7e308, 0.3, 2.0 ** 45]) * rng.random() for _ in range(8)], k % 2) for k in range(40)]
    check(spark, rows, rounds=2)


def test_empty(spark):
    prepare(spark)
    for rows in ([], [(1, None, 1)]):
        found, books = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA))
        assert found.collect() == [] and all(b.size == 0 for b in books)
    with pytest.raises(ValueError):
        vector_codes.compressed(spark.createDataFrame([], SCHEMA), entries=257)


def test_trees_leave_work_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = (centres[rng.integers(0, 16, 4096)] + rng.integers(-40, 40, (4096, 8))).astype(np.int64)
    nearest, work = vector_codes.assigned(vector_codes.Tree(points, vector_codes.LEAF), vector_codes.Entries(centres))
    tree = vector_codes.Tree(points, vector_codes.LEAF)
    entries = vector_codes.Entries(centres)
    assert (nearest == ((tree.points[:, None] - entries.points[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert work["whole"] > 3000 and work["exact"] < 4096 * 16 / 10
    size, total = vector_codes._sums(tree, nearest, len(entries.points))
    assert size.sum() == 4096 and (total.sum(axis=0) == points.sum(axis=0)).all()


def test_query_returns_all_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, v, 1) for k, v in enumerate(vectors(rng, 60, 64, 0.2))]
    prepare(spark)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_dual_tree_codes"](spark, str(tmp_path)).collect()
    rows = [(k, np.float32(v).astype(float).tolist(), label) for k, v, label in rows]
    want, books = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {vector_codes.digest([np.array(b) for b in books])}
