import math

import numpy as np
import pytest

from tidegraph.llm import embedding_dedup as ed
from tidegraph.llm.common import prepare

from .test_simhash import brute_components


def test_no_pair_at_the_threshold_is_lost():
    rng = np.random.default_rng(2)
    for dimension in (1, 2, 5, 48, 64, 200):
        x = rng.standard_normal((300, dimension))
        x /= np.linalg.norm(x, axis=1)[:, None]
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        length = np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        c = 0.93 + 1e-9
        y = c * x + (0 if dimension == 1 else math.sqrt(1 - c * c)) * noise / length
        y /= np.linalg.norm(y, axis=1)[:, None]
        both = np.concatenate([x, y])
        a, b = ed.linked(both, both, 0.93, True)
        want = {(i, j) for i, j in zip(*np.nonzero(both @ both.T >= 0.93)) if i < j}
        close = {(i, j) for i, j in want if abs(both[i] @ both[j] - 0.93) < 1e-12}
        assert set(zip(a.tolist(), b.tolist())) ^ want <= close


@pytest.mark.parametrize("slab", [ed.SLAB, 7])
def test_against_all_pairs(spark, slab):
    prepare(spark)
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((n, (centre + rng.standard_normal(16) * 0.12).astype(np.float32).tolist(), label))
                n += 1
    rows += [(500 + k, [1.0] * 16, 0) for k in range(20)] + [(499, [3.0] * 16, 0), (498, [-0.0] * 16, 0), (497, None, 0), (496, [], 1), (495, [float("nan")] * 16, 0), (494, [float("inf")] + [1.0] * 15, 0)]
    rows += [(493, [None] + [1.0] * 15, 0), (492, [1.0] * 8, 0), (491, [1e30] * 16, 0), (490, [1e-30] * 16, 0), (700, [1.0] * 16, 1), (700, [1.0] * 16, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, place int").repartition(3)
    got = sorted(map(tuple, ed.near_duplicates(df, 0.93, slab).collect()))

    def able(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [None if not able(v, label) else np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for _, v, label in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    root = brute_components(range(len(rows)), near)
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], 10**9), r[0])
    want = sorted((r[0], sum(a == i for a, _ in near), least[root[i]], r[0] == least[root[i]]) for i, r in enumerate(rows))
    assert got == want


def test_null_ids_and_empty_tables(spark):
    prepare(spark)
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (None, [0.0, 1.0], 2), (4, [0.0, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, ed.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, False), (None, 1, None, False), (None, 1, 4, False), (4, 1, 4, True)], key=str)
    assert ed.near_duplicates(df.limit(0)).collect() == []
