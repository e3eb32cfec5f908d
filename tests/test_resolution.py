import random

import pytest
from pyspark.sql import functions as F

from tests.small import Maker, rows
from tidegraph.functions import bands
from tidegraph.plans import resolve as rs
from tidegraph.plans.ranking import numbered, page
from tidegraph.plans.view import open_view, open_views


def log_of(spark, claims):
    m = Maker()
    for c in claims:
        m.claim("node", c.pop("target", "h1"), c.pop("value"), **c)
    m.node("h1", "ASSET")
    return m.graph(spark).assertions


def winner(spark, claims, as_of):
    found = rs.resolve(log_of(spark, claims), as_of, "default").collect()
    return found[0].value_json if found else None


def test_provenance_beats_confidence(spark):
    claims = lambda: [dict(value={"s": "open"}, confidence=0.9), dict(value={"s": "closed"}, confidence=0.95, provenance=1)]
    assert winner(spark, claims(), 150.0) == '{"s": "open"}'
    found = rs.contradictions(log_of(spark, claims()), 150.0).collect()
    assert [(r.assertion_id, r.provenance) for r in found] == [("a0001", "INFERRED")]


def test_confidence_then_time_then_id(spark):
    assert winner(spark, [dict(value={"os": "linux"}, confidence=0.7), dict(value={"os": "windows"}, confidence=0.95)], 150.0) == '{"os": "windows"}'
    assert winner(spark, [dict(value={"v": 1}, observed=5), dict(value={"v": 2}, observed=9)], 150.0) == '{"v": 2}'
    assert winner(spark, [dict(value={"v": 1}), dict(value={"v": 2})], 150.0) == '{"v": 1}'


@pytest.mark.parametrize("t, value", [(5.0, None), (15.0, '{"v": "A"}'), (20.0, '{"v": "B"}'), (25.0, '{"v": "B"}')])
def test_half_open_validity(spark, t, value):
    assert winner(spark, [dict(value={"v": "A"}, at=10, until=20), dict(value={"v": "B"}, at=20)], t) == value


def test_ttl_ends_an_edge(spark):
    m = Maker()
    m.node("a", "ASSET", {}, at=0)
    m.node("b", "ASSET", {}, at=0)
    m.edge("CONNECTS_TO", "a", "b", at=0, ttl=10, provenance=1)
    g = m.graph(spark)
    assert open_view(g, 5.0).edges.count() == 1
    assert open_view(g, 15.0).edges.count() == 0


def test_unknown_never_wins_and_is_not_live(spark):
    m = Maker()
    m.node("h1", "ASSET", {"v": 0}, provenance=0, confidence=1.0, evidence=())
    m.claim("node", "h1", {"v": 1}, confidence=0.5)
    m.node("h2", "ASSET", {"v": 0}, provenance=0, evidence=())
    g = m.graph(spark)
    assert rows(open_view(g, 150.0).nodes, "id", "value_json") == [("h1", '{"v": 1}')]
    assert rs.point_lookup(g.assertions, "h2", as_of=150.0).collect()[0].is_unknown


def test_order_independence(spark):
    m = Maker()
    for n, (h, c) in enumerate([("h1", "prod"), ("h2", "prod"), ("h3", "dev"), ("h1", "dev"), ("h2", "prod"), ("h1", "prod")]):
        m.claim("node", h, {"n": n}, context=c, confidence=0.5 + n / 20)
    def result(seed):
        g = m.graph(spark, order=lambda log: random.Random(seed).sample(log, len(log)))
        return rows(rs.resolve(g.assertions, 150.0), "context", "target_id", "winner", "contributors")
    m.node("h1", "ASSET")
    assert result(1) == result(2) == result(3)
    assert len(result(1)) == 4


def test_edges_to_nodes_of_another_context_are_dropped(spark):
    m = Maker()
    m.node("a", "ASSET", {})
    m.node("b", "ASSET", {}, context="shadow")
    m.edge("CONNECTS_TO", "a", "b")
    v = open_view(m.graph(spark), 150.0)
    assert v.nodes.count() == 1 and v.edges.count() == 0


def test_live_counts_over_time(spark):
    m = Maker()
    for n in range(1, 5):
        m.node(f"h{n}", "ASSET", {}, at=100 * n)
    g = m.graph(spark)
    assert [rs.computable(g.assertions, float(t), "default").count() for t in (50, 150, 250, 350, 450)] == [0, 1, 2, 3, 4]


def test_latest_excludes_finite_ends(spark):
    m = Maker()
    m.node("a", "ASSET", {}, until=1e12)
    m.node("b", "ASSET", {})
    assert rows(open_view(m.graph(spark)).nodes, "id") == [("b",)]


def test_change_count_is_not_bounded_in_time(spark):
    m = Maker()
    m.node("a", "ASSET", {})
    m.claim("node", "a", {}, at=500)
    assert rows(open_view(m.graph(spark), 150.0).nodes, "id", "changes", "contributors") == [("a", 2, 1)]


def test_decay_and_admissibility(spark):
    got = spark.sql("SELECT 1.0D AS b, 1 AS d UNION ALL SELECT 1.0D, 2 UNION ALL SELECT 1.0D, 3 UNION ALL SELECT 1.0D, 4 UNION ALL SELECT 0.3D, 1 UNION ALL SELECT 1.0D, 0").select(
        "b", "d", F.round(bands.decayed_confidence(F.col("b"), F.col("d")), 6).alias("c"), bands.inference_admissible(F.col("b"), F.col("d"))["admissible"].alias("ok")).collect()
    assert [(r.c, r.ok) for r in got] == [(0.8, True), (0.64, True), (0.512, True), (0.4096, False), (0.24, False), (1.0, False)]
    with pytest.raises(Exception, match="depth"):
        spark.range(1).select(bands.decayed_confidence(F.lit(1.0), F.lit(-1))).collect()


def test_six_decimals_like_exact_arithmetic(spark):
    r = random.Random(3)
    values = [r.randrange(10**7) / 10**7 for _ in range(4000)] + [0.1234565, 0.5, 1.0, 0.0, 2.5e-6]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", bands.round6(F.col("x")).alias("y")).collect():
        assert row.y == round(row.x, 6)


def test_numbering_spreads_a_hot_key(spark):
    """Two thirds of the rows share one key; numbers are those of a plain window."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.xxhash64("id").alias("v"))
    got = numbered(df, ["k"], [F.col("v").asc()])
    want = sorted(tuple(r) for r in df.selectExpr("k", "v", "row_number() OVER (PARTITION BY k ORDER BY v) AS rank").collect())
    assert rows(got, "k", "v", "rank") == want


def test_pages(spark):
    df = spark.range(30000).select(F.col("id"))
    assert [r.id for r in page(df, [F.col("id").desc()], 5, 3).collect()] == [29994, 29993, 29992]
    assert [r.id for r in page(df, [F.col("id").asc()], 20000, 3).collect()] == [20000, 20001, 20002]
    assert page(df, [F.col("id").asc()], 29990, None).count() == 10
    with pytest.raises(ValueError):
        page(df, [F.col("id").asc()], -1, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_views_at_fifty_times(spark, seed):
    """Targets with one and with many assertions, expiring ones, gaps and unknown winners: every view as one opened alone."""
    rng = random.Random(seed)
    m = Maker()
    for k in range(12):
        name = m.node(f"n{k}", "ASSET")
        for _ in range(rng.choice([1, 1, 2, 8])):
            at = rng.randint(0, 100)
            m.claim("node", name, {"v": rng.randint(0, 3)}, at=at, until=rng.choice([None, at + rng.randint(0, 30)]), provenance=rng.randint(0, 3), confidence=rng.choice([0.2, 0.9]),
                    observed=rng.randint(0, 3), ttl=rng.choice([None, None, 20]))
    for k in range(10):
        m.edge("DEPENDS_ON", f"n{k}", f"n{k + 1}", at=rng.randint(0, 100), until=rng.choice([None, 105]))
    g = m.graph(spark)
    times = [float(t) for t in range(0, 125, 25)] + [rng.uniform(0, 120) for _ in range(45)]
    views = open_views(g, times)
    columns = ["id", "winner", "value_json", "provenance", "valid_from", "valid_to", "contributors"]
    log = [dict(zip(g.assertions.columns, r)) for r in g.assertions.collect()]
    for v, t in zip(views, times):
        best = {}
        for a in log:
            end = min([x for x in (a["valid_to"], None if a["ttl"] is None else a["valid_from"] + a["ttl"]) if x is not None], default=None)
            if a["valid_from"] <= t and (end is None or t < end):
                best.setdefault((a["target_kind"], a["target_id"]), []).append(((-a["provenance"], -a["confidence"], -a["observed_at"], a["id"]), a, end))
        live = {k: (min(x)[1], min(x)[2], len(x)) for k, x in best.items() if min(x)[1]["provenance"] > 0}
        nodes = {i for kind, i in live if kind == "node"}
        want = sorted((i, a["id"], a["value_json"], a["provenance"], a["valid_from"], end, n) for (kind, i), (a, end, n) in live.items() if kind == "node")
        assert rows(v.nodes, *columns) == want
        edges = {i for kind, i in live if kind == "edge" and set(m.edges[i][2:4]) <= nodes}
        assert {r.id for r in v.edges.collect()} == edges
        assert {r.id: r.changes for r in v.nodes.collect()} == {i: sum(a["target_id"] == i and a["target_kind"] == "node" for a in log) for i in nodes}


def test_a_view_reads_what_begins_by_its_time(spark, tmp_path):
    """The time reaches the scan, and nothing sorts the log."""
    path = str(tmp_path / "log")
    m = Maker()
    for k in range(6):
        m.node(f"n{k}", "ASSET", {"v": k}, at=k * 10)
    g = m.graph(spark)
    g.assertions.write.parquet(path)
    log = spark.read.schema(g.assertions.schema).parquet(path)
    states = rs.States(log, [25.0], "default", "node")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = states.at(0)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(valid_from,25.0)" in plan and "SortAggregate" not in plan and states.best is None
    assert sorted(r.target_id for r in states.at(0).collect()) == ["n0", "n1", "n2"]
