"""Registered queries against their DuckDB SQL on the smallest tables (a selection; the driver compares all)."""

import glob
import os

import pytest

import __spark_entry__ as entry
from registry.oracle import all_sql
from registry.queries import all_queries
from tidegraph.session import staging_root

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "a06_scan_results", "b07_contexts", "c03_ranked_assertions", "c04_resolved_states", "c06_contradictions", "c08_live_edges", "d07_left_to_right", "e05_dependency_metrics", "e06_impact_scores",
    "f10_exposure_findings", "g03_risk", "m01_intent",
]
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def plain(rows, names):
    def text(x):
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_comparison_sees_differences():
    assert plain([(1, "a")], ["x", "y"]) == plain([("a", 1.0)], ["y", "x"])
    assert plain([(1, "a")], ["x", "y"]) != plain([(2, "a")], ["x", "y"])


@needs_tables
@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert rows and plain([tuple(r) for r in df.collect()], df.columns) == plain(rows, names)


def test_exact_ingestion_writes_its_log_in_parts(spark, tmp_path):
    """The log is not sent through one task for each of the two batches."""
    pytest.importorskip("duckdb").sql(
        "COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(i AS INTEGER)) AS ts, i % 7 AS user_id, ['signup', 'view', 'click'][i % 3 + 1] AS event_type, "
        f"i * 1.0 AS value, '{{\"k\": 1}}' AS props FROM range(600) t(i)) TO '{tmp_path}/events.parquet'")
    sizes = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        found = entry.queries()["k01_exact_ingestion"](spark, str(tmp_path))
        assert found.count() == 600
        late = max(glob.glob(f"{staging_root(spark).removeprefix('file:')}/q*_late"))
        assert len(glob.glob(f"{late}/part-*")) > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
