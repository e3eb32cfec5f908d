"""Times of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads. The suite
first runs untimed on the smallest tables, so that class loading and code generation are not measured, then
timed on the chosen ones. The graph and the view are built once and timed as such; every further query runs
once on that view and is written out in full (noop sink). What one query stages, later ones read, as in a
deployment, so the first of a kind carries the cost: `exposure` the parsed attributes, `blast_counts` the
cycles of the dependency graph.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from tidegraph.operators import changes, classify, exposure, query, rules, scoring, topology  # noqa: E402
from tidegraph.plans import resolve  # noqa: E402
from tidegraph.plans.view import open_view, open_views  # noqa: E402
from tidegraph.session import tune  # noqa: E402
from tidegraph.sources import star_tables as st  # noqa: E402
from tidegraph.functions.text import intent  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    suite(spark, small if os.path.isdir(small) else folder)
    times = suite(spark, folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


def suite(spark: SparkSession, folder: str) -> dict[str, float]:
    """Seconds per query."""
    times: dict[str, float] = {}

    def timed(name: str, run):
        start = time.time()
        out = run()
        for part in out if isinstance(out, tuple) else (out,):
            if isinstance(part, DataFrame):
                part.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        return out

    log = st.event_log(spark, folder)
    timed("resolve_events", lambda: resolve.resolve(log, 1705276800.0))
    timed("rank_contributions", lambda: resolve.contributing(log, 1705276800.0))
    graph = timed("graph_build", lambda: st.derive_graph(spark, folder))
    view = timed("view_build", lambda: open_view(graph, st.NOW))
    timed("dependency_metrics", lambda: topology.dependency_metrics(view))
    timed("exposure", lambda: exposure.exposure_findings(view))
    timed("risk", lambda: scoring.risk(view))
    timed("impact_scores", lambda: topology.impact_scores(view))
    timed("subgraph", lambda: topology.subgraph(view, "c_2", 2, 500))
    timed("shortest_path", lambda: topology.shortest_path(view, "s_7", "p_9"))
    timed("find_entities", lambda: query.find_entities(view, "SERVICES", [query.Condition("port", "=", 443), "AND", query.Condition("name", "CONTAINS", "prod")], order_by="name"))
    timed("search", lambda: query.search_graph(view, "promo"))
    timed("assessment", lambda: classify.assessment(view))
    timed("blast_counts", lambda: topology.blast_counts(view))
    timed("recommendations", lambda: rules.recommendations(view))
    timed("compliance", lambda: rules.compliance(view))
    timed("governance", lambda: rules.governance(view))
    timed("changes", lambda: changes.node_changes(*open_views(graph, [st.EARLIER, st.NOW])))
    timed("intent", lambda: st.read(spark, folder, "documents").select("doc_id", intent(F.col("text")).alias("intent")))
    return times


if __name__ == "__main__":
    main()
