import json

import pytest
from pyspark.sql import functions as F

from tests.small import Maker, rows
from tidegraph.functions.text import intent
from tidegraph.operators import changes as ch
from tidegraph.operators import classify as cl
from tidegraph.operators import query as qy
from tidegraph.operators import reports as rp
from tidegraph.operators import rules as ru
from tidegraph.operators import topology as tp
from tidegraph.plans import expand as ex
from tidegraph.plans.components import capped_reach
from tidegraph.plans.view import open_view, open_views

C = qy.Condition


def payments():
    m = Maker()
    m.node("api", "SERVICE", {"name": "payment-api-prod", "tags": {"env": "prod", "team": "payments"}})
    m.node("store", "DATASTORE", {"name": "x", "tags": {"sensitivity": "pci", "owner:tech": "tech"}})
    m.node("plain", "SERVICE", {"name": "plain", "tags": "none"})
    m.node("files", "DATASTORE", {"name": "user-files"})
    m.node("logs", "DATASTORE", {"name": "log-store"})
    m.edge("DEPENDS_ON", "api", "store")
    m.edge("TRUSTS", "files", "plain")
    m.edge("TRUSTS", "logs", "plain")
    return m


@pytest.fixture(scope="module")
def view(spark):
    return open_view(payments().graph(spark), 150.0)


def test_classification(view):
    assert dict(rows(cl.environment(view), "id", "environment")) == {"api": "Production", "store": "Unknown", "plain": "Unknown", "files": "Unknown", "logs": "Unknown"}
    owners = {r.id: r for r in cl.ownership(view).collect()}
    assert (owners["store"].team, owners["store"].technical, owners["store"].business) == ("payments", "tech", None)
    levels = {r.id: (r.level, round(r.confidence, 3), r.evidence_kind) for r in cl.sensitivity(view).collect()}
    assert levels == {"store": ("Restricted", 1.0, "tag"), "api": ("Confidential", 0.7, "name"), "files": ("Restricted", 0.8, "name"),
                      "logs": ("Internal", 0.7, "name"), "plain": ("Restricted", 0.72, "downstream")}
    crit = {r.id: (r.level, r.score) for r in cl.business_criticality(view).collect()}
    assert crit["store"] == ("Critical", 95)


def test_recommendations_and_what_follows(view):
    recs = {(r.node_id, r.category): r for r in ru.recommendations(view).collect()}
    assert ("store", "EXPOSURE") in recs and ("files", "CRITICAL_ASSET") in recs and ("store", "CRITICAL_ASSET") not in recs
    assert recs[("store", "EXPOSURE")].reasons == ["Contains Restricted data", "Publicly accessible over the network", "Affects 1 downstream dependencies"]
    assert rows(ru.recommendation_by_id(view, "rec-exp-db-store"), "id") == [("rec-exp-db-store",)]
    scores = dict(rows(ru.compliance(view), "framework", "score"))
    assert scores == {"CIS": 100, "ISO 27001": 100, "NIST": 50, "PCI DSS": 0, "SOC 2": 0}
    assert ru.overall_compliance(view).collect()[0].overall_score == 50
    gaps = {(r.target_id, r.category) for r in ru.governance(view).collect()}
    assert ("files", "ACCOUNTABILITY_GAP") in gaps and ("store", "OWNERSHIP_GAP") not in gaps
    steps = ru.reasoning(ru.recommendation_by_id(view, "rec-exp-db-store")).collect()[0].steps
    assert [s.node_id for s in steps] == [None, "store"]


def test_unowned_sensitive_store(spark):
    m = Maker()
    m.node("d", "DATASTORE", {"name": "db", "tags": {"sensitivity": "pci"}})
    v = open_view(m.graph(spark), 150.0)
    assert {r.title for r in ru.recommendations(v).collect()} == {"Exposed Database Detected", "Critical Asset Missing Ownership"}
    assert [r.team for r in ru.business_units(v).collect()] == ["Unassigned"]
    assert rows(ru.lifecycle(v, 150.0 + 86400 * 40), "state", "id") == [("dormant", "d"), ("orphaned", "d")]


def test_lifecycle_new(spark):
    m = Maker()
    m.node("a", "ASSET", {}, at=100)
    v = open_view(m.graph(spark), 150.0)
    assert rows(ru.lifecycle(v, 150.0), "state", "id") == [("new", "a"), ("orphaned", "a")]
    assert ru.lifecycle_summary(v, 150.0).collect()[0].asDict() == {"total_assets": 1, "orphaned_count": 1, "dormant_count": 0}


def test_changes_and_alerts(spark):
    m = Maker()
    m.node("a", "ASSET", {"name": "first"}, at=100, until=300)
    m.node("b", "ASSET", {"name": "second"}, at=200)
    g = m.graph(spark)
    assert ch.detect_changes(g, 150.0, 150.0).count() == 0
    got = ch.detect_changes(g, 50.0, 150.0)
    assert rows(got, "type", "target_id", "name") == [("NEW_ASSET", "a", "first")]
    alert = ch.alerts(got).collect()[0]
    assert (alert.severity, alert.title, alert.description) == ("LOW", "New Asset Discovered", "A new asset was detected: first")
    later = ch.detect_changes(g, 250.0, 350.0)
    assert rows(later, "type", "target_id") == [("REMOVED_ASSET", "a")]
    assert ch.alerts(later).count() == 0


def test_risk_rise_is_an_alert(spark):
    m = Maker()
    m.node("a", "ASSET", {"business_importance": 1.0}, at=100)
    m.claim("node", "a", {"business_importance": 1.0, "public": True}, at=200, confidence=0.99)
    before, after = open_views(m.graph(spark), [150.0, 250.0])
    found = ch.risk_changes(before, after)
    row = found.collect()[0]
    assert (row.type, row.old_score) == ("RISK_INCREASE", 0) and row.new_score > 30
    assert [r.severity for r in ch.alerts(found).collect()] == ["CRITICAL"]


def test_new_edge_rules(spark):
    m = Maker()
    for n, k in (("s", "SERVICE"), ("a", "ASSET"), ("internet", "ZONE"), ("z", "ZONE")):
        m.node(n, k, {}, at=100)
    for a, b in (("s", "z"), ("a", "z"), ("a", "internet")):
        m.edge("EXPOSED_TO", a, b, at=200)
    m.edge("OWNED_BY", "a", "s", at=200)
    before, after = open_views(m.graph(spark), [150.0, 250.0])
    found = ch.edge_changes(before, after)
    assert rows(found, "type", "target_id", "other") == [
        ("NEW_EXPOSED_SERVICE", "s", "z"), ("NEW_EXPOSURE", "a", "z"), ("NEW_INTERNET_PATH", "a", "internet"), ("OWNERSHIP_DRIFT", "a", "s")]
    assert sorted(r.severity for r in ch.alerts(found).collect()) == ["CRITICAL", "HIGH", "HIGH", "MEDIUM"]


@pytest.fixture(scope="module")
def shop(spark):
    m = Maker()
    m.node("a1", "ASSET", {"exposure": "internet", "risk": 8, "score": 0.9, "Owner": "Ann", "live": True})
    m.node("a2", "ASSET", {"exposure": "internal", "risk": 4, "score": 1.0, "none": None, "live": 0})
    m.node("a3", "ASSET", {"risk": "443"})
    m.node("s1", "SERVICE", {"port": 443})
    m.edge("CONNECTS_TO", "a1", "s1")
    m.edge("HOSTS", "a2", "s1")
    return open_view(m.graph(spark), 150.0)


@pytest.mark.parametrize("where, ids", [
    ([C("exposure", "=", "internet")], ["a1"]),
    ([C("exposure", "!=", "internet")], ["a2"]),
    ([C("risk", "=", 443)], []),
    ([C("risk", "=", "443")], ["a3"]),
    ([C("risk", "=", 8.0)], ["a1"]),
    ([C("risk", ">", 5)], ["a1", "a3"]),
    ([C("risk", "<=", "8")], ["a1", "a2"]),
    ([C("exposure", ">", 1)], []),
    ([C("risk", ">", "many")], []),
    ([C("risk", "IN", [4, "443"])], ["a2", "a3"]),
    ([C("exposure", "CONTAINS", "INTER")], ["a1", "a2"]),
    ([C("risk", "CONTAINS", 4)], ["a2", "a3"]),
    ([C("owner", "=", "Ann")], ["a1"]),
    ([C("none", "!=", 1)], []),
    ([qy.flag("live")], ["a1"]),
    ([C("live", "=", False)], ["a2"]),
    ([C("confidence", ">=", 0.95), C("id", "!=", "a1")], ["a2", "a3"]),
    ([C("risk", "=", 8), "OR", C("risk", "=", 4), "AND", C("exposure", "=", "internal")], ["a2"]),
])
def test_conditions(shop, where, ids):
    assert [r.id for r in qy.find_entities(shop, "ASSETS", where).collect()] == ids


def test_sort_limit_and_connection(shop):
    order = lambda **k: [r.id for r in qy.find_entities(shop, "ASSETS", **k).collect()]
    assert order(order_by="risk") == ["a2", "a1", "a3"]
    assert order(order_by="exposure", descending=True) == ["a1", "a2", "a3"]
    assert order(order_by="risk", limit=1) == ["a2"]
    assert order(connected="a1", depth=2) == ["a2"]
    assert order(connected="s1") == ["a1", "a2"]
    for bad in (dict(limit=-1), dict(depth=0, connected="a1")):
        with pytest.raises(ValueError):
            order(**bad)


def test_search(shop):
    assert rows(qy.search_graph(shop, "HOSTS"), "id") == [("a2-HOSTS-s1",)]
    assert rows(qy.search_graph(shop, "owner"), "id") == [("a1",)]
    with pytest.raises(ValueError):
        qy.search_graph(shop, " ")
    first, total = qy.search_values(shop, "inter")
    assert [r.id for r in first.collect()] == ["a1", "a2"] and total.collect()[0]["count"] == 2
    assert rows(qy.search_everything(shop, "intern"), "id", "match_field") == [("a1", "exposure"), ("a2", "exposure")]
    assert rows(qy.search_everything(shop, "intern"), "id", "type") == [("a1", "ASSET"), ("a2", "ASSET")]
    assert qy.search_everything(shop, "i", least=2).count() == 0 and qy.search_everything(shop, "i").count() > 0
    assert [r.id for r in qy.search_values(shop, "inter", limit=1)[0].collect()] == ["a1"]


def test_detail_and_trace(spark, shop):
    g = payments().graph(spark)
    identity, state, log = qy.node_detail(g, "api", as_of=150.0)
    assert json.loads(identity.collect()[0].key_json) == {"name": "api"} and state.count() == 1 and log.count() == 1
    assert rows(qy.edge_trace(shop, "a1-CONNECTS_TO-s1"), "source", "target", "tier", "from_source", "ref") == [("a1", "s1", "OBSERVED", "scan", "ev")]


def test_reports_are_written(spark, view, tmp_path):
    for report in rp.REPORTS:
        for form in ("csv", "json"):
            assert rp.write_report(view, report, str(tmp_path / form), form)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv" / "executive_board_report" / "board")).collect()[0]
    assert (back.total_assets, back.compliance_score) == ("0", "50")


def test_intents(spark):
    texts = {"Which assets are exposed to the internet?": "EXPOSURE", "what is my Highest Risk": "RISK", "who owns db": "ASSET", "if db fails?": "DEPENDENCY",
             "are we PCI compliant": "COMPLIANCE", "what changed": "TREND", "what to fix first": "EXECUTIVE", "hello": "UNKNOWN", "internet exposed": "UNKNOWN", "exposed\ninternet": "UNKNOWN"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", intent(F.col("t")).alias("i"))
    assert {r.t: r.i for r in df.collect()} == texts


def _mixed():
    """Stores with 0 to 14 impacted nodes: direct ones, rows, a ring and a self-loop, and one whose only dependent is a hub."""
    m = Maker()
    for n in (0, 1, 3, 4, 10, 11, 14):
        m.node(f"fan{n:02d}", "DATASTORE", {"name": f"fan{n}"})
        m.node(f"row{n:02d}", "DATASTORE", {"name": f"row{n}"})
        before = f"row{n:02d}"
        for k in range(n):
            m.node(f"f{n:02d}-{k:02d}", "SERVICE", {"port": 1})
            m.node(f"r{n:02d}-{k:02d}", "SERVICE", {"port": 1})
            m.edge("DEPENDS_ON", f"f{n:02d}-{k:02d}", f"fan{n:02d}")
            m.edge("DEPENDS_ON", f"r{n:02d}-{k:02d}", before)
            before = f"r{n:02d}-{k:02d}"
    for k in range(4):
        m.node(f"ring{k}", "DATASTORE", {"name": f"ring{k}"})
    for k in range(4):
        m.edge("DEPENDS_ON", f"ring{k}", f"ring{(k + 1) % 4}")
    m.node("self", "DATASTORE", {"name": "self"})
    m.edge("DEPENDS_ON", "self", "self")
    m.node("behind", "DATASTORE", {"name": "behind"})
    m.edge("DEPENDS_ON", "fan14", "behind")
    return m


def _no_sizes(monkeypatch):
    def fail(*_, **__):
        raise AssertionError("exact blast radii of all named nodes")
    monkeypatch.setattr(ru, "blast_counts", fail)
    monkeypatch.setattr(ru, "cycles", fail)


@pytest.mark.parametrize("repeated", [False, True])
def test_findings_are_the_recommendations_without_exact_blast_radii(spark, monkeypatch, repeated):
    graph = _mixed().graph(spark)
    if repeated:
        graph.nodes = graph.nodes.unionByName(graph.nodes.where("id IN ('f03-01', 'r10-05')"))
    names = ["id", "severity", "category", "title", "description", "node_id", "rule"]
    whole = open_view(graph, 150.0)
    want = rows(ru.recommendations(whole), *names)
    top = [tuple(r) for r in ru.top_recommendations(whole, 7).select("id", "severity", "reasons").collect()]
    one = rows(ru.recommendation_by_id(whole, "rec-exp-db-row10"), "id", "severity", "reasons")
    status, plan = rows(ru.control_status(whole), "control_id", "passed", "recommendation_id", "reason"), rows(rp.action_plan(whole), "id", "severity")
    score = rows(ru.compliance(whole), "framework", "controls", "passed", "failed", "score")
    _no_sizes(monkeypatch)
    v = open_view(graph, 150.0)
    assert rows(ru.findings(v), *names) == want and len({r[1] for r in want}) > 1
    assert [tuple(r) for r in ru.top_recommendations(v, 7).select("id", "severity", "reasons").collect()] == top
    assert rows(ru.recommendation_by_id(v, "rec-exp-db-row10"), "id", "severity", "reasons") == one and one
    assert rows(ru.control_status(v), "control_id", "passed", "recommendation_id", "reason") == status
    assert rows(rp.action_plan(v), "id", "severity") == plan
    assert rows(ru.compliance(v), "framework", "controls", "passed", "failed", "score") == score


def test_reach_is_counted_up_to_a_number(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "f"), ("f", "g")] + [("h", f"h{k}") for k in range(6)] + [("i", "h")]
    found = capped_reach(spark.createDataFrame(links, "node string, next string"), spark.createDataFrame([(n,) for n in "abcdefghi"], "node string"), 4)
    assert dict(rows(found, "node", "reach")) == {"a": 3, "b": 3, "c": 3, "d": 1, "e": 2, "f": 1, "h": 4, "i": 4}


def test_trends_and_alerts_need_no_exact_blast_radii(spark, monkeypatch):
    _no_sizes(monkeypatch)
    graph = _mixed().graph(spark)
    assert [r.critical_findings for r in ch.trend(graph, 150.0).where("label = 'current'").collect()]
    assert ch.alerts(ch.detect_changes(graph, 50.0, 150.0)).where("type = 'COMPLIANCE_FAILURE'").count() > 0


def test_a_wide_blast_radius_is_not_searched_from_its_node(spark, monkeypatch):
    monkeypatch.setattr(ex, "FULL", 5)
    v = open_view(_mixed().graph(spark), 150.0)
    assert tp.blast_of_few(v, spark.createDataFrame([("fan14",)], "id string")) is None
    assert ru.recommendation_by_id(v, "rec-exp-db-fan14").collect()[0].reasons[2] == "Affects 14 downstream dependencies"


def test_a_trend_holds_one_view_at_a_time(spark, monkeypatch):
    """The tables of a view are gone when the next one is made; the ends of edges are looked up in a job of their own."""
    from tidegraph.plans import view as vw
    held, most, plans = [], [], {}
    stage, drop = vw.stage, vw.View.drop

    def counted(df, name):
        if name == "live_edges":
            held.append(name)
            most.append(len(held))
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(vw, "stage", counted)
    monkeypatch.setattr(vw.View, "drop", lambda v: (held.pop(), drop(v)))
    rows_ = {r.label: (r.node_count, r.total_risk) for r in ch.trend(_mixed().graph(spark), 150.0 + 8 * 86400).collect()}
    assert set(rows_) == {"current", "last_week", "last_month", "last_quarter"} and rows_["current"] == rows_["last_week"] and rows_["last_month"] == (0, 0)
    assert most == [1, 1, 1, 1]
    assert "LeftSemi" in plans["live_ends"] and "LeftSemi" not in plans["live_edges"].replace("LeftSemi, (target_id", "")
