import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from tests.small import Maker, eight_nodes, rows
from tidegraph.operators import exposure as ex
from tidegraph.operators import scoring as sc
from tidegraph.operators import topology as tp
from tidegraph.plans import components, contract, expand
from tidegraph.plans.view import open_view
from tidegraph.sources import star_tables as st


@pytest.fixture(scope="module")
def view(spark):
    return open_view(eight_nodes().graph(spark), 150.0)


def test_dependencies_of_the_chain(view):
    got = {r.entity_id: r for r in tp.dependency_metrics(view).collect()}
    assert (got["app"].upstream_count, got["app"].downstream_count, got["app"].total_dependencies, got["app"].dependency_rank) == (1, 1, 2, 1)
    assert (got["db"].upstream_count, got["db"].downstream_count) == (0, 1)
    assert "late" not in got


def test_impact_of_the_database_host(view):
    assert rows(tp.impact_paths(view).where("entity_id = 'db'"), "affected_id", "depth") == [("app", 1), ("web", 2)]
    assert {r.entity_id: r.impact_score for r in tp.impact_scores(view).collect()}["db"] == 30


def test_exposure(view):
    got = {(r.entity_id, r.finding_type) for r in ex.exposure_findings(view).collect()}
    assert {("web", "PUBLIC_ZONE_ASSET"), ("web", "EXTERNALLY_REACHABLE_ASSET"), ("svc", "INTERNET_FACING_SERVICE"), ("app", "EXTERNALLY_REACHABLE_ASSET")} <= got
    assert ("db", "EXTERNALLY_REACHABLE_ASSET") not in got
    refs = {(r.entity_id, r.finding_type) for r in ex.exposure_evidence(view).collect()}
    assert refs == got


def test_scores(view):
    risk = {r.entity_id: r for r in sc.risk(view).collect()}
    assert (risk["ds"].score, risk["ds"].category) == (0, "LOW")
    assert risk["web"].score > 0
    for r in sc.criticality(view).collect():
        assert r.score == round(100 * sum(f.contribution for f in r.factors.values()))


def test_two_observations_are_one_change(view):
    got = {r.entity_id: r.factors["change_frequency"].value for r in sc.criticality(view).collect()}
    assert (got["db"], got["app"]) == (0.2, 0.0)


def chain():
    m = Maker()
    m.node("internet", "ASSET", {"name": "Internet", "public_ip": "8.8.8.8"})
    m.node("lb", "ASSET", {"name": "LB", "type": "LoadBalancer"})
    m.node("web", "ASSET", {"name": "Web"})
    m.node("db", "DATASTORE", {"name": "DB"})
    for kind, a, b in [("CONNECTS_TO", "internet", "lb"), ("CONNECTS_TO", "lb", "web"), ("CONNECTS_TO", "web", "db"), ("DEPENDS_ON", "web", "db")]:
        m.edge(kind, a, b, confidence=0.9)
    return m


def test_paths_and_blast_radius(spark):
    v = open_view(chain().graph(spark), 200.0)
    path = tp.shortest_path(v, "internet", "db").collect()[0]
    assert (path.distance, path.nodes, path.score, path.severity) == (3, ["internet", "lb", "web", "db"], 90, "HIGH")
    assert tp.shortest_path(v, "db", "internet").count() == 0
    here = tp.shortest_path(v, "db", "db").collect()[0]
    assert (here.distance, here.edges, here.severity, here.score) == (0, [], "CRITICAL", 100)
    assert rows(tp.blast_radius(v, "db"), "id") == [("internet",), ("lb",), ("web",)]
    assert {r.id: r.total_impacted for r in tp.blast_counts(v).collect()} == {"db": 3, "web": 2, "lb": 1, "internet": 0}
    assert rows(tp.dependent_kinds(v).where("id = 'db'"), "assets", "services") == [(1, 0)]
    # parallel edges are separate paths
    assert sorted(r.distance for r in tp.all_paths(v, "internet").collect()) == [1, 2, 3, 3]
    assert sorted(r.distance for r in tp.all_paths(v, "internet", 2).collect()) == [1]
    assert len([r for r in ex.exposure_buckets(v).collect() if r.bucket == "internet_reachable_assets"]) == 2


def random_graph(seed, nodes=40, edges=90):
    r = random.Random(seed)
    m = Maker()
    names = [f"n{i:02d}" for i in range(nodes)]
    kinds = ["ASSET", "SERVICE", "IDENTITY", "DATASTORE", "ZONE"]
    for n in names:
        m.node(n, r.choice(kinds), {"name": n})
    for _ in range(edges):
        a, b = r.choice(names), r.choice(names[: nodes // 2] if r.random() < 0.6 else names)
        m.edge(r.choice(["DEPENDS_ON", "CONNECTS_TO", "TRUSTS", "HOSTS"]), a, b, confidence=r.choice([0.4, 0.7, 0.9, 0.99]))
    return m


def brute(m):
    """Dependents per node, by plain Python."""
    dep = {n: set() for n in m.nodes}
    for _, kind, src, dst, _ in m.edges.values():
        if kind != "HOSTS":
            dep[dst].add(src)
    def levels(root, limit=None):
        seen, frontier, out, d = {root}, {root}, {}, 0
        while frontier and (limit is None or d < limit):
            d += 1
            frontier = {x for f in frontier for x in dep[f]} - seen
            seen |= frontier
            out.update({x: d for x in frontier})
        return out
    def closure(root):
        seen, todo = set(), [root]
        while todo:
            for x in dep[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen
    return levels, closure


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_against_brute_force(spark, seed):
    m = random_graph(seed)
    v = open_view(m.graph(spark), 150.0)
    levels, closure = brute(m)
    got = {r.id: r for r in tp.blast_counts(v).collect()}
    for n in m.nodes:
        want = closure(n)
        assert got[n].total_impacted == len(want), n
        assert got[n].datastore == sum(m.nodes[x][1] == "DATASTORE" for x in want)
        assert got[n].unknown == sum(m.nodes[x][1] == "ZONE" for x in want)
    paths = {(r.entity_id, r.affected_id): r.depth for r in tp.impact_paths(v).collect()}
    assert paths == {(n, x): d for n in m.nodes for x, d in levels(n, 3).items()}
    scores = {r.entity_id: r.impact_score for r in tp.impact_scores(v).collect()}
    for n in m.nodes:
        weights = {1: 1.0, 2: 0.5, 3: 0.25}
        assert scores[n] == round(100 * min(1.0, sum(weights[d] for d in levels(n, 3).values()) / 5.0)), n


def test_components_without_the_busiest_shortcut(spark, monkeypatch):
    """All components by coloring: three rings joined one way, and a loose chain."""
    monkeypatch.setattr(components, "_around_busiest", components._by_color)
    pairs = [(f"{r}{i}", f"{r}{(i + 1) % 4}") for r, i in product("abc", range(4))] + [("a0", "b1"), ("b2", "c3"), ("c0", "x"), ("x", "y")]
    found = components.cyclic_components(spark.createDataFrame(pairs, "node string, next string")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[f"{r}{i}" for i in range(4)] for r in "abc"]


def test_no_cycle_no_components(spark):
    assert components.cyclic_components(spark.createDataFrame([("a", "b"), ("b", "c")], "node string, next string")) is None


def number_links(pairs, spark):
    return spark.createDataFrame([(f"n{a:05d}", f"n{b:05d}") for a, b in pairs], "node string, next string")


@pytest.fixture
def staged(monkeypatch):
    """Names of the tables that components and contraction stage."""
    names = []
    for module in (components, contract, expand):
        monkeypatch.setattr(module, "stage", lambda df, name, real=module.stage: names.append(name) or real(df, name))
    return names


def test_a_long_chain_takes_a_logarithm_of_rounds(spark, staged):
    n = 2000
    links = number_links([(k, k + 1) for k in range(n)], spark)
    _, turns, rounds = contract.shrunk(links)
    assert sum(t.runs.count() for t in turns if t.runs is not None) == n - 3 and rounds <= 20
    assert components.cyclic_components(links) is None
    ids = links.select("node").union(links.select("next")).distinct()
    counts = {r.node: r.total for r in components.reach_counts(links, ids.withColumn("total", F.lit(1)), ids, None).collect()}
    assert counts == {f"n{k:05d}": n - k for k in range(n)}
    assert len(staged) < 120


def test_a_long_ring_takes_a_logarithm_of_rounds(spark, staged):
    n = 2000
    links = number_links([(k, (k + 1) % n) for k in range(n)] + [(5, n), (n, n + 1)], spark)
    found = components.cyclic_components(links).collect()
    assert len(found) == n and len({r.component for r in found}) == 1
    ids = links.select("node").union(links.select("next")).distinct()
    counts = {r.node: r.total for r in components.reach_counts(links, ids.withColumn("total", F.lit(1)), ids, components.cyclic_components(links)).collect()}
    assert counts == {**{f"n{k:05d}": n + 2 for k in range(n)}, f"n{n:05d}": 1}
    assert len(staged) < 220


def strong_components(pairs):
    nodes = sorted({x for p in pairs for x in p})
    reach = {a: {a} for a in nodes}
    while True:
        more = {a: r | {y for x, y in pairs if x in r} for a, r in reach.items()}
        if more == reach:
            break
        reach = more
    groups = {frozenset(b for b in reach[a] if a in reach[b]) for a in nodes}
    return {g for g in groups if len(g) > 1}, {a: {y for x, y in pairs if x in reach[a]} for a in nodes}


@pytest.mark.parametrize("seed", range(6))
def test_runs_rings_and_branches_against_brute_force(spark, seed):
    """Sparse graphs: cycles of runs, runs that leave and come back, chords, loops and doubled links."""
    rng = random.Random(seed)
    pairs, top = set(), 0
    for _ in range(6):  # runs from one known node to another one
        length, a, b = rng.randint(1, 7), rng.randint(0, top), rng.randint(0, top)
        way = [a, *range(top + 1, top + length + 1), b]
        pairs |= set(zip(way, way[1:]))
        top += length
    pairs |= {(rng.randint(0, top), rng.randint(0, top)) for _ in range(rng.randint(0, 4))}
    links = number_links(sorted(pairs), spark)
    groups, reach = strong_components(pairs)
    found = components.cyclic_components(links)
    got = {}
    for r in found.collect() if found is not None else []:
        got.setdefault(r.component, set()).add(int(r.node[1:]))
    assert set(map(frozenset, got.values())) == groups
    ids = links.select("node").union(links.select("next")).distinct()
    for at_once in (components.ROOTS, 2):
        counts = components.reach_counts(links, ids.withColumn("total", F.lit(1)), ids, found, at_once)
        assert {int(r.node[1:]): r.total for r in counts.collect()} == {a: len(r) for a, r in reach.items() if r}


def test_split_hubs_give_the_same_expansion(spark):
    """A third of all links leave one node; its links are spread over slices."""
    links = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), "id")).alias("node"), F.concat(F.lit("m"), "id").alias("next"))
    plain, cut = expand.make_links(links), expand.make_links(links, split_rows=100)
    assert plain.hubs is None and cut.hubs.count() == 1
    assert cut.rows.where("node = 'hub'").select("_slice").distinct().count() == 10
    frontier = spark.createDataFrame([("hub",), ("n1",)], "node string")
    assert rows(plain.expand(frontier), "node", "next") == rows(cut.expand(frontier), "node", "next")


def test_neighbourhood_and_subgraph(spark, view):
    assert rows(tp.connected_to(view, "svc", 2), "id", "depth") == [("app", 2), ("web", 1), ("zi", 2)]
    nodes, edges = tp.subgraph(view, "svc", 2, 3)
    assert rows(nodes, "id", "depth") == [("app", 2), ("svc", 0), ("web", 1)]
    assert rows(edges, "id") == [("web-CONNECTS_TO-app",), ("web-DEPENDS_ON-app",), ("web-HOSTS-svc",), ("web-IN_ZONE-zi",)]


def all_simple(edges, source, most):
    """(nodes, edge ids) of the simple paths with at most ``most`` nodes, by depth-first search."""
    out, todo = [], [((source,), ())]
    while todo:
        nodes, used = todo.pop()
        if used:
            out.append((nodes, used))
        if len(nodes) < most:
            todo += [((*nodes, b), (*used, e)) for e, a, b in edges if a == nodes[-1] and b not in nodes]
    return out


@pytest.mark.parametrize("listed", [1000, 3])
def test_paths_on_random_graphs(spark, listed):
    """Short lists and staged tables give the same rows as plain searches."""
    v = open_view(random_graph(11, 18, 40).graph(spark), 150.0)
    edges = [tuple(r) for r in v.edges.select("id", "src", "dst").collect()]
    names = sorted({x for _, a, b in edges for x in (a, b)})
    source = max(names, key=lambda n: len(all_simple(edges, n, 4)))
    every = all_simple(edges, source, 6)
    assert {(tuple(r.nodes), tuple(r.edges)) for r in tp.all_paths(v, source, 4).collect()} == {p for p in every if len(p[0]) <= 4}
    ends = sorted({p[0][-1] for p in every}, key=lambda n: -min(len(p[1]) for p in every if p[0][-1] == n))
    for target, most in [(ends[0], 6), *([(ends[-1], 5), (source, 3), ("nowhere", 2)] if listed > 3 else [])]:
        to = [p for p in every if p[0][-1] == target]
        if listed > 3 or most > 5:
            got = tp.all_paths(v, source, most, target, listed).collect()
            assert sorted((tuple(r.nodes), tuple(r.edges)) for r in got) == sorted(p for p in to if len(p[0]) <= most)
        if to:
            best = min(to, key=lambda p: (len(p[1]), p[1]))
            got = tp.shortest_path(v, source, target, listed).first()
            assert (tuple(got.nodes), tuple(got.edges), got.distance) == (*best, len(best[1]))
    near = {source: 0}
    for d in (1, 2):
        near |= {y: d for _, a, b in edges for x, y in ((a, b), (b, a)) if near.get(x) == d - 1 and y not in near}
    want = sorted((n, d) for n, d in near.items() if d)
    assert rows(tp.connected_to(v, source, 2, listed), "id", "depth") == want
    nodes, found = tp.subgraph(v, source, 2, 7, listed)
    kept = sorted(near.items(), key=lambda x: (x[1], x[0]))
    # the second level is not looked at once seven nodes are known
    first = [x for x in kept if x[1] < 2]
    kept = (first if len(first) >= 7 else kept)[:7]
    assert rows(nodes, "id", "depth") == sorted(kept)
    inner = {n for n, d in kept if d < 2}
    assert rows(found, "id", "src", "dst") == sorted(e for e in edges if inner & {e[1], e[2]})


def test_long_path_and_pruned_paths(spark):
    """A path of 40 edges with wrong turns; paths to a target do not list what leads elsewhere."""
    m = Maker()
    for k in range(41):
        m.node(f"n{k:02}", "ASSET", {"name": str(k)})
    for k in range(40):
        m.edge("CONNECTS_TO", f"n{k:02}", f"n{k + 1:02}", confidence=0.5 + k / 100)
        m.edge("DEPENDS_ON", f"n{k:02}", f"n{k + 1:02}", confidence=0.4)
    for k in range(60):
        m.node(f"x{k:02}", "ASSET", {"name": str(k)})
        m.edge("CONNECTS_TO", "n01", f"x{k:02}")
        m.edge("CONNECTS_TO", f"x{k:02}", "n00")
    v = open_view(m.graph(spark), 150.0)
    got = tp.shortest_path(v, "n00", "n40").first()
    assert (got.distance, got.nodes, got.score) == (40, [f"n{k:02}" for k in range(41)], 50) and got.edges[3] == "n03-CONNECTS_TO-n04"
    staged = []
    keep = tp.stage
    try:
        tp.stage = lambda df, name: staged.append(keep(df, name)) or staged[-1]
        assert tp.all_paths(v, "n00", 5, "n04").count() == 16
    finally:
        tp.stage = keep
    assert sum(t.count() for t in staged) <= 2 * 16


def test_paths_from_few_nodes_do_not_copy_the_links(view, monkeypatch):
    want = sorted(tuple(r.edges) for r in tp.all_paths(view, "web", listed=1).collect())
    monkeypatch.setattr(tp, "make_links", lambda rows: pytest.fail("all links are staged"))
    assert sorted(tuple(r.edges) for r in tp.all_paths(view, "web").collect()) == want != []


def test_near_reads_are_pushed_down(spark, view):
    ball = tp._around(view, "svc", 1, None, 1000)
    plan = ball.last.of(tp._adjacent(view))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(node" in plan or "PushedFilters: [IsNotNull(node), EqualTo(node" in plan or "PushedFilters: [EqualTo(node" in plan or "Or(EqualTo(node" in plan, plan


def test_skewed_join_is_split(spark):
    """The membership test of edges against live nodes splits a hot endpoint at run time."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        edges = spark.range(0, 60000, 1, 16).select(F.when(F.col("id") % 3 > 0, F.lit("hub")).otherwise(F.concat(F.lit("n"), "id")).alias("src"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
        alive = spark.range(0, 60000, 1, 4).select(F.concat(F.lit("n"), "id").alias("src")).union(spark.createDataFrame([("hub",)], "src string"))
        joined = edges.join(alive, "src", "left_semi")
        assert joined.groupBy("src").count().count() == 20001
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


@pytest.mark.parametrize("weights, scale", [({1: 1.0, 2: 0.9, 3: 0.8}, 3.0), ({1: 0.3, 2: 0.3, 3: 0.1}, 2.0), ({1: 2.0, 2: 0.25, 3: 0.5}, 7.0)])
def test_impact_scores_with_other_weights(spark, monkeypatch, weights, scale):
    monkeypatch.setattr(tp, "IMPACT_WEIGHTS", weights)
    monkeypatch.setattr(tp, "IMPACT_SCALE", scale)
    v = open_view(random_graph(4).graph(spark), 150.0)
    want = {r.entity_id: r.impact_score for r in tp.impact_of(v).collect()}
    assert {r.entity_id: r.impact_score for r in tp.impact_scores(v).collect()} == want


def test_dependents_are_counted_once_for_impact_scores(spark):
    """The numbers of dependents are a staged table, not counted again in each step."""
    v = open_view(random_graph(4).graph(spark), 150.0)
    plan = tp.impact_scores(v)._jdf.queryExecution().optimizedPlan().toString()
    assert "impact_score" in plan and not re.search(r"Aggregate \[(node|provider)#", plan), plan


def test_evidence_is_ordered_in_generated_code(spark):
    """As ``array_sort`` orders it, nulls last, but without its comparator, which is interpreted for each row."""
    refs = [("a", "b"), ("b", "a"), ("a", "a"), (None, "a"), ("a", None), (None, None)]
    pairs = spark.createDataFrame([(k, *r) for k, r in enumerate(refs)], "k int, x string, y string")
    text, zero = F.col("k").cast("string"), F.lit(0.0)
    log = st._assert(pairs, text, "node", text, text, F.lit(3), F.lit(0.9), "scan", zero, st._refs(F.col("x"), F.col("y")))
    wanted = pairs.select(F.col("k").cast("string").alias("id"), F.array_sort(F.array("x", "y")).alias("e"))
    assert {r.id: r.evidence for r in log.collect()} == {r.id: r.e for r in wanted.collect()}
    assert [r.e for r in pairs.select(st._refs(F.col("x")).alias("e")).orderBy("k").collect()] == [[x] for x, _ in refs]
    assert "lambda" in wanted._jdf.queryExecution().toString() and "lambda" not in log._jdf.queryExecution().toString()


def test_impact_of_roots_with_common_links_takes_a_row_per_word(spark, monkeypatch):
    """Two hundred nodes that all link to each other and to chains of a node each; pairs, depths and counts as by hand."""
    from tidegraph.plans import words
    links = [(f"n{a:03d}", f"n{b:03d}") for a in range(200) for b in range(200) if a != b and (a + b) % 3]
    links += [(f"n{a:03d}", f"c{a:03d}") for a in range(200)] + [(f"c{a:03d}", f"d{a:03d}") for a in range(200)] + [("n000", "n000"), ("d199", "c199")]
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    want = {}
    for root in {a for a, _ in links}:
        level, seen = {root}, {root}
        for depth in (1, 2, 3):
            level = {n for k in level for n in after.get(k, ())} - seen
            seen |= level
            want |= {(root, n): depth for n in level}
    table = spark.createDataFrame(links, "node string, next string")
    found = words.word_levels(table.select("node"), table, 3)
    assert {(r.root, r.node): r.depth for r in found.pairs().collect()} == want
    sizes = {(r.node, r.depth): r.n for r in found.sizes().collect()}
    assert sizes == {(root, d): n for root in after for d in (1, 2, 3) if (n := sum(1 for (r, _), at in want.items() if r == root and at == d))}
    assert sum(t.count() for t in found.levels) * 4 < len(want)
