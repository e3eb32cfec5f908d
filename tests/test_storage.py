import datetime
import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.small import eight_nodes, rows
from tidegraph.model import ASSERTIONS, EVENTS, OBSERVATIONS
from tidegraph.operators import quality as qu
from tidegraph.operators import query as qy
from tidegraph.plans import build as bd
from tidegraph.plans import resolve as rs
from tidegraph.plans.view import Graph, open_view
from tidegraph.sources import event_log as el
from tidegraph.sources import graph_tables as gt
from tidegraph.sources import inventory as iv
from tidegraph.sources import star_tables as st
from tidegraph.session import stage
from tidegraph.sources.levels import Levels
from tidegraph.streaming import ingest as sg


def observation(kind, **values):
    base = dict(kind=kind, source="t", evidence=["e1"], observed_at=100.0)
    return tuple({**base, **values}.get(f.name) for f in OBSERVATIONS.fields)


FIVE = [
    observation("asset", mac="aa", hostname="web-01", zone="DMZ", attributes_json='{"os":"linux","exists":false}'),
    observation("service", host_hostname="other", port=443, product_signature="nginx", attributes_json='{"port":1,"tls":true}', metadata_json='{"name":"x"}'),
    observation("identity", principal="alice", identity_type="user", member_of=["admins"]),
    observation("datastore", cloud_id="arn:db", name="db", host_mac="aa", zone="DMZ"),
    observation("zone", name="DMZ"),
]


def observations(spark, data):
    return spark.createDataFrame(data, OBSERVATIONS)


def test_build(spark):
    b = bd.build_graph(observations(spark, FIVE))
    g = b.graph
    keys = {(r.type, r.key_json) for r in g.nodes.collect()}
    host = g.nodes.where("key_json = '{\"hostname\":\"other\"}'").collect()[0].id
    assert keys == {("ASSET", '{"mac":"aa"}'), ("ASSET", '{"hostname":"other"}'), ("SERVICE", f'{{"asset":"{host}","port":443}}'), ("IDENTITY", '{"principal":"alice"}'),
                    ("IDENTITY", '{"principal":"admins"}'), ("DATASTORE", '{"cloud_id":"arn:db"}'), ("ZONE", '{"name":"DMZ"}')}
    values = {r.type: r.value_json for r in g.assertions.join(g.nodes.withColumnRenamed("id", "target_id"), "target_id").collect()}
    assert values == {"ASSET": '{"exists":false,"os":"linux"}', "SERVICE": '{"exists":true,"port":443,"signature":"nginx","tls":true}', "IDENTITY": '{"exists":true,"identity_type":"user"}',
                      "DATASTORE": '{"exists":true,"name":"db"}', "ZONE": '{"exists":true,"name":"DMZ"}'}
    assert sorted(r.type for r in g.edges.collect()) == ["HOSTS", "HOSTS", "IN_ZONE", "IN_ZONE", "MEMBER_OF"]
    assert b.events.count() == 10
    # named but not observed: not live
    assert open_view(g, 150.0).nodes.count() == 5


def test_build_does_not_depend_on_order(spark):
    shuffled = random.Random(1).sample(FIVE * 3, 15)
    digest = lambda data: gt.content_digest(bd.build_graph(observations(spark, data)).graph).collect()[0].digest
    assert digest(FIVE) == digest(shuffled)


def test_metadata_can_be_folded_into_attributes(spark):
    data = [observation("service", host_ip="1", port=5432, metadata_json='{"public":true}')]
    plain, folded = (bd.build_graph(observations(spark, data), fold_metadata=f).graph.assertions.where("target_kind = 'node'").collect()[0].value_json for f in (False, True))
    assert plain == '{"exists":true,"port":5432}' and folded == '{"exists":true,"port":5432,"public":true}'


@pytest.mark.parametrize("bad, problem", [
    (observation("asset", hostname="h", confidence=1.5), "confidence outside 0..1"),
    (observation("asset", hostname="h", evidence=[]), "no evidence"),
    (observation("asset", hostname="h", valid_to=50.0), "valid_to before valid_from"),
    (observation("asset", hostname=""), "no asset identifier"),
    (observation("service", host_ip="1"), "service without port, signature or metadata"),
    (observation("identity"), "no identity identifier"),
    (observation("datastore"), "datastore without cloud id or name"),
    (observation("router", hostname="h"), "unknown kind"),
])
def test_rejected(spark, bad, problem):
    good, rejected = bd.split_valid(observations(spark, [bad]))
    assert good.count() == 0 and rejected.collect()[0].problems == [problem]


def test_unknown_provenance_needs_no_evidence(spark):
    good, _ = bd.split_valid(observations(spark, [observation("asset", hostname="h", evidence=[], provenance=0)]))
    assert good.count() == 1


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Hostname,IP ,zone,service,port,owner\nhost1,,zone1,http,80,alice\n,,z,,,\nhost2,10.0.0.2,,ssh,x22,\n")
    raw = iv.read_csv(spark, str(tmp_path / "a.csv"))
    got = iv.csv_observations(raw, 5.0)
    assert sorted((r.kind, r.evidence[0]) for r in got.collect()) == [
        ("asset", "csv:asset:host1"), ("asset", "csv:asset:host2"), ("service", "csv:service:host1:80"), ("zone", "csv:zone:zone1")]
    assert iv.csv_counts(raw).collect()[0].asDict() == {"parsed_rows": 2, "skipped_rows": 1, "skipped_services": 1}


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text("hostname,ip,zone,service,port,owner\nh1,10.0.0.1,dmz,web,80,bob\n")
    (folder / "b.csv").write_text("\ufeffOwner,port,service,extra,zone,IP,Hostname\n\"al, ice\",99999999999,db,x,,10.0.0.2,h2\nzoe,443,web\n")
    (folder / "c.csv").write_text("\n\nip\n10.0.0.3\nip\n")
    raw = iv.read_csv(spark, str(folder))
    assert sorted(map(tuple, raw.collect()), key=str) == sorted([
        ("h1", "10.0.0.1", "dmz", "web", "80", "bob"), ("h2", "10.0.0.2", None, "db", "99999999999", "al, ice"), (None, None, None, "web", "443", "zoe"),
        (None, "10.0.0.3", None, None, None, None)], key=str)
    assert [r.port for r in iv.csv_observations(raw, 1.0).where("kind = 'service'").collect()] == [80]
    assert iv.csv_counts(raw).collect()[0].asDict() == {"parsed_rows": 3, "skipped_rows": 1, "skipped_services": 1}


def events_of(spark, times, prefix="e"):
    return spark.createDataFrame([(f"{prefix}{t}", "ASSET_DISCOVERED", float(t), "s", 0.9, ["x"], ["web"], '{"k":1}') for t in times], EVENTS)


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert el.read_events(spark, path).count() == 0
    el.append_events(spark, path, events_of(spark, [300, 100, 400, 200]))
    el.append_events(spark, path, events_of(spark, [100, 200]))
    log = el.read_events(spark, path)
    assert [r.timestamp for r in el.replay(log).collect()] == [100.0, 200.0, 300.0, 400.0]
    assert el.count_events(log).collect()[0]["count"] == 4 and el.events_as_of(log, 200.0).count() == 2
    assert [r.id for r in el.list_events(log, limit=2, offset=1).collect()] == ["e200", "e300"]
    assert log.collect()[0].metadata_json == '{"k":1}'


def test_retention(spark, tmp_path):
    path = str(tmp_path / "log")
    el.append_events(spark, path, events_of(spark, [100, 9_000_000]))
    spark.createDataFrame([("broken {",)], "value string").write.mode("append").text(path)
    assert qu.apply_event_retention(spark, path, str(tmp_path / "old"), qu.FOREVER, 9e6).archived == 0
    kept = qu.apply_event_retention(spark, path, str(tmp_path / "old"), qu.DAYS_7, 9_000_000.0)
    assert (kept.archived, kept.remaining) == (1, 2)
    assert [r.id for r in el.read_events(spark, path).collect()] == ["e9000000"]
    assert [r.id for r in el.read_events(spark, kept.archive_path).collect()] == ["e100"]
    again = qu.apply_event_retention(spark, path, str(tmp_path / "old"), qu.DAYS_7, 9_000_000.0)
    assert (again.archived, again.remaining) == (0, 2)


def test_retention_loses_no_line(spark, tmp_path, monkeypatch):
    """A line appended between reading and swapping stays; an interrupted swap is completed by the next run."""
    path, old = str(tmp_path / "log"), str(tmp_path / "old")
    el.append_events(spark, path, events_of(spark, [100, 200, 9_000_000]))
    swap, calls = qu._swap, []

    def late(*args):
        calls.append(args)
        if len(calls) == 2:
            el.append_events(spark, path, events_of(spark, [300]))
            raise RuntimeError("driver lost")
        swap(*args)
    monkeypatch.setattr(qu, "_swap", late)
    with pytest.raises(RuntimeError):
        qu.apply_event_retention(spark, path, old, qu.DAYS_7, 9_000_000.0)
    monkeypatch.setattr(qu, "_swap", swap)
    kept = qu.apply_event_retention(spark, path, old, qu.DAYS_7, 9_000_000.0)
    assert (kept.archived, kept.remaining) == (1, 1)
    assert sorted(r.id for r in el.read_events(spark, path).collect()) == ["e9000000"]
    assert sorted(r.id for r in spark.read.schema(el.STORED).option("recursiveFileLookup", True).json(old).collect()) == ["e100", "e200", "e300"]


def test_event_issues(spark):
    lines = ['{"id":"a","event_type":"x","timestamp":1,"source":"s"}'] * 2 + ["{bad", '{"event_type":"x"}', '{"id":"b","timestamp":1}']
    got = qu.event_issues(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(got, "level", "problem", "lines") == [
        ("issue", "invalid JSON", 1), ("issue", "missing event id", 1), ("issue", "missing required field 'event_type'", 1), ("issue", "missing required field 'source'", 1), ("warning", "duplicate event id", 1)]


def test_snapshots_and_checkpoints(spark, tmp_path):
    root, g = str(tmp_path), eight_nodes().graph(spark)
    meta = gt.save_snapshot(g, root, "weekly", 7.0).collect()[0]
    assert (meta.node_count, meta.edge_count, meta.assertion_count) == (8, 8, 17)
    with pytest.raises(ValueError):
        gt.save_snapshot(g, root, "weekly")
    with pytest.raises(ValueError):
        gt.save_snapshot(g, root, "../x")
    assert qu.differences(g, gt.load_snapshot(spark, root, "weekly")).isEmpty()
    assert qu.validate_snapshot(spark, root, "weekly").collect()[0].valid
    (tmp_path / "snapshots" / "weekly" / "nodes" / "extra").mkdir()
    changed = Graph(g.nodes.limit(7), g.edges, g.assertions)
    gt.write_graph(changed, f"{root}/snapshots/weekly")
    assert qu.validate_snapshot(spark, root, "weekly").collect()[0].issues == ["content hash differs"]
    gt.save_snapshot(g, root, "daily", 9.0)
    assert [r.name for r in gt.list_snapshots(spark, root).collect()] == ["daily", "weekly"]
    assert gt.delete_snapshot(spark, root, "daily")
    gt.save_checkpoint(g, root, "c")
    assert gt.list_checkpoints(spark, root) == ["c"]
    assert qu.validate_checkpoint(spark, f"{root}/checkpoints/c").collect()[0].valid
    assert qu.validate_graph(g, f"{root}/check").collect()[0].valid
    assert gt.read_graph(spark, f"{root}/nowhere").nodes.count() == 0


def leaves(plan):
    """Scan nodes of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return leaves(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return leaves(plan.plan())
    below = [plan.children().apply(k) for k in range(plan.children().size())]
    return [x for c in below for x in leaves(c)] if below else [plan]


def rows_scanned(df):
    """Rows that the file scans of a collected query gave out: those of the row groups that were read."""
    assert df.collect() is not None
    return sum(x.metrics().apply("numOutputRows").value() for x in leaves(df._jdf.queryExecution().executedPlan()) if "Scan" in x.nodeName())


def many_targets(spark, n, first=0):
    g = eight_nodes().graph(spark)
    ids = spark.range(first, first + n)
    log = ids.select(F.format_string("l%07d", "id").alias("id"), F.lit("node").alias("target_kind"), F.format_string("t%07d", F.pmod(F.col("id") * 7919, F.lit(100_000))).alias("target_id"),
                     F.lit("{}").alias("value_json"), F.lit(3).alias("provenance"), F.lit(0.5).alias("confidence"), F.lit("s").alias("source"), F.lit("default").alias("context"),
                     F.col("id").cast("double").alias("valid_from"), F.lit(None).cast("double").alias("valid_to"), F.lit(1.0).alias("observed_at"),
                     F.array(F.lit("e")).alias("evidence"), F.lit(0).alias("inferred_depth"), F.lit(None).cast("double").alias("ttl"))
    nodes = ids.select(F.format_string("t%07d", "id").alias("id"), F.lit("ASSET").alias("type"), F.lit("{}").alias("key_json"))
    return Graph(nodes, g.edges.limit(0), log)


def test_point_reads_look_at_few_row_groups(spark, tmp_path):
    """One target of a hundred thousand, also after merges whose files cover all targets again."""
    path = str(tmp_path / "g")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    hadoop.set("parquet.block.size", str(1 << 16))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        gt.write_graph(many_targets(spark, 100_000), path)
        for k in range(1, 4):
            gt.merge_graph(spark, path, many_targets(spark, 30_000, k * 100_000)).collect()
        g = gt.read_graph(spark, path)
        total = g.assertions.count()
        assert total == 190_000 and g.by_target.count() == total
        identity, state, log = qy.node_detail(g, "t0007919", as_of=1e9)
        assert rows(log, "id") == [("l0000001",), ("l0100001",), ("l0200001",), ("l0300001",)]
        assert rows_scanned(log) < total / 8 and rows_scanned(state) < total / 8 and rows_scanned(identity) < 100_000 / 8
        assert rows(log, "id") == rows(rs.history(g.assertions, "t0007919"), "id")
        assert rows(identity, "id") == [("t0007919",)]
        assert rows_scanned(qy.node_detail(g, "nothing", as_of=1e9)[2]) < total / 8
        counts = g.changes("default", "node")
        assert rows(counts, "target_id", "changes") == rows(rs.change_counts(g.assertions, "default"), "target_id", "changes")
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_graph_can_be_stored_where_it_was_read(spark, tmp_path, monkeypatch):
    path, g = str(tmp_path / "g"), eight_nodes().graph(spark)
    digest = gt.write_graph(g, path)
    assert gt.write_graph(gt.read_graph(spark, path), path) == digest
    fewer = Graph(g.nodes.where("id <> 'late'"), g.edges, g.assertions)
    move, calls = gt.files.move, []

    def lost(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("driver lost")
        move(*args)
    monkeypatch.setattr(gt.files, "move", lost)
    with pytest.raises(RuntimeError):
        gt.write_graph(fewer, path)
    monkeypatch.setattr(gt.files, "move", move)
    assert qu.differences(gt.read_graph(spark, path), fewer).isEmpty()


def test_a_graph_stored_without_its_copy_by_target(spark, tmp_path):
    """Readers take states, histories and counts from the log, also after a merge and in the place of a graph that had the copy."""
    path, g = str(tmp_path / "g"), many_targets(spark, 200)
    gt.write_graph(many_targets(spark, 10), path)
    gt.store_graph(g, path, points=False)
    gt.merge_graph(spark, path, many_targets(spark, 50, 1000)).collect()
    stored = gt.read_graph(spark, path)
    assert stored.by_target is None and stored.counts is None and stored.assertions.count() == 250
    assert rows(qy.node_detail(stored, "t0007919", as_of=1e9)[2], "id") == rows(rs.history(stored.assertions, "t0007919"), "id") == [("l0000001",)]
    assert rows(stored.changes("default", "node"), "target_id", "changes") == rows(rs.change_counts(stored.assertions, "default"), "target_id", "changes")


def test_digest_sums_are_exact(spark):
    found = spark.range(1000).select(F.col("id").cast("string").alias("row")).agg(*gt.row_sums(F.col("row"))).first()
    digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(1000)]
    assert [int(found[f"s{q}"]) for q in range(4)] == [sum(int(d[16 * q:16 * q + 16], 16) for d in digests) for q in range(4)]


def test_shuffle_files_go_with_their_query(spark):
    """What a staged table was made of does not stay on the executors' disks."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(disk.getAllFiles().apply(k).getName().startswith("shuffle_") for k in range(disk.getAllFiles().size()))
    before = shuffled()
    assert stage(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "counts").count() == 5000
    for _ in range(100):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before


def test_a_large_sort_is_not_bound_to_few_partitions(spark):
    """The session has 2 shuffle partitions; a table of many MB is sorted in more, so that a task's share stays in memory."""
    wide = spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x")).repartitionByRange("x").sortWithinPartitions("x")
    assert wide.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_the_hash_tree_tells_which_rows_differ(spark):
    """Two rows that both come twice are seen, and only the leaves they lie in are compared."""
    g = many_targets(spark, 3000)
    twice = Graph(g.nodes.unionByName(g.nodes.where("id IN ('t0000005', 't0000017')")), g.edges, g.assertions)
    digest = lambda x: gt.content_digest(x).first()["digest"]
    assert digest(g) == digest(Graph(g.nodes.repartition(3), g.edges, g.assertions)) != digest(twice)
    found = qu.unequal_buckets(g, twice)
    assert 1 <= len(found) <= 2 and {t for t, _ in found} == {"nodes"}
    assert [(r.table, r.side, json.loads(r.row)["id"]) for r in qu.differences(g, twice).orderBy("row").collect()] == [("nodes", "right", "t0000005"), ("nodes", "right", "t0000017")]
    changed = Graph(g.nodes, g.edges, g.assertions.withColumn("confidence", F.when(F.col("id") == "l0000123", 0.75).otherwise(F.col("confidence"))))
    assert [(r.table, r.side) for r in qu.differences(g, changed).orderBy("side").collect()] == [("assertions", "left"), ("assertions", "right")]
    assert qu.differences(g, g).collect() == [] and len(qu.unequal_buckets(g, changed)) == 1
    empty = gt.empty_graph(spark)
    assert digest(empty) == digest(empty) and qu.differences(empty, empty).collect() == []


def test_graph_document(spark, tmp_path):
    doc = {"nodes": [{"id": "n", "type": "ASSET", "key": {"ip": "1"}}], "edges": [],
           "assertions": [{"id": "a", "target_kind": "node", "target_id": "n", "value": {"exists": True}, "provenance": "VERIFIED", "confidence": 0.5, "source": "s", "context": "default",
                           "valid_from": 1.0, "valid_to": None, "observed_at": 1.0, "evidence": ["e"], "inferred_depth": 0, "ttl": None}]}
    (tmp_path / "graph.json").write_text(json.dumps(doc))
    g = gt.read_graph_json(spark, str(tmp_path / "graph.json"))
    assert rows(open_view(g, 2.0).nodes, "id", "provenance", "key_json") == [("n", 2, '{"ip":"1"}')]


def test_consistency(spark):
    g = eight_nodes().graph(spark)
    assert qu.is_consistent(g, events_of(spark, [1]))
    assert rows(qu.unknown_entities(g, events_of(spark, [1]).withColumn("affected_entities", F.array(F.lit("web"), F.lit("gone")))), "id", "events") == [("gone", 1)]


def test_streamed_log_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [r.value for r in el.to_lines(events_of(spark, range(100, 130))).collect()]
    (source / "1.json").write_text("\n".join(lines[:20]))
    (source / "2.json").write_text("\n".join(lines[10:] + ["{broken"]))
    out = str(tmp_path / "a")
    for state in ("s", "s", "other"):
        sg.ingest_events(sg.event_stream(spark, str(source)), out, str(tmp_path / state)).awaitTermination()
        assert spark.read.parquet(out).count() == 30


def test_late_events_are_kept(spark, tmp_path):
    """Far older than all before, with late copies, over several runs of one query."""
    source = tmp_path / "in"
    source.mkdir()
    lines = [r.value for r in el.to_lines(events_of(spark, range(0, 60 * 86400, 86400))).collect()]
    for k, part in enumerate((lines[50:], lines[:2] + lines[55:], lines[1:51])):
        (source / f"{k}.json").write_text("\n".join(part))
        sg.ingest_events(sg.event_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "s")).awaitTermination()
    got = spark.read.schema(EVENTS).parquet(str(tmp_path / "out"))
    assert got.count() == 60 and got.select("id").distinct().count() == 60


def test_a_known_id_is_skipped_whatever_its_day(spark, tmp_path):
    """One batch or two, the earlier day first or last: an id is stored once."""
    source, event = tmp_path / "in", lambda t: events_of(spark, [t], prefix="").withColumn("id", F.lit("e1"))
    source.mkdir()
    for k, day in enumerate((5, 9, 2)):
        (source / f"{k}.json").write_text("\n".join(r.value for r in el.to_lines(event(day * 86400).unionByName(events_of(spark, [day]))).collect()))
        sg.ingest_events(sg.event_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "s")).awaitTermination()
    got = spark.read.schema(EVENTS).parquet(str(tmp_path / "out"))
    assert rows(got, "id", "timestamp") == [("e1", 5 * 86400.0), ("e2", 2.0), ("e5", 5.0), ("e9", 9.0)]
    log = str(tmp_path / "log")
    for day in (5, 9, 2):
        el.append_events(spark, log, event(day * 86400))
    assert rows(el.read_events(spark, log), "timestamp") == [(5 * 86400.0,)]


def test_the_index_follows_the_files(spark, tmp_path):
    """Lines that others append are known, and ids whose file is gone are not."""
    log = str(tmp_path / "log")
    el.append_events(spark, log, events_of(spark, [1, 2]))
    el.to_lines(events_of(spark, [3])).write.mode("append").text(log)
    el.append_events(spark, log, events_of(spark, [2, 3, 4]))
    assert rows(el.read_events(spark, log), "id") == [("e1",), ("e2",), ("e3",), ("e4",)]
    for name in gt.files.data_files(spark, log):
        if "e3" in (tmp_path / "log" / name).read_text():
            (tmp_path / "log" / name).unlink()
    el.append_events(spark, log, events_of(spark, [3, 4]))
    assert rows(el.read_events(spark, log), "id") == [("e1",), ("e2",), ("e3",), ("e4",)]


def keyed(spark, ids):
    return stage(spark.createDataFrame([(f"k{k}", k) for k in ids], "id string, n long"), "keyed")


def test_levels_open_few_files(spark, tmp_path):
    store = Levels(spark, str(tmp_path / "s"), ["id"], file_rows=50)
    for k in range(30):
        store.add(keyed(spark, range(40 * k, 40 * k + 40)), tag=str(k))
        assert len(store.parts()) <= 3 * 4
    assert store.read().count() == 1200 and sum(p.rows for p in store.parts()) == 1200
    folders = sum(p.slices for p in store.parts())
    assert folders >= 16
    for ids in ([7], [7, 1199], [600]):
        assert len(ids) <= len(store.candidates(keyed(spark, ids))) <= len(ids) + 2
        assert rows(store.holding(keyed(spark, ids)), "n") == [(k,) for k in sorted(ids)]
    assert len(store.candidates(keyed(spark, range(5000, 5010)))) <= 3
    assert store.holding(keyed(spark, [])) is None
    # files of the version before are still there, older ones are not
    names = {p.name for p in store.parts()}
    assert names <= set(gt.files.folders(spark, str(tmp_path / "s" / "parts"))) and len(gt.files.folders(spark, str(tmp_path / "s" / "parts"))) <= len(names) + 8


def test_many_batches_of_states(spark, tmp_path):
    """After thirty batches: few files, few of them opened by a batch, and the states of one resolution."""
    from tests.small import Maker
    rng, m, batches = random.Random(4), Maker(), []
    for k in range(30):
        before = len(m.log)
        for _ in range(6):
            m.claim("node", f"n{rng.randrange(60)}", {"v": rng.random()}, at=k, confidence=rng.random(), until=rng.choice([None, None, 20]))
        batches.append(m.log[before:])
    source, out = str(tmp_path / "in"), str(tmp_path)
    for part in batches:
        spark.createDataFrame(part, ASSERTIONS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ASSERTIONS).option("maxFilesPerTrigger", 1).parquet(source)
    sg.keep_states(stream, f"{out}/log", f"{out}/states", f"{out}/state", as_of=25.0, file_rows=40).awaitTermination()
    whole = spark.createDataFrame(m.log, ASSERTIONS)
    assert rows(sg.current_states(spark, f"{out}/states"), "target_id", "winner", "contributors") == rows(rs.resolve(whole, 25.0), "target_id", "winner", "contributors")
    log, states = Levels(spark, f"{out}/log", rs.TARGET), Levels(spark, f"{out}/states", rs.TARGET)
    assert len(log.parts()) <= 9 and len(states.parts()) <= 9
    assert sum(p.rows for p in log.parts()) == len(m.log) and sum(p.rows for p in states.parts()) <= 60 * 4
    one = stage(whole.where("target_id = 'n7'"), "one")
    assert len(log.candidates(one)) <= len(log.parts()) + 2


def test_merges_read_few_ids_and_keep_the_layout(spark, tmp_path):
    path = str(tmp_path / "g")
    gt.write_graph(many_targets(spark, 5000), path)
    for k in (1, 2):
        added = {r.table: r.added for r in gt.merge_graph(spark, path, many_targets(spark, 200, k * 4900)).collect()}
        assert added == {"nodes": 100 if k == 1 else 200, "edges": 0, "assertions": 100 if k == 1 else 200}
    g = gt.read_graph(spark, path)
    assert g.assertions.count() == g.by_target.count() == 5300 and g.nodes.select("id").distinct().count() == g.nodes.count() == 5300
    # each file of the log lies in the order of its time
    for f in (tmp_path / "g" / "assertions").rglob("part-*.parquet"):
        times = [r.valid_from for r in spark.read.parquet(str(f)).collect()]
        assert times == sorted(times)


def test_staged_tables_do_not_pile_up(spark, tmp_path):
    from tidegraph.session import staging_root
    from tidegraph.sources import files
    source = tmp_path / "in"
    source.mkdir()
    lines = [r.value for r in el.to_lines(events_of(spark, range(100, 130))).collect()]
    for k, line in enumerate(lines):
        (source / f"{k}.json").write_text(line)
    stream = spark.readStream.schema(el.STORED).option("maxFilesPerTrigger", 1).json(str(source)).withColumnRenamed("metadata", "metadata_json")
    before = len(files.folders(spark, staging_root(spark)))
    sg.ingest_events(stream, str(tmp_path / "out"), str(tmp_path / "s")).awaitTermination()
    assert len(files.folders(spark, staging_root(spark))) == before and spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_streamed_growth_equals_one_build(spark, tmp_path):
    source = str(tmp_path / "obs")
    for row in FIVE + [observation("asset", hostname="")]:
        observations(spark, [row]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", 2).parquet(source)
    seen = []
    sg.grow_graph(stream, str(tmp_path / "g"), str(tmp_path / "state"), rejected=str(tmp_path / "bad"), on_events=lambda e: seen.append(e.count())).awaitTermination()
    assert qu.differences(bd.build_graph(observations(spark, FIVE)).graph, gt.read_graph(spark, str(tmp_path / "g"))).isEmpty()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1 and sum(seen) == 10


def test_expired_winner_gives_way(spark, tmp_path):
    """The runner-up of a winner with a finite end takes over once the time has passed."""
    from tests.small import Maker
    m = Maker()
    m.claim("node", "a", {"v": "short"}, at=1, until=10, confidence=0.9)
    m.claim("node", "a", {"v": "long"}, at=1, confidence=0.5)
    m.node("a", "ASSET")
    log = m.graph(spark).assertions
    source = str(tmp_path / "log")
    log.write.parquet(source)
    for t, winner in ((5.0, "a0000"), (15.0, "a0001")):
        base = str(tmp_path / str(t))
        stream = spark.readStream.schema(log.schema).parquet(source)
        sg.keep_states(stream, f"{base}/log", f"{base}/states", f"{base}/state", as_of=t).awaitTermination()
        assert rows(sg.current_states(spark, f"{base}/states"), "winner") == [(winner,)]


def test_a_graph_stored_in_bulk_is_not_shuffled(spark, tmp_path, monkeypatch):
    """Rows stay in their tasks; a read as of a time skips row groups all the same."""
    path, g = str(tmp_path / "g"), many_targets(spark, 60_000)
    spread = g.assertions.repartition(3)
    monkeypatch.setattr(gt, "GROUP", 1 << 16)
    gt.store_graph(Graph(g.nodes, g.edges, stage(spread, "spread")), path, points=False)
    files = list((tmp_path / "g" / "assertions").rglob("part-*.parquet"))
    assert len(files) == 3
    for f in files:
        times = [r.valid_from for r in spark.read.parquet(str(f)).collect()]
        assert times == sorted(times) and times[0] < 1000 and times[-1] > 59_000
    log = gt.read_graph(spark, path).assertions
    assert log.count() == 60_000 and rows_scanned(log.where("valid_from <= 100.0").select("id", "valid_from")) < 30_000


def test_a_checkpoint_has_no_copy_by_target(spark, tmp_path):
    root, g = str(tmp_path), many_targets(spark, 200)
    digest = gt.save_checkpoint(g, root, "c")
    kept = gt.restore_checkpoint(spark, root, "c")
    assert kept.by_target is None and gt.save_checkpoint(kept, root, "c") == digest == gt.content_digest(g).first()["digest"]
    assert qu.differences(gt.restore_checkpoint(spark, root, "c"), g).isEmpty()


def test_a_digest_reads_each_quarter_of_a_hash_once(spark):
    parts = {p for c in gt.row_sums(F.col("row")) for p in re.findall(r"conv\(substring\(.*?, (\d+, \d+)\), 16, -?10\)", str(c))}
    assert parts == {"1, 16", "17, 16", "33, 16", "49, 16"}


def test_staged_tables_are_compressed_well(spark):
    assert all(f.split("/")[-1].endswith(".zstd.parquet") for f in stage(spark.range(10), "ten").inputFiles())


def test_lines_are_dealt_by_order_once(spark, tmp_path):
    """For the assertions of dependencies the lines are shuffled by order only, and so are they for the edges."""
    day, later = datetime.datetime(1995, 1, 1), datetime.datetime(1995, 2, 1)
    lines = [(o, p, s, n, 0.05, later) for o in (1, 2, None) for n, (p, s) in enumerate([(1, 1), (1, 2), (2, 1), (1, 1)])]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, day), (2, 8, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 0), (2, 0)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    edges = st.graph_edges(spark, str(tmp_path))
    log = st.edge_assertions(spark, str(tmp_path), edges)
    assert rows(edges.where("type = 'DEPENDS_ON'"), "id") == [("dp_1_1",), ("dp_1_2",), ("dp_2_1",), ("dp_2_2",)]
    assert rows(log.where("source = 'flow'"), "id", "target_id") == [(f"a_dp_{o}_{p}_{s}", f"dp_{o}_{p}") for o in (1, 2) for p, s in ((1, 1), (1, 2), (2, 1))]
    for df, kind in ((edges.where("type = 'DEPENDS_ON'"), "l_partkey"), (log.where("source = 'flow'"), "l_suppkey")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(rf"hashpartitioning\(l_orderkey[^)]*{kind}", plan), plan


def test_links_and_parts_of_orders_share_a_shuffle(spark, tmp_path):
    """The lines are dealt by order once for the edges; lines without an order follow each other, but are of no order's parts."""
    day = datetime.datetime(1995, 1, 1)
    lines = [(1, 2, 3, 1), (1, 1, 2, 2), (1, 1, 2, 2), (1, None, 4, 3), (2, 1, None, 1), (2, 5, 9, 1), (None, 1, 7, 1), (None, 1, 8, 2), (3, 1, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7, day), (2, 8, day), (2, 8, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 0)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey long, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    edges = st.graph_edges(spark, str(tmp_path))
    found = sorted((r.type, r.id, r.src or "", r.dst or "") for r in edges.collect() if r.type in ("CONNECTS_TO", "DEPENDS_ON") or (r.id or "").startswith("ho_"))
    assert found == [
        ("CONNECTS_TO", "ct_2_4", "s_2", "s_4"), ("CONNECTS_TO", "ct_3_2", "s_3", "s_2"), ("CONNECTS_TO", "ct_7_8", "s_7", "s_8"),
        ("DEPENDS_ON", "dp_1", "o_1", ""), ("DEPENDS_ON", "dp_1_1", "o_1", "p_1"), ("DEPENDS_ON", "dp_1_2", "o_1", "p_2"),
        *[("DEPENDS_ON", f"dp_2_{p}", "o_2", f"p_{p}") for p in (1, 1, 5, 5)],
        ("HOSTS", "ho_1", "s_2", "o_1"), ("HOSTS", "ho_2", "s_9", "o_2"), ("HOSTS", "ho_2", "s_9", "o_2"),
    ]
    plan = edges._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning\(l_orderkey", x) and "ReusedExchange" not in x]
    assert len(dealt) <= 2, plan  # lines of known orders, and those without one


def test_edges_that_a_log_is_made_from_are_written_once(spark, tmp_path):
    """Their further columns stay in the files; readers see the graph's own."""
    path, g, seen = str(tmp_path / "g"), eight_nodes().graph(spark), []

    def log(edges):
        seen.extend(edges.inputFiles())
        assert edges.columns == [*g.edges.columns, "since"]
        return g.assertions.join(edges.where("since = 5").select(F.col("id").alias("target_id")), "target_id", "left_semi")

    for _ in range(2):  # also in the place of an earlier graph
        gt.store_graph(g, path)
        gt.store_grown(g.nodes, g.edges.withColumn("since", F.lit(5)), log, path)
    assert seen and all("/g/_next/edges/" in f for f in seen)
    kept = gt.read_graph(spark, path)
    wanted = Graph(g.nodes, g.edges, g.assertions.where("target_kind = 'edge'"))
    assert kept.by_target is None and kept.edges.columns == g.edges.columns and qu.differences(kept, wanted).isEmpty()
    assert rows(gt.merge_graph(spark, path, g), "table", "added") == [("assertions", g.assertions.where("target_kind = 'node'").count()), ("edges", 0), ("nodes", 0)]
    assert qu.differences(gt.read_graph(spark, path), g).isEmpty()


def test_a_graph_document_is_stored_compressed(spark, tmp_path):
    graph = eight_nodes().graph(spark)
    gt.write_graph_json(graph, str(tmp_path / "document"))
    assert {f.name.rsplit(".", 1)[1] for f in (tmp_path / "document").glob("part-*")} == {"gz"}
    back = gt.read_graph_json(spark, str(tmp_path / "document"))
    assert rows(back.assertions, "id", "target_id", "provenance") == rows(graph.assertions, "id", "target_id", "provenance")
    assert rows(back.edges, "id", "src", "dst") == rows(graph.edges, "id", "src", "dst")
