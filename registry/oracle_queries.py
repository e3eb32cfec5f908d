"""The checking SQL per query name."""

from __future__ import annotations

from registry.oracle import EARLIER, MID, NOW, YEAR, sql

QUERIES: dict[str, str] = {}


def _q(name: str, text: str, t: float = NOW, times: dict[str, float] | None = None) -> None:
    QUERIES[name] = sql(text, t, times)


PROV = "CASE prov WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'INFERRED' WHEN 2 THEN 'VERIFIED' ELSE 'OBSERVED' END"
NODE = "'node_' || substr(sha256({}), 1, 32)"

# --- A ---------------------------------------------------------------------------
_CSV = """
SELECT CASE WHEN c_acctbal >= 0 THEN c_name END AS hostname, CASE WHEN c_acctbal < 5000 THEN '10.0.' || c_nationkey || '.' || c_custkey END AS ip, CASE WHEN c_acctbal < 9000 THEN lower(c_mktsegment) END AS zone,
  CASE WHEN c_acctbal > 2000 THEN 'http' END AS service, CASE WHEN c_nationkey < 20 THEN ('80' || c_nationkey)::INTEGER END AS port, CASE WHEN c_nationkey >= 5 THEN c_mktsegment END AS owner FROM customer"""
_q("a01_csv_inventory", f"""
WITH rows_ AS (SELECT * FROM ({_CSV}) WHERE hostname IS NOT NULL OR ip IS NOT NULL), obs AS (
SELECT 'zone' AS kind, NULL AS hostname, NULL AS ip, NULL AS host_hostname, NULL AS host_ip, zone AS name, NULL::INTEGER AS port, 'csv:zone:' || zone AS evidence, '' AS attributes, '' AS metadata FROM rows_ WHERE zone IS NOT NULL
UNION ALL SELECT 'asset', hostname, ip, NULL, NULL, NULL, NULL, 'csv:asset:' || coalesce(hostname, ip), CASE WHEN owner IS NULL THEN '{{}}' ELSE '{{"owner":"' || owner || '"}}' END, '' FROM rows_
UNION ALL SELECT 'service', NULL, NULL, hostname, ip, NULL, port, 'csv:service:' || coalesce(hostname, ip) || ':' || port, '', '{{"name":"' || service || '"}}' FROM rows_ WHERE service IS NOT NULL AND port IS NOT NULL)
SELECT kind, 'csv' AS source, hostname, ip, host_hostname, host_ip, name, port, evidence, attributes, metadata, {NOW}::DOUBLE AS observed_at, 'default' AS context FROM obs""")
_q("a01_csv_row_counts", f"SELECT count(*) FILTER (hostname IS NOT NULL OR ip IS NOT NULL) AS parsed_rows, count(*) FILTER (hostname IS NULL AND ip IS NULL) AS skipped_rows, count(*) FILTER ((hostname IS NOT NULL OR ip IS NOT NULL) AND service IS NOT NULL AND port IS NULL) AS skipped_services FROM ({_CSV})")


def _export(*selects: str) -> str:
    """Union of (kind, source, cloud_id, host_cloud_id, iam_id, port, product_signature, evidence, attributes, metadata)."""
    names = "kind, source, cloud_id, host_cloud_id, iam_id, port, product_signature, evidence, attributes, metadata"
    texts = ", ".join(f"{n}::VARCHAR AS {n}" for n in ("cloud_id", "host_cloud_id", "iam_id", "product_signature"))
    return f"SELECT * REPLACE ({texts}) FROM ({' UNION ALL '.join(selects)}) t({names})"


_q("a02_aws_export", _export(
    """SELECT 'asset', 'aws', 'vpc-' || n_nationkey, NULL, NULL, NULL::INTEGER, NULL, 'aws:ec2:describe-vpcs',
       '{"cloud_provider":"aws","region":"us-east-1","vpc_id":"vpc-' || n_nationkey || '","is_default":' || CASE WHEN n_regionkey = 2 THEN 'true' ELSE 'false' END || '}', '' FROM nation""",
    """SELECT 'asset', 'aws', 'i-' || s_suppkey, NULL, NULL, NULL, NULL, 'aws:ec2:describe-instances',
       '{"cloud_provider":"aws","instance_type":"m5","vpc_id":"' || CASE WHEN s_acctbal > 0 THEN 'vpc-' || s_nationkey ELSE 'unknown' END || '","state":"' || CASE WHEN s_acctbal > 5000 THEN 'running' ELSE 'stopped' END || '"}', '' FROM supplier""",
    """SELECT 'service', 'aws', NULL, 'db-' || p_partkey, NULL, CASE WHEN p_size > 20 THEN p_size + 3300 ELSE 5432 END, CASE WHEN p_size > 5 THEN lower(p_type) ELSE 'unknown' END, 'aws:rds:describe-db-instances', '',
       '{"cloud_provider":"aws","status":"available","public":' || CASE WHEN p_size > 40 THEN 'true' ELSE 'false' END || '}' FROM part""",
    """SELECT 'identity', 'aws', NULL, NULL, 'arn:' || c_custkey, NULL, NULL, 'aws:iam:list-roles', '{"cloud_provider":"aws","name":"' || c_name || '"}', '' FROM customer"""))
_q("a03_azure_export", _export(
    """SELECT 'asset', 'azure', 'vnet-' || n_nationkey, NULL, NULL, NULL::INTEGER, NULL, 'azure:network:vnet', '{"cloud_provider":"azure","location":"r' || n_regionkey || '","name":"' || n_name || '"}', '' FROM nation""",
    """SELECT 'asset', 'azure', 'vm-' || s_suppkey, NULL, NULL, NULL, NULL, 'azure:compute:vm',
       '{"cloud_provider":"azure","location":"n' || s_nationkey || '","name":"' || s_name || '","vm_size":"' || CASE WHEN s_acctbal > 0 THEN 'D2' ELSE 'unknown' END || '"}', '' FROM supplier"""))
_q("a04_gcp_export", _export(
    """SELECT 'asset', 'gcp', s_suppkey::VARCHAR, NULL, NULL, NULL::INTEGER, NULL, 'gcp:compute:instance',
       '{"cloud_provider":"gcp","zone":"z' || s_nationkey || '","name":"' || s_name || '","machine_type":"' || CASE WHEN s_acctbal > 1000 THEN 'n1' ELSE 'unknown' END || '","status":"RUNNING"}', '' FROM supplier"""))
_q("a05_kubernetes_export", _export(
    """SELECT 'asset', 'kubernetes', 'n' || n_nationkey, NULL, NULL, NULL::INTEGER, NULL, 'k8s:node:list', '{"cloud_provider":"kubernetes","cluster_name":"east","name":"' || n_name || '","os_image":"linux"}', '' FROM nation""",
    """SELECT 'asset', 'kubernetes', 'p' || s_suppkey, NULL, NULL, NULL, NULL, 'k8s:pod:list',
       '{"cloud_provider":"kubernetes","namespace":"ns","name":"' || s_name || '","status":"Running","node_name":"n' || s_nationkey || '"}', '' FROM supplier""",
    """SELECT 'service', 'kubernetes', NULL, 's' || p_partkey, NULL, CASE WHEN p_size > 10 THEN p_size + 8000 ELSE 80 END, 'k8s-service', 'k8s:service:list', '',
       '{"cloud_provider":"kubernetes","name":"' || p_name || '","namespace":"' || p_brand || '","type":"ClusterIP"}' FROM part"""))
_q("a06_scan_results", """
SELECT 'asset' AS kind, 'host' || l_suppkey AS hostname, '10.1.0.' || l_suppkey AS ip, NULL AS host_hostname, NULL::INTEGER AS port, 'socket:gethostbyname' AS evidence, 1::BIGINT AS n, min(epoch(l_shipdate)) AS first_seen FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 'service', NULL, NULL, 'host' || l_suppkey, l_linenumber * 100, 'socket:connect:' || (l_linenumber * 100), count(*), min(epoch(l_shipdate)) FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey, l_linenumber""")
_q("a07_graph_read", """
SELECT id, kind AS target_kind, target AS target_id, prov AS provenance, conf AS confidence, src AS source, 'default' AS context, vf AS valid_from, vt AS valid_to, obs AS observed_at, array_to_string(list_sort(ev), ',') AS evidence, ttl FROM asr""")
_CONTENTS = """SELECT 'nodes' AS "table", id, type AS kind, key_json AS a, '' AS b FROM regd UNION ALL SELECT 'edges', id, type, src, dst FROM edges
UNION ALL SELECT 'assertions', id, kind, target, src || '/' || prov FROM asr"""
_q("a07_graph_contents", _CONTENTS)
_q("a07_graph_document", _CONTENTS)
_COUNTS = "SELECT 'nodes' AS \"table\", count(*) AS rows FROM regd UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'assertions', count(*) FROM asr"
_q("a08_graph_digest", f"{_COUNTS} UNION ALL SELECT 'equal digests', 1")
_LOG = "(SELECT * FROM disc UNION ALL SELECT * FROM disc WHERE source = 'signup')"
_q("a09_event_log_read", f"SELECT id, event_type, timestamp, source, confidence, evidence, a1 || ',' || a2 AS affected, json_extract_string(props, '$.k') AS k FROM {_LOG}")
_q("a10_idempotent_append", "SELECT event_type, source, count(*) AS n, count(DISTINCT id) AS ids FROM disc GROUP BY 1, 2")
_q("a11_events_as_of", f"SELECT id, event_type, timestamp FROM disc WHERE timestamp <= {MID}")
_q("a11_event_count", f"SELECT count(*) AS count FROM {_LOG}")
_q("a11_event_page", "SELECT id, event_type, timestamp FROM disc ORDER BY timestamp, id LIMIT 500 OFFSET 400")
_q("a11_deep_event_page", "SELECT id, timestamp FROM disc ORDER BY timestamp, id OFFSET 100")
_q("a12_merge_graph", """
SELECT 'nodes' AS "table", count(*) FILTER (type <> 'SERVICE') AS added, 0 AS step FROM regd UNION ALL SELECT 'nodes', count(*) FILTER (type = 'SERVICE'), 1 FROM regd UNION ALL SELECT 'nodes', 0, 2
UNION ALL SELECT 'edges', count(*) FILTER (type <> 'HOSTS'), 0 FROM edges UNION ALL SELECT 'edges', count(*) FILTER (type = 'HOSTS'), 1 FROM edges UNION ALL SELECT 'edges', 0, 2
UNION ALL SELECT 'assertions', count(*) FILTER (src <> 'flow'), 0 FROM asr UNION ALL SELECT 'assertions', count(*) FILTER (src = 'flow'), 1 FROM asr UNION ALL SELECT 'assertions', 0, 2""")
_SIZES = "(SELECT count(*) FROM regd) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM asr) AS assertion_count"
_q("a13_snapshot", f"SELECT 'weekly' AS name, {NOW}::DOUBLE AS created_at, {_SIZES}, 1 AS schema_version")
_q("a14_snapshot_list", f"""SELECT 'full' AS name, {NOW}::DOUBLE AS created_at, {_SIZES}, NULL::BIGINT AS loaded_rows
UNION ALL SELECT 'again', {EARLIER}::DOUBLE, {_SIZES}, (SELECT count(*) FROM regd) + (SELECT count(*) FROM edges) + (SELECT count(*) FROM asr)""")
_q("a15_checkpoint", _CONTENTS)
_q("a16_report_csv", "SELECT id, level AS criticality, score FROM asm@ WHERE level IN ('High', 'Critical')")
_q("a16_report_json", "SELECT id, severity, title, target_name AS target, action, category FROM gov@")

# --- B ---------------------------------------------------------------------------
_AKEY = """CASE WHEN s_acctbal >= 8000 THEN '{"mac":"02:' || s_suppkey || '"}' WHEN s_acctbal < 1000 THEN '{"cloud_id":"i-' || s_suppkey || '"}' ELSE '{"hostname":"' || s_name || '"}' END"""


def _id(kind: str, key: str) -> str:
    return NODE.format("'{\"key\":' || (" + key + f") || ',\"type\":\"{kind}\"}}'")


def _edge(kind: str, src: str, dst: str) -> str:
    return f"""'edge_' || substr(sha256('{{"context":"default","dst":"' || {dst} || '","src":"' || {src} || '","type":"{kind}"}}'), 1, 32)"""


_CKEY = """CASE WHEN c_acctbal >= 0 THEN '{"principal":"' || c_name || '"}' ELSE '{"email":"c' || c_custkey || '@example.com"}' END"""
_BASE = f"""
a AS MATERIALIZED (SELECT s_suppkey, s_name, s_nationkey, r_name, {_AKEY} AS akey, {_id('ASSET', _AKEY)} AS aid FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
z AS MATERIALIZED (SELECT r_regionkey, r_name, '{{"name":"' || r_name || '"}}' AS zkey, {_id('ZONE', "'{\"name\":\"' || r_name || '\"}'")} AS zid FROM region),
s AS MATERIALIZED (SELECT *, {_id('SERVICE', 'skey')} AS sid FROM (
  SELECT o.*, aid, akey, CASE o_orderpriority WHEN '1-URGENT' THEN '{{"asset":"' || aid || '","port":' || o_orderkey || '}}' WHEN '2-HIGH' THEN '{{"asset":"' || aid || '","port":0}}'
    WHEN '3-MEDIUM' THEN '{{"asset":"' || aid || '","signature":"app-' || o_orderkey || '"}}' WHEN '5-LOW' THEN '{{"asset":"' || aid || '","metadata":{{"order":' || o_orderkey || '}}}}' END AS skey
  FROM orders o JOIN (SELECT l_orderkey, min(l_suppkey) AS host FROM lineitem GROUP BY 1) h ON h.l_orderkey = o_orderkey JOIN a ON a.s_suppkey = h.host) WHERE o_totalprice >= 2000 AND skey IS NOT NULL),
c AS MATERIALIZED (SELECT customer.*, {_CKEY} AS ckey, {_id('IDENTITY', _CKEY)} AS cid FROM customer),
g AS MATERIALIZED (SELECT cid, c_custkey, principal, '{{"principal":"' || principal || '"}}' AS gkey, {_id('IDENTITY', "'{\"principal\":\"' || principal || '\"}'")} AS gid, c_mktsegment
  FROM (SELECT cid, c_custkey, c_mktsegment, unnest([lower(c_mktsegment), 'nation-' || c_nationkey]) AS principal FROM c)),
d AS MATERIALIZED (SELECT *, {_id('DATASTORE', 'dkey')} AS did FROM (
  SELECT p.*, aid, akey, CASE WHEN p_size >= 25 THEN '{{"cloud_id":"vol-' || p_partkey || '"}}' WHEN aid IS NOT NULL THEN '{{"asset":"' || aid || '","name":"' || p_name || '-' || p_partkey || '"}}' ELSE '{{"name":"' || p_name || '-' || p_partkey || '"}}' END AS dkey
  FROM part p LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS host FROM lineitem GROUP BY 1) h ON h.l_partkey = p_partkey LEFT JOIN a ON a.s_suppkey = h.host) WHERE p_size < 49),
n AS MATERIALIZED (SELECT aid AS id, 'ASSET' AS type, akey AS key_json, true AS own FROM a UNION ALL SELECT zid, 'ZONE', zkey, r_name <> 'AFRICA' FROM z WHERE r_name <> 'AFRICA' OR r_name IN (SELECT r_name FROM a)
  UNION ALL SELECT sid, 'SERVICE', skey, true FROM s UNION ALL SELECT cid, 'IDENTITY', ckey, true FROM c UNION ALL SELECT gid, 'IDENTITY', gkey, false FROM g UNION ALL SELECT did, 'DATASTORE', dkey, true FROM d),
e AS MATERIALIZED (SELECT DISTINCT {_edge('IN_ZONE', 'aid', 'zid')} AS id, 'IN_ZONE' AS type, aid AS src, zid AS dst FROM a JOIN z USING (r_name)
  UNION SELECT {_edge('HOSTS', 'aid', 'sid')}, 'HOSTS', aid, sid FROM s UNION SELECT {_edge('HOSTS', 'aid', 'did')}, 'HOSTS', aid, did FROM d WHERE aid IS NOT NULL
  UNION SELECT {_edge('MEMBER_OF', 'cid', 'gid')}, 'MEMBER_OF', cid, gid FROM g)"""
QUERIES["b01_natural_keys"] = f"WITH {_BASE} SELECT DISTINCT id, type, key_json FROM n"
QUERIES["b11_edges"] = f"WITH {_BASE} SELECT id, type, src, dst, 'default' AS context FROM e"
QUERIES["b12_unasserted_nodes"] = f"WITH {_BASE} SELECT type, key_json FROM n GROUP BY 1, 2, id HAVING NOT bool_or(own)"
QUERIES["b10_node_assertions"] = f"""WITH {_BASE}
SELECT DISTINCT target_id, value_json, provenance, confidence, source, 'default' AS context, valid_from, NULL::DOUBLE AS valid_to, evidence FROM (
SELECT aid AS target_id, '{{"exists":true,"name":"' || s_name || '","nation":' || s_nationkey || '}}' AS value_json, 3 AS provenance, 0.9::DOUBLE AS confidence, 'scan' AS source, {EARLIER}::DOUBLE AS valid_from, 'scan:' || s_suppkey || ',scan:all' AS evidence FROM a
UNION ALL SELECT zid, '{{"exists":true,"name":"' || r_name || '"}}', 3, 0.9, 'atlas', {EARLIER}, 'atlas:' || r_regionkey FROM z WHERE r_name <> 'AFRICA'
UNION ALL SELECT sid, '{{"exists":true,' || CASE o_orderpriority WHEN '1-URGENT' THEN '"port":' || o_orderkey || ',' WHEN '2-HIGH' THEN '"port":0,' WHEN '3-MEDIUM' THEN '"signature":"app-' || o_orderkey || '",' ELSE '' END || '"status":"' || o_orderstatus || '"}}',
  3, 0.9, 'probe', epoch(o_orderdate), 'probe:' || o_orderkey FROM s
UNION ALL SELECT cid, '{{"exists":true,"identity_type":"user"}}', CASE WHEN c_acctbal < 0 THEN 0 ELSE 3 END, 0.9, 'directory', {EARLIER}, 'segment:' || c_mktsegment FROM c
UNION ALL SELECT did, '{{"exists":true,"kind":"' || p_type || '","name":"' || p_name || '-' || p_partkey || '"}}', 3, CASE WHEN p_size < 10 THEN 0.7 ELSE 0.9 END, 'catalog', {EARLIER}, 'brand:' || p_brand FROM d)"""
QUERIES["b13_discovery_events"] = f"""WITH {_BASE}, ev AS (
SELECT DISTINCT 'ASSET_DISCOVERED' AS event_type, 'scan' AS source, NULL AS edge_type, 1 AS entities, {EARLIER}::DOUBLE AS ts, aid AS x, s_suppkey::VARCHAR AS y FROM a
UNION SELECT 'ZONE_DISCOVERED', 'atlas', NULL, 1, {EARLIER}, zid, '' FROM z WHERE r_name <> 'AFRICA'
UNION SELECT 'SERVICE_DETECTED', 'probe', NULL, 1, epoch(o_orderdate), sid, o_orderkey::VARCHAR FROM s
UNION SELECT 'IDENTITY_FOUND', 'directory', NULL, 1, {EARLIER}, cid, c_mktsegment FROM c
UNION SELECT 'DATASTORE_IDENTIFIED', 'catalog', NULL, 1, {EARLIER}, did, p_brand FROM d
UNION SELECT 'RELATIONSHIP_OBSERVED', 'scan', 'IN_ZONE', 3, {EARLIER}, aid, s_suppkey::VARCHAR FROM a
UNION SELECT 'RELATIONSHIP_OBSERVED', 'probe', 'HOSTS', 3, epoch(o_orderdate), sid, o_orderkey::VARCHAR FROM s
UNION SELECT 'RELATIONSHIP_OBSERVED', 'catalog', 'HOSTS', 3, {EARLIER}, did, p_brand FROM d WHERE aid IS NOT NULL
UNION SELECT 'RELATIONSHIP_OBSERVED', 'directory', 'MEMBER_OF', 3, {EARLIER}, cid || gid, c_mktsegment FROM g)
SELECT event_type, source, edge_type, entities, count(*) AS n, min(ts) AS first, max(ts) AS last FROM ev GROUP BY 1, 2, 3, 4"""
QUERIES["b16_custom_keys"] = f"""SELECT DISTINCT {_id('IDENTITY', 'k')} AS id, k AS key_json FROM (
SELECT '{{"principal":"id-' || lower(CASE WHEN c_acctbal >= 0 THEN c_name ELSE 'c' || c_custkey || '@example.com' END) || '"}}' AS k FROM customer
UNION SELECT '{{"principal":"' || unnest([lower(c_mktsegment), 'nation-' || c_nationkey]) || '"}}' FROM customer)"""
_q("b07_contexts", "SELECT event_id, '{\"app\":\"' || user_id || '\",\"type\":\"' || event_type || '\"}' AS mapping, CASE WHEN event_type = 'view' THEN 'default' ELSE event_type END AS label FROM events")
_q("b08_rejected_rows", """
SELECT 'service' AS kind, CASE WHEN o_totalprice >= 2000 THEN 'probe:' || o_orderkey ELSE '' END AS what,
  concat_ws(';', CASE WHEN o_totalprice < 2000 THEN 'no evidence' END, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'service without port, signature or metadata' END) AS problems, count(*) AS n
FROM orders WHERE (o_totalprice < 2000 OR o_orderpriority = '4-NOT SPECIFIED') AND o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1, 2, 3
UNION ALL SELECT 'datastore', p_name || '-' || p_partkey, CASE WHEN p_size = 50 THEN 'confidence outside 0..1' ELSE 'valid_to before valid_from' END, count(*) FROM part WHERE p_size IN (49, 50) GROUP BY 1, 2, 3""")
_q("b14_order_and_repetition", "SELECT 1::BIGINT AS equal")
_q("b15_assert_edges", "SELECT target AS target_id, prov AS provenance, conf AS confidence, src AS source, 'default' AS context, vf AS valid_from, obs AS observed_at, array_to_string(list_sort(ev), ',') AS evidence FROM asr WHERE kind = 'edge'")

# --- C ---------------------------------------------------------------------------
_q("c01_effective_end", f"SELECT id, stop AS ends, vf <= {MID} AND (stop IS NULL OR {MID} < stop) AS applies FROM elog")
_q("c03_ranked_assertions", "SELECT context, target AS target_id, id AS assertion_id, rn AS rank FROM eval", MID)
_q("c04_resolved_states", "SELECT context, target AS target_id, id AS winner, '{\"event\":\"' || kind || '\"}' AS value_json, prov AS provenance, conf AS confidence, kind AS source, vf AS valid_from, stop AS valid_to, n AS contributors, prov = 0 AS is_unknown FROM eval WHERE rn = 1", MID)
QUERIES["c04_latest_states"] = sql("""SELECT context, target AS target_id, id AS winner, prov AS provenance, n AS contributors FROM (
SELECT *, row_number() OVER (PARTITION BY context, target ORDER BY prov DESC, conf DESC, vf DESC, id) AS rn, count(*) OVER (PARTITION BY context, target) AS n FROM elog WHERE stop IS NULL) WHERE rn = 1""")
_q("c06_contradictions", f"SELECT context, target AS target_id, w.id AS winner, v.id AS assertion_id, {PROV.replace('prov', 'v.prov')} AS provenance, v.conf AS confidence FROM eval v JOIN (SELECT context, target, id, kind FROM eval WHERE rn = 1) w USING (context, target) WHERE v.kind <> w.kind", MID)
_q("c07_computable", "SELECT context, target AS target_id, id AS winner, prov AS provenance FROM eval WHERE rn = 1 AND prov > 0", 1704153600.0)
_q("c08_live_nodes", "SELECT id, type, winner, prov AS provenance, conf AS confidence, source, vf AS valid_from, stop AS valid_to, n AS contributors FROM ln@")
_q("c08_live_edges", "SELECT id, type, src, dst, winner, prov AS provenance, conf AS confidence, vf AS valid_from, n AS contributors FROM le@")
_q("c09_change_counts", "SELECT context, target AS target_id, count(*) AS changes FROM elog GROUP BY 1, 2")
_q("c10_evidence", "SELECT DISTINCT kind AS target_kind, target AS target_id, unnest(ev) AS ref FROM valid@")
_q("c11_inferred", "SELECT context, target AS target_id FROM eval WHERE rn = 1 AND prov = 1", MID)
_VS = "CASE WHEN conf >= 0.8 AND prov <> 1 THEN 'VERIFIED' WHEN conf >= 0.5 THEN 'PARTIALLY_VERIFIED' ELSE 'THEORETICAL' END"
_q("c12_entity_records", f"""SELECT id AS entity_id, type AS node_type, conf AS confidence, {PROV} AS provenance, {_VS} AS validation_state, vf AS valid_from, refs
FROM ln@ JOIN (SELECT target, count(DISTINCT ref) AS refs FROM (SELECT target, unnest(ev) AS ref FROM valid@ WHERE kind = 'node') GROUP BY 1) r ON r.target = id""")
_q("c13_view_accessors", "SELECT type, count(*) AS nodes, min(conf) AS weakest, max(conf) AS strongest, sum(changes)::BIGINT AS changes FROM ln@ GROUP BY 1")
_q("c14_validation_states", f"SELECT id, {_VS} AS state FROM le@")
_q("c15_inference_decay", """SELECT l_discount, l_linenumber AS depth, round((1.0::DOUBLE - l_discount * 6.0::DOUBLE) * pow(0.8::DOUBLE, l_linenumber), 9) AS decayed,
l_linenumber BETWEEN 1 AND 3 AND (1.0::DOUBLE - l_discount * 6.0::DOUBLE) * pow(0.8::DOUBLE, l_linenumber) >= 0.25::DOUBLE AS admissible, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4""")
_q("c17_target_history", "SELECT id, '{\"event\":\"' || kind || '\"}' AS value_json, prov AS provenance, conf AS confidence, vf AS valid_from FROM elog WHERE target = 'u_7' AND context = 'default'")
_q("c17_point_lookup", "SELECT target AS target_id, id AS winner, prov AS provenance, prov = 0 AS is_unknown FROM eval WHERE rn = 1 AND target = 'u_7' AND context = 'default'", MID)
_q("c18_edge_trace", f"""SELECT DISTINCT l.id, l.src AS source, l.dst AS target, l.conf AS confidence, {PROV.replace('prov', 'l.prov')} AS tier, l.vf AS observed_at, v.src AS from_source, unnest(v.ev) AS ref
FROM le@ l JOIN valid@ v ON v.kind = 'edge' AND v.target = l.id WHERE l.id = (SELECT min(id) FROM le@ WHERE type = 'DEPENDS_ON')""")

# --- D ---------------------------------------------------------------------------
_q("d01_scan_by_kind", f"SELECT id, type, conf AS confidence FROM ln@ WHERE type = 'DATASTORE'")
_q("d02_typed_equality", f"SELECT id, conf AS confidence FROM ln@ WHERE type = 'SERVICE' AND port = 443")
_q("d03_comparisons", f"SELECT id FROM ln@ WHERE type = 'IDENTITY' AND importance >= 0.25 AND importance < 0.5 AND conf > 0.5")
_q("d04_in_list", "SELECT id, conf AS confidence FROM ln@ WHERE type = 'SERVICE' AND port IN (80, 3306) ")
_q("d05_contains", f"SELECT id FROM ln@ WHERE type = 'DATASTORE' AND (contains(lower(name), 'red') OR contains(id, '77'))")
_q("d07_left_to_right", f"SELECT id FROM ln@ WHERE type = 'SERVICE' AND port IN (443, 80) AND contains(name, '-prod')")
_q("d08_flag", f"SELECT id FROM ln@ WHERE type = 'ASSET' AND winner LIKE 'a%' AND id IN (SELECT 's_' || s_suppkey FROM supplier WHERE s_acctbal >= 9000)")
_NEAR = """(SELECT id, min(depth) AS depth FROM (
  SELECT b AS id, 1 AS depth FROM und@ WHERE a = 'c_2'
  UNION ALL SELECT v.b, 2 FROM und@ u JOIN und@ v ON v.a = u.b WHERE u.a = 'c_2'
  UNION ALL SELECT w.b, 3 FROM und@ u JOIN und@ v ON v.a = u.b JOIN und@ w ON w.a = v.b WHERE u.a = 'c_2') WHERE id <> 'c_2' GROUP BY 1)"""
_q("d09_connected_to", f"SELECT id, depth FROM {_NEAR}")
_q("d09_find_connected", f"SELECT id FROM ln@ WHERE type = 'DATASTORE' AND id IN (SELECT id FROM {_NEAR} WHERE depth <= 2)")
_q("d10_sorted", "SELECT id FROM ln@ WHERE type = 'ASSET' ORDER BY importance DESC, id LIMIT 25")
_q("d13_list_nodes", f"SELECT id, {PROV} AS provenance, vf AS valid_from FROM ln@ WHERE type = 'SERVICE' ORDER BY id LIMIT 300 OFFSET 200")
_q("d13_list_edges", f"SELECT id, src, dst, {PROV} AS provenance FROM le@ WHERE type = 'HOSTS' ORDER BY id OFFSET 50")
_q("d14_node_detail", "SELECT 's_5' AS target_id, l.type, l.key_json, l.winner, l.n AS contributors, a.id, a.prov AS provenance, a.vf AS valid_from FROM asr a JOIN ln@ l ON l.id = a.target WHERE a.kind = 'node' AND a.target = 's_5'")
_q("d13_list_totals", "SELECT 'nodes' AS listed, count(*) AS total FROM ln@ WHERE type = 'SERVICE' UNION ALL SELECT 'edges', count(*) FROM le@ WHERE type = 'HOSTS'")
_q("d14_edge_detail", """SELECT l.id AS target_id, l.type, l.src, l.dst, l.winner, l.n AS contributors, a.id, a.prov AS provenance, a.vf AS valid_from FROM asr a JOIN le@ l ON l.id = a.target
WHERE a.kind = 'edge' AND a.target = (SELECT min(id) FROM le@ WHERE type = 'DEPENDS_ON')""")
_q("d15_resolved_evidence", "SELECT DISTINCT v.kind AS target_kind, v.target AS id, unnest(v.ev) AS ref FROM valid@ v WHERE (v.kind = 'node' AND v.target IN (SELECT id FROM ln@)) OR (v.kind = 'edge' AND v.target IN (SELECT id FROM le@))")
_q("d15_resolved_graph", f"SELECT 'node' AS target_kind, id, type, NULL AS src, NULL AS dst, conf AS confidence, {PROV} AS provenance FROM ln@ UNION ALL SELECT 'edge', id, type, src, dst, conf, {PROV} FROM le@")
_q("d16_search_graph", """SELECT 'node' AS target_kind, id, type, conf AS confidence FROM ln@ WHERE type = 'DATASTORE' AND id IN (SELECT 'p_' || p_partkey FROM part WHERE p_type = 'PROMO')""")
_HIT = "contains(lower(source), 'license') OR contains(lower(lang), 'license') OR contains(lower(text), 'license')"
_q("d17_search_texts", f"SELECT 'd_' || doc_id AS id, 'ASSET' AS type FROM documents WHERE {_HIT}")
_q("d17_search_first", f"SELECT 'd_' || doc_id AS id, 'ASSET' AS type FROM documents WHERE {_HIT} ORDER BY id LIMIT 20")
_q("d17_search_count", f"SELECT count(*) AS count FROM documents WHERE {_HIT}")
_SEARCH = """SELECT 'assets' AS section, id, name AS label, CASE WHEN NOT contains(id, '{0}') THEN CASE WHEN contains(lower(name), '{0}') THEN 'name' END END AS match_field, type FROM ln@
WHERE contains(id, '{0}') OR contains(lower(name), '{0}')
UNION ALL SELECT 'recommendations', rid, title, NULL, NULL FROM recs@ WHERE contains(lower(title), '{0}') OR contains(lower(description), '{0}')
UNION ALL SELECT 'compliance', control_id, control_title, NULL, NULL FROM ffail@ WHERE contains(lower(control_title), '{0}') OR contains(lower(control_id), '{0}')"""
_q("d18_search_everything", _SEARCH.format("red"))
_q("d18_search_compliance", _SEARCH.format("access"))
_q("d19_inventory", "SELECT id, name, type, environment, level AS criticality, score AS criticality_score FROM asm@ WHERE type IN ('ASSET', 'DATASTORE', 'SERVICE', 'IDENTITY')")
_q("d19_asset_detail", "SELECT id, type, name, environment, team, technical, business, sensitivity, level AS criticality, score AS criticality_score, reasons FROM asm@ WHERE id = 's_5'")

# --- E ---------------------------------------------------------------------------
_q("e01_adjacency", "SELECT src AS id, 'out' AS direction, id AS edge_id, type AS edge_type, dst AS other, conf AS confidence FROM le@ UNION ALL SELECT dst, 'in', id, type, src, conf FROM le@")
_q("e02_degree", "SELECT id, coalesce(degree, 0) AS degree FROM ln@ LEFT JOIN deg@ USING (id)")
_q("e03_providers", "SELECT consumer AS id, provider FROM dep@")
_q("e03_dependents", "SELECT provider AS id, consumer FROM dep@")
_q("e04_neighbourhood", "SELECT 'up' AS direction, l.id, l.type FROM dep@ d JOIN ln@ l ON l.id = d.provider WHERE d.consumer = 's_5' UNION ALL SELECT 'down', l.id, l.type FROM dep@ d JOIN ln@ l ON l.id = d.consumer WHERE d.provider = 's_5'")
_q("e04_dependent_kinds", """SELECT id, coalesce(assets, 0) AS assets, coalesce(services, 0) AS services, coalesce(datastores, 0) AS datastores FROM (SELECT id FROM ln@) LEFT JOIN (
SELECT d.provider AS id, count(*) FILTER (type = 'ASSET') AS assets, count(*) FILTER (type = 'SERVICE') AS services, count(*) FILTER (type = 'DATASTORE') AS datastores FROM dep@ d JOIN ln@ l ON l.id = d.consumer GROUP BY 1) USING (id)""")
_q("e05_dependency_metrics", "SELECT id AS entity_id, up AS upstream_count, down AS downstream_count, total AS total_dependencies, dense_rank() OVER (ORDER BY total DESC)::INTEGER AS dependency_rank FROM dc@")
_q("e05_dependency_evidence", """SELECT DISTINCT entity_id, ref FROM (SELECT id, unnest([src, dst]) AS entity_id FROM le@ WHERE type IN ('DEPENDS_ON', 'CONNECTS_TO', 'AUTHENTICATES_TO')) e
JOIN (SELECT target, unnest(ev) AS ref FROM valid@ WHERE kind = 'edge') v ON v.target = e.id""")
_IMPACT = """(SELECT root, node, min(depth) AS depth FROM (
  SELECT provider AS root, consumer AS node, 1 AS depth FROM dep@
  UNION SELECT a.provider, b.consumer, 2 FROM dep@ a JOIN dep@ b ON b.provider = a.consumer
  UNION SELECT a.provider, c.consumer, 3 FROM dep@ a JOIN dep@ b ON b.provider = a.consumer JOIN dep@ c ON c.provider = b.consumer) WHERE root <> node GROUP BY 1, 2)"""
_FOUND = f"""SELECT id AS entity_id, coalesce(n1, 0) AS directly_affected, coalesce(n2 + n3, 0) AS indirectly_affected,
round_even(100.0::DOUBLE * least(1.0::DOUBLE, (coalesce(n1, 0) + coalesce(n2, 0) * 0.5::DOUBLE + coalesce(n3, 0) * 0.25::DOUBLE) / 5.0::DOUBLE), 0)::INTEGER AS impact_score FROM ln@ LEFT JOIN (
SELECT root, count(*) FILTER (depth = 1) AS n1, count(*) FILTER (depth = 2) AS n2, count(*) FILTER (depth = 3) AS n3 FROM {_IMPACT} GROUP BY 1) p ON p.root = id"""
_q("e06_impact_paths", f"SELECT root AS entity_id, node AS affected_id, depth FROM {_IMPACT}")
_q("e06_impact_findings", _FOUND)
_q("e06_impact_scores", f"SELECT entity_id, impact_score FROM ({_FOUND})")
_q("e07_blast_counts", """SELECT id, coalesce(t, 0) AS total_impacted, coalesce(a, 0) AS asset, coalesce(s, 0) AS service, coalesce(d, 0) AS datastore, coalesce(i, 0) AS identity, coalesce(u, 0) AS unknown FROM (SELECT id FROM ln@) LEFT JOIN (
SELECT root AS id, count(*) AS t, count(*) FILTER (type = 'ASSET') AS a, count(*) FILTER (type = 'SERVICE') AS s, count(*) FILTER (type = 'DATASTORE') AS d, count(*) FILTER (type = 'IDENTITY') AS i,
count(*) FILTER (type IN ('ZONE', 'CREDENTIAL')) AS u FROM pairs@ p JOIN (SELECT id AS nid, type FROM ln@) l ON l.nid = p.node GROUP BY 1) USING (id)""")
_q("e07_chain_counts", """WITH c AS (SELECT 'c_' || c_custkey AS id, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1 AS after FROM customer),
sizes AS (SELECT nation, max(after) + 1 AS n FROM c GROUP BY nation)
SELECT id, after AS total_impacted FROM c UNION ALL
SELECT 's_' || s_suppkey, CAST(count(*) OVER (PARTITION BY s_nationkey) + coalesce(n, 0) AS BIGINT) FROM supplier LEFT JOIN sizes ON nation = s_nationkey""")
_q("e07_blast_radius", "SELECT l.id, l.type, l.name FROM pairs@ p JOIN ln@ l ON l.id = p.node WHERE p.root = 's_5'")
_q("e08_shortest_path", """SELECT nodes[1] AS source, nodes[len(nodes)] AS target, array_to_string(nodes, ',') AS nodes, array_to_string(path, ',') AS edges, len(path)::INTEGER AS distance,
CASE WHEN weakest < 0.5 THEN 'LOW' WHEN weakest < 0.8 THEN 'MEDIUM' WHEN weakest < 0.95 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, floor(weakest * 100)::INTEGER AS score FROM walk@
WHERE depth = 0 ORDER BY path LIMIT 1""")
_q("e09_all_paths", """SELECT 'c_2' AS source, nodes[len(nodes)] AS target, array_to_string(nodes, ',') AS nodes, array_to_string(path, ',') AS edges, len(path)::INTEGER AS distance FROM (
SELECT [src, dst] AS nodes, [id] AS path FROM le@ WHERE src = 'c_2'
UNION ALL SELECT [a.src, a.dst, b.dst], [a.id, b.id] FROM le@ a JOIN le@ b ON b.src = a.dst WHERE a.src = 'c_2' AND b.dst NOT IN (a.src, a.dst)
UNION ALL SELECT [a.src, a.dst, b.dst, c.dst], [a.id, b.id, c.id] FROM le@ a JOIN le@ b ON b.src = a.dst JOIN le@ c ON c.src = b.dst WHERE a.src = 'c_2' AND b.dst NOT IN (a.src, a.dst) AND c.dst NOT IN (a.src, a.dst, b.dst))""")
_SUB = f"(SELECT id, depth FROM (SELECT id, depth FROM {_NEAR} UNION ALL SELECT 'c_2', 0) WHERE depth <= 2 ORDER BY depth, id LIMIT 40)"
_q("e10_subgraph_nodes", f"SELECT l.id, l.type, s.depth FROM {_SUB} s JOIN ln@ l ON l.id = s.id")
_q("e10_subgraph_edges", f"SELECT id, type, src, dst FROM le@ WHERE src IN (SELECT id FROM {_SUB} WHERE depth < 2) OR dst IN (SELECT id FROM {_SUB} WHERE depth < 2)")

# --- F ---------------------------------------------------------------------------
_q("f01_public_zones", "SELECT id FROM ln@ WHERE pubzone")
_q("f02_public_flags", "SELECT id, public_flag FROM ln@")
_q("f03_in_public_zone", "SELECT id, zconf AS zone_confidence FROM inz@")
_q("f04_reachable_assets", "SELECT id, inferred, conf AS confidence, in_zone, via AS via_edge FROM reach@")
_q("f10_exposure_findings", "SELECT id AS entity_id, ft AS finding_type, conf AS confidence, vs AS validation_state FROM ef@")
_RESTS = """rests AS MATERIALIZED (SELECT id, 'node' AS k, id AS tid FROM seed@ UNION ALL SELECT e.src, 'edge', e.id FROM le@ e JOIN ln@ z ON z.id = e.dst AND z.pubzone WHERE e.type = 'IN_ZONE' AND e.src IN (SELECT id FROM seed@)
UNION ALL SELECT id, 'edge', via FROM hop@)"""
_ON = """SELECT r.id AS entity_id, 'PUBLIC_ZONE_ASSET' AS finding_type, r.k, r.tid FROM rests r WHERE r.id IN (SELECT id FROM seed@ WHERE in_zone)
UNION ALL SELECT id, 'EXTERNALLY_REACHABLE_ASSET', k, tid FROM rests
UNION ALL SELECT h.id, 'INTERNET_FACING_SERVICE', r.k, r.tid FROM host@ h JOIN ln@ n ON n.id = h.id AND n.type = 'SERVICE' JOIN rests r ON r.id = h.host
UNION ALL SELECT h.id, 'INTERNET_FACING_SERVICE', 'node', h.id FROM host@ h JOIN ln@ n ON n.id = h.id AND n.type = 'SERVICE'
UNION ALL SELECT h.id, 'INTERNET_FACING_SERVICE', 'edge', h.eid FROM host@ h JOIN ln@ n ON n.id = h.id AND n.type = 'SERVICE'
UNION ALL SELECT id, ft, 'node', id FROM ef@ WHERE ft IN ('EXPOSED_DATASTORE', 'HIGH_CONNECTIVITY_EXPOSED')
UNION ALL SELECT h.id, 'EXPOSED_DATASTORE', r.k, r.tid FROM host@ h JOIN ln@ n ON n.id = h.id AND n.type = 'DATASTORE' JOIN rests r ON r.id = h.host
UNION ALL SELECT id, ft, 'edge', id FROM ef@ WHERE ft = 'ZONE_BOUNDARY_CROSSING'"""
_REFS = "(SELECT kind, target, unnest(ev) AS ref FROM valid@)"


def _with(inner: str, text: str) -> str:
    """``text`` with the local piece ``inner`` put after the shared ones."""
    out = sql(inner + " \x00 " + text)
    head, tail = out.split("\x00")
    name = inner.split(" AS ")[0]
    at = head.rindex(name + " AS MATERIALIZED")
    return head[:at].rstrip() + ", " + head[at:] + tail


QUERIES["f10_exposure_evidence"] = _with(_RESTS, f"SELECT DISTINCT entity_id, finding_type, ref FROM ({_ON}) o JOIN {_REFS} v ON v.kind = o.k AND v.target = o.tid")
_q("f11_exposure_buckets", """SELECT 'cloud_resources' AS bucket, id, name, cloud AS detail FROM ln@ WHERE cloud IS NOT NULL UNION ALL SELECT 'internet_reachable_assets', id, name, NULL FROM ln@ WHERE inet_asset
UNION ALL SELECT 'internet_reachable_services', id, name, port::VARCHAR FROM ln@ WHERE inet_service UNION ALL SELECT 'exposed_datastores', id, name, coalesce(product, 'unknown') FROM ln@ WHERE store""")

# --- G ---------------------------------------------------------------------------
_q("g01_exposure_magnitude", "SELECT id AS entity_id, max(conf) AS exposure FROM ef@ GROUP BY 1")
_q("g02_criticality", """SELECT id AS entity_id, crit AS score, format('{:.6f}', 0.3::DOUBLE * f1)::DOUBLE AS business_importance, format('{:.6f}', 0.25::DOUBLE * f2)::DOUBLE AS dependency_centrality, format('{:.6f}', 0.2::DOUBLE * f3)::DOUBLE AS exposure,
format('{:.6f}', 0.15::DOUBLE * f4)::DOUBLE AS connectivity, format('{:.6f}', 0.1::DOUBLE * f5)::DOUBLE AS change_frequency FROM sc@""")
_q("g03_risk", "SELECT id AS entity_id, risk AS score, band AS category, format('{:.6f}', conf)::DOUBLE AS confidence, format('{:.6f}', f3)::DOUBLE AS exposure_score, crit AS criticality_score, format('{:.6f}', lift)::DOUBLE AS change_multiplier FROM sc@")
QUERIES["g03_risk_evidence"] = _with(_RESTS, f"""SELECT DISTINCT entity_id, ref FROM (SELECT entity_id, k, tid FROM ({_ON}) UNION ALL SELECT id, 'node', id FROM ln@) o JOIN {_REFS} v ON v.kind = o.k AND v.target = o.tid
WHERE entity_id IN (SELECT id FROM ln@)""")
_q("g05_risk_of_node", "SELECT id AS entity_id, risk AS score, band AS category FROM sc@ WHERE id = 's_5' UNION ALL SELECT 'nobody', 0, 'LOW'")
_q("g06_critical_ranking", """SELECT *, centrality * 2 + downstream_dependencies * 5 + base_risk AS criticality_score FROM (
SELECT n.id, n.name, n.type, coalesce(d.degree, 0) AS centrality, dc.down AS downstream_dependencies, CASE WHEN n.sort = 'LoadBalancer' THEN 10 ELSE 1 END + CASE WHEN n.cloud IS NOT NULL THEN 5 ELSE 0 END AS base_risk
FROM ln@ n JOIN dc@ dc ON dc.id = n.id LEFT JOIN deg@ d ON d.id = n.id WHERE n.type IN ('ASSET', 'DATASTORE', 'SERVICE')) ORDER BY criticality_score DESC, id LIMIT 50""")
_q("g07_environment", "SELECT id, environment FROM env@")
_q("g08_sensitivity", "SELECT id, level, confidence, evidence_kind, evidence FROM sens@")
_q("g09_ownership", "SELECT id, team, technical, business FROM own@")
_q("g10_business_criticality", "SELECT id, level, score, reasons AS factors FROM asm@")

# --- H ---------------------------------------------------------------------------
_q("h02_recommendations", "SELECT rid AS id, severity, category, title, description, reasons, actions, node_id FROM recs@")
_q("h03_top_recommendations", "SELECT rid AS id, severity, title FROM recs@ ORDER BY rank DESC, node_id, rule LIMIT 25")
_q("h03_recommendation_by_id", "SELECT rid AS id, severity, title FROM recs@ WHERE rid = 'rec-exp-db-p_5'")
_q("h04_governance", "SELECT id, title, severity, action, target_id, target_name, category FROM gov@")
_q("h05_control_failures", "SELECT framework, control_id, rid AS recommendation_id, severity, reason FROM fail@")
_q("h06_control_status", "SELECT c.framework, c.control_id, c.control_title, c.control_description, f.rid IS NULL AS passed, f.rid AS recommendation_id, f.reason, f.node_id AS evidence_nodes FROM ctl c LEFT JOIN ffail@ f ON f.control_id = c.control_id")
_q("h06_compliance", "SELECT framework, controls, passed, failed, score FROM comp@")
_q("h06_overall_compliance", "SELECT (sum(score) // 5)::INTEGER AS overall_score FROM comp@")
_q("h07_team_members", "SELECT coalesce(team, 'Unassigned') AS team, id FROM own@")
_q("h07_business_units", """SELECT t.team, t.asset_count, 0 AS critical_assets, coalesce(r.n, 0) AS recommendations, greatest(0, 100 - coalesce(r.p, 0))::BIGINT AS security_score
FROM (SELECT coalesce(team, 'Unassigned') AS team, count(*) AS asset_count FROM own@ GROUP BY 1) t LEFT JOIN (
SELECT coalesce(team, 'Unassigned') AS team, count(*) AS n, sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5 ELSE 0 END) AS p FROM recs@ GROUP BY 1) r ON r.team = t.team""")
_LIFE = f"""SELECT 'orphaned' AS state, id, name, type FROM ln@ WHERE type IN ('ASSET', 'DATASTORE') AND id NOT IN (SELECT id FROM deg@)
UNION ALL SELECT CASE WHEN {NOW} - vf < 86400 THEN 'new' ELSE 'dormant' END, id, name, type FROM ln@ WHERE type IN ('ASSET', 'DATASTORE') AND ({NOW} - vf < 86400 OR {NOW} - vf > 2592000)"""
_q("h08_lifecycle", _LIFE)
_q("h08_lifecycle_summary", f"SELECT (SELECT count(*) FROM ln@) AS total_assets, count(*) FILTER (state = 'orphaned') AS orphaned_count, count(*) FILTER (state = 'dormant') AS dormant_count FROM ({_LIFE})")
_q("h09_reasoning", """SELECT rid AS target_id, 'Reasoning for ' || title AS description, NULL AS node_id, CASE WHEN category = 'EXPOSURE' THEN 'Rule Matched: Exposed Asset Detection' ELSE 'Rule Matched: General Best Practices' END AS step FROM recs@
UNION ALL SELECT rid, 'Reasoning for ' || title, node_id, CASE WHEN category = 'EXPOSURE' THEN 'Asset is internet reachable without restrictive boundaries.' ELSE 'Asset flagged by intelligence engine.' END FROM recs@""")

# --- I ---------------------------------------------------------------------------
_TWO = {"0": EARLIER, "1": NOW}
_MOVED = """SELECT 'NEW_' || type AS type, id AS target_id, conf AS confidence, name FROM ln@1 WHERE id NOT IN (SELECT id FROM ln@0)
UNION ALL SELECT 'REMOVED_' || type, id, conf, name FROM ln@0 WHERE id NOT IN (SELECT id FROM ln@1)"""
_RISKS = """SELECT CASE WHEN b.risk > a.risk THEN 'RISK_INCREASE' ELSE 'RISK_DECREASE' END AS type, b.id AS target_id, a.risk AS old_score, b.risk AS new_score FROM sc@0 a JOIN sc@1 b ON b.id = a.id WHERE a.risk <> b.risk"""
_FELL = """SELECT 'COMPLIANCE_FAILURE' AS type, 'global' AS target_id, b.framework, a.score AS old_score, b.score AS new_score FROM comp@0 a JOIN comp@1 b ON b.framework = a.framework WHERE b.score < a.score"""
_q("i01_node_changes", _MOVED, times=_TWO)
_q("i02_risk_changes", _RISKS, times=_TWO)
_q("i03_edge_changes", """SELECT CASE e.type WHEN 'AUTHENTICATES_TO' THEN 'PRIVILEGE_ESCALATION' WHEN 'HOSTS' THEN 'OWNERSHIP_DRIFT' ELSE CASE WHEN n.type = 'SERVICE' THEN 'NEW_EXPOSED_SERVICE' ELSE 'NEW_EXPOSURE' END END AS type,
e.src AS target_id, e.dst AS other, e.conf AS confidence FROM le@1 e JOIN ln@1 n ON n.id = e.src WHERE e.type IN ('AUTHENTICATES_TO', 'HOSTS', 'DEPENDS_ON') AND e.id NOT IN (SELECT id FROM le@0)""", times=_TWO)
_q("i04_compliance_changes", _FELL, times={"0": -1.0, "1": NOW})
_ALERT = f"""SELECT 'LOW' AS severity, CASE type WHEN 'NEW_ASSET' THEN 'New Asset Discovered' ELSE 'New Service Discovered' END AS title,
  CASE type WHEN 'NEW_ASSET' THEN 'A new asset was detected: ' ELSE 'A new service was detected: ' END || name AS description, target_id, type FROM ({_MOVED}) WHERE type IN ('NEW_ASSET', 'NEW_SERVICE')
UNION ALL SELECT CASE WHEN new_score - old_score >= 30 OR new_score >= 80 THEN 'CRITICAL' ELSE 'MEDIUM' END, 'Risk Score Increased', 'Risk score increased from ' || old_score || ' to ' || new_score, target_id, type FROM ({_RISKS}) WHERE type = 'RISK_INCREASE'
UNION ALL SELECT 'HIGH', 'Compliance Score Dropped (' || framework || ')', 'Score dropped from ' || old_score || ' to ' || new_score, target_id, type FROM ({_FELL})"""
_q("i05_alerts", f"SELECT severity, title, description, target_id, {NOW}::DOUBLE AS timestamp FROM ({_ALERT})", times=_TWO)
_q("i06_alerts_until", f"SELECT severity, type, count(*) AS n FROM ({_ALERT}) GROUP BY 1, 2", times=_TWO)
_POINTS = {"0": ("current", NOW), "1": ("last_week", NOW - 7 * 86400.0), "2": ("last_month", NOW - 30 * 86400.0), "3": ("last_quarter", NOW - 90 * 86400.0)}
_METRICS = " UNION ALL ".join(
    f"SELECT '{label}' AS label, {at}::DOUBLE AS timestamp, sum(risk)::BIGINT AS total_risk, round(avg(risk), 9) AS avg_risk, count(*) AS node_count, (SELECT count(*) FROM recs@{k} WHERE severity = 'CRITICAL') AS critical_findings FROM sc@{k}"
    for k, (label, at) in _POINTS.items())
_q("i07_trend", f"""SELECT *, CASE WHEN delta > 0 THEN 'INCREASING' WHEN delta < 0 THEN 'DECREASING' ELSE 'STABLE' END AS trend FROM (
SELECT *, (sum(total_risk) FILTER (label = 'current') OVER () - sum(total_risk) FILTER (label = 'last_week') OVER ())::BIGINT AS delta FROM ({_METRICS}))""", times={k: at for k, (_, at) in _POINTS.items()})

# --- J ---------------------------------------------------------------------------
_q("j01_executive", """SELECT count(*) AS total_nodes, count(*) FILTER (type = 'ASSET') AS total_assets, count(*) FILTER (band IN ('HIGH', 'CRITICAL')) AS high_risk_count, count(*) AS critical_assets,
(SELECT count(*) FROM ef@) AS exposures_detected FROM sc@""")
_RISK = "SELECT id AS entity_id, risk AS risk_score, band AS category FROM sc@"
_q("j01_top_risks", _RISK)
_q("j01_top_ten", f"{_RISK} ORDER BY id LIMIT 10")
_q("j02_technical_risks", _RISK)
_q("j02_technical_nodes", "SELECT id, type, key_json FROM ln@")
_q("j03_asset_inventory", "SELECT id, type, environment FROM asm@ WHERE type IN ('ASSET', 'DATASTORE', 'SERVICE')")
_q("j04_critical_assets", "SELECT id, level AS criticality, score FROM asm@ WHERE level IN ('High', 'Critical')")
_q("j05_sensitive_data", "SELECT id, sensitivity FROM asm@ WHERE sensitivity IN ('Restricted', 'Confidential')")
_PLAN = "SELECT rid AS id, severity, title, description, act AS primary_action FROM recs@"
_q("j06_action_plan", f"{_PLAN} WHERE severity IN ('CRITICAL', 'HIGH')")
_q("j06_remediation", _PLAN)
_q("j06_critical_findings", "SELECT rid AS id, title, description, category FROM recs@ WHERE severity = 'CRITICAL'")
_q("j07_ownership", "SELECT id, team, technical, business FROM own@ WHERE coalesce(team, technical, business) IS NOT NULL")
_q("j08_board", "SELECT count(*) FILTER (type = 'ASSET') AS total_assets, count(*) FILTER (band = 'CRITICAL') AS critical_risks, (SELECT (sum(score) // 5)::BIGINT FROM comp@) AS compliance_score FROM sc@")
_q("j09_compliance", "SELECT c.framework, c.score, coalesce(f.control_id, 'None') AS failed_control, coalesce(f.reason, '') AS reason FROM comp@ c LEFT JOIN ffail@ f ON f.framework = c.framework")
_q("j09_risk_total", "SELECT sum(risk)::BIGINT AS total_risk FROM sc@")
_q("j09_governance", "SELECT id, severity, title, target_name AS target, action, category FROM gov@")

# --- K: streams must end where the batch does --------------------------------------
_q("k01_event_ingestion", "SELECT id, event_type, timestamp FROM disc")
_q("k01_exact_ingestion", "SELECT id, event_type, timestamp FROM disc")
QUERIES["k02_graph_growth"] = f"""WITH {_BASE}, asn AS (SELECT DISTINCT aid AS x, s_suppkey::VARCHAR AS y, 'node' AS k FROM a UNION SELECT zid, '', 'node' FROM z WHERE r_name <> 'AFRICA' UNION SELECT sid, o_orderkey::VARCHAR, 'node' FROM s
UNION SELECT cid, '', 'node' FROM c UNION SELECT did, p_brand || p_partkey, 'node' FROM d UNION SELECT aid || 'z', s_suppkey::VARCHAR, 'edge' FROM a UNION SELECT aid || sid, o_orderkey::VARCHAR, 'edge' FROM s
UNION SELECT aid || did, p_brand, 'edge' FROM d WHERE aid IS NOT NULL UNION SELECT cid || gid, c_mktsegment, 'edge' FROM g)
SELECT 'node ' || type AS what, count(DISTINCT id) AS n FROM n GROUP BY 1 UNION ALL SELECT 'edge ' || type, count(*) FROM e GROUP BY 1 UNION ALL SELECT 'assertion ' || k, count(*) FROM asn GROUP BY 1
UNION ALL SELECT 'rejected', (SELECT count(*) FROM orders WHERE (o_totalprice < 2000 OR o_orderpriority = '4-NOT SPECIFIED') AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) + (SELECT count(*) FROM part WHERE p_size IN (49, 50))"""
_TICKS = {"0": EARLIER - YEAR, "1": EARLIER, "2": NOW}


def _alerts(before: str, after: str, at: float) -> str:
    text = _ALERT.replace("@1", "@#").replace("@0", f"@{before}").replace("@#", f"@{after}")
    return f"SELECT {at}::DOUBLE AS timestamp, severity, title, count(*) AS n FROM ({text}) GROUP BY 1, 2, 3"


_q("k03_monitoring_cycle", f"{_alerts('0', '1', EARLIER)} UNION ALL {_alerts('1', '2', NOW)}", times=_TICKS)
QUERIES["k04_streaming_winners"] = sql("""SELECT context, target AS target_id, id AS winner, prov AS provenance FROM (
SELECT *, row_number() OVER (PARTITION BY context, target ORDER BY prov DESC, conf DESC, vf DESC, id) AS rn FROM elog WHERE stop IS NULL) WHERE rn = 1""")
_q("k04_streaming_states", "SELECT context, target AS target_id, id AS winner, prov AS provenance, n AS contributors FROM eval WHERE rn = 1", MID)

# --- L ---------------------------------------------------------------------------
_CUT = MID + 3 * 86400.0
_q("l01_event_retention", f"""SELECT CASE WHEN timestamp < {_CUT} THEN 'archived' ELSE 'kept' END AS part, source, count(*) AS n FROM {_LOG} GROUP BY 1, 2
UNION ALL SELECT 'kept', NULL, count(*) FROM disc WHERE source = 'purchase'""")
_q("l02_snapshot_retention", f"SELECT 'young' AS name, {_SIZES}")
_q("l03_event_log_issues", """SELECT 'issue' AS level, 'invalid JSON' AS problem, 1::BIGINT AS reported, count(*) AS lines FROM disc WHERE source = 'purchase'
UNION ALL SELECT 'warning', 'duplicate event id', count(*), count(*) FROM disc WHERE source = 'signup'""")
_q("l04_graph_round_trip", "SELECT true AS valid, 0 AS issues")
_q("l05_snapshot_check", "SELECT true AS valid, 0 AS issues")
_q("l06_unknown_entities", "SELECT e.id, count(*) AS events FROM (SELECT unnest([a1, a2]) AS id FROM disc) e WHERE e.id NOT IN (SELECT id FROM regd) GROUP BY 1")

# --- M ---------------------------------------------------------------------------
_PATTERNS = [
    ("EXPOSURE", "exposed.*internet|public.*database|externally reachable|exposed.*asset|internet reachable|publicly accessible"),
    ("RISK", "highest risk|most dangerous|critical risk|risk.*increasing|top risk"),
    ("ASSET", "production asset|sensitive data|who owns|asset.*contain|show.*asset"),
    ("DEPENDENCY", "depends on|if.*fails|what breaks|blast radius"),
    ("COMPLIANCE", "compliant|pci|controls.*failing|governance|compliance"),
    ("TREND", "what changed|risk.*week|risk.*month|trend"),
    ("EXECUTIVE", "fix first|summarize|executive summary|biggest problem|prioritize|leadership"),
]
_INTENT = " ".join(f"WHEN regexp_matches(lower(text), '{p}', 'n') THEN '{c}'" for c, p in _PATTERNS)
_q("m01_intent", f"""SELECT id, CASE {_INTENT} ELSE 'UNKNOWN' END AS intent FROM (
SELECT 'c:' || conv_id || ':' || turn AS id, text FROM conversations UNION ALL SELECT 'd:' || doc_id, text FROM documents)""")
