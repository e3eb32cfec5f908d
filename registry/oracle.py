"""DuckDB SQL with the same rows as the queries, written apart from them.

``PIECES`` are common table expressions over the test tables; ``sql`` puts the ones a statement needs,
with what they need in turn, in front of it. Pieces that depend on a time end in ``@``, which becomes a
suffix, so that one statement can hold two times.
"""

from __future__ import annotations

import re

NOW, EARLIER, YEAR, MID = 959817600.0, 915148800.0, 31536000.0, 1705276800.0

PIECES: dict[str, str] = {}

PIECES["links"] = """
SELECT DISTINCT a, b FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS b FROM lineitem) WHERE a <> b"""
PIECES["ohost"] = "SELECT l_orderkey, min(l_suppkey) AS host FROM lineitem GROUP BY 1"
PIECES["phost"] = "SELECT l_partkey, min(l_suppkey) AS host FROM lineitem GROUP BY 1"
PIECES["lines"] = """
SELECT l_orderkey, l_partkey, l_suppkey, max(l_discount) AS discount, max(l_shipdate) AS shipped, min(o_orderdate) AS dated
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""
PIECES["edges"] = """
SELECT 'iz_' || s_suppkey AS id, 'IN_ZONE' AS type, 's_' || s_suppkey AS src, 'z_' || n_regionkey AS dst, s_suppkey AS x, n_regionkey AS y, 0.0::DOUBLE AS since
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'ho_' || l_orderkey, 'HOSTS', 's_' || host, 'o_' || l_orderkey, host, l_orderkey, epoch(o_orderdate) FROM ohost JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'hp_' || l_partkey, 'HOSTS', 's_' || host, 'p_' || l_partkey, host, l_partkey, 0.0 FROM phost
UNION ALL SELECT 'ct_' || a || '_' || b, 'CONNECTS_TO', 's_' || a, 's_' || b, a, b, 0.0 FROM links
UNION ALL SELECT 'au_' || o_custkey || '_' || o_orderkey, 'AUTHENTICATES_TO', 'c_' || o_custkey, 'o_' || o_orderkey, o_custkey, o_orderkey, epoch(o_orderdate) FROM orders
UNION ALL SELECT DISTINCT 'dp_' || l_orderkey || '_' || l_partkey, 'DEPENDS_ON', 'o_' || l_orderkey, 'p_' || l_partkey, NULL::BIGINT, NULL::BIGINT, epoch(o_orderdate)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
PIECES["regd"] = """
SELECT 'z_' || r_regionkey AS id, 'ZONE' AS type, '{"name":"' || CASE WHEN r_name = 'ASIA' THEN 'ASIA-DMZ' ELSE r_name END || '"}' AS key_json FROM region
UNION ALL SELECT 's_' || s_suppkey, 'ASSET', '{"hostname":"' || s_name || '"}' FROM supplier
UNION ALL SELECT 'p_' || p_partkey, 'DATASTORE', '{"cloud_id":"part-' || p_partkey || '"}' FROM part
UNION ALL SELECT 'c_' || c_custkey, 'IDENTITY', '{"principal":"' || c_name || '"}' FROM customer
UNION ALL SELECT 'o_' || o_orderkey, 'SERVICE', '{"asset":"order-' || o_orderkey || '"}' FROM orders"""
PIECES["asr"] = """
SELECT 'a_z_' || r_regionkey AS id, 'node' AS kind, 'z_' || r_regionkey AS target, 3 AS prov, 1.0::DOUBLE AS conf, 'atlas' AS src, 0.0::DOUBLE AS vf, NULL::DOUBLE AS vt, 0.0::DOUBLE AS obs, NULL::DOUBLE AS ttl, ['atlas:' || r_regionkey] AS ev FROM region
UNION ALL SELECT 'a_s_' || s_suppkey, 'node', 's_' || s_suppkey, 3, 0.9, 'scan', 0.0, NULL, 0.0, NULL, ['scan:' || s_suppkey, 'scan:all'] FROM supplier
UNION ALL SELECT 'b_s_' || s_suppkey, 'node', 's_' || s_suppkey, 2, 0.99, 'review', 850000000.0, NULL, 850000000.0, NULL, ['review:' || s_suppkey] FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT 'c_s_' || s_suppkey, 'node', 's_' || s_suppkey, 1, 0.7, 'model', 915148800.0, NULL, 915148800.0, 31536000.0, ['model:1'] FROM supplier WHERE s_acctbal < 3000
UNION ALL SELECT 'd_s_' || s_suppkey, 'node', 's_' || s_suppkey, 3, 0.95, 'audit', 883612800.0, 946684800.0, 883612800.0, NULL, ['audit:' || s_nationkey] FROM supplier WHERE s_nationkey < 8
UNION ALL SELECT 'a_p_' || p_partkey, 'node', 'p_' || p_partkey, 3, 0.6::DOUBLE + (p_size % 40) / 100.0::DOUBLE, 'catalog', 0.0, NULL, 0.0, NULL, ['brand:' || p_brand, 'type:' || p_type] FROM part
UNION ALL SELECT 'a_c_' || c_custkey, 'node', 'c_' || c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE 3 END, 0.85, 'directory', 0.0, NULL, 0.0, NULL, ['segment:' || c_mktsegment] FROM customer
UNION ALL SELECT 'a_o_' || o_orderkey, 'node', 'o_' || o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END,
  CASE o_orderpriority WHEN '1-URGENT' THEN 0.95 WHEN '2-HIGH' THEN 0.9 WHEN '3-MEDIUM' THEN 0.8 WHEN '5-LOW' THEN 0.45 ELSE 0.6 END::DOUBLE, 'probe', epoch(o_orderdate),
  CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate) + 31536000.0 END, epoch(o_orderdate), CASE WHEN o_orderstatus = 'P' THEN 94608000.0 END, ['probe:' || o_orderkey] FROM orders
UNION ALL SELECT 'a_' || id, 'edge', id, CASE WHEN type = 'CONNECTS_TO' AND (x * 31 + y * 17) % 50 < 10 THEN 1 ELSE 3 END, 0.5::DOUBLE + ((x * 31 + y * 17) % 50) / 100.0::DOUBLE, 'scan', since, NULL, since, NULL, ['edge:' || type]
FROM edges WHERE type <> 'DEPENDS_ON'
UNION ALL SELECT 'a_dp_' || l_orderkey || '_' || l_partkey || '_' || l_suppkey, 'edge', 'dp_' || l_orderkey || '_' || l_partkey, 3, 0.5::DOUBLE + discount * 4.0::DOUBLE, 'flow', epoch(dated), NULL, epoch(shipped), NULL,
  ['line:' || l_suppkey, 'order:' || l_orderkey] FROM lines"""
PIECES["valid@"] = "SELECT *, least(vt, vf + ttl) AS stop FROM asr WHERE vf <= {t} AND (least(vt, vf + ttl) IS NULL OR {t} < least(vt, vf + ttl))"
PIECES["state@"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, target ORDER BY prov DESC, conf DESC, obs DESC, id) AS rn, count(*) OVER (PARTITION BY kind, target) AS n FROM valid@
) WHERE rn = 1 AND prov > 0"""
PIECES["chg"] = "SELECT kind, target, count(*) AS changes FROM asr GROUP BY 1, 2"
PIECES["seg"] = """
SELECT 'z_' || r_regionkey AS id, r_name AS name, '' AS env, '' AS sens, NULL::VARCHAR AS team, NULL::VARCHAR AS tech, NULL::VARCHAR AS biz, 0.0::DOUBLE AS importance, '' AS sort, NULL::VARCHAR AS cloud,
  NULL::INTEGER AS port, NULL::VARCHAR AS product, false AS pub, r_name IN ('ASIA', 'EUROPE') AS pubzone FROM region
UNION ALL SELECT 's_' || s_suppkey, s_name, CASE WHEN s_nationkey < 5 THEN 'Production' WHEN s_nationkey < 10 THEN 'Staging' WHEN s_nationkey < 15 THEN 'Development' WHEN s_nationkey < 20 THEN 'Testing' ELSE '' END, '', NULL,
  CASE WHEN s_acctbal >= 5000 THEN 'tech-' || s_nationkey END, CASE WHEN s_acctbal >= 8000 THEN 'biz-' || s_nationkey END, s_acctbal / 10000.0::DOUBLE, CASE WHEN s_acctbal < 1000 THEN 'LoadBalancer' ELSE '' END,
  CASE WHEN s_nationkey >= 20 THEN 'aws' END, NULL, NULL, s_acctbal >= 9000, false FROM supplier
UNION ALL SELECT 'p_' || p_partkey, p_name || CASE WHEN p_size <= 10 THEN '-log' WHEN p_size <= 20 THEN '-customer' ELSE '' END, '',
  CASE p_type WHEN 'PROMO' THEN 'pci' WHEN 'LARGE' THEN 'pii' WHEN 'SMALL' THEN 'internal' WHEN 'MEDIUM' THEN 'open' ELSE '' END, NULL, NULL, CASE WHEN p_retailprice > 1500 THEN 'finance' END, 0.0, '', NULL, NULL, NULL, false, false FROM part
UNION ALL SELECT 'c_' || c_custkey, c_name, '', '', CASE WHEN c_acctbal < 7000 THEN c_mktsegment END, NULL, NULL, c_acctbal / 10000.0::DOUBLE, '', NULL, NULL, NULL, false, false FROM customer
UNION ALL SELECT 'o_' || o_orderkey, 'svc-' || o_orderkey || CASE WHEN o_totalprice >= 450000 THEN '-payment' WHEN o_orderstatus = 'O' THEN '-prod' WHEN o_orderstatus = 'P' THEN '-dev' ELSE '' END, '', '', NULL, NULL, NULL, 0.0, '', NULL,
  CASE o_orderpriority WHEN '1-URGENT' THEN 443 WHEN '2-HIGH' THEN 80 WHEN '5-LOW' THEN 3306 ELSE 8080 END, CASE WHEN o_orderpriority = '5-LOW' THEN 'mysql' END, false, false FROM orders"""
PIECES["ln@"] = """
SELECT r.id, r.type, r.key_json, s.id AS winner, s.prov, s.conf, s.src AS source, s.vf, s.stop, s.n, c.changes, g.name, g.env, g.sens, g.team, g.tech, g.biz, g.importance, g.sort, g.cloud, g.port, g.product, g.pubzone,
  CASE WHEN s.id LIKE 'b%' OR s.id LIKE 'd%' THEN true ELSE g.pub END AS public_flag,
  r.type = 'ASSET' AND (g.sort = 'LoadBalancer' OR (g.pub AND (s.id LIKE 'a%' OR s.id LIKE 'c%'))) AS inet_asset, r.type = 'SERVICE' AND g.port IN (80, 443) AS inet_service,
  r.type = 'DATASTORE' OR (r.type = 'SERVICE' AND g.product IS NOT NULL) AS store
FROM regd r JOIN state@ s ON s.kind = 'node' AND s.target = r.id JOIN chg c ON c.kind = 'node' AND c.target = r.id JOIN seg g ON g.id = r.id"""
PIECES["le@"] = """
SELECT e.id, e.type, e.src, e.dst, s.id AS winner, s.prov, s.conf, s.vf, s.n
FROM edges e JOIN state@ s ON s.kind = 'edge' AND s.target = e.id WHERE e.src IN (SELECT id FROM ln@) AND e.dst IN (SELECT id FROM ln@)"""
PIECES["dep@"] = "SELECT DISTINCT src AS consumer, dst AS provider FROM le@ WHERE type IN ('DEPENDS_ON', 'CONNECTS_TO', 'AUTHENTICATES_TO', 'HAS_PERMISSION', 'TRUSTS')"
PIECES["deg@"] = "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM le@ UNION ALL SELECT dst FROM le@) GROUP BY 1"
PIECES["dc@"] = """
SELECT id, coalesce(u, 0) AS up, coalesce(d, 0) AS down, coalesce(u, 0) + coalesce(d, 0) AS total FROM ln@
LEFT JOIN (SELECT consumer AS id, count(*) AS u FROM dep@ GROUP BY 1) USING (id) LEFT JOIN (SELECT provider AS id, count(*) AS d FROM dep@ GROUP BY 1) USING (id)"""
PIECES["inz@"] = "SELECT e.src AS id, min(e.conf) AS zconf FROM le@ e JOIN ln@ z ON z.id = e.dst AND z.pubzone WHERE e.type = 'IN_ZONE' GROUP BY 1"
PIECES["seed@"] = """
SELECT n.id, least(n.conf, z.zconf) AS conf, z.zconf IS NOT NULL AS in_zone FROM ln@ n LEFT JOIN inz@ z ON z.id = n.id
WHERE n.type = 'ASSET' AND (n.public_flag OR z.zconf IS NOT NULL)"""
PIECES["hop@"] = """
SELECT id, conf, via FROM (
  SELECT h.id, least(s.conf, h.econf) AS conf, h.eid AS via, row_number() OVER (PARTITION BY h.id ORDER BY s.id, h.way, h.eid) AS rn
  FROM (SELECT src AS seed, dst AS id, 0 AS way, id AS eid, conf AS econf FROM le@ WHERE type = 'CONNECTS_TO'
        UNION ALL SELECT dst, src, 1, id, conf FROM le@ WHERE type = 'CONNECTS_TO') h
  JOIN seed@ s ON s.id = h.seed JOIN ln@ n ON n.id = h.id AND n.type = 'ASSET' WHERE h.id NOT IN (SELECT id FROM seed@)
) WHERE rn = 1"""
PIECES["reach@"] = "SELECT id, false AS inferred, conf, in_zone, NULL::VARCHAR AS via FROM seed@ UNION ALL SELECT id, true, conf, false, via FROM hop@"
PIECES["host@"] = """
SELECT id, eid, host, inferred, hconf FROM (
  SELECT e.dst AS id, e.id AS eid, e.src AS host, r.inferred, r.conf AS hconf, row_number() OVER (PARTITION BY e.dst ORDER BY e.id) AS rn
  FROM le@ e JOIN reach@ r ON r.id = e.src WHERE e.type = 'HOSTS') WHERE rn = 1"""
PIECES["base@"] = """
SELECT id, 'PUBLIC_ZONE_ASSET' AS ft, conf, false AS inferred FROM reach@ WHERE in_zone
UNION ALL SELECT id, 'EXTERNALLY_REACHABLE_ASSET', conf, inferred FROM reach@
UNION ALL SELECT n.id, 'INTERNET_FACING_SERVICE', least(h.hconf, n.conf), h.inferred FROM ln@ n JOIN host@ h ON h.id = n.id WHERE n.type = 'SERVICE'
UNION ALL SELECT n.id, 'EXPOSED_DATASTORE', n.conf, coalesce(h.inferred, false) FROM ln@ n LEFT JOIN host@ h ON h.id = n.id LEFT JOIN inz@ z ON z.id = n.id
  WHERE n.type = 'DATASTORE' AND (h.id IS NOT NULL OR z.id IS NOT NULL OR n.public_flag)"""
PIECES["ef@"] = """
SELECT id, ft, format('{:.6f}', conf)::DOUBLE AS conf, CASE WHEN conf >= 0.8 AND NOT inferred THEN 'VERIFIED' WHEN conf >= 0.5 THEN 'PARTIALLY_VERIFIED' ELSE 'THEORETICAL' END AS vs FROM (
  SELECT * FROM base@
  UNION ALL SELECT e.id, 'ZONE_BOUNDARY_CROSSING', e.conf, false FROM le@ e WHERE e.type IN ('CONNECTS_TO', 'DEPENDS_ON') AND (e.src IN (SELECT id FROM inz@)) <> (e.dst IN (SELECT id FROM inz@))
  UNION ALL SELECT n.id, 'HIGH_CONNECTIVITY_EXPOSED', n.conf, false FROM ln@ n JOIN deg@ d ON d.id = n.id WHERE d.degree >= 3 AND n.id IN (SELECT id FROM base@))"""
PIECES["fac@"] = """
SELECT n.id, n.type, n.name, n.conf, least(1.0::DOUBLE, greatest(0.0::DOUBLE, n.importance)) AS f1, least(1.0::DOUBLE, dc.total / 10.0::DOUBLE) AS f2, coalesce(m.x, 0.0::DOUBLE) AS f3,
  least(1.0::DOUBLE, coalesce(d.degree, 0) / 10.0::DOUBLE) AS f4, least(1.0::DOUBLE, (n.changes - 1) / 5.0::DOUBLE) AS f5, coalesce(d.degree, 0) AS degree, dc.up, dc.down
FROM ln@ n JOIN dc@ dc ON dc.id = n.id LEFT JOIN deg@ d ON d.id = n.id LEFT JOIN (SELECT id, max(conf) AS x FROM ef@ GROUP BY 1) m ON m.id = n.id"""
PIECES["sc@"] = """
SELECT *, CASE WHEN risk <= 25 THEN 'LOW' WHEN risk <= 50 THEN 'MEDIUM' WHEN risk <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM (
  SELECT *, round_even(least(100.0::DOUBLE, 100.0::DOUBLE * (f3 * (crit / 100.0::DOUBLE) * conf) * lift), 0)::INTEGER AS risk FROM (
    SELECT *, 1.0::DOUBLE + least(0.5::DOUBLE, f5 * 0.5::DOUBLE) AS lift,
      round_even(100 * (0.3::DOUBLE * f1 + 0.25::DOUBLE * f2 + 0.2::DOUBLE * f3 + 0.15::DOUBLE * f4 + 0.1::DOUBLE * f5), 0)::INTEGER AS crit FROM fac@))"""
PIECES["sens@"] = """
SELECT id, CASE WHEN sens = 'pci' THEN 'Restricted' WHEN sens = 'pii' THEN 'Confidential' WHEN sens = 'internal' THEN 'Internal' WHEN sens = 'open' THEN 'Public'
  WHEN type = 'DATASTORE' AND name LIKE '%-customer' THEN 'Restricted' WHEN type = 'DATASTORE' AND name LIKE '%-log' THEN 'Internal' WHEN type = 'DATASTORE' THEN 'Confidential'
  WHEN type = 'SERVICE' AND name LIKE '%-payment' THEN 'Confidential' WHEN type = 'SERVICE' THEN 'Internal' ELSE 'Unknown' END AS level,
 CASE WHEN sens <> '' THEN 1.0 WHEN type = 'DATASTORE' AND name LIKE '%-customer' THEN 0.8 WHEN type = 'DATASTORE' AND name LIKE '%-log' THEN 0.7 WHEN type = 'DATASTORE' THEN 0.5
  WHEN type = 'SERVICE' AND name LIKE '%-payment' THEN 0.7 WHEN type = 'SERVICE' THEN 0.4 ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN sens <> '' THEN 'tag' WHEN type = 'DATASTORE' AND (name LIKE '%-customer' OR name LIKE '%-log') THEN 'name' WHEN type = 'DATASTORE' THEN 'type'
  WHEN type = 'SERVICE' AND name LIKE '%-payment' THEN 'name' WHEN type = 'SERVICE' THEN 'default' ELSE 'none' END AS evidence_kind,
 CASE WHEN sens <> '' THEN 'Explicit tag: ' || sens WHEN type = 'DATASTORE' AND name LIKE '%-customer' THEN 'Name implies sensitive data: ' || name
  WHEN type = 'DATASTORE' AND name LIKE '%-log' THEN 'Name implies internal data: ' || name WHEN type = 'DATASTORE' THEN 'Datastores default to Confidential'
  WHEN type = 'SERVICE' AND name LIKE '%-payment' THEN 'Service name implies sensitive handling: ' || name WHEN type = 'SERVICE' THEN 'Default service classification' END AS evidence
FROM ln@"""
PIECES["own@"] = """
SELECT n.id, coalesce(n.team, t.v) AS team, coalesce(n.tech, k.v) AS technical, coalesce(n.biz, b.v) AS business FROM ln@ n
LEFT JOIN (SELECT provider, first(team ORDER BY consumer) AS v FROM dep@ JOIN ln@ ON id = consumer WHERE team IS NOT NULL GROUP BY 1) t ON t.provider = n.id
LEFT JOIN (SELECT provider, first(tech ORDER BY consumer) AS v FROM dep@ JOIN ln@ ON id = consumer WHERE tech IS NOT NULL GROUP BY 1) k ON k.provider = n.id
LEFT JOIN (SELECT provider, first(biz ORDER BY consumer) AS v FROM dep@ JOIN ln@ ON id = consumer WHERE biz IS NOT NULL GROUP BY 1) b ON b.provider = n.id"""
PIECES["env@"] = """
SELECT id, CASE WHEN env <> '' THEN env WHEN name LIKE '%-prod%' THEN 'Production' WHEN name LIKE '%-dev%' THEN 'Development' ELSE 'Unknown' END AS environment FROM ln@"""
PIECES["asm@"] = """
SELECT *, CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS level FROM (
  SELECT n.id, n.type, n.name, n.vf, n.store, n.inet_asset OR n.inet_service AS inet, s.degree, s.up, s.down, s.crit, s.risk, s.band, e.environment, v.level AS sensitivity, o.team, o.technical, o.business,
    coalesce(o.team, o.technical, o.business) IS NOT NULL AS owned,
    CASE WHEN s.degree > 10 THEN 20 WHEN s.degree > 3 THEN 10 ELSE 0 END + CASE WHEN s.down > 5 THEN 30 WHEN s.down > 0 THEN 15 ELSE 0 END + CASE WHEN n.inet_asset OR n.inet_service THEN 25 ELSE 0 END
    + CASE WHEN n.store THEN 40 ELSE 0 END + CASE v.level WHEN 'Restricted' THEN 40 WHEN 'Confidential' THEN 25 ELSE 0 END AS score,
    concat_ws('; ', CASE WHEN s.degree > 10 THEN 'High connectivity (degree: ' || s.degree || ')' WHEN s.degree > 3 THEN 'Moderate connectivity (degree: ' || s.degree || ')' END,
      CASE WHEN s.down > 5 THEN 'High downstream dependency (' || s.down || ' assets depend on this)' WHEN s.down > 0 THEN 'Provides services to ' || s.down || ' downstream assets' END,
      CASE WHEN n.inet_asset OR n.inet_service THEN 'Internet accessible' END, CASE WHEN n.store THEN 'Externally exposed datastore' END,
      CASE v.level WHEN 'Restricted' THEN 'Processes or stores Restricted data' WHEN 'Confidential' THEN 'Processes or stores Confidential data' END) AS reasons
  FROM ln@ n JOIN sc@ s ON s.id = n.id JOIN env@ e ON e.id = n.id JOIN sens@ v ON v.id = n.id JOIN own@ o ON o.id = n.id)"""
PIECES["pairs@"] = "SELECT provider AS root, consumer AS node FROM dep@ UNION SELECT p.root, d.consumer FROM pairs@ p JOIN dep@ d ON d.provider = p.node"
PIECES["blast@"] = "SELECT root AS id, count(*) AS total FROM pairs@ GROUP BY 1"
PIECES["pri@"] = """
SELECT a.*, coalesce(b.total, 0) AS blast, a.risk * 0.3::DOUBLE + CASE WHEN a.inet OR a.store THEN 40 ELSE 0 END + a.score * 0.2::DOUBLE + CASE a.sensitivity WHEN 'Restricted' THEN 30 WHEN 'Confidential' THEN 15 ELSE 0 END
  + CASE WHEN coalesce(b.total, 0) > 10 THEN 20 WHEN coalesce(b.total, 0) > 3 THEN 10 ELSE 0 END AS points FROM asm@ a LEFT JOIN blast@ b ON b.id = a.id"""
PIECES["recs@"] = """
SELECT *, CASE WHEN points >= 80 THEN 'CRITICAL' WHEN points >= 50 THEN 'HIGH' WHEN points >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN points >= 80 THEN 4 WHEN points >= 50 THEN 3 WHEN points >= 25 THEN 2 ELSE 1 END AS rank FROM (
  SELECT 'rec-exp-db-' || id AS rid, 1 AS rule, 'EXPOSURE' AS category, 'Exposed Database Detected' AS title, 'Database ' || name || ' is internet reachable.' AS description,
    'Contains ' || sensitivity || ' data; Publicly accessible over the network; Affects ' || blast || ' downstream dependencies' AS reasons, 3 AS actions, 'Restrict inbound traffic to trusted networks only' AS act, id AS node_id, points, team FROM pri@ WHERE store
  UNION ALL SELECT 'rec-own-' || id, 2, 'CRITICAL_ASSET', 'Critical Asset Missing Ownership', 'Highly critical asset ' || name || ' lacks Team, Technical, or Business ownership.',
    'Criticality score is ' || score || '; No direct or inherited ownership tags found; Incident response will be delayed without clear owners', 2, 'Assign a Team or Technical owner via tagging', id, points, team
    FROM pri@ WHERE level IN ('High', 'Critical') AND NOT owned
  UNION ALL SELECT 'rec-id-' || id, 3, 'IDENTITY', 'High Risk Identity Detected', 'Identity ' || name || ' possesses excessive privileges or high risk score.',
    'Base risk score of ' || risk || '; Capable of impacting ' || blast || ' resources', 3, 'Review current IAM policies', id, points, team FROM pri@ WHERE type = 'IDENTITY' AND risk > 70)"""
PIECES["ctl"] = """
SELECT * FROM (VALUES ('PCI DSS', '1.2', 'Restrict connections to untrusted networks', 'Build firewall and router configurations that restrict connections between untrusted networks and any system components in the CDE.', [1]), ('PCI DSS', '7.1', 'Limit access to system components', 'Limit access to system components and cardholder data to only those individuals whose job requires such access.', [2, 3]), ('SOC 2', 'CC6.1', 'Logical Access Security', 'The entity implements logical access security software, infrastructure, and architectures over protected information assets to protect them from security events.', [2, 3]),
  ('SOC 2', 'CC6.6', 'External Threats', 'The entity implements logical access security measures to protect against threats from sources outside its boundaries.', [1]), ('NIST', 'PR.AC-3', 'Remote Access is Managed', 'Remote access is managed.', [1]), ('NIST', 'PR.AC-4', 'Access Permissions', 'Access permissions and authorizations are managed, incorporating the principles of least privilege and separation of duties.', [3])) t(framework, control_id, control_title, control_description, rules)"""
PIECES["fail@"] = """
SELECT c.framework, c.control_id, c.control_title, r.rid, r.rule, r.rank, r.severity, r.node_id, 'Failed due to ' || r.severity || ' risk: ' || r.title AS reason
FROM ctl c JOIN recs@ r ON list_contains(c.rules, r.rule)"""
PIECES["ffail@"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY control_id ORDER BY rank DESC, node_id, rule) AS rn FROM fail@) WHERE rn = 1"
PIECES["comp@"] = """
SELECT f.framework, count(c.control_id) AS controls, count(c.control_id) - count(x.control_id) AS passed, count(x.control_id) AS failed,
  CASE WHEN count(c.control_id) = 0 THEN 100 ELSE floor((count(c.control_id) - count(x.control_id)) * 100.0 / count(c.control_id))::INTEGER END AS score
FROM (VALUES ('CIS'), ('NIST'), ('ISO 27001'), ('SOC 2'), ('PCI DSS')) f(framework) LEFT JOIN ctl c ON c.framework = f.framework LEFT JOIN ffail@ x ON x.control_id = c.control_id GROUP BY 1"""
PIECES["gov@"] = """
SELECT 'gov-own-' || id AS id, 'Unowned Asset Detected' AS title, CASE WHEN environment = 'Production' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'Assign Technical or Team Owner' AS action, id AS target_id, name AS target_name, 'OWNERSHIP_GAP' AS category
FROM asm@ WHERE NOT owned AND type IN ('ASSET', 'DATASTORE', 'SERVICE')
UNION ALL SELECT 'gov-env-' || id, 'Unclassified Asset', 'MEDIUM', 'Tag with valid environment (Prod, Staging, Dev)', id, name, 'CLASSIFICATION_GAP' FROM asm@ WHERE environment = 'Unknown' AND type IN ('ASSET', 'DATASTORE')
UNION ALL SELECT 'gov-sens-' || id, 'Sensitive Data Missing Business Owner', 'CRITICAL', 'Assign Business Owner accountable for data', id, name, 'ACCOUNTABILITY_GAP' FROM asm@ WHERE sensitivity IN ('Restricted', 'Confidential') AND business IS NULL"""
PIECES["elog"] = """
SELECT lpad(event_id::VARCHAR, 12, '0') AS id, 'u_' || user_id AS target, event_type AS kind, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS prov, (event_id % 100) / 100.0::DOUBLE AS conf,
  CASE WHEN value >= 90 THEN 'shadow' ELSE 'default' END AS context, epoch(ts) AS vf, CASE WHEN event_type = 'purchase' THEN epoch(ts) + 864000.0 WHEN event_type = 'view' THEN epoch(ts) + 604800.0 END AS stop FROM events"""
PIECES["eval"] = "SELECT *, row_number() OVER (PARTITION BY context, target ORDER BY prov DESC, conf DESC, vf DESC, id) AS rn, count(*) OVER (PARTITION BY context, target) AS n FROM elog WHERE vf <= {t} AND (stop IS NULL OR {t} < stop)"
PIECES["disc"] = """
SELECT 'e' || lpad(event_id::VARCHAR, 9, '0') AS id, CASE event_type WHEN 'signup' THEN 'IDENTITY_FOUND' WHEN 'error' THEN 'SERVICE_DETECTED' WHEN 'view' THEN 'ASSET_DISCOVERED' ELSE 'RELATIONSHIP_OBSERVED' END AS event_type,
  epoch(ts) AS timestamp, event_type AS source, (event_id % 100) / 100.0::DOUBLE AS confidence, 'ev:' || event_id AS evidence, 'c_' || user_id AS a1, 's_' || floor(value)::INTEGER AS a2, props FROM events"""
# shortest paths from the last supplier to the last part that is depended on: levels forwards, then only edges to the level before backwards
PIECES["walklevel@"] = """
SELECT max(src) AS node, 0 AS depth FROM le@ WHERE type = 'IN_ZONE'
UNION SELECT e.dst, w.depth + 1 FROM walklevel@ w JOIN le@ e ON e.src = w.node WHERE w.depth < 40"""
PIECES["walkdist@"] = "SELECT node, min(depth) AS depth FROM walklevel@ GROUP BY 1"
PIECES["walk@"] = """
SELECT node, depth, [node] AS nodes, []::VARCHAR[] AS path, 1.0::DOUBLE AS weakest FROM walkdist@ WHERE node = (SELECT max(dst) FROM le@ WHERE type = 'DEPENDS_ON')
UNION ALL SELECT d.node, d.depth, list_prepend(d.node, w.nodes), list_prepend(e.id, w.path), least(w.weakest, e.conf)
FROM walk@ w JOIN le@ e ON e.dst = w.node JOIN walkdist@ d ON d.node = e.src AND d.depth = w.depth - 1"""
PIECES["und@"] = "SELECT src AS a, dst AS b FROM le@ UNION SELECT dst, src FROM le@"



_LOOPS = ("pairs", "walk")


def sql(text: str, t: float | None = NOW, times: dict[str, float] | None = None) -> str:
    """Prefix ``text`` with the pieces it names. ``x@`` is a piece at time ``t``; ``x@1`` one at ``times["1"]``."""
    done: dict[str, str] = {}
    recursive = False

    def add(body: str, mark: str, at: float | None) -> str:
        nonlocal recursive

        def use(match: re.Match) -> str:
            nonlocal recursive
            base = match.group(0)
            timed = base.endswith("@")
            name, out = base.rstrip("@"), base.rstrip("@") + (mark if timed else "")
            key = name + "@" if timed else name
            if key in PIECES and out not in done and out not in doing:
                doing.add(out)
                filled = add(PIECES[key], mark, at)
                done[out] = filled
            return out
        return _USES.sub(use, body).replace("{t}", repr(at))

    doing: set[str] = set()
    if times:
        for mark, at in times.items():
            text = re.sub(r"([a-z]+)@" + mark, lambda m, mark=mark, at=at: (add(m.group(1) + "@", f"_{mark}", at)), text)
        body = add(text, "", t)
    else:
        body = add(text, "", t)
    if not done:
        return body
    with_recursive = "RECURSIVE " if any(n.startswith(_LOOPS) for n in done) else ""
    ctes = ", ".join(f"{n} AS {'' if n.startswith(_LOOPS) else 'MATERIALIZED '}({b})" for n, b in done.items())
    return f"WITH {with_recursive}{ctes} {body}"


_USES = re.compile(r"(?<![\w.'])(?:" + "|".join(
    [re.escape(p) for p in PIECES if p.endswith("@")] + [re.escape(p) + r"(?![\w@(.])" for p in PIECES if not p.endswith("@")]) + ")")


def all_sql() -> dict[str, str]:
    from registry.oracle_queries import QUERIES
    return dict(QUERIES)
