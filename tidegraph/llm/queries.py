"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegraph.llm import (
    decontaminate, embedding_dedup, filter_audit, language, packing, secret_scan, simhash, token_counts, token_shards, toxicity, url_templates, vector_codes, warc,
)
from tidegraph.llm.common import own_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ordinal_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.learn_from(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, model, ["doc_id"])


@query
def op2_string_kernel_language(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.learn(docs.where(~held_out).select("text", "lang"))
    return language.identified(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_perfect_hash_shards(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    store = token_shards.write(table(spark, folder, "documents"), own_folder(spark, "token_shards"), path, end_id=1)
    return token_shards.read(spark, store).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op4_collision_counting(spark, folder):
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"), cosine=0.93)


ORACLE["op4_collision_counting"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
walk(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.vec_id, l.b FROM walk w JOIN links l ON w.other = l.a),
component AS (SELECT vec_id, min(other) AS component_id FROM walk GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN degree USING (vec_id)
"""


@query
def op5_simhash_groups(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"), width=4, half=2)
    return found.select("doc_id", simhash.hex_of("fingerprint").alias("fingerprint"), "component_id")


@query
def op6_warc_salvage(spark, folder):
    found = warc.archived(spark, table(spark, folder, "pages"), own_folder(spark, "warc")).where(F.col("reason").isNull())
    return found.select(F.col("key").try_cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


ORACLE["op6_warc_salvage"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest, payload_bytes)
"""


@query
def op7_minimum_bin_slack(spark, folder):
    docs = table(spark, folder, "documents")
    pieces = packing.encoded_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.packed(pieces, 1024).withColumnRenamed("id", "doc_id")


@query
def op8_markov_secrets(spark, folder):
    found = secret_scan.secrets(table(spark, folder, "documents"), ["doc_id"])
    counts = [secret_scan.of_kind("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed("base").cast("binary"), 256).alias("base_sha256"), secret_scan.listed("spans").alias("spans"))


@query
def op9_rank_synchronous_counts(spark, folder):
    return token_counts.with_token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_benchmark_windows(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    names = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op10_benchmark_windows"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op11_dual_tree_codes(spark, folder):
    found, books = vector_codes.compressed(table(spark, folder, "embeddings"), parts=8, entries=16, rounds=6)
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """The same rounds, each by the distances of all parts to all entries."""
    steps = [f"""
WITH ok AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS MATERIALIZED (SELECT r, part, [CAST(floor(4096 * x) AS HUGEINT) FOR x IN e[part * (len(e) // {parts}) + 1:(part + 1) * (len(e) // {parts})]] AS v FROM ok, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS k, v FROM p WHERE r <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'k': k}}) AS near FROM (
  SELECT p.r, p.part, k, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.v, b{n}.v)]) AS d FROM p JOIN b{n} USING (part)) GROUP BY ALL)""")
        if n < rounds:
            steps.append(f"""
b{n + 1} AS MATERIALIZED (SELECT part, k, coalesce(m.v, b{n}.v) AS v FROM b{n} LEFT JOIN (
  SELECT part, k, list(f ORDER BY i) AS v FROM (
    SELECT part, near.k AS k, i, CAST(floor(sum(v[i]) / count(*)) AS HUGEINT) AS f FROM a{n} JOIN p USING (r, part), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL
  ) GROUP BY ALL) m USING (part, k))""")
    return ",".join(steps) + f""",
c AS (SELECT r, string_agg(printf('%02x', CAST(near.k AS INT)), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM ok JOIN c USING (r), h
"""


ORACLE["op11_dual_tree_codes"] = _codes_sql(8, 16, 6)


@query
def op12_path_templates(spark, folder):
    rules = [
        url_templates.Rule("allow", "com", "/"), url_templates.Rule("block", "example.com", "/en/"), url_templates.Rule("allow", "www.example.com", "/en/"),
        url_templates.Rule("block", "net", "/es/"), url_templates.Rule("block", "net", "/fr/"),
    ]
    return url_templates.judged(table(spark, folder, "pages"), rules, ["page_id"])


@query
def op13_filter_audit(spark, folder):
    cells = filter_audit.mask_cells(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return filter_audit.audited(cells, "ABCDE")


ORACLE["op13_filter_audit"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS s FROM documents),
w AS (SELECT doc_id, part, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY s) AS first FROM t),
d AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 3 * length(s),
    regexp_matches(s, '[#$%&*|]'), coalesce(first < doc_id, first IS NOT NULL)] AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic FROM w),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
steps AS (SELECT o AS filter_order, step, ascii(o[step]) - 64 AS f, [ascii(x) - 64 FOR x IN string_split(o[1:step - 1], '') IF x <> ''] AS before FROM orders, range(1, 6) r(step) WHERE length(o) = 5),
m AS (SELECT part, filter_order, step, f, fails[f] AS here, len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS single, n, good, toxic FROM c, steps),
g AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (here AND single), 0) AS unique_fails,
  coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""
