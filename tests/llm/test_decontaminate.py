import os
import random
import re
import time
import uuid

import duckdb
import numpy as np
import pytest

from tidegraph.llm import decontaminate
from tidegraph.llm.common import prepare
from tidegraph.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(len(b), window)
            grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted((str(i) for i in found if i is not None)) + [None] * (None in found)))
    return out


def test_words_of_hard_texts(monkeypatch):
    texts = ["Ab c", "", "x", "y z", "É  ß-ñ 1a", "\n", "日本 é", "w" * 50, " end"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for piece in (1 << 20, 16):
        monkeypatch.setattr(decontaminate, "_PIECE", piece)
        got = decontaminate.words_of(np.frombuffer(raw, np.uint8), offsets)
        listed = [[got.bytes_of(k, 1).decode() for k in range(a, b)] for a, b in zip(got.first, got.first[1:])]
        assert listed == [words(t) for t in texts]
        flat = [w for t in listed for w in t]
        assert len(set(got.hash.tolist())) == len(set(flat)) and got.hash[flat.index("ab")] == decontaminate.words_of(np.frombuffer(b"-aB", np.uint8), np.array([0, 3])).hash[0]


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 20])
def test_against_all_windows(spark, block_words):
    prepare(spark)
    rng = random.Random(7)
    vocabulary = ["a", "B", "c1", "é", "D", "e"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 6, 9])))) for k in range(100, 112)]
    items += [(100, "zz yy"), (7, None), (8, "..."), (None, "a a"), (9, "zz yy"), (9, "zz yy")]
    docs = [(k, "; ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 30, 60])))) for k in range(40)]
    docs += [(None, "zz yy"), (3, None), (3, ""), (5, "ZZ-yy zz"), (5, "ZZ-yy zz"), (6, "a " * 30_000)]
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, items int, spans string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(left, right, window=5, block_words=block_words).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str) == sorted(brute(docs, items, 5), key=str)
    assert all(r.n_hit == sum(r.spans[1::2]) - sum(r.spans[::2]) for r in got)


def test_empty_tables(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, none).collect()] == [(1, 3, 0, [], [])]
    some = spark.createDataFrame([(4, "b c")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), some).collect() == []
    kept = decontaminate.contamination(docs.selectExpr("*", "'k' AS source"), some, keep=("source",)).first()
    assert (kept.source, kept.n_hit, list(kept["items"]), list(kept.spans)) == ("k", 2, ["4"], [1, 3])
    named = spark.createDataFrame([("x-1", "b c"), (None, "a b"), (None, "a b")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, named).collect()] == [(1, 3, 3, ["x-1", None], [0, 3])]


def test_query_and_its_sql_agree_on_null_ids(spark, tmp_path):
    prepare(spark)
    rng = random.Random(5)
    passages = [" ".join(rng.choices(["a", "b", "c", "d"], k=14)) for _ in range(4)]
    docs = [(k, f"x {rng.choice(passages)} y" if k % 2 else "nothing here") for k in range(20)] + [(49, passages[1]), (50, None), (51, "")]
    items = [(1, passages[0]), (None, passages[1]), (None, passages[2]), (2, passages[2]), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = base.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op10_benchmark_windows']})").fetchall()
    got = QUERIES["op10_benchmark_windows"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got if r.doc_id == 49] == [(14, 1, True)]


def test_pieces_have_the_windows_of_the_text():
    text = " ".join(f"W{k % 7}" for k in range(50))
    whole = [tuple(words(text)[k:k + 5]) for k in range(46)]
    for most in (1, 7, 45, 46, 100):
        parts = decontaminate.pieces(text, 5, most)
        assert [tuple(words(t)[k:k + 5]) for _, t in parts for k in range(len(words(t)) - 4)] == whole
        assert all(n == len(words(t)) <= most + 4 for n, t in parts)
    assert decontaminate.pieces("a b", 5, 1) == [(2, "a b")] and decontaminate.pieces(None, 5, 1) == []


def test_many_blocks_one_at_a_time(spark, monkeypatch):
    """A benchmark of fifty times the block size: bounded blocks, and only the last one in the plan."""
    prepare(spark)
    items = [(k, " ".join(f"x{k}y{j}" for j in range(20))) for k in range(4)] + [(9, " ".join(f"z{j}" for j in range(120)))]
    docs = spark.createDataFrame([(k, f"a {items[k % 5][1]} b") for k in range(10)], "doc_id long, text string")
    sizes, make = [], decontaminate.make_block
    monkeypatch.setattr(decontaminate, "make_block", lambda rows, window: sizes.append(sum(len(words(t)) for _, t in rows)) or make(rows, window))
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), window=4, block_words=24)
    assert len(sizes) > 8 and max(sizes) <= 24 + 3 + 4
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.n_hit, list(r["items"])) for r in found.collect()) == [(k, len(words(items[k % 5][1])), [str(items[k % 5][0])]) for k in range(10)]


def test_reads_items_after_their_query_has_ended(spark, tmp_path):
    """Items are read partition by partition, later than Spark takes the query for done: the shuffle before must not be lost and run again."""
    prepare(spark)

    def seen(batches):
        for pdf in batches:
            for item in pdf["item_id"]:
                open(f"{tmp_path}/{item}-{uuid.uuid4().hex}", "w").close()
            yield pdf
    items = [(f"i{k}", f"one two three {k}") for k in range(30)]
    shape = "item_id string, text string"
    benchmark = spark.createDataFrame(items, shape).coalesce(1).mapInPandas(seen, shape).repartition(20, "item_id")
    found = []
    for block in decontaminate._blocks(benchmark, "item_id", "text", 10, 4):
        found += block.texts
        time.sleep(0.2)
    assert len(found) == 30 and len(os.listdir(tmp_path)) == 30
