import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegraph.llm import token_counts, token_shards, tokenization
from tidegraph.llm.common import own_folder, prepare
from tidegraph.llm.token_counts import Merges
from tidegraph.llm.tokenization import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
HARD = ["a<|endoftext|>b<|endoftext|><|endoftext|>", "ẞ ﬁ ́e", "  \n\n x y\x1cz", "İSTANBUL", "日本語 text", "", None, "a\r\n\tb   ", "x" * 3000, "aaaaaaa aaa!!!!!!!!! ===== \n\n\n\n", "one two " * 500]


def test_merging_counts_as_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(0)
    texts = HARD + ["".join(rng.choices("aaab \nAz09é日\u0085  \x1c'st.,!=-", k=60)) for _ in range(400)]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert Merges(path).count_all(texts) == want
    monkeypatch.setattr(token_counts, "AT_ONCE", 11)
    monkeypatch.setattr(token_counts, "SYMBOLS", 64)
    small = Merges(path, kept=9)
    assert small.count_all(texts) == want and [small.count(t) for t in texts] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_all_plain_characters(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), Encoder(path)
    rng = random.Random(11)
    every = [chr(c) for a, z in tokenization._RANGES for c in range(a, z + 1)]
    texts = every + [f"{c}b" for c in every] + [f"a{c} {c}{c}" for c in every] + ["".join(rng.choices(every, k=40)) for _ in range(1500)]
    plain = "".join(c for c in every if tokenization.PLAIN.fullmatch(c))
    texts += ["".join(rng.choices(plain, k=40)) for _ in range(1500)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want.ids, text


def test_read_needs_the_index():
    keys = np.array([3, 3, 9, 12], "<i8")
    index = token_shards.Index.build(keys, np.zeros(4, bool), np.array([0, 5, 6, 9, 11], "<i8"))
    again = token_shards.Index.from_bytes(index.to_bytes())
    assert [x.tolist() for x in again.find(np.array([12, 3, 9, 4]))] == [[3, 0, 2, again.find(np.array([4]))[0][0]], [1, 2, 1, 0]]
    assert not {"keys", "null"} & set(again.arrays)


def test_counts_of_a_table(spark):
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "é b", 5), (None, None, 6), (1, "é b", 5), (2, "", 7), (2**60 + 1, "a " * 3000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.with_token_counts(docs, path, 1024).collect()
    library = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 1024) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.with_token_counts(docs.limit(0), path).collect() == []
    with pytest.raises(ValueError):
        Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 1000, 50_000):
        keys = np.unique(rng.integers(-2**63, 2**63 - 1, n))
        made = token_shards.PerfectHash.build(keys)
        assert sorted(made.find(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_shards.PerfectHash.build(np.array([3, 3]))


@pytest.mark.parametrize("shards", [1, 7])
def test_shards_round_trip(spark, shards):
    prepare(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = [(rng.randint(-50, 50), rng.choice(HARD), 1) for _ in range(120)] + [(None, "no key", 2), (None, None, 2), (2**62, "Far away", 3)] + [(7, f"copy {k}", 4) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    store = token_shards.write(docs, own_folder(spark, "test_shards"), path, 1, shards=shards)
    got = sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in token_shards.read(spark, store).collect())
    coded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows]
    assert sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in coded), key=str) == sorted((g[1:] for g in got), key=str)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    keys = [k for _, k, _, _ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    asked = spark.createDataFrame([(k,) for k in [7, 7, 2**62, 12345, None, *range(-50, 0)]], "k long")
    found = sorted((r.key, list(r.ids)) for r in token_shards.fetch(asked, store, "k").collect())
    assert found == sorted((i, x) for i, x in coded if i is not None and (i in (7, 2**62) or i < 0))


def test_store_without_documents(spark):
    prepare(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    store = token_shards.write(docs, own_folder(spark, "test_shards"), public_tokenizers.path("word_bpe_49k.json"), 1)
    assert token_shards.read(spark, store).collect() == []
    assert token_shards.fetch(spark.createDataFrame([(1,)], "k long"), store, "k").collect() == []
