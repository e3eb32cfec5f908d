import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegraph.llm import packing
from tidegraph.llm.common import prepare
from tidegraph.llm.tokenization import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
HARD = ["a<|endoftext|>b", "ẞ ﬁ ́e", "  \n\n x y\x1cz", "İSTANBUL ŉ ǅ", "日本語 text", "'S it'll I'M 123 4x5", "", None, "a\r\n\tb   ", "<|startoftext|>", "x" * 3000, "Été\xa0là", "one two " * 700]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name, monkeypatch):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in HARD]
    assert [Encoder(path).ids(t) for t in HARD] == want
    monkeypatch.setattr("tidegraph.llm.tokenization.AT_ONCE", 7)
    assert [Encoder(path, kept=5).ids(t) for t in HARD] == want


def test_fullest_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
        uses = packing.fullest(counts, 40)
        assert all(k <= counts[n] for n, k in uses.items()) and max(counts) in uses
        sums = {max(counts)}
        for n, c in counts.items():
            for _ in range(c - (n == max(counts))):
                sums |= {s + n for s in sums}
        assert sum(n * k for n, k in uses.items()) == max(s for s in sums if s <= 40)


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_documents_are_packed_whole(spark):
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i if i % 5 else None, t, "offset") for i, t in enumerate(HARD * 6)] + [(2**60 + 1, "copy", "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(5)
    got = packing.packed(packing.encoded_pieces(docs, path, 2, 64), 64).collect()
    library = Tokenizer.from_file(path)
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    n = check_sequences(got, 64)
    assert n <= sum(r.length for r in got) / 64 * 1.05 + 1
    assert packing.packed(packing.encoded_pieces(docs.limit(0), path, 2, 64), 64).collect() == []
