import numpy as np
import pytest
import xxhash

from tidegraph.llm import simhash
from tidegraph.llm.common import prepare
from tidegraph.llm.components import connected


def plain_fingerprint(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    pieces = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return label


def test_fingerprint_of_hard_texts():
    for text in (None, "", "  \n", "One", "a b c", "Ärger ÉTÉ\x85x\x1fy z w", "x " * 40_000, "Ab\tcd\x0bef gh " * 9):
        for width in (4, 5):
            assert simhash.fingerprint(text, width) % 2**64 == plain_fingerprint(text, width)


def test_links_are_those_of_all_pairs(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12).tolist()
    values = {0, 2**63 + 5}
    for c in centres:
        values.add(c)
        for _ in range(20):
            values.add(c ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 7))}))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 4]
    want = brute_components(signed, near)
    for at_once, per_task in ((1 << 12, 1 << 12), (1 << 20, 1 << 22)):
        df = spark.createDataFrame([(v,) for v in signed], "v long")
        found = connected(simhash.links(df, "v", per_task=per_task, at_once=at_once))
        got = {r.node: r.component for r in found.collect()}
        assert {v: got.get(v, v) for v in signed} == want


def test_near_duplicates(spark):
    prepare(spark)
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 8
    rows = [(5, base, "x"), (2, base, "y"), (2, base, "y"), (9, base.upper(), None), (7, None, "z"), (8, "", "z"), (None, "alone text here now", "q"), (11, "other words entirely " * 9, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").withColumnRenamed("fingerprint", "value")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (2, 2), (9, 2), (7, 7), (8, 7), (None, None), (11, 11)], key=str)
    assert simhash.near_duplicates(df.limit(0), 4).collect() == []


@pytest.mark.parametrize("n", [2, 40])
def test_components_of_chains(spark, n):
    prepare(spark)
    order = np.random.default_rng(1).permutation(n).tolist()
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (101, 100), (103, 103), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected(links).collect()}
    assert got == {**{k: 0 for k in range(n)}, 100: 100, 101: 100}
    assert connected(links.limit(0)).collect() == []
