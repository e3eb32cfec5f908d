"""The stages against plain versions, on documents with planted cases and with the awkward ones."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidegraph.llm import simhash
from tidegraph.llm.common import prepare

from .test_decontaminate import brute as brute_hits
from .test_packing import check_sequences
from .test_secret_scan import brute as brute_spans
from .test_simhash import brute_components

STAGES = dict(corpus_pipeline.STAGES)
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, found string, digest string, spans int"
SYLLABLES = ["ta", "no", "mi", "re", "lu", "ko", "sa", "ve", "di", "pu"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n)]


def jaccard(a, b):
    def grams(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    texts, toxic, labels = [], set(), []
    for k in range(160):
        w = words(rng, rng.randint(60, 150))
        if k % 4 == 0:
            w += rng.choices(["vilea", "vileb", "vilec"], k=rng.randint(2, 6))
            rng.shuffle(w)
            toxic.add(k)
        texts.append(" ".join(w))
        labels.append((k, None, int(k % 4 == 0)))
    rows = [[k, t] for k, t in enumerate(texts)]
    item = " ".join(words(rng, 30))
    rows.append([200, " ".join(words(rng, 40)) + ". " + item.upper() + ", " + " ".join(words(rng, 40))])
    rows.append([201, " ".join(words(rng, 50)) + ' token = "' + "ab12" * 10 + '" ' + " ".join(words(rng, 50))])
    near = words(rng, 120)
    for k in range(12):  # copies of a base with one word changed
        own = list(near)
        own[10 * k] = f"changed{k}"
        rows.append([300 + k, " ".join(own)])
    rows += [[400 + k, texts[1]] for k in range(20)] + [[500, texts[2] + "  "], [501, None], [502, ""], [None, texts[3]], [None, "null id " + " ".join(words(rng, 30))]]
    rows += [[600, "same row " + " ".join(words(rng, 30))]] * 3 + [[601, "Short."], [602, "word " * 6000]]
    full = [(i, t, "en", f"s{n % 3}", len(t) if t is not None else None, "f", "d", n) for n, (i, t) in enumerate(rows)]
    return full, toxic, labels, [(1, item), (2, "zz"), (None, texts[5]), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    prepare(spark)
    docs, _, labels, items = corpus
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(docs, SHAPE).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_toxicity_removes_what_it_rejects(spark, corpus, folder):
    docs, toxic, _, _ = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["toxicity"](spark, df, folder)
    assert out.schema == df.schema
    assert Counter(map(tuple, out.collect())) == Counter(d for d in docs if d[0] not in toxic)


def stays(docs):
    """One document of each group: the smallest id, null last."""
    texts = sorted({d[1] or "" for d in docs})
    near = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if jaccard(a, b) >= 0.8]
    root = brute_components(texts, near)
    best = {}
    for d in docs:
        r = root[d[1] or ""]
        if r not in best or (d[0] is None, d[0] or 0) < (best[r][0] is None, best[r][0] or 0):
            best[r] = d
    return best, root


def test_one_near_copy_stays(spark, corpus, folder):
    docs, *_ = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["near_duplicates"](spark, df, folder)
    assert out.schema == df.schema
    rows, (best, root) = out.collect(), stays(docs)
    assert Counter(root[r.text or ""] for r in rows) == Counter(best.keys())
    assert sorted((r.doc_id for r in rows), key=str) == sorted((d[0] for d in best.values()), key=str)
    assert STAGES["near_duplicates"](spark, df.limit(0), folder).collect() == []


def test_similar_groups_against_all_pairs(spark):
    prepare(spark)
    rng = random.Random(3)
    texts = ["", "one two", "One two", "a b c d e f"]
    for _ in range(12):
        base = words(rng, rng.randint(30, 200))
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = "".join(words(rng, 1)) + "x"
            texts.append(" ".join(own))
    texts = sorted(set(texts))
    values = {(a, b): jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i]}
    df = spark.createDataFrame([(t,) for t in texts + texts[:9]], "text string").withColumn("digest", F.sha2("text", 256))
    digest = {r.text: r.digest for r in df.collect()}
    for counters in (simhash.COUNTERS, 1 << 6):  # how common shingles are must not matter
        found = {r.digest: r.component for r in simhash.similar_groups(df, 0.8, counters=counters).collect()}
        assert len(found) == len(texts)
        sure = brute_components(texts, [p for p, j in values.items() if j >= 0.85])
        most = brute_components(texts, [p for p, j in values.items() if j >= 0.8])
        for a in texts:
            for b in texts:
                together = found[digest[a]] == found[digest[b]]
                assert together or sure[a] != sure[b]
                assert not together or most[a] == most[b]


def components_found(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("digest", F.sha2("text", 256))
    digest = {r.text: r.digest for r in df.collect()}
    found = {r.digest: r.component for r in simhash.similar_groups(df, 0.8).collect()}
    return {t: found[digest[t]] for t in texts}


def as_groups(label):
    out = {}
    for t, c in label.items():
        out.setdefault(c, set()).add(t)
    return sorted(map(sorted, out.values()))


def test_no_pair_is_lost_among_texts_with_a_passage(spark):
    """All share most of their words; those of 0.8 are few, and lie among many of about 0.65."""
    prepare(spark)
    rng = random.Random(8)
    base, texts = words(rng, 100), set()
    while len(texts) < 400:
        own = list(base)
        for k in rng.sample(range(10, 90), 2):
            own[k] = f"change{k}x{rng.randrange(8)}"
        texts.add(" ".join(own))
    texts = sorted(texts)
    want = brute_components(texts, [(a, b) for i, a in enumerate(texts) for b in texts[:i] if jaccard(a, b) >= 0.8])
    assert 10 < len(set(want.values())) < 390
    assert as_groups(components_found(spark, texts)) == as_groups(want)


def test_short_texts_with_a_word_more(spark):
    """Four of five shingles are shared: a similarity of 0.8."""
    prepare(spark)
    rng = random.Random(9)
    pairs = [words(rng, 9) for _ in range(120)]
    found = components_found(spark, [" ".join(w[:n]) for w in pairs for n in (8, 9)])
    assert all(found[" ".join(w[:8])] == found[" ".join(w)] for w in pairs)
    assert len(set(found.values())) == len(pairs)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shared, n, m = (int(x) for x in rng.integers(0, 400, 3))
        h = np.unique(rng.integers(0, 2**64, shared + n + m, dtype=np.uint64))
        x, y = np.sort(h[:shared + n]), np.sort(np.concatenate([h[:shared], h[shared + n:]]))
        own = len(np.setxor1d(x, y))
        assert simhash.difference(simhash.parities(x), simhash.parities(y)) <= own
        assert simhash.difference(simhash.parities(x), simhash.parities(x)) == 0
    x, y = (np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64)) for _ in range(2))
    assert simhash.difference(simhash.parities(x), simhash.parities(y)) > 600


def test_fingerprint_and_overlap():
    assert simhash.fingerprint("x y z", 2) % 2**64 == sum(1 << b for b in range(64) if all(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in (b"x y", b"y z")))
    assert simhash.overlap(b"", b"") == 1.0 and simhash.overlap(b"", b"aaaa") == 0.0


def test_benchmark_passages_go(spark, corpus, folder):
    docs, _, _, items = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["decontamination"](spark, df, folder)
    assert out.schema == df.schema
    hit = brute_hits([(d, d[1]) for d in docs], items, 10)
    assert Counter(map(tuple, out.collect())) == Counter(d for d, _, n, _ in hit if not n)


def test_secrets_are_replaced(spark, corpus, folder):
    docs, *_ = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["secrets"](spark, df, folder)
    assert out.schema == df.schema
    want = Counter()
    for d in docs:
        if brute_spans(d[1]):
            start, end = min(int(s.split(":")[1]) for s in brute_spans(d[1])), max(int(s.split(":")[2]) for s in brute_spans(d[1]))
            text = d[1][:start] + "[secret]" + d[1][end:]
            d = (d[0], text, *d[2:4], len(text), *d[5:])
        want[d] += 1
    assert Counter(map(tuple, out.collect())) == want


def test_whole_run(spark, corpus, folder):
    docs, toxic, _, items = corpus
    left = list(stays([d for d in docs if d[0] not in toxic])[0].values())
    left = [d for d, _, n, _ in brute_hits([(d, d[1]) for d in left], items, 10) if not n]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id for r in rows if r.piece == 0), key=str) == sorted((d[0] for d in left), key=str)
    n = check_sequences(rows, 1024)
    assert n <= sum(r.length for r in rows) / 1024 * 1.1 + 2
    by = {}
    for r in rows:
        if r.doc_id is not None:
            by.setdefault(r.doc_id, []).append((r.start, r.length))
    for own in by.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length


def test_empty_tables(spark, folder, tmp_path):
    for name, shape in (("documents", SHAPE), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
