import random
from collections import Counter

import numpy as np

from tidegraph.llm import toxicity as tx
from tidegraph.llm.common import prepare


def test_words_of_long_texts(monkeypatch):
    text = "Ab cd'ef Éa1b " * 50 + "x" * 300
    whole = tx.words_of(text)
    monkeypatch.setattr(tx, "_PIECE", 7)
    assert tx.words_of(text) == whole and whole["éa"] == 50 and tx.words_of(None) == Counter()


def test_fit_finds_the_maximum():
    """One feature with values 0..5 and grades from a known model: the gradient is zero at the result, thresholds are in order."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 4000)
    latent = 1.5 * x + rng.logistic(size=4000)
    grade = (latent[:, None] > np.array([2.0, 4.0, 6.0])).sum(1)
    w, t = tx.fit(np.arange(4000), np.zeros(4000, int), x.astype(float), grade, 1, 4, steps=3000, decay=0.0)

    def loss(w, t):
        p = 1 / (1 + np.exp(t[None, :] - w * x[:, None]))
        e = np.concatenate([np.ones((4000, 1)), p, np.zeros((4000, 1))], 1)
        weight = (1 / np.bincount(grade))[grade]
        return -(weight * np.log(e[np.arange(4000), grade] - e[np.arange(4000), grade + 1])).sum()
    best = loss(w[0], t)
    assert (np.diff(t) > 0).all() and 1.2 < w[0] < 1.8
    for d in (-0.05, 0.05):
        assert loss(w[0] + d, t) > best
        for k in range(3):
            assert loss(w[0], t + d * (np.arange(3) == k)) > best


def corpus(rng, n, start=0):
    clean = ["good", "house", "tree", "river", "walk", "green", "paper", "table"]
    bad = ["vilea", "vileb", "vilec"]
    docs, labels = [], []
    for k in range(start, start + n):
        toxic = rng.random() < 0.3
        words = rng.choices(clean, k=rng.randint(5, 40)) + (rng.choices(bad, k=rng.choice([1, 3, 9])) if toxic else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words) + f" nr{rng.randint(0, 10**9)}x", "s"))
        labels.append((k, int(toxic)))
    return docs, labels


def test_learns_scores_and_orders(spark):
    prepare(spark)
    rng = random.Random(5)
    docs, labels = corpus(rng, 400)
    labels += [(1, None), (None, 1), (10**6, 1), labels[0]]
    shape = "doc_id long, text string, severity string"
    model = tx.learn_from(spark.createDataFrame(docs, shape), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    fresh, truth = corpus(rng, 300, 1000)
    extra = [(1, None, "s"), (2, "", "s"), (None, "vilea", "s"), (3, "Vilea vileb " * 60_000, "s"), (3, "good house", "s"), (3, "good house", "s")]
    got = tx.scored(spark.createDataFrame(fresh + extra, shape), model, ["doc_id", "text"]).collect()
    assert len(got) == len(fresh) + len(extra)
    known = dict(truth)
    for r in got:
        assert 0 <= r.severity <= 3 and r.toxic == (r.grade > 0)
        if r.doc_id in known:
            assert r.toxic == bool(known[r.doc_id])
    by_words = {n: np.mean([r.severity for r in got if sum(w.startswith("vile") for w in (r.text or "").split()) == n]) for n in (0, 1, 3, 9)}
    assert by_words[0] < by_words[1] < by_words[3] < by_words[9]
    assert tx.scored(spark.createDataFrame([], shape), model, ["doc_id"]).collect() == []


def test_without_toxic_labels(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = tx.learn_from(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert [(r.severity < 1e-9, r.toxic) for r in tx.scored(docs, model, ["doc_id"]).collect()] == [(True, False)] * 2
    model = tx.learn_from(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r.toxic for r in tx.scored(docs, model, ["doc_id"]).collect())


def test_near_copies_are_used_once():
    class Row:
        def __init__(self, text):
            self.text, self.signature = text, tx._signature(text)
    base = " ".join(f"w{k}" for k in range(200))
    rows = [Row(base), Row(base + " tail"), Row("quite another text of some words"), Row(None), Row("")]
    assert [r.text for r in tx._once(rows)] == [base, "quite another text of some words", None, ""]


def test_rare_words_count():
    """A hundred toxic words, each in 15 of 2000 toxic documents and most such documents with one of them only; more features than 300."""
    rng = np.random.default_rng(3)
    neutral = [f"w{chr(97 + k % 20)}{chr(97 + k // 20)}" for k in range(400)]
    tail = [f"vile{chr(97 + k // 10)}{chr(97 + k % 10)}x" for k in range(100)]

    def texts(n, bad):
        return [" ".join([*rng.choice(neutral, 15), *([bad[k % len(bad)]] if bad else [])]) for k in range(n)]
    bad, good = texts(1500, tail) + texts(500, ["crude"]), texts(2000, [])
    found = [tx.features_of(tx.words_of(t)) for t in bad + good]
    names = sorted(set().union(*found))
    place = {f: k for k, f in enumerate(names)}
    row, column, count = (np.array(x) for x in zip(*[(r, place[f], n) for r, own in enumerate(found) for f, n in own.items()]))
    model = tx.learn(tx.Sample(names, np.arange(4000) < 2000, row, column, count))
    assert all(w in model.vocabulary for w in tail)

    def caught(some):
        return (model.above(np.array([model.score(t) for t in some]))[:, 0] >= 0.5).mean()
    assert caught(texts(500, tail)) > 0.9 and caught(texts(100, ["crude"])) > 0.9 and caught(texts(500, [])) < 0.1
