import os
import random

import numpy as np
import pytest

from tidegraph.llm import language
from tidegraph.llm.common import prepare
from tidegraph.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["ka", "lo", "mi", "nu", "é"], "bb": ["sch", "ung", "ä", "ber", "ein"], "cc": ["ci", "ón", "lla", "qu", "ez"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_grams_are_all_distinct_n_grams(monkeypatch):
    for piece in (1 << 20, 3):
        monkeypatch.setattr(language, "_PIECE", piece)
        for t in ("Ab, cé1D  ab", "x", "😀 ß" * 5):
            folded = " " + language._OTHER.sub(" ", t.lower()).strip() + " "
            if not folded.strip() or not all(c.isalpha() or c == " " for c in folded):
                continue
            want = {folded[i:i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)}
            code = lambda g: sum((ord(c) + 1) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
            assert sorted(map(code, want)) == language.grams(t).tolist()
    assert not len(language.grams(None)) and not len(language.grams(" 12 ,_")) and not len(language.grams("½½ ² Ⅷ ①"))
    assert language.grams("a½½ b²").tolist() == language.grams("a b").tolist()


def test_equals_plain_kernel_ridge_regression():
    """With all texts as landmarks, the scores are those of ridge regression on the kernel itself."""
    rng = random.Random(8)
    sample = [(lang, language.grams(text(rng, lang, rng.randint(4, 20)))) for lang in SYLLABLES for _ in range(rng.randint(8, 14))]
    model = language.fit(sample, landmarks=len(sample))
    sets = [set(g.tolist()) for _, g in sample]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    languages = sorted(SYLLABLES)
    share = np.array([1 / sum(n == name for n, _ in sample) for name, _ in sample]) / len(languages)
    y = np.array([[1.0 if name == n else -1.0 for n in languages] for name, _ in sample])
    # minimize sum share (y - K a - b)^2 + ridge a' K a: centred in feature space by the weighted mean
    h = np.eye(len(k)) - share[None, :]
    centred, target = h @ k @ h.T, y - share @ y
    dual = np.linalg.solve(share[:, None] * centred + language.RIDGE * np.eye(len(k)), share[:, None] * target)
    fresh = [text(rng, lang, 9) for lang in languages for _ in range(5)] + ["ka zz unk", "x"]
    there = np.array([[kernel(set(language.grams(t).tolist()), b) for b in sets] for t in fresh])
    want = (there - share @ k) @ h.T @ dual + share @ y
    names, scores = model.predict(fresh)
    assert names == [languages[c] for c in want.argmax(axis=1)]
    assert scores == pytest.approx(np.clip((want.max(axis=1) + 1) / 2, 0, 1), abs=1e-4)


def test_kernel_is_shared_presence():
    a, b = "der hund beisst", "der mann und hund"
    model = language.fit([("x", language.grams(a)), ("y", language.grams(b))])
    g, h = set(language.grams(a).tolist()), set(language.grams(b).tolist())
    k = model.kernel([language.grams(a)])
    assert k.ravel() == pytest.approx([1.0, len(g & h) / np.sqrt(len(g) * len(h))])


def test_learns_and_predicts(spark):
    prepare(spark)
    rng = random.Random(3)
    rows = [(k, text(rng, lang, rng.randint(5, 60)), lang, "x") for k, lang in enumerate(rng.choices(list(SYLLABLES), weights=[8, 1, 1], k=300))]
    rows += [(900, "only unlabelled", None, "x"), (901, None, "aa", "x"), (902, "123", "bb", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    model = language.learn(df, per_language=40, landmarks=10)
    assert model.languages == ["aa", "bb", "cc"] and len(model.sizes) == 30
    fresh = [(k, text(rng, lang, 12), lang, "y") for k, lang in enumerate(list(SYLLABLES) * 30)]
    fresh += [(900, None, None, "y"), (901, "", None, "y"), (902, "12 — !", None, "y"), (904, "½ ² Ⅷ", None, "y"), (903, "é" + text(rng, "bb", 200_000), "bb", "y")]
    got = language.identified(spark.createDataFrame(fresh, "doc_id long, text string, lang string, score string"), model).collect()
    for r in got:
        assert 0 <= r.score <= 1
        assert r.lang_pred == (r.lang if r.lang else "und")
    assert language.identified(df.limit(0), model).collect() == []


def test_without_labels(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in language.identified(df, language.learn(df)).collect()] == [("und", 0.0)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_string_kernel_language"](spark, FOLDER).collect()}
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").where("lang is not null").collect()
    held = [rows[r.doc_id].lang_pred == r.lang for r in truth if rows[r.doc_id].held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.97
