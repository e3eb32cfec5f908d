import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import filter_audit
from tidegraph.llm.common import prepare
from tidegraph.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(row, rows):
    text = row[1] or ""
    words = WORD.findall(text)
    earlier = any((t or "") == text and i is not None and (row[0] is None or i < row[0]) for i, t, _ in rows)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier,
    }


def brute(rows, labels):
    judged = [(r, fails(r, rows)) for r in rows]
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in judged if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                here = [(r, f) for r, f in left if f[letter]]
                gone = [(r, f) for r, f in own if f[letter] and any(f[x] for x in order[:step - 1])]
                left = [(r, f) for r, f in left if not f[letter]]
                shapley[letter] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), len(gone), sum(f[letter] and sum(f.values()) == 1 for _, f in own),
                    sum(r[0] in good for r, _ in here), sum(r[0] in toxic for r, _ in here),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["ab", "Cd", "é😀", "x|y", "zz\x0bq", "mm\xa0n", "#1"] + [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words[rng.choice([0, 7]):rng.choice([9, 300])], k=rng.choice([0, 5, 199, 200, 201, 250]))) for _ in range(25)]
    texts += [None, "", " ", "ALL CAPS " * 150, "tab\tnew\nline " * 100, "a\x1cb " * 210, "long " + "word " * 40000]
    rows = [(rng.choice([*range(60), None]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    return rows + rows[:10]


def test_audit_equals_all_orders(spark, tmp_path):
    rows = corpus()
    rng = random.Random(4)
    labels = [(rng.choice([*range(60), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": F.lit("x"), "n": F.lit(2), "part": F.lit(1)}).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("no")).write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op13_filter_audit"](spark, str(tmp_path)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 3 * 600
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == want


def test_no_documents_and_no_labels(spark):
    prepare(spark)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(filter_audit.mask_cells(docs, labels)).collect() == []
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    rows = filter_audit.audited(filter_audit.mask_cells(one, labels)).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and all(r.removed == 1 for r in rows if r.step == 1 and r.filter_order[0] == "A")


def test_other_filters(spark):
    prepare(spark)
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 2), ("p", 2, 1, 1, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audited(cells, "XY").collect()}
    assert got == {("XY", 1): (6, 2, 0, 2), ("XY", 2): (5, 1, 2, 4), ("YX", 1): (5, 3, 0, 4), ("YX", 2): (5, 0, 2, 2)}
    with pytest.raises(ValueError):
        filter_audit.audited(cells, "XX")
