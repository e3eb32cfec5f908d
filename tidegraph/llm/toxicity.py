"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w x - t_k): one weight vector for all thresholds t_0 <= t_1 <= ..., so the grades share what
they know about a feature. The expected severity is the sum of these probabilities over k. Features are words and
their first four and five letters (case-folded), each by log(1 + count).

Where labels say toxic or not but give no grade, ``graded`` derives one: a toxic document has grade 1, 2 or 3 by its number
of marked words, words that the sample holds mainly in toxic documents, with the sample's terciles as bounds.

The model is fitted to a bounded sample: of toxic and other labelled documents the ``per_class`` with the smallest hash of their id
each; of near copies in it one is used, else a copied text's own words would count as evidence. Every feature has a weight whose
shares of the two sides differ by more than ``SIGMAS`` deviations, however rare it is and however many there are; what is left of
chance the ridge penalty keeps small. Everything is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import drop_folder, free_name, local_rows, only, staged_at
from tidegraph.llm.simhash import least_shingles, shingle_hashes

PER_CLASS, GRADES, STEPS, DECAY = 2000, 4, 400, 1e-3
#: A feature must be in so many documents of one side of the sample: fewer are no evidence.
LEAST = 3
#: Deviations by which a feature's share must differ between the sides.
SIGMAS = 3.0
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = 1 << 20


def words_of(text: str | None) -> Counter:
    """Case-folded words with their counts; long texts are read in pieces that end between words."""
    text, out, at = text or "", Counter(), 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        out.update(_WORD.findall(text[at:end].lower()))
        at = end
    return out


def features_of(words: Counter) -> Counter:
    """Words and prefixes (marked by ^) with their counts."""
    out = Counter(words)
    for word, n in words.items():
        for length in (4, 5):
            if len(word) >= length:
                out["^" + word[:length]] += n
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    prefixes: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.prefixes = frozenset(f[1:] for f in self.vocabulary if f[0] == "^")

    def score(self, text: str | None) -> float:
        """w x of a text."""
        words, total = words_of(text), 0.0
        shared: Counter = Counter()
        known, prefixes = self.vocabulary, self.prefixes
        for word, n in words.items():
            k = known.get(word)
            if k is not None:
                total += self.weights[k] * np.log1p(n)
            if word[:4] in prefixes and len(word) >= 4:
                shared["^" + word[:4]] += n
            if word[:5] in prefixes and len(word) >= 5:
                shared["^" + word[:5]] += n
        return total + sum(self.weights[known[f]] * np.log1p(n) for f, n in shared.items())

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score, by k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, columns: int, grades: int, steps: int = STEPS, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximize the penalized likelihood; Adam on the full sample.

    ``row, column, value``: the sparse feature matrix. Grades count alike in sum. Thresholds are a first one and positive steps,
    so they stay in order.
    """
    share = np.bincount(grade, minlength=grades).astype(np.float64)
    weight = (1 / np.maximum(share, 1))[grade] / max(1, (share > 0).sum())
    params = np.concatenate([np.zeros(columns), [1.0], np.zeros(grades - 2)])
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = len(grade)
    for step in range(1, steps + 1):
        w, rest = params[:columns], params[columns:]
        t = np.cumsum(np.concatenate([rest[:1], np.exp(rest[1:])]))
        score = np.bincount(row, value * w[column], n)
        p = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -50, 50)))  # P(grade > k)
        edges = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        own = np.maximum(edges[np.arange(n), grade] - edges[np.arange(n), grade + 1], 1e-12)
        slope = p * (1 - p)
        # d log P(grade) / d (score - t_k)
        link = np.zeros((n, grades - 1))
        upper, lower = grade >= 1, grade <= grades - 2
        link[upper, grade[upper] - 1] += slope[upper, grade[upper] - 1] / own[upper]
        link[lower, grade[lower]] -= slope[lower, grade[lower]] / own[lower]
        link *= weight[:, None]
        by_score, by_t = -link.sum(axis=1), link.sum(axis=0)
        g_w = np.bincount(column, value * by_score[row], columns) + decay * w
        tail = np.cumsum(by_t[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * np.exp(rest[1:])])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        params = params - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    rest = params[columns:]
    return params[:columns], np.cumsum(np.concatenate([rest[:1], np.exp(rest[1:])]))


def _signature(text: str | None) -> list[int]:
    """Minima of hashed five-word shingles: near copies share one."""
    return least_shingles(shingle_hashes(text, 5))


def _once(rows: list) -> list:
    """Without rows that share a part of the signature with one before."""
    seen: list[set[int]] = [set() for _ in range(4)]
    out = []
    for r in rows:
        if not any(s in known for s, known in zip(r.signature, seen)):
            out.append(r)
        for s, known in zip(r.signature, seen):
            known.add(s)
    return out


@dataclass
class Sample:
    """Labelled documents as a sparse matrix: ``count[i]`` of feature ``names[column[i]]`` in document ``row[i]``."""

    names: list[str]
    toxic: np.ndarray
    row: np.ndarray
    column: np.ndarray
    count: np.ndarray


def sample_of(documents: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, per_class: int) -> Sample:
    """The sample's documents in the order of their ids. An id with several labels is toxic if one of them is.

    Only features of enough documents of one side come to the driver, by a hash of 64 bits; the others cannot be used.
    """
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = [marks.where(F.col("toxic") == side).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(per_class) for side in (True, False)]
    wanted = chosen[0].union(chosen[1]).select("id", "toxic")  # at most 2 * per_class rows
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(wanted), "id")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("toxicity")
        for pdf in batches:
            found = [dict(features_of(words_of(t))) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "toxic": pdf["toxic"], "features": found, "signature": [_signature(t) for t in pdf["text"]]})

    shape = f"id {rows.schema['id'].dataType.simpleString()}, toxic boolean, features map<string,long>, signature array<long>"
    spark = documents.sparkSession
    sample, path = staged_at(spark, rows.dropDuplicates(["id"]).mapInPandas(made, shape), "toxicity_sample")
    kept = _once(sorted(sample.select("id", "toxic", "signature").collect(), key=lambda r: str(r.id)))
    side = {r.id: r.toxic for r in kept}
    single = sample.join(F.broadcast(spark.createDataFrame([(k,) for k in side], sample.select("id").schema)), "id")
    each = single.select("id", "toxic", F.explode("features").alias("feature", "n"))
    sums = each.groupBy("feature").agg(F.count_if("toxic").alias("high"), F.count_if(~F.col("toxic")).alias("low"))
    common, kept_at = staged_at(spark, sums.where((F.col("high") >= LEAST) | (F.col("low") >= LEAST)).select("feature", F.xxhash64("feature").alias("h")), "toxicity_features")
    known = common.orderBy("h", "feature").toArrow()
    names, hashes = known["feature"].to_pylist(), known["h"].to_numpy()
    per = each.join(common, "feature").groupBy("id").agg(F.collect_list("h").alias("h"), F.collect_list("n").alias("n"))
    at = {k: i for i, k in enumerate(side)}
    row, column, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in local_rows(per):
        column.append(np.searchsorted(hashes, np.array(r.h, np.int64)))
        count.append(np.array(r.n, np.int64))
        row.append(np.full(len(r.h), at[r.id]))
    drop_folder(spark, path)
    drop_folder(spark, kept_at)
    row, column, count = np.concatenate(row), np.concatenate(column), np.concatenate(count)
    order = np.lexsort((column, row))
    return Sample(names, np.array(list(side.values()), bool), row[order], column[order], count[order])


def sides(sample: Sample) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and other documents that hold each feature."""
    toxic = sample.toxic[sample.row]
    return np.bincount(sample.column[toxic], minlength=len(sample.names)), np.bincount(sample.column[~toxic], minlength=len(sample.names))


def graded(sample: Sample) -> np.ndarray:
    """0 for documents that are not toxic, else 1, 2 or 3 by their number of marked words.

    A word is marked if it is in enough toxic documents of the sample, and in at least nine times as large a share of them as of the
    others.
    """
    high, low = sides(sample)
    n_toxic = int(sample.toxic.sum())
    scale = max(1, n_toxic) / max(1, len(sample.toxic) - n_toxic)
    marked = np.array([n[0] != "^" for n in sample.names], bool) & (high >= LEAST) & (high >= 9 * scale * low)
    own = marked[sample.column]
    counts = np.bincount(sample.row[own], sample.count[own], len(sample.toxic))
    bounds = np.quantile(counts[sample.toxic] if n_toxic else [0], [1 / 3, 2 / 3])
    return np.where(sample.toxic, 1 + (counts[:, None] > bounds).sum(axis=1), 0)


def learn(sample: Sample, grade: np.ndarray | None = None, grades: int = GRADES, sigmas: float = SIGMAS) -> Model:
    """Fit to a sample; ``grade`` overrides the derived grades, 0 to ``grades`` - 1. Without a toxic or without another document,
    nothing is toxic."""
    grade = graded(sample) if grade is None else grade
    n_high, n_low = int(sample.toxic.sum()), int((~sample.toxic).sum())
    if not n_high or not n_low:
        return Model({}, np.zeros(0), np.full(grades - 1, 50.0))
    high, low = sides(sample)
    m = (high + low) / (n_high + n_low)
    told = np.abs(high / n_high - low / n_low) > sigmas * np.sqrt(m * (1 - m) * (1 / n_high + 1 / n_low))
    place = np.cumsum(told) - 1
    own = told[sample.column]
    weights, thresholds = fit(sample.row[own], place[sample.column[own]], np.log1p(sample.count[own]), grade, int(told.sum()), grades)
    return Model({f: int(place[k]) for k, f in enumerate(sample.names) if told[k]}, weights, thresholds)


def learn_from(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", per_class: int = PER_CLASS) -> Model:
    return learn(sample_of(documents, labels, id_column, text_column, label_column, per_class))


def _judged(model: Model):
    @F.pandas_udf("severity double, grade int")
    def judged(texts: pd.Series) -> pd.DataFrame:
        only("toxicity")
        above = model.above(np.array([model.score(t) for t in texts]))
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": (above >= 0.5).sum(axis=1).astype(np.int32)})
    return judged


def scored(documents: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The kept columns with severity, grade and toxic of every row.

    severity: expected grade; grade: the number of thresholds passed with probability of at least one half; toxic: grade
    over zero. Null and empty texts have no features and score as such. Repeated rows are kept, an empty table gives
    no rows, and columns that are not in ``keep`` are not looked at.
    """
    found = documents.select(F.struct(*keep).alias("kept"), _judged(model)(F.col(text_column)).alias("found"))
    return found.select("kept.*", "found.severity", "found.grade", (F.col("found.grade") > 0).alias("toxic"))


def without_toxic(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows whose grade is 0, with all columns as they are."""
    name = free_name(documents, "found")
    found = documents.withColumn(name, _judged(model)(F.col(text_column)))
    return found.where(F.col(f"{name}.grade") == 0).drop(name)
