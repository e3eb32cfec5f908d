"""Language identification with string kernels.

The kernel is the blended spectrum of presence: the number of distinct character n-grams of one to ``MOST`` characters two
texts share, divided by the geometric mean of their own numbers. A text is case-folded, everything but letters becomes a
single space. Landmark texts span a Nystroem approximation: a text is represented by its kernel values with the landmarks,
whitened by the landmarks' own kernel matrix; on that, one ridge regression per language (one against the rest) is solved in
closed form. Scoring is two matrix products per batch: n-gram presence times landmark presence, then times the weights.

The model is learnt from a bounded sample: the ``per_language`` rows of each language with the smallest hash of their text, of
which the first ``landmarks`` are landmarks. Everything is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

MOST, LANDMARKS, PER_LANGUAGE, RIDGE = 3, 48, 400, 1e-3
#: Characters of a text that are looked at together; n-grams never span more, and pieces overlap by MOST - 1.
_PIECE = 1 << 20
_BATCH = 256
_OTHER = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"


def grams(text: str | None, most: int = MOST) -> np.ndarray:
    """Distinct n-grams of a text as sorted 64-bit numbers (21 bits a character); empty if it has no letter."""
    folded = _OTHER.sub(" ", (text or "").lower())
    numerals = [c for c in set(folded) if c != " " and not c.isalpha()]  # such as fractions and Roman numerals
    if numerals:
        folded = re.sub(f"[ {re.escape(''.join(numerals))}]+", " ", folded)
    folded = folded.strip()
    if not folded:
        return np.zeros(0, np.int64)
    folded = f" {folded} "
    out = np.zeros(0, np.int64)
    for start in range(0, len(folded), _PIECE):
        codes = np.frombuffer(folded[start:start + _PIECE + most - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        parts, gram = [codes], codes
        for n in range(1, most):
            gram = (gram[:-1] << 21) | codes[n:]
            parts.append(gram)
        out = np.unique(np.concatenate([out, *parts])) if len(out) else np.unique(np.concatenate(parts))
    return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks, sorted
    presence: np.ndarray    # landmarks x vocabulary
    sizes: np.ndarray       # distinct n-grams of each landmark
    weights: np.ndarray     # landmarks x languages
    bias: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts x landmarks."""
        here = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for k, g in enumerate(texts):
            at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
            here[k, at[self.vocabulary[at] == g]] = 1
        sizes = np.array([max(1, len(g)) for g in texts], np.float64)
        return (here @ self.presence.T) / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ``und`` and 0 for texts without a letter or if nothing was learnt.

        Letters are what ``str.isalpha`` says; marks and numerals are none. Of languages with equal scores, the first by name.
        """
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [grams(t) for t in texts]
        able = [k for k, g in enumerate(known) if len(g)] if self.languages else []
        for s in range(0, len(able), _BATCH):
            some = able[s:s + _BATCH]
            values = self.kernel([known[k] for k in some]) @ self.weights + self.bias
            best = values.argmax(axis=1)
            for k, b, v in zip(some, best.tolist(), values[np.arange(len(some)), best].tolist()):
                names[k], scores[k] = self.languages[b], min(1.0, max(0.0, (v + 1) / 2))
        return names, scores


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From (language, n-grams) in the order of preference."""
    languages = sorted({name for name, _ in sample})
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    chosen = [g for name in languages for g in [g for n, g in sample if n == name][:landmarks]]
    vocabulary = np.unique(np.concatenate(chosen))
    presence = np.zeros((len(chosen), len(vocabulary)), np.float32)
    for k, g in enumerate(chosen):
        presence[k, np.searchsorted(vocabulary, g)] = 1
    model = Model(languages, vocabulary, presence, np.array([len(g) for g in chosen], np.float64), np.zeros((len(chosen), len(languages))), np.zeros(len(languages)))
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    x = np.concatenate([model.kernel([g for _, g in sample[s:s + _BATCH]]) for s in range(0, len(sample), _BATCH)]) @ whiten
    y = np.array([[1.0 if name == n else -1.0 for n in languages] for name, _ in sample])
    share = np.array([1 / sum(n == name for n, _ in sample) for name, _ in sample]) / len(languages)  # languages count alike
    middle, offset = share @ x, share @ y
    xc, yc = x - middle, y - offset
    solved = np.linalg.solve((xc * share[:, None]).T @ xc + ridge * np.eye(x.shape[1]), (xc * share[:, None]).T @ yc)
    model.weights, model.bias = whiten @ solved, offset - middle @ solved
    return model


def learn(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Learn from rows with a label and a letter; others are passed over. The sample is at most ``per_language`` texts a language."""
    rows = labelled.select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # copies share a hash and count once; the smallest hashes are found among those below a bound that about four times as
    # many as wanted fall under, so that no task gets all rows of a language
    single = rows.select("lang", "hash").distinct()
    sizes = single.groupBy("lang").agg(F.count("*").alias("n"))
    low = single.join(F.broadcast(sizes), "lang").where(F.col("hash") / 2.0**64 + 0.5 <= 4.0 * per_language / F.col("n"))
    ranked = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("r") <= per_language)
    wanted = ranked.select("lang", "hash")  # at most ``per_language`` rows a language
    texts = rows.join(F.broadcast(wanted), ["lang", "hash"], "left_semi")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "hash": pdf["hash"], "grams": [grams(t) for t in pdf["text"]]})

    found = texts.mapInPandas(made, "lang string, hash long, grams array<long>").where(F.size("grams") > 0).dropDuplicates(["lang", "hash"]).orderBy("lang", "hash").collect()
    return fit([(r.lang, np.array(r.grams, np.int64)) for r in found], landmarks)


def identified(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``documents`` with lang_pred and score. Texts that are null or have no letter: ``und``, 0. Whole texts are read.

    Rows and other columns stay as they are; columns called lang_pred or score are replaced.
    """
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found = documents.select("*", predict(F.col(text_column)).alias("_found"))
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    return found.select(*[F.col(f"`{c}`") for c in kept], "_found.lang_pred", "_found.score")
