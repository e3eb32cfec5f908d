"""Secrets in texts: fixed rules, and character Markov models of random strings against ordinary identifiers.

All of it is column expressions. The rules give the base spans. Every longer run of identifier characters is a sample: one
that overlaps a base span is labelled as a random string, any other one as an ordinary identifier. Over all samples of the
corpus, the pairs of neighbouring characters are counted per label; that is all that leaves the executors (at most
2 * 66 * 66 sums). The log-likelihood ratio of the two first-order models then scores the samples outside the base spans.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.llm.common import staged_at

#: Kinds in the order of the report, with pattern, and the part and number of characters it must have at least.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # greedy runs of one class: asking for the length in the pattern finds the same as dropping short runs, without listing those
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
RANDOM = "random"
KINDS = [kind for kind, *_ in RULES] + [RANDOM]
_ALPHABET = string.ascii_letters + string.digits + "_+/-"
#: Shortest run that is a sample; log-likelihood ratio from which it is a secret; pseudo-count of each pair.
LEAST, RATIO, PRIOR = 16, 10.0, 0.5
_STEP = 256


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _found(text: Column, pattern: str, part: int, least: int) -> Column:
    """(start, end, token) of the matches of ``pattern`` whose part is long enough, in code points.

    Splitting at the matches gives what lies between them, so starts are sums of lengths; sums of ``_STEP`` lengths each keep
    that from growing with the square of the number of matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    def places(found: Column) -> Column:
        lengths = F.zip_with(F.transform(found, F.length), F.slice(F.transform(between, F.length), F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
        return F.transform(F.array(lengths), lambda w: _starts(found, w))[0]
    def _starts(found: Column, w: Column) -> Column:
        both = F.transform(w, lambda x: x["m"] + x["b"])
        steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / _STEP).cast("int")), lambda k: _sum(F.slice(both, k * _STEP + 1, F.lit(_STEP))))
        before = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: _sum(F.slice(steps, F.lit(1), k)))
        return F.transform(F.array(F.struct(both.alias("both"), before.alias("before"))), lambda t: F.transform(found, lambda m, i: _span(m, i, t, w)))[0]
    def _span(m: Column, i: Column, t: Column, w: Column) -> Column:
        step = F.floor(i / _STEP).cast("int")
        start = F.get(t["before"], step) + _sum(F.slice(t["both"], step * _STEP + 1, i % _STEP)) + F.get(w, i)["b"]
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("token"))
    # an array of one element holds a value that is used several times
    every = F.transform(F.array(matches), lambda found: F.when(F.size(found) > 0, places(found)))[0]
    long_enough = lambda s: F.length(F.regexp_extract(s["token"], pattern, part) if part else s["token"]) >= least
    return F.coalesce(F.filter(every, long_enough), F.array().cast("array<struct<start:int,end:int,token:string>>"))


def base_spans(text: Column) -> Column:
    """(start, kind's place in KINDS, end) of all base spans, sorted; leftmost non-overlapping for each kind."""
    kinds = [F.transform(_found(text, pattern, part, least), _as_span(k)) for k, (_, pattern, part, least) in enumerate(RULES)]
    return F.array_sort(F.concat(*kinds))


def _as_span(kind: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def of_kind(spans: str, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def _codes(token: Column) -> Column:
    """Place of each character of the token in the alphabet."""
    place = F.split(F.lit(",".join(str(max(0, _ALPHABET.find(chr(c)))) for c in range(128))), ",").cast("array<int>")
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.get(place, F.ascii(F.substring(token, i, F.lit(1)))))


def scanned(documents: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The kept columns, base spans and samples (start, end, token, overlap) of every row; staged."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    sample = _found(text, f"[A-Za-z0-9_+/-]{{{LEAST},}}", 0, LEAST)
    rows = documents.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], base_spans(text).alias("base"), sample.alias("found"))
    marked = rows.withColumn("samples", F.expr("transform(found, f -> struct(f.start, f.end, f.token, exists(base, s -> s.start < f.end AND f.start < s.end) AS labelled))")).drop("found")
    return staged_at(documents.sparkSession, marked, "scanned")[0]


def ratios(rows: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random string to ordinary identifier, from the labelled samples.

    Without samples of a label, its model is uniform.
    """
    n = len(_ALPHABET)
    samples = rows.select(F.explode("samples").alias("s")).select(F.col("s.labelled").alias("random"), _codes(F.col("s.token")).alias("codes"))
    pairs = samples.select("random", F.explode(F.zip_with(F.expr("slice(codes, 1, size(codes) - 1)"), F.expr("slice(codes, 2, size(codes) - 1)"), lambda a, b: a * n + b)).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}

    def logs(random: bool) -> list[float]:
        out = []
        for a in range(n):
            row = [counts.get((random, a * n + b), 0) + PRIOR for b in range(n)]
            out += [math.log(x / sum(row)) for x in row]
        return out
    return [x - y for x, y in zip(logs(True), logs(False))]


def secrets(documents: DataFrame, keep: list[str], text_column: str = "text", ratio: float = RATIO) -> DataFrame:
    """The kept columns, ``base`` and ``spans`` (base spans and those of random strings) of every row, each sorted.

    A span is (start, kind, end): code points, the end exclusive, and the kind's place in ``KINDS``. Null and empty texts have
    none. Repeated rows are kept; columns that are not in ``keep`` are not looked at, and those kept must not be called base
    or spans. An empty table gives no rows.
    """
    rows = scanned(documents, keep, text_column)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios(rows))), ",").cast("array<double>")
    n = len(_ALPHABET)

    def score(token: Column) -> Column:
        return F.transform(F.array(_codes(token)), lambda codes: F.aggregate(
            F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0), lambda a, i: a + F.get(table, F.get(codes, i - 1) * n + F.get(codes, i))))[0]
    added = F.transform(
        F.filter("samples", lambda s: ~s["labelled"] & (score(s["token"]) >= ratio)),
        _as_span(len(RULES)),
    )
    return rows.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "base", F.array_sort(F.concat("base", added)).alias("spans"))


def without_secrets(documents: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """All rows, with secrets in their text replaced; where that changes a text, ``length_column``, if there is one, is its new length.

    Other columns stay as they are.
    """
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    found = secrets(documents.toDF(*names.values()), list(names.values()), names[text_column])
    text = redacted(F.col(names[text_column]), F.col("spans"))
    new = {text_column: text, length_column: F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col(names.get(length_column, names[text_column]))) if length_column in names else None}
    return found.select(*[(new[c] if c in new else F.col(n)).cast(documents.schema[c].dataType).alias(c) for c, n in names.items()])


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each group of overlapping spans replaced by ``mark``; null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
