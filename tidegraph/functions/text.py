"""Intent of a question, by ordered keyword patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Tried in this order, the first category with a match wins -----
INTENT_PATTERNS = {
    "EXPOSURE": [
        r"exposed.*internet", r"public.*database", r"externally reachable", r"exposed.*asset",
        r"internet reachable", r"publicly accessible",
    ],
    "RISK": [r"highest risk", r"most dangerous", r"critical risk", r"risk.*increasing", r"top risk"],
    "ASSET": [r"production asset", r"sensitive data", r"who owns", r"asset.*contain", r"show.*asset"],
    "DEPENDENCY": [r"depends on", r"if.*fails", r"what breaks", r"blast radius"],
    "COMPLIANCE": [r"compliant", r"pci", r"controls.*failing", r"governance", r"compliance"],
    "TREND": [r"what changed", r"risk.*week", r"risk.*month", r"trend"],
    "EXECUTIVE": [
        r"fix first", r"summarize", r"executive summary", r"biggest problem", r"prioritize", r"leadership",
    ],
}
# --------------------------------------------------------------------------


def _matches(folded: Column, pattern: str) -> Column:
    """A pattern is plain words with ``.*`` between them: all words have to be there before their order is looked at."""
    words = pattern.split(".*")
    there = reduce(Column.__and__, [F.contains(folded, F.lit(w)) for w in words])
    return there if len(words) == 1 else there & folded.rlike(pattern)


def intent(text: Column) -> Column:
    """Category of a question text, UNKNOWN where no pattern matches."""
    folded = F.lower(text)
    out = None
    for category, patterns in INTENT_PATTERNS.items():
        hit = reduce(Column.__or__, [_matches(folded, p) for p in patterns])
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("UNKNOWN")
