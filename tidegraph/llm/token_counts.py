"""Token counts by rank-synchronous merging of ragged arrays.

Byte-pair encoding merges the lowest-ranked adjacent pair of a pre-token again and again. Here many pre-tokens lie in one
flat array of symbols. In a round, the rank of every adjacent pair is looked up, each pre-token takes its own lowest
rank, and all places of that pair are merged at the same time in all of them. Pre-tokens without a known pair are done;
what survives is counted. A worker counts a distinct pre-token once and keeps a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import islice
from re import Pattern

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import held
from tidegraph.llm.tokenization import BYTE_LEVEL, PLAIN, byte_characters, plain_pattern

_ANY, _OF_PLAIN = regex.compile(BYTE_LEVEL), plain_pattern(BYTE_LEVEL)
#: Distinct pre-tokens a worker remembers; symbols merged in one array; pre-tokens of a long text looked at once.
KEPT, SYMBOLS, AT_ONCE = 600_000, 1 << 20, 200_000
_NONE = np.iinfo(np.int32).max


def merges(path: str) -> "Merges":
    """One per worker and file."""
    return held("token_counts", path, lambda: Merges(path))


def _split(text: str) -> Pattern:
    return _OF_PLAIN if PLAIN.fullmatch(text) else _ANY


class Merges:
    """Merge table of a byte-level BPE file."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] is not None or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a byte-level BPE without normalization")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with context are not supported")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        vocabulary = model["vocab"]
        self.first = np.zeros(256, np.int64)
        for b, c in enumerate(byte_characters()):
            self.first[b] = vocabulary[c]
        self.size = max(vocabulary.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        joined = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.joined = key[order], order.astype(np.int32), joined
        self.counts: dict[str, int] = {}
        self.kept = kept

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], _NONE)

    def merged(self, parts: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        length = np.array([len(p) for p in parts], np.int64)
        symbol = self.first[np.frombuffer(b"".join(parts), np.uint8)]
        out, owner = np.zeros(len(parts), np.int64), np.repeat(np.arange(len(parts)), length)
        rank = np.full(len(symbol), _NONE, np.int32)  # of the pair that begins here
        rank[:-1] = np.where(owner[1:] == owner[:-1], self._ranks(symbol[:-1], symbol[1:]), _NONE)
        while len(symbol):
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(start, len(owner)))
            least = np.minimum.reduceat(rank, start)
            done = least == _NONE
            if done.any():
                out[owner[start[done]]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbol, owner, rank, sizes, least = symbol[stay], owner[stay], rank[stay], sizes[~done], least[~done]
                if not len(symbol):
                    break
            chosen = rank == np.repeat(least, sizes)
            # a run of equal symbols chooses overlapping places: take every other one, from the left
            at = np.flatnonzero(chosen)
            follows = np.concatenate([[False], at[1:] == at[:-1] + 1])
            begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbol[at] = self.joined[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            touched = np.zeros(len(symbol) + 1, bool)
            touched[at] = True
            symbol, owner = symbol[keep], owner[keep]
            rank, touched = rank[keep], touched[:-1][keep]
            new = np.flatnonzero(touched)
            new = np.unique(np.concatenate([new, new[new > 0] - 1]))
            inner = new[new < len(symbol) - 1]
            rank[inner] = np.where(owner[inner + 1] == owner[inner], self._ranks(symbol[inner], symbol[inner + 1]), _NONE)
            rank[-1] = _NONE
        return out

    def _learn(self, fresh: Iterable[str]) -> None:
        batch: list[str] = []
        size = 0
        for part in fresh:
            batch.append(part)
            size += len(part)
            if size >= SYMBOLS:
                self._add(batch)
                batch, size = [], 0
        self._add(batch)

    def _add(self, batch: list[str]) -> None:
        if batch:
            self.counts.update(zip(batch, self.merged([p.encode("utf-8", "surrogatepass") for p in batch]).tolist()))

    def _known(self, parts: list[str]) -> int:
        try:
            return sum(map(self.counts.__getitem__, parts))
        except KeyError:
            pass
        self.learn(parts)
        return sum(map(self.counts.__getitem__, parts))

    def learn(self, parts: Iterable[str]) -> None:
        fresh = set(parts).difference(self.counts)
        if len(self.counts) + len(fresh) > self.kept:
            self.counts.clear()
            fresh = set(parts)
        self._learn(fresh)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, at most ``AT_ONCE`` at once."""
        if len(text) <= AT_ONCE:
            yield _split(text).findall(text)
            return
        found = _split(text).finditer(text)
        while part := [m.group() for m in islice(found, AT_ONCE)]:
            yield part

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        extra, texts = 0, [text]
        if self.special and self.special.search(text):
            texts = self.special.split(text)
            extra = len(texts) - 1
        return extra + sum(self._known(p) for t in texts for p in self.pieces(t))

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Counts of a batch; its short texts are split first, so that their new pre-tokens are merged together."""
        short: dict[int, list[str]] = {}
        fresh: set[str] = set()
        for k, text in enumerate(texts):
            if text and len(text) <= AT_ONCE and not (self.special and self.special.search(text)):
                short[k] = _split(text).findall(text)
                fresh.update(short[k])
        self.learn(fresh)
        return [self._known(short.pop(k)) if k in short else self.count(text) for k, text in enumerate(texts)]


def with_token_counts(documents: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``over_limit``: more than ``limit`` tokens.

    Special strings inside a text are one token each, as the library takes them. A null or empty text has no bytes and no
    tokens. Repeated rows and null ids are kept; other columns are not looked at; an empty table gives no rows.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.octet_length(F.coalesce(text_column, F.lit(""))).cast("long").alias("n_bytes"), F.col(text_column).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(tokenizer)
        for batch in batches:
            n = pa.array(table.count_all(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(made, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
