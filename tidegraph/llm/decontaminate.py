"""Benchmark decontamination by a prefix-filtered set join with exact windows.

Every benchmark item gives windows of ``window`` consecutive words (a shorter item is one window). A window is a set of
word shingles, and it occurs in a document only if *all* of them do. So the necessary prefix of a window is a single
shingle: the rarest over all documents, counted in a first pass. The second pass joins documents to windows on that
shingle only, places the window by the shingle's position, drops placements that do not fit between the document's
first and last word (position and length bounds), and verifies the rest word by word.

Documents are never shuffled: the item side is sent to the tasks in blocks of about ``block_words`` words. A larger
benchmark takes several blocks, one after the other over the same rows, with the same result: items are cut on the cluster into
pieces that share all but one word of a window, the driver holds one block at a time, and the rows are written after each block but
the last, so that no plan and no task has more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import drop_folder, local_rows, only, staged_at

BLOCK_WORDS = 500_000
SHINGLE = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_PIECE = 1 << 20
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE + 1, _BASE)]), dtype=np.uint64)
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE + 1, np.uint64(pow(int(_BASE), -1, 2**64)))]), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of several texts, one after the other."""

    data: np.ndarray    # lower-cased bytes
    start: np.ndarray   # of each word, in bytes
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray   # first word of each text, and one more entry at the end

    def bytes_of(self, word: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[i]:self.end[i]].tobytes() for i in range(word, word + n))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8).

    Only ASCII characters separate words, so bytes can be looked at instead of characters. A word's hash is a polynomial
    of its bytes, taken from running sums of bounded pieces.
    """
    data = _LOWER[data]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
        edge[1:-1] = inside[1:] != inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # two texts that meet inside a word
    marks = np.flatnonzero(edge)
    if len(cuts):
        marks = np.sort(np.concatenate([marks, cuts, cuts]))
    start, end = marks[0::2], marks[1::2]
    h = np.zeros(len(start), np.uint64)
    low = 0
    while low < len(start):  # words of about _PIECE bytes at once
        high = max(low + 1, int(np.searchsorted(end, start[low] + _PIECE, "right")))
        a, z = int(start[low]), int(end[high - 1])
        if z - a <= _PIECE:
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data[a:z].astype(np.uint64) + np.uint64(1)) * _POWERS[:z - a], dtype=np.uint64)])
            s, e = start[low:high] - a, end[low:high] - a
            h[low:high] = (sums[e] - sums[s]) * _INVERSE[s]
        else:  # one word of more than a piece
            value, power = 0, 1
            for k in range(a, z, _PIECE):
                part = data[k:min(z, k + _PIECE)].astype(np.uint64) + np.uint64(1)
                value = (value + power * int((part * _POWERS[:len(part)]).sum(dtype=np.uint64))) % 2**64
                power = power * int(_POWERS[len(part)]) % 2**64
            h[low] = value
        low = high
    return Words(data, start, end, _mix(h), np.searchsorted(start, offsets))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive words at each place but the last few."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = _mix(out * _FOLD[k % 3] + h[k:k + n])
    return out


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Block:
    """Windows of some benchmark items, each once, and the items that hold it."""

    texts: list[bytes]         # of each window, words joined by a space
    length: np.ndarray         # in words
    width: np.ndarray          # of its shingles, in words
    shingle: list[np.ndarray]  # of each window, by position
    items: list[list[str | None]]  # items of each window
    key: np.ndarray | None = None    # hash of the chosen shingle
    place: np.ndarray | None = None  # its position in the window

    def tokens(self) -> dict[int, np.ndarray]:
        """Distinct shingles, by width."""
        return {w: np.unique(np.concatenate([self.shingle[i] for i in np.flatnonzero(self.width == w)])) for w in np.unique(self.width).tolist()}

    def choose(self, frequency: dict[tuple[int, int], int]) -> None:
        """Take the rarest shingle of each window as its prefix (ties: the first)."""
        count = [[frequency.get((int(w), int(s)), 0) for s in own.view(np.int64)] for w, own in zip(self.width, self.shingle)]
        self.place = np.array([int(np.argmin(c)) for c in count], np.int64)
        self.key = np.array([own[p] for own, p in zip(self.shingle, self.place)], np.uint64)


def _sorted(ids: set[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i or ""))


def make_block(items: list[tuple[str | None, str | None]], window: int) -> Block:
    found: dict[bytes, tuple[np.ndarray, set[str | None]]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        words = words_of(raw, np.array([0, len(raw)]))
        n = len(words.start)
        size = min(n, window)
        for i in range(n - size + 1 if n else 0):
            key = words.bytes_of(i, size)
            if key not in found:
                found[key] = (words.hash[i:i + size], set())
            found[key][1].add(item)
    length = np.array([len(h) for h, _ in found.values()], np.int64)
    width = np.minimum(length, SHINGLE)
    return Block(list(found), length, width, [shingles(h, w) for (h, _), w in zip(found.values(), width.tolist())], [_sorted(s) for _, s in found.values()])


def _count(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this partition that hold each shingle of the block."""
    only("decontaminate")
    tokens = block.tokens()
    sums = {w: np.zeros(len(t), np.int64) for w, t in tokens.items()}
    for batch in batches:
        words = words_of(*_text_bytes(batch.column(0)))
        for w, known in tokens.items():
            h = shingles(words.hash, w)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[at] == h)
            text = np.searchsorted(words.first, hit, "right")
            pairs = np.unique(at[hit] * np.int64(len(words.first) + 1) + text)
            sums[w] += np.bincount(pairs // (len(words.first) + 1), minlength=len(known))
    for w, known in tokens.items():
        some = sums[w] > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), w), pa.int32()), pa.array(known[some].view(np.int64)), pa.array(sums[w][some])], ["width", "shingle", "documents"])


def occurrences(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every place where a window of the block occurs."""
    windows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in np.unique(block.width).tolist():
        own = np.flatnonzero(block.width == w)
        own = own[np.argsort(block.key[own], kind="stable")]
        keys = block.key[own]
        h = shingles(words.hash, w)
        low = np.searchsorted(keys, h)
        hit = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == h))
        times = np.searchsorted(keys, h[hit], "right") - low[hit]
        at = np.repeat(hit, times)
        window = own[np.repeat(low[hit], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
        text = np.searchsorted(words.first, at, "right") - 1
        begin = at - block.place[window]
        fits = (begin >= words.first[text]) & (begin + block.length[window] <= words.first[text + 1])
        begin, window = begin[fits], window[fits]
        same = [words.bytes_of(b, n) == block.texts[k] for b, n, k in zip(begin.tolist(), block.length[window].tolist(), window.tolist())]
        windows.append(window[same])
        places.append(begin[same])
    return np.concatenate(windows), np.concatenate(places)


def _join(block: Block, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a block's occurrences to ``spans`` (first word, one past the last) and ``items`` of each row.

    The last block also drops the text and counts the words that are hit.
    """
    only("decontaminate")
    for batch in batches:
        texts = batch.schema.get_field_index("text")
        words = words_of(*_text_bytes(batch.column(texts)))
        window, begin = occurrences(block, words)
        end = begin + block.length[window]
        text = np.searchsorted(words.first, begin, "right") - 1
        base = words.first[text]
        n = batch.num_rows
        spans: list[list[int]] = [list(s or ()) for s in batch.column("spans").to_pylist()]
        items: list[set[str | None]] = [set(s or ()) for s in batch.column("items").to_pylist()]
        for t, s, e, k in zip(text.tolist(), (begin - base).tolist(), (end - base).tolist(), window.tolist()):
            spans[t] += (s, e)
            items[t].update(block.items[k])
        columns = {"spans": pa.array([_merged(s) for s in spans], pa.list_(pa.int64())), "items": pa.array([_sorted(s) for s in items], pa.list_(pa.string()))}
        out = {f.name: columns.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)}
        if last:
            out.pop("text")
            out["n_words"] = pa.array(words.first[1:n + 1] - words.first[:n])
            out["n_hit"] = pa.array([sum(m[1::2]) - sum(m[::2]) for m in columns["spans"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_pydict(out)


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2])):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += (s, e)
    return out


def pieces(text: str | None, window: int, most: int) -> list[tuple[int, str]]:
    """(words, text) of parts with at most ``most`` windows of ``window`` words each; together they have the windows of the whole
    text and no others."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = words_of(raw, np.array([0, len(raw)]))
    n = len(words.start)
    if n - window < most:
        return [(n, words.bytes_of(0, n).decode("utf-8", "surrogatepass"))] if n else []
    parts = [(k, min(k + most + window - 1, n)) for k in range(0, n - window + 1, most)]
    return [(e - k, words.bytes_of(k, e - k).decode("utf-8", "surrogatepass")) for k, e in parts]


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, window: int, block_words: int) -> Iterator[Block]:
    """Items by blocks of at most ``block_words`` words and one more piece, read one by one from the cluster."""
    most = max(1, block_words // 8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontaminate")
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, part in pieces(text, window, most):
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "n": pa.array([n], pa.int64()), "text": pa.array([part], pa.string())})

    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for row in local_rows(rows.mapInArrow(cut, "item string, n long, text string")):
        if block and size + row.n > block_words:
            yield make_block(block, window)
            block, size = [], 0
        block.append((row["item"], row.text))
        size += row.n
    yield make_block(block, window)


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``documents``: id, n_words, n_hit, items (ids of items with an occurring window, sorted as strings), spans.

    ``spans`` are merged hit ranges as first word, one past the last, in turn. Words are runs of ASCII digits, lower-cased
    ASCII letters and all other non-ASCII characters. A null or empty text has no words; such an item has no window.
    Item ids are carried as strings; items with a null id hit words like any other and are one null in ``items``. An id that comes several times has the windows of all its rows. Repeated
    documents and null ids are kept as they are. An empty benchmark hits nothing. ``keep`` names further columns of
    ``documents`` to carry along; others, also with clashing names, are not looked at.
    """
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *kept)
    texts = rows.select("text")
    current = rows.withColumn("spans", F.array().cast("array<bigint>")).withColumn("items", F.array().cast("array<string>"))
    narrow = current.drop("text").schema.simpleString()[7:-1]
    wide = current.schema.simpleString()[7:-1]
    blocks = _blocks(benchmark, item_column, item_text_column, window, block_words)
    block = next(blocks)
    spark, before = documents.sparkSession, None
    while block is not None:
        following = next(blocks, None)
        counts = {}
        if block.texts:
            counted = texts.mapInArrow(lambda b, block=block: _count(block, b), "width int, shingle long, documents long")
            # at most one row per shingle of the block
            counts = {(r.width, r.shingle): r.documents for r in counted.groupBy("width", "shingle").agg(F.sum("documents").alias("documents")).collect()}
        block.choose(counts)
        last = following is None
        current = current.mapInArrow(lambda b, block=block, last=last: _join(block, last, b), f"{narrow}, n_words bigint, n_hit bigint" if last else wide)
        if not last:
            current, path = staged_at(spark, current, "decontaminate")
            if before is not None:
                drop_folder(spark, before)
            before = path
        block = following
    return current.select(F.col("id").alias(id_column), "n_words", "n_hit", "items", "spans", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows without a hit, with all columns as they are."""
    names = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    found = contamination(documents.toDF(*names.values()), benchmark, window, names[id_column], names[text_column], keep=tuple(n for c, n in names.items() if c != id_column))
    return found.where(F.col("n_hit") == 0).select(*[F.col(n).alias(c) for c, n in names.items()])
