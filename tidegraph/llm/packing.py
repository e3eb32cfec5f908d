"""Packing of documents into sequences by minimum bin slack.

A sequence is filled with the fullest feasible combination of the lengths still there, found by a subset-sum over
bitsets, and the combination is removed. Only lengths matter for that, and there are at most ``capacity`` of them, so
the plan works on counts per length: a combination stays the fullest one as long as it is feasible, hence it is
taken as often as the counts allow, at once. The plan has a few thousand lines whatever the number of documents.

Pieces find their place by their number among the pieces of equal length. Each task numbers its own pieces; the
numbers of the tasks before come from a table with one row per task and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidegraph.llm.common import staged_at
from tidegraph.llm.tokenization import encoder

Plan = list[tuple[dict[int, int], int]]


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination that holds one piece of the largest length, as copies per length.

    Of equally full ones, it prefers long pieces.
    """
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    lengths = [n for n in sorted(counts, reverse=True) if n <= room]
    reach, levels = 1, [1]
    for n in lengths:
        for _ in range(min(counts[n] - (n == first), room // n)):
            wider = (reach | reach << n) & mask
            if wider == reach:
                break
            reach = wider
        levels.append(reach)
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    uses = {first: 1}
    for level in range(len(levels) - 1, 0, -1):
        n = lengths[level - 1]
        while not levels[level - 1] >> left & 1:
            uses[n] = uses.get(n, 0) + 1
            left -= n
    return uses


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Combinations (copies per length) and how many sequences each fills."""
    left = {n: c for n, c in counts.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be between 1 and the capacity")
    out: Plan = []
    while left:
        uses = fullest(left, capacity)
        times = min(left[n] // k for n, k in uses.items())
        out.append((uses, times))
        for n, k in uses.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


class Places:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, chosen: Plan) -> None:
        lines: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for uses, times in chosen:
            offset = 0
            for n in sorted(uses, reverse=True):
                lines.setdefault(n, []).append((taken.get(n, 0), sequence, uses[n], offset))
                taken[n] = taken.get(n, 0) + uses[n] * times
                offset += n * uses[n]
            sequence += times
        self.lines = {n: np.array(rows, np.int64) for n, rows in lines.items()}
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        bounds = np.flatnonzero(np.diff(length[order])) + 1
        for mine in np.split(order, bounds) if len(order) else []:
            n = int(length[mine[0]])
            rows = self.lines[n]
            row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
            within = rank[mine] - row[:, 0]
            sequence[mine] = row[:, 1] + within // row[:, 2]
            offset[mine] = row[:, 3] + within % row[:, 2] * n
        return sequence, offset


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity if there are several."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def encoded_pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of all pieces; every document ends with ``end_id``, a null or empty one has only that."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = ids_of(text) + end
                out += [(k, i, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            row, piece, start, length, crc = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": crc})

    return rows.mapInArrow(made, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def packed(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: as few sequences of at most ``capacity`` as the method finds, without gaps.

    Lengths must be 1 to ``capacity``. Pieces of equal length are interchangeable, so repeated rows and ties need no order.
    An empty table gives no rows. ``pieces`` is computed once and staged. Its columns must not be called part, rank,
    sequence_id or offset.
    """
    if clash := {"part", "rank", "sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"columns in use: {sorted(clash)}")
    spark = pieces.sparkSession
    at = pieces.columns.index(length)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = seen[n] + pd.Series(n).groupby(n).cumcount().to_numpy(np.int64)
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank)], [*batch.schema.names, "part", "rank"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    rows, _ = staged_at(spark, pieces.mapInArrow(number, f"{shape}, part int, rank long"), "pieces")
    sizes, _ = staged_at(spark, rows.groupBy("part", F.col(length).alias("n")).agg(F.count("*").alias("size")), "sizes")
    before = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "n", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    counts = {r.n: r["size"] for r in sizes.groupBy("n").agg(F.sum("size").alias("size")).collect()}  # at most ``capacity`` rows
    places = Places(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(n.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    numbered = rows.withColumnRenamed(length, "n").join(base, ["part", "n"]).withColumn("place", place(F.col("n"), F.col("rank") + F.col("base")))
    return numbered.select(*[F.col("n").alias(length) if c == length else F.col(c) for c in pieces.columns], "place.sequence_id", "place.offset")
