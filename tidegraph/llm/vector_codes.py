"""Vector codes by product quantisation, with exact integer Lloyd rounds over two trees.

Vectors become integers, are cut into equal parts, and each part position has its codebook. The vectors are stored once as blocks
of trees: a tree per block and part position, each node with its box, count and sum. A round makes a small tree of each
codebook's entries and walks both: bounds on the distance of a node pair drop combinations, a node with one entry left is
assigned whole by its cached sum, and leaves that stay uncertain compare integers. A task returns sums per entry, which Spark
adds; the driver sees as many rows as the codebooks have numbers. All arithmetic is exact, so results do not depend on how the
vectors are dealt out: where 64 bits could overflow, Python's integers are used.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidegraph.llm.common import drop_folder, only, staged_at

#: Vectors of a block, and points of a leaf at most.
BLOCK, LEAF = 4096, 16
_LIMB = 10 ** 18
_LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int = 4096) -> np.ndarray:
    """floor(scale * x) of finite doubles, as 64-bit integers or, where those do not hold them, as Python integers."""
    if not x.size or np.abs(x).max() < 2 ** 40:
        return np.floor(x * scale).astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2 ** 53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


class Tree:
    """A balanced tree over the rows of ``points``: node i has the children 2i+1 and 2i+2; level l holds 2^l nodes.

    ``order`` puts the rows so that each node is a range of them. ``low``, ``high``: boxes; ``sums``: sum of the rows.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.depth = 0
        while n >> (self.depth + 1) >= max(1, leaf // 2):
            self.depth += 1
        order = np.arange(n)
        rough = self._rough(points)  # only the shape of the tree depends on it
        lows, highs, sums = [], [], []
        for level in range(self.depth + 1):
            starts = self._bounds(n, level)[:-1]
            there = points[order]
            lows.append(np.minimum.reduceat(there, starts, axis=0))
            highs.append(np.maximum.reduceat(there, starts, axis=0))
            sums.append(np.add.reduceat(there, starts, axis=0))
            if level < self.depth:
                widest = self._rough(highs[-1] - lows[-1]).argmax(axis=1) if points.shape[1] else np.zeros(len(starts), np.int64)
                node = np.repeat(np.arange(len(starts)), np.diff(self._bounds(n, level)))
                key = rough[order, widest[node]] if points.shape[1] else np.zeros(n)
                order = order[np.lexsort((key, node))]
        self.order, self.points = order, points[order]
        self.low, self.high, self.sums = np.concatenate(lows), np.concatenate(highs), np.concatenate(sums)

    @staticmethod
    def _rough(x: np.ndarray) -> np.ndarray:
        return (x // (1 << 20) if x.dtype == object else x).astype(np.float64)  # integers() of doubles can leave their range

    @staticmethod
    def _bounds(n: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * n) >> level

    def ranges(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row, and the row after the last, of nodes of a level."""
        bounds, at = self._bounds(len(self.points), level), nodes - ((1 << level) - 1)
        return bounds[at], bounds[at + 1]


class Entries:
    """A codebook's different entries, each under its lowest index, and a tree over them."""

    def __init__(self, book: np.ndarray):
        seen: dict[tuple, int] = {}
        for k, entry in enumerate(map(tuple, book.tolist())):
            seen.setdefault(entry, k)
        self.index = np.array(sorted(seen.values()), np.int64)
        self.points = book[self.index]
        self.tree = Tree(self.points, 1) if len(book) else None


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _fits(*arrays: np.ndarray) -> bool:
    """Whether no distance or bound between rows of the arrays leaves 64 bits."""
    most = max(_largest(a) for a in arrays)
    return 8 * max(1, arrays[0].shape[1]) * most * most < 1 << 62


def assigned(tree: Tree, entries: Entries) -> tuple[np.ndarray, dict[str, int]]:
    """Place in ``entries.points`` of the nearest entry of each of ``tree.points``, ties to the lower; and counts of the work.

    The counts: ``whole`` points of nodes assigned without looking at them, ``exact`` distances of single points.
    """
    plain = _fits(tree.low, tree.high, entries.points)
    kind = np.int64 if plain else object
    q_low, q_high = tree.low.astype(kind), tree.high.astype(kind)
    points, e_tree = entries.points.astype(kind), entries.tree
    e_low, e_high = e_tree.low.astype(kind), e_tree.high.astype(kind)
    nearest = np.full(len(tree.points), -1, np.int64)
    work = {"whole": 0, "exact": 0}
    q, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level, e_level, single = 0, 0, False
    while len(q):
        ql, qh = q_low[q], q_high[q]
        el, eh = (points[e], points[e]) if single else (e_low[e], e_high[e])
        gap = np.maximum(np.maximum(ql - eh, el - qh), 0)
        reach = np.maximum(qh - el, eh - ql)
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        firsts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        sizes = np.diff(np.append(firsts, len(q)))
        best = np.repeat(np.minimum.reduceat(most, firsts), sizes)
        keep = (least <= best).astype(bool)
        if single:  # the entry of the least upper bound against each other one, at the corner of the box that favours the other
            ranked = np.flatnonzero((most == best).astype(bool))
            group = np.repeat(np.arange(len(firsts)), sizes)
            champion = e[ranked[np.unique(group[ranked], return_index=True)[1]]][group]
            a, b = points[champion], points[e]
            corner = np.where((b > a).astype(bool), qh, ql)
            margin = ((corner - a) ** 2).sum(axis=1) - ((corner - b) ** 2).sum(axis=1)
            keep &= ~((margin < 0) | ((margin == 0) & (champion < e))).astype(bool) | (champion == e)
        q, e = q[keep], e[keep]
        if single:
            firsts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            sizes = np.diff(np.append(firsts, len(q)))
            alone = np.repeat(sizes == 1, sizes)
            start, end = tree.ranges(level, q[alone])
            lengths = end - start
            nearest[np.repeat(start, lengths) + _steps(lengths)] = np.repeat(e[alone], lengths)
            work["whole"] += int(lengths.sum())
            q, e = q[~alone], e[~alone]
            if level == tree.depth:
                _leaves(tree, points, level, q, e, nearest, work)
                break
        if not single:
            if e_level < e_tree.depth:
                q, e, e_level = np.repeat(q, 2), (2 * e[:, None] + np.array([1, 2])).ravel(), e_level + 1
            else:
                start, end = e_tree.ranges(e_level, e)
                lengths = end - start
                q, e, single = np.repeat(q, lengths), e_tree.order[np.repeat(start, lengths) + _steps(lengths)], True
        if level < tree.depth:
            q, e, level = (2 * q[:, None] + np.array([1, 2])).ravel(), np.repeat(e, 2), level + 1
        turn = np.lexsort((e, q))
        q, e = q[turn], e[turn]
    return nearest, work


def _steps(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _leaves(tree: Tree, points: np.ndarray, level: int, q: np.ndarray, e: np.ndarray, nearest: np.ndarray, work: dict[str, int]) -> None:
    if not len(q):
        return
    start, end = tree.ranges(level, q)
    lengths = end - start
    row, entry = np.repeat(start, lengths) + _steps(lengths), np.repeat(e, lengths)
    apart = ((tree.points.astype(points.dtype)[row] - points[entry]) ** 2).sum(axis=1)
    rows, place = np.unique(row, return_inverse=True)
    table = np.full((len(rows), len(points)), apart.max() + 1, points.dtype)
    table[place, entry] = apart
    nearest[rows] = table.argmin(axis=1)
    work["exact"] += len(row)


def _sums(tree: Tree, nearest: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and sum of each entry; of runs of one entry that are a whole node, the node's sum is taken."""
    size, total = np.zeros(count, np.int64), np.zeros((count, tree.points.shape[1]), object)
    size += np.bincount(nearest, minlength=count)
    todo, level = np.zeros(1, np.int64), 0
    while len(todo):
        start, end = tree.ranges(level, todo)
        first = nearest[start]
        changes = np.concatenate([[0], np.cumsum(nearest[1:] != nearest[:-1])])
        uniform = changes[end - 1] == changes[start]
        np.add.at(total, first[uniform], tree.sums[todo[uniform]].astype(object))
        todo = todo[~uniform]
        if level == tree.depth:
            start, end = tree.ranges(level, todo)
            row = np.repeat(start, end - start) + _steps(end - start)
            np.add.at(total, nearest[row], tree.points[row].astype(object))
            break
        todo, level = (2 * todo[:, None] + np.array([1, 2])).ravel(), level + 1
    return size, total


def _blocks(rows: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """(id, label: of the block's vectors; trees: pickled, one per part) of blocks of up to ``BLOCK`` vectors."""
    kinds = {c: rows.schema[c].dataType for c in ("id", "label")}
    schema = T.StructType([T.StructField(c, T.ArrayType(k)) for c, k in kinds.items()] + [T.StructField("trees", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vector_codes")
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                took = batch.slice(at, BLOCK - size)
                waiting.append(took)
                at, size = at + took.num_rows, size + took.num_rows
                if size == BLOCK:
                    yield one(waiting)
                    waiting, size = [], 0
        if size:
            yield one(waiting)

    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(batches).combine_chunks()
        vectors = block.column("v").combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        numbers = integers(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
        whole = np.zeros((len(lengths), parts * width), numbers.dtype)
        whole[np.repeat(np.arange(len(lengths)), lengths), _steps(lengths)] = numbers
        trees = [Tree(whole[:, p * width:(p + 1) * width], LEAF) for p in range(parts)]
        lists = [pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(c).combine_chunks()) for c in kinds]
        return pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(trees)], pa.binary())], names=[*kinds, "trees"])

    return rows.mapInArrow(build, schema)


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one assignment and update."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vector_codes")
        entries = [Entries(b) for b in books]
        sizes = [np.zeros(len(b), object) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for stored in batch.column("trees"):
                for p, tree in enumerate(pickle.loads(stored.as_py())):
                    nearest, _ = assigned(tree, entries[p])
                    n, s = _sums(tree, nearest, len(entries[p].points))
                    sizes[p][entries[p].index] += n
                    totals[p][entries[p].index] += s
        out = []
        for p in range(len(books)):
            numbers = np.concatenate([sizes[p][:, None], totals[p]], axis=1)
            for (entry, place), value in np.ndenumerate(numbers):
                sign, rest, limb = (-1 if value < 0 else 1), abs(int(value)), 0
                while rest:
                    rest, low = divmod(rest, _LIMB)
                    out.append((p, entry, place, limb, sign * low))
                    limb += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(),) * 4 + (pa.int64(),))], names=["part", "entry", "place", "limb", "value"])

    sums = blocks.select("trees").mapInArrow(each, "part int, entry int, place int, limb int, value long").groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    numbers = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
    for r in sums.collect():  # parts * entries * (width + 1) numbers
        numbers[r.part][r.entry, r.place] += int(r.value) * _LIMB ** r.limb
    return [_compact(np.array([[x // n[0] for x in n[1:]] if n[0] else list(old) for n, old in zip(ns, b.tolist())], object).reshape(b.shape)) for ns, b in zip(numbers, books)]


def _compact(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if _largest(book) < 1 << 62 else book


def _coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every vector."""
    kinds = {c: blocks.schema[c].dataType.elementType for c in ("id", "label")}
    schema = T.StructType([T.StructField(c, k) for c, k in kinds.items()] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vector_codes")
        entries = [Entries(b) for b in books]
        for batch in batches:
            for k in range(batch.num_rows):
                keep = [batch.column(c)[k].values for c in kinds]
                n = len(keep[0])
                code, error = np.empty((n, len(books)), np.uint8), np.zeros(n, object)
                for p, tree in enumerate(pickle.loads(batch.column("trees")[k].as_py())):
                    nearest, _ = assigned(tree, entries[p])
                    kind = np.int64 if _fits(tree.points, books[p]) else object
                    apart = tree.points.astype(kind) - entries[p].points[nearest].astype(kind)
                    code[tree.order, p] = entries[p].index[nearest]
                    error[tree.order] += (apart * apart).sum(axis=1).astype(object)
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays([
                    *keep, pa.array([text[2 * len(books) * i:2 * len(books) * (i + 1)] for i in range(n)], pa.string()), pa.array([min(int(x), _LONG) for x in error], pa.int64()),
                ], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(each, schema)


def compressed(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the codebooks: an integer array (entries, width) per part position.

    The table: id, label, code (two hex digits per part), error (squared distance to the entries, summed), label_error (errors
    of one label, nulls together, summed). Vectors that are null or hold null or non-finite components are left out. All others
    are filled up with zeros to the longest one's length, and that to a multiple of ``parts``; an empty vector is all zeros.
    The first codebooks are the ``entries`` smallest ids' vectors, null ids last, repeated ids by their vectors; with fewer
    vectors the codebooks are smaller, with none there are no rows. Repeated rows are kept. Errors beyond 64 bits are given as
    the largest long. Other columns are not looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has at most 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    first = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    start = np.zeros((len(first), parts * width))
    for k, v in enumerate(first):
        start[k, :len(v)] = v
    start = integers(start, scale)
    books = [start[:, p * width:(p + 1) * width] for p in range(parts)]
    blocks, path = staged_at(spark, _blocks(rows, parts, width, scale), "blocks")
    for _ in range(rounds if first else 0):
        books = _round(blocks, books)
    coded, _ = staged_at(spark, _coded(blocks, books), "codes")
    drop_folder(spark, path)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_column), F.col("label").alias(label_column), "code", "error", "label_error")
    return found, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of the codebooks, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
