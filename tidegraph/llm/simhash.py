"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``2 * half`` bits exactly if some third value lies within ``half`` bits of
both. So every distinct fingerprint emits all its variants within ``half`` bits, and fingerprints that share a
variant are linked. There are 2081 variants for ``half`` = 2, too many to move: the shuffle is on a *prefix* of the
variant, a fingerprint visits each prefix within reach once, and the variants that begin with that prefix are made
where they meet. The prefix grows with the number of distinct fingerprints, so a task's share stays the same.

All members of one variant lie within the radius of each other, so links between neighbours in the sorted variants
suffice: a group of a million near copies gives a chain, not 10^12 pairs. Every link is checked by its distance.

``near_duplicates`` links by the distance of one fingerprint. ``similar_groups`` takes such links as candidates, links by the
similarity of shingle sets, and completes them by a prefix-filtered set join that loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegraph.llm.common import drop_folder, free_name, local_roots, only, staged_at
from tidegraph.llm.components import connected

SEED = 42
#: Variants that one task makes on average, and that are in memory at once.
PER_TASK, AT_ONCE = 4 << 20, 1 << 20


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of all ``width``-word shingles of a text, repeats included; of all words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    pieces = zip(starts[:n].tolist(), ends[len(words) - n:].tolist())
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in pieces]), ">u8").astype(np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """64 bits; a bit is set if it is set in more than half of the shingle hashes. No words: 0."""
    return _fingerprint_of(shingle_hashes(text, width))


def _fingerprint_of(hashes: np.ndarray) -> int:
    return int.from_bytes(np.packbits(2 * _ones(hashes[:, None]) > len(hashes)).tobytes(), "big", signed=True)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """Hashes (one column of 64 bits) in which each bit is set, the highest bit first."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 250 * 64):
        bits = np.unpackbits(hashes[k:k + 250 * 64].astype(">u8").view(np.uint8), axis=1)
        whole = len(bits) // 250 * 250  # sums of up to 255 bits fit a byte
        total += bits[:whole].reshape(-1, 250, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def with_fingerprint(df: DataFrame, text: str, out: str, width: int = 5) -> DataFrame:
    """Adds the fingerprint of ``text`` as a signed long. Null and empty texts: 0."""
    @F.pandas_udf(T.LongType())
    def made(texts: pd.Series) -> pd.Series:
        only("simhash")
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")
    return df.withColumn(out, made(F.col(text)))


def hex_of(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _ball(bits: int, flips: int) -> np.ndarray:
    """Masks of at most ``flips`` of the lowest ``bits`` bits."""
    return np.array([sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in combinations(range(bits), k)], np.uint64)


def _ball_size(bits: int, flips: int) -> int:
    return len(_ball(bits, flips)) if flips <= 1 else sum(_binomial(bits, k) for k in range(flips + 1))


def _binomial(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _meetings(values: np.ndarray, rows: np.ndarray, used: np.ndarray, bits: int, half: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that share a variant of the lowest ``bits`` bits: each row with the next one of the variant.

    ``used``: flips already spent on the bits above. Variants are made in slices by their next bit, so that at most about
    ``at_once`` are in memory.
    """
    expected = sum(int((used == u).sum()) * _ball_size(bits, half - u) for u in range(half + 1))
    if expected > at_once and bits > 1:
        top = ((values >> np.uint64(bits - 1)) & np.uint64(1)).astype(np.int64)
        for bit in (0, 1):
            spent = used + (top ^ bit)
            keep = spent <= half
            yield from _meetings(values[keep], rows[keep], spent[keep], bits - 1, half, at_once)
        return
    low = np.uint64((1 << bits) - 1)
    made, owners = [], []
    for u in range(half + 1):
        mine = used == u
        masks = _ball(bits, half - u)
        made.append(((values[mine] & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(rows[mine], len(masks)))
    variants, owner = np.concatenate(made), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owner = variants[order], owner[order]
    same = variants[1:] == variants[:-1]
    met = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(order) else order
    variants, owner = variants[met], owner[met]
    order = np.lexsort((owner, variants))
    variants, owner = variants[order], owner[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    if len(same):
        pairs = np.unique(owner[same] * np.int64(rows.max() + 1) + owner[same + 1])
        yield pairs // (rows.max() + 1), pairs % (rows.max() + 1)


def links(fingerprints: DataFrame, column: str, half: int = 2, per_task: int = PER_TASK, at_once: int = AT_ONCE) -> DataFrame:
    """(high, low): links that connect all distinct values of ``column`` within ``2 * half`` bits of each other.

    ``fingerprints`` holds each value once. The links of each task form a forest, each tree named by its smallest member.
    """
    count = fingerprints.count()
    prefix_bits = min(20, max(4, int(np.ceil(np.log2(max(1, count * _ball_size(64, half) / per_task))))))
    rest = 64 - prefix_bits
    masks = [(int(m), int(bin(int(m)).count("1"))) for m in _ball(prefix_bits, half)]
    reach = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(u).alias("used")) for m, u in masks])
    visits = (
        fingerprints.select(F.col(column).alias("value"), F.explode(reach).alias("r"))
        .select(F.shiftrightunsigned("value", rest).bitwiseXOR(F.col("r.mask")).alias("prefix"), "value", F.col("r.used").alias("used"))
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        only("simhash")
        pdf = pdf.sort_values("value")  # so a tree is named by its smallest member, and no large one is the end of many links
        values = pdf["value"].to_numpy(np.int64).view(np.uint64)
        used, rows = pdf["used"].to_numpy(np.int64), np.arange(len(pdf))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        kept = 0
        for x, y in _meetings(values, rows, used, rest, half, at_once):
            near = np.bitwise_count(values[x] ^ values[y]) <= 2 * half
            a.append(x[near])
            b.append(y[near])
            kept += len(x)
            if kept > 4 * len(rows) + at_once:  # keep a forest instead of all links so far
                a, b = _forest(len(rows), a, b)
                kept = 0
        a, b = _forest(len(rows), a, b)
        signed = values.view(np.int64)
        return pd.DataFrame({"high": signed[a[0]], "low": signed[b[0]]})

    return visits.groupBy("prefix").applyInPandas(meet, "high long, low long")


def _forest(n: int, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    root = local_roots(n, np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(root != np.arange(n))
    return [linked], [root[linked]]


def near_duplicates(documents: DataFrame, width: int = 5, half: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint as a signed long, component_id) of every row, linked at ``2 * half`` or fewer differing bits.

    ``component_id`` is the smallest id reachable by links, itself included. Texts that are null, empty or without words
    have fingerprint 0 and are linked like any other. Rows with a null id take part and are returned; they name a
    component only if no member has an id (then it is null). Repeated rows are returned as often as they come. An empty
    table gives no rows; other columns of ``documents`` are not looked at.
    """
    spark = documents.sparkSession
    marked = with_fingerprint(documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "text", "value", width)
    rows, _ = staged_at(spark, marked.select("id", "value"), "fingerprints")
    values, _ = staged_at(spark, rows.groupBy("value").agg(F.min("id").alias("least")), "values")
    groups = connected(links(values.select("value"), "value", half))
    named = values.join(groups.withColumnRenamed("node", "value"), "value", "left").select("value", "least", F.coalesce("component", "value").alias("component"))
    named, _ = staged_at(spark, named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.select("value", "component").join(least, "component").select("value", "component_id")
    return rows.join(ids, "value").select(F.col("id").alias(id_column), F.col("value").alias("fingerprint"), "component_id")


#: Orders of the texts, each by their least shingle under another hash, that bring near copies side by side; the texts that each
#: text is first compared with in such an order, if they share so many of their least shingles.
ORDERS, BESIDE, SHARED = 4, 2, 3
#: Counters of the sketch that tells how common shingles are.
COUNTERS = 1 << 21
#: Rows that a sketch is cut into, and sums of sketches that are added up at once.
CHUNKS, TOGETHER = 64, 64
#: Bits of the bitmap of texts that have a candidate.
BITMAP = 1 << 24


_ORDER_FACTORS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def overlap(a: bytes, b: bytes, kind: str = "<u4") -> float:
    """Jaccard similarity of two sorted sets of hashes of type ``kind``; two empty sets are equal."""
    x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def prefix_of(shingles: np.ndarray, similarity: float, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set in an order of all shingles, so many that two sets of this similarity share one.

    Sets of a similarity s share at least s times the size of either, so all but that number, and one more. The order is by how
    common the sketch ``times`` says they are, then by the hash. Without shingles: a 0.
    """
    n = len(shingles)
    if not n:
        return np.zeros(1, np.uint64)
    return shingles[np.lexsort((shingles, times[_counter_of(shingles, len(times))]))][:n - int(np.ceil(similarity * n - 1e-6)) + 1]


def _counter_of(shingles: np.ndarray, counters: int) -> np.ndarray:
    return (shingles & np.uint64(counters - 1)).astype(np.int64)


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, set if an odd number of them has it; at least twice as many bits as hashes, a power of two."""
    size = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def difference(x: bytes, y: bytes) -> int:
    """A lower bound on the number of hashes that only one of two sets has, from their parities.

    A bit that differs needs at least one of them. The longer array is folded to the length of the other one.
    """
    if len(x) < len(y):
        x, y = y, x
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _frequencies(texts: DataFrame, width: int, counters: int) -> np.ndarray:
    """A sketch of how many texts have each shingle, over all texts; of a fixed size, by sums of hashed counters up to 65,535.

    A task counts its texts in one array. The arrays are added up in two steps, a few at a time, and only order the shingles.
    """
    most = np.iinfo(np.uint16).max

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        total = np.zeros(counters, np.uint32)
        for batch in batches:
            for t in batch.column(0):
                own = np.unique(shingle_hashes(t.as_py(), width))
                np.add.at(total, _counter_of(own, counters), 1)
        if total.any():
            parts = np.minimum(total, most).astype("<u2").reshape(CHUNKS, -1)
            part = TaskContext.get().partitionId() // TOGETHER
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS), pa.int32()), pa.array(np.full(CHUNKS, part), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "part", "counts"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(counters // CHUNKS, np.uint32)
        for counts in pdf["counts"]:
            total = np.minimum(total + np.frombuffer(counts, "<u2"), most)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [pdf["part"].iloc[0]], "counts": [total.astype("<u2").tobytes()]})

    shape = "chunk int, part int, counts binary"
    sums = texts.mapInArrow(count, shape).groupBy("chunk", "part").applyInPandas(add, shape).groupBy("chunk").applyInPandas(add, shape)
    found = np.zeros(counters, np.uint16)
    for r in sums.collect():  # CHUNKS rows, four megabytes in all
        found[r.chunk * (counters // CHUNKS):(r.chunk + 1) * (counters // CHUNKS)] = np.frombuffer(r.counts, "<u2")
    return found


def _binary_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class _Search:
    """The set join of ``similar_groups``, whose tables are dropped as soon as their last reader has run."""

    def __init__(self, texts: DataFrame, similarity: float, width: int, counters: int):
        self.spark, self.texts, self.similarity, self.width = texts.sparkSession, texts, similarity, width
        self.paths: dict[int, str] = {}
        self.sketches = self.hold(self._sketches(_frequencies(texts, width, counters)), "sketches")

    def hold(self, df: DataFrame, name: str) -> DataFrame:
        stored, path = staged_at(self.spark, df, name)
        self.paths[id(stored)] = path
        return stored

    def drop(self, *stored: DataFrame) -> None:
        for df in stored:
            drop_folder(self.spark, self.paths.pop(id(df)))

    def _sketches(self, times: np.ndarray) -> DataFrame:
        """(node, digest, lead, fingerprint, size, prefix, bits) of each distinct text; no shingle set is stored.

        The prefix holds 32 bits of each shingle: two that are equal in them only add a candidate.
        """
        similarity, width = self.similarity, self.width

        @F.pandas_udf("lead array<long>, fingerprint long, size int, prefix array<int>, bits binary")
        def made(texts: pd.Series) -> pd.DataFrame:
            only("simhash")
            out = []
            for t in texts:
                all_of_it = shingle_hashes(t, width)
                s = np.unique(all_of_it)
                prefix = prefix_of(s, similarity, times)
                out.append((least_shingles(s) or [0] * ORDERS, _fingerprint_of(all_of_it), len(s), (prefix >> np.uint64(32)).astype(np.uint32).view(np.int32), parities(s)))
            return pd.DataFrame(out, columns=["lead", "fingerprint", "size", "prefix", "bits"])

        rows = self.texts.select(_binary_digest(F.col("text")).alias("digest"), made("text").alias("m"))
        single = rows.groupBy("digest").agg(F.first("m").alias("m"))
        return single.select(F.monotonically_increasing_id().alias("node"), "digest", "m.*")

    def _sets(self, edges: DataFrame) -> DataFrame:
        """(node, shingles) of all texts that have a candidate, made again from the texts.

        A bitmap of their hashed digests, of the same size whatever their number, spares most other texts.
        """
        some = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        wanted = self.hold(self.sketches.select("node", "digest").join(some, "node"), "wanted")
        bit = F.pmod(F.xxhash64("digest"), F.lit(BITMAP)) + 1
        parts = wanted.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
        marks = np.zeros(BITMAP // 8, np.uint8)
        for r in parts.collect():  # at most BITMAP / 32768 of 4 KB
            marks[(r.part - 1) * 4096:r.part * 4096] = np.frombuffer(r.bits, np.uint8)
        width = self.width

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only("simhash")
            for batch in batches:
                at = batch.column("bit").to_numpy() - 1
                batch = batch.filter(pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                once = dict(zip(batch.column("digest").to_pylist(), batch.column("text")))
                sets = [np.unique(shingle_hashes(t.as_py(), width)).astype("<u8").tobytes() for t in once.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

        near = self.texts.select(_binary_digest(F.col("text")).alias("digest"), "text").withColumn("bit", bit).mapInArrow(made, "digest binary, shingles binary")
        single = near.groupBy("digest").agg(F.first("shingles").alias("shingles"))  # copies of a text meet once for each task
        found = self.hold(single.join(wanted, "digest").select("node", "shingles"), "sets")
        self.drop(wanted)
        return found

    def proved(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that have the similarity.

        Sets of a similarity s differ in at most (1 - s) / (1 + s) of both sizes together. The parities of two texts bound their
        difference from below, which rules out most pairs; the others are compared by their whole sets.
        """
        @F.pandas_udf("long")
        def apart(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([difference(p, q) for p, q in zip(x, y)], dtype="int64")

        @F.pandas_udf("double")
        def alike(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([overlap(p, q, "<u8") for p, q in zip(x, y)], dtype="float64")

        s, told = self.similarity, self.sketches.select("node", "size", "bits")
        both = pairs.join(told.toDF("a", "m", "p"), "a").join(told.toDF("b", "n", "q"), "b")
        edges = self.hold(both.where(apart("p", "q") <= (1 - s) / (1 + s) * (F.col("m") + F.col("n")) + 1e-6).select("a", "b"), "candidates")
        sets = self._sets(edges)
        both = edges.join(sets.toDF("a", "p"), "a").join(sets.toDF("b", "q"), "b")
        found = self.hold(both.where(alike("p", "q") >= s).select("a", "b"), "proved")
        self.drop(edges, sets)
        return found

    def by_fingerprint(self, half: int) -> DataFrame:
        """(a, b): texts of one fingerprint, each with the first of them, and first texts of fingerprints that are linked."""
        rows = self.sketches.select("node", "fingerprint")
        first = self.hold(rows.groupBy("fingerprint").agg(F.min("node").alias("first")), "fingerprints")
        same = rows.join(first, "fingerprint").where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        linked = links(first.select("fingerprint"), "fingerprint", half)
        ends = linked.join(first.toDF("high", "x"), "high").join(first.toDF("low", "y"), "low")
        out = self.hold(same.union(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "by_fingerprint")
        self.drop(first)
        return out

    def by_order(self) -> DataFrame:
        """(a, b): texts side by side in the orders of their least shingles, which near copies mostly share."""
        found = []
        for k in range(ORDERS):
            turned = self.sketches.select("node", "lead", F.xxhash64("node", F.lit(k)).alias("turn"), F.get("lead", F.lit(k)).alias("least"))
            placed = self.hold(_in_order(turned, ["least", "turn"], "place"), "order")
            found.append(self.hold(_beside(placed), "beside"))
            self.drop(placed)
        return self.hold(reduce(DataFrame.union, found), "by_order")

    def by_prefix(self, groups: DataFrame) -> DataFrame:
        """(a, b), a < b, of the texts of different ``groups`` that share a prefix shingle and can have the similarity.

        The sizes, and the places of the first shingle that two texts share, bound what they can have in common. First the
        shingles that several groups have are found, by two numbers for each; only their visits are moved and joined.
        """
        texts = self.sketches.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
        ends = texts.select("group", F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high"))
        several = self.hold(ends.where("low <> high").select("shingle"), "several")
        visits = texts.select("node", "size", "group", F.posexplode("prefix").alias("place", "shingle"))
        met = self.hold(visits.join(several, "shingle", "left_semi"), "meeting")
        x, y = (met.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "size", "group", "place")]) for side in "ab")
        small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
        most = 1 + F.least(F.col("size_a") - 1 - F.col("place_a"), F.col("size_b") - 1 - F.col("place_b"))
        s = self.similarity
        can = (small >= s * large - 1e-6) & (most >= s / (1 + s) * (small + large) - 1e-6)
        both = x.join(y, "shingle").where((F.col("node_a") < F.col("node_b")) & (F.col("group_a") != F.col("group_b")) & can)
        out = self.hold(both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "by_prefix")
        self.drop(several, met)
        return out


def similar_groups(documents: DataFrame, similarity: float = 0.8, width: int = 5, text_column: str = "text", half: int = 2, counters: int = COUNTERS) -> DataFrame:
    """(digest, component) of every distinct text, digest its SHA-256; texts linked, over others too, share a component.

    A link is a Jaccard similarity of at least ``similarity`` of the sets of ``width``-word shingles (fewer words: all of them
    are one shingle), compared as 64-bit hashes. All pairs of that similarity share a component. First come the texts whose
    fingerprints meet in the middle, ``2 * half`` bits apart at most, and those side by side in ``ORDERS`` orders by their least
    shingle. What a comparison of their sets proves makes groups. Then a set join completes them: two texts of this
    similarity share a shingle of their prefixes, the rarest ones of each, and all such pairs of different groups are
    compared. So a large group of near copies does not give all its pairs, and no pair is left out. How common shingles are
    comes from a sketch of ``counters`` numbers (a power of two, ``CHUNKS`` at least) over all texts; only the work depends on it. Null is the empty text. An empty table gives no rows.
    """
    search = _Search(documents.select(F.coalesce(F.col(text_column), F.lit("")).alias("text")), similarity, width, counters)
    first = [search.by_fingerprint(half), search.by_order()]
    quick = search.proved(reduce(DataFrame.union, first).distinct())
    groups = search.hold(connected(quick), "groups")
    groups = search.hold(connected(quick.union(search.proved(search.by_prefix(groups)))), "groups")
    found = search.sketches.select("node", "digest").join(groups, "node", "left").select(F.lower(F.hex("digest")).alias("digest"), F.coalesce("component", "node").alias("component"))
    found, _ = staged_at(documents.sparkSession, found, "near_copies")
    for path in search.paths.values():
        drop_folder(documents.sparkSession, path)
    return found


def least_shingles(hashes: np.ndarray) -> list[int]:
    """The least hash under four different orders; nothing without shingles."""
    return [int((hashes * np.uint64(m) ^ hashes >> np.uint64(31)).min().view(np.int64)) for m in _ORDER_FACTORS] if len(hashes) else []


def _in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds numbers that ascend with ``order``, by one within each task's range; to be staged before it is read twice."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def _beside(placed: DataFrame) -> DataFrame:
    """(a, b): texts with one least shingle and ``SHARED`` of all, at most ``BESIDE`` places apart."""
    own = [placed.select((F.col("place") + k).alias("place"), F.col("node").alias("x"), F.col("least").alias("x_least"), F.col("lead").alias("x_lead")) for k in range(1, BESIDE + 1)]
    met = reduce(DataFrame.union, own).join(placed, "place").where(F.col("least") == F.col("x_least"))
    shared = sum((F.get("lead", F.lit(k)) == F.get("x_lead", F.lit(k))).cast("int") for k in range(ORDERS))
    return met.where(shared >= SHARED).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))


def without_near_copies(documents: DataFrame, similarity: float = 0.8, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay if of each group of near copies one does: that with the smallest id, null last.

    Of rows that repeat this id, the one with the smallest digest stays, once. Null texts are copies of the empty text. Columns
    stay as they are.
    """
    spark = documents.sparkSession
    groups = similar_groups(documents, similarity, width, text_column=text_column)
    digest = F.sha2(F.coalesce(F.col(text_column), F.lit("")).cast("binary"), 256)
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("digest").alias("digest"))
    first = documents.select(F.col(id_column).alias("id"), digest.alias("digest")).groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))).alias("f"))
    kept = first.join(groups, "digest").select("component", F.col("f.id").alias("id"), "digest").groupBy("component").agg(F.min(order).alias("f"))
    # the id is part of the key, so copies of one text do not meet in a task
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    names = [free_name(documents, "digest"), free_name(documents, "key")]
    kept, _ = staged_at(spark, kept.select(F.col("f.digest").alias(names[0]), key(F.col("f.id")).alias(names[1])), "kept")
    marked = documents.withColumns({names[0]: digest, names[1]: key(F.col(id_column))})
    return marked.join(kept, names).dropDuplicates(names).select(*[F.col(f"`{c}`") for c in documents.columns])
