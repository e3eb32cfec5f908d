"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

``write`` puts documents in key order into shards. A shard is three files below the store's folder: ``.bin`` holds nothing
but ids (16 bits each if the vocabulary allows, else 32, little-endian), ``.key`` the keys of all documents that have one (64
bits each), and ``.idx`` the arrays

* ``offset`` and ``nulls``: each document's first id in ``.bin``, and how many documents, the first ones, have a null key;
* ``level_size``, ``level_bits``, ``level_rank``: the minimal perfect hash of the shard's distinct keys;
* ``slot_print``, ``slot_first``, ``slot_rows``: per hash value a 32-bit fingerprint of its key, the first document with
  that key and how many follow (documents with one key lie side by side).

A lookup hashes the key, compares the fingerprint, and reads the ids at the stored place: constant time for each key. An
unknown key passes with a probability of 2^-32; ``fetch`` rules that out by the key at that place of ``.key``. The ``shards`` table, one row per shard
with its key range and the number of ids before it, is the directory; only files it names are part of the
store, so what a failed attempt has left behind is never read.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegraph.llm.common import attempt_name, open_store
from tidegraph.llm.tokenization import encoder

_GAMMA, _MOST_LEVELS = 2.0, 64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 2**64 - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class PerfectHash:
    """Distinct 64-bit keys to 0 .. n-1.

    Each level is a bit array twice as long as the keys that have not found a place yet; a key takes its place if no
    other key of the level falls on it. A key's value is the number of places taken before its own.
    """

    size: np.ndarray  # bits of each level, a multiple of 64
    bits: np.ndarray  # all levels' bits, in words of 64
    rank: np.ndarray  # places taken before each word

    @staticmethod
    def build(keys: np.ndarray) -> "PerfectHash":
        sizes, parts = [], []
        left = keys
        for level in range(_MOST_LEVELS):
            if not len(left):
                break
            size = -(-int(_GAMMA * len(left)) // 64) * 64
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys must be distinct")
        bits = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        return PerfectHash(np.array(sizes, np.int64), bits, rank)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of known keys; an unknown key gets any value, or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.size.tolist()):
            at = (_mixed(keys[rest], level) % np.uint64(size)).astype(np.int64)
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            held = self.bits[word]
            set_ = (held >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[rest[set_]] = (self.rank[word] + below)[set_]
            rest, base = rest[~set_], base + size // 64
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class Index:
    """Index of one shard."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        self.offset, self.nulls = arrays["offset"], int(arrays["nulls"])
        self.hash = PerfectHash(arrays["level_size"], arrays["level_bits"], arrays["level_rank"])

    @staticmethod
    def build(keys: np.ndarray, null: np.ndarray, offset: np.ndarray) -> "Index":
        """Equal keys must be neighbours, and null ones come first."""
        real = np.flatnonzero(~null)
        first = real[np.concatenate([[True], keys[real][1:] != keys[real][:-1]])] if len(real) else real
        rows = np.diff(np.append(first, len(keys))).astype(np.int64)
        made = PerfectHash.build(keys[first])
        slot = made.find(keys[first])
        arrays = {"offset": offset, "nulls": null.sum(), "level_size": made.size, "level_bits": made.bits, "level_rank": made.rank}
        for name, values, kind in (("slot_print", _fingerprints(keys[first]), "<u4"), ("slot_first", first, "<i8"), ("slot_rows", rows, "<i8")):
            arrays[name] = np.zeros(len(first), kind)
            arrays[name][slot] = values
        return Index(arrays)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents if no key here has its fingerprint."""
        slot = self.hash.find(keys)
        known = slot >= 0
        known[known] = self.arrays["slot_print"][slot[known]] == _fingerprints(keys[known])
        first = np.where(known, self.arrays["slot_first"][np.where(known, slot, 0)] if len(self.arrays["slot_first"]) else 0, 0)
        rows = np.zeros(len(keys), np.int64)
        rows[known] = self.arrays["slot_rows"][slot[known]]
        return first, rows

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> "Index":
        with np.load(io.BytesIO(raw)) as z:
            return Index({k: z[k] for k in z.files})


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None) -> str:
    """Encode all texts, each with ``end_id`` after it, and write them in ascending order of the key; returns ``folder``.

    The key is an integer column. Null keys come first; they are stored, but have no entry in the hash. Documents with equal
    keys are all stored, ordered by their text's hash, and may lie in several shards. Null and empty texts have the
    end id only. An empty table gives a store without shards. Other columns are not looked at.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = ["key", "tie"]
    spread = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        store, path = open_store(f"{folder}/data")
        name = attempt_name(f"shard-{part:06d}")
        keys, null, length, out = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}.bin", compression=None)
            null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(codes.ids(text) + end, "<u4").astype(codes.id_type)
                out.write(ids.tobytes())
                length.append(len(ids))
        if out is None:
            return
        out.close()
        offset = np.concatenate([[0], np.cumsum(length)]).astype("<i8")
        all_keys, all_null = np.concatenate(keys), np.concatenate(null)
        real = all_keys[~all_null]
        for end_of_name, raw in ((".idx", Index.build(all_keys, all_null, offset).to_bytes()), (".key", real.tobytes())):
            with store.open_output_stream(f"{path}/{name}{end_of_name}", compression=None) as f:
                f.write(raw)
        row = (part, name, codes.id_type, len(length), int(offset[-1]), int(real[0]) if len(real) else None, int(real[-1]) if len(real) else None)
        yield pa.RecordBatch.from_pylist([dict(zip(_SHARD.names, row))], schema=_SHARD)

    spread.sortWithinPartitions(*order).select("key", "text").mapInArrow(put, "shard int, name string, id_type string, documents long, tokens long, low long, high long").write.parquet(f"{folder}/shards")
    return folder


_SHARD = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("id_type", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with the number of ids in the shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{folder}/shards").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class Shard:
    """Open shard."""

    def __init__(self, folder: str, name: str, id_type: str) -> None:
        store, path = open_store(f"{folder}/data")
        with store.open_input_file(f"{path}/{name}.idx") as f:
            self.index = Index.from_bytes(f.read())
        self.payload, self.id_type = store.open_input_file(f"{path}/{name}.bin"), np.dtype(id_type)
        self.stored = store.open_input_file(f"{path}/{name}.key")

    def keys(self) -> np.ndarray:
        """Of all documents that have one, in their order."""
        return np.frombuffer(self.stored.read_at(self.stored.size(), 0), "<i8")

    def key(self, document: int) -> int:
        return int(np.frombuffer(self.stored.read_at(8, 8 * (document - self.index.nulls)), "<i8")[0])

    def ids(self, document: int) -> np.ndarray:
        a, z = self.index.offset[document:document + 2].tolist()
        return np.frombuffer(self.payload.read_at((z - a) * self.id_type.itemsize, a * self.id_type.itemsize), self.id_type).astype("<u4")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every stored document, read back from the files through the index.

    Each key is looked up, and the index says which documents it has and where their ids lie; documents with a null key are
    the first ones of their shard.
    ``start`` counts the ids of all documents before it. The CRC-32 is that of the ids as little-endian 32-bit integers.
    """
    shards = directory(spark, folder).select("shard", "name", "id_type", "base")
    spread = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")

    def get(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tables:
            for row in pdf.itertuples():
                shard = Shard(folder, row.name, row.id_type)
                index, keys = shard.index, shard.keys()
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
                first, copies = index.find(keys)
                if not copies.all():
                    raise ValueError(f"{row.name}: the index does not find {int((copies == 0).sum())} keys")
                documents = np.repeat(first - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
                documents = np.concatenate([np.arange(index.nulls), documents])
                keys = pd.arrays.IntegerArray(np.concatenate([np.zeros(index.nulls, np.int64), np.repeat(keys, copies)]), np.arange(len(documents)) < index.nulls)
                for k in range(0, len(documents), 4096):
                    some = documents[k:k + 4096]
                    yield pd.DataFrame({
                        "key": keys[k:k + 4096], "start": index.offset[some] + row.base, "n_tokens": index.offset[some + 1] - index.offset[some],
                        "ids_crc32": [zlib.crc32(shard.ids(d).tobytes()) for d in some.tolist()],
                    })

    return spread.mapInPandas(get, "key long, start long, n_tokens long, ids_crc32 long")


def fetch(keys: DataFrame, folder: str, column: str) -> DataFrame:
    """(key, ids) of all stored documents whose key is among ``keys``, by lookups in the shards that can hold it.

    The key ranges of the shards (16 bytes a shard) go to every task. Unknown and null keys give no row; a key asked for twice
    is answered once.
    """
    spark = keys.sparkSession
    shards = directory(spark, folder).where(F.col("low").isNotNull()).orderBy("shard").select("shard", "name", "id_type", "low", "high").toPandas()
    low, high, names, kind = shards["low"].to_numpy(np.int64), shards["high"].to_numpy(np.int64), shards["name"].tolist(), shards["id_type"].tolist()

    def route(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tables:
            k = pdf["key"].to_numpy(np.int64)
            a, z = np.searchsorted(high, k, "left"), np.searchsorted(low, k, "right")  # shards a .. z-1 can hold it
            n = np.maximum(z - a, 0)
            yield pd.DataFrame({"key": np.repeat(k, n), "place": np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)})

    def get(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, Shard] | None = None
        for pdf in tables:
            for place, group in pdf.groupby("place", sort=False):
                if held is None or held[0] != place:
                    held = (place, Shard(folder, names[place], kind[place]))
                asked = group["key"].to_numpy(np.int64)
                first, rows = held[1].index.find(asked)
                out = [(key, held[1].ids(d).astype(np.int64)) for key, f, n in zip(asked.tolist(), first.tolist(), rows.tolist()) if n and held[1].key(f) == key for d in range(f, f + n)]
                yield pd.DataFrame(out, columns=["key", "ids"])

    wanted = keys.select(F.col(column).cast("long").alias("key")).where(F.col(column).isNotNull()).distinct()
    routed = wanted.mapInPandas(route, "key long, place long")
    return routed.repartition("place").sortWithinPartitions("place").mapInPandas(get, "key long, ids array<long>")
