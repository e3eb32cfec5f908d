"""WARC archives: a writer with revisit records, and a salvage reader.

An archive holds one gzip member per record. The reader checks every member (checksum, version line, header block,
length, digest). After a failed check it looks for the next place where a valid record begins - a gzip member that
decompresses to a version line, or a bare version line, whatever stands before it - goes on from there, and reports the
bytes in between as a gap. Nothing that can be read is given up, and every byte of a file is in a record or in a gap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegraph.llm.common import attempt_name, open_store, staged_at

LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
_MAGIC = b"\x1f\x8b\x08"
_WINDOW = 1 << 20
_END = b"\r\n\r\n"


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]  # names in lower case
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(Exception):
    pass


class _File:
    """Random access to a stored file through a window."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size, self.base, self.held = source, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.base <= start and start + n <= self.base + len(self.held)):
            self.base, self.held = start, self.source.read_at(min(max(n, _WINDOW), self.size - start), start)
        return self.held[start - self.base:start - self.base + n]

    def find(self, what: tuple[bytes, ...], start: int) -> int:
        """First place of any of the byte strings from ``start`` on, or the end of the file."""
        overlap = max(map(len, what)) - 1
        while start < self.size:
            part = self.get(start, _WINDOW)
            hits = [h for h in (part.find(w) for w in what) if h >= 0]
            if hits:
                return start + min(hits)
            if start + len(part) >= self.size:
                break
            start += max(1, len(part) - overlap)
        return self.size


def _headers(block: bytes) -> dict[str, str]:
    lines = block.split(b"\r\n")
    if lines[0] + b"\r\n" not in _VERSIONS:
        raise Damaged("no version line")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not out.get("content-length", "").isdigit() or not {"warc-type", "warc-record-id"} <= set(out):
        raise Damaged("bad header block")
    return out


def _checked(start: int, end: int, headers: dict[str, str], block: bytes) -> Record:
    want = headers.get("warc-block-digest")
    if want and want.lower().startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:].lower():
        raise Damaged("block digest differs")
    return Record(start, end, headers, block)


def _member(f: _File, start: int, head_only: bool = False) -> Record | None:
    """The record in the gzip member at ``start``; with ``head_only`` None if it begins with a version line."""
    inflate, out, at = zlib.decompressobj(31), bytearray(), start
    try:
        while not inflate.eof:
            part = f.get(at, 1 << 16)
            if not part:
                raise Damaged("member is cut off")
            out += inflate.decompress(part, 64 if head_only else 0)
            at += len(part)
            if head_only and (len(out) >= 10 or inflate.eof):
                if bytes(out[:10]) not in _VERSIONS:
                    raise Damaged("no version line")
                return None
    except zlib.error as e:
        raise Damaged("bad gzip member") from e
    end = at - len(inflate.unused_data)
    head = out.find(_END)
    if head < 0:
        raise Damaged("no header block")
    headers = _headers(bytes(out[:head]))
    body = head + 4
    if len(out) != body + int(headers["content-length"]) + 4 or out[-4:] != _END:
        raise Damaged("length differs")
    return _checked(start, end, headers, bytes(out[body:-4]))


def _bare(f: _File, start: int, head_only: bool = False) -> Record | None:
    """The uncompressed record at ``start``."""
    if head_only:
        return None
    head = f.find((_END,), start)
    if head == f.size:
        raise Damaged("no header block")
    headers = _headers(f.get(start, head - start))
    body, n = head + 4, int(headers["content-length"])
    if body + n + 4 > f.size or f.get(body + n, 4) != _END:
        raise Damaged("length differs")
    return _checked(start, body + n + 4, headers, f.get(body, n))


def _read_at(f: _File, start: int, head_only: bool = False) -> Record | None:
    if f.get(start, 3) == _MAGIC:
        return _member(f, start, head_only)
    if f.get(start, 10) in _VERSIONS:
        return _bare(f, start, head_only)
    raise Damaged("no record begins here")


def _next_start(f: _File, start: int) -> int:
    """First place from ``start`` on where a record may begin."""
    while True:
        start = f.find((_MAGIC, *_VERSIONS), start)
        if start >= f.size:
            return f.size
        try:
            _read_at(f, start, head_only=True)
            return start
        except Damaged:
            start += 1


def salvage(source, size: int) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, in order; they cover it without overlap.

    ``source`` has ``read_at(n, start)``. One record is in memory at once. A place that looks like a beginning but fails its
    checks belongs to the gap. An empty file gives nothing.
    """
    f, at, gap, reason = _File(source, size), 0, None, ""
    while at < size:
        try:
            record = _read_at(f, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = _next_start(f, at + 1)
            continue
        if gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        yield record
        at = record.end
    if gap is not None:
        yield Gap(gap, size, reason)


def record_bytes(kind: str, key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has the HTTP header only; its payload's digest and length are in the WARC header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {DATE}"]
    if url is not None and not set(url) & {"\r", "\n"}:
        lines.append(f"WARC-Target-URI: {url}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    raw = b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + _END + block + _END
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def referred(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """key, url, html, digest and, for repeated payloads of at least ``least`` bytes, the smallest key with that payload.

    Payloads are compared by SHA-256 and length. Only keys and digests meet in the join; a payload that a third of all
    pages share is reduced to its smallest key by each task first.
    """
    rows = pages.select("key", "url", "html", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    narrow = pages.select("key", F.octet_length("html").alias("n"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    narrow, _ = staged_at(pages.sparkSession, narrow.where((F.col("n") >= least) & F.col("key").isNotNull()), "payloads")
    first = narrow.groupBy("digest", "n").agg(F.min("key").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = narrow.join(first, ["digest", "n"]).where(F.col("key") != F.col("first")).select("key", "first").distinct()
    return rows.join(later, "key", "left")


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One record per row, in archives below ``folder``; returns their table (name, records, bytes), staged there.

    The payload is the html in UTF-8, null is empty. Of equal payloads of at least 100 bytes, the record with the smallest key
    is a response and the others are revisits of it; all others are responses. Rows with a null key are responses with the
    key "null". Rows that repeat a key are all written; those that also repeat the smallest key's payload are responses. An
    empty table writes no archive.
    """
    spark = pages.sparkSession
    rows = referred(pages.select(F.col(id_column).alias("key"), F.col(url_column).alias("url"), F.coalesce(html_column, F.lit("")).alias("html")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(f"{folder}/archives")
        name, out, records = f"{attempt_name(f'pages-{TaskContext.get().partitionId():06d}')}.warc.gz", None, 0
        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            for key, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if first is None else "revisit"
                out.write(record_bytes(kind, "null" if key is None else str(key), url, html.encode("utf-8", "surrogatepass"), digest, None if first is None else str(first)))
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [records], "bytes": [size]})

    rows.select("key", "url", "html", "digest", "first").mapInArrow(put, "name string, records long, bytes long").write.parquet(f"{folder}/table")
    return spark.read.parquet(f"{folder}/table")


_FIELDS = "archive string, start long, end long, reason string, type string, key string, url string, digest string, payload_bytes long, refers_to string"


def read(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """All records and gaps of archives in ``folder``; columns archive, start, end, reason (null: a record), and the record's.

    ``archives`` has the column name. A record whose payload does not have the digest or the length its header states is a
    gap. ``payloads`` adds the payload of responses.
    """
    spark = archives.sparkSession
    spread = archives.select("name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")

    def get(tables: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(f"{folder}/archives")
        for names in tables:
            for name in names.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as f:
                    rows: list[dict] = []
                    held = 0
                    for x in salvage(f, f.size()):
                        row = _row(name, x, payloads)
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=shape)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)

    fields = [pa.field(n, pa.int64() if k == "long" else pa.string()) for n, k in (f.split() for f in _FIELDS.split(", "))]
    shape = pa.schema(fields + [pa.field("payload", pa.binary())] * payloads)
    return spread.mapInArrow(get, _FIELDS + ", payload binary" * payloads)


def _row(name: str, x: Record | Gap, payloads: bool) -> dict:
    if isinstance(x, Gap):
        return {"archive": name, "start": x.start, "end": x.end, "reason": x.reason}
    h = x.headers
    place = {"archive": name, "start": x.start, "end": x.end}
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    stated = h.get("x-payload-length", "")
    payload = x.block.partition(_END)[2]
    if h["warc-type"] == "response":
        if digest and hashlib.sha256(payload).hexdigest() != digest:
            return place | {"reason": "payload digest differs"}
        if stated and int(stated) != len(payload):
            return place | {"reason": "payload length differs"}
        digest, stated = digest or hashlib.sha256(payload).hexdigest(), str(len(payload))
    named = lambda v: v.removeprefix("<urn:page:").removesuffix(">") if v else None
    row = place | {
        "type": h["warc-type"], "key": named(h["warc-record-id"]), "url": h.get("warc-target-uri"), "digest": digest or None,
        "payload_bytes": int(stated) if stated.isdigit() else None, "refers_to": named(h.get("warc-refers-to")),
    }
    return row | {"payload": payload if h["warc-type"] == "response" else None} if payloads else row


def archived(spark: SparkSession, pages: DataFrame, folder: str, id_column: str = "page_id") -> DataFrame:
    """Writes ``pages`` and returns what the reader finds in the archives."""
    return read(write(pages, folder, id_column), folder)
