import gzip
import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from tidegraph.llm import warc
from tidegraph.llm.common import open_store, own_folder, prepare
from tidegraph.llm.queries import QUERIES
from tidegraph.llm.warc import Gap, Record


def archive(n, rng):
    """Records as (key, raw bytes)."""
    out = []
    for k in range(n):
        payload = bytes(rng.choices(b"abc<>\r\n WARC/1.1\r\n\x1f\x8b\x08", k=rng.choice([0, 1, 50, 3000])))
        out.append((str(k), warc.record_bytes("response", str(k), f"http://x/{k}", payload, hashlib.sha256(payload).hexdigest(), None)))
    return out


def found(raw):
    rows = list(warc.salvage(pa.BufferReader(raw), len(raw)))
    at = 0
    for x in rows:
        assert x.start == at and x.end > at
        at = x.end
    assert at == len(raw)
    return [x.headers["warc-record-id"][10:-1] for x in rows if isinstance(x, Record)], [x for x in rows if isinstance(x, Gap)]


@pytest.mark.parametrize("window", [1 << 20, 97])
def test_later_records_are_recovered(monkeypatch, window):
    monkeypatch.setattr(warc, "_WINDOW", window)
    rng = random.Random(1)
    for trial in range(30):
        parts = archive(8, rng)
        if trial % 2:  # uncompressed
            parts = [(k, gzip.decompress(raw)) for k, raw in parts]
        assert found(b"".join(raw for _, raw in parts)) == ([k for k, _ in parts], [])
        hurt, pieces = set(), []
        for k, raw in parts:
            kind = rng.choice(["keep", "keep", "flip", "cut", "noise", "lost head"])
            if kind == "flip":
                at = rng.randrange(len(raw))
                raw = raw[:at] + bytes([raw[at] ^ 1 << rng.randrange(8)]) + raw[at + 1:]
            elif kind == "cut":
                raw = raw[:rng.randrange(1, len(raw))]
            elif kind == "lost head":
                raw = raw[12:]
            elif kind == "noise":
                raw = bytes(rng.choices(range(256), k=40)) + b"\n" + raw
            if kind not in ("keep", "noise"):
                hurt.add(k)
            pieces.append(raw)
        got, gaps = found(b"".join(pieces))
        whole = [k for k, _ in parts if k not in hurt]
        assert [k for k in got if k not in hurt] == whole  # a flipped bit may hit a byte that is not checked
        assert gaps or len(got) == len(parts)


def test_places_and_reasons_of_gaps():
    a, b, c = (raw for _, raw in archive(3, random.Random(3)))
    assert found(a + b"junk" + b + c[:-5]) == (["0", "1"], [Gap(len(a), len(a) + 4, "no record begins here"), Gap(len(a + b) + 4, len(a + b + c) - 1, "member is cut off")])
    assert found(b"") == ([], []) and found(b"x") == ([], [Gap(0, 1, "no record begins here")])
    wrong = zlib.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n", wbits=31)
    assert [g.reason for g in found(wrong + a)[1]] == ["bad header block"]


PAGES = [
    (5, "http://a", "x" * 100), (3, "http://b", "x" * 100), (9, "http://c", "x" * 100), (4, "http://d", "x" * 99), (6, None, "x" * 99), (7, "http://e\r\nEvil: 1", None), (8, "u", ""), (2, "é", "ä" * 50),
    (1, "u", "ä" * 50), (None, "n", "x" * 100), (11, "u", "WARC/1.1\r\n\r\n" * 2000), (12, "u", "y" * 300), (12, "u", "y" * 300), (13, "u", "y" * 300), (14, "u", "long " * 200_000),
]


def test_pages_round_trip(spark):
    prepare(spark)
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    folder = own_folder(spark, "test_warc")
    table = warc.write(df, folder)
    rows = warc.read(table, folder, payloads=True).collect()
    assert all(r.reason is None for r in rows)
    first = {}
    for key, _, html in PAGES:
        if html and len(html.encode()) >= 100 and key is not None:
            first[html] = min(first.get(html, key), key)
    want = []
    for key, url, html in PAGES:
        raw = (html or "").encode()
        lead = first.get(html)
        revisit = key is not None and lead is not None and key != lead
        want.append((str(key).replace("None", "null"), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", str(lead) if revisit else None, None if revisit else raw))
    got = [(r.key, r.payload_bytes, r.digest, r.type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)

    name = table.first()["name"]
    store, path = open_store(f"{folder}/archives")
    with store.open_input_file(f"{path}/{name}") as f:
        raw = bytearray(f.read())
    raw[20] ^= 255
    with store.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(bytes(raw))
    again = warc.read(table, folder).collect()
    gaps = [r for r in again if r.reason is not None]
    assert len(again) == len(rows) and [(g.archive, g.start) for g in gaps] == [(name, 0)] and gaps[0].key is None
    assert warc.archived(spark, df.limit(0), own_folder(spark, "test_warc")).collect() == []


def test_query_with_null_and_repeated_rows(spark, tmp_path):
    prepare(spark)
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op6_warc_salvage"](spark, str(tmp_path)).collect()]
    assert len(got) == len(PAGES) and (None, 100, "response", None) in got and (5, 100, "revisit", 3) in got and (7, 0, "response", None) in got
    assert got.count((12, 300, "response", None)) == 2 and (13, 300, "revisit", 12) in got
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert QUERIES["op6_warc_salvage"](spark, f"{tmp_path}/none").collect() == []
