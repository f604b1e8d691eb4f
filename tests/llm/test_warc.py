"""Round trips, and magic inside payloads, over one and over many splits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from casefile.llm import warc

SCHEMA = "page_id long, url string, html string, id string"


def _inner(n):
    body = "x" * n
    return f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"


ROWS = [
    (1, "http://a/1", "plain", "z"),
    (2, None, None, None),
    (3, "http://a/3", "", "z"),
    (4, "http://a/4", "y" * 100, "z"),
    (5, "http://a/5\r\nX: 1", "y" * 100, "z"),
    (6, "http://a/6", "y" * 99, "z"),
    (7, "http://a/7", "y" * 99, "z"),
    (8, "http://a/8", "head " + _inner(50) + _inner(7) + "tail", "z"),
    (9, "http://a/9", "WARC/1.1\r\n", "z"),
    (10, "http://a/10", "é\r\n\r\n" * 40 + "WARC/1.", "z"),
    (11, "http://a/11", _inner(3000) * 30, "z"),
    (12, "http://a/12", "WARC/1.1\r\nContent-Length: 9999999\r\n\r\n", "z"),
]


def _expected(rows):
    first = {}
    for i, _, html, _ in sorted(rows, key=lambda r: r[0]):
        if len((html or "").encode()) >= 100:
            first.setdefault(html, i)
    out = set()
    for i, _, html, _ in rows:
        data = (html or "").encode()
        of = first.get(html, i) if len(data) >= 100 else i
        out.add((i, len(data), hashlib.sha256(data).hexdigest(), "response" if of == i else "revisit", None if of == i else of))
    return out


def test_round_trip(spark):
    got = warc.archived(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert {tuple(r) for r in got} == _expected(ROWS) and len(got) == len(ROWS)


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("split", [6000, 20000])
def test_many_splits(spark, tmp_path, split):
    rows = [(i, f"http://a/{i}", _inner(i % 7 * 40) * (i % 5) + "p" * (i * 13 % 900), "z") for i in range(80)]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"), compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_warc(spark, str(tmp_path / "w")).select(F.col("headers")["warc-record-id"], "payload", F.col("headers")["warc-type"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 80
    by = {r[0]: bytes(r[1]).decode() for r in got if r[2] == "response"}
    want = {f"<urn:page:{i}>": html for i, _, html, _ in rows}
    assert all(want[k] == v for k, v in by.items())


def test_broken_chain_stops(spark, tmp_path):
    good = _inner(10)
    (tmp_path / "a.warc").write_bytes((good + "WARC/1.1\r\nContent-Length: 5\r\n\r\n123456789\r\n\r\n" + good).encode())
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(("x" + good).encode())
    (tmp_path / "d.warc").write_bytes((good + good[:-9]).encode())
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.file[-6:], r.offset, bytes(r.payload)) for r in got) == [("a.warc", 0, b"x" * 10), ("a.warc", len(good), b"12345"), ("d.warc", 0, b"x" * 10)]


def test_magic_in_urls(spark, tmp_path):
    urls = ["http://x/WARC/1.0/spec", "http://x/WARC/1.", "WARC/1.1\r\n", "http://x/WARC/1.WARC/1.1", "http://x/a"]
    rows = [(i, urls[i % 5], "same " * 30 if i % 2 else f"page {i} WARC/1.1\r\n", "z") for i in range(20)]
    got = warc.archived(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert {tuple(r) for r in got} == _expected(rows) and len(got) == len(rows)
    raw = b"".join(f"WARC/1.1\r\nWARC-Target-URI: {u.strip()}\r\nContent-Length: 4\r\n\r\nab{i:02}\r\n\r\n".encode() for i, u in enumerate(urls))
    (tmp_path / "other.warc").write_bytes(raw)  # of a writer that leaves the magic as it is
    found = sorted(warc.read_warc(spark, str(tmp_path / "other.warc")).collect(), key=lambda r: r.offset)
    assert [(r.headers["warc-target-uri"], bytes(r.payload)) for r in found] == [(u.strip(), f"ab{i:02}".encode()) for i, u in enumerate(urls)]


def test_open_heads_in_linear_time():
    """One payload that looks like the start of a head over and over, far longer than any head that is real."""
    import time

    import pyarrow as pa

    data = b"WARC/1.1\r\nfoo: " * 70_000 + b"x\r\nContent-Length: 5\r\n\r\n"
    pieces = data.split(warc.MAGIC)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(pieces)), pa.array([0] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["file", "block", "piece"])
    began = time.perf_counter()
    rows = [r for b in warc._cut(iter([batch.slice(0, 1000), batch.slice(1000)])) for r in b.to_pylist()]
    assert time.perf_counter() - began < 20
    assert len(rows) == 70_001 and {r["after"] for r in rows if r["rel"] >= 0} == {len(data) + 5 + 4}  # all end where the blank line says
    # the first head is one record whose headers hold all the others
    assert min(r["rel"] for r in rows if r["rel"] >= 0) == 0


def test_heads_that_magics_cut():
    import random

    import pyarrow as pa

    own = random.Random(3)
    parts = [b"WARC/1.1\r\n", b"WARC/1.", b"foo: x\r\n", b"Content-Length: 12\r\n", b"content-length: a\r\n", b"Content-Length: ", b"\r\n", b"\r\n\r\n", b"\r", b"\n", b"abc", b"1\r\n", b"Content-Length:WARC/1.1\r\n", b"5"]
    for _ in range(3000):
        data = b"WARC/1.1\r\n" + b"".join(own.choices(parts, k=own.randint(1, 14)))
        pieces = data.split(warc.MAGIC)
        batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(pieces)), pa.array([0] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["file", "block", "piece"])
        got = {r["rel"]: r["after"] for b in warc._cut(iter([batch])) for r in b.to_pylist() if r["rel"] >= 0}
        at = 0
        for n, piece in enumerate(pieces[1:], 1):  # the head as it would be read with everything behind it
            rel = at + len(pieces[0])
            assert got[rel] == warc._after(rel, warc._parsed(warc.MAGIC.join(pieces[n:]))), data
            at += len(warc.MAGIC) + len(piece)
