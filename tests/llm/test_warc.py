"""Archives: round trips, revisits, and the dictionary frame."""

import hashlib
import struct
from glob import glob

import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.llm import warc
from millrace.llm.queries import op4_warc


def test_archive_layout_and_round_trip():
    rows = [(i, f"https://a.example/{i}", (f"<p>page {i}\r\n\r\n" + "shared words here " * (i % 90)).encode()) for i in range(400)]
    records = [warc.record(i, u, p, len(p), hashlib.sha1(p).digest(), None, "2000-01-01T00:00:00Z") for i, u, p in rows]
    data = warc.archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    held = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    dictionary = zstandard.ZstdCompressionDict(held)
    # each record is a frame of its own, and the dictionary opens it
    frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert frame.decompress(data[8 + size :]) == records[0] and frame.unused_data
    assert [(w["warc-record-id"], p) for w, _, p in warc.records_of(data)] == [(f"<urn:page:{i}>", p) for i, _, p in rows]
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - size < plain


def test_small_archives():
    for payloads in ([b""], [b"x"], [b"a" * 5000] * 3):
        records = [warc.record(None, "", p, len(p), b"\0" * 20, None, "d") for p in payloads]
        assert [p for *_, p in warc.records_of(warc.archive(records))] == payloads


def test_revisits_nulls_repeats_and_clashes(spark, tmp_path, monkeypatch):
    big, other = "é" * 500, "b" * 1000
    rows = [(1, "u", big), (9, "u\r\nX: y é", big), (5, None, big), (None, "u", big), (2, "u", "a" * 999), (3, "u", "a" * 999), (4, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (8, "u", "c" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_payload", F.lit("clash"))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    made = warc.write_archives(pages, f"file://{tmp_path}/a")
    assert sum(r.records for r in made.collect()) == len(rows)
    assert len(glob(f"{tmp_path}/a/*.warc.zst")) == made.count() > 1
    got = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    by = {(r.page_id, r.payload_bytes): r for r in got}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        r = by[i, len(raw)]
        assert r.payload_digest == hashlib.sha1(raw).hexdigest()
        refers = 9 if html == big and i != 9 else None
        assert (r.record_type, r.refers_to) == (("response", None) if refers is None else ("revisit", 9))
        assert r.payload == (raw if refers is None else b"")
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/b").count() == 0
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_a_damaged_payload_is_an_error(spark, tmp_path):
    good = b"a payload " * 200
    digest = hashlib.sha1(good).digest()
    fine = warc.record(1, "u", good, len(good), digest, None, "d")
    cases = {
        "fine": [fine, warc.record(2, "u", b"", len(good), digest, 1, "d")],
        "byte": [fine.replace(b"payload", b"paxload", 1)],
        "revisit": [fine, warc.record(2, "u", b"", len(good), hashlib.sha1(b"").digest(), 1, "d")],
        "missing": [fine, warc.record(2, "u", b"", len(good), digest, 3, "d")],
    }
    for name, records in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"x{warc.SUFFIX}").write_bytes(warc.archive(records))
        read = lambda: warc.read_archives(spark, f"file://{tmp_path}/{name}", payload=False).collect()  # noqa: B023, E731
        if name == "fine":
            assert {r.payload_digest for r in read()} == {digest.hex()}
        else:
            with pytest.raises(Exception, match="headers|revisit"):
                read()


def test_query_over_a_whole_table(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    largest = {}
    for i, p in pages.items():
        largest[p] = max(i, largest.get(p, i))
    rows = op4_warc(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        p = pages[r.page_id]
        to = largest[p] if len(p) >= 1000 and largest[p] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), hashlib.sha1(p).hexdigest(), "revisit" if to is not None else "response", to)


def test_an_id_with_two_payloads(spark, tmp_path):
    long = {x: x * 3000 for x in "AB"}
    rows = [(5, long["A"]), (5, long["B"]), (3, long["A"]), (2, long["B"])]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    sha = {x: hashlib.sha1(long[x].encode()).hexdigest() for x in "AB"}
    assert got == {(5, "response", None, sha["A"]), (5, "response", None, sha["B"]), (3, "revisit", 5, sha["A"]), (2, "revisit", 5, sha["B"])}
