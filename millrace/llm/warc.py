"""Dictionary-compressed web archives: writing, deduplicating by payload, and reading back.

An archive file begins with a skippable Zstandard frame that holds a dictionary built from
the archive's own records; each record follows as a frame of its own, compressed with it. Each
task writes its rows as archives of bounded size straight to the target folder, under another
name first, so a task that runs again replaces what it wrote before.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import split_by_keys, written

ARCHIVE_BYTES = 24 << 20  # of records before compression
SAMPLE_BYTES, DICTIONARY_BYTES = 3 << 20, 96 << 10
LEAST_SHARED = 1000  # payloads shorter than this are always written
#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.zst"


def record(page_id: int | None, url: str, payload: bytes, payload_bytes: int, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit whose HTTP header keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The file of these records: dictionary frame, then a frame for each."""
    size, sample = 0, []
    for r in records[:: max(1, sum(map(len, records)) // SAMPLE_BYTES)]:
        sample.append(r[: SAMPLE_BYTES // 8])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample)
    except zstandard.ZstdError:  # too few or too equal records to train on: their bytes themselves
        dictionary = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *map(compressor.compress, records)])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers (names in lower case) and payload of each record of an archive file."""
    magic, size = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the beginning")
    held = data[8 : 8 + size]
    if held[:4] == FRAME:
        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=64 << 20)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).stream_reader(data[8 + size :], read_across_frames=True)
    whole, at = reader.read(), 0

    def headers(begin: int) -> tuple[dict[str, str], int]:
        end = whole.index(b"\r\n\r\n", begin)
        pairs = (line.partition(": ") for line in whole[begin:end].decode().split("\r\n")[1:])
        return {name.lower(): value for name, _, value in pairs}, end + 4

    while at < len(whole):
        warc, begin = headers(at)
        end = begin + int(warc["content-length"])
        http, payload = headers(begin)
        yield warc, http, whole[payload:end]
        at = end + 4


def with_references(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """``pages`` and ``_payload, _sha1, _refers``: of equal payloads, all but the one with the largest id refer to it.

    Only payloads of LEAST_SHARED bytes take part; equality is by SHA-256. A payload that
    very many pages share costs one row a task in the aggregate, and a join by its key whose
    skew adaptive execution can split. Pages whose payload no other page has (but for a few, by
    a Bloom filter) and shorter ones are not shuffled.
    """
    shown = pages.withColumn("_payload", F.coalesce(F.col(html), F.lit("")).cast("binary"))
    shown = shown.withColumns({"_sha1": F.sha1("_payload"), "_key": F.when(F.length("_payload") >= LEAST_SHARED, F.sha2("_payload", 256))})
    keys = shown.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.max(page_id).alias("_largest"), F.count("*").alias("_n")).filter("_n > 1")
    keys = written(keys.select(F.col("_key").alias("_k"), "_largest"), "shared")
    asked, alone = split_by_keys(shown, F.col("_key"), keys.select("_k"))
    joined = asked.join(keys, F.col("_key") == F.col("_k"), "left").drop("_k")
    refers = F.when(~F.col(page_id).eqNullSafe(F.col("_largest")), F.col("_largest"))
    return joined.unionByName(alone.withColumn("_largest", F.lit(None).cast("long"))).withColumn("_refers", refers).drop("_key", "_largest")


def write_archives(pages: DataFrame, target: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the pages as archives into the folder ``target`` (a URI); rows ``path, records, bytes`` when all are written.

    Payload: the html in UTF-8 (null: empty). A null url is empty. Repeated rows are records
    of their own: of equal payloads all rows with the largest id are responses; rows with
    null ids refer to it; where all ids are null, all are responses. An id with several payloads
    is a record for each. No rows: no files.
    """
    where, folder = fs.FileSystem.from_uri(target)
    where.create_dir(folder, recursive=True)
    pages = pages.select(page_id, url, html)
    rows = with_references(pages, page_id, html).select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.when(F.col("_refers").isNull(), F.col("_payload")).otherwise(F.lit(b"")).alias("payload"),
        F.length("_payload").cast("long").alias("size"), F.unhex("_sha1").alias("sha1"), F.col("_refers").cast("long").alias("refers"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (place, top) = TaskContext.get(), fs.FileSystem.from_uri(target)
        number = 0

        def put(records: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            name = f"{top}/part-{task.partitionId():06d}-{number:05d}{SUFFIX}"
            number += 1
            data = archive(records)
            with place.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
                out.write(data)
            place.move(f"{name}.{task.taskAttemptId()}", name)
            return pa.RecordBatch.from_pydict({"path": [name], "records": [len(records)], "bytes": [len(data)]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        records, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                records.append(record(r["page_id"], r["url"], r["payload"], r["size"], r["sha1"], r["refers"], date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield put(records)
                    records, size = [], 0
        if records:
            yield put(records)

    made = rows.sortWithinPartitions("page_id", "url", "sha1").mapInArrow(write, "path string, records long, bytes long")
    return written(made, "archives")  # one row an archive


_ID = re.compile(r"<urn:page:(-?\d+)>")


def read_archives(spark: SparkSession, target: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` and the payload.

    Length and SHA-1 (bare lower-case hex) are counted from the payload that is read; one that
    differs from its record's headers is an error. A revisit has none: its figures are those of
    the response that it refers to, by id, length and digest, and it is an error if there is none.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("payload", pa.binary())] * payload
    schema = pa.schema(fields)

    def number(value: str | None) -> int | None:
        found = _ID.fullmatch(value or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for warc, http, body in records_of(content.as_py()):
                    size, digest = int(http["content-length"]), base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if warc["warc-type"] == "response" and (size, digest) != (len(body), hashlib.sha1(body).hexdigest()):
                        raise ValueError(f"{warc['warc-record-id']}: the payload is not what its headers tell of")
                    row = {"page_id": number(warc["warc-record-id"]), "url": warc["warc-target-uri"], "record_type": warc["warc-type"], "refers_to": number(warc.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest}
                    rows.append(row | ({"payload": body} if payload else {}))
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(target).select("content")
    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    records = files.mapInArrow(read, ", ".join(f"{name} {kinds[str(kind)]}" for name, kind in fields))
    narrow = [name for name, _ in fields if name != "payload"]
    if not payload:
        records = written(records, "records")  # archives are read once
    first, again = records.filter("refers_to is null"), records.filter("refers_to is not null")
    known = first.filter("page_id is not null").select(F.col("page_id").alias("_of"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    # a page id that several payloads have is several responses: a revisit is held against the one of its own digest and length
    same = (F.col("refers_to") == F.col("_of")) & (F.col("payload_bytes") == F.col("_bytes")) & (F.col("payload_digest") == F.col("_digest"))
    again = again.join(known.distinct(), same, "left")
    missing = F.raise_error(F.concat(F.lit("no such response for the revisit "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("string")
    again = again.withColumn("payload_digest", F.when(F.col("_of").isNotNull(), F.col("_digest")).otherwise(missing))
    return first.unionByName(again.select(*narrow, *["payload"] * payload))
