"""Token ids as flat binary files with 64-bit document offsets, to be memory-mapped.

A folder holds, for each part of the order of documents, a file of ids (unsigned 16 or 32-bit,
little-endian, as the vocabulary needs) and an index: document ids, and the offset of each document
in the ids of all parts. Texts are dealt by ranges of the order and encoded where they are written, so a
part is one task's stream of bounded memory whatever is in it. Each part first tells its own
total; running sums of these totals are the parts' bases, and indexes are written with them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from math import ceil
from re import compile as pattern
from struct import Struct, calcsize, pack, unpack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import blocks, text_of, written
from millrace.operators.ordered import in_order

PART_BYTES = 384 << 20  # of texts whose ids are in a file, about
BLOCK = 1 << 20  # characters encoded at once
MOST_WORDS, LONGEST = 300_000, 64  # words remembered by a task, and characters of one
READ_DOCS, READ_IDS = 20_000, 8 << 20  # documents of a reading task, and ids of one of its batches
#: An index begins with: mark, bytes of an id, documents, those of them without an id (they come first).
HEAD, MARK = "<8sQQQ", b"TOKENS01"
HEAD_BYTES = calcsize(HEAD)
#: The rules of a file whose words can be encoded one by one; characters whose case and kind are the same everywhere, and how the rules split them.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}
PLAIN = pattern("[!-~À-ÖØ-öø-įı-ž]+")
PARTS = pattern("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-įı-ž]+|[0-9]|[^a-z0-9À-ÖØ-öø-įı-ž]+")


class Words:
    """Ids of texts by the library, each word once while it is remembered.

    That holds for files with the RULES above: they compose characters, which never joins a
    space to others, drop white space, and merge within words alone; so a text's ids are those of its
    words, one after the other. Words of PLAIN characters are lower-cased and split here and merged
    by the library's model; others go through the whole library. With any other rules, whole texts do.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = max(end_id, *self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.pack = Struct("<H" if size <= 1 << 16 else "<I").pack
        self.end = self.pack(end_id)
        told = json.loads(self.library.to_str())
        added = all(t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"])
        self.by_words = added and {k: told[k] for k in RULES} == RULES
        self.known: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}
        # each byte's character in the vocabulary: itself where it is printable, else one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.characters = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, word: str) -> bytes:
        """Ids of a word of PLAIN characters."""
        low = word.lower()
        ids = self.merged.get(low)
        if ids is not None:
            return ids
        out = []
        for part in [low] if low.isalpha() else PARTS.findall(low):
            ids = self.merged.get(part)
            if ids is None:
                shown = part if part.isascii() else part.encode().decode("latin1").translate(self.characters)
                ids = b"".join([self.pack(t.id) for t in self.library.model.tokenize(shown)])
                if len(part) <= LONGEST:
                    self.merged[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, the end id last."""
        if not self.by_words:
            return [ids + self.end for ids in self._whole(texts)]
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > MOST_WORDS:
            self.known = {}
        if len(self.merged) > MOST_WORDS:
            self.merged = {}
        own = self.known
        new = set().union(*split) - own.keys()
        odd = [w for w in new if not PLAIN.fullmatch(w) or "<|" in w]
        coded = dict(zip(odd, self._whole(odd), strict=True))
        coded |= {w: self._plain(w) for w in new.difference(odd)}
        long = {w: coded.pop(w) for w in new if len(w) > LONGEST}
        own.update(coded)
        if long:
            own = own | long
        return [b"".join(map(own.__getitem__, words)) + self.end for words in split]


def _put(place: fs.FileSystem, path: str, chunks: Iterator[bytes]) -> None:
    """Write a file under another name first: an attempt that is repeated replaces it whole."""
    attempt = f"{path}.{TaskContext.get().taskAttemptId()}"
    with place.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
    place.move(attempt, path)


def write_ids(docs: DataFrame, tokenizer: str, target: str, end_id: int, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the documents' ids in ascending order of ``doc_id`` into the folder ``target`` (a URI); rows ``part, docs, nulls, tokens, base``.

    Null ids come first; rows that repeat an id are documents of their own, ordered by a checksum of
    their texts, so one id that very many rows have is dealt over parts too. Null and
    empty texts are the end id alone. Other columns take no part. No rows: no files. The rows are read
    three times (sizes, bounds of the ranges, texts), and must be the same each time.
    """
    where, folder = fs.FileSystem.from_uri(target)
    where.create_dir(folder, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(ceil(total / part_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, ceil(total / (1 << 20))), 1)
    rows = rows.withColumns({"crc": F.crc32("text"), "size": F.octet_length("text")})
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("size")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    kind = Words(tokenizer, end_id).kind

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (place, top) = TaskContext.get().partitionId(), fs.FileSystem.from_uri(target)
        words = Words(tokenizer, end_id)
        names, sizes = [], []

        def ids() -> Iterator[bytes]:
            for batch in batches:
                names.append(batch.column("doc_id"))
                for texts in blocks(batch.column("text"), BLOCK):
                    coded = words.encode(texts)
                    sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)) // kind.itemsize)
                    yield b"".join(coded)

        first = next(batches, None)
        if first is None or not len(first):
            return
        batches = (b for rest in ([first], batches) for b in rest)
        _put(place, f"{top}/part-{part:06d}.ids", ids())
        documents = pa.chunked_array(names)
        plain = documents.fill_null(0).to_numpy().astype("<i8")
        ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
        head = pack(HEAD, MARK, kind.itemsize, len(plain), documents.null_count)
        _put(place, f"{top}/part-{part:06d}.local", iter((head, plain.tobytes(), np.concatenate([[0], ends]).astype("<u8").tobytes())))
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(plain)], "nulls": [documents.null_count], "tokens": [int(ends[-1])]}, pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]))

    fields = "part long, docs long, nulls long, tokens long"
    told = written(dealt.mapInArrow(write, fields), "parts")
    based = in_order(told, ["part"], sums={"upto": F.col("tokens")}).select("part", "docs", "nulls", "tokens", (F.col("upto") - F.col("tokens")).alias("base"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = fs.FileSystem.from_uri(target)
        for batch in batches:
            for part, docs, base in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "base")), strict=True):
                with place.open_input_file(f"{top}/part-{part:06d}.local") as local:
                    head = local.read(HEAD_BYTES + 8 * docs)
                    offsets = np.frombuffer(local.read(), "<u8") + np.uint64(base)
                _put(place, f"{top}/part-{part:06d}.index", iter((head, offsets.astype("<u8").tobytes())))
            yield batch

    return written(based.mapInArrow(finish, f"{fields}, base long"), "indexes")


class Mapped:
    """One part, mapped into memory where it is on a local disk, else read in ranges."""

    def __init__(self, place: fs.FileSystem, path: str):
        self.index = self._open(place, f"{path}.index")
        mark, width, self.docs, self.nulls = unpack(HEAD, self._bytes(self.index, 0, HEAD_BYTES))
        if mark != MARK:
            raise ValueError(f"{path}: not an index of token files")
        self.kind, self.ids = np.dtype(f"<u{width}"), self._open(place, f"{path}.ids")
        self.base = int(self.offsets(0, 0)[0])

    @staticmethod
    def _open(place: fs.FileSystem, path: str):
        return pa.memory_map(path) if isinstance(place, fs.LocalFileSystem) else place.open_input_file(path)

    @staticmethod
    def _bytes(file, at: int, n: int) -> bytes | pa.Buffer:
        file.seek(at)
        return file.read_buffer(n)

    def names(self, first: int, end: int) -> np.ndarray:
        """Ids of documents first to end; those of the part's first ``nulls`` documents mean nothing."""
        return np.frombuffer(self._bytes(self.index, HEAD_BYTES + 8 * first, 8 * (end - first)), "<i8")

    def offsets(self, first: int, end: int) -> np.ndarray:
        """Offsets, in the ids of all parts, of documents first to end and of what follows them."""
        return np.frombuffer(self._bytes(self.index, HEAD_BYTES + 8 * (self.docs + first), 8 * (end - first + 1)), "<u8").astype(np.int64)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids by their places in those of all parts."""
        width = self.kind.itemsize
        return np.frombuffer(self._bytes(self.ids, (start - self.base) * width, (end - start) * width), self.kind)


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a folder, from its files: ids are packed as little-endian unsigned 32-bit integers.

    A task reads a run of READ_DOCS documents of one part, READ_IDS of their ids at a time (or one document).
    A part whose ids end before or after its last offset is an error.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.index").load(target).select("path", "length")
    docs = F.floor((F.col("length") - HEAD_BYTES - 8) / 16)
    runs = names.select(F.regexp_extract("path", r"([^/]+)\.index$", 1).alias("name"), docs.alias("docs"))
    runs = runs.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(READ_DOCS).cast("long"))).alias("first"))
    count = runs.count()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = fs.FileSystem.from_uri(target)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                part = Mapped(place, f"{top}/{name}")
                size = place.get_file_info(f"{top}/{name}.ids").size
                if size != (int(part.offsets(part.docs, part.docs)[0]) - part.base) * part.kind.itemsize:
                    raise ValueError(f"{name}: the ids are not as long as the index tells")
                end = min(part.docs, first + READ_DOCS)
                doc_ids, offsets = part.names(first, end), part.offsets(first, end)
                at = 0
                while at < end - first:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_IDS, "right")) - 1)
                    ids = part.tokens(int(offsets[at]), int(offsets[to])).astype("<u4").tobytes()
                    cuts = (offsets[at : to + 1] - offsets[at]) * 4
                    packed = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids)]).cast(pa.binary())
                    missing = np.arange(first + at, first + to) < part.nulls
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64(), mask=missing), pa.array(offsets[at:to]), pa.array(np.diff(offsets[at : to + 1])), packed], schema=schema)
                    at = to

    return runs.repartition(max(1, min(count, 1 << 16))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
