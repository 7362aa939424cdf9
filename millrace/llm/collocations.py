"""Phrases whose words go together: counts from suffix automata of shards, reduced over all shards.

Texts are cut into words once and kept as shards: one language's words as numbers of the
shard's own word list. A phrase that occurs ``least`` times has only words and pairs that do, so
words are counted first, then pairs of such words, then the longer phrases of such pairs, these by hashes of 32 bits
in packed blocks of two or three bytes each; three bitmaps of at most 32 MB tell shards which
words, pairs and longer phrases may be frequent (never that one which is isn't), and only those are listed
as texts, in packed blocks too. What pairs leave of a shard
are runs. A generalised suffix automaton of bounded depth is built over them,
level by level with sorts in place of word after word: its nodes are the distinct phrases, each with
its number of end positions, its longest proper suffix (the link) and its prefix; nodes whose
link has as many end positions are one state with it. Nodes are listed with their counts, and the sums over all
shards are exact. A phrase inside longer ones is found by following links, one word shorter
at a time, so the largest count of any phrase around it arrives by two small joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import BITS_A_KEY, MOST_BITS, delete, fresh_path, text_of, written

SHARD_BYTES = 12 << 20  # of texts
FILE_SHARDS = 3  # of a file: rows of megabytes, which a reader of files holds together
BATCH_TEXTS = 500  # that go to Python at once
HELD_KEYS = 1 << 21  # that a task adds up before it sends them
MOST_PARTS = 1 << 13  # of all keys
DEPTH = 4
PAGE_BITS = 1 << 15
#: What parts words, and what ends a piece.
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(SPACES)], kinds[list(BREAKS)] = 1, 2
    return kinds


def shard_of(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some text, and its words as their numbers from 1, with 0 between pieces."""
    raw = np.frombuffer(data.lower(), np.uint8)  # of bytes: A-Z alone
    kind = _kinds()[raw]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())]).dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int32) + 1
    return words.dictionary.cast(pa.string()), np.insert(ids, np.flatnonzero(np.diff(piece)) + 1, 0)


def _cut(data: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes, cut where pieces end; whole if none does."""
    at = 0
    while len(data) - at > most:
        end = max(data.rfind(bytes([b]), at, at + most) for b in BREAKS) + 1
        if end <= at:
            end = min((p for b in BREAKS if (p := data.find(bytes([b]), at + most)) >= 0), default=len(data) - 1) + 1
        yield data[at:end]
        at = end
    yield data[at:]


def shards(docs: DataFrame, lang: str, text: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, words, counts, h, ids`` (packed): the texts of a task by language (null: und), in shards of bounded size. ``h``: xxhash64(lang, word)."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("h", pa.list_(pa.int64())), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back at once
        held: dict[str, list[bytes]] = {}
        size = 0

        def full() -> Iterator[pa.RecordBatch]:
            for own, texts in held.items():
                words, ids = shard_of(b"\n".join(texts))
                if len(words):
                    seed = xxhash.xxh64_intdigest(own.encode(), 42)  # as Spark's function chains its columns
                    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)
                    one = [0, len(words)]
                    lists = [pa.ListArray.from_arrays(one, c) for c in (words, pa.array(np.bincount(ids, minlength=len(words) + 1)[1:], pa.int64()), pa.array(hashes))]
                    yield pa.RecordBatch.from_arrays([pa.array([own]), *lists, pa.array([memoryview(ids).cast("B")], pa.binary())], schema=schema)

        for batch in batches:
            for own, said in zip(batch.column("lang"), batch.column("text"), strict=True):
                for part in _cut(said.as_py().encode(), shard_bytes):
                    held.setdefault(own.as_py(), []).append(part)
                    size += len(part)
                    if size >= shard_bytes:
                        yield from full()
                        held, size = {}, 0
        yield from full()

    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    return rows.mapInArrow(cut, "lang string, words array<string>, counts array<long>, h array<long>, ids binary")


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """In what runs meanwhile, so many rows at once go to Python (texts may be long, and shards always are), and shuffle files go when their job ends."""
    now = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name) for name in now}
    try:
        for name, value in now.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits that the hashes in column ``h`` set, of a bitmap of at most 32 MB: all that the driver gets of them."""
    n = keys.count()
    bits = min(MOST_BITS, max(PAGE_BITS, 1 << (BITS_A_KEY * n - 1).bit_length())) if n else PAGE_BITS
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    pages = keys.groupBy(F.shiftright(place, 15).alias("page")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(PAGE_BITS - 1))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[r.page * (PAGE_BITS // 8) : (r.page + 1) * (PAGE_BITS // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    at = hashes.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _chain(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of a phrase and the next word, from the phrase's and the word's."""
    z = one.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + two.view(np.uint64)
    return (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)


def _key(hashes: np.ndarray) -> np.ndarray:
    """The 32 bits of a phrase's hash by which it is counted; few of billions of phrases share them with a frequent one."""
    return (hashes >> np.uint64(32)).view(np.int64)


def _joined(ids: np.ndarray, hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Whether each word and the next are in one piece and may both be frequent."""
    fine = np.concatenate([[False], _set(frequent, hashes)])[ids]
    return fine[:-1] & fine[1:]


class Automaton:
    """The generalised suffix automaton of runs of words, to a depth: nodes of a level are the distinct phrases of so many words.

    ``ids``: words from 1, ``joined``: whether a word and the next are in one run. Of level
    k (from 1): ``ends[k]`` has the number of end positions of each node, ``last[k]`` its last word,
    ``prefix[k]`` and ``link[k]`` the nodes of level k - 1 without the last and without the first word.
    """

    def __init__(self, ids: np.ndarray, joined: np.ndarray, depth: int):
        words = int(ids.max(initial=0)) + 1
        held, node = np.unique(ids, return_inverse=True)
        self.ends, self.last, self.prefix, self.link = {1: np.bincount(node)}, {1: held}, {}, {}
        at = np.arange(len(ids))  # where the phrases of this level begin
        place = np.full(len(ids) + 1, -1)  # a position's node
        place[at] = node
        open_ = np.concatenate([joined, [False]])
        for k in range(2, depth + 1):
            at = at[open_[np.minimum(at + k - 2, len(ids) - 1)] & (at + k - 2 < len(ids) - 1)]
            if k > 2:
                at = at[place[at + 1] >= 0]
            key = place[at] * words + ids[at + k - 1]
            own, first, node, ends = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            self.ends[k], self.last[k] = ends, own % words
            self.prefix[k], self.link[k] = own // words, place[at[first] + 1]
            place = np.full(len(ids) + 1, -1)
            place[at] = node

    def phrases(self, words: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """Level, phrases and end counts, from level 2; ``words`` are those of the numbers from 1."""
        text = pc.take(words, pa.array(np.maximum(self.last[1] - 1, 0)))
        for k in sorted(self.prefix):
            text = pc.binary_join_element_wise(pc.take(text, pa.array(self.prefix[k])), pc.take(words, pa.array(self.last[k] - 1)), " ")
            yield k, text, self.ends[k]

    def hashes(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Level and hashes of the phrases, from level 2; ``words`` are those of the words from 1."""
        own = words[np.maximum(self.last[1] - 1, 0)]
        for k in sorted(self.prefix):
            own = _chain(own[self.prefix[k]], words[self.last[k] - 1])
            yield k, own

    def states(self) -> dict[int, np.ndarray]:
        """For each level from 2, whether a node is one state with its link: all its end positions are the link's."""
        return {k: self.ends[k] == self.ends[k - 1][link] for k, link in self.link.items()}


def _pack(values: np.ndarray) -> bytes:
    """Numbers of 32 bits, a byte of each after the other, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _frequent_keys(rows: DataFrame, counts: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]], least: int, parts: int) -> DataFrame:
    """``h``: the keys whose counts, summed over all shards (``h, ids``), reach ``least``.

    ``counts`` gives the keys and counts of a shard. Each task adds up some shards, and sends a block for each of
    ``parts`` ranges of keys; counts over ``least`` count as ``least``.
    """
    width = (1 << 32) // parts
    schema = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back at once
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def full() -> Iterator[pa.RecordBatch]:
            keys, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            n = np.minimum(n, least)
            cuts = np.searchsorted(keys, np.arange(parts + 1) * width)
            some = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
            for i in range(0, len(some), 256):
                own = some[i : i + 256]
                columns = [p for p, _, _ in own], [b - a for _, a, b in own], [_pack(np.diff(keys[a:b], prepend=p * width)) for p, a, b in own], [_pack(n[a:b]) for _, a, b in own]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for h, packed in zip(batch.column("h"), batch.column("ids"), strict=True):
                held += [x for x in counts(np.frombuffer(packed.as_py(), np.int32), h.values.to_numpy()) if len(x[0])]
                if sum(len(keys) for keys, _ in held) >= HELD_KEYS:
                    yield from full()
                    held.clear()
        if held:
            yield from full()

    def sums(group: pa.Table) -> pa.Table:
        found = [(_unpack(k, size), _unpack(n, size)) for size, k, n in zip(*(group[c].to_pylist() for c in ("size", "keys", "n")), strict=True)]
        keys, n = _summed(np.concatenate([np.cumsum(k) for k, _ in found]), np.concatenate([n for _, n in found]))
        return pa.table({"h": keys[n >= least] + group["part"][0].as_py() * width})

    return rows.select("h", "ids").mapInArrow(blocks, "part int, size int, keys binary, n binary").groupBy("part").applyInArrow(sums, "h long")


def _pairs(frequent) -> Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]:
    """What counts a shard's pairs of words that may be frequent."""

    def pairs(ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.flatnonzero(_joined(ids, hashes, frequent.value))
        both, n = np.unique(ids[at].astype(np.int64) * (len(hashes) + 1) + ids[at + 1], return_counts=True)
        yield _key(_chain(hashes[both // (len(hashes) + 1) - 1], hashes[both % (len(hashes) + 1) - 1])), n

    return pairs


def _machine(ids: np.ndarray, hashes: np.ndarray, frequent, linked, depth: int) -> Automaton | None:
    """The automaton of a shard's runs of pairs that may be frequent; none without such."""
    joined = _joined(ids, hashes, frequent.value)
    at = np.flatnonzero(joined)
    joined[at] = _set(linked.value, _key(_chain(hashes[ids[at] - 1], hashes[ids[at + 1] - 1])))
    kept = np.concatenate([joined, [False]]) | np.concatenate([[False], joined])  # words of runs alone
    runs = ids[kept]
    return Automaton(runs, joined[kept[:-1]][: len(runs) - 1], depth) if len(runs) else None


def _longer(frequent, linked, depth: int) -> Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]:
    """What counts a shard's phrases of 3 to ``depth`` words, of pairs that may be frequent."""

    def longer(ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        machine = _machine(ids, hashes, frequent, linked, depth)
        if machine is not None:
            yield from ((_key(h), machine.ends[k]) for k, h in machine.hashes(hashes) if k > 2)

    return longer


def _phrases(rows: DataFrame, frequent, linked, often, depth: int, least: int, parts: int) -> DataFrame:
    """``lang, phrase, k, a``: phrases of 2 to ``depth`` words and their counts over all shards, if those reach ``least``.

    A shard's phrases that may be frequent go in a block for each of ``parts`` ranges of their keys, and are summed by their texts.
    """
    width = (1 << 32) // parts
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("size", pa.int32()), ("bytes", pa.int32()), ("phrases", pa.binary()), ("n", pa.binary())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back at once
        for batch in batches:
            for lang, words, h, packed in zip(*(batch.column(c) for c in ("lang", "words", "h", "ids")), strict=True):
                hashes = h.values.to_numpy()
                machine = _machine(np.frombuffer(packed.as_py(), np.int32), hashes, frequent, linked, depth)
                if machine is None:
                    continue
                keys = {k: _key(h) for k, h in machine.hashes(hashes)}
                kept = {k: np.arange(len(x)) if k == 2 else np.flatnonzero(_set(often.value, x)) for k, x in keys.items()}
                texts, n, key = [], [], []
                for k, phrases, ends in machine.phrases(words.values):
                    texts.append(pc.take(phrases, pa.array(kept[k])))
                    n.append(ends[kept[k]])
                    key.append(keys[k][kept[k]] // width)
                part, n = np.concatenate(key), np.concatenate(n)
                order = np.argsort(part, kind="stable")
                texts, n = pc.take(pa.concat_arrays(texts), pa.array(order)), n[order]
                cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                for p, (at, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if at < end:
                        text = "\n".join(texts.slice(at, end - at).to_pylist()).encode()
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((p, lang.as_py(), end - at, len(text), pa.compress(text, "zstd", asbytes=True), _pack(n[at:end])), schema, strict=True)], schema=schema)

    def sums(group: pa.Table) -> pa.Table:
        found = []
        for lang in pc.unique(group["lang"]):
            own = group.filter(pc.equal(group["lang"], lang))
            texts = [pa.array(pa.decompress(t, size, "zstd", asbytes=True).decode().split("\n"), pa.string()) for size, t in zip(own["bytes"].to_pylist(), own["phrases"].to_pylist(), strict=True)]
            n = np.concatenate([_unpack(x, size) for size, x in zip(own["size"].to_pylist(), own["n"].to_pylist(), strict=True)])
            some = pa.table({"phrase": pa.chunked_array(texts), "n": n}).group_by("phrase").aggregate([("n", "sum")])
            some = some.filter(pc.greater_equal(some["n_sum"], least))
            k = pc.add(pc.count_substring(some["phrase"], " "), pa.scalar(1, pa.int32()))
            found.append(pa.table({"lang": pa.array([lang.as_py()] * len(some), pa.string()), "phrase": some["phrase"], "k": k, "a": some["n_sum"]}))
        return pa.concat_tables(found)

    blocks = rows.select("lang", "words", "h", "ids").mapInArrow(listed, "part int, lang string, size int, bytes int, phrases binary, n binary")
    return blocks.groupBy("part").applyInArrow(sums, "lang string, phrase string, k int, a long")


def _around(phrases: DataFrame, depth: int) -> DataFrame:
    """``phrases`` (``lang, phrase, k, a``) with ``around``: the largest count of any longer phrase that has its words in a row, or null."""
    inner = F.array(F.expr("substr(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', k - 1)"))  # the link, and the prefix
    levels = phrases.filter(F.col("k") == depth).withColumn("around", F.lit(None).cast("long"))
    longer = levels
    for k in range(depth - 1, 1, -1):
        most = longer.select("lang", F.explode(inner).alias("phrase"), F.greatest("a", "around").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
        longer = phrases.filter(F.col("k") == k).join(most, ["lang", "phrase"], "left").select("lang", "phrase", "k", "a", "around")
        levels = levels.unionByName(longer)
    return levels


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2,000,000 a / (l + r)), in decimals: the product may pass 64 bits."""
    wide = "decimal(38,0)"
    return F.call_function("div", a.cast("decimal(28,0)") * F.lit(2_000_000).cast("decimal(9,0)"), (left.cast("decimal(28,0)") + right.cast("decimal(28,0)")).cast(wide))


def mine(docs: DataFrame, least: int = 30, most: int = 2000, lang: str = "lang", text: str = "text", depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``most`` phrases of 2 to ``depth`` words that score best.

    Words are lower-cased (A-Z), end at spaces and tabs, and pieces at ``.,;:!?`` and line ends; a
    phrase lies within a piece. ``a``: its occurrences, overlaps included, at least ``least``; ``n``: words of the
    language; ``l`` and ``r``: occurrences of the two parts of the cut that scores lowest, at ties the first.
    A phrase inside any longer one of at least 0.8 times its count is left out. Null languages
    count as ``und``, null texts as empty; repeated rows count as often as they are there; other columns take no part. An
    empty table, or one without such phrases, gives an empty result. Order: score and ``a`` falling, phrase rising by its bytes.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    path = fresh_path(spark, "shards")
    made = shards(docs, lang, text, shard_bytes)
    with _batches(spark, BATCH_TEXTS):
        made.write.option("maxRecordsPerFile", FILE_SHARDS).option("compression", "zstd").parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    parts = min(MOST_PARTS, 1 << (rows.count() // 4).bit_length())
    often = F.col("a") >= least
    with _batches(spark, 1):
        one = rows.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("a"))
        one = written(one, "words")
        frequent = context.broadcast(_bitmap(one.filter(often).select(F.xxhash64("lang", "phrase").alias("h"))))
        linked = context.broadcast(_bitmap(written(_frequent_keys(rows, _pairs(frequent), least, parts), "pairs")))
        longer = context.broadcast(_bitmap(written(_frequent_keys(rows, _longer(frequent, linked, depth), least, parts), "longer")))
        phrases = written(_phrases(rows, frequent, linked, longer, depth, least, max(1, parts // 4)), "phrases")
    delete(spark, path)
    around = _around(phrases, depth)
    kept = around.filter(F.col("around").isNull() | (F.col("around") * F.lit(5).cast("decimal(9,0)") < F.col("a") * F.lit(4).cast("decimal(9,0)")))

    cut = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)")}).withColumn("rest", F.expr("substr(phrase, length(first) + 2)"))
    known = one.filter(often).select("lang", "phrase", "a").unionByName(phrases.select("lang", "phrase", "a"))
    for part, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(known.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", part])
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("low"))
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    best = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    sizes = one.groupBy("lang").agg(F.sum("a").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", F.col("low.score").cast("long").alias("score"))
