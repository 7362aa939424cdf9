"""SimHash near-duplicates: 64-bit fingerprints, linked by multi-index hashing.

A fingerprint is cut into ``segments`` parts. Two fingerprints that differ in at most
``radius`` bits differ in at most ``radius // segments`` bits in one of the parts, so each
fingerprint asks, for each part, for every value of that part within that small Hamming ball;
equal values in the table of parts are candidates, and the whole distance decides. With two
parts of 32 bits and radius 3 that is 66 questions a fingerprint and parts so long that
chance matches stay rare for billions of fingerprints.

Values that very many fingerprints share (large families of near copies) are asked for
again under a longer key, which adds a piece of the other part and its own small ball, so no
value gathers all pairs of a family.

``near_duplicates`` works that way on 64 bits and a few bits' distance. Texts whose shingle
sets are only 0.8 alike differ in about 10 of 64 bits, too many for few and long parts, so
``near_copies`` and ``keep_one`` take 256 bits in 12 parts of 21, and balls of one bit: one of
12 parts is nearly always close, and the whole distance leaves few candidates. The texts of
these are then held against each other shingle by shingle, so no link is below the similarity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, islice, repeat
from math import acos, ceil, pi, sqrt
from operator import add, and_
from re import compile as pattern

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bit_at, split_by_keys, text_of, unused, written
from millrace.llm.graph import components

WORD = pattern(rb"[^\x20\x09-\x0D]+")
BLOCK = 50_000  # words hashed at once: bounds memory for very long texts
#: A part's value that more fingerprints than this have is asked for under a longer key.
CROWDED = 64
TASK_ROWS = 50_000  # fingerprints whose questions one task asks
LONGS, PART = 4, 21  # of a wide fingerprint: 64-bit words, and bits of each of the three parts of a word
SKETCH = 16  # more words, that no part is cut from: they tell texts under the similarity from those over it
PARITY = 16  # words of the parities of a set of hashes; the set's size follows them


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; no words give 0."""
    stream = (m.group() for m in WORD.finditer(text.lower())) if len(text) > 1 << 20 else iter(text.lower().split())
    counts, total, kept = np.zeros(64, np.int64), 0, []
    while block := list(islice(stream, BLOCK)):
        kept += block
        if len(kept) < words:
            continue
        grams = map(b" ".join, zip(*(kept[i:] for i in range(words)), strict=False))
        hashes = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(seed))), np.uint64)
        counts, total, kept = counts + _set_bits(hashes), total + len(hashes), kept[len(kept) - words + 1 :]
    if not total and kept:
        counts, total = _set_bits(np.array([xxhash.xxh64_intdigest(b" ".join(kept), seed)], np.uint64)), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` and a long column: the SimHash of the text's shingles of ``words`` words.

    A-Z are lower-cased; words are runs without the six ASCII white-space characters;
    shingles count as often as they occur; a text with fewer words is one shingle; no words
    (null or empty text too) give 0. A column named ``out`` is replaced.
    """

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), words, seed) for t in texts.cast(pa.binary())], pa.int64())

    return docs.withColumn(out, fingerprint(text_of(text)))


def _ball(width: int, radius: int) -> list[int]:
    """Masks of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _cut(value: Column, first: int, width: int) -> Column:
    """``width`` bits of a long, from bit ``first``."""
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))


def _without(value: Column, first: int, width: int) -> Column:
    """A long without those bits: the bits above them come down."""
    low = value.bitwiseAND(F.lit((1 << first) - 1))
    above = first + width
    return low if above == 64 else F.shiftleft(F.shiftrightunsigned(value, above), first).bitwiseOR(low)


def _entries(df: DataFrame, value: Column, pieces: list[tuple[int, int]], radius: int, name: str) -> DataFrame:
    """``df`` with a row for each piece of ``value`` and each mask of the ball: columns ``name`` (piece) and ``name_v``."""

    def around(piece: tuple[int, int]) -> Column:
        masks = F.array(*(F.lit(m).cast("long") for m in _ball(piece[1], radius)))
        return F.transform(masks, lambda m: m.bitwiseXOR(_cut(value, *piece)))

    each = [F.struct(F.lit(i).alias("i"), around(piece).alias("v")) for i, piece in enumerate(pieces)]
    kept = df.columns
    by_piece = df.select(*kept, F.explode(F.array(*each)).alias("_e"))
    return by_piece.select(*kept, F.col("_e.i").alias(name), F.explode("_e.v").alias(f"{name}_v"))


def links(fingerprints: DataFrame, fp: str = "fingerprint", radius: int = 3, segments: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``a, b`` (a < b, signed) of distinct fingerprints that differ in at most ``radius`` bits, each once.

    Null fingerprints link nothing. The table of parts is joined by the part's value; the
    distance is a condition of that join, so only links leave it.
    """
    if segments not in (2, 4, 8) or not 0 <= radius < 8 * segments:
        raise ValueError("2, 4 or 8 segments, and a radius under 8 times that")
    width, near = 64 // segments, radius // segments
    parts = [(width * i, width) for i in range(segments)]
    once = written(fingerprints.select(F.col(fp).cast("long").alias("fp")).filter("fp is not null").distinct(), "fingerprints")
    spread = once.repartition(ceil((once.count() + 1) / TASK_ROWS), "fp")  # each row becomes many questions
    held, asks = _entries(once, F.col("fp"), parts, 0, "part"), _entries(spread, F.col("fp"), parts, near, "part")
    crowd = written(held.groupBy("part", "part_v").count().filter(F.col("count") > crowded).drop("count"), "crowded")

    differ = F.col("a").bitwiseXOR(F.col("b"))
    fresh = F.lit(True)  # a pair counts at the first part that brings it, so none comes twice
    for i in range(1, segments):
        missed = reduce(and_, (F.bit_count(_cut(differ, *p)) > near for p in parts[:i]))
        fresh = fresh & ((F.col("part") != i) | missed)
    close = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & fresh

    def meet(asking: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
        right = table.select(F.col("fp").alias("b"), *(F.col(c).alias(f"r_{c}") for c in key))
        same = reduce(and_, (F.col(c) == F.col(f"r_{c}") for c in key))
        return asking.withColumnRenamed("fp", "a").join(right, same & close).select("a", "b")

    key = ["part", "part_v"]
    if crowd.isEmpty():
        return meet(asks, held, key)
    quiet = meet(asks.join(crowd, key, "left_anti"), held.join(crowd, key, "left_anti"), key)
    # What is left of the distance lies outside the part: of those bits one half has at most radius // 2 wrong.
    half = (64 - width) // 2
    halves = [(0, half), (half, 64 - width - half)]
    rest = F.when(F.col("part") == 0, _without(F.col("fp"), *parts[0]))
    for i, p in enumerate(parts[1:], 1):
        rest = rest.when(F.col("part") == i, _without(F.col("fp"), *p))
    loud = [_entries(df.join(crowd, key, "left_semi"), rest, halves, radius // 2 * probe, "piece") for probe, df in ((0, held), (1, asks))]
    return quiet.union(meet(loud[1], loud[0], [*key, "piece", "piece_v"]).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, segments: int = 2, seed: int = 42) -> DataFrame:
    """Columns ``<doc_id>, fingerprint, component_id``: a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits, the
    row's own included. Equal fingerprints are one node, whatever their number. A null id
    keeps its row and counts for no minimum; a component of null ids alone has a null
    component. Repeated rows stay repeated. An empty table gives an empty result.
    """
    marked = with_fingerprint(docs.select(F.col(doc_id).alias("id"), F.col(f"`{text}`").alias("text")), "text", "fp", words, seed)
    marked = written(marked.select("id", "fp"), "marked")
    classes = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes, "fp", radius, segments), "a", "b").withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(doc_id), F.col("fp").alias("fingerprint"), "component_id")


def _spread(hashes: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """Each 64-bit hash as so many words that look independent: SplitMix64 outputs with the hash as state."""
    z = hashes[:, None] + np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def shingle_hashes(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 hashes, ascending, of a UTF-8 text's shingles; a text with fewer words is one shingle."""
    stream = (m.group() for m in WORD.finditer(text.lower())) if len(text) > 1 << 20 else iter(text.lower().split())
    found, kept = [], []

    def add_all(grams) -> None:
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, set(grams), repeat(seed)), np.uint64))

    while block := list(islice(stream, BLOCK)):
        kept += block
        if len(kept) >= words:
            add_all(map(b" ".join, zip(*(kept[i:] for i in range(words)), strict=False)))
            kept = kept[len(kept) - words + 1 :]
    if not found and kept:
        add_all([b" ".join(kept)])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def wide_simhash(text: bytes, words: int = 5, seed: int = 42, longs: int = LONGS) -> list[int]:
    """A fingerprint of ``longs`` signed longs of a UTF-8 text, over its distinct shingles; no words give zeros."""
    return _wide(shingle_hashes(text, words, seed), longs)


def _wide(hashes: np.ndarray, longs: int) -> list[int]:
    counts = np.zeros(64 * longs, np.int64)
    block = BLOCK * LONGS // longs
    for at in range(0, len(hashes), block):
        spread = _spread(hashes[at : at + block], longs).view(np.uint8).reshape(-1, 8 * longs)
        counts += np.unpackbits(spread, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64).tolist()


def parities(hashes: np.ndarray) -> list[int]:
    """PARITY signed longs, then the number of hashes: each bit is the parity of the hashes that fall on it.

    A hash that two sets share leaves no trace in the difference of their bits, and any other
    changes one bit: so sets differ in at least as many hashes as bits, whatever falls together.
    """
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return [*np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist(), len(hashes)]


def as_alike(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes have at least this Jaccard similarity; two empty ones have."""
    if min(len(one), len(two)) < similarity * max(len(one), len(two)) - 1e-9:
        return False
    both = np.intersect1d(one, two, assume_unique=True).size
    return both >= similarity * (len(one) + len(two) - both) - 1e-9


def bits_apart(similarity: float, bits: int = 64 * LONGS) -> int:
    """How many of so many bits of a wide fingerprint may differ for two sets of one size and this Jaccard similarity.

    Two and a half standard deviations above the mean, so that 99 of 100 such pairs are within.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    return round(bits * share + 2.5 * sqrt(bits * share * (1 - share)))


def _keys(longs: list[Column]) -> Column:
    """The parts of a wide fingerprint, each with the part's number above its bits."""
    cut = [_cut(w, PART * i, PART) for w in longs for i in range(64 // PART)]
    return F.array(*(c.bitwiseOR(F.lit(n << PART)) for n, c in enumerate(cut)))


def _apart(one: list[Column], two: list[Column]) -> Column:
    """The bits in which two lists of words differ."""
    return reduce(add, (F.bit_count(a.bitwiseXOR(b)) for a, b in zip(one, two, strict=True)))


def _longs(fp: str, first: int = 0, longs: int = LONGS) -> list[Column]:
    return [F.col(fp)[i] for i in range(first, first + longs)]


def _words(fp: str, key: str) -> list[Column]:
    """Two of a wide fingerprint's words that the part of this key isn't cut from."""
    word = F.floor(F.shiftright(key, PART) / (64 // PART)).cast("int")
    return [F.get(F.col(fp), (word + i) % LONGS).alias(f"word_{i}") for i in (1, 2)]


def _across(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links ``a, b`` between nodes of two groups, with ``g_a, g_b``."""
    ends = [nodes.select(F.col("node").alias(x), F.col("group").alias(f"g_{x}")) for x in "ab"]
    return links.join(ends[0], "a").join(ends[1], "b").filter("g_a != g_b")


def _tied(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (``node, fp, group``), the groups that links ``a, b`` of nodes join made one."""
    joined = components(_across(links, nodes), "g_a", "g_b").withColumnRenamed("node", "group")
    return nodes.join(joined, "group", "left").select("node", "fp", F.coalesce("root", "group").alias("group"))


def wide_roots(prints: DataFrame, radius: int, half: int | None = None, alike: Callable[[DataFrame], DataFrame] | None = None, sketch: int | None = None, similarity: float | None = None) -> DataFrame:
    """Columns ``node, root`` of every node; ``prints`` has ``node, fp``, distinct and written.

    Nodes with a part in common, but for one bit, are linked if they differ in at most
    ``radius`` bits, and in at most ``half`` (``radius`` where not given) in the two words after
    the part's, and if ``alike`` keeps the pair: it gets pairs ``a, b`` (a > b), each once, and
    returns some of them. With ``sketch``, fingerprints have SKETCH more words, and pairs that differ in
    more than so many bits of these are no links; ``alike`` isn't asked about nearly all of them.
    With ``similarity`` (and ``sketch``), the ``parities`` of the node's hashes follow, and pairs that these prove
    to be below it are no links: exactly, so a set that ``alike`` would keep is never lost by them. Of sets of some
    hundred hashes they leave few that it would refuse; of thousands, the sketch alone tells.

    First each node is held against the smallest one with the same part, which makes groups of
    most families of near copies. Then each asks for its parts and for those one bit away (of
    two such values, the one with the bit set asks), and is answered only where another group
    has the part. Of the answers between two groups the closest is tried, and the groups are made one if it
    holds. What is asked between groups that are still apart then meets all that have the part: again the closest
    link of two groups is tried first, and the others if they stay apart. So the links made within a family grow with its
    members, not with their pairs, and the groups at the end are those of all links. No pair is shown to ``alike`` twice.

    Distances are conditions of the joins. A question brings two of four words with it, and chance
    matches of a part nearly all differ in too many of their bits.
    """
    half = radius if half is None else half

    def parts(nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("key", F.explode(_keys(_longs("fp"))))

    def checked(pairs: DataFrame) -> DataFrame:
        return pairs if alike is None else written(alike(pairs), "alike")

    def whole(one: str, two: str) -> Column:
        """Whether two fingerprints are within the radius, their sketches too, and their parities allow the similarity."""
        within = _apart(_longs(one), _longs(two)) <= radius
        if sketch is not None:
            within &= _apart(_longs(one, LONGS, SKETCH), _longs(two, LONGS, SKETCH)) <= sketch
        if similarity is not None:
            odd, n = LONGS + SKETCH, LONGS + SKETCH + PARITY
            differ = F.greatest(_apart(_longs(one, odd, PARITY), _longs(two, odd, PARITY)), F.abs(F.col(one)[n] - F.col(two)[n]))
            within &= differ <= (F.col(one)[n] + F.col(two)[n]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        return within

    same = parts(prints.select("node", F.slice("fp", 1, LONGS).alias("fp")))
    least = same.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("least"))
    apart = _apart(_longs("fp"), _longs("least.fp"))
    near = (F.col("node") != F.col("least.node")) & (apart <= radius) & (_apart(_words("fp", "key"), _words("least.fp", "key")) <= half)
    star = same.join(least, "key").filter(near).select(F.col("node").alias("a"), F.col("least.node").alias("b"), apart.alias("apart")).distinct()
    star = written(star, "stars")
    first = written(star.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")), "firsts")  # a link a node; the others wait
    roots = components(checked(first), "a", "b")
    nodes = written(prints.join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("group")), "groups")

    def held(nodes: DataFrame) -> DataFrame:
        return parts(nodes).select("key", F.col("node").alias("b"), "group", *(w.alias(f"b_{i}") for i, w in enumerate(_words("fp", "key"))))

    def fresh(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The pairs that aren't known, each once."""
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")

    # One node of the lowest group that has a part and one of the highest: each question meets one of another group.
    row = F.struct("group", "b", "b_0", "b_1")
    have = held(nodes).groupBy("key").agg(F.min(row).alias("low"), F.max(row).alias("high"), F.count("*").alias("n"))
    masks = F.array(*(F.lit(1 << i).cast("long") for i in range(PART)))
    around = F.transform(_keys(_longs("fp")), lambda k: F.concat(F.array(k), F.transform(F.filter(masks, lambda m: k.bitwiseAND(m) != 0), lambda m: k.bitwiseXOR(m))))
    spread = nodes.withColumn("fp", F.slice("fp", 1, LONGS)).repartition(ceil((prints.count() + 1) / TASK_ROWS), "node")  # each row becomes some 140 questions
    asks = spread.select(F.col("node").alias("a"), F.col("group").alias("g"), "fp", F.explode(F.flatten(around)).alias("key"))
    # Which values are taken is a bitmap of 12 times 2^21 bits, 3 MB for any table: questions for the others end here.
    page, bit = F.shiftright("key", 15), F.col("key").bitwiseAND(F.lit((1 << 15) - 1))
    taken = parts(nodes).groupBy(page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    asks = asks.join(F.broadcast(taken), page == F.col("page")).filter(bit_at(F.col("bits"), bit.cast("int")))
    asks = asks.select("a", "g", "key", *_words("fp", "key"))

    def two_words(row: Column) -> Column:
        return _apart([F.col("word_1"), F.col("word_2")], [row["b_0"], row["b_1"]])

    def closest(pairs: DataFrame) -> DataFrame:
        """Of pairs ``a, b, g_a, g_b, apart`` the closest of each two groups."""
        of = (F.least("g_a", "g_b").alias("low"), F.greatest("g_a", "g_b").alias("high"))
        return pairs.groupBy(*of).agg(F.min(F.struct("apart", "a", "b")).alias("pair")).select("pair.a", "pair.b")

    def answer(row: Column) -> Column:
        return F.struct(row["b"].alias("b"), row["group"].alias("g_b"), two_words(row).alias("apart"))

    # Two nodes or one that have a part are known whole, and a question that is close to neither ends here, as nearly all chance matches do.
    ends = [F.col("low"), F.col("high")]
    other = [F.col("g") != x["group"] for x in ends]
    near = [o & (two_words(x) <= half) for o, x in zip(other, ends, strict=True)]
    met = asks.join(have, "key").filter((other[0] | other[1]) & ((F.col("n") > 2) | near[0] | near[1]))
    met = met.select("a", F.col("g").alias("g_a"), "key", "word_1", "word_2", F.when(near[0], answer(ends[0])).when(near[1], answer(ends[1])).alias("met")).select("*", "met.*").drop("met")
    met = written(met, "met")
    one, two = (prints.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    second = fresh(closest(met.filter("b is not null")), first)
    second = written(second.join(one, "a").join(two, "b").filter(whole("fp_a", "fp_b")).select("a", "b"), "links")
    nodes = written(_tied(nodes, checked(second)), "groups")

    # Of the parts that are asked for, those still in several groups: there every pair of two groups meets. The
    # whole distance is a condition of that join, so only links leave it; a node brings its fingerprint once for all its questions.
    asked = met.groupBy("a").agg(F.collect_list(F.struct("key", "word_1", "word_2")).alias("asked"))  # some 140 at most
    full = asked.join(nodes.select(F.col("node").alias("a"), F.col("group").alias("g"), F.col("fp").alias("fp_a")), "a").select("a", "g", "fp_a", F.inline("asked"))
    several = held(nodes).join(met.select("key").distinct(), "key", "left_semi").withColumnRenamed("key", "part")
    groups = several.groupBy("part").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    several = several.join(two, "b")
    full = full.join(groups, F.col("key") == F.col("part")).filter("g != low or g != high").drop("part")
    meets = (F.col("key") == F.col("part")) & (F.col("g") != F.col("group")) & (_apart([F.col("word_1"), F.col("word_2")], [F.col("b_0"), F.col("b_1")]) <= half) & whole("fp_a", "fp_b")
    third = full.join(several, meets).select("a", "b", F.col("g").alias("g_a"), F.col("group").alias("g_b"), _apart(_longs("fp_a"), _longs("fp_b")).alias("apart"))
    third = written(third.distinct(), "links")
    tried = written(fresh(closest(third), first.union(second)), "links")
    nodes = written(_tied(nodes, checked(tried)), "groups")
    rest = fresh(_across(third.select("a", "b"), nodes), first.union(second).union(tried))
    return _tied(nodes, checked(written(rest, "links"))).select("node", F.col("group").alias("root"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Columns ``<doc_id>, component_id``: a row for each row of ``docs``; texts as alike as ``similarity`` are linked.

    Alike: the Jaccard similarity of the sets of their shingles (words as in
    ``with_fingerprint``; sets of 64-bit hashes) is at least ``similarity``. Candidates are by
    their wide fingerprints: one of 12 parts differs in at most one bit, and the whole in at
    most ``bits_apart(similarity)``, as do SKETCH more words of 64 bits. So no link is false, and some pairs near the threshold
    are missed. Most that aren't alike are refused by their ``parities`` before texts are fetched; these miss none. Equal fingerprints are one text. Ids, nulls, repeats and empty tables are as in
    ``near_duplicates``; texts without words are copies of one another.
    """

    @F.arrow_udf("array<long>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        hashes = (shingle_hashes(t.as_py(), words, seed) for t in texts.cast(pa.binary()))
        return pa.array([_wide(h, LONGS + SKETCH) + parities(h) for h in hashes], pa.list_(pa.int64()))

    @F.arrow_udf("boolean")
    def enough(ones: pa.Array, twos: pa.Array) -> pa.Array:
        out, text_two, two = [], None, None
        for a, b in zip(ones.cast(pa.binary()), twos.cast(pa.binary()), strict=True):
            if (b := b.as_py()) != text_two:  # rows of one b mostly lie together
                text_two, two = b, shingle_hashes(b, words, seed)
            out.append(as_alike(shingle_hashes(a.as_py(), words, seed), two, similarity))
        return pa.array(out, pa.bool_())

    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    longs = LONGS + SKETCH
    marked = rows.select("id", "mark", fingerprint("text").alias("all")).select("id", "mark", F.slice("all", 1, longs).alias("fp"), F.slice("all", longs + 1, PARITY + 1).alias("odd"))
    marked = written(marked, "marked")
    classes = marked.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct("id", "mark", "odd")).alias("row"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # fixed once written
    repeated = not marked.groupBy("id", "mark").count().filter("count > 1").isEmpty()

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts have enough shingles in common. Only texts of these pairs are fetched."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(classes.join(ends, "node").select("node", F.col("row.id").alias("own"), F.col("row.mark").alias("of")), "wanted")
        asked, _ = split_by_keys(rows, F.xxhash64("id", "mark"), wanted.select(F.xxhash64("own", "of").alias("k")))
        found = asked.join(wanted, F.col("id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("of"))).select("node", "text")
        found = written(found.dropDuplicates(["node"]) if repeated else found, "texts")
        one, two = (found.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return pairs.select("a", "b").join(one, "a").join(two, "b").filter(enough("text_a", "text_b")).select("a", "b")

    prints = classes.select("node", F.concat("fp", "row.odd").alias("fp"))
    roots = wide_roots(prints, bits_apart(similarity), bits_apart(similarity, 32 * LONGS), alike, bits_apart(similarity, 64 * SKETCH), similarity)
    rooted = classes.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(doc_id), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row for each group of ``near_copies``: the one with the group's smallest id.

    Extra columns stay as they are. Rows with a null id can't be told apart: all stay. Of
    rows that repeat a kept id, one stays.
    """
    found = near_copies(docs, doc_id, text, words, similarity).filter(F.col(doc_id).isNotNull())
    found = written(found.select(F.col(doc_id).alias("id"), "component_id"), "components")
    gone = found.filter("id != component_id").select(F.col("id").alias(unused(docs.columns, "id"))).distinct()
    again = found.groupBy("id").count().filter("count > 1").select(F.col("id").alias(gone.columns[0]))
    asked, settled = split_by_keys(docs, F.col(doc_id), gone.union(again).distinct())  # most texts need no join
    left = asked.join(gone, asked[doc_id] == gone[gone.columns[0]], "left_anti")
    same = left[doc_id] == again[again.columns[0]]
    once = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([doc_id]))
    return once.unionByName(settled)
