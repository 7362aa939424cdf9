"""Byte-level BPE encoding and decoding by a rank queue.

The pairs of symbols that can merge wait in one bucket for each merge rank; a bucket holds
positions in the linked list of symbols. A three-level bitmap of 64-bit words says which
buckets have entries, so find-first-set on three words gives the lowest rank. Merging does
not take neighbours' old entries out: an entry whose pair has since changed is stale and is
skipped when its turn comes. A piece of n bytes costs O(n log n) whatever its length, where
the usual scan for the lowest pair costs O(n * n).

Pieces merge independently, so many new pieces share one list and one queue: the lowest rank
of all is the lowest of each piece that has it, and opening a bucket serves them all at once.
Most pieces are short and repeat, so each task remembers the ids of pieces that it has seen;
the memory is bounded and is only a matter of speed.

Memory: texts are taken in blocks, results leave in blocks, and the pieces of a longer text are
taken in portions. One piece of n bytes (a text without any place to split it) needs about 60 n.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, text_of

MEMORY = 100_000  # pieces that a task remembers from earlier blocks
LONGEST = 48  # characters of a piece that is remembered
BLOCK = 1 << 20  # characters encoded together: their pieces take some 20 bytes a character meanwhile
PORTION = 200_000  # pieces of a longer text encoded together
SLICE = 1 << 19  # bytes that share a queue, or one piece
WORD = 6  # bits that index a bitmap word of 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by merge rank: ``push``, and ``pop`` of the lowest rank with all its positions, in order, each once."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        sizes = [ranks]
        while sizes[-1] > 1:
            sizes.append((sizes[-1] + 63) >> WORD)
        #: levels[0] has a bit for each rank, levels[i + 1] a bit for each word of levels[i]
        self.levels = [[0] * n for n in sizes[1:]] or [[0]]

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word = rank >> WORD
            level[word] |= 1 << (rank & 63)
            rank = word

    def pop(self) -> tuple[int, np.ndarray] | None:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << WORD | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            word = rank >> WORD
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word
        bucket = self.buckets.pop(at)
        positions = np.sort(bucket[0] if len(bucket) == 1 else np.concatenate(bucket))
        twice = positions[1:] == positions[:-1]
        return at, positions[np.append(True, ~twice)] if twice.any() else positions


class Neighbours:
    """For each token, the tokens that may follow (or precede) it in a pair, and the ranks of these pairs."""

    def __init__(self, own: np.ndarray, other: np.ndarray, rank: np.ndarray, tokens: int):
        order = np.argsort(own, kind="stable")
        self.other, self.rank = other[order], rank[order]
        self.begin = np.searchsorted(own[order], np.arange(tokens + 1))
        self.lookup = np.full(tokens, -1, np.int32)  # set for one token at a time

    def of(self, token: int, others: np.ndarray) -> np.ndarray | None:
        """The ranks of the token's pairs with these others, -1 for none; None if it has no pairs at all."""
        a, b = self.begin[token], self.begin[token + 1]
        if a == b:
            return None
        self.lookup[self.other[a:b]] = self.rank[a:b]
        out = self.lookup[others]
        self.lookup[self.other[a:b]] = -1
        return out


def _characters(kind: str) -> set[str]:
    """The characters that tiktoken's own Unicode tables put into a class."""
    import tiktoken  # on the driver alone

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    bare = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(bare.decode_bytes(bare.encode_ordinary(every)).decode())


@cache
def splitters(split: str) -> tuple[str, str, str]:
    """The pattern for most texts; the one for texts with characters of which tiktoken's Unicode and this one's differ; a pattern for these ("": none).

    Takes seconds, as it asks for every code point: the driver makes it once and broadcasts it.
    """
    exact, odd = split, set()
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind in (r"\p{L}", r"\p{N}"):
        theirs, ours = _characters(kind), set(regex.findall(kind, every))
        more, less = "".join(map(regex.escape, sorted(theirs - ours))), "".join(map(regex.escape, sorted(ours - theirs)))
        odd |= theirs ^ ours
        exact = exact.replace(kind, f"[[{kind}{more}]--[{less}]]" if less else f"[{kind}{more}]")
    return (split, f"(?V1){exact}", "[" + "".join(map(regex.escape, sorted(odd))) + "]") if odd else (split, split, "")


class Decoder:
    """Decodes by a rank table: a byte string for each id, and nothing else."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for; an id without a token raises an error."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I"))) if packed else b""


class Codec(Decoder):
    """Encodes and decodes by a rank table; every single byte must have a rank. ``patterns``: of ``splitters``."""

    def __init__(self, ranks: dict[bytes, int], patterns: tuple[str, str, str]):
        super().__init__(ranks)
        self.ranks = ranks
        usual, exact, odd = patterns
        self.usual, self.exact, self.odd = regex.compile(usual), regex.compile(exact), regex.compile(odd) if odd else None
        tokens = len(self.bytes_of)
        self.queue = RankQueue(tokens)
        pairs = np.array([(x, y, r) for t, r in ranks.items() for i in range(1, len(t)) if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None], np.int32).reshape(-1, 3)
        left, right, rank = pairs.T
        self.after, self.before = Neighbours(left, right, rank, tokens), Neighbours(right, left, rank, tokens)
        self.early = np.zeros(tokens, bool)  # tokens that take part in a pair of lower rank than their own
        self.early[left[rank < left]] = self.early[right[rank < right]] = True
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        two = np.full((256, 256), -1, np.int32)
        for token, r in ranks.items():
            if len(token) == 2:
                two[token[0], token[1]] = r
        self.two = two
        self.memory: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pieces that aren't tokens themselves, by one list and one queue."""
        queue, blob = self.queue, b"".join(pieces)
        n = len(blob)
        edges = np.cumsum([0, *map(len, pieces)])
        first = np.zeros(n + 1, bool)  # where pieces begin: no pair reaches over
        first[edges] = True
        raw = np.frombuffer(blob, np.uint8)
        # symbol i covers blob[i:right[i]] and is the token name[i]; left[i] is where the one before it begins; waits[i] is the rank of its pair
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        name, waits = np.append(self.single[raw], np.int32(0)), np.full(n, -1, np.int32)
        waits[:-1] = np.where(first[1:-1], -1, self.two[raw[:-1], raw[1:]])
        _push(queue, np.arange(n, dtype=np.int32), waits)
        now = np.zeros(n + 1, bool)  # set for one bucket at a time: the positions that merge
        slow: set[int] = set()
        while entry := queue.pop():
            rank, at = entry
            at = at[waits[at] == rank]  # the others are stale: the symbol is gone, or its pair is another now
            if not len(at):
                continue
            middle = right[at]
            if (middle[:-1] == at[1:]).any():  # pairs that share a symbol: the first has it
                at = _leftmost(at, middle)
                middle = right[at]
            end = right[middle]
            if self.early[rank]:
                now[at] = True
                odd = self._odd(rank, at, end, first, left, name, now)
                now[at] = False
                if odd.any():  # pieces with such a merge are left to _slowly
                    own = np.searchsorted(edges, at, "right") - 1
                    bad = np.unique(own[odd])
                    slow.update(bad.tolist())
                    for p in bad.tolist():
                        waits[edges[p] : edges[p + 1]] = -1  # all its entries are stale from now on
                    at = at[~np.isin(own, bad)]
                    middle = right[at]
                    end = right[middle]
            right[at], left[end], name[at] = end, at, rank
            waits[middle] = waits[at] = -1
            ranks = self.after.of(rank, name[end])
            if ranks is not None:
                ranks[first[end]] = -1
                waits[at] = ranks
                _push(queue, at, ranks)
            inner = at[~first[at]]
            behind = left[inner]
            ranks = self.before.of(rank, name[behind])
            waits[behind] = -1 if ranks is None else ranks
            if ranks is not None:
                _push(queue, behind, ranks)
        at = np.flatnonzero(_begins(right))
        ids, cuts = name[at].astype("<u4").tobytes(), (4 * np.searchsorted(at, edges)).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for p in slow:
            out[p] = self._slowly(pieces[p])
        return out

    def _odd(self, rank: int, at: np.ndarray, end: np.ndarray, first: np.ndarray, left: np.ndarray, name: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Which merges make a pair of a lower rank, that should come next; neighbours count as they are and as this bucket makes them."""
        odd = np.zeros(len(at), bool)
        behind = np.where(first[at], at, left[at])
        for pairs, other, edge in ((self.after, end, first[end]), (self.before, behind, first[at])):
            names = name[other]
            for them in (names, np.where(now[other], rank, names)):
                ranks = pairs.of(rank, them)
                if ranks is not None:
                    odd |= (ranks >= 0) & (ranks < rank) & ~edge
        return odd

    def _slowly(self, piece: bytes) -> bytes:
        """One piece, one merge at a time; for pieces in which a merge makes a pair that should have come before it."""
        ranks, queue, n = self.ranks, self.queue, len(piece)
        right, left, waits = list(range(1, n + 1)), list(range(-1, n)), [-1] * n

        def wait(i: int) -> int:
            j = right[i] if i >= 0 else n
            rank = ranks.get(piece[i : right[j]]) if i >= 0 and j < n else None
            if i >= 0:
                waits[i] = -1 if rank is None else rank
            if rank is None:
                return len(self.bytes_of)
            queue.push(rank, np.array([i], np.int32))
            return rank

        for i in range(n):
            wait(i)
        while entry := queue.pop():
            rank, positions = entry
            for done, i in enumerate(positions.tolist(), 1):
                if waits[i] != rank:
                    continue
                j = right[i]
                right[i] = right[j]
                left[right[j]] = i
                waits[j] = -1
                if min(wait(i), wait(left[i])) < rank:  # a pair of lower rank came up: it goes first
                    if done < len(positions):
                        queue.push(rank, positions[done:])
                    break
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : right[i]]].to_bytes(4, "little"))
            i = right[i]
        return b"".join(ids)

    def ids_of(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The packed ids of each piece, in order; a piece that is a token is that token, as in the tiktoken library."""
        ranks = self.ranks
        size, begin = 0, 0
        for at, piece in enumerate(pieces):
            if size and size + len(piece) > SLICE:
                yield from self._sliced(pieces[begin:at])
                size, begin = 0, at
            size += 0 if piece in ranks else len(piece)
        yield from self._sliced(pieces[begin:])

    def _sliced(self, pieces: list[bytes]) -> Iterator[bytes]:
        known = self.ranks
        merged = iter(self.merge(rest) if (rest := [p for p in pieces if p not in known]) else ())
        for p in pieces:
            yield known[p].to_bytes(4, "little") if p in known else next(merged)

    def _pattern(self, text: str) -> regex.Pattern:
        if self.odd is not None and not text.isascii():
            try:
                text.encode("latin-1")  # holds none of them, and is quickly known
            except UnicodeEncodeError:
                return self.exact if self.odd.search(text) else self.usual
        return self.usual

    def _learn(self, pieces: Iterable[str]) -> list[str]:
        """Pieces that memory lacks are put there; those that are too long to stay are returned."""
        memory = self.memory
        new = sorted(p for p in set(pieces) if p not in memory)
        memory.update(zip(new, self.ids_of([p.encode() for p in new]), strict=True))
        return [p for p in new if len(p) > LONGEST]

    def _long(self, text: str) -> bytes:
        found, out = (m.group() for m in self._pattern(text).finditer(text)), []
        while portion := list(islice(found, PORTION)):
            passing = self._learn(portion)
            out.append(b"".join(map(self.memory.__getitem__, portion)))
            self._forget(passing)
        return b"".join(out)

    def _forget(self, passing: list[str]) -> None:
        for piece in passing:
            del self.memory[piece]
        if len(self.memory) >= MEMORY:
            self.memory.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            return [self._long(texts[0])]
        cut = [self._pattern(text).findall(text) for text in texts]
        passing = self._learn(chain.from_iterable(cut))
        out = [b"".join(map(self.memory.__getitem__, pieces)) for pieces in cut]
        self._forget(passing)
        return out


def _push(queue: RankQueue, positions: np.ndarray, ranks: np.ndarray) -> None:
    """Each position into the bucket of its rank; none where that is -1."""
    at = np.flatnonzero(ranks >= 0)
    if not len(at):
        return
    at = at[np.argsort(ranks[at], kind="stable")]
    found, positions = ranks[at], positions[at]
    cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(at)]
    for a, b, rank in zip(cuts, cuts[1:], found[cuts[:-1]].tolist(), strict=False):
        queue.push(rank, positions[a:b])


def _leftmost(at: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Of positions whose pairs share symbols with the next, those that a walk from the left merges."""
    kept, taken = [], -1
    for i, j in zip(at.tolist(), middle.tolist(), strict=True):
        if i != taken:
            kept.append(i)
            taken = j
    return np.array(kept, np.int32)


def _begins(right: np.ndarray) -> np.ndarray:
    """Where symbols begin: places that no symbol before reaches over (a swallowed one ends within its swallower)."""
    out = np.ones(len(right), bool)
    out[1:] = np.maximum.accumulate(right)[:-1] <= np.arange(1, len(right))
    return out


_codecs: dict[tuple, Decoder] = {}


def _kept(what: str, path: str, split: str, make) -> Decoder:
    """One codec of a kind for each Python worker, built from the broadcast tables."""
    key = (what, path, split)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = make()
    return _codecs[key]


def _encoder(df: DataFrame, ranks_path: str, split: str):
    """A function that gives a Python worker its codec; tables (under 10 MB, whatever the corpus) are made on the driver and broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), splitters(split)))
    return lambda: _kept("codec", ranks_path, split, lambda: Codec(*shared.value))


def with_ids(docs: DataFrame, ranks_path: str, split: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` and a binary column: the ids of the whole text, little-endian unsigned 32-bit, packed.

    Each match of ``split`` is encoded by itself, as the tiktoken library would, without
    special tokens. A null or empty text has no ids. A column named ``out`` is replaced.
    """
    codec_of = _encoder(docs, ranks_path, split)

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back at once
        codec = codec_of()
        for texts in batches:
            for block in blocks(texts, BLOCK):
                yield pa.array(codec.encode(block), pa.binary())

    return docs.withColumn(out, encode(text_of(text)))


def with_bytes(df: DataFrame, ranks_path: str, split: str = "", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and a binary column: the bytes that the packed ids stand for; null ids give no bytes.

    An id that the rank table lacks raises an error: the ids are not of this table. A column
    named ``out`` is replaced. ``split`` is not needed, as tokens are joined without it.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _kept("decoder", ranks_path, "", lambda: Decoder(shared.value))
        for packed in batches:
            for k in range(0, len(packed), 256):
                yield pa.array([decoder.decode(p.as_py()) for p in packed[k : k + 256]], pa.binary())

    return df.withColumn(out, decode(F.coalesce(ids, F.lit(b""))))


def with_round_trip(docs: DataFrame, ranks_path: str, split: str, text: str = "text", out: str = "coded") -> DataFrame:
    """``docs`` and a struct column: ``ids`` as of ``with_ids`` and ``decoded``, the bytes that these ids stand for.

    Both are made in one pass by one Python worker a core, where ``with_ids`` and
    ``with_bytes`` in one plan take two. A column named ``out`` is replaced.
    """
    codec_of = _encoder(docs, ranks_path, split)

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back at once
        codec = codec_of()
        for texts in batches:
            for block in blocks(texts, BLOCK):
                ids = codec.encode(block)
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.binary())], ["ids", "decoded"])

    return docs.withColumn(out, both(text_of(text)))


def unpacked(ids: str = "ids"):
    """A column of packed ids as ``array<long>``."""
    digits = F.hex(ids)
    return F.transform(
        F.when(F.length(ids) > 0, F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.concat(*(F.substring(digits, 8 * i + k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long"),
    )
