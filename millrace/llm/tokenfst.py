"""Token counts by a finite-state tokenizer.

Two deterministic machines replace the tokenizer:

* Where a piece begins is a local matter: the class of a character, of the one before it and
  of the two after it decide (``piece_starts``), so whole blocks of text are classed at once.
* Within a piece, a transducer over bytes yields the token count. Byte-pair encodings have
  the property that a sequence of tokens is the encoding of its bytes exactly if each two
  neighbours are, so the last token of each prefix's encoding, and with it the prefix's token
  count, follows from the last tokens of a few shorter prefixes. Which prefixes can still
  matter is a set of places in the vocabulary's trie; that set, with the last token and the
  relative count at each place, is a state. A transition carries the change of the count, so
  counts of a piece are sums along its path. States and transitions are made when first met (as
  regular expression engines do); transitions lie in a hash table of (state, byte).

The bytes of many texts form one stream, cut into chunks of equal length that step through
the table side by side. Each chunk gives a state map (entry state to exit state); a parallel
prefix scan composes the maps and tells each chunk's entry. Chunks enter with a guess from a
short run-up, which is right unless a piece is longer than the run-up; where the scan finds
another entry, the chunk's map is extended and the scan repeated.

Memory: the states, the known answers and the stream are bounded; a text longer than the stream
goes through in windows that hand on the machine's state.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, text_of

STREAM = 1 << 20  # characters stepped through together
CHUNK, RUN_UP = 512, 48  # bytes
MOST_STATES = 500_000  # kept between streams; some 300 bytes each, with their transitions
MOST_AGREE = 400_000  # answers kept about pairs of tokens
FEW = 64  # new transitions that go into the table one by one
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier
BEFORE, AFTER = 4, 3  # characters around a place that decide whether a piece begins there
END, SPACE, WHITE, LETTER, NUMBER, OTHER = range(6)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_model(path: str) -> tuple[list[bytes], list[tuple[int, int]], list[int], list[str]]:
    """Tokens by id, merges (left, right) by rank with the ids they make, and special strings, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    split = before and before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
    added = whole["added_tokens"]
    if not plain or not split or whole["normalizer"] or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError(f"{path}: only plain byte-level BPE models can be compiled")
    letters, special = byte_letters(), {a["content"] for a in added}
    ids = {k: v for k, v in model["vocab"].items() if k not in special}
    tokens = [b""] * (max(ids.values()) + 1)
    for word, i in ids.items():
        tokens[i] = bytes(letters[c] for c in word)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return tokens, [(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs], sorted(special)


@cache
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizers library's own Unicode tables have it (regex knows a later Unicode).

    Takes seconds, as it asks for every code point: the driver makes it once and broadcasts it (1 MB).
    """
    from tokenizers import Regex, pre_tokenizers  # on the driver alone

    out = np.full(0x110000, OTHER, np.uint8)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        without = pre_tokenizers.Split(Regex(f"{what}+"), "removed")
        for k in range(0, len(every), 1 << 14):
            block = "".join(every[k : k + (1 << 14)])
            here = np.ones(len(block), bool)
            for _, (first, last) in without.pre_tokenize_str(block):
                here[first:last] = False
            out[[ord(c) for c, yes in zip(block, here.tolist(), strict=True) if yes]] = kind
    out[32] = SPACE
    return out


def piece_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character. ``kinds`` has END after each text, and ``points`` no letter there.

    The pieces are those of the usual byte-level pattern: contractions, runs of letters,
    numbers or others with one space before them, and white space, of which a run before
    other text leaves its last character.
    """

    def shifted(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        if by > 0:
            out[by:] = a[:-by]
        else:
            out[:by] = a[-by:]
        return out

    before, after = shifted(kinds, 1), shifted(kinds, -1)
    is_white = (kinds == SPACE) | (kinds == WHITE)
    white_before = (before == SPACE) | (before == WHITE)
    solid_after = after >= LETTER
    start = np.where(is_white, ~white_before | solid_after, (before != SPACE) & (before != kinds))
    mark = (points == ord("'")) & (before != SPACE) & (before != OTHER)
    at = np.flatnonzero(mark)
    if len(at):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        padded_start = np.concatenate([start, np.zeros(3, bool)])
        padded_start[at[short] + 1] = False
        padded_start[at[long] + 1] = False
        padded_start[at[short] + 2] = True
        padded_start[at[long] + 3] = True
        start = padded_start[: len(start)]
    return start | (kinds == END)


class Transducer:
    """The machine within pieces: ``step`` in Python for new transitions, ``next`` and ``weight`` tables for known ones."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int]], made: list[int]):
        self.tokens = tokens
        self.merges = {pair: (rank, whole) for rank, (pair, whole) in enumerate(zip(merges, made, strict=True))}
        self.single = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for i, token in enumerate(tokens):
            node = 0
            for byte in token:
                child = self.children[node].get(byte)
                if child is None:
                    child = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = child
            if token:
                self.token_at[node] = i
        self.agree: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the entry state alone."""
        start = array("i", (0, -1, 0)).tobytes()
        #: places of each state, packed: node, last token, relative count
        self.states, self.number = [start], {start: 0}
        self._room(1 << 16)

    def _room(self, slots: int) -> None:
        """An empty table of transitions; at most half of its slots get used."""
        self.keys = np.full(slots, -1, np.int64)
        self.next, self.weight = np.zeros(slots, np.int32), np.zeros(slots, np.int8)
        self.used, self.shift = 0, np.uint64(65 - slots.bit_length())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * SPREAD >> self.shift).astype(np.int64)

    def _insert(self, keys: np.ndarray, states: np.ndarray, gains: np.ndarray) -> None:
        """New transitions; a slot that is taken sends a key on to the next."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            held = self.keys >= 0
            old, wanted = (self.keys[held], self.next[held], self.weight[held]), 2 * (self.used + len(keys))
            self._room(max(2 * len(self.keys), 1 << wanted.bit_length()))
            self._insert(*old)
        self.used += len(keys)
        if len(keys) <= FEW:
            most, shift, spread = len(self.keys) - 1, int(self.shift), int(SPREAD)
            for key, state, gain in zip(keys.tolist(), states.tolist(), gains.tolist(), strict=True):
                slot = (key * spread & 0xFFFFFFFFFFFFFFFF) >> shift
                while self.keys[slot] >= 0:
                    slot = slot + 1 & most
                self.keys[slot], self.next[slot], self.weight[slot] = key, state, gain
            return
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]  # of several that want a slot, one gets it
            got = free[self.keys[slots[free]] == keys[free]]
            self.next[slots[got]], self.weight[slots[got]] = states[got], gains[got]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) % len(self.keys)

    def plain(self, raw: bytes) -> list[int]:
        """The encoding by repeated merging; for the few bytes of one or two tokens."""
        ids = [self.single[b] for b in raw]
        while len(ids) > 1:
            ranked = [(self.merges[pair][0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in self.merges]
            if not ranked:
                break
            i = min(ranked)[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def together(self, last: int, token: int) -> bool:
        """Whether the two tokens (or, with last = -1, the one) are the encoding of their bytes."""
        key = last << 32 | token
        if (known := self.agree.get(key)) is None:
            if last < 0:
                known = self.plain(self.tokens[token]) == [token]
            else:
                known = self.plain(self.tokens[last] + self.tokens[token]) == [last, token]
            if len(self.agree) >= MOST_AGREE:
                self.agree.clear()
            self.agree[key] = known
        return known

    def known(self, places: bytes) -> int:
        """The number of a state with these places."""
        new = self.number.get(places)
        if new is None:
            new = self.number[places] = len(self.states)
            self.states.append(places)
        return new

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Where a new transition goes, and what it adds."""
        found, key = None, array("i")
        now = memoryview(self.states[state]).cast("i").tolist()
        for at in range(0, len(now), 3):
            node, last, count = now[at : at + 3]
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if found is None and token >= 0 and self.together(last, token):
                found = (token, count + 1)
            if self.children[child]:
                key.extend((child, last, count))
        token, gain = found
        for at in range(2, len(key), 3):
            key[at] -= gain
        key.extend((0, token, 0))
        return self.known(key.tobytes()), gain

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, side by side, and what they add."""
        keys = states.astype(np.int64) << 8 | symbols
        slots = self._slots(keys)
        found = self.keys[slots]
        off, missing = np.flatnonzero(found != keys), []
        while len(off):
            free = found[off] < 0
            missing.append(off[free])
            off = off[~free]
            slots[off] = (slots[off] + 1) % len(self.keys)
            found[off] = self.keys[slots[off]]
            off = off[found[off] != keys[off]]
        after, gains = self.next[slots], self.weight[slots]
        if missing and len(new := np.concatenate(missing)):
            fresh, at = np.unique(keys[new], return_inverse=True)
            made, more = zip(*(self.step(key >> 8, key & 255) for key in fresh.tolist()), strict=True)
            made, more = np.array(made, np.int32), np.array(more, np.int8)
            self._insert(fresh, made, more)
            after[new], gains[new] = made[at], more[at]
        return after, gains

    def weights(self, stream: np.ndarray, reset: np.ndarray, state: int = 0) -> tuple[np.ndarray, int]:
        """The change of the token count at each byte, and the last state; ``reset`` marks the bytes that begin a piece, ``state`` is that before the first."""
        n = len(stream)
        lanes = -(-n // CHUNK)
        grid = np.zeros(lanes * CHUNK, np.uint8)
        grid[:n] = stream
        new = np.ones(lanes * CHUNK, bool)
        new[:n] = reset
        grid, new = grid.reshape(lanes, CHUNK).T.copy(), new.reshape(lanes, CHUNK).T.copy()
        entry = np.zeros(lanes, np.int32)
        entry[0] = state
        for k in range(CHUNK - RUN_UP, CHUNK):  # the run-up is the end of the chunk before
            entry[1:] = np.where(new[k, :-1], 0, entry[1:])
            entry[1:], _ = self.advance(entry[1:], grid[k, :-1])
        path, gains = np.empty((CHUNK + 1, lanes), np.int32), np.empty((CHUNK, lanes), np.int8)
        path[0] = entry
        for k in range(CHUNK):
            path[k + 1], gains[k] = self.advance(np.where(new[k], 0, path[k]), grid[k])
        constant = new.any(axis=0)
        while True:
            entries = np.concatenate([[state], _compose(path[0].copy(), path[-1].copy(), constant.copy(), state)[:-1]])
            wrong = np.flatnonzero((entries >= 0) & (entries != path[0]))
            if not len(wrong):
                break
            for lane in wrong.tolist():
                self._extend(path, gains, new, grid, lane, int(entries[lane]))
        return gains.T.reshape(-1)[:n], int(path[(n - 1) % CHUNK + 1, lanes - 1])

    def _extend(self, path: np.ndarray, gains: np.ndarray, new: np.ndarray, grid: np.ndarray, lane: int, state: int) -> None:
        """Walk a lane from another entry, as far as its path differs."""
        path[0, lane] = state
        for k in range(CHUNK):
            if new[k, lane]:
                return
            after, gains[k, lane : lane + 1] = self.advance(path[k, lane : lane + 1], grid[k, lane : lane + 1])
            if path[k + 1, lane] == after[0]:
                return
            path[k + 1, lane] = after[0]


def _compose(entry: np.ndarray, leave: np.ndarray, constant: np.ndarray, state: int = 0) -> np.ndarray:
    """The exit state after each chunk, -1 where the maps don't tell, by a parallel prefix scan.

    A map takes ``entry`` to ``leave``, or any entry if it is ``constant``; the first one is
    entered with ``state``. Two maps compose to a map of the same form, so log2(chunks) sweeps
    compose all prefixes.
    """
    step, n = 1, len(entry)
    constant[:1] |= entry[:1] == state
    while step < n:
        first_leave, first_entry, first_constant = leave[:-step], entry[:-step], constant[:-step]
        meets = constant[step:] | ((first_leave == entry[step:]) & (first_leave >= 0))
        joined = np.where(meets, leave[step:], -1)
        entry[step:], constant[step:], leave[step:] = first_entry.copy(), constant[step:] | first_constant, joined
        step *= 2
    return np.where(constant, leave, -1)


class Counter:
    """Counts the tokens of texts. ``kinds``: of ``classes``."""

    def __init__(self, model: tuple, kinds: np.ndarray):
        tokens, merges, made, self.special = model
        self.machine, self.kinds = Transducer(tokens, merges, made), kinds
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _parts(self, text: str) -> Iterator[str]:
        """What lies between special strings; one more part than these."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def count(self, texts: list[str]) -> np.ndarray:
        """Token counts; a special string counts as one token and ends the text before it."""
        total = np.zeros(len(texts), np.int64)
        owners, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for n, part in enumerate(self._parts(text)):
                total[i] += n > 0
                if len(part) > STREAM:
                    total[i] += self._long(part)
                elif part:
                    owners.append(i)
                    parts.append(part)
                    size += len(part)
                if size >= STREAM:
                    self._stream(owners, parts, total)
                    owners, parts, size = [], [], 0
        if parts:
            self._stream(owners, parts, total)
        return total

    def _fresh(self) -> None:
        if len(self.machine.states) > MOST_STATES:
            self.machine.forget()

    def _stream(self, owners: list[int], parts: list[str], total: np.ndarray) -> None:
        self._fresh()
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = END
        stream, reset, offset = _bytes(joined, points, piece_starts(points, kinds))
        gains, _ = self.machine.weights(stream, reset)
        sums = np.concatenate([[0], np.cumsum(gains, dtype=np.int64)])
        first = np.concatenate([[0], ends[:-1] + 1])
        np.add.at(total, owners, sums[offset[ends]] - sums[offset[first]])

    def _long(self, text: str) -> int:
        """One long text, in windows; each sees a few characters of its neighbours and goes on from the state before."""
        total, state = 0, 0
        for a in range(0, len(text), STREAM):
            if len(self.machine.states) > MOST_STATES:
                places = self.machine.states[state]
                self.machine.forget()
                state = self.machine.known(places)
            b = min(a + STREAM, len(text))
            low, high = max(0, a - BEFORE), min(b + AFTER, len(text))
            shown = text[low:high] + "\n" * (high == len(text))
            points = np.frombuffer(shown.encode("utf-32-le"), np.uint32)
            kinds = self.kinds[points]
            if high == len(text):
                kinds[-1] = END
            starts = piece_starts(points, kinds)[a - low : b - low]
            starts[0] |= a == 0
            stream, reset, _ = _bytes(text[a:b], points[a - low : b - low], starts)
            gains, state = self.machine.weights(stream, reset, state)
            total += int(gains.sum(dtype=np.int64))
        return total


def _bytes(text: str, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, which of them begin a piece, and where each character's bytes begin."""
    stream = np.frombuffer(text.encode(), np.uint8)
    width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int32)
    offset = np.concatenate([[0], np.cumsum(width, dtype=np.int32)])
    reset = np.zeros(len(stream), bool)
    reset[offset[:-1][starts]] = True
    return stream, reset, offset


_counters: dict[str, Counter] = {}
SHARE = 2 << 20  # characters of texts turned into Python strings at once


def with_token_counts(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` and a long column: the tokens of the whole text, as the tokenizers library counts them.

    No special tokens are added; a special string within a text is one token, which is that
    library's default. Null and empty texts have none. A column named ``out`` is replaced. The
    model and the classes of characters (a few MB, whatever the corpus) are made on the driver
    and broadcast; each Python worker keeps its compiled machine for later tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast((read_model(model_path), classes()))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model_path not in _counters:
            _counters.clear()
            _counters[model_path] = Counter(*shared.value)
        for texts in batches:
            for block in blocks(texts, SHARE):
                yield pa.array(_counters[model_path].count(block), pa.int64())

    return docs.withColumn(out, count(text_of(text)))
