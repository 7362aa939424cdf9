"""A quality classifier: generalised additive model with pairwise interactions.

Twenty-six numbers describe a whole text. Each number's range is cut into bins, and a lookup
table over the bins gives its share of the log-odds; a few pairs of numbers have tables over
coarse bins of both. Tables are learnt by cyclic boosting: in turn, each takes a small step
along a shallow tree fitted to the current residuals, so no number explains what another one
should. A score is a sum of table entries, looked up for whole batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of

#: Labelled rows that a fit uses at most: those with the smallest hashes of their ids.
MAX_FIT = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
CYCLES, PAIR_CYCLES, RATE, RIDGE = 120, 60, 0.15, 2.0
FEATURES = (
    "chars", "words", "word_length", "word_length_spread", "letters", "upper", "digits", "white", "marks", "noise", "pipes", "shouts", "stops",
    "commas", "distinct", "commonest", "adjacent", "pairs", "alphabetic", "short", "lines", "line_length", "repeated_lines", "entropy", "foreign", "longest",
)
_BYTE = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((_BYTE >= a) & (_BYTE <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
_WHITE = np.isin(_BYTE, list(b" \t\n\r\x0b\x0c"))
_MARK = (_BYTE > 32) & (_BYTE < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_NOISE = np.isin(_BYTE, list(b"#$%&*+=<>@^_~\\{}[]|"))


def describe(text: str) -> list[float]:
    """The numbers of FEATURES for one text; all are 0 for an empty one."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [log1p(len(text)), *[0.0] * (len(FEATURES) - 1)]
    n, size = len(words), len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = text.split("\n")
    letters = int(seen[_UPPER | _LOWER].sum())
    foreign = int(seen[128:].sum())
    share = seen[seen > 0] / size
    return [
        log1p(len(text)), log1p(n), float(lengths.mean()), float(lengths.std()), (letters + foreign) / size, int(seen[_UPPER].sum()) / max(1, letters),
        int(seen[_DIGIT].sum()) / size, int(seen[_WHITE].sum()) / size, int(seen[_MARK].sum()) / size, int(seen[_NOISE].sum()) / size,
        int(seen[124]) / n, int(seen[33]) / n, int(seen[46]) / n, int(seen[44]) / n, len(counts) / n, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), sum(map(str.isalpha, words)) / n,
        int((lengths <= 3).sum()) / n, log1p(len(lines)), log1p(size / len(lines)), 1 - len(set(lines)) / len(lines),
        float(-(share * np.log2(share)).sum()), foreign / size, log1p(int(lengths.max())),
    ]


def _table(texts: list[str]) -> np.ndarray:
    return np.array([describe(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gain and place of the best cut along the last axis; place 0 means none."""
    left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    all_g, all_h = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)
    cut = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h)
    whole = _gain(all_g, all_h)
    gains = np.concatenate([whole, cut], -1)
    place = gains.argmax(-1)
    return np.take_along_axis(gains, place[..., None], -1)[..., 0], place


def _leaves(g: np.ndarray, h: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The step of each bin, equal between cuts."""
    step, edges = np.zeros(len(g)), [0, *sorted({c for c in cuts if 0 < c < len(g)}), len(g)]
    for a, b in zip(edges, edges[1:], strict=False):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def _line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins of one number."""
    _, cut = _best_cut(g, h)
    cut = int(cut)
    cuts = [cut]
    for a, b in ((0, cut), (cut, len(g))):
        if b - a > 1:
            cuts.append(a + int(_best_cut(g[a:b], h[a:b])[1]))
    return _leaves(g, h, cuts)


def _plane_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over two numbers: one cut of the first, then one of the second on each side; the better order of the two."""
    best, step = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        upper_g, upper_h = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        lower_g, lower_h = a.sum(0) - upper_g, b.sum(0) - upper_h
        (gain_u, cut_u), (gain_l, cut_l) = _best_cut(upper_g, upper_h), _best_cut(lower_g, lower_h)
        i = int((gain_u + gain_l).argmax())
        if (gain := float(gain_u[i] + gain_l[i])) > best:
            best, out = gain, np.empty_like(a)
            out[: i + 1] = _leaves(upper_g[i], upper_h[i], [int(cut_u[i])])
            out[i + 1 :] = _leaves(lower_g[i], lower_h[i], [int(cut_l[i])])
            step = out.T if turned else out
    return step


@dataclass
class Model:
    """Bin edges, tables, and the pairs with theirs; some KB."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    planes: list[np.ndarray]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1, by additions of looked-up bins."""
        out = np.full(len(x), self.base)
        for f, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edge, x[:, f], "right")]
        for (a, b), plane in zip(self.pairs, self.planes, strict=True):
            out += plane[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Quantile edges, without repeats."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on rows of numbers and labels 0 or 1. Labels of one kind, or none, give a constant model."""
    width = x.shape[1]
    positive = float(y.sum())
    base = float(np.log((positive + 1) / (len(y) - positive + 1)))
    edges, coarse = [_edges(x[:, f], BINS) for f in range(width)], [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if not 0 < positive < len(y):
        return model
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    odds = np.full(len(y), base)

    def slopes(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return np.bincount(cells, y - p, n), np.bincount(cells, p * (1 - p), n)

    for _ in range(CYCLES):
        for f in range(width):
            if len(model.tables[f]) > 1:
                step = RATE * _line_tree(*slopes(bins[f], len(model.tables[f])))
                model.tables[f] += step
                odds += step[bins[f]]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    sizes = [len(e) + 1 for e in coarse]
    usable = [f for f in range(width) if sizes[f] > 1]
    cells = {(a, b): rough[a] * sizes[b] + rough[b] for a, b in combinations(usable, 2)}
    strength = {p: float(_gain(*slopes(c, sizes[p[0]] * sizes[p[1]])).sum()) for p, c in cells.items()}
    model.pairs = sorted(strength, key=lambda p: (-strength[p], p))[:PAIRS]
    model.planes = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_CYCLES):
        for (a, b), plane in zip(model.pairs, model.planes, strict=True):
            g, h = slopes(cells[a, b], plane.size)
            step = RATE * _plane_tree(g.reshape(plane.shape), h.reshape(plane.shape))
            plane += step
            odds += step.reshape(-1)[cells[a, b]]
    return model


def held_out(doc_id):
    """Whether a row is kept from learning: the remainder by 5 of the CRC-32 of its id as text is 0 (null id: learns nothing, so true)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_FIT) -> Model:
    """A model from at most ``most`` labelled documents that are not held out.

    Null labels and ids whose labels differ are left out. The sample is those ids with the
    smallest hashes: a uniform one, and the same on every run. An id that several documents
    have counts once, by the least of their rows of numbers. Only the sample's numbers (26 a
    row) come to the driver.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).filter("_id is not null and _y is not null")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_y2")).filter("_y = _y2").drop("_y2")
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(most))  # at most `most` rows of 16 bytes

    @F.arrow_udf("array<double>")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_table(texts.to_pylist()).tolist(), pa.list_(pa.float64()))

    joined = docs.select(F.col(doc_id).alias("_d"), text_of(text).alias("_t")).join(sample, F.col("_d") == F.col("_id"))
    rows = joined.select("_id", "_y", numbers("_t").alias("x")).groupBy("_id", "_y").agg(F.min("x").alias("x")).orderBy("_id").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows["_y"].to_pylist(), np.float64))


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and a double column from 0 to 1: the probability of label 1. Null and empty texts have one too; a column named ``out`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score(_table(texts.to_pylist())), pa.float64())

    return docs.withColumn(out, score(text_of(text)))
