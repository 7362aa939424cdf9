"""Mixing to target weights by soft membership.

A classifier learnt from a labelled table gives each document a posterior over domains, so a
document counts for several domains at once. Rates r >= 0, one for each document, are then
fitted by projected gradient: with tokens n and posteriors p, the expected tokens of domain k
are T_k = sum(r * n * p_k), and

    sum_k (T_k - t_k)^2 / m_k  +  RIDGE * sum(n * (r - 1)^2)

is made least, where t are the targets and m the totals at r = 1. The second, small part makes
the best rates unique: without it a target that no rates reach (as of nothing, where every
posterior is over 0) is approached by dropping nearly all documents. In the metric that weighs
documents by their tokens the gradient is sum_k p_k (T_k - t_k) / m_k + RIDGE * (r - 1) and the
largest curvature 1 + RIDGE, which sets the length of a step.

All rates start from 1. Plain steps are slow along directions that totals hardly tell apart, so
each step sets out from a point ahead, in the direction of the last one (Nesterov's momentum),
and the momentum starts again whenever it points uphill. Steps go on until one moves the rates by
no more than NEAR, in the mean square over tokens. A step is one pass over all documents, which
brings K totals and two sums to the driver and nothing else: totals are linear in the rates, so
those of the point ahead follow from the last two. The steps' K residuals and paces are all that
is needed to give any document its rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of, unused, written

MAX_FIT = 20_000  # labelled documents that the classifier learns from at most: those with the smallest hashes of their ids
BUCKETS = 1 << 15  # of hashed words
PRIOR_WEIGHT = 20.0  # documents' worth of the overall rate in each domain's rate
HEATS = (1, 2, 4, 8, 16, 32, 64)  # by which log-odds may be divided
RIDGE = 1e-3  # what a rate's distance from 1 counts beside the targets
NEAR, MOST_STEPS = 2e-5, 2000  # settled at so small a step; an error if that isn't reached
CUT = 16  # steps after which rates are written


def buckets(text: str) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the buckets of its distinct words."""
    words = text.encode().split()
    once = set(words)
    return len(words), np.unique(np.fromiter(map(crc32, once), np.int64, len(once)) & (BUCKETS - 1))


class Posterior:
    """A model of hashed word presence: log-odds for each domain and bucket; some MB at most."""

    def __init__(self, counts: np.ndarray, docs: np.ndarray):
        rate = (counts.sum(0) + 1) / (docs.sum() + 2)
        self.prior = np.log((docs + 1) / (docs.sum() + len(docs)))
        own = (counts + PRIOR_WEIGHT * rate) / (docs[:, None] + PRIOR_WEIGHT)
        self.odds = np.log(own / rate).T.copy()  # bucket, domain
        self.heat = 1.0

    def evidence(self, found: np.ndarray) -> np.ndarray:
        return self.odds[found].sum(axis=0)

    def of(self, evidence: np.ndarray, heat: float | None = None) -> np.ndarray:
        """Posteriors of rows of evidence."""
        z = self.prior + evidence / (heat or self.heat)
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def learn(docs: DataFrame, labelled: DataFrame, domains: int, doc_id: str = "doc_id", text: str = "text", most: int = MAX_FIT) -> Posterior:
    """A model from ``labelled`` (``doc_id, domain`` with domains from 0), of at most ``most`` ids.

    Ids that are null, have a null domain or more than one are left out; those are taken whose
    hashes are the smallest. An id that several documents have counts once, by the least of
    their sets of words. Four fifths give the counts; the last fifth chooses the heat that makes
    its log-likelihood best. Counts (at most domains x BUCKETS) and the last fifth's words come
    to the driver.
    """
    known = labelled.select(F.col(doc_id).alias("_id"), F.col("domain").cast("int").alias("_y")).filter("_id is not null and _y is not null")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_y2")).filter("_y = _y2").drop("_y2")
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(most))

    @F.arrow_udf("array<int>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([buckets(t.as_py())[1].tolist() for t in texts], pa.list_(pa.int32()))

    rows = docs.select(F.col(doc_id).alias("_d"), text_of(text).alias("_t")).join(sample, F.col("_d") == F.col("_id"))
    rows = rows.select("_id", "_y", words("_t").alias("w")).groupBy("_id", "_y").agg(F.min("w").alias("w"))
    rows = written(rows.withColumn("last", (F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5)) == 0)), "labelled")
    counts, size = np.zeros((domains, BUCKETS)), np.zeros(domains)
    for r in rows.filter("not last").groupBy("_y").count().collect():
        size[r["_y"]] = r["count"]
    pairs = rows.filter("not last").select("_y", F.explode("w").alias("w")).groupBy("_y", "w").count().toArrow()
    counts[pairs["_y"].to_numpy(), pairs["w"].to_numpy()] = pairs["count"].to_numpy()
    model = Posterior(counts, size)
    rest = rows.filter("last").orderBy("_id").toArrow()  # ids are unique: at most ``most`` rows
    if len(rest):
        evidence = np.array([model.evidence(np.array(w, np.int64)) for w in rest["w"].to_pylist()])
        y = rest["_y"].to_numpy()
        model.heat = min(HEATS, key=lambda t: -np.log(model.of(evidence, t)[np.arange(len(y)), y] + 1e-300).sum())
    return model


def with_posterior(docs: DataFrame, model: Posterior, text: str = "text", out: str = "mix") -> DataFrame:
    """``docs`` and a struct column: ``tokens`` (words of the whole text) and ``p`` (posteriors, which add up to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<tokens: long, p: array<double>>")
    def posterior(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [buckets(t.as_py()) for t in texts]
            width = shared.value.odds.shape[1]
            p = shared.value.of(np.array([shared.value.evidence(b) for _, b in found]).reshape(-1, width))
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], ["tokens", "p"])

    return docs.withColumn(out, posterior(text_of(text)))


@dataclass
class Fit:
    """The steps, each of them residuals and a pace of momentum, and what came of them."""

    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)
    wanted: list[float] = field(default_factory=list)  # tokens of each domain
    reached: list[float] = field(default_factory=list)
    moved: float = 0.0  # by the last step

    def rates(self, p: np.ndarray) -> np.ndarray:
        """The rates of rows of posteriors: the steps, taken again."""
        r = ahead = np.ones(len(p))
        return advanced(p, r, ahead, self.steps)[0]


def stepped(p: np.ndarray, ahead: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Rates after one projected step from ``ahead``."""
    return np.maximum(0.0, ahead - (p @ residual + RIDGE * (ahead - 1)) / (1 + RIDGE))


def advanced(p: np.ndarray, r: np.ndarray, ahead: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and the point ahead of them, after some steps."""
    for residual, push in steps:
        new = stepped(p, ahead, residual)
        ahead, r = new + push * (new - r), new
    return r, ahead


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, rates, points ahead and posteriors of a batch of the state."""
    n, r, ahead, *p = (c.to_numpy() for c in batch.columns)
    return n, r, ahead, np.column_stack(p)


def totals_after(state: DataFrame, steps: list[tuple[np.ndarray, float]], residual: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Totals after the given steps and one by ``residual``; the square of that step's length; and whether momentum points uphill (over 0)."""
    k = len(residual)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r, ahead, p = _numbers(batch)
            r, ahead = advanced(p, r, ahead, steps)
            new = stepped(p, ahead, residual)
            found = [*((n * new) @ p), (n * (new - ahead) ** 2).sum(), (n * (ahead - new) * (new - r)).sum()]
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in found], [f"s{i}" for i in range(k + 2)])

    parts = state.mapInArrow(sums, ", ".join(f"s{i} double" for i in range(k + 2)))
    *totals, moved, uphill = parts.agg(*(F.sum(c) for c in parts.columns)).first()
    return np.array(totals), moved, uphill


def moved_on(state: DataFrame, steps: list[tuple[np.ndarray, float]]) -> DataFrame:
    """The state after some steps, written in place of the old one."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r, ahead, p = _numbers(batch)
            r, ahead = advanced(p, r, ahead, steps)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n, r, ahead)] + batch.columns[3:], batch.schema.names)

    return written(state.mapInArrow(move, state.schema), "rates", instead_of=state)


def rate(p: list[Column], found: Fit) -> Column:
    """The rate of a document with posteriors ``p``."""

    @F.arrow_udf("double")
    def rates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(found.rates(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)), pa.float64())

    return rates(F.array(*p))


def fit(mixed: DataFrame, weights: list[float], tokens: Column, p: list[Column], total: float | None = None) -> Fit:
    """The rates that bring the expected tokens of each domain to ``weights`` of the ``total``.

    ``total``: by default what there is. A domain that no document belongs to is left out,
    its weight unreached. An empty table, or one without tokens, needs no step. The result says
    how many tokens of each domain were wanted and reached. A fit that doesn't settle is an
    error, not a result.
    """
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be nonnegative, and not all zero")
    shares, k = np.array(weights) / sum(weights), len(p)
    numbers = mixed.select(tokens.cast("double").alias("n"), F.lit(1.0).alias("r"), F.lit(1.0).alias("ahead"), *(x.alias(f"p{i}") for i, x in enumerate(p)))
    state = written(numbers.filter("n > 0"), "rates")
    mass = np.array([x or 0.0 for x in state.agg(*(F.sum(F.col("n") * F.col(f"p{i}")) for i in range(k))).first()])
    size = mass.sum()  # posteriors add up to 1
    inverse = np.where(mass > 0, 1 / np.maximum(mass, 1e-300), 0.0)
    target = shares * (size if total is None else total)
    found = Fit([], target.tolist(), mass.tolist())
    if not size:
        return found
    here = there = mass  # totals of the rates, and of the point ahead
    pace = 1.0
    while len(found.steps) < MOST_STEPS:
        residual = (there - target) * inverse
        done = found.steps[len(found.steps) // CUT * CUT :]  # since the rates were written
        totals, moved, uphill = totals_after(state, done, residual)
        if uphill > 0:
            pace = 1.0
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push, pace = float((pace - 1) / faster), float(faster)
        found.steps.append((residual, push))
        here, there = totals, totals + push * (totals - here)
        found.reached, found.moved = totals.tolist(), float(np.sqrt(moved / size))
        if found.moved <= NEAR:
            return found
        if len(found.steps) % CUT == 0:
            state = moved_on(state, found.steps[-CUT:])
    raise RuntimeError(f"rates did not settle in {MOST_STEPS} steps: the last one moved them by {found.moved}")


def rated(scored: DataFrame, weights: list[float], total: float | None = None, doc_id: str = "doc_id", column: str = "mix") -> DataFrame:
    """``scored`` (of ``with_posterior``) with ``rate`` and ``copies`` in its struct.

    It is written to the shared folder once, so texts are classified once; the steps read the
    numbers alone. A column named ``column`` of ``scored`` is replaced, others stay. ``copies`` is the rate rounded down or up, by a hash of the id, so that it
    is the rate in expectation.
    """
    held = written(scored, "mixed")
    tokens, p = F.col(f"{column}.tokens"), [F.col(f"{column}.p")[k] for k in range(len(weights))]
    found = rate(p, fit(held, weights, tokens, p, total))
    chance = F.pmod(F.xxhash64(F.col(doc_id), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    own = unused(held.columns, "rate")
    parts = (tokens.alias("tokens"), F.col(f"{column}.p").alias("p"), F.col(own).alias("rate"), F.floor(F.col(own) + chance).cast("int").alias("copies"))
    return held.withColumn(own, found).withColumn(column, F.struct(*parts)).drop(own)


def mix(docs: DataFrame, model: Posterior, weights: list[float], total: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as often as their copies say, with the same columns.

    Null and empty texts have no tokens and the prior as posterior. Repeated rows each count.
    An empty table stays empty.
    """
    name = unused(docs.columns, "mix")
    scored = rated(with_posterior(docs, model, text, name), weights, total, doc_id, name)
    return scored.withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(f"{name}.copies")))).drop(name)
