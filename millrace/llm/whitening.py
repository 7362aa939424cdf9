"""Whitening of embeddings: principal components by a randomised range finder, and rows in their unit scale.

Components become integers first, so the mean and every row's distance from it are exact. The
covariance is never needed whole: a few more random directions than components are wanted
are multiplied by it in one pass over all centred rows, made orthonormal, and multiplied
again (power passes); each pass sums one narrow matrix a task. Rayleigh-Ritz on the directions
gives components and, from the same pass, what each leaves over (its residual). Where residuals
don't get small, as on spectra that hardly fall, the directions become all dimensions: one more
pass, whose components are those of the covariance itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.blockknn import usable
from millrace.llm.common import unused, written

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40  # of an integer component, so that sums of very many stay exact
CHUNK = 16  # columns of a summed matrix that one row holds
SLICE = 1 << 18  # numbers multiplied at once
PART_BYTES = 16 << 20  # of integers that a task of a pass reads, at least (or all)
SMALL = 1e-13  # residual of a component, relative to the largest eigenvalue


@dataclass
class Whitening:
    """What a fit gives. ``sums`` has the sum of each dimension, ``basis`` a component in each column; ``full``: all dimensions were needed."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int
    full: bool


def quantised(vectors: DataFrame, vector: str, out: str, width: int | None = None) -> DataFrame:
    """Rows with a usable vector, and its integers floor(64 c) + 1,000,000 as ``out``, filled with zeros' integers up to ``width``."""
    whole = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE))
    large = F.exists(whole, lambda x: F.abs(x) >= LARGEST)
    whole = F.when(large, F.raise_error(F.lit("a component is too large for exact sums")).cast("array<bigint>")).otherwise(F.transform(whole, lambda x: x + SHIFT))
    if width is not None:
        whole = F.concat(whole, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size(vector)))
    return usable(vectors, vector, True).withColumn(out, whole)


def _matrices(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The rows of a list column as integer matrices of bounded size."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    step = max(1, SLICE // width)
    for i in range(0, len(flat), step):
        yield flat[i : i + step]


def _summed(fit: DataFrame, width: int, columns: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a matrix of ``width`` rows that each part of the fit list's rows gives; a task sends its own sum alone."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, columns))
        for batch in batches:
            for rows in _matrices(batch.column("x"), width):
                total += product(rows)
        padded = np.pad(total, ((0, 0), (0, -columns % CHUNK))).reshape(width, -1, CHUNK)
        at = np.indices(padded.shape[:2]).reshape(2, -1)
        values = pa.FixedSizeListArray.from_arrays(padded.reshape(-1), CHUNK).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), values], ["i", "j", "v"])

    parts = fit.select("x").mapInArrow(part, "i int, j int, v array<double>")
    sums = parts.groupBy("i", "j").agg(F.array(*(F.sum(F.col("v")[c]) for c in range(CHUNK))).alias("v"))
    out = np.zeros((width, ceil(columns / CHUNK) * CHUNK))
    for r in sums.collect():  # one matrix; a job for each partition would cost more than the sums
        out[r.i, r.j * CHUNK : (r.j + 1) * CHUNK] = r.v
    return out[:, :columns]


def _in_parts(rows: DataFrame, numbers: int) -> DataFrame:
    """``rows`` in no more parts than ``numbers`` integers fill, however many partitions or files they come in."""
    most = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(8 * numbers / PART_BYTES))
    return rows.coalesce(most) if rows.rdd.getNumPartitions() > most else rows


def _centred(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Integer rows less the mean, in double precision: the mean's whole part is taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return lambda rows: (rows - whole) - rest


def fit(vectors: DataFrame, components: int = 16, vector: str = "embedding", oversample: int = 10, passes: int = 12, seed: int = 11) -> Whitening:
    """The components of the distinct integer vectors' covariance, by falling eigenvalue; as many as it has a rank for, ``components`` at most.

    The fit list is written once, in the shared folder; each pass reads it. The driver gets one
    matrix of as many rows as dimensions a pass, and keeps the directions. A component's sign
    makes its largest entry positive. Vectors as in ``with_whitened``. Without rows, or of one
    distinct vector, there are no components.
    """
    width = usable(vectors, vector, True).agg(F.max(F.size(vector))).first()[0] or 0
    rows = written(quantised(vectors, vector, "x", width).groupBy("x").agg(F.lit(True).alias("one")).select("x"), "fit-list")
    n = rows.count()
    rows = _in_parts(rows, n * width)  # every pass costs as many tasks as there are parts
    if not n or not width:
        return Whitening(n, [0] * width, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0, False)
    top = rows.agg(F.max(F.array_max(F.transform("x", lambda x: F.abs(x - SHIFT))))).first()[0]
    if n * max(1, top) >= 1 << 53:
        raise ValueError("too many rows of too large components for exact sums")
    sums = [int(s) + n * SHIFT for s in _summed(rows, width, 1, lambda x: (x - SHIFT).sum(axis=0, dtype=np.float64)[:, None])[:, 0]]
    centre = _centred(n, sums)
    trace = float((_summed(rows, width, 1, lambda x: (centre(x) ** 2).sum(axis=0)[:, None]) / n).sum())
    if not trace:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0, False)

    def covered(directions: np.ndarray) -> np.ndarray:
        """The covariance times the directions: a pass over all centred rows."""

        def product(x: np.ndarray) -> np.ndarray:
            b = centre(x)
            return b.T @ (b @ directions)

        return _summed(rows, width, directions.shape[1], product) / n

    def ritz(directions: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Components within the directions, their eigenvalues, and the largest residual of those wanted."""
        inner = directions.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
        basis = directions @ turn
        return basis, values, float(np.sqrt(((image @ turn - basis * values) ** 2).sum(axis=0)).max() / max(values[0], 1e-300))

    room = min(width, components + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, room)))[0]
    before, full, done = np.inf, room == width, 0
    if full:
        q = np.eye(width)
    while True:
        image = covered(q)
        done += 1
        basis, values, left = ritz(q, image)
        if full or left <= SMALL:
            break
        pace = left / before  # of the last pass; what the passes that are left could reach at it
        before = left
        if done >= passes or done > 2 and left * pace ** (passes - done) > SMALL:
            q, full = np.eye(width), True
            continue
        q = np.linalg.qr(image)[0]
    sound = values > trace * 1e-12  # the others are rounding
    basis, values = basis[:, sound], values[sound]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    found = Whitening(n, sums, basis, values, trace, 0.0, done, full)
    spread = _summed(rows, width, basis.shape[1], lambda x: np.pad((w := _projected(found, centre(x))).T @ w, ((0, width - basis.shape[1]), (0, 0)))) / n
    found.identity_error = float(np.abs(spread[: basis.shape[1]] - np.eye(basis.shape[1])).max(initial=0.0))
    return found


def _projected(model: Whitening, centred: np.ndarray) -> np.ndarray:
    return centred @ model.basis / np.sqrt(model.values)


def _deviations(model: Whitening, rows: np.ndarray) -> list[Decimal]:
    """Sums of (n x - S) ^ 2, exact: two limbs of each term add up in 64 bits, and Python's integers join them."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n for s in model.sums], np.int64)
    apart = rows - whole
    if model.n * (int(np.abs(apart).max(initial=0)) + 1) >= 1 << 52 or rows.shape[1] > 1 << 10:
        exact = apart.astype(object) * model.n - rest  # a row of very many or very large components
        return [Decimal(int(s)) for s in (exact * exact).sum(axis=1)]
    term = model.n * apart - rest
    high, low = term >> 26, term & ((1 << 26) - 1)
    limbs = ((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist())
    return [Decimal((a << 52) + (b << 27) + c) for a, b, c in zip(*limbs, strict=True)]


def with_whitened(vectors: DataFrame, model: Whitening, vector: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Rows with a usable vector, its whitened components (array of doubles) and its exact deviation (decimal); columns of these names are replaced.

    Vectors that are null or hold null or non-finite entries are dropped. Shorter vectors count as
    if filled with zeros; longer ones than any of the fit are an error. Repeated rows, null ids
    and other columns stay. Whitened: the integers less their mean, projected on each component,
    over the square root of its eigenvalue. Deviation: the sum of (n x - S) ^ 2.
    """
    width, places = len(model.sums), model.basis.shape[1]
    centre = _centred(model.n, model.sums) if model.n else None
    both = unused(vectors.columns, "both")

    @F.arrow_udf("struct<w: array<double>, d: decimal(38,0)>")
    def both_of(x: pa.Array) -> pa.Array:
        if not len(x) or not width:
            values = [{"w": [], "d": Decimal(0)}] * len(x)
            return pa.array(values, pa.struct([("w", pa.list_(pa.float64())), ("d", pa.decimal128(38, 0))]))
        white, apart = [], []
        for rows in _matrices(x, width):
            white.append(_projected(model, centre(rows)).reshape(-1))
            apart += _deviations(model, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * places, pa.int32()), pa.array(np.concatenate(white)))
        return pa.StructArray.from_arrays([lists, pa.array(apart, pa.decimal128(38, 0))], ["w", "d"])

    x = unused([*vectors.columns, both], "x")
    told = quantised(vectors, vector, x, width).withColumn(both, both_of(F.col(x)))
    return told.drop(x).withColumns({out: F.col(both)["w"], deviation: F.col(both)["d"]}).drop(both)


def by_component(whitened: DataFrame, model: Whitening, vec_id: str = "vec_id") -> DataFrame:
    """A row for each row and component: ``<vec_id>, component, n, deviation, whitened, explained, identity_error``."""
    explained: Column = F.array(*(F.lit(float(v / model.trace)) for v in model.values)).cast("array<double>")
    one = whitened.select(F.col(vec_id), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return one.select(
        vec_id, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
