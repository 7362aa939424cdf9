"""Nearest neighbours by a block matrix join of int8 codes.

Queries and candidates are dealt evenly over the rows and columns of a grid; each cell is one
task's work of bounded size. Within a cell, vectors are int8 codes with a scale each, and
tiles of code products give every inner product up to a known error: with residuals r = v -
scale * code, |q.v - q'.v'| <= |q| |r_v| + |r_q| |v'|. A candidate whose upper bound is under
the k-th best lower bound can't be among the k best; the few others are computed again in
double precision from the original vectors and merged into each query's heap. So the result
is exact, not only near: recall is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import salted

CELL_QUERIES, CELL_ROWS = 4096, 16_384  # of a cell
TILE_QUERIES, TILE_ROWS = 512, 2048  # of a tile


class Codes:
    """Vectors of one cell as int8 codes, with scales and the norms that bound the errors."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        top = np.abs(vectors).max(axis=1, initial=0)
        self.scale = np.where(top > 0, top / 127, 1.0)
        self.code = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        # a little over the rounding of these norms themselves
        self.residual = np.sqrt(((vectors - near) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.norm = np.sqrt((vectors**2).sum(axis=1)) * (1 + 1e-9)
        self.near_norm = np.sqrt((near**2).sum(axis=1)) * (1 + 1e-9)


def cell_best(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, row, score) of each query's k best rows of the cell, ties to the smaller id."""
    q, c = Codes(queries), Codes(rows)
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)  # the k-th best score so far
    for a in range(0, len(query_ids), TILE_QUERIES):
        b = min(a + TILE_QUERIES, len(query_ids))
        left = q.code[a:b].astype(np.float32)
        for d in range(0, len(row_ids), TILE_ROWS):
            e = min(d + TILE_ROWS, len(row_ids))
            # products of codes are integers under 2**24 for up to 1040 components: float32 holds them exactly
            tile = (left @ c.code[d:e].astype(np.float32).T if rows.shape[1] <= 1040 else q.code[a:b].astype(np.float64) @ c.code[d:e].astype(np.float64).T).astype(np.float64)
            tile *= q.scale[a:b, None] * c.scale[None, d:e]
            error = q.norm[a:b, None] * c.residual[None, d:e] + q.residual[a:b, None] * c.near_norm[None, d:e] + 1e-12
            lower = tile - error
            if e - d >= k:
                lower[query_ids[a:b, None] == row_ids[None, d:e]] = -np.inf  # the query's own rows, however many
                floor[a:b] = np.maximum(floor[a:b], np.partition(lower, e - d - k, axis=1)[:, e - d - k])
            at_q, at_c = np.nonzero(tile + error >= floor[a:b, None])
            other = query_ids[a + at_q] != row_ids[d + at_c]
            at_q, at_c = at_q[other] + a, at_c[other] + d
            for s in range(0, len(at_q), 1 << 16):  # bounded memory, whatever survives
                i, j = at_q[s : s + (1 << 16)], at_c[s : s + (1 << 16)]
                score = (q.exact[i] * c.exact[j]).sum(axis=1)
                for x, y, v in zip(i.tolist(), row_ids[j].tolist(), score.tolist(), strict=True):
                    heap = heaps[x]
                    if len(heap) < k:
                        heappush(heap, (v, -y))
                    elif (v, -y) > heap[0]:
                        heappushpop(heap, (v, -y))
            full = [(x, heap[0][0]) for x, heap in enumerate(heaps[a:b], a) if len(heap) == k]
            if full:
                at, least = zip(*full, strict=True)
                floor[list(at)] = np.maximum(floor[list(at)], least)
    for query, heap in zip(query_ids.tolist(), heaps, strict=True):
        yield from ((query, -y, v) for v, y in heap)


def usable(vectors: DataFrame, vector: str, zero: bool) -> DataFrame:
    """Rows whose vector is not null, has no null or non-finite component, and (unless ``zero``) is not all zeros."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fine = fine & F.exists(v, lambda x: x != 0)
    return vectors.filter(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns ``query_id, rank, vec_id, score``: each query's k rows of largest inner product, not its own row.

    Ranks run from 1, ties go to the smaller id; fewer rows give fewer ranks. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do null ids.
    Vectors of different lengths count as if filled with zeros. A repeated row is another
    candidate under the same id; of queries that repeat an id, the least vector counts. Scores are sums in double precision over the original
    vectors. Each cell of the grid has at most about CELL_QUERIES queries and CELL_ROWS rows,
    so work is split evenly whatever the vectors are, and cells send k rows a query.
    """

    def sides(df: DataFrame) -> DataFrame:
        return usable(df, vector, False).filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    asked, held = sides(queries).groupBy("id").agg(F.min("v").alias("v")), sides(rows)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    across = max(1, ceil(queries.count() / CELL_QUERIES))
    down = max(ceil(rows.count() / CELL_ROWS), ceil(2 * tasks / across))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("i", salted(F.col("id"), parts=across)).withColumn("j", each(down))
    right = held.withColumn("j", salted(F.col("id"), F.lit(1), parts=down)).withColumn("i", each(across))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(q) and len(c):
            width = max(q["v"].map(len).max(), c["v"].map(len).max())
            found = list(cell_best(q["id"].to_numpy(), _matrix(q["v"], width), c["id"].to_numpy(), _matrix(c["v"], width), k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(cell, "query_id long, vec_id long, score double")
    return ranked(best, k, "score")


def ranked(best: DataFrame, k: int, score: str) -> DataFrame:
    """The k best of each query's partial lists."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
