"""Exact top-k by inner product: best-first search of M-trees.

Components are made integers first, so scores and ties are exact. With M the largest norm,
one more component sqrt(M^2 - |x|^2) puts every row on a sphere, where the largest inner
product is the smallest distance: d^2(q, x) = |q|^2 + M^2 - 2 q.x. That is a metric, so an
M-tree holds the rows: pages of routing entries (an object, its covering radius, its distance
to the page's own routing object) above pages of rows (with that same distance). A search
takes the page of the smallest lower bound first. An entry whose stored distance to the
parent already puts it out of reach costs no distance computation, and the search ends when no
page can hold a better row than the k-th.

Rows are dealt evenly over trees of bounded size (a forest), trees are built side by side and
kept as a table of pages; blocks of queries meet each tree, and the partial lists merge.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush, heappushpop
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blockknn import ranked, usable
from millrace.llm.common import salted, written

PAGE = 64  # entries of a page
TREE_ROWS = 16_384  # of a tree
BLOCK_QUERIES = 2048  # that meet a tree in one task
SLACK = 1e-7  # relative, for rounding of distances


@dataclass
class Page:
    """Entries side by side. A leaf has ``ids`` (of each entry, the smallest of its equal rows, repeats too) and no ``pages``."""

    points: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray
    pages: list[int] | None
    ids: list[list[int]] | None


class Tree:
    """An M-tree over integer rows; equal rows share an entry, which keeps enough of their smallest ids for ``most`` to be left whichever id is a query's own."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, top: float, most: int):
        self.top, self.pages = top, []
        order = np.argsort(ids, kind="stable")
        points, group = np.unique(rows[order], axis=0, return_inverse=True)
        self.ids: list[list[int]] = [[] for _ in points]
        commonest = [0] * len(points)  # how often an entry keeps the id that it keeps most often
        run: dict[int, tuple[int, int]] = {}  # of each entry, the last id and its repeats: ids come in order
        for i, g in zip(ids[order].tolist(), group.reshape(-1).tolist(), strict=True):
            last, n = run.get(g, (i, 0))
            n = n + 1 if last == i else 1
            run[g] = i, n
            if n <= most and len(self.ids[g]) - commonest[g] < most:
                self.ids[g].append(i)
                commonest[g] = max(commonest[g], n)
        self.points = points
        self.square = (points * points).sum(axis=1)
        self.height = np.sqrt(np.maximum(0.0, top - self.square))
        self.root = self._build(np.arange(len(points)), None)[0] if len(points) else -1
        del self.ids, self.points, self.square, self.height

    def _distance(self, i: int, among: np.ndarray) -> np.ndarray:
        """From a row to rows, on the sphere."""
        gap = self.height[among] - self.height[i]
        flat = self.square[among] + self.square[i] - 2 * (self.points[among] @ self.points[i])
        return np.sqrt(np.maximum(0.0, flat + gap * gap))

    def _build(self, members: np.ndarray, parent: int | None) -> tuple[int, float]:
        """The page of the members, and their largest distance to the parent."""
        to_parent = self._distance(parent, members) if parent is not None else np.zeros(len(members))
        far = float(to_parent.max())
        if len(members) <= PAGE:
            page = Page(self.points[members], to_parent, np.zeros(len(members)), None, [self.ids[m] for m in members.tolist()])
        else:
            # routing objects far from one another, each next one farthest from those before
            count = min(PAGE, max(2, ceil(len(members) / PAGE)))
            pivots, nearest, owner = [0], self._distance(int(members[0]), members), np.zeros(len(members), np.int64)
            while len(pivots) < count:
                pivot = int(nearest.argmax())
                if nearest[pivot] <= 0:
                    pivot = next(i for i in range(len(members)) if i not in pivots)
                other = self._distance(int(members[pivot]), members)
                closer = other < nearest
                closer[pivot] = True
                owner[closer], nearest[closer] = len(pivots), other[closer]
                pivots.append(pivot)
            own = [members[owner == g] for g in range(count)]
            routes = [int(members[p]) for p in pivots]
            built = [self._build(m, r) for m, r in zip(own, routes, strict=True) if len(m)]
            kept = [r for m, r in zip(own, routes, strict=True) if len(m)]
            to_route = self._distance(parent, np.array(kept)) if parent is not None else np.zeros(len(kept))
            page = Page(self.points[kept], to_route, np.array([r for _, r in built]), [n for n, _ in built], None)
        self.pages.append(page)
        return len(self.pages) - 1, far

    def search(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows other than the query's own, ties to the smaller id; unordered."""
        if self.root < 0:
            return []
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        base = float(query @ query) + self.top
        slack = SLACK * (1 + sqrt(base))
        reach = float("inf")  # distance of the k-th best
        queue: list[tuple[float, int, float | None]] = [(0.0, self.root, None)]
        while queue:
            bound, number, to_route = heappop(queue)
            if bound > reach + slack:
                break
            page = self.pages[number]
            near = np.arange(len(page.points))
            if to_route is not None and reach < float("inf"):
                near = np.flatnonzero(np.abs(page.to_parent - to_route) - page.radius <= reach + slack)
                if not len(near):
                    continue
            dots = page.points[near] @ query
            if page.pages is not None:
                away = np.sqrt(np.maximum(0.0, base - 2 * dots))
                lower = np.maximum(0.0, away - page.radius[near])
                for i in np.flatnonzero(lower <= reach + slack).tolist():
                    heappush(queue, (float(lower[i]), page.pages[near[i]], float(away[i])))
                continue
            if len(best) == k:
                fine = dots >= best[0][0]
                near, dots = near[fine], dots[fine]
            for i, dot in zip(near.tolist(), dots.tolist(), strict=True):
                for row in page.ids[i]:
                    if row == query_id:
                        continue
                    entry = (int(dot), -row)
                    if len(best) < k:
                        heappush(best, entry)
                    elif entry > best[0]:
                        heappushpop(best, entry)
                    else:
                        break  # the entry's other rows have larger ids
            if len(best) == k:
                reach = sqrt(max(0.0, base - 2 * best[0][0]))
        return [(score, -row) for score, row in best]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def top_k(queries: DataFrame, rows: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """Columns ``query_id, rank, vec_id, score``: each query's k rows of largest integer inner product, not its own row.

    Components become floor(scale * x), x in double precision. Ranks run from 1, ties go to
    the smaller id, fewer rows give fewer ranks. Null vectors and those with null or
    non-finite components take no part, nor do null ids; all-zero vectors do. Vectors of
    different lengths count as if filled with zeros. A repeated row is another candidate
    under the same id; of queries that repeat an id, the least vector counts. Sums of squares
    must stay under 2 ** 53, which double precision holds exactly; larger ones raise an error.
    """
    def sides(df: DataFrame) -> DataFrame:
        whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
        return usable(df, vector, True).filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))

    held = sides(rows)
    asked = sides(queries).groupBy("id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    size = F.size("v")
    top, width, total = held.agg(F.max(square), F.max(size), F.count("*")).first()
    q_top, q_width, q_total = asked.agg(F.max(square), F.max(size), F.count("*")).first()
    if max(top or 0, q_top or 0) >= 2**53:
        raise ValueError("components too large for exact scores")
    top, width = float(top or 0), max(width or 0, q_width or 0)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    across = max(1, ceil(q_total / BLOCK_QUERIES))
    trees = max(ceil(total / TREE_ROWS), ceil(2 * tasks / across))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(group["id"].to_numpy(), _matrix(group["v"], width), top, k)
        return pd.DataFrame({"tree": [key[0]], "pages": [pickle.dumps(tree)]})

    placed = held.withColumn("tree", salted(F.col("id"), F.col("v"), parts=trees))
    forest = written(placed.groupBy("tree").applyInPandas(build, "tree int, pages binary"), "forest")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        def found() -> Iterator[tuple[int, int, int]]:
            for pages in t["pages"]:
                tree = pickle.loads(pages)
                for query_id, v in zip(q["id"].tolist(), _matrix(q["v"], width), strict=True):
                    for score, row in tree.search(v, query_id, k):
                        yield query_id, row, score

        return pd.DataFrame(found(), columns=["query_id", "vec_id", "score"]).astype("int64")

    left = asked.withColumn("i", salted(F.col("id"), parts=across)).withColumn("tree", each(trees))
    right = forest.withColumn("i", each(across))
    best = left.groupBy("i", "tree").cogroup(right.groupBy("i", "tree")).applyInPandas(search, "query_id long, vec_id long, score long")
    return ranked(best, k, "score")
