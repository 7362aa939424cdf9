"""M-tree search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import mtree
from millrace.llm.queries import op2_mtree


def brute(ids, x, queries, k):
    out = []
    for q in queries:
        scores = sorted((-int(x[q] @ x[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q])
        out += [(int(ids[q]), r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_tree_is_exact_and_saves_distances(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6)) * 500
    x = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)) * 30)
    x[300:400] = x[7]
    x[:5] = 0
    ids = np.arange(900) * 7 % 1009
    tree = mtree.Tree(ids, x, float((x * x).sum(1).max()), 6)
    seen = []
    for page in tree.pages:
        page.points = Counted(page.points, seen)
    for q in range(0, 900, 9):
        want = [(w[2], w[3]) for w in brute(ids, x, [q], 5)]
        got = sorted(tree.search(x[q], ids[q], 5), key=lambda e: (-e[0], e[1]))
        assert [(i, s) for s, i in got] == want
    assert sum(seen) < 0.6 * 100 * 800


class Counted:
    """Counts the rows whose distance a search computes."""

    def __init__(self, points, seen):
        self.points, self.seen = points, seen

    def __len__(self):
        return len(self.points)

    def __getitem__(self, at):
        self.seen.append(len(at))
        return self.points[at]


def test_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64))
    got = sorted(map(tuple, op2_mtree(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(brute(ids, x, [i for i, v in enumerate(ids) if v % 100 == 0], 10))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [0.5, 0.5]), (None, [9.0, 9.0]), (1, [0.5, 0.5]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = mtree.top_k(df.filter("vec_id = 0"), df, 9).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(7, 1024 * 1024), (1, 512 * 1024), (1, 512 * 1024), (8, 512 * 1024), (5, 0), (9, 0)]
    assert mtree.top_k(df.limit(0), df, 3).count() == 0
    assert mtree.top_k(df, df.limit(0), 3).count() == 0


def test_own_id_repeated_beside_equal_rows(spark):
    """A query's own id 12 times and 60 rows equal to it: its 10 best are the smallest other ids."""
    rows = [(100, [1.0, 2.0])] * 12 + [(101 + i, [1.0, 2.0]) for i in range(60)] + [(7, [0.5, 0.5])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = mtree.top_k(df.filter("vec_id = 100"), df, 10).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(101, 111))
    other = mtree.top_k(df.filter("vec_id = 105"), df, 14).orderBy("rank").collect()
    assert [r.vec_id for r in other] == [100] * 12 + [101, 102]
