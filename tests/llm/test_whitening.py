"""Whitening against numpy's covariance and eigenvectors, and exact integers in Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import whitening
from millrace.llm.queries import QUERIES


def brute(rows):
    """n, sums, covariance of the distinct integer vectors."""
    xs = sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in rows})
    n, sums = len(xs), [sum(c) for c in zip(*xs, strict=True)]
    b = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in xs])
    return n, sums, b.T @ b / n, b


def check(spark, rows, width, model, out):
    n, sums, v, b = brute([r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])])
    assert (model.n, model.sums) == (n, sums)
    e, z = np.linalg.eigh(v)
    e = e[::-1][: len(model.values)]
    assert np.allclose(model.values, e, rtol=1e-10)
    for i, value in enumerate(model.values):
        assert np.linalg.norm(v @ model.basis[:, i] - value * model.basis[:, i]) < 1e-10 * e[0] and abs(np.linalg.norm(model.basis[:, i]) - 1) < 1e-12
    assert model.identity_error < 1e-9 and abs(model.trace - np.trace(v)) < 1e-9 * np.trace(v)
    for r in out:
        x = [math.floor(64 * c) + 1_000_000 for c in r.embedding]
        assert int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        want = np.array([c - s / n for c, s in zip(x, sums, strict=True)]) @ model.basis / np.sqrt(model.values)
        assert np.allclose(r.whitened, want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("falling", [True, False])
def test_against_numpy(spark, falling):
    """On a spectrum that falls fast the range finder is enough; on a flat one, all dimensions are needed."""
    r = np.random.default_rng(5)
    scale = 40.0 * 0.5 ** np.arange(40) if falling else np.ones(40)
    turn = np.linalg.qr(r.standard_normal((40, 40)))[0]
    data = (r.standard_normal((600, 40)) * scale @ turn).astype(np.float32)
    if falling:
        data = (np.round(r.standard_normal((600, 3)) * [9, 5, 2] @ r.integers(-3, 4, (3, 40))) / 2).astype(np.float32)  # of rank 3: integers of rank 3 too
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(i, data[0].tolist()) for i in range(1000, 1200)] + [(7000, None), (7001, [float("nan")] * 40), (7002, [None] * 40), (None, data[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    model = whitening.fit(df, components=3 if falling else 6, oversample=5)
    assert model.full != falling
    out = whitening.with_whitened(df, model).collect()
    assert len(out) == 801 and sum(r.vec_id is None for r in out) == 1
    check(spark, rows, 40, model, out)


def test_query_over_whole_table(spark, sf_dir):
    got = QUERIES["op11_whitening"](spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    check(spark, [(r.vec_id, r.embedding) for r in vectors.collect()], 64, model, whitening.with_whitened(vectors, model).collect())
    rows = got.collect()
    assert len(rows) == 16 * vectors.count() and {r.component for r in rows} == set(range(1, 17))
    assert len({r.identity_error for r in rows}) == 1 and max(r.identity_error for r in rows) < 1e-4
    assert all(abs(r.explained - model.values[r.component - 1] / model.trace) < 1e-9 for r in rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    model = whitening.fit(empty)
    assert whitening.by_component(whitening.with_whitened(empty, model), model).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    model = whitening.fit(same)
    assert model.n == 1 and [r.whitened for r in whitening.with_whitened(same, model).collect()] == [[]] * 4
    mixed = spark.createDataFrame([(1, [1.0], "p"), (2, [0.5, 3.0], "q"), (3, [], "r"), (1, [1.0], "p")], "vec_id long, embedding array<float>, x string")
    model = whitening.fit(mixed)
    out = whitening.with_whitened(mixed, model)
    assert out.columns == ["vec_id", "embedding", "x", "whitened", "deviation"] and model.n == 3 and len(model.values) == 2
    assert sorted(r.x for r in out.collect()) == ["p", "p", "q", "r"]
    clash = whitening.with_whitened(mixed.withColumn("both", F.lit(1)).withColumn("deviation", F.lit("old")), model)
    assert {r.both for r in clash.collect()} == {1} and "old" not in {str(r.deviation) for r in clash.collect()}
    with pytest.raises(Exception, match="too large"):
        whitening.fit(spark.createDataFrame([(1, [1e30]), (2, [2.0])], "vec_id long, embedding array<float>"))


def test_deviations_of_large_tables():
    """Exact where a row's sum leaves 64 bits, as with very many rows."""
    r = random.Random(1)
    for n in (1, 10, 10**9, 10**11, 10**13):
        sums = [n * 1_000_000 + r.randrange(-n, n + 1) for _ in range(5)]
        model = whitening.Whitening(n, sums, np.zeros((5, 0)), np.zeros(0), 1.0, 0.0, 1, False)
        rows = np.array([[1_000_000 + r.randrange(-9000, 9000) for _ in range(5)] for _ in range(20)])
        assert [int(d) for d in whitening._deviations(model, rows)] == [sum((n * int(c) - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in rows]


def test_a_pass_is_one_job_of_few_tasks_whatever_the_partitions(spark):
    df = spark.createDataFrame([([i, i * i % 7, 3],) for i in range(600)], "x array<long>").repartition(300)
    few = whitening._in_parts(df, 1800)
    assert few.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and few.count() == 600
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("a pass", "")
    try:
        sums = whitening._summed(few, 3, 1, lambda x: x.sum(axis=0)[:, None])
    finally:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("a pass")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sums[:, 0].tolist() == [sum(range(600)), sum(i * i % 7 for i in range(600)), 1800]
    assert len(jobs) <= 3  # two shuffles and the result, not one for each partition
