"""The additive model: what it can learn, held-out accuracy, and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import gam
from millrace.llm.queries import op5_gam


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_learns_curves_and_interactions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = (np.abs(x[:, 0]) + 2 * (x[:, 1] > 0) * (x[:, 2] > 0) > 1.5).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert auc(y[3000:], model.odds(x[3000:])) > 0.97
    assert (1, 2) in model.pairs


def test_one_kind_of_label_or_none():
    x = np.zeros((10, 3))
    assert np.allclose(gam.fit(x, np.ones(10)).score(x), 11 / 12)
    assert gam.fit(np.empty((0, 3)), np.empty(0)).score(x)[0] == 0.5


def test_equal_texts_score_alike_in_any_batch(spark):
    rows = [(i, "Some words here, and more. " * (i % 3), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(60)] + [(None, 1, 1), (4, None, 0), (4, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = gam.with_score(docs, gam.learn(docs, labels)).collect()
    assert len(out) == 60 and len({r.score for r in out}) <= 3


def test_nulls_empty_and_long(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, " \n"), (3, "a" * 100_000), (4, "w " * 100_000), (4, "w")], "doc_id long, text string")
    model = gam.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    scores = [r.score for r in gam.with_score(docs, model).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert gam.with_score(docs.limit(0), gam.learn(docs.limit(0), docs.limit(0).withColumn("quality", F.lit(1)))).count() == 0


def test_query_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op5_gam(spark, sf).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    y, s, p = map(np.array, zip(*held, strict=True))
    assert auc(y, s) > 0.95
    assert (y == p).mean() > 0.9
