"""The pipeline's stages against brute force on the smallest tables."""

import importlib.util
from collections import Counter
from collections.abc import Iterator

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline

from millrace.llm import bpe, gam, mixing
from millrace.llm.common import BATCH_BYTES
from millrace.llm.queries import WEIGHTS, label_domains
from tests.llm.test_simhash import brute_copies


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality(spark, docs, sf_dir)
    model = gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = model.score(gam._table([t or "" for t in texts.values()]))
    expected = {i for i, s in zip(texts, scores, strict=True) if s >= 0.3}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == expected

    kept = corpus_pipeline.near_duplicates(spark, good, sf_dir)
    roots = brute_copies({i: texts[i] or "" for i in expected})
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == columns and sorted(ids) == sorted(set(roots.values()))

    out = corpus_pipeline.mixed(spark, kept, sf_dir)
    domain_model = mixing.learn(kept, label_domains(spark, sf_dir), len(WEIGHTS))
    copies = {r.doc_id: r["mix"]["copies"] for r in mixing.rated(mixing.with_posterior(kept, domain_model), WEIGHTS).collect()}
    assert out.columns == columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in copies.items() if n})

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in copies.items() if n})
    for r in rows:
        assert r.exact and memoryview(r.ids).cast("I").tolist() == library.encode_ordinary(texts[r.doc_id] or "")


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same words here and there again", "x"), (4, "same words here and there again", "x"), (None, "lost", "x"), (4, "same words here and there again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("mix", F.lit(1))
    spark.createDataFrame([(1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    where, ids = str(tmp_path), lambda rows: Counter(r.doc_id for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), where).count() == 0

    scores = gam.learn(docs, spark.read.parquet(f"{where}/labels.parquet")).score(gam._table([t or "" for _, t, _ in rows]))
    good = corpus_pipeline.quality(spark, docs, where)
    assert good.columns == docs.columns and {(r.score, r.mix) for r in good.collect()} <= {("x", 1)}
    assert ids(good.collect()) == Counter(i for (i, _, _), s in zip(rows, scores, strict=True) if s >= 0.3)

    model = mixing.learn(docs, label_domains(spark, where), len(WEIGHTS))
    want = Counter()
    for r in mixing.rated(mixing.with_posterior(docs.drop("mix"), model), WEIGHTS).collect():
        want[r.doc_id] += r["mix"]["copies"]
    out = corpus_pipeline.mixed(spark, docs, where)
    assert out.columns == docs.columns and ids(out.collect()) == +want and {r.mix for r in out.collect()} <= {1}

    told = corpus_pipeline.tokens(spark, docs, where).collect()
    assert ids(told) == Counter(i for i, _, _ in rows) and all(r.exact and (r.n_tokens == 0) == (r.doc_id in (1, 2)) for r in told)
    assert sorted((r.doc_id is None, r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [(False, 1), (False, 3), (True, None)]


def test_texts_go_to_python_in_small_batches(spark):
    """A batch by rows alone holds 4,000 of these texts at once, 32 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.rpad(F.lit("words "), 8000, "of a text ").alias("text"))
        corpus_pipeline.tokens(spark, docs, "")

        @F.arrow_udf("long")
        def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([texts.nbytes] * len(texts))

        assert docs.select(F.max(held("text"))).first()[0] < 1.1 * BATCH_BYTES
        spark.conf.set(name, 1000)
        corpus_pipeline.tokens(spark, docs, "")
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)
