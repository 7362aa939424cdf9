"""The corpus pipeline: documents through four operators, each stage over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
in the shared folder and reads it again as the next stage's documents. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, gam, mixing, simhash
from millrace.llm.common import small_batches, table, unused, written
from millrace.llm.queries import WEIGHTS, label_domains

#: Documents of a lower score are rejected.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, learnt from the labels, doesn't reject.

    Rows are judged by their text alone: a null text counts as empty, rows that repeat stay or
    go together, null ids are ids like others (their labels are none). Without rows, or labels
    to learn from, the model is a constant. All columns stay, also one named ``score``.
    """
    small_batches(spark)
    model = gam.learn(docs, table(spark, sf_dir, "labels"))
    score = unused(docs.columns, "score")
    return gam.with_score(docs, model, out=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Candidates are by SimHash; only texts of five-word shingles that are at least 0.8 alike are
    linked. Texts without words, null ones too, are one group. Rows with a null id all stay; of
    rows that repeat a kept id, one stays. All columns stay; an empty table stays empty.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the domains of the labels to their weights.

    Each row has a rate by its text (null: empty, of no tokens) and goes or comes that often; rows
    that repeat have equal rates. All columns stay, also one named ``mix``; an empty table stays empty.
    """
    small_batches(spark)
    model = mixing.learn(docs, label_domains(spark, sf_dir), len(WEIGHTS))
    return mixing.mix(docs, model, WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (packed) and whether decoding gives the text back, for each document.

    A row for each row: a null text has no tokens, null and repeated ids stay; other columns go.
    """
    small_batches(spark)
    ranks, split = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    name = unused(docs.columns, "coded")
    coded = bpe.with_round_trip(docs.select("doc_id", "text"), ranks, split, out=name)
    ids, decoded = F.col(f"{name}.ids"), F.col(f"{name}.decoded")
    exact = decoded == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", (F.length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"), exact.alias("exact"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("mixed", mixed), ("tokens", tokens)]

#: Boosted tables, components and rates are not expressible in SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
