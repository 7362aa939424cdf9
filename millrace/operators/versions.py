"""Versions: next, latest, active; first writer wins; changes against what was before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import in_order


def next_version(df: DataFrame, name: str, version: str) -> DataFrame:
    """``name, next_version``: one more than the highest."""
    return df.groupBy(name).agg((F.max(version) + 1).cast("long").alias("next_version"))


def first_of(df: DataFrame, by: list[str | Column], *order: Column) -> DataFrame:
    """One row for each key: the first in the order, which must be total to be the same every time."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def active_version(policies: DataFrame) -> DataFrame:
    """Per name, the version that is active: the newest of those inserted as active, which switches older ones off."""
    return policies.filter("active").groupBy("name").agg(F.max("version").alias("active_version"))


def with_single_active(policies: DataFrame) -> DataFrame:
    """The policies with ``active`` as it stands after all inserts."""
    newest = F.max(F.when(F.col("active"), F.col("version"))).over(Window.partitionBy("name"))
    return policies.withColumn("active", F.coalesce(F.col("version") == newest, F.lit(False)))


def insert_policy(policies: DataFrame, new: DataFrame) -> DataFrame:
    """Policies after inserting new ones (one a name): each gets the next version, and a new active one is the only active."""
    have = policies.groupBy("name").agg(F.max("version").alias("_v"))
    numbered = new.drop("version").join(have, "name", "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int")).drop("_v")
    return with_single_active(policies.unionByName(numbered.select(*policies.columns)))


def rotated(df: DataFrame, key: str, cursor: int) -> DataFrame:
    """Rows with ``turn``: their place when the keys' order begins at the cursor (round robin)."""
    ranked = in_order(df, [key], rank="_rank", total="_n")
    return ranked.withColumn("turn", F.pmod(F.col("_rank") - 1 - F.lit(cursor), F.col("_n")).cast("long")).drop("_rank", "_n")


def changed(df: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """Rows whose value differs from the one before (or that have none before): what a log on change keeps."""
    before = F.lag(F.struct(column)).over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_before", before).filter(~F.struct(column).eqNullSafe(F.col("_before"))).drop("_before")
