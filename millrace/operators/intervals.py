"""Ranges that overlap, each pair once, joined by equality of buckets.

Buckets of a level are 16 times as wide as those of the level below; a range is at home in the lowest
level where it spans two buckets at most, and visits the levels above. Two ranges meet where the longer one
is at home, in the first bucket that both have. So a long range costs no more rows than a short one,
and the rows of one key are split by bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import _names

NARROW, TIMES, LEVELS = 64, 16, 13  # widths of buckets: 64, 1024, ..., over 2 ** 53


def _level(start: Column, end: Column) -> Column:
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(end - start < NARROW * TIMES**k, k).otherwise(out)
    return out


def _bucket(at: Column, level: Column) -> Column:
    width = F.element_at(F.array(*(F.lit(NARROW * TIMES**k).cast("long") for k in range(LEVELS))), level + 1)
    return F.floor((at - F.pmod(at, width)) / width).cast("long")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal ``by`` columns whose ranges (whole numbers, both ends included) have a number in common.

    A pair of rows comes once. Columns: all of ``left``, and those of ``right`` but ``by``; names must differ. A row with a
    null in its key or range, or that ends before it starts, meets none.
    """
    level, bucket, home, top = _names([*left.columns, *right.columns], "level", "bucket", "home", "top")

    def sound(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        start, end = (F.col(f"`{c}`").cast("long") for c in ends)
        return df.filter(reduce(and_, (F.col(f"`{c}`").isNotNull() for c in by), start <= end)).withColumn(home, _level(start, end))

    sides = [(sound(left, left_range), left_range), (sound(right, right_range), right_range)]
    highest = reduce(DataFrame.unionByName, (df.select(F.max(home).alias(top)) for df, _ in sides)).agg(F.max(top).alias(top))  # levels that nobody has are left out

    def dealt(df: DataFrame, ends: tuple[str, str], prefix: str) -> DataFrame:
        start, end = (F.col(f"`{c}`").cast("long") for c in ends)
        rows = df.join(F.broadcast(highest)).withColumn(level, F.explode(F.sequence(home, top))).drop(top)
        rows = rows.withColumn(bucket, F.explode(F.sequence(_bucket(start, F.col(level)), _bucket(end, F.col(level)))))
        return rows.withColumnsRenamed({c: f"{prefix}{c}" for c in (level, bucket, home, *(by if prefix == "r." else ()))})

    a, b = dealt(*sides[0], "l."), dealt(*sides[1], "r.")
    same = reduce(and_, (F.col(f"`{c}`") == F.col(f"`r.{c}`") for c in by))
    at = F.col(f"`l.{level}`")
    meet = same & (at == F.col(f"`r.{level}`")) & (F.col(f"`l.{bucket}`") == F.col(f"`r.{bucket}`"))
    starts = [F.col(f"`{r[0]}`").cast("long") for r in (left_range, right_range)]
    ends = [F.col(f"`{r[1]}`").cast("long") for r in (left_range, right_range)]
    once = (at == F.greatest(F.col(f"`l.{home}`"), F.col(f"`r.{home}`"))) & (F.col(f"`l.{bucket}`") == _bucket(F.greatest(*starts), at))
    pairs = a.join(b, meet & once & (starts[0] <= ends[1]) & (starts[1] <= ends[0]))
    return pairs.select(*(F.col(f"`{c}`") for c in left.columns), *(F.col(f"`{c}`") for c in right.columns if c not in by))
