"""Filtered listings: optional conjuncts, totals, ordered pages, point lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import case_folded

MOST, USUAL = 100, 50  # rows of a page


def filtered(df: DataFrame, /, **equal: object) -> DataFrame:
    """Rows equal in every filter that is given; a filter of None adds no conjunct, and none at all no WHERE.

    Booleans compare as SQL ``IS`` does: a null is neither.
    """
    conjuncts = [F.col(c).eqNullSafe(v) if isinstance(v, bool) else F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    return df.filter(reduce(and_, conjuncts)) if conjuncts else df


def total(df: DataFrame) -> DataFrame:
    """The count under the same filters, a column ``total``; 0 for none."""
    return df.agg(F.count("*").alias("total"))


def page(df: DataFrame, *order: Column, limit: int = USUAL, offset: int = 0) -> DataFrame:
    """An ordered page: plans as a top-n of limit + offset rows, not as a sort of the table."""
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit must be from 1 to {MOST}, and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; no row means not found."""
    return df.filter(F.col(key) == F.lit(value))


def same_name(df: DataFrame, column: str, value: str | Column) -> DataFrame:
    """Rows whose name is the value (or another column's) but for case, by full case folding."""
    return df.filter(case_folded(F.col(column)) == (case_folded(value) if isinstance(value, Column) else F.lit(value.casefold())))
