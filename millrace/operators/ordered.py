"""Ranks, running sums and carried values over a whole order, without one task that sees all rows.

The order is cut into ranges of bounded size at sampled bounds. A window within each range counts
and sums; a range's total is one row, and the totals of all ranges before it are added. Which range
a row is in depends on its values alone, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_ROWS, MOST_RANGES = 100_000, 65_536
SAMPLED = 24  # rows a range that choose the bounds
FAN = 256  # ranges whose totals are added up side by side


def _names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until none of the taken ones is the same but for case."""
    have, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def _bounds(df: DataFrame, order: list[str], range_rows: int) -> tuple[list[list], T.StructType]:
    """Bounds between ranges, in groups; the driver gets SAMPLED rows of the order's columns a range."""
    keys = df.select(*(F.col(f"`{c}`") for c in order))
    n = keys.count()
    ranges = min(MOST_RANGES, ceil(n / range_rows))
    if ranges < 2:
        return [], keys.schema
    sample = keys.sample(min(1.0, SAMPLED * ranges / n), 7).orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in order)).collect()
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges) if sample]
    cuts = [c for c, before in zip(cuts, [None, *cuts], strict=False) if c != before]
    wide = max(1, round(len(cuts) ** 0.5))
    return [cuts[i : i + wide] for i in range(0, len(cuts), wide)], keys.schema


def ranged(df: DataFrame, order: list[str], out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with an int column ``out``: the number of the row's range in the order, from 0 and rising.

    Ascending, nulls first; structs of the order's columns compare with sampled bounds, first with
    one of each group of them. Rows that are equal in all columns of the order share a range, so
    an order should be total where one key may have very many rows.
    """
    groups, schema = _bounds(df, order, range_rows)
    if not groups:
        return df.withColumn(out, F.lit(0))
    heads, fine = _names(df.columns, "heads", "fine")
    kind = T.ArrayType(schema)
    table = df.sparkSession.createDataFrame([([g[0] for g in groups], groups)], T.StructType([T.StructField(heads, kind), T.StructField(fine, T.ArrayType(kind))]))
    key = F.struct(*(F.col(f"`{c}`") for c in order))

    def passed(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b <= key))

    group = passed(F.col(heads))
    wide = len(groups[0])
    number = F.when(group == 0, 0).otherwise((group - 1) * wide + passed(F.element_at(fine, F.greatest(group, F.lit(1)))))
    return df.join(F.broadcast(table)).withColumn(out, number.cast("int")).drop(heads, fine)


def _before(totals: DataFrame, number: str, kinds: dict[str, str]) -> DataFrame:
    """``totals`` (a row for each range) with each column of ``kinds`` replaced by what all ranges before have together.

    Kinds are sum and max. Groups of FAN ranges are added up each in a window, their totals in one array of at most MOST_RANGES / FAN.
    """
    group, all_groups = _names(totals.columns, "group", "groups")
    rows = totals.withColumn(group, F.floor(F.col(number) / FAN).cast("int"))
    made = {"sum": F.sum, "max": F.max}
    before = Window.partitionBy(group).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    inner = {c: made[kind](c).over(before) for c, kind in kinds.items()}
    each = rows.groupBy(group).agg(*(made[kind](c).alias(c) for c, kind in kinds.items()))
    whole = each.agg(F.collect_list(F.struct(group, *kinds)).alias(all_groups))
    joined = rows.withColumns(inner).join(F.broadcast(whole))
    earlier = F.filter(all_groups, lambda g: g[group] < F.col(group))

    def over(c: str, kind: str) -> Column:
        values = F.transform(earlier, lambda g: g[c])
        if kind == "max":
            return F.greatest(F.array_max(values), F.col(c))
        zero = F.lit(0).cast(totals.schema[c].dataType)
        return F.aggregate(values, zero, lambda s, x: (s + F.coalesce(x, zero)).cast(totals.schema[c].dataType)) + F.coalesce(c, zero)

    return joined.select(number, *(over(c, kind).alias(c) for c, kind in kinds.items()))


def in_order(df: DataFrame, order: list[str], rank: str | None = None, total: str | None = None, sums: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with what its whole order tells of each row; columns of these names are replaced.

    ``rank``: from 1 (long). ``total``: how many rows there are (long). ``sums``: running sums of
    numbers, the row's own included; null adds nothing. ``latest``: the last value that is not null,
    of the row itself or of those before it. Order: the named columns ascending, nulls
    first; the rank of rows that tie in all of them is one of theirs, but each has its own.
    An empty table gives an empty result.
    """
    sums, latest = sums or {}, latest or {}
    number, place, *rest = _names(df.columns, "range", "place", *(f"part_{i}" for i in range(len(sums) + len(latest))))
    parts, lasts = rest[: len(sums)], rest[len(sums) :]
    dealt = ranged(df, order, number, range_rows)
    upto = Window.partitionBy(number).orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn(place, F.row_number().over(upto).cast("long"))
    for name, value in zip(parts, sums.values(), strict=True):
        own = own.withColumn(name, F.sum(value).over(upto))
    # a running maximum of (range, place, value): the place rises, so the last one counts
    for name, value in zip(lasts, latest.values(), strict=True):
        own = own.withColumn(name, F.max(F.when(value.isNotNull(), F.struct(F.col(number).alias("at"), F.col(place).alias("place"), value.alias("value")))).over(upto))
    ends = own.groupBy(number).agg(F.max(place).alias(place), *(F.max_by(c, place).alias(c) for c in rest))
    bases = _before(ends, number, {place: "sum"} | dict.fromkeys(parts, "sum") | dict.fromkeys(lasts, "max"))
    if total:
        bases = bases.join(F.broadcast(ends.agg(F.sum(place).alias(total))))
    bases = bases.withColumnsRenamed({c: f"base of {c}" for c in (place, *rest)})
    joined = (own.drop(total) if total else own).join(F.broadcast(bases), number)  # at most MOST_RANGES rows
    out = {}
    if rank:
        out[rank] = (F.col(place) + F.col(f"`base of {place}`")).cast("long")
    for name, part in zip(sums, parts, strict=True):
        base = F.col(f"`base of {part}`")
        out[name] = F.coalesce(F.col(part) + base, base)
    for name, part in zip(latest, lasts, strict=True):
        out[name] = F.coalesce(F.col(part), F.col(f"`base of {part}`"))["value"]
    if total:
        out[total] = F.col(total)
    new = [c for c in (rank, total, *sums, *latest) if c]
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c not in new), *(out[c].alias(c) for c in new))
