"""What was so at a time: last values and counts as they stood, over ranges of one order of key and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import RANGE_ROWS, in_order


def as_of(rows: DataFrame, history: DataFrame, by: str, at: str, values: list[str], tie: str | None = None, own_tie: str | None = None, before: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with the columns ``values`` of the last row of ``history`` of the same key ``by`` at or before its time ``at``; null where there is none.

    Ties of time: history at the very time counts, unless ``before``; of history rows at one time the one
    with the largest ``tie`` counts. With ``own_tie`` (a column of ``rows`` of the type of ``tie``) rows and history are in one order of
    time and tie. Rows with a null key or time get nulls. Columns of the names in ``values`` are replaced.
    """
    none = "string" if tie is None else dict(history.dtypes)[tie]
    side = F.lit(0 if before else 2)
    late = F.col(f"`{own_tie}`") if own_tie else F.lit(None).cast(none)
    kept = [c for c in rows.columns if c not in values]
    told = F.struct(*(F.col(f"`{c}`") for c in values))
    # of rows at one time, history comes first (side 1) unless only earlier times count; with a tie of their own, by that
    mine = rows.select(F.col(by).alias("k"), F.col(at).alias("at"), (late if own_tie else F.lit(None).cast(none)).alias("tie"), side.alias("side"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.lit(None).cast(history.select(told.alias("h")).schema["h"].dataType).alias("h"))
    theirs = history.select(F.col(by).alias("k"), F.col(at).alias("at"), (F.col(f"`{tie}`") if tie else F.lit(None).cast(none)).alias("tie"), F.lit(1).alias("side"), F.lit(None).cast(mine.schema["row"].dataType).alias("row"), told.alias("h"))
    order = ["k", "at", "tie", "side"] if own_tie else ["k", "at", "side", "tie"]
    carried = in_order(mine.unionByName(theirs.filter("k is not null and at is not null")), order, latest={"last": F.when(F.col("h").isNotNull(), F.struct("k", "h"))}, range_rows=range_rows)
    fits = (F.col("last.k") == F.col("k")) & F.col("at").isNotNull()
    return carried.filter("row is not null").select(*(F.col("row")[c].alias(c) for c in kept), *(F.when(fits, F.col("last.h")[c]).alias(c) for c in values))


def counted_at(rows: DataFrame, changes: DataFrame, by: str, at: str, counts: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``counts``: sums, as they stood at each row's time, over the changes of its key up to and at that time.

    ``counts``: numbers of a row of ``changes`` (1 for one more, -1 for one less; null for none). Keys without changes count 0; so do rows with a null key or time.
    """
    kept = [c for c in rows.columns if c not in counts]
    mine = rows.select(F.col(by).alias("k"), F.col(at).alias("at"), F.lit(2).alias("side"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *(F.lit(0).cast("long").alias(c) for c in counts))
    theirs = changes.select(F.col(by).alias("k"), F.col(at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(mine.schema["row"].dataType).alias("row"), *(F.coalesce(v, F.lit(0)).cast("long").alias(c) for c, v in counts.items()))
    both = mine.unionByName(theirs.filter("k is not null and at is not null"))
    summed = in_order(both, ["k", "at", "side"], rank="rank", sums={f"upto {c}": F.col(c) for c in counts}, range_rows=range_rows)
    first = summed.groupBy("k").agg(*(F.min_by(F.col(f"`upto {c}`") - F.col(c), "rank").alias(f"ahead {c}") for c in counts)).withColumnRenamed("k", "of")
    own = summed.filter("row is not null").join(first, F.col("k") == F.col("of"), "left")
    known = F.col("k").isNotNull() & F.col("at").isNotNull()
    return own.select(*(F.col("row")[c].alias(c) for c in kept), *(F.when(known, F.col(f"`upto {c}`") - F.col(f"`ahead {c}`")).otherwise(F.lit(0)).cast("long").alias(c) for c in counts))
