"""Running states of long histories, as scans of composed moves.

Whether a request is refused depends on all before it, but what a run of requests does to each of few
states is a small map, and maps compose. So requests are dealt in short runs, maps are composed
from runs to runs of runs, and starting states come down again: no key is ever one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import RANGE_ROWS, _names, in_order
from millrace.sources.scratch import written

RUN = 256  # rows, or maps, of one array


def _composed(first: Column, then: Column) -> Column:
    """The map that applies both: maps are arrays that hold, for each state from 1, the state it becomes."""
    return F.transform(first, lambda x: F.element_at(then, x))


def _states(held: Column, start: Column) -> Column:
    """The state before each element of ``held`` (structs with a map), from a starting state."""
    begin = F.struct(start.alias("now"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(held, begin, lambda s, r: F.struct(F.element_at(r["map"], s["now"]).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")))["out"]


def replayed(requests: DataFrame, key: str, order: list[str], step: Column, states: int, first: int, out: str, range_rows: int = RANGE_ROWS, run: int = RUN) -> DataFrame:
    """``requests`` with an int column ``out``: the state of the key before each request, of states from 1.

    ``step``: an array that holds the state that each of ``states`` states becomes by the request. Each
    key begins in the state ``first``; null is a key like others. Order: within a key by the named columns, nulls first,
    which should be total. The number of passes grows with the logarithm of the rows; each reads ranked rows that are
    written once, so ranking isn't done again for each level. An empty table gives an empty result.
    """
    map_, place, held, row = _names([*requests.columns, out], "map", "place", "held", "row")
    ranked = written(in_order(requests.withColumn(map_, step), [key, *order], rank=place, range_rows=range_rows), "ranked")
    rows = ranked.select(F.col(f"`{key}`").alias("key"), F.col(place).alias("place"), F.struct(F.col(place).alias("place"), F.col(map_).alias("map"), F.struct(*(F.col(f"`{c}`") for c in requests.columns)).alias("row")).alias("one"))

    def gathered(df: DataFrame) -> DataFrame:
        """Runs of a level: at most ``run`` elements of a key side by side, in order."""
        return df.groupBy("key", F.floor(F.col("place") / run).cast("long").alias("up")).agg(F.array_sort(F.collect_list("one"), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("held"))

    same = F.array(*(F.lit(i + 1) for i in range(states)))
    levels, n = [gathered(rows)], ranked.count()
    while n >= run:
        n //= run
        whole = F.aggregate("held", same, lambda m, r: _composed(m, r["map"]))
        levels.append(gathered(levels[-1].select("key", F.col("up").alias("place"), F.struct(F.col("up").alias("place"), whole.alias("map")).alias("one"))))
    starts = levels[-1].select("key", "up", "held", F.lit(first).alias("start"))  # one run a key is left
    for level in reversed(levels[:-1]):
        each = starts.select("key", F.explode(F.arrays_zip("held", _states(F.col("held"), F.col("start")).alias("s"))).alias("e"))
        begun = each.select(F.col("key").alias("k"), F.col("e.held.place").alias("at"), F.col("e.s").alias("start"))
        starts = level.join(begun, F.col("key").eqNullSafe(F.col("k")) & (F.col("up") == F.col("at"))).select("key", "up", "held", "start")
    told = starts.select(F.explode(F.arrays_zip("held", _states(F.col("held"), F.col("start")).alias("s"))).alias("e"))
    return told.select(*(F.col("e.held.row")[c].alias(c) for c in requests.columns), F.col("e.s").alias(out))
