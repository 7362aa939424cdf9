"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. ``edges`` has a > b, without repeats.

    Large: every node ties its larger neighbours to its smallest one (itself included).
    Small: every node ties itself and its smaller neighbours to the smallest of them.
    The minimum is aggregated before the join, so a node with very many neighbours costs
    one row a task in the aggregate, and a join whose skew adaptive execution can split.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        out = edges.join(least, F.col("b") == F.col("k")).select("a", F.col("m").alias("b"))
        # the larger neighbours of u are the rows with b = u; each is tied to m(u)
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k"))
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Columns ``node, root`` (longs): for every node that has a link, the smallest node it can reach, itself included.

    Links are undirected; self-links, repeats and nulls are ignored; no links give an empty
    table. Rounds go on until a round changes nothing; their number grows with the logarithm
    of the longest path. Each round is written to the shared folder, so lineage stays short,
    and only row counts and one checksum come to the driver.
    """
    first = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    known = first.filter("a is not null and b is not null and a != b").distinct()
    now = written(known, "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = written(_star(_star(now, True), False), "links", instead_of=now)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
