"""One digest of all entries of a key in their order, for any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import RANGE_ROWS, _names, in_order

LEAF = 1024  # entries of a leaf, and leaves of a section


def entry(path: Column, kind: Column, executable: Column, content: Column) -> Column:
    """A file's line in a tree: path, type, executable bit and content hash, with a separator of our choice; nulls are empty."""
    return F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in (path, kind, executable, content)))


def tree_digest(files: DataFrame, key: str, path: str, line: Column, leaf: int = LEAF, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``<key>, files, digest``: the digest of each key's lines in the order of their paths, and how many there are.

    Form (ours): ``leaf`` lines in order are joined by line ends and hashed (SHA-256, hex); ``leaf`` such digests, joined the same way, are a
    section; the digest is that of all section digests, joined. So no array holds over ``leaf`` lines, and a key
    is split over tasks, yet times and archive order don't count. Paths are ordered by their bytes, nulls first; rows that
    repeat a path by their lines. Null keys are a key. No rows: no digests.
    """
    text, rank = _names(files.columns, "line", "rank")
    ranked = in_order(files.withColumn(text, line), [key, path, text], rank=rank, range_rows=range_rows)
    lines = ranked.select(F.col(f"`{key}`").alias("k"), F.col(text).alias("line"), F.col(rank).alias("rank"))
    first = lines.groupBy(F.col("k").alias("of")).agg(F.min("rank").alias("first"), F.count("*").alias("files"))
    placed = lines.join(first.select("of", "first"), F.col("k").eqNullSafe(F.col("of"))).select("k", (F.col("rank") - F.col("first")).alias("at"), "line")
    for _ in range(2):
        held = F.array_sort(F.collect_list(F.struct("at", "line")))
        rows = placed.groupBy("k", F.floor(F.col("at") / leaf).cast("long").alias("up")).agg(held.alias("held"))
        placed = rows.select("k", F.col("up").alias("at"), F.sha2(F.array_join(F.transform("held", lambda x: x["line"]), "\n"), 256).alias("line"))
    whole = placed.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("held"))
    digest = F.sha2(F.array_join(F.transform("held", lambda x: x["line"]), "\n"), 256)
    return whole.join(first, F.col("k").eqNullSafe(F.col("of"))).select(F.col("k").alias(key), "files", digest.alias("digest"))
