"""Deletes and updates of Parquet tables by copy on write: only files that hold a touched row are written again.

A table is a folder of files. What a change touches is found by its keys, and told by file
(``_metadata.file_path``). Rows of touched files are copied, changed, into a new folder; other files
stay where they are, under their names. The table after the change is both together. There is no log and
no catalogue: whoever keeps the table keeps the two row sets that ``Changed`` has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import _names


@dataclass
class Changed:
    """``rows``: the table after the change. ``files``: ``file, rows, touched`` of each old file (touched rows; 0: the file stays). ``gone``: rows that left, as they were."""

    rows: DataFrame
    files: DataFrame
    gone: DataFrame


def _rewrite(table: DataFrame, keys: DataFrame, key: str, target: str, changed: dict[str, Column] | None) -> Changed:
    spark, columns = table.sparkSession, table.columns
    file, mark, wanted = _names([*columns, *keys.columns], "file", "mark", "wanted")
    located = table.select("*", F.col("_metadata.file_path").alias(file))
    known = keys.select(F.col(f"`{keys.columns[0]}`").alias(wanted), *(F.col(f"`{c}`") for c in keys.columns[1:])).dropDuplicates([wanted]).withColumn(mark, F.lit(True))
    hit = located.join(known.select(wanted), F.col(f"`{key}`") == F.col(wanted), "left_semi")
    counts = located.groupBy(file).agg(F.count("*").alias("rows")).join(hit.groupBy(F.col(file).alias("at")).agg(F.count("*").alias("touched")), F.col(file) == F.col("at"), "left")
    counts.select(F.col(file).alias("file"), "rows", F.coalesce("touched", F.lit(0)).cast("long").alias("touched")).write.parquet(f"{target}/files")
    files = spark.read.parquet(f"{target}/files")  # fixed from here on
    touched = files.filter("touched > 0").select(F.col("file").alias(file))
    inside = located.join(touched, file, "left_semi")
    if changed is None:
        copied = inside.join(known.select(wanted), F.col(f"`{key}`") == F.col(wanted), "left_anti")
        gone = inside.join(known.select(wanted), F.col(f"`{key}`") == F.col(wanted), "left_semi").select(*(F.col(f"`{c}`") for c in columns))
    else:
        marked = inside.join(known, F.col(f"`{key}`") == F.col(wanted), "left")
        gone = marked.filter(mark).select(*(F.col(f"`{c}`") for c in columns))
        copied = marked.withColumns({c: F.when(F.col(mark), v).otherwise(F.col(f"`{c}`")).cast(table.schema[c].dataType) for c, v in changed.items()})
    copied.select(*(F.col(f"`{c}`") for c in columns)).write.parquet(f"{target}/data")
    stay = located.join(touched, file, "left_anti").select(*(F.col(f"`{c}`") for c in columns))
    return Changed(stay.unionByName(spark.read.schema(table.schema).parquet(f"{target}/data")), files, gone)


def deleted(table: DataFrame, keys: DataFrame, key: str, target: str) -> Changed:
    """The table without the rows whose ``key`` is among ``keys`` (one column). ``table`` must be read from files; ``target`` an unused folder.

    A null key is among none. No touched file: nothing but the list of files is written. Repeated keys and rows are as one key and many rows.
    """
    return _rewrite(table, keys.select(keys.columns[0]), key, target, None)


def updated(table: DataFrame, changes: DataFrame, key: str, target: str, **columns: Column) -> Changed:
    """The table with ``columns`` set anew in the rows whose ``key`` the first column of ``changes`` has; expressions may use the other columns of ``changes``.

    Of changes that repeat a key one counts, so they should not. ``gone`` has the rows as they were.
    """
    return _rewrite(table, changes, key, target, columns)


def cascaded(parent: DataFrame, keys: DataFrame, key: str, chain: list[tuple[DataFrame, str, str]], target: str) -> list[Changed]:
    """A delete of parents and of all that refers to them: for each (child, foreign key, own key) the rows under those that left before it."""
    out = [deleted(parent, keys, key, f"{target}/0")]
    gone = out[0].gone.select(F.col(f"`{key}`").alias("gone"))
    for i, (child, foreign, own) in enumerate(chain, 1):
        out.append(deleted(child, gone, foreign, f"{target}/{i}"))
        gone = out[-1].gone.select(F.col(f"`{own}`").alias("gone"))
    return out


def deleted_unreferenced(parent: DataFrame, keys: DataFrame, key: str, child: DataFrame, foreign: str, target: str) -> tuple[Changed, DataFrame]:
    """A delete of the parents that nothing refers to; and each asked key with its ``error_code``: null, conflict (something does) or not_found."""
    asked = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    used = child.select(F.col(f"`{foreign}`").alias("used")).distinct()
    have = parent.select(F.col(f"`{key}`").alias("have")).distinct()
    told = asked.join(have, F.col("key") == F.col("have"), "left").join(used, F.col("key") == F.col("used"), "left")
    told = told.select("key", F.when(F.col("have").isNull(), "not_found").when(F.col("used").isNotNull(), "conflict").alias("error_code"))
    return deleted(parent, told.filter("error_code is null").select("key"), key, target), told
