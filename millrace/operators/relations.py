"""Relations between tables: nested details, existence, orphans, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(parent: DataFrame, key: str, /, **children: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """``parent`` with an array of structs for each child: name = (rows, foreign key, columns in order).

    Each child is gathered by its foreign key before the join, so children don't multiply one
    another. Arrays are ordered by the columns given; a parent without children has an empty one.
    """
    out = parent
    for name, (rows, foreign, columns) in children.items():
        gathered = rows.groupBy(F.col(foreign).alias(f"_{name}")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(gathered, F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}")
        out = out.withColumn(name, F.coalesce(F.col(name), F.array()))
    return out


def referenced(parent: DataFrame, child: DataFrame, on: Column) -> DataFrame:
    """Parents that a child refers to (deleting them is blocked)."""
    return parent.join(child, on, "left_semi")


def unreferenced(parent: DataFrame, child: DataFrame, on: Column) -> DataFrame:
    """Parents that no child refers to (they may be deleted)."""
    return parent.join(child, on, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose reference is not null and has no parent."""
    keys = parent.select(F.col(key).alias("_key"))
    return child.filter(F.col(foreign).isNotNull()).join(keys, F.col(foreign) == F.col("_key"), "left_anti")


def cascade(removed: DataFrame, key: str, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """What deleting rows takes along: for each (child, foreign key, own key), the rows under those before it."""
    out, keys = [], removed.select(F.col(key).alias("_gone"))
    for child, foreign, own in chain:
        rows = child.join(keys, F.col(foreign) == F.col("_gone"), "left_semi")
        out.append(rows)
        keys = rows.select(F.col(own).alias("_gone"))
    return out


def restricted(removed: DataFrame, key: str, child: DataFrame, foreign: str) -> DataFrame:
    """Rows whose deletion a reference restricts."""
    return removed.join(child.select(F.col(foreign).alias("_ref")), F.col(key) == F.col("_ref"), "left_semi")


def status_or_deleted(tasks: DataFrame, projects: DataFrame, key: str = "project") -> DataFrame:
    """Running tasks with their project's status, ``deleted`` where the project is gone."""
    known = projects.select(F.col("id").alias("_id"), F.col("status").alias("_status"))
    return tasks.join(known, F.col(key) == F.col("_id"), "left").withColumn("status", F.coalesce("_status", F.lit("deleted"))).drop("_id", "_status")


def unchanged_markers(markers: DataFrame, projects: DataFrame) -> DataFrame:
    """Markers (id, status) whose project still has that status."""
    return markers.join(projects.select("id", "status"), ["id", "status"], "left_semi")


def bridged(left: DataFrame, left_key: str, bridge: DataFrame, to_left: str, to_right: str, right: DataFrame, right_key: str) -> DataFrame:
    """Many-to-many through a bridge table."""
    return left.join(bridge, F.col(left_key) == F.col(to_left)).join(right, F.col(to_right) == F.col(right_key))


def children_of(tasks: DataFrame, key: str = "id", parent: str = "parent_task_id") -> DataFrame:
    """(parent, child) of a table that refers to itself."""
    up = tasks.select(F.col(key).alias("parent"))
    return tasks.select(F.col(key).alias("child"), F.col(parent).alias("_up")).join(up, F.col("_up") == F.col("parent")).select("parent", "child")
