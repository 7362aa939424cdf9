"""Whole orders cut into ranges: ranks, sums and carried values against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.ordered import in_order
from millrace.operators.versions import rotated
from millrace.plans import schedule


def rows_of(n, seed=3):
    r = random.Random(seed)
    return [(r.choice([None, "a", "b", "hot", "hot", "hot"]), r.randrange(40) if r.random() > 0.1 else None, i, r.choice([None, 1, 5, -2])) for i in range(n)]


@pytest.mark.parametrize("range_rows", [7, 50, 10_000])
def test_against_plain_python(spark, range_rows):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, "key string, at int, id int, x int").repartition(5)
    got = in_order(df, ["key", "at", "id"], rank="rank", total="n", sums={"cum": F.col("x"), "ids": F.col("id")}, latest={"last": F.col("x")}, range_rows=range_rows)
    want, cum, ids, last = [], 0, 0, None
    low = lambda v: (v is not None, v)
    for i, (key, at, id_, x) in enumerate(sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2])), 1):
        cum, ids, last = cum + (x or 0), ids + id_, last if x is None else x
        want.append((key, at, id_, x, i, len(rows), cum, ids, last))
    assert [tuple(r) for r in got.orderBy("rank").select("key", "at", "id", "x", "rank", "n", "cum", "ids", "last").collect()] == want


def test_no_window_sees_all_rows(spark):
    df = spark.range(5000).repartition(6)
    out = in_order(df, ["id"], rank="r", total="n", sums={"s": F.col("id")}, range_rows=100)
    assert out.filter("r != id + 1 or n != 5000 or s != id * (id + 1) / 2").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in "\n".join(line for line in plan.split("\n") if "Window" in line)


def test_odd_tables(spark):
    empty = in_order(spark.createDataFrame([], "id int, x int"), ["id"], rank="r", total="n", sums={"s": F.col("x")}, latest={"l": F.col("x")})
    assert empty.columns == ["id", "x", "r", "n", "s", "l"] and empty.count() == 0
    clash = spark.createDataFrame([(i, i % 3, -i) for i in range(60)], "id int, range int, place int")
    out = in_order(clash, ["id"], rank="r", range_rows=9)
    assert sorted(map(tuple, out.collect())) == [(i, i % 3, -i, i + 1) for i in range(60)]
    same = in_order(spark.createDataFrame([(1, i) for i in range(40)], "id int, x int"), ["id"], rank="r", range_rows=5)
    assert sorted(r.r for r in same.collect()) == list(range(1, 41))


def test_rotation_and_choice(spark):
    df = spark.createDataFrame([(c,) for c in "dbca"], "name string")
    assert {r.name: r.turn for r in rotated(df, "name", 1).collect()} == {"b": 0, "c": 1, "d": 2, "a": 3}
    options = spark.createDataFrame([("a", 2), ("b", 3), ("c", 5)], "name string, w int")
    for pick, name in ((0.5, "a"), (2, "a"), (2.5, "b"), (10, "c")):
        assert schedule.weighted_pick(options, "w", pick, "name").first()["name"] == name
    assert schedule.weighted_pick(options, "w", 11, "name").first() is None
    workers = spark.createDataFrame([("x", 1, 0), ("y", 0, 5), ("z", 0, 5)], "name string, priority int, running int")
    assert {r.name: r.rank for r in schedule.chosen(workers).collect()} == {"y": 1, "z": 2, "x": 3}
    assert {r.name: r.rank for r in schedule.chosen(workers, tie=-F.ascii("name")).collect()} == {"z": 1, "y": 2, "x": 3}
