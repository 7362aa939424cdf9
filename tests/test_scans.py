"""Replays by composed maps against a fold in plain Python."""

import random

import pytest

from millrace.operators.lifecycle import replay
from millrace.operators.scans import replayed
from pyspark.sql import functions as F

MOVES = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "b"), ("c", "d")]


def folded(rows, first="a"):
    now, out, low = {}, [], lambda v: (v is not None, v)
    for key, at, to in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), low(r[2]))):
        was = now.get(key, first)
        fine = (was, to) in MOVES
        now[key] = to if fine else was
        out.append((key, at, to, was, now[key], None if fine else "audit_run_invalid_transition"))
    return out


@pytest.mark.parametrize("range_rows", [40, 100_000])
def test_one_hot_key_and_odd_rows(spark, range_rows):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "x", None]), r.choice([None, *range(300)]), r.choice(["a", "b", "c", "d", "e", None])) for _ in range(700)]
    df = spark.createDataFrame(rows, "user string, at int, to string").repartition(6)
    got = replay(df, MOVES, "a", "user", "at", "to", range_rows)
    assert got.columns == ["user", "at", "to", "from_status", "status", "error_code"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, folded(rows)))


@pytest.mark.parametrize("run", [2, 5, 64])
def test_runs_of_runs(spark, run):
    """Counting modulo 5: every level of runs composes."""
    df = spark.range(200).selectExpr("id % 3 as k", "id as map", "'x' as place").repartition(4)
    step = F.array(*(F.lit(i % 5 + 1) for i in range(1, 6)))
    got = replayed(df, "k", ["map"], step, 5, 1, "before", range_rows=30, run=run)
    assert sorted(map(tuple, got.collect())) == sorted((i % 3, i, "x", i // 3 % 5 + 1) for i in range(200))


def test_no_python_and_empty(spark):
    empty = replay(spark.createDataFrame([], "user string, at int, to string"), MOVES, "a", "user", "at", "to")
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
