"""Rewrites, ranges that overlap, values as of a time, tree digests and the graph's log, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators.asof import as_of, counted_at
from millrace.operators.digests import entry, tree_digest
from millrace.operators.intervals import overlapping
from millrace.plans import graph, reporting
from millrace.sources import rewrites


def names(df):
    return {r.file.rpartition("/")[2] for r in df.collect()}


def table_of(spark, path, rows, schema, files):
    spark.createDataFrame(rows, schema).repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(path)
    return spark.read.parquet(path)


def test_deletes_write_touched_files_alone(spark, tmp_path):
    rows = [(i, i // 10, f"v{i}") for i in range(200)] + [(None, 5, "null"), (7, 0, "again")]
    table = table_of(spark, f"{tmp_path}/t", rows, "id int, file int, mark string", 8)
    before = {f.replace("file:///", "file:/") for f in table.inputFiles()}
    gone = spark.createDataFrame([(7,), (7,), (11,), (9999,), (None,)], "k int")
    out = rewrites.deleted(table, gone, "id", f"{tmp_path}/new")
    assert sorted(map(str, map(tuple, out.rows.collect()))) == sorted(str(r) for r in rows if r[0] not in (7, 11))
    assert sorted(map(tuple, out.gone.collect())) == [(7, 0, "again"), (7, 0, "v7"), (11, 1, "v11")]
    told = {r.file.replace("file:///", "file:/"): (r.rows, r.touched) for r in out.files.collect()}
    assert set(told) == before and sum(n for n, _ in told.values()) == 202 and sum(t for _, t in told.values()) == 3
    stays = {f for f, (_, t) in told.items() if not t}
    assert 6 <= len(stays) < 8 and {f.replace("file:///", "file:/") for f in table.inputFiles()} == before  # the old layout is whole
    copied = spark.read.parquet(f"{tmp_path}/new/data")
    assert copied.count() == sum(n for n, t in told.values() if t) - 3
    read = {f.replace("file:///", "file:/") for f in out.rows.inputFiles()}
    assert stays <= read and any("/new/data/" in f for f in read)
    again = rewrites.deleted(table, spark.createDataFrame([], "k int"), "id", f"{tmp_path}/same")
    assert again.rows.count() == 202 and again.gone.count() == 0 and again.files.filter("touched > 0").count() == 0


def test_updates_and_cascades(spark, tmp_path):
    parents = table_of(spark, f"{tmp_path}/p", [(i, "old") for i in range(40)], "id int, state string", 4)
    children = table_of(spark, f"{tmp_path}/c", [(100 + i, i % 40) for i in range(120)], "id int, parent int", 4)
    leaves = table_of(spark, f"{tmp_path}/l", [(1000 + i, 100 + i % 120) for i in range(240)], "id int, child int", 4)
    new = rewrites.updated(parents, spark.createDataFrame([(3, "x"), (39, None)], "k int, said string"), "id", f"{tmp_path}/u", state=F.col("said"))
    assert {r.id: r.state for r in new.rows.collect()} == {i: "old" for i in range(40)} | {3: "x", 39: None}
    assert sorted(map(tuple, new.gone.collect())) == [(3, "old"), (39, "old")] and new.rows.schema == parents.schema
    out = rewrites.cascaded(parents, spark.createDataFrame([(5,)], "k int"), "id", [(children, "parent", "id"), (leaves, "child", "id")], f"{tmp_path}/x")
    assert [x.gone.count() for x in out] == [1, 3, 6] and [x.rows.count() for x in out] == [39, 117, 234]
    left, told = rewrites.deleted_unreferenced(parents, spark.createDataFrame([(5,), (99,)], "k int"), "id", out[1].rows, "parent", f"{tmp_path}/y")
    assert left.rows.count() == 39 and {r.key: r.error_code for r in told.collect()} == {5: None, 99: "not_found"}
    left, told = rewrites.deleted_unreferenced(parents, spark.createDataFrame([(6,)], "k int"), "id", children, "parent", f"{tmp_path}/z")
    assert left.rows.count() == 40 and told.first().error_code == "conflict"


def test_ranges_meet_once(spark):
    r = random.Random(2)

    def some(n, first):
        out = []
        for i in range(n):
            start = r.choice([r.randrange(-200, 3000), r.randrange(10**7), 64 * r.randrange(20)])
            out.append((r.choice(["hot", "hot", "a", None]), first + i, r.choice([start, start, start, None]), start + r.choice([0, 1, 63, 64, 65, 1000, 10**6, 10**12, -1])))
        return out

    a, b = some(150, 0), some(150, 1000)
    left, right = spark.createDataFrame(a, "file string, a int, s long, e long"), spark.createDataFrame(b, "file string, b int, t long, u long")
    got = Counter((x.a, x.b) for x in overlapping(left, right, ["file"], ("s", "e"), ("t", "u")).collect())
    want = Counter((x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and want
    assert overlapping(left, right.limit(0), ["file"], ("s", "e"), ("t", "u")).count() == 0
    clash = overlapping(left.withColumn("level", F.lit(1)), right.withColumn("bucket", F.lit(2)), ["file"], ("s", "e"), ("t", "u"))
    assert clash.columns == ["file", "a", "s", "e", "level", "b", "t", "u", "bucket"] and clash.count() == sum(want.values())


def test_a_hot_file_is_split(spark):
    left = spark.range(4000).selectExpr("'one' as file", "id as a", "id * 50 as s", "id * 50 + 10 as e")
    right = spark.range(4000).selectExpr("'one' as file", "id as b", "id * 50 + 5 as t", "id * 50 + 6 as u")
    pairs = overlapping(left, right, ["file"], ("s", "e"), ("t", "u"))
    assert pairs.count() == 4000 and pairs.filter("a != b").count() == 0
    assert "l.bucket" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_located_quality(spark):
    schema = "id int, run int, file string, kind int, severity string, first_line int, last_line int"
    truth = spark.createDataFrame([(1, 1, "f", 7, "high", 10, 20), (2, 1, "f", 8, "critical", 1, 5), (3, 1, "g", 7, "low", 1, 9)], schema)
    found = spark.createDataFrame([(1, 1, "f", 7, "x", 20, 30), (2, 1, "f", 7, "x", 12, 12), (3, 1, "f", 8, "x", 6, 9), (4, 1, "f", 9, "x", 1, 1), (5, 2, "f", 7, "x", 12, 12)], schema)
    runs = spark.createDataFrame([(1, 5000, 60.0, 10, 3), (2, 15000, 20.0, 20, 2)], "run int, lines int, seconds double, tokens int, cost int")
    assert tuple(reporting.located_quality(truth, found, runs).first()) == (0.5, 0.4, 0.2, 0.2, 40.0, 15.0, 2.5)
    assert tuple(reporting.located_quality(truth.limit(0), found.limit(0), runs.limit(0)).first()) == (None,) * 7


@pytest.mark.parametrize(("before", "tied", "range_rows"), [(False, False, 20), (True, False, 9), (False, True, 20), (False, False, 100_000)])
def test_as_of(spark, before, tied, range_rows):
    r = random.Random(6)
    pick = lambda: (r.choice(["hot", "hot", "x", None]), r.choice([None, *range(30)]))
    rows = [(*pick(), 3 * i) for i in range(120)]
    history = [(*pick(), 3 * i + 1, r.choice([None, i])) for i in range(120)]
    left = spark.createDataFrame(rows, "k string, at int, n int")
    right = spark.createDataFrame(history, "k string, at int, n int, v int")
    got = as_of(left.withColumn("v", F.lit("old")), right.withColumnRenamed("n", "m"), "k", "at", ["m", "v"], tie="m", own_tie="n" if tied else None, before=before, range_rows=range_rows)
    want = []
    for k, at, n in rows:
        fits = [(h[1], h[2], h[3]) for h in history if k is not None and at is not None and h[0] == k and h[1] is not None and (h[1] < at or h[1] == at and not before and (not tied or h[2] <= n))]
        want.append((k, at, n, *(max(fits, key=lambda h: h[:2])[1:] if fits else (None, None))))
    assert sorted(map(str, map(tuple, got.select("k", "at", "n", "m", "v").collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("range_rows", [15, 100_000])
def test_counts_at_a_time(spark, range_rows):
    r = random.Random(8)
    changes = [(r.choice(["hot", "hot", "x", None]), r.choice([None, *range(20)]), r.choice([1, -1, None])) for _ in range(150)]
    rows = [(r.choice(["hot", "x", "none", None]), r.choice([None, *range(20)]), i) for i in range(60)]
    got = counted_at(spark.createDataFrame(rows, "k string, at int, i int"), spark.createDataFrame(changes, "k string, at int, d int"), "k", "at", {"n": F.lit(1), "net": F.col("d")}, range_rows)
    want = []
    for k, at, i in rows:
        seen = [c for c in changes if k is not None and at is not None and c[0] == k and c[1] is not None and c[1] <= at]
        want.append((k, at, i, len(seen), sum(c[2] or 0 for c in seen)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_checkpoints_are_of_dispatch(spark):
    tasks = spark.createDataFrame([("p", 1, "reason", "success", 5, 1, 0, 2), ("p", 2, "reason", "success", 4, 9, 9, 9), ("p", 3, "reason", "unhealthy", 9, 8, 8, 8), ("p", 4, "explore", "success", 9, 7, 7, 7), ("q", 5, "reason", "crashed", 1, 1, 1, 1)],
        "project string, id int, task_type string, outcome string, completed_at int, fact_count int, hint_count int, open_intent_count int")
    assert [tuple(r) for r in graph.checkpoints(tasks).collect()] == [("p", 1, 0, 2)]


def test_completing_and_reopening(spark):
    def req(project, at, kind, *source):
        return (project, at, at * 10, kind, list(source), f"d{at}", "w")

    rows = [
        req("p", 1, "reopen"), req("p", 2, "complete", "a", "b"), req("p", 3, "complete", "c"), req("p", 4, "reopen"), req("p", 5, "reopen"), req("p", 6, "complete", "d"),
        req("q", 1, "stop"), req("q", 2, "complete", "x"), req("q", 3, "resume"), req("q", 4, "complete", "y"), req("q", 5, "reopen"), req("r", 1, None), req("r", 2, "dance"),
    ]
    df = spark.createDataFrame(rows, "project string, at int, id int, kind string, `from` array<string>, description string, worker string")
    log = {(r.project, r["at"]): (r.from_status, r.error_code) for r in graph.project_log(df).collect()}
    assert log == {
        ("p", 1): ("active", "forbidden"), ("p", 2): ("active", None), ("p", 3): ("completed", "forbidden"), ("p", 4): ("completed", None), ("p", 5): ("active", "forbidden"), ("p", 6): ("active", None),
        ("q", 1): ("active", None), ("q", 2): ("stopped", "forbidden"), ("q", 3): ("stopped", None), ("q", 4): ("active", None), ("q", 5): ("completed", None), ("r", 1): ("active", "unknown"), ("r", 2): ("active", "unknown"),
    }
    edges = sorted((r.project, r.to, r.description, r["from"], r.creator) for r in graph.goal_edges(df).collect())
    assert edges == [("p", "f40", "external_feedback", ["a", "b"], "w"), ("p", "goal", "d6", ["d"], "w"), ("q", "f50", "external_feedback", ["y"], "w")]


def test_the_log_is_replayed_once(spark, tmp_path):
    """Neither the edges nor the states before requests are computed from the requests again: what they read was written."""
    rows = [("p", i, i, "complete" if i % 2 else "reopen", [f"a{i}"], "d", "w") for i in range(600)]
    spark.createDataFrame(rows, "project string, at int, id int, kind string, `from` array<string>, description string, worker string").write.parquet(f"{tmp_path}/requests")
    requests = spark.read.parquet(f"{tmp_path}/requests")
    edges = graph.goal_edges(requests)
    assert edges.count() == 300  # each reopening but the first, and the last completion
    for df in (edges, graph.project_log(requests)):
        assert df.inputFiles() and not [f for f in df.inputFiles() if str(tmp_path) in f]


@pytest.mark.parametrize(("leaf", "range_rows"), [(2, 13), (3, 100_000), (1024, 40)])
def test_tree_digests(spark, leaf, range_rows):
    rows = [("hot", f"p{i:03}", "file", i % 2 == 0, f"h{i}") for i in range(60)] + [(None, "é", "file", None, "h"), (None, None, "link", True, None), ("x", "b", "f", False, "1"), ("x", "b", "f", False, "0"), ("x", "a/z", "f", False, "2")]
    trees = defaultdict(list)
    for key, path, kind, executable, content in rows:
        shown = {True: "true", False: "false", None: ""}[executable]
        trees[key].append(((path is not None, (path or "").encode()), "\x1f".join((path or "", kind, shown, content or ""))))

    def digest(lines):
        for _ in range(2):
            lines = [hashlib.sha256("\n".join(lines[i : i + leaf]).encode()).hexdigest() for i in range(0, len(lines), leaf)]
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()

    df = spark.createDataFrame(rows, "tree string, path string, kind string, executable boolean, content string").repartition(5)
    line = entry(*map(F.col, ("path", "kind", "executable", "content")))
    got = {r.tree: (r.files, r.digest) for r in tree_digest(df, "tree", "path", line, leaf, range_rows).collect()}
    assert got == {k: (len(v), digest([x for _, x in sorted(v)])) for k, v in trees.items()}
    assert tree_digest(df.limit(0), "tree", "path", line).count() == 0


def test_each_condition_alone(spark):
    """Run i breaks condition i alone; run 8 none, and run 9 has nothing."""
    run = lambda schema, rows: spark.createDataFrame(rows, f"run int, {schema}")
    out = reporting.completion(
        run("x int", [(i, 0) for i in range(1, 10)]),
        run("inventoried boolean", [(1, False), (1, None), (8, True)]), run("task string, excluded_reason string", [(2, None, None), (8, "t", None), (8, None, "why")]),
        run("required boolean, status string, failure_reason string", [(3, True, "failed", None), (3, True, None, "x"), (8, False, "failed", None), (8, True, "succeeded", None), (8, True, "failed", "x")]),
        run("status string", [(4, "lost"), (4, None), (8, "succeeded"), (8, "failed")]), run("severity string, verified boolean, unverifiable boolean", [(5, "high", None, False), (8, "high", True, None), (8, "critical", False, True), (8, "low", False, False)]),
        run("status string", [(6, "pending"), (8, "done")]), run("recorded boolean", [(7, None), (8, True)]),
    )
    got = {r.run: list(r)[1:] for r in out.collect()}
    for i in range(1, 8):
        assert [n > 0 for n in got[i][:7]] == [k == i for k in range(1, 8)] and not got[i][7]
    assert got[8] == got[9] == [0] * 7 + [True] and got[1][0] == got[3][2] == got[4][3] == 2


def test_verdicts(spark):
    findings = spark.createDataFrame([(1, "a")], "id int, discovered_by string")
    rows = [(1, "a", "confirmed", False, True), (1, "b", "confirmed", False, True), (1, "b", "confirmed", True, True), (1, "b", "rejected", None, False), (1, "b", None, False, True), (2, "b", "rejected", None, True), (1, None, "rejected", False, True)]
    out = reporting.verdicts(spark.createDataFrame(rows, "finding_id int, verifier string, outcome string, timed_out boolean, environment_ok boolean"), findings)
    assert Counter(r.verdict for r in out.collect()) == {"self": 1, "confirmed": 1, "inconclusive": 3, "rejected": 2}
