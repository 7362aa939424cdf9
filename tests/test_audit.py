"""Small hand-made audit tables: constraints, lifecycles, relations, the work graph, scheduling, leases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import constraints, lifecycle, listing, relations, versions
from millrace.plans import graph, reporting, schedule
from millrace.queries import EVENT_MOVES, replayed_requests
from millrace.sources import tables
from millrace.streaming import leases

T0 = datetime(2026, 1, 1)


def at(n):
    return T0 + timedelta(seconds=n)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_pages_refuse_bad_bounds(spark):
    df = spark.range(5)
    for limit, offset in ((0, 0), (101, 0), (10, -1)):
        with pytest.raises(ValueError):
            listing.page(df, F.asc("id"), limit=limit, offset=offset)
    assert ids(listing.page(df, F.desc("id"), limit=2, offset=1)) == [2, 3]
    assert listing.total(df.filter("id > 9")).first().total == 0
    envelope = tables.page_envelope(df.limit(2), listing.total(df), 2, 0).first()
    assert len(envelope["items"]) == 2 and (envelope["meta"].limit, envelope["meta"].total) == (2, 5)


def test_page_plans_as_top_n(spark):
    plan = listing.page(spark.range(1000), F.desc("id"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_boolean_filter_is_not_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, active boolean")
    assert ids(listing.filtered(df, active=True)) == [1]
    assert ids(listing.filtered(df, active=False)) == [2]
    assert ids(listing.filtered(df, active=None)) == [1, 2, 3]


def test_policies_versions_and_single_active(spark):
    rows = [{"name": "p", "version": v, "active": a} for v, a in ((1, True), (2, True), (3, False))]
    policies = tables.audit_frame(spark, "audit_policies", rows + [{"name": "q", "version": 1, "active": False}])
    assert [(r.name, r.active_version) for r in versions.active_version(policies).collect()] == [("p", 2)]
    after = versions.insert_policy(policies, tables.audit_frame(spark, "audit_policies", [{"name": "p", "active": True}, {"name": "r", "active": True}]))
    assert sorted((r.name, r.version) for r in after.filter("active").collect()) == [("p", 4), ("r", 1)]
    assert {r.next_version for r in versions.next_version(policies, "name", "version").collect()} == {4, 2}


def test_first_writer_wins_and_checked_append(spark):
    old = spark.createDataFrame([("r1", "f1", 0)], "run string, fp string, at int")
    new = spark.createDataFrame([("r1", "f1", 5), ("r1", "f2", 2), ("r1", "f2", 1), ("r2", "f2", 3)], "run string, fp string, at int")
    good, bad = tables.append_checked(new, old, ["run", "fp"])
    assert sorted(map(tuple, good.select("run", "fp", "at").collect())) == [("r1", "f2", 1), ("r2", "f2", 3)]
    assert {r.error_code for r in bad.collect()} == {"conflict"} and bad.count() == 2


def test_null_keys_conflict_with_none(spark):
    old = spark.createDataFrame([("r1", None), ("r1", "f1")], "run string, fp string")
    new = spark.createDataFrame([("r1", None), ("r1", None), (None, "f1"), ("r1", "f1")], "run string, fp string")
    good, bad = tables.append_checked(new, old, ["run", "fp"])
    assert good.count() == 3 and [tuple(r) for r in bad.collect()] == [("r1", "f1", "conflict")]


def test_a_null_key_is_replayed_as_one(spark):
    rows = [(None, 1, "click"), (None, 2, "purchase"), (5, 1, "click"), (5, 2, "purchase")]
    out = lifecycle.replay(spark.createDataFrame(rows, "k long, n int, target string"), EVENT_MOVES, "view", "k", "n", "target").collect()
    assert sorted((r.k is None, r.n, r.status) for r in out) == [(False, 1, "click"), (False, 2, "purchase"), (True, 1, "click"), (True, 2, "purchase")]


def test_lapsed_tasks(spark):
    rows = [{"id": "a", "status": "running", "lease_expires_at": at(1)}, {"id": "b", "status": "claimed", "lease_expires_at": at(9)}, {"id": "c", "status": "failed", "lease_expires_at": at(1)}, {"id": "d", "status": "claimed"}]
    assert ids(leases.lapsed_tasks(tables.audit_frame(spark, "audit_tasks", rows), F.lit(at(5)))) == ["a"]


def test_checks_let_null_pass(spark):
    df = spark.createDataFrame([(1, 5, "high"), (2, -1, "odd"), (3, None, None)], "id int, n int, severity string")
    assert ids(constraints.violations(df, F.col("n") >= 0)) == [2]
    assert ids(constraints.not_in(df, "severity", constraints.ENUMS["severity"].split())) == [2]
    assert len(constraints.ENUMS) == 22


def test_repeated_keys_ignore_nulls(spark):
    df = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), (None, True), (None, True)], "name string, active boolean")
    assert [(r.name, r.n) for r in constraints.repeated_keys(df, ["name"], F.col("active")).collect()] == [("a", 2)]


def test_ready_snapshots_do_not_change(spark):
    rows = [("a", 1, "creating", 1), ("a", 2, "ready", 2), ("a", 3, "ready", 2), ("a", 4, "ready", 9), ("b", 1, "creating", 1), ("b", 2, "creating", 5)]
    df = spark.createDataFrame(rows, "id string, v int, status string, n int")
    assert [(r.id, r.v) for r in constraints.changed_after_ready(df, "id", "v").collect()] == [("a", 4)]


def test_run_and_finding_moves(spark):
    moves = set(lifecycle.run_moves())
    assert all((a, b) in moves for a, b in zip(lifecycle.PIPELINE, lifecycle.PIPELINE[1:], strict=False))
    assert all((s, "cancelling") in moves and (s, "failed") in moves for s in lifecycle.PIPELINE)
    assert not any(a in lifecycle.TERMINAL for a, _ in moves) and ("created", "preprocessing") not in moves
    assert ("awaiting_human_review", "validating") in lifecycle.FINDING_MOVES and not any(a in ("rejected", "accepted_risk") for a, _ in lifecycle.FINDING_MOVES)
    history = spark.createDataFrame([("r", 1, "created"), ("r", 2, "ingesting"), ("r", 3, "reporting"), ("r", 4, "completed"), ("s", 1, "completed"), ("s", 2, "cancelling")], "run string, n int, status string")
    bad = lifecycle.invalid_moves(history, lifecycle.allowed(spark, lifecycle.run_moves()), "run", ["n"], "status")
    assert sorted((r.run, r.n) for r in bad.collect()) == [("r", 3), ("s", 2)]


def test_refused_requests_change_nothing(spark):
    steps = ["ingesting", "static_scanning", "preprocessing", "completed", "cancelling", "cancelled", "failed"]
    df = spark.createDataFrame([(run, i, s) for run in ("a", "b") for i, s in enumerate(steps)], "run string, n int, target string").repartition(3)
    out = lifecycle.replay(df, lifecycle.run_moves(), "created", "run", "n", "target").orderBy("run", "n").collect()
    assert [r.status for r in out[:7]] == ["ingesting", "ingesting", "preprocessing", "preprocessing", "cancelling", "cancelled", "cancelled"]
    assert [r.error_code is None for r in out[7:]] == [True, False, True, False, True, True, False]


def test_replayed_query_against_plain_python(spark, sf_dir):
    rows = sorted((r.user_id, r.event_id, r.event_type) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect())
    now, expected = {}, []
    for user, event, kind in rows:
        was = now.get(user, "view")
        fine = (was, kind) in EVENT_MOVES
        now[user] = kind if fine else was
        expected.append((event, now[user], fine))
    got = sorted((r.user_id, r.event_id, r.status, r.error_code is None) for r in replayed_requests(spark, sf_dir).collect())
    assert [g[1:] for g in got] == expected


def test_cancel_and_stamps(spark):
    df = spark.createDataFrame([("created",), ("cancelling",), ("cancelled",), ("completed",), ("failed",)], "s string")
    to, error = lifecycle.cancelled(F.col("s"))
    assert [tuple(r) for r in df.select(to, error).collect()] == [("cancelling", None), ("cancelling", None), ("cancelled", None), ("completed", "audit_run_not_cancellable"), ("failed", "audit_run_not_cancellable")]
    log = spark.createDataFrame([("r", 1, "created"), ("r", 2, "ingesting"), ("r", 3, "preprocessing"), ("r", 4, "cancelling"), ("r", 5, "cancelled")], "run string, t int, status string")
    assert tuple(lifecycle.stamped(log, "run", "t", "status").first()) == ("r", 2, "preprocessing", 5)


def test_create_and_attach_errors(spark):
    repos = tables.audit_frame(spark, "repositories", [{"id": "g", "source_type": "git"}, {"id": "z", "source_type": "zip"}])
    policies = tables.audit_frame(spark, "audit_policies", [{"id": "on", "active": True, "version": 3}, {"id": "off", "active": False, "version": 1}])
    snaps = tables.audit_frame(spark, "source_snapshots", [{"id": "s1", "repository_id": "g", "status": "ready"}, {"id": "s2", "repository_id": "z", "status": "ready"}, {"id": "s3", "repository_id": "g", "status": "creating"}])
    cases = [
        ("none", "on", "git_ref", None, "repository_not_found"), ("g", "none", "git_ref", None, "audit_policy_not_found"), ("g", "off", "upload", None, "audit_policy_inactive"),
        ("g", "on", "existing_snapshot", "no", "source_snapshot_not_found"), ("g", "on", "existing_snapshot", "s2", "snapshot_repository_mismatch"), ("g", "on", "existing_snapshot", "s3", "snapshot_not_ready"),
        ("g", "on", "existing_snapshot", "s1", None), ("z", "on", "git_ref", None, "source_type_mismatch"), ("g", "on", "upload", None, "source_type_mismatch"), ("g", "on", "git_ref", None, None), ("z", "on", "upload", None, None),
    ]
    requests = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "id int, repository_id string, policy_id string, source string, snapshot_id string")
    got = {r.id: (r.error_code, r.policy_version) for r in lifecycle.create_errors(requests, repos, policies, snaps).collect()}
    assert [got[i][0] for i in range(len(cases))] == [c[4] for c in cases] and got[9][1] == 3
    moves = [("g", None, "preprocessing", "s1", None), ("g", None, "preprocessing", None, "snapshot_required"), ("g", "s1", "preprocessing", "s3", "snapshot_immutable"), ("g", None, "ingesting", "s1", "snapshot_attachment_not_allowed"), ("g", None, "preprocessing", "s2", "snapshot_repository_mismatch"), ("g", "s1", "reporting", None, None)]
    runs = spark.createDataFrame([(i, *m[:4]) for i, m in enumerate(moves)], "id int, repository_id string, snapshot_id string, target string, offered_snapshot_id string")
    got = {r.id: r.error_code for r in lifecycle.attach_errors(runs, snaps).collect()}
    assert [got[i] for i in range(len(moves))] == [m[4] for m in moves]


def test_nested_detail_keeps_order_and_does_not_multiply(spark):
    findings = spark.createDataFrame([("f1",), ("f2",)], "id string")
    places = spark.createDataFrame([("f1", 2, "b"), ("f1", 1, "a"), ("f1", 3, "c")], "finding_id string, ordinal int, path string")
    proof = spark.createDataFrame([("f1", "e1"), ("f1", "e2")], "finding_id string, eid string")
    out = {r.id: r for r in relations.nested(findings, "id", locations=(places, "finding_id", ["ordinal", "path"]), evidence=(proof, "finding_id", ["eid"])).collect()}
    assert [x.path for x in out["f1"].locations] == ["a", "b", "c"] and len(out["f1"].evidence) == 2
    assert out["f2"].locations == [] and out["f2"].evidence == []


def test_orphans_restrict_and_markers(spark):
    parents, kids = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(10, 1), (11, 7), (12, None)], "kid int, up int")
    assert ids(relations.orphans(kids, parents, "up", "id"), "kid") == [11]
    assert ids(relations.restricted(parents, "id", kids, "up")) == [1]
    projects = spark.createDataFrame([("a", "active"), ("b", "stopped")], "id string, status string")
    tasks = spark.createDataFrame([("a",), ("c",)], "project string")
    assert sorted(r.status for r in relations.status_or_deleted(tasks, projects).collect()) == ["active", "deleted"]
    marks = spark.createDataFrame([("a", "stopped"), ("b", "stopped"), ("c", "stopped")], "id string, status string")
    assert ids(relations.unchanged_markers(marks, projects)) == ["b"]


BOOT = ("start here", "dispatcher")


def work(spark):
    rows = {
        "projects": [(p, "active", p != "plain", None) for p in ("initial", "boot", "plain", "open", "done", "busy", "clean", "same")] + [("held", "active", True, "w9"), ("off", "stopped", True, "w1")],
        "facts": [(p, f) for p in ("initial", "boot", "plain", "open", "done", "busy", "clean", "same", "held", "off") for f in ("origin", "goal")] + [(p, "f1") for p in ("open", "done", "same", "held")],
        "intents": [("boot", "b1", ["origin"], None, *BOOT, None, "1"), ("open", "i1", ["origin"], None, "x", "c", None, "1"), ("open", "i2", ["f1", "origin", "gone"], None, "x", "c", None, "2"), ("open", "i3", ["f1"], None, "x", "c", None, "3"),
                    ("done", "i1", ["origin"], "f1", "x", "c", "w1", "1"), ("same", "i1", ["origin"], "f1", "x", "c", "w1", "1"), ("off", "i1", ["origin"], None, "x", "c", "w1", "1"), ("off", "i2", ["origin"], "f1", "x", "c", "w1", "1")],
    }
    make = spark.createDataFrame
    return {
        "projects": make(rows["projects"], "id string, status string, bootstrap_enabled boolean, reason_worker string"),
        "facts": make(rows["facts"], "project string, id string"),
        "intents": make(rows["intents"], "project string, id string, from array<string>, to string, description string, creator string, worker string, created_at string"),
        "hints": make([("open", "h1")], "project string, id string"),
        "tasks": make([("open", "explore", "w1", "i3"), ("busy", "reason", "w1", None), ("busy", "explore", "w2", "i9")], "project string, task_type string, worker string, intent string"),
        "checkpoints": make([("open", 3, 1, 2), ("done", 2, 0, 3), ("same", 3, 0, 0), ("held", 1, 0, 0)], "project string, fact_count int, hint_count int, open_intent_count int"),
    }


def test_decisions_by_first_rule(spark):
    w = work(spark)
    boot = graph.is_bootstrap(*BOOT)
    cleanup = spark.createDataFrame([("clean",)], "project string")
    got = {r.id: (r.decision, r.why, r.intent) for r in graph.decisions(w["projects"], w["facts"], w["intents"], w["hints"], w["tasks"], w["checkpoints"], boot, cleanup, 2, True).collect()}
    assert got == {
        "initial": ("bootstrap", None, None), "boot": ("bootstrap", None, None), "plain": ("reason", "initial", None), "open": ("explore", None, "i2"),
        "done": ("reason", "facts:2->3,open_intents:3->0", None), "busy": ("max_project_workers", None, None), "clean": ("cleanup_pending", None, None),
        "same": ("unchanged", None, None), "held": ("reason_claimed", None, None), "off": ("inactive", None, None),
    }
    assert ids(graph.unclaimed(w["intents"], w["tasks"], boot)) == ["i1", "i2"]
    assert sorted((r.intent, r.fact) for r in graph.hyperedges(w["intents"].filter("project = 'open'"), w["facts"]).collect()) == [("i1", "origin"), ("i2", "f1"), ("i2", "origin"), ("i3", "f1")]
    assert graph.bootstrap_choice(w["intents"], boot).first().id == "b1"
    assert "goal" not in ids(graph.allowed_facts(w["facts"])) and graph.open_intents(w["intents"]).count() == 5
    summary = graph.summaries(w["projects"], w["facts"], w["intents"], w["hints"])
    assert ids(graph.first_checkpoints(summary, w["checkpoints"]), "project") == ["boot"]
    projects, intents = graph.stopped(w["projects"], w["intents"])
    assert projects.filter("id = 'off'").first().reason_worker is None and projects.filter("id = 'held'").first().reason_worker == "w9"
    assert {r.id: r.worker for r in intents.filter("project = 'off'").collect()} == {"i1": None, "i2": "w1"}


def test_workers(spark):
    workers = spark.createDataFrame([("busy", ["explore"], 1, 1), ("ill", ["explore"], 2, 1), ("no", ["explore"], 2, 1), ("other", ["reason"], 2, 1), ("x", ["explore"], 9, 2), ("y", ["explore"], 9, 2), ("back", ["explore"], 9, 3)], "name string, task_types array<string>, max_running int, priority int")
    tasks = spark.createDataFrame([("p", "explore", "busy", "i"), ("p", "explore", "x", None)], "project string, task_type string, worker string, intent string")
    outcomes = spark.createDataFrame([("q", "reason", "ill", "unhealthy", at(8)), ("q", "reason", "ill", "crashed", at(9)), ("p", "explore", "no", "rejected", at(7)), ("q", "explore", "y", "rejected", at(9)), ("p", "explore", "back", "unhealthy", at(1)), ("p", "explore", "back", "success", at(9))], "project string, task_type string, worker string, outcome string, at timestamp")
    out = schedule.classified(workers, tasks, outcomes, "p", "explore", F.lit(at(10)))
    assert {r["name"]: r["class"] for r in out.collect()} == {"busy": "busy", "ill": "unhealthy", "no": "rejected", "other": "task_type", "x": "candidate", "y": "candidate", "back": "candidate"}
    assert [r.name for r in schedule.chosen(out.filter("class = 'candidate'")).orderBy("rank").collect()] == ["y", "x", "back"]
    assert schedule.labels(tasks).first().labels == ["explore:busy:i", "explore:x"]
    options = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5)], "name string, weight double")
    assert schedule.weighted_pick(options, "weight", 0.45, "name").first().name == "b"
    verdicts = spark.createDataFrame([(5, 5), (9, 5), (10, 5)], "t int, i int").select(schedule.settings_verdict(F.col("t"), F.col("i")).alias("v"))
    assert [r.v for r in verdicts.collect()] == ["error", "warning", "ok"]
    projects = spark.createDataFrame([("a", True, 3), ("b", False, 0), ("c", False, 1), ("d", True, 2)], "id string, running boolean, turn long")
    assert ids(schedule.admitted(projects, 3)) == ["a", "b", "d"]


def test_leases_in_batch(spark):
    df = spark.createDataFrame([("fresh", "w", at(95)), ("old", "w", at(60)), ("never", "w", None)], "id string, worker string, last_heartbeat_at timestamp")
    assert {r.id: r.worker for r in leases.expired_cleared(df, F.lit(at(100)), 30).collect()} == {"fresh": "w", "old": None, "never": None}
    beats = spark.createDataFrame([("ok", at(0), 200), ("ok", at(5), 500), ("ok", at(9), 200), ("denied", at(0), 200), ("denied", at(5), 409), ("gone", at(0), 200), ("gone", at(5), 0), ("gone", at(10), 0), ("gone", at(15), 0)], "task string, at timestamp, status int")
    assert {r.task: (r.lost_at, r.why) for r in leases.heartbeat_failures(beats, 5).collect()} == {"denied": (at(5), "status 409"), "gone": (at(10), "no heartbeat")}
    asked = spark.createDataFrame([("t", at(2), "late"), ("t", at(1), "first")], "task string, at timestamp, reason string")
    assert leases.first_cancellation(asked, "task", "at", "reason").first().reason == "first"


def test_claims_as_a_stream(spark, tmp_path):
    rows = [("k", "a", at(0), "claim", True), ("k", "b", at(5), "claim", True), ("k", "a", at(6), "claim", True), ("k", "b", at(50), "claim", True), ("k", "a", at(51), "heartbeat", True), ("k", "b", at(52), "release", True), ("k", "a", at(53), "claim", False), ("m", "a", at(0), "release", True)]
    schema = "key string, worker string, at timestamp, command string, active boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = leases.claims(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 30)
    run = stream.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    out = spark.sql("select * from answers where key = 'k' order by at").collect()
    assert [r.status for r in out] == [200, 409, 200, 200, 409, 200, 403]
    assert [r.holder for r in out] == ["a", "a", "a", "b", "b", None, None]
    assert spark.sql("select status from answers where key = 'm'").first().status == 409


def test_reports(spark):
    tasks = tables.audit_frame(spark, "audit_tasks", [{"audit_run_id": "r", "type": "sast", "status": s, "attempt": n, "created_at": at(0), "started_at": at(2), "finished_at": at(n * 10)} for s, n in (("succeeded", 1), ("failed", 3))])
    row = reporting.observed(tasks).first()
    assert (row.wait_s, row.run_s, row.succeeded, row.failed, row.retries) == (4, 36, 1, 1, 2)
    cover = tables.audit_frame(spark, "audit_coverage", [{"audit_run_id": "r", "modules_total": 4, "modules_analyzed": 1}, {"audit_run_id": "s", "modules_total": 0, "modules_analyzed": 0}])
    assert [r.modules_ratio for r in reporting.coverage(cover, "modules").orderBy("audit_run_id").collect()] == [0.25, None]
    findings = tables.audit_frame(spark, "findings", [{"id": "a", "severity": "high", "discovered_by": "w"}, {"id": "b", "severity": "low"}, {"id": "c", "severity": "critical"}])
    reviews = tables.audit_frame(spark, "human_reviews", [{"finding_id": "c"}])
    assert ids(reporting.needs_review(findings, reviews)) == ["a"]
    checks = tables.audit_frame(spark, "verifications", [{"id": "v1", "finding_id": "a", "verifier": "w"}, {"id": "v2", "finding_id": "a", "verifier": "x"}])
    assert ids(reporting.self_verified(checks, findings)) == ["v1"]
    files = tables.audit_frame(spark, "artifacts", [{"id": "x", "expires_at": at(1)}, {"id": "y", "expires_at": at(1)}, {"id": "z"}])
    assert ids(reporting.expired(files, F.lit(at(5)), spark.createDataFrame([("y",)], "id string"))) == ["x"]


def test_text_sink_paths(spark, tmp_path):
    tables.write_text(spark.createDataFrame([("a",)], "v string"), "v", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "a"
    for bad in ("relative/x", "/", "/a/../b"):
        with pytest.raises(ValueError):
            tables.write_text(spark.range(1), "id", bad)


def test_changes_only(spark):
    rng = random.Random(3)
    rows = [("k", i, rng.choice(["a", "b", None])) for i in range(60)]
    expected = [i for i, (_, _, v) in enumerate(rows) if i == 0 or rows[i - 1][2] != v]
    assert ids(versions.changed(spark.createDataFrame(rows, "k string, n int, v string"), "k", ["n"], "v"), "n") == expected
