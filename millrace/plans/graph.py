"""The work graph: projects with facts, intents (edges from facts to a fact) and hints.

Tables: ``projects(id, status, bootstrap_enabled, reason_worker)``, ``facts(project, id)``,
``hints(project, id)``, ``intents(project, id, from, to, description, creator, worker,
created_at)``, ``tasks(project, task_type, worker, intent)``, ``checkpoints(project,
fact_count, hint_count, open_intent_count)``. Each child is aggregated by project before it
is joined, so nothing multiplies, and a project with very many intents costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.asof import as_of
from millrace.operators.scans import replayed
from millrace.operators.versions import first_of
from millrace.sources.scratch import written


def summaries(projects: DataFrame, facts: DataFrame, intents: DataFrame, hints: DataFrame) -> DataFrame:
    """Projects with fact, intent, working, unclaimed, open and hint counts. Open = working + unclaimed."""
    is_open = F.col("to").isNull()
    counts = [
        facts.groupBy("project").agg(F.count("*").alias("fact_count")),
        hints.groupBy("project").agg(F.count("*").alias("hint_count")),
        intents.groupBy("project").agg(
            F.count("*").alias("intent_count"),
            F.count_if(is_open & F.col("worker").isNotNull()).alias("working_intent_count"),
            F.count_if(is_open & F.col("worker").isNull()).alias("unclaimed_intent_count"),
        ),
    ]
    out = projects
    for c in counts:
        out = out.join(c.withColumnRenamed("project", "_p"), F.col("id") == F.col("_p"), "left").drop("_p")
    out = out.fillna(0, ["fact_count", "hint_count", "intent_count", "working_intent_count", "unclaimed_intent_count"])
    return out.withColumn("open_intent_count", F.col("working_intent_count") + F.col("unclaimed_intent_count"))


def is_bootstrap(description: str, creator: str) -> Column:
    """Whether an intent is the open one that starts a project."""
    return (F.col("description") == description) & (F.col("creator") == creator) & (F.col("from") == F.array(F.lit("origin"))) & F.col("to").isNull()


def unclaimed(intents: DataFrame, tasks: DataFrame, bootstrap: Column) -> DataFrame:
    """Open intents without a worker, not running here, and not the bootstrap one."""
    running = tasks.filter((F.col("task_type") == "explore") & F.col("intent").isNotNull()).select(F.col("project").alias("_p"), F.col("intent").alias("_i")).distinct()
    free = intents.filter(F.col("to").isNull() & F.col("worker").isNull() & ~F.coalesce(bootstrap, F.lit(False)))
    return free.join(running, (F.col("project") == F.col("_p")) & (F.col("id") == F.col("_i")), "left_anti")


def newest(intents: DataFrame) -> DataFrame:
    """The newest intent of each project; of equal times the smallest id."""
    return first_of(intents, ["project"], F.desc("created_at"), F.asc("id"))


def bootstrap_choice(intents: DataFrame, bootstrap: Column) -> DataFrame:
    """Each project's bootstrap intent: unclaimed ones first, then the oldest, then the smallest id."""
    return first_of(intents.filter(bootstrap), ["project"], F.col("worker").isNotNull().asc(), F.asc("created_at"), F.asc("id"))


def open_intents(intents: DataFrame) -> DataFrame:
    """What a reasoning task is told of open intents."""
    return intents.filter(F.col("to").isNull()).select("project", "id", "from", "description", "worker")


def allowed_facts(facts: DataFrame) -> DataFrame:
    """Facts that a new intent may begin from."""
    return facts.filter("id != 'goal'")


def hyperedges(intents: DataFrame, facts: DataFrame) -> DataFrame:
    """(project, intent, fact, to): a row for each fact that an intent comes from, if the fact exists."""
    tails = intents.select("project", F.col("id").alias("intent"), F.explode("from").alias("fact"), "to")
    known = facts.select(F.col("project").alias("_p"), F.col("id").alias("_f"))
    return tails.join(known, (F.col("project") == F.col("_p")) & (F.col("fact") == F.col("_f"))).drop("_p", "_f")


def trigger(fact_count: Column, hint_count: Column, open_count: Column, was_facts: Column, was_hints: Column, was_open: Column, known: Column) -> Column:
    """Why to reason again: ``initial``, or what grew, or that the open intents ran out; null for no reason. Decreases don't count."""

    def change(name: str, was: Column, now: Column) -> Column:
        return F.concat(F.lit(f"{name}:"), was.cast("string"), F.lit("->"), now.cast("string"))

    parts = F.array_compact(
        F.array(
            F.when(fact_count > was_facts, change("facts", was_facts, fact_count)),
            F.when(hint_count > was_hints, change("hints", was_hints, hint_count)),
            F.when((was_open > 0) & (open_count == 0), change("open_intents", was_open, F.lit(0))),
        )
    )
    return F.when(~known, "initial").when(F.size(parts) > 0, F.array_join(parts, ","))


def decisions(projects: DataFrame, facts: DataFrame, intents: DataFrame, hints: DataFrame, tasks: DataFrame, checkpoints: DataFrame, bootstrap: Column, pending_cleanup: DataFrame, most_tasks: int, can_bootstrap: bool) -> DataFrame:
    """Each project with its ``decision`` and its reason ``why``, by the first rule that holds.

    cleanup_pending, max_project_workers, inactive; for a project of origin and goal alone:
    reason_claimed, bootstrap, or reason (initial); then reason (on a change), explore (with
    ``intent``), reason_claimed, unchanged.
    """
    shown = summaries(projects, facts, intents, hints)
    is_initial = facts.groupBy("project").agg((F.array_sort(F.collect_set("id")) == F.array(F.lit("goal"), F.lit("origin"))).alias("_two"), F.count("*").alias("_n"))
    only = intents.groupBy("project").agg(F.bool_and(F.coalesce(bootstrap, F.lit(False))).alias("_only"), F.bool_or(F.coalesce(bootstrap, F.lit(False))).alias("_some"))
    running = tasks.groupBy("project").agg(F.count("*").alias("_tasks"))
    best = newest(unclaimed(intents, tasks, bootstrap)).select("project", F.col("id").alias("intent"))
    cleanup = pending_cleanup.select("project", F.lit(True).alias("_cleanup")).distinct()
    was = checkpoints.select("project", *(F.col(c).alias(f"_was_{c}") for c in ("fact_count", "hint_count", "open_intent_count")), F.lit(True).alias("_known"))
    for extra in (is_initial, only, running, best, cleanup, was):
        shown = shown.join(extra.withColumnRenamed("project", "_p"), F.col("id") == F.col("_p"), "left").drop("_p")

    def yes(name: str, default: bool = False) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    why = trigger(*map(F.col, ("fact_count", "hint_count", "open_intent_count", "_was_fact_count", "_was_hint_count", "_was_open_intent_count")), yes("_known"))
    initial = yes("_two") & (F.col("_n") == 2) & yes("_only", True)
    wants_bootstrap = F.col("bootstrap_enabled") & (yes("_some") | F.lit(can_bootstrap))
    claimed = F.col("reason_worker").isNotNull()
    decision = (
        F.when(yes("_cleanup"), "cleanup_pending")
        .when(F.coalesce("_tasks", F.lit(0)) >= most_tasks, "max_project_workers")
        .when(F.col("status") != "active", "inactive")
        .when(initial & claimed, "reason_claimed")
        .when(initial & wants_bootstrap, "bootstrap")
        .when(initial, "reason")
        .when(~claimed & why.isNotNull(), "reason")
        .when(F.col("intent").isNotNull(), "explore")
        .when(claimed, "reason_claimed")
        .otherwise("unchanged")
    )
    out = shown.withColumns({"decision": decision, "why": F.when(decision == "reason", F.when(initial, F.lit("initial")).otherwise(why))})
    return out.select("id", "decision", "why", F.when(decision == "explore", F.col("intent")).alias("intent"), "fact_count", "hint_count", "open_intent_count")


def first_checkpoints(summary: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints to begin with: active projects with open intents that have none yet."""
    fresh = summary.filter((F.col("status") == "active") & (F.col("open_intent_count") > 0))
    fresh = fresh.join(checkpoints.select(F.col("project").alias("_p")), F.col("id") == F.col("_p"), "left_anti")
    return fresh.select(F.col("id").alias("project"), "fact_count", "hint_count", "open_intent_count")


def stopped(projects: DataFrame, intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects and intents after stopping: open claims and the reason lease of stopped projects are cleared."""
    gone = projects.filter("status = 'stopped'").select(F.col("id").alias("_p"), F.lit(True).alias("_stopped"))
    cleared = intents.join(gone, F.col("project") == F.col("_p"), "left")
    cleared = cleared.withColumn("worker", F.when(F.col("_stopped") & F.col("to").isNull(), F.lit(None)).otherwise(F.col("worker"))).drop("_p", "_stopped")
    lease = F.when(F.col("status") != "stopped", F.col("reason_worker"))
    return projects.withColumn("reason_worker", lease), cleared


def checkpoints(tasks: DataFrame) -> DataFrame:
    """Per project the counts of its last reasoning task that succeeded, as they stood when that task was dispatched.

    Columns of a task: ``project, id, task_type, outcome, completed_at`` and the three counts at dispatch (see ``asof.counted_at``).
    Of tasks that end at one time the one with the largest id counts.
    """
    done = tasks.filter((F.col("task_type") == "reason") & (F.col("outcome") == "success"))
    counts = ("fact_count", "hint_count", "open_intent_count")
    last = done.groupBy("project").agg(F.max_by(F.struct(*counts), F.struct("completed_at", "id")).alias("last"))
    return last.select("project", *(F.col("last")[c].alias(c) for c in counts))


#: States of a project, and what requests make of them in that order.
PROJECT_STATES = ["active", "completed", "stopped"]
PROJECT_MOVES = {"complete": ("active", "completed"), "reopen": ("completed", "active"), "stop": ("active", "stopped"), "resume": ("stopped", "active")}


def project_log(requests: DataFrame) -> DataFrame:
    """Requests ``project, at, id, kind`` in their order, with ``from_status`` and ``error_code`` (forbidden where the status doesn't allow it, unknown for another kind).

    A refused request changes nothing, and every project begins active: a scan of composed moves. Requests at one time go by their ids.
    """
    at = {s: i + 1 for i, s in enumerate(PROJECT_STATES)}

    def step(kind: str) -> Column:
        a, b = PROJECT_MOVES[kind]
        return F.array(*(F.lit(at[b if s == a else s]) for s in PROJECT_STATES))

    steps = F.create_map(*(x for kind in PROJECT_MOVES for x in (F.lit(kind), step(kind))))
    needs = F.create_map(*(F.lit(x) for kind, (a, _) in PROJECT_MOVES.items() for x in (kind, a)))
    kind = F.coalesce("kind", F.lit(""))
    told = replayed(requests, "project", ["at", "id"], F.coalesce(F.try_element_at(steps, kind), F.array(F.lit(1), F.lit(2), F.lit(3))), 3, 1, "_state")
    told = told.withColumn("from_status", F.element_at(F.array(*map(F.lit, PROJECT_STATES)), F.col("_state"))).drop("_state")
    need = F.try_element_at(needs, kind)
    return told.withColumn("error_code", F.when(need.isNull(), "unknown").when(need != F.col("from_status"), "forbidden"))


def goal_edges(requests: DataFrame) -> DataFrame:
    """What completing and reopening leaves in the graph: ``project, id, to, description, from, creator``.

    ``requests`` has also ``from`` (the facts of a completion), ``description`` and ``worker``. A completion that no reopening undid is an edge
    to the goal. A reopening undoes the one that stands, and leaves an edge ``external_feedback`` from that one's facts to a new fact of its own.
    Requests of unknown kinds change nothing, so they aren't replayed. The log is written once: three parts of the answer are made from it.
    """
    known = requests.filter(F.col("kind").isin(*PROJECT_MOVES))
    fine = project_log(known).filter("error_code is null and kind in ('complete', 'reopen')").select("project", "at", "id", "kind", "from", "description", "worker")
    fine = written(fine, "log")
    done = fine.filter("kind = 'complete'")
    undone = as_of(fine.filter("kind = 'reopen'").drop("from"), done.select("project", "at", "id", "from"), "project", "at", ["from"], tie="id", own_tie="id")
    feedback = undone.select("project", "id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("to"), F.lit("external_feedback").alias("description"), "from", F.col("worker").alias("creator"))
    last = fine.filter("kind in ('complete', 'reopen')").groupBy("project").agg(F.max_by(F.struct("kind", "id", "description", "from", "worker"), F.struct("at", "id")).alias("last"))
    standing = last.filter("last.kind = 'complete'").select("project", "last.id", F.lit("goal").alias("to"), "last.description", "last.from", F.col("last.worker").alias("creator"))
    return standing.unionByName(feedback)
