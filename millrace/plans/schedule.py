"""Scheduling: worker classes and ranks, cooldowns, admission, weighted choice.

Tables: ``workers(name, task_types, max_running, priority)``, ``tasks(project, task_type,
worker, intent)``, ``outcomes(project, task_type, worker, outcome, at)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import in_order

COOLDOWN = 5  # seconds


def running_by(tasks: DataFrame, key: str) -> DataFrame:
    """Running tasks of each worker or project."""
    return tasks.groupBy(key).agg(F.count("*").alias("running"))


def labels(tasks: DataFrame) -> DataFrame:
    """Per project, the sorted labels ``task:worker[:intent]``."""
    return tasks.groupBy("project").agg(F.array_sort(F.collect_list(F.concat_ws(":", "task_type", "worker", "intent"))).alias("labels"))


def blocked_until(outcomes: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Until when each key is blocked: its last outcome, if of the kind, and the cooldown. Crashes change nothing."""
    told = outcomes.filter(F.col("outcome") != "crashed")
    last = told.groupBy(*by).agg(F.max_by("outcome", F.struct("at", "outcome")).alias("last"), F.max("at").alias("at"))
    return last.filter(F.col("last") == kind).select(*by, (F.col("at") + F.make_interval(secs=F.lit(COOLDOWN))).alias("until"))


def classified(workers: DataFrame, tasks: DataFrame, outcomes: DataFrame, project: str, task_type: str, now: Column) -> DataFrame:
    """Workers with ``running`` and ``class``: task_type, busy, unhealthy, rejected or candidate, the first that holds."""
    load = running_by(tasks, "worker").withColumnRenamed("worker", "_w")
    ill = blocked_until(outcomes, ["worker"], "unhealthy").select(F.col("worker").alias("_u"), F.col("until").alias("_ill"))
    no = blocked_until(outcomes.filter((F.col("project") == project) & (F.col("task_type") == task_type)), ["worker"], "rejected").select(F.col("worker").alias("_r"), F.col("until").alias("_no"))
    out = workers.join(load, F.col("name") == F.col("_w"), "left").join(ill, F.col("name") == F.col("_u"), "left").join(no, F.col("name") == F.col("_r"), "left")
    out = out.withColumn("running", F.coalesce("running", F.lit(0)))
    kind = (
        F.when(~F.array_contains("task_types", task_type), "task_type")
        .when(F.col("running") >= F.col("max_running"), "busy")
        .when(F.col("_ill") > now, "unhealthy")
        .when(F.col("_no") > now, "rejected")
        .otherwise("candidate")
    )
    return out.withColumn("class", kind).drop("_w", "_u", "_r", "_ill", "_no")


def chosen(candidates: DataFrame, by: list[str] | None = None, tie: Column | None = None) -> DataFrame:
    """Candidates ranked by priority, then load, then the tie-break (the name, or a seeded random column).

    ``by``: keys within each of which candidates are ranked; without them, all are, over ranges of the order.
    """
    if by:
        order = Window.partitionBy(*by).orderBy("priority", "running", F.col("name") if tie is None else tie)
        return candidates.withColumn("rank", F.row_number().over(order).cast("long"))
    if tie is None:
        return in_order(candidates, ["priority", "running", "name"], rank="rank")
    return in_order(candidates.withColumn("_tie", tie), ["priority", "running", "_tie", "name"], rank="rank").drop("_tie")


def admitted(projects: DataFrame, cap: int) -> DataFrame:
    """Projects to look at: running ones first, then idle ones as far as the cap on running projects goes.

    Columns ``id, running, turn``. One task ranks them: projects are few.
    """
    order = Window.orderBy(F.desc("running"), "turn", "id")
    active = F.count_if("running").over(Window.partitionBy())
    ranked = projects.withColumn("_rank", F.row_number().over(order)).withColumn("_active", active)
    return ranked.filter(F.col("running") | (F.col("_rank") <= F.greatest(F.col("_active"), F.lit(cap)))).drop("_rank", "_active")


def running_weights(options: DataFrame, weight: str, *order: str) -> DataFrame:
    """Options with ``cum``: the sum of the weights up to each in the order."""
    return in_order(options, list(order), sums={"cum": F.col(weight)})


def weighted_pick(options: DataFrame, weight: str, pick: float | Column, *order: str) -> DataFrame:
    """The first option whose running sum of weights reaches the pick; none where the sum of all doesn't."""
    return running_weights(options, weight, *order).filter(F.col("cum") >= (pick if isinstance(pick, Column) else F.lit(pick))).orderBy("cum", *order).limit(1)


def shares_add_up(options: DataFrame, weight: str, *by: str) -> DataFrame:
    """Whether the weights of each key (of all rows, without keys) are exactly 1 in decimals; a null weight counts as none."""
    return options.groupBy(*by).agg(F.coalesce(F.sum(F.col(weight).cast("decimal(38,18)")) == 1, F.lit(False)).alias("exact"))


def settings_verdict(timeout: Column, interval: Column) -> Column:
    """Whether a lease timeout is over the polling interval, with room."""
    return F.when(timeout <= interval, "error").when(timeout < interval * 2, "warning").otherwise("ok")
