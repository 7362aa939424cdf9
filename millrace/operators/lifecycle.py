"""Lifecycles: allowed transitions, recorded histories, requests, side effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import RANGE_ROWS
from millrace.operators.scans import replayed

#: The pipeline of a run, in order; every status of it may also go to cancelling or failed.
PIPELINE = "created ingesting preprocessing static_scanning semantic_auditing dynamic_verifying machine_review human_review reporting".split()
TERMINAL = "completed completed_with_warnings cancelled failed".split()
STAGES = PIPELINE[1:]
RUN_ENDS = [("reporting", "completed"), ("reporting", "completed_with_warnings"), ("cancelling", "cancelled"), ("cancelling", "failed")]
#: Where a finding may go.
FINDING_MOVES = [
    ("candidate", "validating"), ("candidate", "rejected"),
    ("validating", "machine_confirmed"), ("validating", "rejected"),
    ("machine_confirmed", "awaiting_human_review"),
    ("awaiting_human_review", "confirmed"), ("awaiting_human_review", "rejected"),
    ("awaiting_human_review", "accepted_risk"), ("awaiting_human_review", "validating"),
    ("confirmed", "accepted_risk"),
]


def run_moves() -> list[tuple[str, str]]:
    """All (from, to) that a run may take."""
    out = list(zip(PIPELINE, PIPELINE[1:], strict=False)) + RUN_ENDS
    return out + [(s, t) for s in PIPELINE for t in ("cancelling", "failed")]


def allowed(spark: SparkSession, moves: list[tuple[str, str]]) -> DataFrame:
    """The moves as a table of some dozen rows."""
    return spark.createDataFrame(moves, "from_status string, to_status string")


def invalid_moves(history: DataFrame, moves: DataFrame, by: str, order: list[str], status: str) -> DataFrame:
    """Rows of a recorded history that come after a status from which theirs is not allowed."""
    before = F.lag(status).over(Window.partitionBy(by).orderBy(*order))
    steps = history.withColumn("from_status", before).filter(F.col("from_status").isNotNull())
    ok = moves.select(F.col("from_status").alias("_f"), F.col("to_status").alias("_t"))
    return steps.join(F.broadcast(ok), (F.col("from_status") == F.col("_f")) & (F.col(status) == F.col("_t")), "left_anti")


def cancelled(status: Column) -> tuple[Column, Column]:
    """What a request to cancel makes of a status, and its error code: cancelling and cancelled stay, other ends refuse."""
    done = status.isin("cancelling", "cancelled")
    ended = status.isin(TERMINAL) & ~done
    return F.when(done | ended, status).otherwise(F.lit("cancelling")), F.when(ended, F.lit("audit_run_not_cancellable"))


def replay(requests: DataFrame, moves: list[tuple[str, str]], first: str, by: str, order: str, target: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Requested moves in order, each with ``from_status, status`` and ``error_code``; a refused one changes nothing.

    A refusal decides what the next request starts from: a scan of composed moves over short runs
    of requests, so one key that has very many is split over tasks. Statuses are those of the moves.
    Targets that no move has, and null ones, are refused. Requests of a key that tie in ``order`` go by their other columns.
    """
    statuses = sorted({first, *(s for move in moves for s in move)})
    at = {s: i + 1 for i, s in enumerate(statuses)}
    ok = set(moves)
    same = F.array(*(F.lit(i) for i in at.values()))
    steps = F.create_map(*(x for t in statuses for x in (F.lit(t), F.array(*(F.lit(at[t] if (s, t) in ok else at[s]) for s in statuses)))))
    froms = F.create_map(*(x for t in statuses for x in (F.lit(t), F.array(*(F.lit(s) for s in statuses if (s, t) in ok)).cast("array<string>"))))
    wanted = F.coalesce(F.col(target).cast("string"), F.lit(""))
    rest = [c for c in requests.columns if c not in (by, order)]
    told = replayed(requests, by, [order, *rest], F.coalesce(F.try_element_at(steps, wanted), same), len(statuses), at[first], "_before", range_rows)
    names = F.array(*map(F.lit, statuses))
    fine = F.coalesce(F.array_contains(F.try_element_at(froms, wanted), F.col("from_status")), F.lit(False))
    told = told.withColumn("from_status", F.element_at(names, F.col("_before"))).withColumn("error_code", F.when(~fine, "audit_run_invalid_transition"))
    return told.select(*requests.columns, "from_status", F.when(fine, F.col(target)).otherwise(F.col("from_status")).alias("status"), "error_code")


def stamped(history: DataFrame, by: str, order: str, status: str) -> DataFrame:
    """Per run: ``started_at`` (first ingesting), ``current_stage`` (last status that is a stage), ``completed_at`` (last end)."""
    at, is_stage = F.col(order), F.col(status).isin(STAGES)
    return history.groupBy(by).agg(
        F.min(F.when(F.col(status) == "ingesting", at)).alias("started_at"),
        F.max_by(F.when(is_stage, F.col(status)), F.when(is_stage, at)).alias("current_stage"),
        F.max(F.when(F.col(status).isin(TERMINAL), at)).alias("completed_at"),
    )


def create_errors(requests: DataFrame, repositories: DataFrame, policies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Requests for runs with ``error_code`` (null: accepted) and ``policy_version``; the first failing check names it.

    Columns of a request: ``id, repository_id, policy_id, source`` (existing_snapshot, git_ref or upload) and ``snapshot_id``.
    """
    repo = repositories.select(F.col("id").alias("_repo"), "source_type")
    policy = policies.select(F.col("id").alias("_policy"), "active", F.col("version").alias("policy_version"))
    snap = snapshots.select(F.col("id").alias("_snap"), F.col("repository_id").alias("_snap_repo"), F.col("status").alias("_snap_status"))
    joined = requests.join(repo, F.col("repository_id") == F.col("_repo"), "left").join(policy, F.col("policy_id") == F.col("_policy"), "left")
    joined = joined.join(snap, F.col("snapshot_id") == F.col("_snap"), "left")
    old = F.col("source") == "existing_snapshot"
    code = (
        F.when(F.col("_repo").isNull(), "repository_not_found")
        .when(F.col("_policy").isNull(), "audit_policy_not_found")
        .when(~F.coalesce("active", F.lit(False)), "audit_policy_inactive")
        .when(old & F.col("_snap").isNull(), "source_snapshot_not_found")
        .when(old & (F.col("_snap_repo") != F.col("repository_id")), "snapshot_repository_mismatch")
        .when(old & (F.col("_snap_status") != "ready"), "snapshot_not_ready")
        .when((F.col("source") == "git_ref") & (F.col("source_type") != "git"), "source_type_mismatch")
        .when((F.col("source") == "upload") & (F.col("source_type") == "git"), "source_type_mismatch")
    )
    return joined.select(*requests.columns, "policy_version", code.alias("error_code"))


def attach_errors(runs: DataFrame, snapshots: DataFrame, target: str = "target", offered: str = "offered_snapshot_id") -> DataFrame:
    """Runs asked to move, with the snapshot they would have and the ``error_code`` of attaching it."""
    snap = snapshots.select(F.col("id").alias("_snap"), F.col("repository_id").alias("_snap_repo"), F.col("status").alias("_snap_status"))
    enters = F.col(target) == "preprocessing"
    wanted = F.when(enters, F.coalesce("snapshot_id", offered)).otherwise(F.col("snapshot_id"))
    joined = runs.withColumn("effective_snapshot_id", wanted).join(snap, F.col("effective_snapshot_id") == F.col("_snap"), "left")
    code = (
        F.when(F.col(offered).isNotNull() & ~enters, "snapshot_attachment_not_allowed")
        .when(enters & (F.col("snapshot_id") != F.col(offered)), "snapshot_immutable")
        .when(enters & F.col("effective_snapshot_id").isNull(), "snapshot_required")
        .when(enters & F.col("_snap").isNull(), "source_snapshot_not_found")
        .when(enters & (F.col("_snap_repo") != F.col("repository_id")), "snapshot_repository_mismatch")
        .when(enters & (F.col("_snap_status") != "ready"), "snapshot_not_ready")
    )
    return joined.select(*runs.columns, "effective_snapshot_id", code.alias("error_code"))
