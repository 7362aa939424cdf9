"""Constraint checks: enumerations, ranges, uniqueness, immutability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The enumerated domains.
ENUMS = {
    "source_type": "git zip local_upload",
    "snapshot_status": "creating ready rejected failed",
    "build_system": "maven gradle mixed unknown",
    "dynamic_verification": "required preferred disabled",
    "run_status": "created ingesting preprocessing static_scanning semantic_auditing dynamic_verifying machine_review human_review reporting completed completed_with_warnings cancelling cancelled failed",
    "stage": "ingesting preprocessing static_scanning semantic_auditing dynamic_verifying machine_review human_review reporting",
    "task_type": "inventory build sast dependency_scan secret_scan config_scan semantic_review dynamic_verify independent_verify coverage_check report",
    "task_status": "queued claimed running succeeded failed cancelled skipped",
    "severity": "critical high medium low info",
    "confidence": "confirmed high medium low",
    "finding_status": "candidate validating machine_confirmed awaiting_human_review confirmed rejected accepted_risk",
    "runtime_verification": "verified unverified not_applicable",
    "location_role": "entrypoint source propagation sink related",
    "artifact_kind": "source_snapshot scan_result build_log runtime_log poc report other",
    "access_level": "normal sensitive",
    "evidence_type": "code_snippet call_trace tool_result build_log unit_test poc_output http_exchange runtime_log",
    "verification_method": "static_corroboration independent_agent build_test dynamic_poc",
    "verdict": "confirmed rejected inconclusive",
    "build_status": "success partial failed",
    "review_verdict": "confirmed rejected accepted_risk reverify",
    "fact_kind": "architecture entrypoint trust_boundary source sink candidate_finding verification_result",
    "intent_status": "pending claimed concluded cancelled",
}


def not_in(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is not null and not one of the allowed."""
    return violations(df, F.col(column).isin(allowed))


def violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows that break a CHECK: those for which it is false. Null passes."""
    return df.filter(~F.coalesce(check, F.lit(True)))


def violation_counts(df: DataFrame, by: str, /, **checks: Column) -> DataFrame:
    """Per group, how many rows break each check; one pass over the table."""
    return df.groupBy(by).agg(*(F.count_if(~F.coalesce(c, F.lit(True))).alias(name) for name, c in checks.items()))


def repeated_keys(df: DataFrame, key: list[str | Column], where: Column | None = None) -> DataFrame:
    """Keys that more than one row has, with ``n``; with ``where``, a partial unique constraint. Keys with a null don't count."""
    rows = df.filter(where) if where is not None else df
    out = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return out.dropna(subset=[c for c in out.columns if c != "n"])


def changed_after_ready(versions: DataFrame, key: str, order: str, status: str = "status") -> DataFrame:
    """Versions of a row that differ, in any other column, from an earlier version that was ready."""
    rest = [c for c in versions.columns if c not in (key, order)]
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sealed = F.min_by(F.struct(*rest), F.when(F.col(status) == "ready", F.col(order))).over(so_far)
    marked = versions.withColumn("_sealed", F.when(F.max(F.when(F.col(status) == "ready", 1)).over(so_far) == 1, sealed))
    return marked.filter(F.col("_sealed").isNotNull() & ~F.struct(*rest).eqNullSafe(F.col("_sealed"))).drop("_sealed")
