"""Table sources with declared schemas, JSON lines, and text sinks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The declared schemas of the audit tables (names and types by column).
SCHEMAS = {
    "repositories": "id string, name string, source_type string, remote_url string, credential_ref string, default_branch string, created_by string, created_at timestamp, updated_at timestamp",
    "source_snapshots": "id string, repository_id string, commit_sha string, content_sha256 string, branch_or_tag string, artifact_id string, file_count int, total_bytes long, java_file_count int, java_version string, build_system string, status string, failure_code string, created_at timestamp",
    "audit_policies": "id string, name string, version int, include_paths array<string>, exclude_paths array<string>, enabled_scanners array<string>, dynamic_verification string, severity_thresholds string, resource_budget string, active boolean, created_at timestamp",
    "audit_runs": "id string, repository_id string, source_request string, snapshot_id string, policy_id string, policy_version int, status string, current_stage string, progress decimal(5,2), warning_count int, failure_code string, failure_reason string, created_by string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "audit_tasks": "id string, audit_run_id string, parent_task_id string, type string, scope string, required_capabilities array<string>, status string, worker_name string, attempt int, max_attempts int, timeout_seconds int, input_artifact_ids array<string>, output_artifact_ids array<string>, error_code string, error_detail string, lease_expires_at timestamp, created_at timestamp, started_at timestamp, finished_at timestamp",
    "artifacts": "id string, audit_run_id string, kind string, storage_key string, sha256 string, size_bytes long, media_type string, access_level string, produced_by_task_id string, expires_at timestamp, created_at timestamp",
    "audit_coverage": "audit_run_id string, modules_total int, modules_analyzed int, java_files_total int, java_files_analyzed int, entrypoints_total int, entrypoints_analyzed int, sensitive_sinks_total int, sensitive_sinks_analyzed int, build_status string, static_tools_completed string, skipped_paths array<string>, unsupported_components string, coverage_warnings string, updated_at timestamp",
    "reports": "id string, audit_run_id string, version int, summary_json string, html_artifact_id string, json_artifact_id string, sarif_artifact_id string, generated_at timestamp",
    "findings": "id string, audit_run_id string, fingerprint string, title string, description string, category string, cwe_id string, owasp_category string, severity string, confidence string, status string, attack_preconditions string, impact string, remediation string, runtime_verification string, discovered_by string, first_seen_at timestamp, updated_at timestamp",
    "finding_locations": "id string, finding_id string, role string, file_path string, start_line int, end_line int, symbol string, code_snippet string, snapshot_sha string, ordinal int",
    "evidence": "id string, finding_id string, type string, artifact_id string, summary string, sha256 string, produced_by_task_id string, created_at timestamp",
    "verifications": "id string, finding_id string, method string, verdict string, verifier string, evidence_ids array<string>, reasoning string, created_at timestamp",
    "human_reviews": "id string, finding_id string, verdict string, original_severity string, final_severity string, reviewer_id string, comment string, reviewed_at timestamp",
    "audit_facts": "id string, audit_run_id string, kind string, structured_payload string, evidence_ids array<string>, created_by_task_id string, created_at timestamp",
    "audit_intents": "id string, audit_run_id string, category string, scope string, required_capabilities array<string>, status string, created_by_task_id string, claimed_by_task_id string, concluded_at timestamp, created_at timestamp",
    "audit_intent_sources": "audit_intent_id string, audit_fact_id string",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder; audit tables are read with their declared schema."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def audit_frame(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows of an audit table; columns that a row lacks are null."""
    schema = spark.createDataFrame([], SCHEMAS[name]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def ready(spark: SparkSession) -> DataFrame:
    """The readiness probe."""
    return spark.sql("SELECT 1 AS ok")


def json_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Event lines that hold a JSON object, as a variant ``event``; bad lines and other JSON values are skipped."""
    parsed = lines.withColumn("event", F.try_parse_json(F.trim(value)))
    return parsed.filter(F.col("event").isNotNull() & F.schema_of_variant("event").startswith("OBJECT"))


def json_documents(df: DataFrame, *columns: str) -> DataFrame:
    """The rows as JSON documents, one column ``json``."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))


def page_envelope(page: DataFrame, total: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row ``items, meta`` of a page (bounded by its limit) and the count of the whole."""
    order = [c for c in page.columns]
    items = page.agg(F.coalesce(F.collect_list(F.struct(*order)), F.array()).alias("items"))
    meta = total.select(F.struct(F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), F.col("total")).alias("meta"))
    return items.join(meta)


def write_text(df: DataFrame, column: str, target: str) -> None:
    """A text sink; the target must be an absolute path with at least one part and no ``..``."""
    parts = [p for p in target.partition("://")[2].split("/") if p] if "://" in target else [p for p in target.split("/") if p]
    if not parts or ".." in parts or not ("://" in target or target.startswith("/")):
        raise ValueError(f"not an absolute path without ..: {target}")
    df.select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(target)


def append_checked(new: DataFrame, old: DataFrame, key: list[str], error: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that may be inserted, and those that may not with ``error_code``.

    A row conflicts if its key is in ``old`` or an earlier row of ``new`` (by all columns) has
    it. A key with a null conflicts with none, as in SQL.
    """
    first = F.row_number().over(_by(key, new.columns))
    known = old.select(*key).distinct().withColumn("_known", F.lit(True))
    marked = new.withColumn("_n", first).join(known, key, "left")
    whole = reduce(and_, (F.col(c).isNotNull() for c in key))
    code = F.when(whole & (F.coalesce("_known", F.lit(False)) | (F.col("_n") > 1)), F.lit("conflict"))
    marked = marked.withColumn("error_code", F.coalesce(error, code) if error is not None else code).drop("_known", "_n").select(*new.columns, "error_code")
    return marked.filter("error_code is null").drop("error_code"), marked.filter("error_code is not null")


def _by(key: list[str], columns: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*key).orderBy(*columns)
