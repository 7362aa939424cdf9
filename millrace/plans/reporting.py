"""Reports that are specified but that nothing computes yet: counts, ratios, gates, timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.intervals import overlapping


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """Rows of each kind."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def ratio(part: Column, whole: Column) -> Column:
    """The share; null where there is no whole."""
    return F.try_divide(part, whole)


def coverage(df: DataFrame, *kinds: str) -> DataFrame:
    """Coverage rows with the share analysed of each kind (columns <kind>_total, <kind>_analyzed)."""
    return df.withColumns({f"{k}_ratio": ratio(F.col(f"{k}_analyzed"), F.col(f"{k}_total")) for k in kinds})


def quality(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Recall, precision and the share of duplicates of what was found against what there is."""
    once = found.select(*key).distinct()
    hits = once.join(truth.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("hits"))
    sizes = truth.select(*key).distinct().agg(F.count("*").alias("known")).join(once.agg(F.count("*").alias("distinct_found"))).join(found.agg(F.count("*").alias("found")))
    return hits.join(sizes).select(
        ratio(F.col("hits"), F.col("known")).alias("recall"),
        ratio(F.col("hits"), F.col("distinct_found")).alias("precision"),
        ratio(F.col("found") - F.col("distinct_found"), F.col("found")).alias("duplicate_ratio"),
    )


def observed(tasks: DataFrame) -> DataFrame:
    """Per run and task type: waiting and running seconds, outcomes, retries."""

    def secs(a: str, b: str) -> Column:
        return F.unix_timestamp(b) - F.unix_timestamp(a)

    return tasks.groupBy("audit_run_id", "type").agg(
        F.sum(secs("created_at", "started_at")).alias("wait_s"),
        F.sum(secs("started_at", "finished_at")).alias("run_s"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.greatest(F.col("attempt") - 1, F.lit(0))).alias("retries"),
    )


def gate(runs: DataFrame, key: str, **blockers: DataFrame) -> DataFrame:
    """Runs with a boolean for each blocker (rows with the run's key stand in its way) and ``may_report``."""
    out = runs.select(key)
    for name, rows in blockers.items():
        known = rows.select(F.col(key).alias("_k")).distinct().withColumn(name, F.lit(True))
        out = out.join(known, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(False)))
    free = reduce(lambda a, b: a & b, (~F.col(n) for n in blockers), F.lit(True))
    return out.withColumn("may_report", free)


#: Task statuses that a run may not be reported in.
UNSETTLED = ["pending", "claimed", "running", "lost"]


def completion(runs: DataFrame, files: DataFrame, entries: DataFrame, tools: DataFrame, tasks: DataFrame, candidates: DataFrame, reviews: DataFrame, gaps: DataFrame) -> DataFrame:
    """``run``, how many rows break each of the seven conditions before a report, and ``may_report``: none does.

    Tables, each with ``run``: files in scope (``inventoried``), entry points and sinks (``task``, ``excluded_reason``), tools (``required, status,
    failure_reason``), tasks (``status``), candidates (``severity, verified, unverifiable``), reviews (``status``), skipped paths and
    other gaps (``recorded``). A null flag counts as false. All are one aggregate: a run with very many rows costs a row a task.
    """

    def no(name: str) -> Column:
        return ~F.coalesce(F.col(name), F.lit(False))

    bad = {
        "uninventoried": files.filter(no("inventoried")),
        "unassigned": entries.filter("task is null and excluded_reason is null"),
        "tools_open": tools.filter(~no("required") & ~F.coalesce((F.col("status") == "succeeded") | ((F.col("status") == "failed") & F.col("failure_reason").isNotNull()), F.lit(False))),
        "tasks_open": tasks.filter(F.col("status").isNull() | F.col("status").isin(UNSETTLED)),
        "unverified": candidates.filter(F.col("severity").isin("critical", "high") & no("verified") & no("unverifiable")),
        "reviews_open": reviews.filter("status is null or status = 'pending'"),
        "unrecorded": gaps.filter(no("recorded")),
    }
    rows = reduce(DataFrame.unionByName, (df.select("run", F.lit(name).alias("why")) for name, df in bad.items()))
    counts = rows.groupBy(F.col("run").alias("_run")).agg(*(F.count_if(F.col("why") == name).alias(name) for name in bad))
    out = runs.select("run").join(counts, F.col("run") == F.col("_run"), "left").drop("_run").fillna(0, list(bad))
    return out.withColumn("may_report", reduce(lambda a, b: a & b, (F.col(name) == 0 for name in bad)))


def needs_review(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """High and critical findings that no human has reviewed."""
    seen = reviews.select(F.col("finding_id").alias("_f"))
    return findings.filter(F.col("severity").isin("critical", "high")).join(seen, F.col("id") == F.col("_f"), "left_anti")


def self_verified(verifications: DataFrame, findings: DataFrame) -> DataFrame:
    """Verifications by whoever discovered the finding."""
    by = findings.select(F.col("id").alias("_f"), "discovered_by")
    return verifications.join(by, (F.col("finding_id") == F.col("_f")) & (F.col("verifier") == F.col("discovered_by"))).drop("_f")


def verdicts(verifications: DataFrame, findings: DataFrame) -> DataFrame:
    """Verifications with their ``verdict``: inconclusive after a timeout or where the environment failed, self where the verifier discovered the finding, else the outcome.

    Columns: ``finding_id, verifier, outcome, timed_out, environment_ok``. A finding that isn't known is verified by somebody else.
    """
    by = findings.select(F.col("id").alias("_f"), F.col("discovered_by").alias("_by"))
    told = verifications.join(by, F.col("finding_id") == F.col("_f"), "left")
    lost = F.coalesce(F.col("timed_out"), F.lit(False)) | ~F.coalesce(F.col("environment_ok"), F.lit(False))
    verdict = F.when(F.coalesce(F.col("verifier") == F.col("_by"), F.lit(False)), "self").when(lost | F.col("outcome").isNull(), "inconclusive").otherwise(F.col("outcome"))
    return told.withColumn("verdict", verdict).drop("_f", "_by")


def located_quality(truth: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of what is to be recorded of audits against known issues.

    ``truth`` and ``found``: ``id, run, file, kind, severity, first_line, last_line``; ``runs``: ``run, lines, seconds, tokens, cost``.
    A finding hits a known issue of its run, file and kind whose lines overlap its own. ``recall``: known critical and high
    issues that are hit; ``precision``: findings that hit; ``wrong_location``: findings that hit none though their run
    has an issue of their kind; ``duplicate_ratio``: findings that hit an issue which another finding, of a smaller id, hits first
    (a finding counts for the smallest issue it hits); ``seconds_per_10k``: by lines of code; ``tokens_per_run, cost_per_run``.
    Shares of nothing are null.
    """
    known = truth.select("run", "file", "kind", F.col("id").alias("t_id"), "severity", F.col("first_line").alias("t_first"), F.col("last_line").alias("t_last"))
    mine = found.select("run", "file", "kind", F.col("id").alias("f_id"), "first_line", "last_line")
    pairs = overlapping(mine, known, ["run", "file", "kind"], ("first_line", "last_line"), ("t_first", "t_last")).select("f_id", "t_id")
    hit = pairs.groupBy("f_id").agg(F.min("t_id").alias("t_id"))
    firsts = hit.groupBy("t_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count("*").alias("first_hits"))
    grave = known.filter(F.col("severity").isin("critical", "high")).select(F.col("t_id").alias("g"))
    met = pairs.select("t_id").distinct()
    recalled = grave.join(met.withColumn("met", F.lit(1)), F.col("g") == F.col("t_id"), "left").agg(F.count("*").alias("grave"), F.count("met").alias("recalled"))
    kinds = known.select("run", "kind").distinct()
    missed = mine.join(hit, "f_id", "left_anti").join(kinds, ["run", "kind"], "left_semi").agg(F.count("*").alias("wrong"))
    size = found.agg(F.count("*").alias("found"))
    spent = runs.agg(F.count("*").alias("runs"), F.sum("lines").alias("lines"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    one = reduce(DataFrame.join, (firsts, recalled, missed, size, spent))  # of one row each
    return one.select(
        ratio(F.col("recalled"), F.col("grave")).alias("recall"), ratio(F.col("hits"), F.col("found")).alias("precision"), ratio(F.col("wrong"), F.col("found")).alias("wrong_location"),
        ratio(F.col("hits") - F.col("first_hits"), F.col("found")).alias("duplicate_ratio"), ratio(F.col("seconds") * 10_000.0, F.col("lines")).alias("seconds_per_10k"),
        ratio(F.col("tokens").cast("double"), F.col("runs")).alias("tokens_per_run"), ratio(F.col("cost").cast("double"), F.col("runs")).alias("cost_per_run"),
    )


def expired(artifacts: DataFrame, now: Column, protected: DataFrame) -> DataFrame:
    """Artifacts past their time that nothing protects."""
    return artifacts.filter(F.col("expires_at") < now).join(protected.select(F.col("id").alias("_keep")), F.col("id") == F.col("_keep"), "left_anti")


def timeline(*events: DataFrame) -> DataFrame:
    """Events (at, kind, id) of several kinds in one order."""
    return reduce(DataFrame.unionByName, events).orderBy("at", "kind", "id")
