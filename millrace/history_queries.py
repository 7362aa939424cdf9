"""Registered queries over histories, ranges and trees, on stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import asof, digests
from millrace.plans import graph, reporting, schedule
from millrace.queries import query
from millrace.sources.tables import load


@query("""with t as (select event_id, user_id, ts from events where event_type = 'purchase'), c as (
      select t.*, (select count(*) from events h where h.user_id = t.user_id and h.ts <= t.ts and event_type = 'view') as fact_count,
        (select count(*) from events h where h.user_id = t.user_id and h.ts <= t.ts and event_type = 'click') as hint_count,
        (select count(*) filter (where event_type = 'signup') - count(*) filter (where event_type = 'error') from events h where h.user_id = t.user_id and h.ts <= t.ts) as open_intent_count,
        ts + to_seconds(event_id % 7 * 36000) as completed_at from t where event_id % 3 != 0)
    select user_id as project, fact_count, hint_count, open_intent_count::bigint as open_intent_count from c qualify row_number() over (partition by user_id order by completed_at desc, event_id desc) = 1""")
def dispatch_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoints hold the counts as they stood at dispatch of the last task that succeeded; stand-in: purchases are tasks, up to 60 hours long."""
    events = load(spark, sf, "events")
    kind = F.col("event_type")
    counts = {"fact_count": F.when(kind == "view", 1), "hint_count": F.when(kind == "click", 1), "open_intent_count": F.when(kind == "signup", 1).when(kind == "error", -1)}
    outcome = F.when(F.col("event_id") % 3 == 0, "rejected").otherwise("success")
    tasks = events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("project"), F.col("event_id").alias("id"), "ts", F.lit("reason").alias("task_type"), outcome.alias("outcome"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7 * 10).cast("int"))).alias("completed_at")
    )
    return graph.checkpoints(asof.counted_at(tasks, events.withColumnRenamed("user_id", "project"), "project", "ts", counts))


@query("""with e as (select user_id, ts, event_id, event_type, lag(event_type, 1, 'error') over (partition by user_id order by ts, event_id) as was from events where event_type in ('purchase', 'error')),
    a as (select *, event_type != was as fine from e), f as (
      select *, max(case when fine and event_type = 'purchase' then event_id end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as undone from a),
    l as (select user_id, arg_max(event_type, (ts, event_id)) as last, arg_max(event_id, (ts, event_id)) as id from a where fine group by 1)
    select user_id as project, event_id as id, 'f' || event_id as "to", 'external_feedback' as description, undone as source from f where fine and event_type = 'error'
    union all select user_id, id, 'goal', 'done ' || id, id from l where last = 'purchase'""")
def goal_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """What completing and reopening leaves of edges to the goal; stand-in: purchases complete a user's project, errors reopen it."""
    kind = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "reopen")
    requests = load(spark, sf, "events").select(F.col("user_id").alias("project"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), F.array("event_id").alias("from"), F.concat(F.lit("done "), F.col("event_id")).alias("description"), F.lit("w").alias("worker"))
    return graph.goal_edges(requests).select("project", "id", "to", "description", F.col("from")[0].alias("source"))


_ISSUES = "l_suppkey % 10 as run, case when l_suppkey % 3 = 0 then 0 else l_suppkey end as file, l_linenumber as kind, l_partkey as first_line, l_partkey + case when l_orderkey % 50 = 0 then 5000 else l_quantity::bigint end as last_line"


@query(f"""with t as (select row_number() over () as id, {_ISSUES}, l_orderkey % 2 = 0 as grave from lineitem where l_returnflag = 'R' and l_discount > 0.05),
    f as (select l_orderkey * 100 + l_linenumber as id, {_ISSUES}, row_number() over () as i from lineitem where l_returnflag = 'A' and l_discount > 0.05),
    p as (select f.i, min(t.id) as t from f join t on t.run = f.run and t.file = f.file and t.kind = f.kind and t.first_line <= f.last_line and f.first_line <= t.last_line group by 1),
    m as (select distinct t.id from f join t on t.run = f.run and t.file = f.file and t.kind = f.kind and t.first_line <= f.last_line and f.first_line <= t.last_line),
    r as (select count(*) as runs, sum(s_nationkey * 1000 + 1) as lines, sum(s_acctbal) as seconds, sum(s_suppkey) as tokens, sum(s_nationkey) as cost from supplier)
    select (select count(*) from t where grave and id in (from m)) / (select count(*) from t where grave) as recall, (select count(*) from p) / (select count(*) from f) as precision,
      (select count(*) from f where i not in (select i from p) and exists (select 1 from t where t.run = f.run and t.kind = f.kind)) / (select count(*) from f) as wrong_location,
      (select seconds * 10000 / lines from r) as seconds_per_10k, (select tokens / runs from r) as tokens_per_run, (select cost / runs from r) as cost_per_run""")
def located_findings(spark: SparkSession, sf: str) -> DataFrame:
    """A16 (specified): recall, precision, wrong locations, time, tokens and cost; stand-in: lines as issues of suppliers' files, one of which a third of them share."""
    lines = load(spark, sf, "lineitem").filter("l_discount > 0.05")
    last = F.col("l_partkey") + F.when(F.col("l_orderkey") % 50 == 0, 5000).otherwise(F.col("l_quantity").cast("long"))
    severity = F.when(F.col("l_orderkey") % 2 == 0, F.when(F.col("l_orderkey") % 4 == 0, "high").otherwise("critical")).otherwise("low")
    issues = lines.select(
        "l_returnflag", F.struct("l_orderkey", "l_linenumber", *(c for c in lines.columns if c not in ("l_orderkey", "l_linenumber"))).alias("id"), (F.col("l_suppkey") % 10).alias("run"), F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey")).alias("file"),
        F.col("l_linenumber").alias("kind"), severity.alias("severity"), F.col("l_partkey").alias("first_line"), last.alias("last_line"),
    )
    runs = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("run"), (F.col("s_nationkey") * 1000 + 1).alias("lines"), F.col("s_acctbal").alias("seconds"), F.col("s_suppkey").alias("tokens"), F.col("s_nationkey").alias("cost"))
    out = reporting.located_quality(issues.filter("l_returnflag = 'R'"), issues.filter("l_returnflag = 'A'"), runs)
    return out.select("recall", "precision", "wrong_location", "seconds_per_10k", "tokens_per_run", "cost_per_run")


@query("""with f as (select source, doc_id, row_number() over (partition by source order by lpad(doc_id::varchar, 12, '0')) - 1 as i,
      source || '/' || lpad(doc_id::varchar, 12, '0') || chr(31) || 'file' || chr(31) || (case when doc_id % 7 = 0 then 'true' else 'false' end) || chr(31) || sha256(coalesce(text, '')) as line from documents),
    a as (select source, i // 64 as j, sha256(string_agg(line, chr(10) order by i)) as line from f group by 1, 2),
    b as (select source, j // 64 as k, sha256(string_agg(line, chr(10) order by j)) as line from a group by 1, 2)
    select source, (select count(*) from f where f.source is not distinct from b.source) as files, sha256(string_agg(line, chr(10) order by k)) as digest from b group by 1""")
def source_trees(spark: SparkSession, sf: str) -> DataFrame:
    """X33 (specified): one hash of each source's files in the order of their paths, in leaves of 64; stand-in: documents as files."""
    path = F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    line = digests.entry(path, F.lit("file"), F.col("doc_id") % 7 == 0, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    docs = load(spark, sf, "documents").select("source", path.alias("path"), line.alias("line"))
    return digests.tree_digest(docs, "source", "path", F.col("line"), leaf=64)


@query("""select c_custkey as run, count(o_orderkey) filter (where o_orderkey % 7 = 0) as uninventoried, count(o_orderkey) filter (where o_orderkey % 11 = 0 and o_orderstatus != 'F') as unassigned,
    count(o_orderkey) filter (where o_orderkey % 13 = 0 and o_orderstatus != 'O') as tools_open, count(o_orderkey) filter (where o_orderstatus = 'P' and o_orderkey % 2 = 0) as tasks_open,
    count(o_orderkey) filter (where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'P') as unverified, count(o_orderkey) filter (where o_orderkey % 17 = 0) as reviews_open,
    count(o_orderkey) filter (where o_orderkey % 19 = 0) as unrecorded, uninventoried + unassigned + tools_open + tasks_open + unverified + reviews_open + unrecorded = 0 as may_report
    from customer left join orders on o_custkey = c_custkey group by 1""")
def report_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """L11 (specified): all seven conditions before a report; stand-in: orders of customers in each role."""
    o = load(spark, sf, "orders").withColumnRenamed("o_custkey", "run")
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return reporting.completion(
        load(spark, sf, "customer").select(F.col("c_custkey").alias("run")),
        o.select("run", (key % 7 != 0).alias("inventoried")),
        o.select("run", F.when(key % 11 != 0, "task").alias("task"), F.when(status == "F", "out of reach").alias("excluded_reason")),
        o.select("run", (key % 13 == 0).alias("required"), F.when(status == "O", "failed").when(status == "F", "failed").otherwise("running").alias("status"), F.when(status == "O", "no license").alias("failure_reason")),
        o.select("run", F.when((status == "P") & (key % 2 == 0), "running").otherwise("succeeded").alias("status")),
        o.select("run", F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high").otherwise("low").alias("severity"), (status == "F").alias("verified"), F.when(status == "O", True).alias("unverifiable")),
        o.select("run", F.when(key % 17 == 0, "pending").otherwise("done").alias("status")),
        o.select("run", F.when(key % 19 != 0, True).alias("recorded")),
    )


@query("""select l_orderkey, l_linenumber, l_suppkey, case when o_custkey % 100 = l_suppkey then 'self' when l_linestatus = 'O' and l_quantity > 40 or l_discount = 0 then 'inconclusive' when l_returnflag = 'A' then 'confirmed' else 'rejected' end as verdict
    from lineitem join orders on o_orderkey = l_orderkey""")
def verification_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """L13 (specified): timeouts and lost environments are inconclusive, one's own findings can't be verified; stand-in: lines verify orders."""
    checks = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("finding_id"), "l_linenumber", F.col("l_suppkey").alias("verifier"), F.when(F.col("l_returnflag") == "A", "confirmed").otherwise("rejected").alias("outcome"),
        ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)).alias("timed_out"), (F.col("l_discount") != 0).alias("environment_ok"),
    )
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("discovered_by"))
    known = checks.join(orders.select(F.col("id").alias("finding_id")), "finding_id", "left_semi")
    return reporting.verdicts(known, orders).select(F.col("finding_id").alias("l_orderkey"), "l_linenumber", F.col("verifier").alias("l_suppkey"), "verdict")


@query("""with o as (select user_id as w, arg_max(event_type, ts) as last, max(ts) as at from events where event_type != 'signup' group by 1), now as (select max(ts) as t from events),
    r as (select l_suppkey as w, count(*) as running from lineitem where l_quantity < 3 group by 1), c as (
      select s_suppkey, s_name, s_nationkey % 3 as priority, coalesce(running, 0) as running from supplier cross join now left join o on o.w = s_suppkey left join r on r.w = s_suppkey
      where s_nationkey < 20 and coalesce(running, 0) < 20 + s_nationkey and not (coalesce(last, '') = 'error' and o.at + interval 5 second > t))
    select s_suppkey, row_number() over (order by priority, running, s_name) as rank from c""")
def worker_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The workers that may take a task, ranked by priority, load and name; stand-in: suppliers, their small lines as tasks, events of users as outcomes."""
    kinds = F.when(F.col("s_nationkey") < 20, F.array(F.lit("explore"))).otherwise(F.array(F.lit("reason")))
    workers = load(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").alias("name"), F.col("s_name").alias("shown"), kinds.alias("task_types"), (20 + F.col("s_nationkey")).alias("max_running"), (F.col("s_nationkey") % 3).alias("priority"))
    tasks = load(spark, sf, "lineitem").filter("l_quantity < 3").select(F.col("l_suppkey").alias("worker"))
    events = load(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "unhealthy").when(F.col("event_type") == "signup", "crashed").otherwise("success")
    outcomes = events.select(F.lit("p").alias("project"), F.lit("explore").alias("task_type"), F.col("user_id").alias("worker"), kind.alias("outcome"), F.col("ts").alias("at"))
    end = events.agg(F.max("ts").alias("_end"))
    known = schedule.classified(workers.join(F.broadcast(end)), tasks, outcomes, "p", "explore", F.col("_end"))
    return schedule.chosen(known.filter("class = 'candidate'").select("s_suppkey", "priority", "running", F.col("shown").alias("name"))).select("s_suppkey", "rank")
