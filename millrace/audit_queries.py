"""More registered queries: checks, decisions and contracts, by their operators on stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import payloads, text
from millrace.operators import constraints, lifecycle, relations
from millrace.plans import graph, reporting, schedule
from millrace.queries import query
from millrace.sources import tables
from millrace.sources.tables import load
from millrace.streaming import leases


def noisy(spark: SparkSession, sf: str, *samples: str) -> DataFrame:
    """Events with ``said``: the samples in turn by id, ``<k>`` in them replaced by the event's property."""
    turn = F.pmod("event_id", F.lit(len(samples))).cast("int")
    said = F.replace(F.element_at(F.array(*map(F.lit, samples)), turn + 1), F.lit("<k>"), F.get_json_object("props", "$.k"))
    return load(spark, sf, "events").select("event_id", said.alias("said"))


def _judged(df: DataFrame, contract: str, open_empty: Column | None = None) -> DataFrame:
    return df.select("event_id", payloads.checked(F.col("said"), contract, open_empty).alias("r")).select("event_id", "r.kind", "r.data", "r.error")


def _expected(*outcomes: tuple[str, str, str]) -> str:
    """SQL for (kind, data, error) of each turn; data is an SQL expression over k."""
    parts = [" ".join(f"when {i} then {v}" for i, v in enumerate(column)) for column in zip(*outcomes, strict=True)]
    kinds, data, errors = (f"case event_id % {len(outcomes)} {p} end" for p in parts)
    return f"select event_id, {kinds} as kind, {data} as data, {errors} as error from (select event_id, props->>'$.k' as k from events)"


@query(_expected(
    ("'rejected'", "null", "null"), ("'fact'", "'\"k is ' || k || '\"'", "null"), ("'fact'", "'\"' || k || '\"'", "null"), ("'error'", "null", "'description:text'"),
    ("'error'", "null", "'object:missing'"), ("'error'", "null", "'data:object'"), ("'error'", "null", "'accepted:missing'"),
))
def extracted_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Objects in noisy text by the contract of exploration, with every outcome; stand-in: events say what stands here, in turn."""
    return _judged(noisy(
        spark, sf, 'No. {"accepted": false}', 'Result:\n```JSON\n{"accepted": true, "data": {"description": " k is <k> ", "more": 1}}\n```\ndone', '[{"description": "<k>"}] {"x": 1}',
        '{bad {"accepted": true, "data": {"description": <k>}}', "only prose <k> {", '{"accepted": true, "data": [<k>]}', '{"description": "x", "other": <k>}',
    ), "exploration")


_EDGE = """'{"from": ["f' || k || '"], "description": "d"}'"""


@query(_expected(
    ("'rejected'", "null", "null"), ("'complete'", _EDGE, "null"), ("'intents'", f"'[' || {_EDGE} || ']'", "null"), ("'intents'", f"'[' || {_EDGE} || ', ' || {_EDGE} || ', ' || {_EDGE} || ']'", "null"),
    ("case when event_id % 3 = 0 then 'error' else 'noop' end", "null", "case when event_id % 3 = 0 then 'intents:missing' end"), ("'error'", "null", "'complete:alone'"), ("'error'", "null", "'intents.1:edge'"), ("'error'", "null", "'intents:list'"),
))
def reasoned_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The contract of reasoning, with every outcome; no intent is open where the id divides by three."""
    edge = '{"from": ["f<k>"], "description": "d"}'
    return _judged(noisy(
        spark, sf, '{"accepted": false, "data": {}}', f'so: {{"complete": {edge}}}', f'{{"accepted": true, "data": {{"intent": {edge}}}}}', f'{{"intents": [{edge}, {edge}, {edge}, {edge}]}}',
        '{"accepted": true, "data": {}}', f'{{"accepted": true, "data": {{"complete": {edge}, "intents": []}}}}', f'{{"intents": [{edge}, {{"from": []}}]}}', '{"accepted": true, "data": {"intents": "<k>"}}',
    ), "reason", F.pmod("event_id", F.lit(3)) == 0)


@query(_expected(
    ("'complete'", """'{"fact_description": "' || k || '", "complete_description": "c"}'""", "null"), ("'rejected'", "null", "null"), ("'error'", "null", "'fact.description:text'"),
    ("'error'", "null", "'complete:object'"), ("'error'", "null", "'accepted:missing'"),
))
def bootstrap_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The contract of starting a project."""
    fact = '"fact": {"description": "<k> "}'
    return _judged(noisy(
        spark, sf, f'{{{fact}, "complete": {{"description": "c"}}}}', '{"accepted": false}', '{"accepted": true, "data": {"fact": {"description": " "}}}', f'{{"accepted": true, "data": {{{fact}, "complete": "<k>"}}}}', f"{{{fact}}}",
    ), "bootstrap")


@query(_expected(
    ("'fact'", "'\"' || k || '\"'", "null"), ("'fact'", "'\"' || k || '\"'", "null"), ("'error'", "null", "'extra:unexpected'"), ("'error'", "null", "'fact.description:text'"),
))
def concluded_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The contract of concluding a start; a complete beside the fact is let pass."""
    fact = '"fact": {"description": "<k>"}'
    return _judged(noisy(spark, sf, f"{{{fact}}}", f'{{{fact}, "complete": 1}}', f'{{"accepted": true, "data": {{{fact}, "extra": 1}}}}', '{"fact": {"text": "<k>"}}'), "bootstrap_conclusion")


@query("""with n as (select l_orderkey, l_linenumber, count(*) as rows from lineitem where l_quantity > 25 group by 1, 2),
    o as (select distinct l_orderkey, l_linenumber from lineitem where l_quantity <= 25),
    m as (select n.*, o.l_orderkey is not null as known from n left join o using (l_orderkey, l_linenumber))
    select 'accepted' as outcome, count(*) filter (where not known) as n from m union all
    select 'conflict', (sum(rows) - count(*) filter (where not known))::bigint from m""")
def checked_inserts(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts against a unique key; stand-in: larger lines go in after the smaller ones."""
    lines = load(spark, sf, "lineitem")
    good, bad = tables.append_checked(lines.filter("l_quantity > 25"), lines.filter("l_quantity <= 25"), ["l_orderkey", "l_linenumber"])
    count = F.count("*").alias("n")
    return good.agg(count).select(F.lit("accepted").alias("outcome"), "n").union(bad.groupBy(F.col("error_code").alias("outcome")).agg(count))


_RUN_TABLES = """repo as (select c_custkey as id, case c_nationkey % 3 when 0 then 'zip' else 'git' end as source_type from customer where c_acctbal > 0),
    pol as (select n_nationkey as id, n_nationkey % 4 != 0 as active, n_regionkey as version from nation),
    snap as (select s_suppkey as id, s_suppkey % 7 as repo7, case when s_nationkey % 2 = 0 then 'ready' else 'creating' end as status from supplier),
    req as (select o_orderkey as id, o_custkey as repository_id, o_orderkey % 30 as policy_id, case o_orderkey % 3 when 0 then 'existing_snapshot' when 1 then 'git_ref' else 'upload' end as source, o_orderkey % 120 as snapshot_id, o_custkey % 7 as r7 from orders)"""


def run_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Repositories, policies, snapshots and requests from customers, nations, suppliers and orders."""
    source = F.element_at(F.array(*map(F.lit, ("existing_snapshot", "git_ref", "upload"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return {
        "repositories": load(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 3 == 0, "zip").otherwise("git").alias("source_type")),
        "policies": load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 4 != 0).alias("active"), F.col("n_regionkey").alias("version")),
        "snapshots": load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).alias("repository_id"), F.when(F.col("s_nationkey") % 2 == 0, "ready").otherwise("creating").alias("status")),
        "requests": load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repository_id"), (F.col("o_orderkey") % 30).alias("policy_id"), source.alias("source"), (F.col("o_orderkey") % 120).alias("snapshot_id")),
    }


@query(f"""with {_RUN_TABLES}
    select req.id, version::integer as policy_version, case when repo.id is null then 'repository_not_found' when pol.id is null then 'audit_policy_not_found' when not active then 'audit_policy_inactive'
      when source = 'existing_snapshot' then case when snap.id is null then 'source_snapshot_not_found' when repo7 != repository_id then 'snapshot_repository_mismatch' when status != 'ready' then 'snapshot_not_ready' end
      when source = 'git_ref' and source_type != 'git' or source = 'upload' and source_type = 'git' then 'source_type_mismatch' end as error_code
    from req left join repo on repo.id = repository_id left join pol on pol.id = policy_id left join snap on snap.id = snapshot_id""")
def create_run_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The first check that a request for a run fails."""
    t = run_tables(spark, sf)
    return lifecycle.create_errors(t["requests"], t["repositories"], t["policies"], t["snapshots"]).select("id", F.col("policy_version").cast("int").alias("policy_version"), "error_code")


@query(f"""with {_RUN_TABLES}, run as (select id, r7 as repository_id, case when id % 4 = 0 then snapshot_id end as snapshot_id, case when id % 5 < 3 then 'preprocessing' else 'reporting' end as target, case when id % 3 = 0 then id % 110 end as offered from req),
    w as (select *, case when target = 'preprocessing' then coalesce(snapshot_id, offered) else snapshot_id end as effective from run)
    select w.id, effective as effective_snapshot_id, case when offered is not null and target != 'preprocessing' then 'snapshot_attachment_not_allowed' when target != 'preprocessing' then null
      when snapshot_id != offered then 'snapshot_immutable' when effective is null then 'snapshot_required' when snap.id is null then 'source_snapshot_not_found'
      when repo7 != repository_id then 'snapshot_repository_mismatch' when status != 'ready' then 'snapshot_not_ready' end as error_code from w left join snap on snap.id = effective""")
def attach_snapshot_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a move may attach a snapshot."""
    t = run_tables(spark, sf)
    runs = t["requests"].select(
        "id", (F.col("repository_id") % 7).alias("repository_id"), F.when(F.col("id") % 4 == 0, F.col("snapshot_id")).alias("snapshot_id"),
        F.when(F.col("id") % 5 < 3, "preprocessing").otherwise("reporting").alias("target"), F.when(F.col("id") % 3 == 0, F.col("id") % 110).alias("offered_snapshot_id"),
    )
    return lifecycle.attach_errors(runs, t["snapshots"]).select("id", "effective_snapshot_id", "error_code")


def work_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Intents from orders (open unless finished, claimed where in progress) and tasks from lines of small quantity."""
    orders = load(spark, sf, "orders")
    intents = orders.select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.array(F.lit("origin")).alias("from"), F.when(F.col("o_orderstatus") == "F", "x").alias("to"), F.col("o_orderpriority").alias("description"),
        F.lit("c").alias("creator"), F.when(F.col("o_orderstatus") == "P", "w").alias("worker"), F.col("o_orderdate").alias("created_at"),
    )
    lines = load(spark, sf, "lineitem").filter("l_quantity < 4")
    tasks = lines.select(F.lit("explore").alias("task_type"), F.col("l_orderkey").alias("intent"), F.lit("w").alias("worker"))
    held = orders.select(F.col("o_orderkey").alias("_o"), F.col("o_custkey").alias("project"))
    return intents, tasks.join(held, F.col("intent") == F.col("_o")).drop("_o")


@query("""select o_custkey as project, o_orderkey as id from orders where o_orderstatus = 'O' and o_orderpriority != '1-URGENT'
    and o_orderkey not in (select l_orderkey from lineitem where l_quantity < 4)""")
def unclaimed_intents(spark: SparkSession, sf: str) -> DataFrame:
    """Open intents that nobody works on; stand-in: urgent orders are those that start a project."""
    intents, tasks = work_tables(spark, sf)
    return graph.unclaimed(intents, tasks, graph.is_bootstrap("1-URGENT", "c")).select("project", "id")


@query("select o_custkey as project, o_orderkey as id, o_orderpriority as description, case when o_orderstatus = 'P' then 'w' end as worker from orders where o_orderstatus != 'F'")
def open_intents(spark: SparkSession, sf: str) -> DataFrame:
    """What a reasoning task is told."""
    return graph.open_intents(work_tables(spark, sf)[0]).select("project", "id", "description", "worker")


@query("select c_custkey as project, case c_custkey % 3 when 0 then 'goal' else 'f' || c_nationkey end as id from customer where c_custkey % 3 != 0")
def allowed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that an intent may begin from."""
    fact = F.when(F.col("c_custkey") % 3 == 0, "goal").otherwise(F.concat(F.lit("f"), F.col("c_nationkey")))
    return graph.allowed_facts(load(spark, sf, "customer").select(F.col("c_custkey").alias("project"), fact.alias("id")))


@query("""with r as (select l_suppkey as w, count(*) as running from lineitem where l_quantity < 3 group by 1), o as (select user_id as w, arg_max(event_type, ts) as last, max(ts) as at from events where event_type != 'signup' group by 1),
    b as (select user_id as w, arg_max(event_type, ts) as last, max(ts) as at from events where event_type != 'signup' and event_id % 2 = 0 group by 1), now as (select max(ts) as t from events)
    select s_suppkey, coalesce(r.running, 0)::bigint as running, case when s_nationkey >= 20 then 'task_type' when coalesce(r.running, 0) >= 20 + s_nationkey then 'busy'
      when o.last = 'error' and o.at + interval 5 second > t then 'unhealthy' when b.last = 'purchase' and b.at + interval 5 second > t then 'rejected' else 'candidate' end as class
    from supplier cross join now left join r on r.w = s_suppkey left join o on o.w = s_suppkey left join b on b.w = s_suppkey""")
def worker_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that holds classes a worker; stand-in: suppliers, their small lines as tasks, events of users as outcomes."""
    kinds = F.when(F.col("s_nationkey") < 20, F.array(F.lit("explore"))).otherwise(F.array(F.lit("reason")))
    workers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("name"), kinds.alias("task_types"), (20 + F.col("s_nationkey")).alias("max_running"))
    tasks = load(spark, sf, "lineitem").filter("l_quantity < 3").select(F.col("l_suppkey").alias("worker"))
    events = load(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "unhealthy").when(F.col("event_type") == "purchase", "rejected").when(F.col("event_type") == "signup", "crashed").otherwise("success")
    outcomes = events.select(F.when(F.col("event_id") % 2 == 0, "p").otherwise("q").alias("project"), F.lit("explore").alias("task_type"), F.col("user_id").alias("worker"), kind.alias("outcome"), F.col("ts").alias("at"))
    end = events.agg(F.max("ts").alias("_end"))
    out = schedule.classified(workers.join(F.broadcast(end)), tasks, outcomes, "p", "explore", F.col("_end"))
    return out.select(F.col("name").alias("s_suppkey"), "running", "class")


@query("""with o as (select user_id as project, case when event_type = 'error' then 'unhealthy' else 'success' end as outcome, ts from events), l as (select project, arg_max(outcome, ts) as last, max(ts) as at from o group by 1)
    select project, l.at + interval 5 second as until from l where last = 'unhealthy'""")
def cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    """Until when a key is blocked by its last outcome."""
    outcomes = load(spark, sf, "events").select(F.col("user_id").alias("project"), F.when(F.col("event_type") == "error", "unhealthy").otherwise("success").alias("outcome"), F.col("ts").alias("at"))
    return schedule.blocked_until(outcomes, ["project"], "unhealthy")


@query("select n_nationkey, case when n_nationkey <= 9 then 'error' when n_nationkey < 18 then 'warning' else 'ok' end as verdict from nation")
def settings_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """ST5: whether a timeout leaves room over an interval of 9."""
    return load(spark, sf, "nation").select("n_nationkey", schedule.settings_verdict(F.col("n_nationkey"), F.lit(9)).alias("verdict"))


@query("""with b as (select user_id, ts, case event_type when 'error' then 409 when 'view' then 200 else 500 end as status from events),
    g as (select *, max(case when status = 200 then ts end) over (partition by user_id order by ts) as good, min(ts) over (partition by user_id) as start from b),
    w as (select *, case when status = 409 then 'status 409' when status = 500 and epoch(date_trunc('second', ts))::bigint - epoch(date_trunc('second', coalesce(good, start)))::bigint >= 7200 then 'no heartbeat' end as why from g)
    select user_id, min(ts) as lost_at, arg_min(why, ts) as why from w where why is not null group by 1""")
def heartbeat_losses(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: when and why a lease is lost; stand-in: events of users as answers to heartbeats, an hour apart."""
    status = F.when(F.col("event_type") == "error", 409).when(F.col("event_type") == "view", 200).otherwise(500)
    return leases.heartbeat_failures(load(spark, sf, "events").withColumn("status", status), 3600, "user_id", "ts")


@query("select o_orderkey from orders where o_orderstatus in ('O', 'P') and o_orderdate < timestamp '1997-01-01'")
def lapsed_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """ST7: tasks whose lease is over; stand-in: unfinished orders of before 1997."""
    status = F.element_at(F.create_map(*map(F.lit, ("O", "claimed", "P", "running", "F", "succeeded"))), F.col("o_orderstatus"))
    tasks = load(spark, sf, "orders").select("o_orderkey", status.alias("status"), F.col("o_orderdate").alias("lease_expires_at"))
    return leases.lapsed_tasks(tasks, F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).select("o_orderkey")


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def needs_review(spark: SparkSession, sf: str) -> DataFrame:
    """L12 (specified): high and critical findings without review; stand-in: orders without lines."""
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("low")
    findings = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), severity.alias("severity"))
    return reporting.needs_review(findings, load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("finding_id"))).select(F.col("id").alias("o_orderkey"))


@query("select l_orderkey, l_linenumber, l_suppkey from lineitem join orders on o_orderkey = l_orderkey and o_custkey % 100 = l_suppkey")
def self_verifications(spark: SparkSession, sf: str) -> DataFrame:
    """L13 (specified): verifications by whoever discovered the finding; stand-in: lines supplied by the number that ordered them."""
    checks = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("finding_id"), "l_linenumber", F.col("l_suppkey").alias("verifier"))
    findings = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("discovered_by"))
    return reporting.self_verified(checks, findings).select(F.col("finding_id").alias("l_orderkey"), "l_linenumber", F.col("verifier").alias("l_suppkey"))


@query("select o_orderkey from orders where o_orderdate < timestamp '1997-01-01' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def expired_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """L14 (specified): artifacts past their time that nothing protects; stand-in: old orders without returned lines."""
    artifacts = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_at"))
    kept = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return reporting.expired(artifacts, F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")), kept).select(F.col("id").alias("o_orderkey"))


@query("""select l_suppkey, l_linestatus, sum(epoch(l_shipdate) - epoch(o_orderdate))::bigint as wait_s, sum(l_linenumber * 60)::bigint as run_s, count(*) filter (where l_returnflag = 'A') as succeeded,
    count(*) filter (where l_returnflag = 'R') as failed, sum(l_linenumber - 1)::bigint as retries from lineitem join orders on o_orderkey = l_orderkey group by 1, 2""")
def observability(spark: SparkSession, sf: str) -> DataFrame:
    """A17 (specified): waiting, running, outcomes and retries; stand-in: lines as tasks of suppliers."""
    lines = load(spark, sf, "lineitem").join(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("l_returnflag") == "A", "succeeded").when(F.col("l_returnflag") == "R", "failed")
    tasks = lines.select(
        F.col("l_suppkey").alias("audit_run_id"), F.col("l_linestatus").alias("type"), status.alias("status"), F.col("l_linenumber").alias("attempt"), F.col("o_orderdate").alias("created_at"),
        F.col("l_shipdate").alias("started_at"), (F.col("l_shipdate") + F.make_interval(mins=F.col("l_linenumber"))).alias("finished_at"),
    )
    return reporting.observed(tasks).withColumnsRenamed({"audit_run_id": "l_suppkey", "type": "l_linestatus"})


@query("select c_custkey, c_nationkey % 2 = 0 as status_same from customer where c_nationkey % 2 = 0 and c_acctbal > 0")
def unchanged_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Markers whose project still has the status; stand-in: customers of even nations are as they were, those without money are gone."""
    customers = load(spark, sf, "customer")
    marks = customers.select(F.col("c_custkey").alias("id"), F.lit("active").alias("status"))
    now = customers.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "active").otherwise("stopped").alias("status"))
    return relations.unchanged_markers(marks, now).select(F.col("id").alias("c_custkey"), F.lit(True).alias("status_same"))


@query("""with s as (select *, min(case when event_type = 'purchase' then event_id end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as sealed from events)
    select a.user_id, a.event_id from s a join events b on b.event_id = a.sealed where a.event_type != 'purchase' or a.value is distinct from b.value""")
def changed_after_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Versions that differ from the one that was ready; stand-in: events of users, ready with their first purchase."""
    rows = load(spark, sf, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "purchase", "ready").otherwise(F.col("event_type")).alias("status"))
    return constraints.changed_after_ready(rows, "user_id", "event_id").select("user_id", "event_id")


@query("""select p_partkey, [x for x in list_sort(list_distinct(string_split(lower(p_name), ' '))) if x not in ('small', 'ring')] as unknown, len(string_split(p_name, ' ')) != len(list_distinct(string_split(p_name, ' '))) as repeats,
    len([x for x in string_split(lower(p_name), ' ') if x in ('small', 'ring')]) as known from part""")
def set_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Values that aren't known, values held twice, and those in common; stand-in: words of part names."""
    words = F.split(F.lower("p_name"), " ")
    common = F.filter(words, lambda w: F.array_contains(F.array_intersect(words, F.array(F.lit("small"), F.lit("ring"))), w))
    return load(spark, sf, "part").select("p_partkey", text.unsupported(words, ["small", "ring"]).alias("unknown"), text.has_repeats(F.split("p_name", " ")).alias("repeats"), F.size(common).cast("long").alias("known"))


@query("""select event_id, case when k::integer between 1 and 50 then k::integer end as n, case when event_id % 3 != 0 then (k || '.5')::double end as secs,
    case when event_id % 2 = 0 then ('0.' || k)::decimal(38, 18) when k = '0' then 1::decimal(38, 18) end as share from (select event_id, props->>'$.k' as k from events)""")
def typed_values(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as positive ints, seconds and probabilities, null where they aren't; stand-in: event properties."""
    k = F.get_json_object("props", "$.k")
    number = F.when(k.cast("int") > 50, F.concat(F.lit("-"), k)).otherwise(k)
    share = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("0."), k)).otherwise(F.concat(F.lit("1."), k))
    return load(spark, sf, "events").select(
        "event_id", text.positive_int(number).alias("n"), text.seconds(F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.concat(k, F.lit(".5")))).alias("secs"), text.probability(share).alias("share")
    )


@query("""select event_id, status between 200 and 299 as ok, status % 2 = 0 and (status % 3 = 0 or status in (124, 137)) as late from (select event_id, (props->>'$.k')::integer * 5 + 4 as status from events)""")
def exit_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Timeouts by flag or exit code, and answers that are good; stand-in: five times an event's property and four."""
    status = F.get_json_object("props", "$.k").cast("int") * 5 + 4
    return load(spark, sf, "events").select("event_id", text.http_ok(status).alias("ok"), text.timed_out(status % 2 != 0, status % 3 == 0, status).alias("late"))


@query("""select n_nationkey, 'Dear ' || n_name || ' of ' || n_name || '!' as filled, case when n_nationkey % 2 = 0 then ['place'] else [] end as missing from nation""")
def filled_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Placeholders replaced one after the other, and those that a template lacks."""
    template = F.when(F.col("n_nationkey") % 2 == 0, "Dear {who}").otherwise("Dear {who} of {place}")
    done = text.filled(F.lit("Dear {who}!"), {"who": F.lit("{name} of {name}"), "name": F.col("n_name")})
    return load(spark, sf, "nation").select("n_nationkey", done.alias("filled"), text.missing_placeholders(template, ["who", "place"]).alias("missing"))


@query(r"""select page_id, regexp_full_match('CWE-' || page_id || case page_id % 3 when 0 then chr(10) else '' end, 'CWE-[0-9]+') as cwe, page_id % 4 = 0 as hash, regexp_full_match(url, '.*[^/]') as path from pages""")
def patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Weakness ids (a line end is none), hashes, absolute paths; stand-in on pages."""
    cwe = F.concat(F.lit("CWE-"), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, "\n").otherwise(""))
    good = F.sha2("url", 256)  # of four pages one has it; the others have capitals, a line end, or one digit less
    said = F.element_at(F.array(good, F.concat(F.lit("A"), F.substring(F.upper(good), 2, 63)), F.concat(good, F.lit("\n")), F.substring(good, 1, 63)), (F.col("page_id") % 4 + 1).cast("int"))
    return load(spark, sf, "pages").select("page_id", text.is_cwe(cwe).alias("cwe"), text.is_sha256(said).alias("hash"), text.is_absolute_path(F.concat(F.lit("/"), F.col("url"))).alias("path"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then case when c_nationkey = 3 then null when c_nationkey < 3 then 'remote_url required' else 'remote_url must use HTTPS or SSH' end
    when c_nationkey >= 3 then 'remote_url not allowed' when c_mktsegment = 'BUILDING' then 'credential_ref not allowed' end as problem from customer""")
def source_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a repository's source fields; stand-in on customers."""
    url = F.when(F.col("c_nationkey") == 3, "https://host/path").when(F.col("c_nationkey") > 3, "http://host/path")
    kind, secret = F.when(F.col("c_custkey") % 2 == 0, "git").otherwise("zip"), F.when(F.col("c_mktsegment") == "BUILDING", "s")
    return load(spark, sf, "customer").select("c_custkey", text.source_error(kind, url, secret, F.lit(None).cast("string")).alias("problem"))


@query("""with m as (select n_nationkey, case when n_nationkey % 2 = 0 then 'right' else 'left' end as winner, case n_nationkey % 3 when 0 then ['token'] when 1 then ['token', 'url'] else [] end as missing from nation) select * from m""")
def merged_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of which the right one wins, and required keys that a map lacks or has empty."""
    left = F.create_map(F.lit("k"), F.lit("left"), F.lit("other"), F.lit("x"))
    right = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("k"), F.lit("right"))).otherwise(F.create_map(F.lit("z"), F.lit("y")))
    token, url = F.when(F.col("n_nationkey") % 3 == 2, "t").otherwise(""), F.when(F.col("n_nationkey") % 3 != 1, "u")
    env = F.create_map(F.lit("token"), token, F.lit("url"), url)
    return load(spark, sf, "nation").select("n_nationkey", F.element_at(text.merged(left, right), "k").alias("winner"), text.missing_values(env, ["token", "url"]).alias("missing"))
