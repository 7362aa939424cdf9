"""Registered queries: each operator on a table that stands in for audit data, with its DuckDB SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import constraints, lifecycle, listing, relations, versions
from millrace.plans import graph, reporting, schedule
from millrace.sources import rewrites, tables
from millrace.sources.scratch import fresh_path
from millrace.sources.tables import load
from millrace.streaming import leases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("""select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders
    where o_orderstatus = 'O' and o_orderpriority = '1-URGENT' order by o_orderdate desc, o_orderkey limit 50""")
def list_page(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered, ordered page; stand-in on orders."""
    rows = listing.filtered(load(spark, sf, "orders"), o_orderstatus="O", o_orderpriority="1-URGENT")
    return listing.page(rows, F.desc("o_orderdate"), F.asc("o_orderkey")).select(*ORDER_COLUMNS)


@query("""select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 20 offset 40""")
def list_page_offset(spark: SparkSession, sf: str) -> DataFrame:
    """A later page; stand-in on orders."""
    rows = listing.filtered(load(spark, sf, "orders"), o_orderstatus="F", o_orderpriority=None)
    return listing.page(rows, F.desc("o_orderdate"), F.asc("o_orderkey"), limit=20, offset=40).select("o_orderkey", "o_totalprice")


@query("select count(*) as total from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
def list_total(spark: SparkSession, sf: str) -> DataFrame:
    """A1: count under the page's filters."""
    return listing.total(listing.filtered(load(spark, sf, "orders"), o_orderstatus="O", o_orderpriority="1-URGENT"))


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'P'")
def optional_filter_null(spark: SparkSession, sf: str) -> DataFrame:
    """An absent filter adds no conjunct."""
    return listing.filtered(load(spark, sf, "orders"), o_orderstatus="P", o_orderpriority=None).select("o_orderkey", "o_custkey")


@query("select c_custkey, c_name from customer where (c_acctbal > 0) is true")
def boolean_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A boolean filter compares as IS; stand-in on customer."""
    rows = load(spark, sf, "customer").withColumn("active", F.col("c_acctbal") > 0)
    return listing.filtered(rows, active=True).select("c_custkey", "c_name")


@query("select p_partkey, p_brand from part where lower(p_name) = (select min(lower(p_name)) from part)")
def same_name(spark: SparkSession, sf: str) -> DataFrame:
    """Equality but for case; stand-in on part."""
    part = load(spark, sf, "part")
    least = part.agg(F.min(F.lower("p_name")).alias("_least"))
    return listing.same_name(part.join(F.broadcast(least)), "p_name", F.col("_least")).select("p_partkey", "p_brand")


@query("select * from nation where n_nationkey = 7")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A row by its key."""
    return listing.lookup(load(spark, sf, "nation"), "n_nationkey", 7)


@query("select lower(p_name) as name, count(*) as n from part group by 1 having count(*) > 1")
def name_collision_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Names that collide but for case."""
    return constraints.repeated_keys(load(spark, sf, "part").select(F.lower("p_name").alias("name")), ["name"])


@query("""select s_suppkey, s_name from supplier where not exists
    (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49 and l_discount > 0.09)""")
def deletable_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parents that nothing refers to; stand-in on supplier and filtered lineitem."""
    child = load(spark, sf, "lineitem").filter("l_quantity > 49 and l_discount > 0.09").select("l_suppkey")
    return relations.unreferenced(load(spark, sf, "supplier"), child, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def blocked_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parents that a reference blocks."""
    child = listing.filtered(load(spark, sf, "orders"), o_orderpriority="1-URGENT").select("o_custkey")
    return relations.referenced(load(spark, sf, "customer"), child, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("""select l_linenumber, count(*) as n from lineitem
    where l_partkey not in (select p_partkey from part where p_size <= 25) group by 1""")
def orphan_refs(spark: SparkSession, sf: str) -> DataFrame:
    """References without a parent, by line number."""
    parent = load(spark, sf, "part").filter("p_size <= 25")
    return reporting.counts_by(relations.orphans(load(spark, sf, "lineitem"), parent, "l_partkey", "p_partkey"), "l_linenumber")


@query("""with gone as (select c_custkey from customer where c_nationkey = 3),
    o as (select o_orderkey from orders where o_custkey in (select c_custkey from gone))
    select 'customer' as kind, c_custkey as id, null::integer as line from customer where c_nationkey != 3 union all
    select 'orders', o_orderkey, null from orders where o_orderkey not in (select o_orderkey from o) union all
    select 'lineitem', l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from o)""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Deleting parents and what refers to them, by copy on write; what is left, read from the files of the new layout."""
    gone = listing.filtered(load(spark, sf, "customer"), c_nationkey=3).select("c_custkey")
    chain = [(load(spark, sf, "orders"), "o_custkey", "o_orderkey"), (load(spark, sf, "lineitem"), "l_orderkey", "l_orderkey")]
    customers, orders, lines = (x.rows for x in rewrites.cascaded(load(spark, sf, "customer"), gone, "c_custkey", chain, fresh_path(spark, "cascade")))
    none = F.lit(None).cast("int").alias("line")
    left = customers.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), none)
    left = left.unionByName(orders.select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("id"), none))
    return left.unionByName(lines.select(F.lit("lineitem").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")))


@query("""select c_custkey, c_name from customer where c_nationkey >= 5 or exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""")
def repositories_left(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories after deleting those of a list that nothing refers to; stand-in: customers of five nations, urgent orders refer to them."""
    asked = load(spark, sf, "customer").filter("c_nationkey < 5").select("c_custkey")
    used = listing.filtered(load(spark, sf, "orders"), o_orderpriority="1-URGENT")
    left, _ = rewrites.deleted_unreferenced(load(spark, sf, "customer"), asked, "c_custkey", used, "o_custkey", fresh_path(spark, "repositories"))
    return left.rows.select("c_custkey", "c_name")


@query("""select o_orderkey, case when o_orderstatus != 'F' and o_custkey in (select c_custkey from customer where c_nationkey = 7) then 'cancelling' else o_orderstatus end as status from orders""")
def cancelled_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs after requests to cancel, their files written again; stand-in: unfinished orders of one nation's customers."""
    asked = load(spark, sf, "customer").filter("c_nationkey = 7").select("c_custkey")
    orders = load(spark, sf, "orders")
    runs = orders.filter("o_orderstatus != 'F'").join(asked, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("run"), F.lit("reporting").alias("now"))
    to, error = lifecycle.cancelled(F.col("now"))
    changes = runs.select("run", to.alias("to"), error.alias("error")).filter("error is null").drop("error")
    return rewrites.updated(orders, changes, "o_orderkey", fresh_path(spark, "runs"), o_orderstatus=F.col("to")).rows.select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("""with c as (select c_nationkey, string_agg(c_custkey || ':' || c_name, ',' order by c_custkey) as customers from customer group by 1),
      s as (select s_nationkey, string_agg(s_suppkey || ':' || s_name, ',' order by s_suppkey) as suppliers from supplier where s_suppkey % 3 = 0 group by 1)
    select n_nationkey, n_name, coalesce(customers, '') as customers, coalesce(suppliers, '') as suppliers from nation left join c on c_nationkey = n_nationkey left join s on s_nationkey = n_nationkey""")
def nested_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Parents with two ordered child collections, gathered before the join; all their contents in order."""
    nested = relations.nested(
        load(spark, sf, "nation"), "n_nationkey",
        customers=(load(spark, sf, "customer"), "c_nationkey", ["c_custkey", "c_name"]),
        suppliers=(load(spark, sf, "supplier").filter("s_suppkey % 3 = 0"), "s_nationkey", ["s_suppkey", "s_name"]),
    )

    def told(name: str, *columns: str) -> Column:
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", *(x[c] for c in columns))), ",").alias(name)

    return nested.select("n_nationkey", "n_name", told("customers", "c_custkey", "c_name"), told("suppliers", "s_suppkey", "s_name"))


@query("select conv_id, string_agg(role, '>' order by turn) as path from conversations group by conv_id")
def detail_path(spark: SparkSession, sf: str) -> DataFrame:
    """K7: children in their order; roles of conversations by turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = load(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["role"]), ">").alias("path"))


@query("select r_name, count(*) as n from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey group by 1")
def bridge_join(spark: SparkSession, sf: str) -> DataFrame:
    """Many-to-many through a bridge; stand-in on region, nation, supplier."""
    joined = relations.bridged(load(spark, sf, "region"), "r_regionkey", load(spark, sf, "nation"), "n_regionkey", "n_nationkey", load(spark, sf, "supplier"), "s_nationkey")
    return reporting.counts_by(joined, "r_name")


@query("select a.event_id as child, b.event_id as parent from events a join events b on b.event_id = a.event_id // 2 where a.event_id > 0")
def self_relation(spark: SparkSession, sf: str) -> DataFrame:
    """A table that refers to itself; stand-in: an event's parent is the one with half its id."""
    events = load(spark, sf, "events").select("event_id", F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2)).alias("up"))
    return relations.children_of(events, "event_id", "up").select("child", "parent")


@query("""select l_orderkey, l_linenumber, coalesce(o_orderstatus, 'deleted') as status
    from lineitem left join (select * from orders where o_totalprice > 100000) on o_orderkey = l_orderkey""")
def status_or_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """The parent's status, or deleted."""
    projects = load(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return relations.status_or_deleted(load(spark, sf, "lineitem"), projects, "l_orderkey").select("l_orderkey", "l_linenumber", "status")


@query("select p_brand, (max(p_size) + 1)::bigint as next_version from part group by p_brand")
def next_version(spark: SparkSession, sf: str) -> DataFrame:
    """V1, A2: the next version of each name; stand-in: sizes of brands."""
    return versions.next_version(load(spark, sf, "part"), "p_brand", "p_size")


@query("""select p_brand, p_partkey, p_size from part qualify row_number() over (partition by p_brand order by p_size desc, p_partkey) = 1""")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """V3: the latest of each name."""
    return versions.first_of(load(spark, sf, "part"), ["p_brand"], F.desc("p_size"), F.asc("p_partkey")).select("p_brand", "p_partkey", "p_size")


@query("select p_brand as name, max(p_partkey) as active_version from part where p_size > 25 group by 1")
def active_version(spark: SparkSession, sf: str) -> DataFrame:
    """V2: the one active version of each name; stand-in: parts inserted by key, active if large."""
    policies = load(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version"), (F.col("p_size") > 25).alias("active"))
    return versions.active_version(policies)


@query("select sha256(text) as fingerprint, min(doc_id) as doc_id from documents group by 1")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """V5: of rows with one fingerprint the first stays; stand-in: documents by the hash of their text."""
    docs = load(spark, sf, "documents").select(F.sha2("text", 256).alias("fingerprint"), "doc_id")
    return versions.first_of(docs, ["fingerprint"], F.asc("doc_id"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Composite keys that repeat."""
    return constraints.repeated_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1 having count(*) > 1")
def partial_unique(spark: SparkSession, sf: str) -> DataFrame:
    """A partial unique constraint; stand-in: at most one order in progress for a customer."""
    return constraints.repeated_keys(load(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus") == "P")


@query("""select l_returnflag, count(*) filter (where not (l_quantity <= 40)) as quantity, count(*) filter (where not (l_discount between 0 and 0.08)) as discount,
    count(*) filter (where not (l_tax >= 0)) as tax from lineitem group by 1""")
def check_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break each range check; null passes."""
    return constraints.violation_counts(
        load(spark, sf, "lineitem"), "l_returnflag", quantity=F.col("l_quantity") <= 40, discount=F.col("l_discount").between(0, 0.08), tax=F.col("l_tax") >= 0
    )


@query("select event_id, event_type from events where event_type not in ('view', 'signup', 'purchase')")
def enum_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Values outside an enumeration."""
    return constraints.not_in(load(spark, sf, "events"), "event_type", ["view", "signup", "purchase"]).select("event_id", "event_type")


EVENT_MOVES = [("view", "view"), ("view", "click"), ("click", "purchase"), ("signup", "view"), ("purchase", "view"), ("click", "view")]
_MOVES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in EVENT_MOVES)


@query(f"""with m(f, t) as (values {_MOVES_SQL}), s as (
      select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as from_status from events)
    select user_id, count(*) as n from s where from_status is not null and not exists (select 1 from m where f = from_status and t = event_type) group by 1""")
def invalid_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """V4, L1: recorded moves that are not allowed; stand-in: event types of users."""
    moves = lifecycle.allowed(spark, EVENT_MOVES)
    return reporting.counts_by(lifecycle.invalid_moves(load(spark, sf, "events"), moves, "user_id", ["ts", "event_id"], "event_type"), "user_id")


@query("""select o_orderkey, case o_orderstatus when 'F' then 'completed' when 'P' then 'cancelling' else 'cancelling' end as status,
    case o_orderstatus when 'F' then 'audit_run_not_cancellable' end as error_code from orders""")
def cancel_requests(spark: SparkSession, sf: str) -> DataFrame:
    """L3: what a request to cancel does; stand-in: order statuses as completed, cancelling, and running ones."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "cancelling").otherwise("reporting")
    to, error = lifecycle.cancelled(status)
    return load(spark, sf, "orders").select("o_orderkey", to.alias("status"), error.alias("error_code"))


@query("""select user_id, min(ts) filter (where event_type = 'signup') as started_at, max(ts) filter (where event_type in ('purchase', 'error')) as completed_at,
    arg_max(event_type, ts) filter (where event_type in ('view', 'click', 'signup')) as current_stage from events group by user_id""")
def lifecycle_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """L4: times and stage that a history leaves; stand-in: events of users."""
    names = {"signup": "ingesting", "view": "static_scanning", "click": "reporting", "purchase": "completed", "error": "failed"}
    status = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("event_type"))
    out = lifecycle.stamped(load(spark, sf, "events").withColumn("status", status), "user_id", "ts", "status")
    back = F.element_at(F.create_map(*(F.lit(x) for a, b in names.items() for x in (b, a))), F.col("current_stage"))
    return out.select("user_id", "started_at", "completed_at", back.alias("current_stage"))


@query(f"""with recursive m(f, t) as (values {_MOVES_SQL}), e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as i from events),
    w as (select user_id, 0::bigint as event_id, null::varchar as event_type, 0::bigint as i, null::varchar as from_status, 'view' as status, null::varchar as error_code from (select distinct user_id from events)
      union all select e.user_id, e.event_id, e.event_type, e.i, w.status, case when m.f is null then w.status else e.event_type end, case when m.f is null then 'audit_run_invalid_transition' end
      from w join e on e.user_id = w.user_id and e.i = w.i + 1 left join m on m.f = w.status and m.t = e.event_type)
    select user_id, event_id, event_type, from_status, status, error_code from w where i > 0""")
def replayed_requests(spark: SparkSession, sf: str) -> DataFrame:
    """L1: requested moves in order, where a refused one changes nothing; a sequential fold."""
    events = load(spark, sf, "events").select("user_id", "event_id", "event_type")
    return lifecycle.replay(events, EVENT_MOVES, "view", "user_id", "event_id", "event_type")


@query("""select o_custkey as id, count(*) as fact_count, count(*) filter (where o_orderstatus != 'F') as open_intent_count,
    count(*) filter (where o_orderstatus = 'P') as working_intent_count, count(*) filter (where o_orderstatus = 'O') as unclaimed_intent_count,
    count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH')) as hint_count from orders group by 1""")
def project_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A4, A5: counts of a project; stand-in: orders of customers as facts and intents."""
    orders = load(spark, sf, "orders")
    intents = orders.select(F.col("o_custkey").alias("project"), F.when(F.col("o_orderstatus") == "F", "x").alias("to"), F.when(F.col("o_orderstatus") == "P", "w").alias("worker"))
    projects = orders.select(F.col("o_custkey").alias("id")).distinct()
    facts = orders.select(F.col("o_custkey").alias("project"))
    hints = orders.filter("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("project"))
    return graph.summaries(projects, facts, intents, hints).select("id", "fact_count", "open_intent_count", "working_intent_count", "unclaimed_intent_count", "hint_count")


@query("""select o_custkey as project, o_orderkey as id from orders where o_orderstatus = 'O'
    qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1""")
def newest_open(spark: SparkSession, sf: str) -> DataFrame:
    """The newest open intent of a project; stand-in on orders."""
    orders = load(spark, sf, "orders").filter("o_orderstatus = 'O'")
    return graph.newest(orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))).select("project", "id")


@query("""select o_custkey as project, o_orderkey as id from orders where o_orderstatus != 'F'
    qualify row_number() over (partition by o_custkey order by o_orderstatus = 'P', o_orderdate, o_orderkey) = 1""")
def bootstrap_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Unclaimed first, then the oldest; stand-in on orders."""
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "w").alias("worker"), "o_orderstatus")
    return graph.bootstrap_choice(orders, F.col("o_orderstatus") != "F").select("project", "id")


@query("""with t as (select l_suppkey, l_orderkey, l_linenumber, unnest([l_orderkey, l_partkey]) as fact from lineitem)
    select l_suppkey as project, l_orderkey as intent, fact, count(*) as n from t join orders on o_custkey = l_suppkey and o_orderkey = fact group by 1, 2, 3""")
def hyperedge_explode(spark: SparkSession, sf: str) -> DataFrame:
    """An edge for each tail of a hyperedge that exists; stand-in: lines of suppliers come from two keys, facts are orders of customers."""
    key = [F.col("l_suppkey").alias("project"), F.col("l_orderkey").alias("id"), F.array("l_orderkey", "l_partkey").alias("from"), F.lit(None).cast("string").alias("to")]
    facts = load(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"))
    return reporting.counts_by(graph.hyperedges(load(spark, sf, "lineitem").select(*key), facts), "project", "intent", "fact")


@query("""with h as (select user_id, date_trunc('hour', ts) as hour, count(*) filter (where event_type = 'view') as facts, count(*) filter (where event_type = 'click') as hints, count(*) filter (where event_type = 'error') as opened from events group by 1, 2),
    p as (select *, lag(facts) over w as f, lag(hints) over w as g, lag(opened) over w as o from h window w as (partition by user_id order by hour))
    select user_id, hour, case when f is null then 'initial' else array_to_string(list_filter([case when facts > f then 'facts:' || f || '->' || facts end, case when hints > g then 'hints:' || g || '->' || hints end,
      case when o > 0 and opened = 0 then 'open_intents:' || o || '->0' end], lambda x: x is not null), ',') end as why from p where f is null or facts > f or hints > g or o > 0 and opened = 0""")
def change_trigger(spark: SparkSession, sf: str) -> DataFrame:
    """What grew since the checkpoint before, and intents that ran out; stand-in: hourly events of users as facts, hints and open intents."""
    kinds = {"facts": "view", "hints": "click", "opened": "error"}
    hours = load(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(*(F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()))
    order = Window.partitionBy("user_id").orderBy("hour")
    hours = hours.withColumns({f"was_{name}": F.lag(name).over(order) for name in kinds})
    why = graph.trigger(*map(F.col, kinds), *(F.col(f"was_{name}") for name in kinds), F.col("was_facts").isNotNull())
    return hours.select("user_id", "hour", why.alias("why")).filter("why is not null")


@query("""with p as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as was, row_number() over (partition by user_id order by ts, event_id) as i from events)
    select user_id, event_id from p where i = 1 or event_type != was""")
def log_on_change(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows that differ from the one before."""
    return versions.changed(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("select n_nationkey, n_name, ((row_number() over (order by n_name) - 1 - 7 + 25 * 7) % 25)::bigint as turn from nation")
def rotation(spark: SparkSession, sf: str) -> DataFrame:
    """V7: round robin from a cursor; stand-in on nation."""
    return versions.rotated(load(spark, sf, "nation"), "n_name", 7).select("n_nationkey", "n_name", "turn")


@query("""select s_suppkey, row_number() over (order by s_nationkey % 3, s_nationkey, s_name)::bigint as rank from supplier""")
def worker_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by priority, load, name; stand-in on supplier."""
    workers = load(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), (F.col("s_nationkey") % 3).alias("priority"), F.col("s_nationkey").alias("running"))
    return schedule.chosen(workers).select("s_suppkey", "rank")


@query("select s_suppkey, sum(s_nationkey + 1) over (order by s_suppkey rows unbounded preceding)::bigint as cum from supplier")
def weighted_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """V9: running weights; stand-in on supplier."""
    options = load(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).cast("long").alias("weight"))
    return schedule.running_weights(options, "weight", "s_suppkey").select("s_suppkey", "cum")


@query("""with c as (select o_orderkey, sum(o_custkey) over (order by o_orderdate, o_orderkey rows unbounded preceding)::bigint as cum from orders)
    select o_orderkey, cum from c where cum >= (select sum(o_custkey) * 0.75 from orders) order by cum, o_orderkey limit 1""")
def weighted_choice(spark: SparkSession, sf: str) -> DataFrame:
    """V9: the option that a number between 0 and 1 picks, by running weights; stand-in: orders weighted by customer number, 0.75 drawn."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").cast("long").alias("weight"))
    drawn = orders.agg((F.sum("weight") * F.lit(0.75)).alias("drawn"))
    return schedule.weighted_pick(orders.join(F.broadcast(drawn)), "weight", F.col("drawn"), "o_orderdate", "o_orderkey").select("o_orderkey", "cum")


@query("select o_custkey as project, string_agg(label, ',' order by label) as labels from (select o_custkey, o_orderpriority || ':' || o_orderstatus || case when o_orderstatus = 'P' then ':' || o_orderkey else '' end as label from orders) group by 1")
def task_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted labels of a project's tasks; a null intent is skipped."""
    tasks = load(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("task_type"), F.col("o_orderstatus").alias("worker"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).cast("string").alias("intent"))
    return schedule.labels(tasks).select("project", F.array_join("labels", ",").alias("labels"))


@query("select l_suppkey, count(*) as running from lineitem where l_linestatus = 'O' group by 1")
def running_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Running tasks by worker; stand-in on open lineitems by supplier."""
    return schedule.running_by(load(spark, sf, "lineitem").filter("l_linestatus = 'O'"), "l_suppkey")


@query("select o_custkey, bool_and(o_totalprice > 50000) as all_large, bool_or(o_orderstatus = 'P') as any_open from orders group by 1")
def quantifiers(spark: SparkSession, sf: str) -> DataFrame:
    """A10: any and all."""
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 50000).alias("all_large"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_open"))


@query("select count(*) as total, count(*) filter (where s_acctbal >= 0) as healthy, count(*) filter (where s_acctbal < 0) as unhealthy from supplier")
def health_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of healthy and unhealthy; stand-in on supplier balances."""
    good = F.col("s_acctbal") >= 0
    return load(spark, sf, "supplier").agg(F.count("*").alias("total"), F.count_if(good).alias("healthy"), F.count_if(~good).alias("unhealthy"))


@query("""with c as (select c_nationkey, count(*) as n, sum(c_custkey % 3) as odd from customer where c_custkey % 4 != 1 group by 1)
    select c_nationkey, sum(case when c_custkey % 4 = 1 then 0 else (case when c_custkey = (select min(b.c_custkey) from customer b where b.c_custkey % 4 != 1 and b.c_nationkey = a.c_nationkey) then 1 - (n - 1) * 0.001::decimal(38,18) else 0.001::decimal(38,18) end) end
      + case when a.c_nationkey % 2 = 1 and c_custkey = (select min(b.c_custkey) from customer b where b.c_nationkey = a.c_nationkey) then 0.000000000000000001::decimal(38,18) else 0 end) = 1 as exact
    from customer a join c using (c_nationkey) group by 1""")
def exact_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares that must be exactly 1 in decimals; stand-in: customers of a nation share it, and odd nations miss by 1e-18."""
    rows = load(spark, sf, "customer").select("c_nationkey", "c_custkey")
    shared = rows.filter("c_custkey % 4 != 1").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first")).withColumnRenamed("c_nationkey", "of")
    least = rows.groupBy(F.col("c_nationkey").alias("at")).agg(F.min("c_custkey").alias("least"))
    wide = "decimal(24,18)"  # sums of two keep the scale
    part = F.when(F.col("c_custkey") % 4 == 1, F.lit(0)).when(F.col("c_custkey") == F.col("first"), F.lit(1).cast(wide) - (F.col("n") - 1) * F.lit("0.001").cast("decimal(9,3)")).otherwise(F.lit("0.001").cast(wide))
    off = F.when((F.col("c_nationkey") % 2 == 1) & (F.col("c_custkey") == F.col("least")), F.lit("0.000000000000000001").cast(wide)).otherwise(F.lit(0).cast(wide))
    joined = rows.join(shared, F.col("c_nationkey") == F.col("of")).join(least, F.col("c_nationkey") == F.col("at"))
    return schedule.shares_add_up(joined.select("c_nationkey", (part.cast(wide) + off).cast("string").alias("share")), "share", "c_nationkey")


@query("select conv_id, arg_max(text, turn) as text from conversations where role = 'assistant' group by 1")
def last_assistant(spark: SparkSession, sf: str) -> DataFrame:
    """The last assistant message of a conversation."""
    rows = listing.filtered(load(spark, sf, "conversations"), role="assistant")
    return rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("select event_id, (props->>'$.k')::bigint as k from events where json_type(props) = 'OBJECT'")
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    """A field of JSON lines, of objects alone."""
    return tables.json_lines(load(spark, sf, "events"), "props").select("event_id", F.variant_get("event", "$.k", "long").alias("k"))


@query("select event_id, (props->>'$.k') is not null and len(json_keys(props)) = 1 as exact from events")
def json_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Exact key sets."""
    return load(spark, sf, "events").select("event_id", text.has_exact_keys(F.col("props"), ["k"]).alias("exact"))


@query(r"""with c as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t from documents)
    select doc_id, case when length(t) > 60 then substr(t, 1, 60) || '...' else t end as preview from c""")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts compacted and cut at 60."""
    return load(spark, sf, "documents").select("doc_id", text.preview(F.coalesce("text", F.lit("")), 60).alias("preview"))


@query(r"select page_id, regexp_matches(url, '^https://[^/@:?#]+(:[0-9]+)?/[^?#]*') as supported from pages")
def url_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Which URLs are supported; the SQL holds for this table's URLs."""
    return load(spark, sf, "pages").select("page_id", text.is_git_url(F.col("url")).alias("supported"))


@query(r"select page_id, case when not (path like '/%' or list_contains(string_split(path, '/'), '..') or substr(path, 2, 1) = ':') then path end as path from (select page_id, replace(substr(url, 9), '\', '/') as path from pages)")
def path_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Relative snapshot paths; stand-in: URLs without their scheme."""
    return load(spark, sf, "pages").select("page_id", text.relative_path(F.expr("substring(url, 9)")).alias("path"))


@query("select doc_id, sha256(coalesce(lang, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(text, '')) as fingerprint from documents")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """X32 (specified): a fingerprint of several parts, with a separator of our choice."""
    return load(spark, sf, "documents").select("doc_id", text.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"))


@query("select user_id, case when n >= 80 then 'many' when n <= 50 then 'few' else 'some' end as rule from (select user_id, count(*) as n from events group by 1)")
def forced_rule(spark: SparkSession, sf: str) -> DataFrame:
    """The first matching rule over counts."""
    counts = reporting.counts_by(load(spark, sf, "events"), "user_id")
    return counts.select("user_id", text.first_rule([(F.col("n") >= 80, "many"), (F.col("n") <= 50, "few")], "some").alias("rule"))


@query("select user_id, max(ts) as last_seen from events group by 1 having max(ts) < (select max(ts) from events) - interval 2 hour")
def expired_leases(spark: SparkSession, sf: str) -> DataFrame:
    """ST3: leases whose last heartbeat is over two hours before the data's end."""
    events = load(spark, sf, "events")
    end = events.agg(F.max("ts").alias("_end"))
    seen = leases.last_seen(events, "user_id", "ts").withColumn("worker", F.col("user_id")).join(F.broadcast(end))
    read = leases.expired_cleared(seen, F.col("_end"), 2 * 3600, beat="last_seen")
    return read.filter("worker is null and user_id is not null").select("user_id", "last_seen")


@query("select user_id, arg_min(event_type, ts) as reason, min(ts) as at from events group by 1")
def first_cancellation(spark: SparkSession, sf: str) -> DataFrame:
    """ST6: the first reason stays; stand-in: first events of users."""
    return leases.first_cancellation(load(spark, sf, "events"), "user_id", "ts", "event_type")


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') / count(*) as ratio from orders group by 1")
def coverage_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """A15 (specified): analysed over total; stand-in: finished orders."""
    rows = load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("part"), F.count("*").alias("whole"))
    return rows.select("o_orderpriority", reporting.ratio(F.col("part"), F.col("whole")).alias("ratio"))


@query("select c_mktsegment, c_nationkey, count(*) as n from customer group by 1, 2")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A14 (specified): counts by kind; stand-in on customer."""
    return reporting.counts_by(load(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query("""select o_orderdate as at, 'order' as kind, o_orderkey as id from orders
    union all select l_shipdate, 'shipment', l_orderkey from lineitem""")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """U5 (specified): events of several kinds in one order; all orders and all lines."""
    orders = load(spark, sf, "orders").select(F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    lines = load(spark, sf, "lineitem").select(F.col("l_shipdate").alias("at"), F.lit("shipment").alias("kind"), F.col("l_orderkey").alias("id"))
    return reporting.timeline(orders, lines)


@query("""with f as (select distinct o_custkey as k from orders where o_orderstatus = 'P'), t as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT')
    select (select count(*) from f semi join t using (k)) / (select count(*) from t) as recall, (select count(*) from f semi join t using (k)) / (select count(*) from f) as precision,
    (select count(*) - count(distinct o_custkey) from orders where o_orderstatus = 'P') / (select count(*) from orders where o_orderstatus = 'P') as duplicate_ratio""")
def audit_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A16 (specified): recall, precision, duplicates; stand-in on customers of orders."""
    orders = load(spark, sf, "orders")
    return reporting.quality(orders.filter("o_orderpriority = '1-URGENT'"), orders.filter("o_orderstatus = 'P'"), ["o_custkey"])


@query("""select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as open_orders,
    not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as may_report from customer""")
def completion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """L11 (specified): what stands in the way of a report; stand-in: customers with open orders."""
    blocked = load(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return reporting.gate(load(spark, sf, "customer"), "c_custkey", open_orders=blocked)


@query("select 1 as ok")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    """The probe."""
    return tables.ready(spark)


@query("select to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::varchar as json from region")
def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON documents."""
    return tables.json_documents(load(spark, sf, "region"), "r_regionkey", "r_name")


from millrace import audit_queries, history_queries  # noqa: E402, F401  register more queries
