"""Queries over whole tables, against brute force on small ones."""

from datetime import datetime, timedelta

from millrace.queries import QUERIES


def test_self_relation_links_every_event(spark, tmp_path):
    ids = [i for i in range(130) if i % 9]  # 0 and some parents are missing
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.child, r.parent) for r in QUERIES["self_relation"](spark, str(tmp_path)).collect())
    assert got == [(i, i // 2) for i in ids if i // 2 in ids]


def test_timeline_has_all_orders_and_lines_in_order(spark, tmp_path):
    day = lambda i: datetime(2020, 1, 1) + timedelta(days=i * 37 % 11)
    orders = [(i, 250 + i, day(i)) for i in range(120)]
    lines = [(i % 40, i, day(i + 3)) for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in QUERIES["timeline"](spark, str(tmp_path)).collect()]
    assert got == sorted([(at, "order", k) for k, _, at in orders] + [(at, "shipment", k) for k, _, at in lines])
