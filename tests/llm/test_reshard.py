"""Resharding: the flow's optimum, the law, and the rewritten files."""

import random
import zlib
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from millrace.llm import reshard as R
from millrace.llm.queries import op7_reshard


def test_flow_is_feasible_and_least():
    rng = random.Random(4)
    for _ in range(200):
        old, new = rng.randrange(1, 7), rng.randrange(1, 9)
        sizes = [rng.randrange(0, 50) for _ in range(old)]
        caps = R.even(sum(sizes), new)
        rng.shuffle(caps)
        flow = R.min_cost_flow(sizes, caps)
        for i, n in enumerate(sizes):
            assert sum(f for (a, _), f in flow.items() if a == i) == n
        for j, n in enumerate(caps):
            assert sum(f for (_, b), f in flow.items() if b == j) == n
        # no plan can keep more than min(size, capacity) in each place
        assert sum(f for (a, b), f in flow.items() if a == b) == sum(min(a, b) for a, b in zip(sizes, caps, strict=False))


def check(rows, shards):
    sizes, largest = Counter(), max(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
    for j in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == j)
        assert slots == list(range(len(slots)))
        assert abs(sizes[j] - sum(sizes.values()) / shards) <= largest
    return sizes


def test_query_keeps_the_law(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_reshard(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    check(rows, 8)


def test_moves_least_bytes_nulls_repeats_and_clashes(spark):
    rng = random.Random(9)
    rows = [(i if i % 50 else None, "y" * rng.randrange(40) if i % 7 else None, i % 3 if i % 11 else None, "x") for i in range(900)]
    rows += [(5, "same", 1, "x")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, size string")
    out = R.reshard(docs, F.col("shard"), 5).collect()
    assert len(out) == len(rows)
    check(out, 5)
    totals = Counter()
    for r in out:
        totals[r.old_shard] += r.size
    share = sum(totals.values()) / 5
    least = sum(max(0, totals[i] - (share if i < 5 else 0)) for i in totals)
    assert sum(r.size for r in out if r.moved) <= least + 5 * 41
    assert R.reshard(docs.limit(0), F.col("shard"), 5).count() == 0


def placed_by_hand(spark, folder, shards):
    """Shard and slot of each (file, row), row by row: the flow's cuts along each old shard's files in order."""
    table = spark.read.parquet(folder)
    rows = table.select("doc_id", "text", "shard", "_metadata.file_path", "_metadata.row_index").collect()
    rows.sort(key=lambda r: (r.shard, r.file_path, r.row_index))
    size = [len((r.text or "").encode()) + 1 for r in rows]
    totals = Counter()
    for r, n in zip(rows, size, strict=True):
        totals[r.shard] += n
    sizes = [totals[i] for i in range(max(totals) + 1)]
    flow = R.min_cost_flow(sizes, R.even(sum(sizes), shards))
    place, at = {}, Counter()
    for r, n in zip(rows, size, strict=True):
        middle = at[r.shard] + n - (n + 1) // 2
        at[r.shard] += n
        begin = 0
        for j in sorted((b for a, b in flow if a == r.shard), key=lambda b: (b != r.shard, b)):
            begin += flow[r.shard, j]
            if middle < begin:
                place[r.file_path, r.row_index] = (r.doc_id, j)
                break
    slots, out = Counter(), Counter()
    for r in rows:
        doc, j = place[r.file_path, r.row_index]
        out[doc, r.text, j, slots[j]] += 1
        slots[j] += 1
    return out


def test_rewrite_row_by_row(spark, tmp_path):
    """Affected files only are rewritten; shard and slot of every row, read from the files, are those of a plain loop."""
    rng = random.Random(3)
    rows = [(i, "z" * 100, i % 2 if i < 400 else 2) for i in range(600)]
    odd = [(None if i % 40 == 0 else i, None if i % 30 == 0 else "w" * rng.randrange(200), min(i % 5, 3)) for i in range(500)] + [(7, "same", 3)] * 200
    for name, data, shards, quiet in (("a", rows, 3, True), ("b", rows, 4, False), ("c", odd, 6, False), ("d", odd, 2, False)):
        old = str(tmp_path / name)
        spark.createDataFrame(data, "doc_id long, text string, shard int").repartition(6).write.partitionBy("shard").parquet(old)
        new, files = R.rewrite(spark.read.parquet(old), shards, str(tmp_path / f"{name}-new"))
        told = files.collect()
        assert any(r.affected for r in told) != quiet
        got = Counter((r.doc_id, r.text, r.shard, r.slot) for r in new.collect())
        assert got == placed_by_hand(spark, old, shards)
        written = Path(tmp_path / f"{name}-new").rglob("*.parquet")
        rewritten = sum(spark.read.parquet(str(f)).count() for f in written)
        kept = sum(spark.read.parquet(r.file).count() for r in told if not r.affected)
        assert rewritten + kept == len(data)


def test_query_is_the_plain_loop(spark, sf_dir):
    """op7 over a whole table: size, CRC and law of each row, all of them, from rewritten files."""
    rows = op7_reshard(spark, sf_dir).collect()
    assert {r.shard for r in rows} == set(range(8)) and all(r.law == "bytes" for r in rows)
    check(rows, 8)


def test_clashing_names_stay(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 5), i % 3) for i in range(60)]
    extra = {c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in [*R.INNER, "_file", "_row"]}
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumns(extra)
    out = R.reshard(docs, F.col("shard"), 4)
    assert set(extra) <= set(out.columns) and out.count() == 60
    assert all(r[c] == f"{c} of {r.doc_id}" for r in out.collect() for c in extra)
    docs.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    new, _ = R.rewrite(spark.read.parquet(f"{tmp_path}/old"), 4, f"file://{tmp_path}/new")
    told = new.collect()
    assert len(told) == 60 and all(r[c] == f"{c} of {r.doc_id}" for r in told for c in extra)
    for s in range(4):
        assert sorted(r.slot for r in told if r["shard"] == s) == list(range(sum(r["shard"] == s for r in told)))
