"""Resharding by minimum-cost flow: new shards of near-equal bytes, moving as few bytes as possible.

The old shards' sizes and the new shards' capacities make a small network (a node for each
shard): staying costs nothing, a moved byte costs one. Its minimum-cost flow says how many
bytes go from each old shard to each new one. Old shards are lines of blocks; the flow cuts
each line, so whole blocks move, and a cut falls between rows. Positions on the lines come
from block totals and sums within blocks, so no shard is ever one group.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import salted, text_of, unused, written

#: Blocks of an old shard: one for so many rows of the corpus, within these bounds.
ROWS_A_BLOCK, FEWEST_BLOCKS, MOST_BLOCKS = 20_000, 64, 65_536
#: Lines of a plan for files that are broadcast, at most.
MOST_PIECES = 200_000


#: Names of columns on the way; columns of a table that have them are called otherwise meanwhile.
INNER = "_block _upto _rank _begin _from _to _old _ahead _f _r _new affected".split()


def _hidden(columns: list[str]) -> dict[str, str]:
    """Other names for the columns whose names are needed here."""
    taken, out = list(columns), {}
    for c in columns:
        if c.lower() in INNER:
            out[c] = unused(taken, f"own {c}")
            taken.append(out[c])
    return out


def min_cost_flow(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Units from each old shard i to each new shard j, at the least total over i != j.

    Shard i of the old and of the new layout are the same place. ``sum(sizes)`` must equal
    ``sum(capacities)``. Edges: i to its own place at cost 0, i to an exchange at cost 1, and
    the exchange to each place at cost 0; so their number grows with the shards, not with
    their square. Flow is sent along cheapest paths until all is placed.
    """
    if sum(sizes) != sum(capacities) or min([*sizes, *capacities], default=0) < 0:
        raise ValueError("sizes and capacities must be nonnegative and add up to the same")
    old, new = len(sizes), len(capacities)
    source, sink, exchange = 0, 1, 2
    first_old, first_new = 3, 3 + old
    to, room, cost, out = [], [], [], [[] for _ in range(3 + old + new)]

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
        return len(to) - 2

    stay = {i: edge(first_old + i, first_new + i, sizes[i], 0) for i in range(min(old, new))}
    away = [edge(first_old + i, exchange, sizes[i], 1) for i in range(old)]
    come = [edge(exchange, first_new + j, capacities[j], 0) for j in range(new)]
    for i, n in enumerate(sizes):
        edge(source, first_old + i, n, 0)
    for j, n in enumerate(capacities):
        edge(first_new + j, sink, n, 0)
    while True:
        price, queued, by = {source: 0}, deque([source]), {}
        while queued:  # cheapest path in the residual network, whose reversed edges may cost -1
            a = queued.popleft()
            for e in out[a]:
                if room[e] and price[a] + cost[e] < price.get(to[e], 1 << 60):
                    price[to[e]], by[to[e]] = price[a] + cost[e], e
                    queued.append(to[e])
        if sink not in price:
            break
        path, node = [], sink
        while node != source:
            path.append(by[node])
            node = to[by[node] ^ 1]
        n = min(room[e] for e in path)
        for e in path:
            room[e] -= n
            room[e ^ 1] += n
    flow = {(i, i): room[e ^ 1] for i, e in stay.items() if room[e ^ 1]}
    waiting = deque((j, room[e ^ 1]) for j, e in enumerate(come) if room[e ^ 1])
    for i, e in enumerate(away):  # what meets at the exchange is dealt in order: neighbours on the line of surplus
        left = room[e ^ 1]
        while left:
            j, want = waiting.popleft()
            n = min(left, want)
            flow[i, j] = flow.get((i, j), 0) + n
            left -= n
            if want > n:
                waiting.appendleft((j, want - n))
    return flow


def even(total: int, shards: int) -> list[int]:
    """``total`` in parts that differ by at most one."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(docs: DataFrame, old_shard: Column, shards: int, doc_id: str = "doc_id", text: str = "text", capacities: list[int] | None = None, file: str | None = None, row: str | None = None) -> DataFrame:
    """``docs`` and ``size, text_crc32, old_shard, shard, slot, moved`` (columns of these names are replaced).

    Blocks are by a hash of id, size and text; with ``file`` and ``row`` (columns that tell the
    file of a row and its place there) each file is a block, in its own order, so that most
    files stay or move whole. A block is one window group.

    ``old_shard``: an int column, from 0, where each row lies now (null: 0). Size: UTF-8
    bytes of the text (null: none) and 1. Shards hold near-equal bytes, or the given
    ``capacities`` (which must add up to the whole): a shard is off by at most one row at each
    cut of its line. Slots run from 0 without gaps in each shard. Rows that repeat, null ids
    and empty texts are rows like others; an empty table gives an empty result. The driver
    gets one total for each old shard.
    """
    spark, columns = docs.sparkSession, docs.columns
    hidden = _hidden(columns)
    named = docs.withColumn("old_shard", F.coalesce(old_shard.cast("int"), F.lit(0))).withColumnsRenamed(hidden)
    doc_id, text, file, row = (hidden.get(c, c) for c in (doc_id, text, file, row))
    named = named.withColumn("size", (F.octet_length(text_of(text)) + 1).cast("long")).withColumn("text_crc32", F.crc32(text_of(text)))
    rows = docs.count()
    blocks = min(MOST_BLOCKS, max(FEWEST_BLOCKS, rows // ROWS_A_BLOCK))
    named = named.withColumn("_block", F.col(f"`{file}`") if file else salted(F.col(f"`{doc_id}`"), F.col("size"), F.col("text_crc32"), parts=blocks))
    order = [F.col(f"`{c}`") for c in ([row] if row else [doc_id, "size", "text_crc32"])]
    per_block = named.groupBy("old_shard", "_block").agg(F.sum("size").alias("bytes"))
    totals = {r.old_shard: r.bytes for r in per_block.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}
    sizes = [totals.get(i, 0) for i in range(max(totals, default=-1) + 1)]
    flow = min_cost_flow(sizes, capacities or even(sum(sizes), shards))

    cuts, at = [], {}
    for (i, j), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        begin = at.get(i, 0)
        at[i] = begin + n
        cuts.append((i, begin, at[i], j))
    # at most old + new rows, whatever the corpus
    cut_table = F.broadcast(spark.createDataFrame(cuts, "_old int, _from long, _to long, shard int"))

    line = Window.partitionBy("old_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_block.select("old_shard", "_block", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("old_shard", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("_upto", F.sum("size").over(inside)).join(begins, ["old_shard", "_block"])
    middle = F.col("_begin") + F.col("_upto") - F.ceil(F.col("size") / 2)
    hit = (F.col("old_shard") == F.col("_old")) & (middle >= F.col("_from")) & (middle < F.col("_to"))
    placed = placed.drop("shard").join(cut_table, hit)

    held = placed.groupBy("shard", "old_shard", "_block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("old_shard", "_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.select("shard", "old_shard", "_block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy("old_shard", "_block", "shard").orderBy("_upto"))
    out = placed.withColumn("_rank", rank).join(ahead, ["shard", "old_shard", "_block"])
    keep = [c for c in columns if c.lower() not in ("size", "text_crc32", "old_shard", "shard", "slot", "moved")]
    return out.select(
        *(F.col(f"`{hidden.get(c, c)}`").alias(c) for c in keep), "size", "text_crc32", "old_shard", "shard",
        (F.col("_ahead") + F.col("_rank") - 1).cast("long").alias("slot"),
        (F.col("shard") != F.col("old_shard")).alias("moved"),
    )


def rewrite(old: DataFrame, shards: int, target: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rewrite the files of a layout that a move touches: the rows of the new layout, read from its files, and one row ``file, affected`` for each old file.

    ``old`` is a table read from Parquet files partitioned by a column ``shard``. Rows of
    affected files (those with a row that leaves) are written under ``target``, in folders by
    their new ``shard``, with their ``slot``. The other files stay as they are, in their shard:
    their rows' slots run on from the first one of the file.

    A file lies on its line in its own order, so each new shard takes one run of its rows: the
    plan is a line for each such piece (at most files + old + new shards of them), from which
    a row's shard and slot follow by its place in the file. Texts meet that plan in the task
    that reads them (it is broadcast up to MOST_PIECES lines, some 60 MB; beyond that Spark chooses
    the join) and are written there, so none is shuffled. The plan is written once, so that moves
    and rows agree. The driver gets one total for each old shard.
    """
    spark = old.sparkSession
    hidden = _hidden(old.columns)
    file, row = (unused([*old.columns, *hidden.values()], x) for x in ("_file", "_row"))
    doc_id, text = (hidden.get(c, c) for c in (doc_id, text))
    at = old.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)).withColumnsRenamed(hidden)
    keep = [F.col(f"`{hidden.get(c, c)}`") for c in old.columns if c.lower() not in ("shard", "slot")]
    plan = reshard(at.select(file, row, doc_id, text, "shard"), F.col("shard"), shards, doc_id, text, file=file, row=row)
    pieces = plan.groupBy(F.col(file).alias("_f"), F.col("shard").alias("_new")).agg(F.min(row).alias("_from"), F.max(row).alias("_to"), F.min("slot").alias("_ahead"), F.max("moved").alias("_r"))
    pieces = written(pieces, "pieces")
    files = pieces.groupBy("_f").agg(F.max("_r").alias("affected"))
    if pieces.count() <= MOST_PIECES:
        pieces, files = F.broadcast(pieces), F.broadcast(files)

    inside = (F.col(file) == F.col("_f")) & F.col(row).between(F.col("_from"), F.col("_to"))
    slot = (F.col("_ahead") + F.col(row) - F.col("_from")).cast("long").alias("slot")
    touched = pieces.join(files.filter("affected"), "_f", "left_semi")
    rows = at.join(touched, inside).select(*keep, F.col("_new").alias("shard"), slot)
    # rows go from a file's task to the new files of their shards, without a shuffle: a row's slot follows from its place
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(target)
    told = files.select(F.col("_f").alias("file"), "affected")

    whole = pieces.join(files.filter("not affected"), "_f", "left_semi")
    stays = at.join(whole, inside).select(*keep, F.col("_new").cast("int").alias("shard"), slot)
    new = spark.read.schema(rows.schema).parquet(target).select(*keep, F.col("shard").cast("int").alias("shard"), "slot")
    back = {v: k for k, v in hidden.items()}
    return stays.unionByName(new).withColumnsRenamed(back), told
