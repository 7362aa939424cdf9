"""Chat formatting in budgeted windows.

A conversation becomes windows of at most ``budget`` tokens. Prefix sums of the turns' tokens
choose which turns are new in which window: those that begin within one stride of half of what
the system turn leaves of the budget. Each later window repeats the system turn and as many of the turns before it as fit,
up to a limit, as context without loss; so every turn is new once, and every assistant text
is a target once.

Each turn reads ``### role: text</turn>`` and a line end. Within texts the control strings and
the backslash get a backslash before them (in roles the colon too), which ``parse`` undoes.

A very long conversation is never one group: turns are dealt by range over (conversation,
turn), prefix sums are made within ranges and carried over by range totals, and windows are
bounded by the budget. All of that works on rows of a few numbers; texts stay where they are
until it is known which windows want them, and move twice: to their places, and into windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.tokenfst import with_token_counts

OPEN, CLOSE, AFTER_ROLE = "### ", "</turn>\n", ": "
_TOKEN = re.compile(r"\\(\\|###|</turn>|:)|(</turn>\n)")
_HEAD = re.compile(r"### ((?:\\[\\:#<]|[^\\:])*): ")


def _escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>" + ("|:" if role else "") + ")", r"\\$1")


def unescape(text: str) -> str:
    """The text before escaping."""
    return _TOKEN.sub(lambda m: m.group(1) or m.group(2), text)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns, at = [], 0
    while at < len(window):
        head = _HEAD.match(window, at)
        begin = head.end()
        end = next(m.start() for m in _TOKEN.finditer(window, begin) if m.group(2))
        turns.append((unescape(head.group(1)), unescape(window[begin:end])))
        at = end + len(CLOSE)
    return turns


def format_windows(turns: DataFrame, tokenizer: str, budget: int = 2048, history: int = 4) -> DataFrame:
    """Columns ``conv_id, window, text, loss, context, new, n_tokens`` from rows ``conv_id, turn, role, text``.

    ``loss``: array of (begin, end), code points of ``text``: the assistant texts among the
    ``new`` turns; ``context``: how many turns before them are repeated (the system turn, if
    the conversation begins with one, then at most ``history`` turns that still fit).
    ``n_tokens``: sum of the turns' own token counts, over ``budget`` only where one turn alone
    is longer than the stride (a system turn of over half the budget isn't repeated). Turns go
    by ``turn`` (nulls first), then by the first 32 characters of the role, the first 64 of the
    text, and a hash of both; null roles and texts are empty; a null conv_id is a conversation;
    repeated rows are turns of their own. Extra columns are dropped; no rows give no windows.
    """
    clean = turns.select(
        F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body")
    )
    shown = clean.withColumns({"head": F.concat(F.lit(OPEN), _escaped(F.col("role"), True), F.lit(AFTER_ROLE)), "escaped": _escaped(F.col("body"))})
    shown = shown.withColumn("piece", F.concat("head", "escaped", F.lit(CLOSE)))
    numbers = {"head_chars": F.length("head"), "body_chars": F.length("escaped"), "chars": F.length("piece"), "is_system": F.col("role") == "system", "is_target": F.col("role") == "assistant"}
    order = {"r": F.substring("role", 1, 32), "b": F.substring("body", 1, 64), "h": F.xxhash64("role", "body")}
    counted = with_token_counts(shown, tokenizer, "piece", "tokens").withColumns(numbers | order)
    keys = ["conv", "t", *order, "row"]
    held = written(counted.select(*keys, "tokens", *numbers, "piece"), "turns")

    # prefix sums: within a range, and the totals of the ranges before
    narrow = held.drop("piece").repartitionByRange(*keys).withColumn("range", F.spark_partition_id())
    dealt = written(narrow, "dealt")  # the ranges stay what they are
    totals = dealt.groupBy("conv", "range").agg(F.sum("tokens").alias("n"), F.count("*").alias("c"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("conv").alias("k"), F.col("range").alias("q"), *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in "nc"))
    within = Window.partitionBy("conv", "range").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({"n1": F.coalesce(F.sum("tokens").over(within), F.lit(0)), "c1": F.count("*").over(within)})
    placed = local.join(carried, F.col("conv").eqNullSafe(F.col("k")) & (F.col("range") == F.col("q")))
    placed = written(placed.select("row", "conv", (F.col("c0") + F.col("c1")).alias("at"), (F.col("n0") + F.col("n1")).alias("begins"), "tokens", *numbers), "placed")

    # one number a conversation that begins with a system turn: what its repetition takes off the budget
    repeated = (F.col("at") == 0) & F.col("is_system") & (F.col("tokens") <= budget // 2)
    system = placed.filter(repeated).select(F.col("conv").alias("k"), F.col("tokens").alias("fixed"))
    placed = placed.join(system, F.col("conv").eqNullSafe(F.col("k")), "left").drop("k").withColumn("fixed", F.coalesce("fixed", F.lit(0)))
    stride = F.greatest(F.lit(1), F.floor((budget - F.col("fixed")) / 2))
    placed = written(placed.withColumn("bucket", F.floor(F.col("begins") / stride)), "placed")

    spans = placed.groupBy("conv", "bucket").agg(F.min("at").alias("first"))
    near = [F.sequence(F.greatest(F.col("first") - history, F.lit(0)), F.col("first") - 1)] if history else []
    wanted = spans.filter("first > 0").select(
        F.col("conv").alias("k"), F.col("bucket").alias("w"), "first",
        F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), *near))).alias("need"),
    )
    again = wanted.join(placed, F.col("k").eqNullSafe(F.col("conv")) & (F.col("need") == F.col("at")))
    again = again.filter(repeated | (F.col("at") >= F.col("first") - history)).withColumns({"kind": F.when(repeated, 0).otherwise(1), "bucket": F.col("w")})
    members = placed.withColumn("kind", F.lit(2)).unionByName(again.drop("k", "w", "first", "need"))

    whole = Window.partitionBy("conv", "bucket")
    nearest = whole.orderBy(F.desc("kind"), F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.when(F.col("kind") == 0, F.col("tokens"))).over(whole)
    used = F.coalesce(own, F.lit(0)) + F.sum(F.when(F.col("kind") > 0, F.col("tokens")).otherwise(0)).over(nearest)
    # history is taken from the nearest turn back, as long as the sum stays within the budget
    kept = members.withColumn("used", used).filter((F.col("kind") != 1) | (F.col("used") <= budget))
    upto = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("chars").over(upto), F.lit(0)) + F.col("head_chars")
    target = (F.col("kind") == 2) & F.col("is_target")
    kept = kept.withColumn("span", F.when(target, F.struct(begin.alias("begin"), (begin + F.col("body_chars")).alias("end"))))
    kept = kept.select("row", "conv", "bucket", "at", "kind", "tokens", "span").join(held.select(F.col("row").alias("of"), "piece"), F.col("row") == F.col("of"))
    return kept.groupBy("conv", "bucket").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("text"),
        F.array_sort(F.collect_list("span")).alias("loss"),
        F.count_if(F.col("kind") < 2).alias("context"),
        F.count_if(F.col("kind") == 2).alias("new"),
        F.sum("tokens").alias("n_tokens"),
    ).withColumnsRenamed({"conv": "conv_id", "bucket": "window"})


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, read from formatted windows alone.

    ``n_turns``; ``turns_sha256`` over role, line end, text, line end of each turn;
    ``loss_chars`` and ``loss_sha256`` of the unescaped text under the loss spans;
    ``formatted_chars``. Windows stream through in order; a digest holds no text, so a very
    long conversation needs no more memory than a window.
    """

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for frame in frames for r in frame.itertuples(index=False))
        for _, own in groupby(rows, key=lambda r: None if pd.isna(r.conv_id) else int(r.conv_id)):
            conv, turns, loss, n_turns, loss_chars, chars = None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for r in own:
                conv = r.conv_id
                for role, text in parse(r.text)[r.context :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                for span in r.loss:
                    target = unescape(r.text[span["begin"] : span["end"]])
                    loss.update(target.encode())
                    loss_chars += len(target)
                chars += len(r.text)
            yield pd.DataFrame({"conv_id": pd.array([None if pd.isna(conv) else int(conv)], "Int64"), "n_turns": [n_turns], "turns_sha256": [turns.hexdigest()], "loss_chars": [loss_chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [chars]})

    ordered = windows.select("conv_id", "window", "text", "loss", "context").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
