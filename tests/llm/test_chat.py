"""Chat windows: exact round trips, budgets, and masks."""

import hashlib
from collections import defaultdict

import public_tokenizers as P
from pyspark.sql import functions as F

from millrace.llm import chat
from millrace.llm.queries import op3_chat

MODEL = P.path("byte_bpe_50k.json")
NASTY = ["", "\\", "\\\\", "### x: </turn>\n", "a</turn", "<", "####", "\\### Assistant: </turn> ok", "</turn>\n### assistant: no", "é漢🙂 :\\:", "</turn></turn>\n\\"]


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))


def test_round_trip_of_nasty_texts_nulls_ties_and_long_conversations(spark):
    rows = [(i, j, role, text) for i, text in enumerate(NASTY) for j, role in enumerate(["system", "user", "assistant", "a:\\b###"])]
    rows += [(100, j, "assistant" if j % 2 else "user", NASTY[j % len(NASTY)] + " word" * (j % 9)) for j in range(700)]
    rows += [(None, 0, "user", "a"), (None, None, None, None), (101, 1, "assistant", "tie"), (101, 1, "assistant", "tie"), (101, 1, "assistant", "a"), (102, 0, "user", "z" * 50_000)]
    windows = chat.format_windows(frame(spark, rows), MODEL, budget=64, history=3)
    assert got(chat.read_back(windows)) == expected(rows)
    assert windows.filter("conv_id = 100").count() > 50
    assert chat.read_back(chat.format_windows(frame(spark, rows[:0] or rows).limit(0), MODEL)).count() == 0


def test_budget_system_history_and_mask(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, j, "assistant" if j % 2 == 0 else "user", f"turn {j} " + "w " * 8) for j in range(1, 60)]
    out = chat.format_windows(frame(spark, rows), MODEL, budget=120, history=2).orderBy("window").collect()
    assert len(out) > 3
    seen = []
    for n, r in enumerate(out):
        turns = chat.parse(r.text)
        assert r.n_tokens <= 120
        assert turns[0] == ("system", "be kind")
        assert r.context == 0 if n == 0 else 1 <= r.context <= 3
        assert len(turns) == r.context + r.new
        if n:  # history is the turns just before the new ones
            assert turns[1 : r.context] == seen[len(seen) - r.context + 1 :]
        seen += turns[r.context :]
        assert [r.text[s.begin : s.end] for s in r.loss] == [t for role, t in turns[r.context :] if role == "assistant"]
    assert [t for _, t in seen] == [t for *_, t in rows]


def test_query_over_a_whole_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    out = op3_chat(spark, sf_dir)
    assert got(out) == expected(rows)
    assert all(r.formatted_chars > r.loss_chars for r in out.collect())


def test_windows_keep_the_budget_beside_a_system_turn(spark):
    """Turns just under the stride, and a system turn that every window repeats."""
    one = "word " * 90  # some hundred tokens with its marks
    rows = [(1, 0, "system", one)] + [(1, i, "user" if i % 2 else "assistant", one) for i in range(1, 12)] + [(2, i, "user", one) for i in range(7)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_windows(turns, MODEL, budget=310).collect()
    assert max(r.n_tokens for r in out) <= 310 and sum(r.new for r in out) == len(rows)
    assert all(chat.parse(r.text)[0][0] == "system" for r in out if r.conv_id == 1)
    long = spark.createDataFrame([(1, 0, "system", one), (1, 1, "user", one), (1, 2, "assistant", "x")], "conv_id long, turn long, role string, text string")
    out = chat.format_windows(long, MODEL, budget=150, history=0).orderBy("window").collect()
    assert [r.context for r in out] == [0] * len(out)  # a system turn of over half the budget isn't repeated


def test_no_text_is_a_key_of_ranges(spark):
    turns = spark.createDataFrame([(1, None, "user", "x" * 5000)] * 20, "conv_id long, turn long, role string, text string")
    (row,) = chat.read_back(chat.format_windows(turns, MODEL)).collect()
    assert row.n_turns == 20
