"""Text functions and payload contracts."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import payloads, text
from millrace.operators import listing
from millrace.sources.tables import json_lines


def values(spark, function, rows, schema="c string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r.v for r in df.select(function(F.col("c")).alias("v")).collect()]


def test_urls(spark):
    good = ["https://h.example/p", "ssh://git@h.example/p", "git@h.example:team/p.git", "https://h.example:8443/p", "HTTPS://h.example/p"]
    bad = ["http://h.example/p", "file:///p", "https://user@h.example/p", "ssh://git:pw@h.example/p", "https://h.example", "", "no url", "https:///p"]
    assert values(spark, text.is_git_url, good) == [True] * len(good)
    assert values(spark, text.is_git_url, bad) == [False] * len(bad)


def test_paths(spark):
    assert values(spark, text.relative_path, ["a\\b\\C.java", "/a", "a/../b", "C:x", "a/b", "..a/b"]) == ["a/b/C.java", None, None, None, "a/b", "..a/b"]
    assert values(spark, text.is_absolute_path, ["/a/b", "a", "/", "/a/../b", "/a/."]) == [True, False, False, False, False]


def test_patterns_and_trimming(spark):
    assert values(spark, text.is_cwe, ["CWE-89", "CWE-89\n", "cwe-89", "CWE-"]) == [True, False, False, False]
    assert values(spark, text.is_sha256, ["a" * 64, "a" * 64 + "\n", "A" * 64, "a" * 63]) == [True, False, False, False]
    assert values(spark, text.trimmed, ["  x y \n", "x"]) == ["x y", "x"]
    assert values(spark, text.blank, [" \t", None, "a"]) == [True, True, False]
    assert values(spark, lambda c: text.preview(c, 5), ["  a \n b ", "abcdef g", "abcde"]) == ["a b", "abcde...", "abcde"]


def test_templates_sets_and_numbers(spark):
    df = spark.createDataFrame([("{a} {b}", "{b}!", "z", ["x", "y", "x"], {"k": "1", "m": ""}, {"k": "2"}, '{"b": 1, "a": 2}')], "t string, a string, b string, l array<string>, e map<string,string>, f map<string,string>, j string")
    row = df.select(
        text.filled(F.col("t"), {"a": F.col("a"), "b": F.col("b")}).alias("filled"), text.missing_placeholders(F.col("t"), ["a", "c"]).alias("missing"),
        text.has_repeats(F.col("l")).alias("repeats"), text.unsupported(F.col("l"), ["y"]).alias("unknown"), text.merged(F.col("e"), F.col("f")).alias("merged"),
        text.missing_values(F.col("e"), ["k", "m", "n"]).alias("absent"), text.has_exact_keys(F.col("j"), ["a", "b"]).alias("exact"), text.extra_keys(F.col("j"), ["a"]).alias("extra"),
    ).first()
    assert tuple(row) == ("z! z", ["c"], True, ["x", "x"][:1], {"k": "2", "m": ""}, ["m", "n"], True, ["b"])
    assert values(spark, text.positive_int, ["3", "0", "-1", "x", "1.5"])[:4] == [3, None, None, None]
    assert values(spark, text.seconds, ["1.5", "-1", "x", "NaN"]) == [1.5, None, None, None]
    assert [v is not None for v in values(spark, text.probability, ["0.3", "1", "1.01", "x"])] == [True, True, False, False]
    assert values(spark, text.http_ok, [200, 299, 300, None], "c int") == [True, True, False, False]
    out = spark.createDataFrame([(False, False, 124), (True, True, 137), (False, True, 0), (False, False, None)], "c boolean, f boolean, x int")
    assert [r.v for r in out.select(text.timed_out(F.col("c"), F.col("f"), F.col("x")).alias("v")).collect()] == [True, False, True, False]


def test_source_fields(spark):
    rows = [("git", None, None, None), ("git", "ftp://x/y", None, None), ("git", "https://h/p", None, "main"), ("zip", "https://h/p", None, None), ("zip", None, "c", None), ("zip", None, None, "b"), ("zip", None, None, None)]
    df = spark.createDataFrame(rows, "t string, u string, c string, b string")
    got = [r.v for r in df.select(text.source_error(F.col("t"), F.col("u"), F.col("c"), F.col("b")).alias("v")).collect()]
    assert [g is None for g in got] == [False, False, True, False, False, False, True]


def test_assistant_text(spark):
    df = spark.createDataFrame([([("text", "a"), ("tool", "b"), ("text", ""), ("text", "c ")], "raw"), ([("tool", "b")], "raw"), (None, "raw")], "m array<struct<type:string,text:string>>, s string")
    assert [r.v for r in df.select(text.assistant_text(F.col("m"), F.col("s")).alias("v")).collect()] == ["a\nc", "raw", "raw"]


def test_json_lines_skip_what_is_no_object(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("nope",), ("[1]",), ("3",), (" {} ",), (None,)], "value string")
    assert json_lines(df).count() == 2


OBJECTS = [
    ('{"a": 1}', {"a": 1}), ('Sure:\n```json\n{"a": 1}\n```', {"a": 1}), ("only prose", None), ('{"outer": {"inner": 2}', {"inner": 2}), ('[1, {"b": 2}]', {"b": 2}),
    ('{"a": 1} {"b": 2}', {"a": 1}), ("{broken} then {\"c\": 3}", {"c": 3}), ("", None), ("[1, 2]", None), ("{" * 50, None),
]


@pytest.mark.parametrize("noisy, expected", OBJECTS)
def test_first_object(noisy, expected):
    assert payloads.first_object(noisy) == expected


INTENT = {"from": ["a"], "description": "d"}
REASONS = [
    ({"accepted": False}, True, ("rejected", None)), ({"accepted": True, "data": {"complete": INTENT}}, True, ("complete", INTENT)), ({"complete": INTENT}, True, ("complete", INTENT)),
    ({"intents": [INTENT] * 5}, True, ("intents", [INTENT] * 3)), ({"intent": INTENT}, False, ("intents", [INTENT])), ({"intents": []}, False, ("noop", None)), ({"intents": []}, True, None),
    ({"accepted": True, "data": {}}, False, ("noop", None)), ({"accepted": True, "data": {}}, True, None), ({"accepted": True, "data": 3}, True, None), ({"accepted": "yes"}, True, None),
    ({"accepted": True, "data": {"complete": INTENT, "intents": []}}, True, None), ({"intents": [{"from": []}]}, True, None), ({"complete": {"from": []}}, True, None), ({"intents": [INTENT], "x": 1}, True, None),
]


@pytest.mark.parametrize("payload, empty, expected", REASONS)
def test_reason_contract(payload, empty, expected):
    kind, data, code = payloads.verdict(payload, "reason", empty, 3)
    assert (kind == "error" and code) if expected is None else (kind, data, code) == (*expected, None)


def test_other_contracts():
    d, verdict = {"description": " x "}, payloads.verdict
    assert verdict({"fact": d, "complete": d}, "bootstrap") == ("complete", {"fact_description": "x", "complete_description": "x"}, None)
    assert verdict({"fact": d, "complete": {}}, "bootstrap_conclusion") == ("fact", "x", None)
    assert verdict({"description": " x"}, "exploration") == ("fact", "x", None)
    assert verdict({"accepted": True, "data": {"description": "x", "more": 1}}, "exploration") == ("fact", "x", None)
    for contract in ("bootstrap", "bootstrap_conclusion", "exploration", "reason"):
        assert verdict({"accepted": False}, contract) == ("rejected", None, None)
    for contract, bad, code in (
        ("bootstrap", {"fact": d}, "accepted:missing"), ("bootstrap", {"fact": d, "complete": {}}, "complete.description:text"), ("bootstrap", {"accepted": True, "data": {"fact": d}}, "complete:object"),
        ("bootstrap_conclusion", {"accepted": True, "data": {"fact": d, "x": 1}}, "x:unexpected"), ("bootstrap_conclusion", {"fact": {"description": " "}}, "fact.description:text"),
        ("exploration", {"description": "x", "y": 1}, "accepted:missing"), ("exploration", {"description": 3}, "description:text"), ("exploration", None, "object:missing"),
    ):
        assert verdict(bad, contract) == ("error", None, code)


def test_contract_column(spark):
    df = spark.createDataFrame([('x {"description": "found"}', False), ("none", False), (None, True), ('{"accepted": false}', None)], "t string, e boolean")
    assert [tuple(r.v) for r in df.select(payloads.checked(F.col("t"), "exploration", F.col("e")).alias("v")).collect()] == [("fact", '"found"', None), ("error", None, "object:missing"), ("error", None, "object:missing"), ("rejected", None, None)]
    assert [r.v for r in df.select(payloads.extracted(F.col("t")).alias("v")).collect()] == ['{"description": "found"}', None, None, '{"accepted": false}']


def test_case_folding_of_every_character(spark):
    names = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    names += ["Straße", "STRASSE", "ΛΌΓΟΣ", "λόγος", "İstanbul", "ǰ\ufb03ŉ", "", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    wrong = [r.name for r in df.withColumn("folded", text.case_folded(F.col("name"))).collect() if r.folded != (None if r.name is None else r.name.casefold())]
    assert wrong == []
    assert {r.name for r in listing.same_name(df, "name", "strasse").collect()} == {"Straße", "STRASSE"}
    assert {r.name for r in listing.same_name(df, "name", F.lit("λόγοΣ")).collect()} == {"ΛΌΓΟΣ", "λόγος"}
