"""Phrases against brute force over all spans, and the automaton against end positions of every substring."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import collocations
from millrace.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connection

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most, depth=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            inside = (q for q in good if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * good[q] >= 80 * a for q in inside):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, left, right, score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n[lang], score))
    return sorted(out)


def some_rows(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "New", "york", "É", "é", "city", "of", "x\x1cy", "b-c", "日本", "ab"]
    def text():
        return "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b"]) for _ in range(r.randrange(60)))
    fixed = ["new york city of light. " * 3, "as well as well as well", "new york", ""]
    return [(r.choice(["en", "en", "en", "de", None, "und"]), r.choice([text(), text(), r.choice(fixed)])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "least", "shard_bytes"), [(1, 3, 200), (2, 6, 5000), (3, 2, 64)])
def test_against_brute_force(spark, seed, least, shard_bytes):
    rows = [*some_rows(seed, 120), ("en", None), ("fr", None), ("fr", "one two three four five"), ("en", "no breaks at all " * 40)]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as a", "'x' as phrase", "0 as h").repartition(5)
    got = sorted(map(tuple, collocations.mine(df, least, 50, shard_bytes=shard_bytes).collect()))
    assert got == brute(rows, least, 50) and got


def test_hashes_are_spark_s(spark):
    df = spark.createDataFrame([("en", "alpha beta É. " * 3), (None, "a much longer word-of-over-thirty-two-bytes-in-all x")], "lang string, text string")
    same = collocations.shards(df, "lang", "text").selectExpr("inline(transform(arrays_zip(words, h), x -> struct(xxhash64(lang, x.words) = x.h as same)))")
    assert same.count() == 8 and same.filter("not same").count() == 0


def test_empty_and_rare(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).count() == 0
    rare = collocations.mine(spark.createDataFrame([("en", "a b c d"), ("en", "...")], "lang string, text string"))
    assert rare.count() == 0 and rare.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**15, 9 * 10**15 + 5, 9 * 10**15 + 7)], "a long, l long, r long")
    got = df.select(collocations.score(df.a, df.l, df.r).alias("s")).first().s
    assert got == 2_000_000 * 9 * 10**15 // (18 * 10**15 + 12)


@pytest.mark.parametrize("seed", range(6))
def test_automaton(seed):
    """Nodes are the substrings, counts those of their end positions, links their longest proper suffixes."""
    r = np.random.default_rng(seed)
    ids = r.integers(1, 4, 60).astype(np.int32)
    joined = r.random(59) > 0.15
    machine = collocations.Automaton(ids, joined, 4)
    names = pa.array(["a", "b", "c"])
    ends = defaultdict(set)
    for i in range(len(ids)):
        for k in range(1, 5):
            if i + k <= len(ids) and all(joined[i : i + k - 1]):
                ends[" ".join(names[int(x) - 1].as_py() for x in ids[i : i + k])].add(i + k)
    texts = {1: [names[int(x) - 1].as_py() for x in machine.last[1]]}
    for k, phrases, counts in machine.phrases(names):
        texts[k] = phrases.to_pylist()
        assert dict(zip(texts[k], counts.tolist(), strict=True)) == {p: len(e) for p, e in ends.items() if p.count(" ") == k - 1}
        assert [texts[k - 1][i] for i in machine.link[k]] == [p.partition(" ")[2] for p in texts[k]]
        assert machine.states()[k].tolist() == [ends[p] == ends[p.partition(" ")[2]] for p in texts[k]]


def test_long_texts_are_cut_where_pieces_end():
    data = b"aa bb, cc dd ee ff gg hh; ii" * 3
    parts = list(collocations._cut(data, 10))
    assert b"".join(parts) == data and all(p[-1:] in b",;" for p in parts[:-1]) and len(parts) > 3
    assert list(collocations._cut(b"x " * 50, 10)) == [b"x " * 50, b""]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(spark, connection(sf), "op13_collocations", QUERIES["op13_collocations"], ORACLES["op13_collocations"], sf)


def test_only_what_may_be_frequent_is_listed_as_text(spark, monkeypatch):
    """Phrases of frequent pairs that aren't frequent themselves go by packed hashes alone."""
    r = random.Random(4)
    rows = [("en", " ".join(r.choice("abcdefghij") for _ in range(30))) for _ in range(40)]
    listed, made = [], collocations._phrases
    monkeypatch.setattr(collocations, "_phrases", lambda *a: listed.append(made(*a[:5], 1, a[6])) or made(*a))  # all that are listed
    monkeypatch.setattr(collocations, "delete", lambda *_: None)
    monkeypatch.setattr(collocations, "HELD_KEYS", 50)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.mine(df, 5, 100, shard_bytes=300).collect())) == brute(rows, 5, 100)
    texts = Counter(r.phrase for r in listed[0].collect())
    counts = Counter(" ".join(w[i : i + k]) for _, t in rows for w in [t.split()] for k in (2, 3, 4) for i in range(len(w) - k + 1))
    frequent = {p for p, a in counts.items() if a >= 5}
    assert frequent <= set(texts) and len(texts) < 1.1 * len(frequent) and len(frequent) < 0.5 * len(counts)


def test_packed_numbers():
    values = np.array([0, 1, 255, 2**31, 2**32 - 1])
    assert collocations._unpack(collocations._pack(values), len(values)).tolist() == values.tolist()
