"""Token counts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from millrace.llm import tokenfst
from millrace.llm.queries import op10_tokenfst

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "a", "Hello  world's\n\n\tdon't'll", "éèç 漢字🙂🙂‍ ÄÖÜ ß 1234 ---", "x" * 3000, "ab" * 2000 + "  \n ", "<|endoftext|> s<|endoftext|><|endoftext|> ", "\x00\x1f\x1c\x85　�", "'s's'S ''re 'x 've", "aaaa" * 333, " \n", "  a", "\n\na", "a \n"]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tokenfst.Counter(tokenfst.read_model(PATH), tokenfst.classes())


def test_every_character_has_the_librarys_class(counter):
    texts = [f"a{chr(i)}1{chr(i)}-{chr(i)}" for i in range(1, 0x110000, 7) if not 0xD800 <= i < 0xE000]
    every = [chr(i) for i in range(0x3500) if not 0xD800 <= i < 0xE000]
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for text in every:
        sample = f"b{text}b1{text}1?{text}?"
        expected = [a for _, (a, _) in split.pre_tokenize_str(sample)]
        points = np.frombuffer((sample + "\n").encode("utf-32-le"), np.uint32)
        kinds = tokenfst.classes()[points]
        kinds[-1] = tokenfst.END
        assert np.flatnonzero(tokenfst.piece_starts(points, kinds))[:-1].tolist() == expected, hex(ord(text))
    wrong = [t for t, a, b in zip(texts, counter.count(texts), library(texts), strict=True) if a != b]
    assert not wrong


def test_counts_match_the_library(counter):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrst'' \n\t,.!12éß漢🙂ETAOIN"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(1500)]
    tokens = [t for t in counter.machine.tokens if 0 < len(t) < 12]
    made += [b"".join(rng.choice(tokens) for _ in range(60)).decode(errors="ignore") for _ in range(600)]
    assert counter.count(TEXTS + made).tolist() == library(TEXTS + made)


def test_pieces_longer_than_chunks_and_forgetting(counter, monkeypatch):
    rng = random.Random(6)
    long = ["".join(rng.choice("aeiourstln") for _ in range(n)) for n in (511, 512, 513, 2000, 20000)]
    long += ["a" * 5000, "ab" * 3000, "the" * 2001, "=" * 4000]
    monkeypatch.setattr(tokenfst, "MOST_STATES", 10)
    monkeypatch.setattr(tokenfst, "STREAM", 3000)
    assert counter.count(long).tolist() == library(long)


def test_scan_composes_maps():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, states = int(rng.integers(1, 40)), 3
        entry, leave = rng.integers(0, states, n), rng.integers(0, states, n)
        constant = rng.random(n) < 0.3
        constant[0] = True
        expected, now = [], -1
        for i in range(n):
            now = leave[i] if constant[i] or now == entry[i] else -1
            expected.append(now)
        assert tokenfst._compose(entry.copy(), leave.copy(), constant.copy()).tolist() == expected


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    out = tokenfst.with_token_counts(docs, PATH).collect()
    assert [r.n_tokens for r in out] == library([r.text or "" for r in out])
    assert tokenfst.with_token_counts(docs.limit(0), PATH).count() == 0


def test_query_over_a_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_tokenfst(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r, n in zip(rows, library([texts[r.doc_id] for r in rows]), strict=True):
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_long_texts_in_windows(counter, monkeypatch):
    """Windows may cut anywhere: within words, contractions, white space, characters of several bytes."""
    rng = random.Random(9)
    letters = "abcdefgh'' \n\t,.12éß漢🙂stmdrelv"
    texts = ["".join(rng.choice(letters) for _ in range(400)) for _ in range(40)] + ["a" * 900, "we're they'll don't " * 40, " " * 300, "x <|endoftext|> y" * 60]
    for width in (37, 64, 129):
        monkeypatch.setattr(tokenfst, "STREAM", width)
        assert counter.count(texts).tolist() == library(texts)
    monkeypatch.setattr(tokenfst, "MOST_STATES", 20)  # the state goes on where states are forgotten between windows
    assert counter.count(texts).tolist() == library(texts)


def test_a_column_of_the_outputs_name_is_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, n_tokens string")
    assert [tuple(r) for r in tokenfst.with_token_counts(docs, PATH).collect()] == [(1, "a b", 2)]


def test_a_step_of_all_lanes_is_looked_up_once(monkeypatch):
    """New transitions are made for the lanes that lack them; the others aren't looked up again."""
    machine = tokenfst.Transducer([bytes([b]) for b in range(256)] + [b"ab", b"abc"], [(97, 98), (256, 99)], [256, 257])
    calls, whole = [], tokenfst.Transducer.advance
    monkeypatch.setattr(tokenfst.Transducer, "advance", lambda self, *a: calls.append(1) or whole(self, *a))
    text = b"abcab xyz cab " * 300
    stream = tokenfst.np.frombuffer(text, tokenfst.np.uint8)
    gains, _ = machine.weights(stream, stream == 32)
    assert len(calls) == tokenfst.CHUNK + tokenfst.RUN_UP
    assert int(gains.sum()) == 300 * (len([b"abc", b"ab", b" ", b"x", b"y", b"z", b" ", b"c", b"ab", b" "]))
