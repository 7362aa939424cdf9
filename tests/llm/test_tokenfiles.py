"""Token files against the library on whole texts, and against the order in plain Python."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import tokenfiles
from millrace.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["", " ", "\n\n", "it's I'LL don't 'sx", "á ́a ȩ́ 각 ᄀ ᅡ", "<|endoftext|> x<|startoftext|>y < |endoftext|>", "  a　b\x1cc\x85d\x0be\x0cf", "İSTANBUL ΣΑΣ ΟΔΟΣ. ﬁ ß", "1234 5 ½ ²", "\U0001f600‍\U0001f600 ️", "x" * 3000, "\r\n a\rb\tc", "Σ ΑΣ\nΣ ΑΣ\tb"]


@pytest.mark.parametrize("text", ODD)
def test_words_are_whole_texts(library, text):
    words = tokenfiles.Words(PATH, 2)
    assert np.frombuffer(words.encode([text])[0], words.kind).tolist() == ids_of(library, text)


def test_plain_characters(library):
    """Every plain character alone, in capitals and among others, against the library."""
    plain = [chr(c) for c in range(0x180) if tokenfiles.PLAIN.fullmatch(chr(c))]
    assert len(plain) == 94 + 23 + 31 + 56 + 78
    texts = [t for c in plain for t in (c, f"a{c}b", f"'{c}{c}", f"9{c}!", f"{c}'LL{c}'s")] + ["".join(plain), "".join(reversed(plain)), " ".join(plain)]
    words = tokenfiles.Words(PATH, 2)
    assert words.by_words and words._whole(texts) == [ids[:-2] for ids in words.encode(texts)]


def test_other_rules_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, other = tokenfiles.Words(path, 7), Tokenizer.from_file(path)
    assert not words.by_words
    assert [np.frombuffer(i, words.kind).tolist() for i in words.encode(["a b  c", ""])] == [[*other.encode(t, add_special_tokens=False).ids, 7] for t in ("a b  c", "")]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r'́̇ΣsStTİ<|>")), max_size=40))
def test_words_are_whole_texts_of_any_characters(text):
    words = test_words_are_whole_texts_of_any_characters.words
    assert np.frombuffer(words.encode([text])[0], words.kind).tolist() == ids_of(words.library, text)


test_words_are_whole_texts_of_any_characters.words = tokenfiles.Words(PATH, 2)


def expected(library, rows):
    low = [(r, np.array(ids_of(library, r[1]), "<u4").tobytes()) for r in rows]
    order = sorted(low, key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    out, at = [], 0
    for (doc, _), ids in order:
        out.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def told(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.c) for r in df.withColumn("c", F.crc32("ids")).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("part_bytes", [64, 1 << 20])
def test_files_and_bases(spark, library, tmp_path, part_bytes):
    rows = [(i * 7 % 101 - 3, f"document {i} says {'word ' * (i % 9)}{i}") for i in range(101)] + [(500, None), (501, ""), (None, "no id"), (502, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "crc": F.lit("x"), "part": F.lit(2)}).repartition(7)
    manifest = tokenfiles.write_ids(df, PATH, f"file://{tmp_path}/t", 2, part_bytes=part_bytes)
    want = expected(library, rows)
    assert told(tokenfiles.read_ids(spark, f"file://{tmp_path}/t")) == want
    parts = sorted(manifest.collect(), key=lambda r: r.part)
    assert [p.base for p in parts] == np.cumsum([0, *(p.tokens for p in parts)])[:-1].tolist() and sum(p.docs for p in parts) == len(rows)
    assert len(parts) > 1 or part_bytes > 64
    assert sum(np.memmap(f, "<u2", "r").size for f in glob.glob(f"{tmp_path}/t/*.ids")) == sum(w[2] for w in want)


def test_repeated_ids_are_dealt_too(spark, library, tmp_path):
    rows = [(1, f"copy {i % 50}") for i in range(300)] + [(None, "a"), (None, "b"), (0, "x"), (2, "y")]
    tokenfiles.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, f"file://{tmp_path}/t", 2, part_bytes=256)
    got = told(tokenfiles.read_ids(spark, f"file://{tmp_path}/t"))
    assert [r[0] for r in got] == [None] * 2 + [0] + [1] * 300 + [2]
    assert sorted(map(str, ((r[0], r[2], r[3]) for r in got))) == sorted(map(str, ((r[0], r[2], r[3]) for r in expected(library, rows))))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    files = glob.glob(f"{tmp_path}/t/*.ids")
    assert sum(1 in tokenfiles.Mapped(fs.LocalFileSystem(), f.removesuffix(".ids")).names(0, 1) for f in files) > 1


def test_empty_table_and_damage(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    tokenfiles.write_ids(empty, PATH, f"file://{tmp_path}/t", 2)
    assert glob.glob(f"{tmp_path}/t/*") == [] and tokenfiles.read_ids(spark, f"file://{tmp_path}/t").count() == 0
    tokenfiles.write_ids(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), PATH, f"file://{tmp_path}/u", 2)
    with open(glob.glob(f"{tmp_path}/u/*.ids")[0], "ab") as f:
        f.write(b"xx")
    with pytest.raises(Exception, match="not as long"):
        tokenfiles.read_ids(spark, f"file://{tmp_path}/u").collect()


def test_query_over_whole_table(spark, library, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op12_tokenfiles"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(library, rows))
