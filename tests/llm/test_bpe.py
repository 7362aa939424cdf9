"""BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.queries import op1_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
PATTERNS = bpe.splitters(P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "a", "Hello  world's\n\n\tdon't'll", "éèç 漢字🙂🙂‍ ÄÖÜ ß 1234 ---", "x" * 3000, "ab" * 2000 + "  \n ", "<|endoftext|> s", "\x00\x1f�", "'s's'S", "aaaa" * 33]


def test_rank_queue_is_a_priority_queue():
    queue, rng = bpe.RankQueue(5000), random.Random(1)
    entries = [(rng.randrange(5000), rng.randrange(100)) for _ in range(2000)]
    for rank, position in entries:
        queue.push(rank, np.array([position], np.int32))
    popped = []
    while bucket := queue.pop():
        popped += [(bucket[0], position) for position in bucket[1].tolist()]
    assert popped == sorted(set(entries))


def test_codec_matches_the_library():
    codec, rng = bpe.Codec(RANKS, PATTERNS), random.Random(2)
    tokens = [t for t in RANKS if len(t) < 9]
    more = [b"".join(rng.choice(tokens) for _ in range(40)).decode(errors="ignore") for _ in range(300)]
    for text, packed in zip(TEXTS + more, codec.encode(TEXTS + more), strict=True):
        ids = LIBRARY.encode_ordinary(text)
        assert list(memoryview(packed).cast("I")) == ids if packed else not ids
        assert codec.decode(packed) == text.encode()


def test_every_character_splits_as_in_the_library():
    codec = bpe.Codec(RANKS, PATTERNS)
    for i in [*range(0x3500), *range(0xA000, 0xD800, 17), *range(0xE000, 0x110000, 97), 0x11DE0]:
        text = f"b{chr(i)}b1{chr(i)}1?{chr(i)}?"
        assert memoryview(codec.encode([text])[0]).cast("I").tolist() == LIBRARY.encode_ordinary(text), hex(i)


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    codec = bpe.Codec(RANKS, PATTERNS)
    text = " ".join(f"w{i}q" for i in range(50))
    for part in (text, "w1q w2q", text):
        assert codec.decode(codec.encode([part])[0]) == part.encode()
    assert len(codec.memory) <= 60


def test_columns_nulls_repeats_and_extra_columns(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (3, TEXTS[3], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids string").withColumn("n_tokens", F.lit("clash"))
    out = bpe.with_bytes(bpe.with_ids(docs, PATH, P.PATTERN), PATH, P.PATTERN).withColumn("list", bpe.unpacked())
    assert sorted(out.columns) == sorted([*docs.columns, "list"])  # columns of the output's names are replaced
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.list == LIBRARY.encode_ordinary(r.text or "")
    both = bpe.with_round_trip(docs, PATH, P.PATTERN, out="n_tokens").select("text", "n_tokens.*", F.col("n_tokens.ids").alias("again"))
    assert both.count() == len(rows)
    for r in both.collect():
        assert bytes(r.decoded) == (r.text or "").encode() and memoryview(bytes(r.ids)).cast("I").tolist() == LIBRARY.encode_ordinary(r.text or "")
    assert bpe.with_ids(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_pairs_of_lower_rank_that_come_up_late():
    """Ranks that no training would give: merging makes pairs that should have come before."""
    rng = random.Random(8)
    for _ in range(300):
        words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(25)}
        order = [bytes([i]) for i in range(256)] + sorted(words, key=lambda _: rng.random())
        ranks = {t: i for i, t in enumerate(order)}
        library = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
        codec = bpe.Codec(ranks, bpe.splitters(r"\w+"))
        assert [memoryview(p).cast("I").tolist() for p in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_texts_in_portions_and_long_pieces(monkeypatch):
    rng = random.Random(5)
    words = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(3000)) + "a" * 5000 + "ab" * 3000
    monkeypatch.setattr(bpe, "BLOCK", 1000), monkeypatch.setattr(bpe, "PORTION", 100), monkeypatch.setattr(bpe, "SLICE", 500)
    codec = bpe.Codec(RANKS, PATTERNS)
    assert memoryview(codec.encode([words])[0]).cast("I").tolist() == LIBRARY.encode_ordinary(words)


def test_unknown_ids_are_an_error():
    with pytest.raises(IndexError):
        bpe.Decoder(RANKS).decode((10**6).to_bytes(4, "little"))
    with pytest.raises(TypeError):
        bpe.Decoder({b"a": 0, b"b": 2}).decode((1).to_bytes(4, "little"))


def test_query_over_a_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pieces_of_a_block_take_little_memory():
    """The traced peak of encoding 3 M characters, besides the texts and ids themselves."""
    import tracemalloc

    codec, texts = bpe.Codec(RANKS, PATTERNS), ["some words of a text that come again and again " * 60] * 1100
    tracemalloc.start()
    for block in bpe.blocks(pa.array(texts), bpe.BLOCK):
        codec.encode(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
