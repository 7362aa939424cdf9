"""The registered queries of this subpackage: each applies one operator to its whole table, as its contract says."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import blockknn, bpe, chat, collocations, gam, mixing, mtree, reshard, simhash, tokenfiles, tokenfst, warc, whitening
from millrace.llm.common import fresh_path, table, text_of


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    ranks, split = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.with_round_trip(docs, ranks, split).select("doc_id", "coded.ids", "coded.decoded")
    n_tokens = (F.length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth embedding among all: ``query_id, rank, vec_id, score``."""
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted in windows of 2048 tokens and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as dictionary-compressed archives and read back, a row for each page."""
    target = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), target)
    read = warc.read_archives(spark, target, payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents: ``doc_id, held_out, score, predicted``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.learn(docs, table(spark, sf_dir, "labels"))
    scored = gam.with_score(docs, model)
    return scored.select("doc_id", gam.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Token shares of the domains quality + 2 * toxic of the labels: low, high, low and toxic, high and toxic.
WEIGHTS = [0.05, 0.9, 0.0, 0.05]


def label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of domains: ``doc_id, domain``."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target shares: ``doc_id, n_tokens, posterior, rate, copies``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.learn(docs, label_domains(spark, sf_dir), len(WEIGHTS))
    scored = mixing.with_posterior(docs, model).select("doc_id", "mix")
    mixed = mixing.rated(scored, WEIGHTS)
    return mixed.select("doc_id", F.col("mix.tokens").alias("n_tokens"), F.col("mix.p").alias("posterior"), "mix.rate", "mix.copies")


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near-equal bytes, from files of five shards by source: moves the fewest bytes, and reads the new files back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    before, after = fresh_path(spark, "old-layout"), fresh_path(spark, "new-layout")
    docs.withColumn("shard", F.coalesce(F.pmod(F.crc32("source"), F.lit(5)), F.lit(0)).cast("int")).write.partitionBy("shard").parquet(before)
    old = spark.read.schema("doc_id long, text string, source string, shard int").parquet(before)
    rows, _ = reshard.rewrite(old, 8, after)
    size, crc = (F.octet_length(text_of()) + 1).cast("long"), F.crc32(text_of())
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: ``doc_id, fingerprint, component_id``."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_blockknn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all: ``query_id, rank, vec_id, score``."""
    vectors = table(spark, sf_dir, "embeddings")
    return blockknn.nearest(vectors.filter("vec_id % 20 = 0"), vectors, 20)


def op10_tokenfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: ``doc_id, n_bytes, n_tokens, over_limit``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokenfst.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.octet_length(text_of()).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on their 16 largest components: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    return whitening.by_component(whitening.with_whitened(vectors, model), model)


def op12_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as flat files in the order of doc_id, and read back: ``doc_id, start, n_tokens, ids_crc32``."""
    target = fresh_path(spark, "tokens")
    tokenfiles.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), target, 2)
    return tokenfiles.read_ids(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose words go together most: ``lang, rank, phrase, a, l, r, n, score``."""
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {"op6_mixing": op6_mixing, "op4_warc": op4_warc, "op3_chat": op3_chat, "op2_mtree": op2_mtree, "op9_blockknn": op9_blockknn, "op5_gam": op5_gam, "op7_reshard": op7_reshard, "op10_tokenfst": op10_tokenfst, "op1_bpe": op1_bpe, "op8_simhash": op8_simhash, "op11_whitening": op11_whitening, "op12_tokenfiles": op12_tokenfiles, "op13_collocations": op13_collocations}
ORACLES: dict[str, str] = {
    "op4_warc": """
        with p as (
            select page_id, coalesce(html, '') as html from pages
        ), largest as (
            select html, max(page_id) as top from p where strlen(html) >= 1000 group by html
        )
        select page_id, strlen(p.html)::bigint as payload_bytes, sha1(p.html) as payload_digest,
               case when top is null or top = page_id then 'response' else 'revisit' end as record_type,
               case when top != page_id then top end as refers_to
        from p left join largest using (html)
    """,
    "op2_mtree": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id % 100 = 0 and q.vec_id != c.vec_id
        ), ranked as (
            select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from scored
        )
        select * from ranked where rank <= 10
    """,
    "op9_blockknn": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: x::double) as e
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
            from v q join v c on q.vec_id % 20 = 0 and q.vec_id != c.vec_id
        ), ranked as (
            select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from scored
        )
        select * from ranked where rank <= 20
    """,
    "op13_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
        ), lines as (
            select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x != '') as w from pieces
        ), sizes as (
            select lang, sum(len(w))::bigint as n from lines group by lang
        ), spans as (
            select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from lines, range(1, 5) as t(k) where len(w) >= k
        ), f as (
            select lang, k, phrase, count(*) as f from spans group by all having count(*) >= 30
        ), kept as (
            select c.* from f c where c.k > 1 and not exists (
                select 1 from f q where q.lang = c.lang and q.k > c.k and 100 * q.f >= 80 * c.f and contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))
        ), cuts as (
            select lang, phrase, f as a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from kept
        ), scored as (
            select c.lang, c.phrase, c.a, c.cut, p.f as l, q.f as r, (2000000::hugeint * c.a // (p.f + q.f))::bigint as score
            from cuts c join f p on p.lang = c.lang and p.phrase = array_to_string(w[1:cut], ' ') join f q on q.lang = c.lang and q.phrase = array_to_string(w[cut + 1:], ' ')
        ), lowest as (
            select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
        ), ranked as (
            select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from lowest
        )
        select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
    """,
}
