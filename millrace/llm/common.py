"""What the operators of this subpackage share: tables, durable cuts of lineage, column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset: on one machine (tests) a new temporary one, on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(named)
    where = spark._jvm.org.apache.hadoop.fs.Path(named)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()  # a path without a scheme means what Spark means
    return (f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no earlier stage.

    ``instead_of``: a result of this function, or made from one, that nothing needs any more;
    the table behind it is deleted. Other tables stay as long as the folder, as results are lazy.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    for old in instead_of.inputFiles() if instead_of is not None else ():
        if f"/millrace/{what}-" in old:
            delete(spark, old.rpartition("/")[0])
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, through the file system that Spark knows for it; one that is gone is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Python gets at most ``BATCH_BYTES`` at once from now on, in the whole session, as results are lazy; a lower limit stays.

    By Spark's own limit of 10,000 rows a batch of texts takes tens of MB, which the executor and each of its
    workers hold two or three times, outside the heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:  # it may say 64m
        spark.conf.set(name, BATCH_BYTES)


BITS_A_KEY, MOST_BITS = 32, 1 << 28  # of a filter; at most 32 MB are broadcast


def bit_at(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` of a bitmap made by ``bitmap_construct_agg`` is set."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8))) == 1


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose key may be in ``keys`` (one column), which all are whose key is, and rows whose key is not.

    A Bloom filter of one hash decides, so that only the first part need go through a join.
    About a row in 32 is there in vain; more of them if there are over 8 million keys, as the
    filter stays within 32 MB. A null key may be in either part.
    """
    n = keys.count()
    if not n:
        return df.filter(F.lit(False)), df
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_A_KEY * n - 1).bit_length()))
    bucket, bit, hit = (unused(df.columns, x) for x in ("bucket", "bits", "hit"))
    place = F.pmod(F.xxhash64(F.col(f"`{keys.columns[0]}`")), F.lit(bits))
    maps = keys.groupBy(F.floor(place / (1 << 15)).alias(bucket)).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15))).alias(bit))
    own = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.pmod(own, F.lit(1 << 15)).cast("int")
    marked = df.withColumn(hit, own).join(F.broadcast(maps), F.floor(F.col(hit) / (1 << 15)) == F.col(bucket), "left")
    marked = marked.withColumn(hit, F.coalesce(bit_at(F.col(bit), at), F.lit(False))).drop(bucket, bit)
    return marked.filter(F.col(hit)).drop(hit), marked.filter(~F.col(hit)).drop(hit)


def unused(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores put before it until no column of ``taken`` has it (compared without case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def blocks(texts, most: int) -> Iterator[list[str]]:
    """The texts of an Arrow array in order, in lists of at most ``most`` characters or of one text."""
    block, size = [], 0
    for text in texts:
        text = text.as_py()
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def salted(*cols: Column, parts: int) -> Column:
    """A number from 0 to parts - 1 that depends on the given columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")
