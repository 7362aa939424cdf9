"""A folder for tables that a query writes and reads again: the one that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that what is built on it several times is computed once."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
