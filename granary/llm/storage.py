"""The shared folder in which lineage is cut, and the size of what is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import in_batches, shared_dir

__all__ = ["cut", "in_batches", "remove", "shared_dir", "sized", "stored", "tidy", "volume"]


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and stored in the shared folder; it survives the loss of executors.

    Spark removes such files when they are no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written as a table of the shared folder, and where: smaller than a checkpoint, to be removed once used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return rows, size or 0


def sized(df: DataFrame, rows: int, text_bytes: int = 0, each_rows: int = 20_000, each_bytes: int = 16 << 20) -> DataFrame:
    """df in so many partitions at most that each has about `each_rows` of its rows or `each_bytes` of its texts."""
    return df.coalesce(max(1, -(-rows // each_rows), -(-text_bytes // each_bytes)))


def tidy(spark: SparkSession) -> None:
    """Has the driver look for what is no longer used, so that executors drop broadcasts, shuffles and, if Spark is set to, checkpoints.

    Spark does so itself every spark.cleaner.periodicGC.interval, which is 30 minutes; operators of many steps leave
    more than that between.
    """
    spark.sparkContext._jvm.System.gc()
