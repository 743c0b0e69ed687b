"""Session defaults and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "granary", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset a local session gets a folder; a cluster gets an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="granary-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def folder(spark: SparkSession, path: str) -> str:
    """path, made if it isn't there; an empty folder reads as no rows under a given schema."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).mkdirs(at)
    return path


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df, after the session's Arrow batches are held to `most` bytes, if they may be larger.

    Batches are held several times over, in the JVM, on the way and in Python, so 64 MB of them cost an executor
    hundreds. Spark reads the limit when the caller runs the plan, so it can't be set back here; it changes no result.
    """
    conf = df.sparkSession.conf
    now = conf.get(BATCH_BYTES).rstrip("b")
    if not now.isdigit() or int(now) > most:
        conf.set(BATCH_BYTES, str(most))
    return df
