"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, name: str = "skein", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where none is set and all runs on this machine. Elsewhere it must be set: every executor has disks of its own."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get(CHECKPOINT_DIR, None) or sc.getConf().get(CHECKPOINT_DIR)
    if not named and not (sc.master or "").startswith("local["):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, so that later steps survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As `cut`, by columns and compressed: a fraction of a checkpoint's disk. The files go when the session's JVM ends, or by `dropped`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    return spark.read.schema(df.schema).parquet(path)


def dropped(*kept_ones: DataFrame) -> None:
    """Removes the files of what `kept` gave, once nothing reads them any more."""
    for df in kept_ones:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, at = _files(df.sparkSession, path)
            fs.delete(at, True)


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
