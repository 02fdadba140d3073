"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the bench use it."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("ultradia")
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is absent (tests, a notebook) is a new temporary folder used, and then
    set as the checkpoint folder of this session.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="ultradia-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder; never used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Writes like ``written`` and deletes its tables together once nothing reads them any more.

    Spark frees the broadcasts and shuffles of finished tables only when the driver collects garbage, which
    loops of many small jobs may put off until its memory is full; so it is asked to after every few tables.
    """

    EVERY = 8

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = scratch_path(spark, name)
        df.write.parquet(path)
        self.paths.append((spark, path))
        if len(self.paths) % self.EVERY == 0:
            spark._jvm.System.gc()
        return spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for spark, path in self.paths:
            remove_path(spark, path)
        self.paths = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
