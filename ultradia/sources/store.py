"""Tables on disk: appends of what is new, upserts by key, replacement and removal by experiment."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ultradia.session import remove_path, written


def latest_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``; ties by the row's hash."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*df.columns))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def new_rows(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored (null keys never match); one row per key."""
    return batch.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def upserted(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows without those the batch has, and the batch."""
    return stored.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch, allowMissingColumns=True)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table in place of the one it may have been read from: beside it first, then put there by renaming; until then the old one stays."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh, old = (f"{path}.{k}-{uuid.uuid4().hex}" for k in ("new", "old"))
    df.write.parquet(fresh)
    a, b, c = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, old))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(a) and not fs.rename(a, c):
        raise OSError(f"cannot move {path}")
    if not fs.rename(b, a):
        fs.rename(c, a)
        raise OSError(f"cannot put {fresh} in place")
    remove_path(spark, old)


def replace_experiments(df: DataFrame, path: str) -> None:
    """Write a table partitioned by experiment; only the experiments in ``df`` are replaced."""
    df.repartition("experiment_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment_id").parquet(path)


def without_flies(table: DataFrame, removed: DataFrame) -> DataFrame:
    """A table without the sources in ``removed`` (experiment_id, fly_id)."""
    return table.join(removed.select("experiment_id", "fly_id").distinct(), ["experiment_id", "fly_id"], "left_anti")


#: Tables that hold rows of an experiment, children first: the order in which its rows go.
CASCADE = ("features_z", "features", "health_reports", "readings", "flies", "experiments")


def without_experiments(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A table without the experiments in ``gone`` (experiment_id); rows without an experiment stay."""
    return table.join(gone.select("experiment_id").distinct(), "experiment_id", "left_anti")


def delete_experiments(spark: SparkSession, root: str, ids: Sequence[int] | None = None) -> dict[str, int]:
    """Remove the experiments with these ids (all, if none are given) from every table of CASCADE under ``root``; rows removed per table.

    Children go first, so a deletion that dies leaves the experiment listed and can be given again. Tables that are absent are left out.
    """
    listed = read_table(spark, root, "experiments").select("experiment_id")
    gone = listed if ids is None else listed.where(F.col("experiment_id").isin(list(ids)))
    gone = written(gone.distinct(), "gone")
    removed = {}
    for name in CASCADE:
        path = f"{root.rstrip('/')}/{name}.parquet"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            continue
        table = spark.read.parquet(path)
        n = table.join(gone, "experiment_id", "left_semi").count()
        if n:
            replace_table(without_experiments(table, gone), path)
        removed[name] = n
    return removed


def experiment_info(spark: SparkSession, root: str, names: Sequence[str] = CASCADE) -> DataFrame:
    """experiment_id, table_name, n for every experiment that a table has rows of."""
    parts = [read_table(spark, root, n).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).select("experiment_id", F.lit(n).alias("table_name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_id(table: DataFrame, column: str) -> int:
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def latest_experiment(experiments: DataFrame) -> int | None:
    """The experiment created last; none for an empty table."""
    row = experiments.agg(F.max_by("experiment_id", F.struct("created_at", "experiment_id"))).first()
    return row[0]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Rows that are in one of two tables only, numbers rounded, with ``side``; no rows if they agree."""
    def rounded(df: DataFrame) -> DataFrame:
        return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)])

    x, y = rounded(a), rounded(b)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right"))).orderBy(*keys, "side")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")
