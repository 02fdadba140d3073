"""Metadata files separated by white space: four fixed fields, the rest is the treatment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ultradia.functions import timecols as T


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """monitor, channel, fly_id, genotype, sex, treatment; headers, lines of fewer than four fields and empty channels are left out."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).where((F.size("w") >= 4) & (F.lower(F.col("w")[0]) != "monitor"))
    cols = rows.select(
        F.regexp_replace(F.col("w")[0], "^(?i)monitor", "").alias("monitor"),
        F.expr("try_cast(regexp_extract(lower(w[1]), '^(?:ch)?([0-9]+)$', 1) as int)").alias("channel"),
        F.col("w")[2].alias("genotype"),
        F.col("w")[3].alias("sex"),
        F.array_join(F.slice("w", 5, F.greatest(F.size("w") - 4, F.lit(0))), " ").alias("treatment"),
    )
    good = cols.where(T.is_ok(F.col("genotype")) & F.col("channel").isNotNull())
    return good.select("monitor", "channel", T.fly_id(F.col("monitor"), F.col("channel")).alias("fly_id"), "genotype", "sex", "treatment")
