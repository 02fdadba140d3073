"""Raw monitor files: tab-separated, without header, ten fixed columns and 32 channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ultradia.functions import timecols as T

#: The fixed columns of a monitor file and its reading types.
FIXED = ("id", "date", "time", "port", "unknown1", "unknown2", "unknown3", "movement_type", "zero1", "zero2")
TYPES = ("MT", "CT", "Pn")
CHANNELS = 32
SCHEMA = StructType(
    [StructField(c, LongType() if c == "id" else StringType()) for c in FIXED] + [StructField(f"ch{i}", IntegerType()) for i in range(1, CHANNELS + 1)]
)


def read_monitors(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path or glob, with ``monitor`` from the file name. Fields that are no number are null; missing ones too."""
    raw = spark.read.csv(path, sep="\t", schema=SCHEMA, mode="PERMISSIVE")
    return raw.withColumn("monitor", T.monitor_of_file(F.col("_metadata.file_name")))


def long_readings(raw: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """monitor, channel, fly_id, datetime, reading, value.

    Per line id, time and channel the first value of each type, 0 if it has none; where all are 0, no
    rows. The 32 channels become rows first, then one aggregate has all types side by side, so the
    file is passed once. Times that do not parse and other types are left out.
    """
    at = F.to_timestamp_ntz(F.concat_ws(" ", "date", "time"), F.lit("d MMM yy HH:mm:ss"))
    good = F.concat_ws(" ", "date", "time").rlike(r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.col(f"ch{i}").alias("v")) for i in range(1, CHANNELS + 1)]))
    rows = raw.where(F.col("movement_type").isin(*types) & good).select("monitor", "id", at.alias("datetime"), "movement_type", cells.alias("x"))
    wide = rows.groupBy("monitor", "id", "datetime", F.col("x.channel").alias("channel")).agg(
        *[F.coalesce(F.first(F.when(F.col("movement_type") == t, F.col("x.v")), ignorenulls=True), F.lit(0)).alias(t) for t in types]
    )
    active = wide.where(" or ".join(f"{t} != 0" for t in types))
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("reading"), F.col(t).alias("value")) for t in types]))
    return active.select("monitor", "channel", T.fly_id(F.col("monitor"), F.col("channel")).alias("fly_id"), "datetime", pairs.alias("y")).select(
        "monitor", "channel", "fly_id", "datetime", "y.reading", "y.value"
    )


def lines_between(spark: SparkSession, path: str, load_date: str, days: int, offset_days: int = 1, hour: int = 9) -> DataFrame:
    """The raw text lines from ``hour`` of the day ``offset_days`` after the load date (MM/DD/YY) on, for so many days; lines without a time are left out."""
    text = spark.read.text(path)
    parts = F.split("value", "\t")
    at = F.try_to_timestamp(F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))), F.lit("d MMM yy HH:mm:ss"))
    start = F.timestamp_add("HOUR", F.lit(24 * offset_days + hour), F.to_timestamp(F.lit(load_date), "MM/dd/yy"))
    return text.where((at >= start) & (at < F.timestamp_add("DAY", F.lit(days), start)))
