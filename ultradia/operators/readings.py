"""Which rows of the readings table count.

Rows arrive late and repeated. Of the rows with equal experiment_id, fly_id, datetime and
reading_type that have a value, the one with the smallest measurement_id counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = ["experiment_id", "fly_id"]
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
US = 1_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} as timestamp_ntz))")


def from_micros(us: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {us}, {EPOCH})")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def day_stamp(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def counted_readings(readings: DataFrame, reading_types: Sequence[str] = ("MT",), block: Column | None = None) -> DataFrame:
    """One row per source, time and type: experiment_id, fly_id, datetime, reading_type, measurement_id, value, blk.

    Rows without experiment_id, fly_id, datetime or value do not count. The rows are placed by
    source and ``block`` (the calendar day unless given) in one exchange, so that whatever is later
    grouped or windowed by source and block needs no other, and a source with a third of all rows
    is spread over its days. After this a block holds at most one row for each second of a day
    (for each microsecond, where the clock is that fine) and type.

    No rows in, or only rows that do not count: no rows out.
    """
    block = F.to_date("datetime") if block is None else block
    rows = readings.select("measurement_id", *SOURCE, "datetime", "reading_type", "value").where(
        F.col("value").isNotNull()
        & F.col("reading_type").isin(*reading_types)
        & F.col("datetime").isNotNull()
        & F.col("fly_id").isNotNull()
        & F.col("experiment_id").isNotNull()
    )
    one_type = len(reading_types) == 1
    if one_type:
        rows = rows.drop("reading_type")
    rows = rows.withColumn("blk", block).repartition(*SOURCE, "blk")
    out = rows.groupBy(*SOURCE, "blk", "datetime", *([] if one_type else ["reading_type"])).agg(
        F.min_by("value", "measurement_id").alias("value"), F.min("measurement_id").alias("measurement_id")
    )
    return out.withColumn("reading_type", F.lit(reading_types[0])) if one_type else out


def usable_readings(readings: DataFrame, low: int = 0, high: int = 1000, block: Column | None = None) -> DataFrame:
    """Counted MT readings with a value from ``low`` to ``high``."""
    return counted_readings(readings, ("MT",), block).where(F.col("value").between(low, high))
