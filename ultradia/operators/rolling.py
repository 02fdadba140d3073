"""Totals over trailing periods of days by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_grid(daily: DataFrame, keys: Sequence[str], day: str, value: str, until: str) -> DataFrame:
    """One row per key and day from the key's first day to its ``until``: keys, day, first_day, total, observed.

    ``daily`` has at most one row per key and day. Missing days get total 0 and observed false, a
    null value counts as 0; days after ``until`` are left out, as are rows with a null key, day or
    ``until``. The missing days are put in after each present one, so no join is needed. A key has
    as many rows as days.
    """
    w = Window.partitionBy(*keys).orderBy("_day")
    present = (
        daily.select(*keys, F.col(day).cast("date").alias("_day"), F.col(value).alias("_value"), F.col(until).cast("date").alias("_until"))
        .dropna(subset=[*keys, "_day", "_until"])
        .where(F.col("_day") <= F.col("_until"))
        .withColumn("first_day", F.min("_day").over(w))
        .withColumn("_next", F.coalesce(F.lead("_day").over(w), F.date_add("_until", 1)))
    )
    return (
        present.withColumn("day", F.explode(F.sequence("_day", F.date_sub("_next", 1))))
        .withColumn("observed", F.col("day") == F.col("_day"))
        .withColumn("total", F.when(F.col("observed"), F.coalesce("_value", F.lit(0))).otherwise(F.lit(0)))
        .select(*keys, "day", "first_day", "total", "observed")
    )


def trailing_sums(grid: DataFrame, keys: Sequence[str], periods: Sequence[int], day: str = "day", value: str = "total") -> DataFrame:
    """Adds ``total_<n>`` and ``mean_<n>`` for each period of n days ending on the row's day.

    Sums of 1, 2, 4, 8, ... days are doubled from one another; a period is put together from the
    blocks of its binary digits, each shifted behind the one before (30 = 16 + 8 + 4 + 2). So a
    period costs a few additions a row, whatever its length, and all shifts share one sort. Days
    before the key's first day count as 0; the mean is over the whole period. The grid must have
    every day of a key once. Integer values give exact sums.
    """
    w = Window.partitionBy(*keys).orderBy(day)

    def shifted(c: str, by: int) -> Column:
        return F.col(c) if by == 0 else F.lag(c, by, 0).over(w)

    df, size = grid.withColumn("_s1", F.col(value)), 1
    while size * 2 <= max(periods):
        df = df.withColumn(f"_s{2 * size}", F.col(f"_s{size}") + shifted(f"_s{size}", size))
        size *= 2
    for n in periods:
        if n < 1:
            raise ValueError("a period has at least one day")
        behind, total = 0, None
        for bit in reversed(range(n.bit_length())):
            if n >> bit & 1:
                part = shifted(f"_s{1 << bit}", behind)
                total = part if total is None else total + part
                behind += 1 << bit
        df = df.withColumn(f"total_{n}", total)
    for n in periods:
        df = df.withColumn(f"mean_{n}", F.col(f"total_{n}") / F.lit(float(n)))
    return df.drop(*[c for c in df.columns if c.startswith("_s") and c[2:].isdigit()])
