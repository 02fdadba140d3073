"""The series the analytics start from: counted readings with their time columns; and the fly dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ultradia.functions import timecols as T
from ultradia.operators.hotdeck import strain_of
from ultradia.operators.readings import SOURCE, counted_readings

DAY = [*SOURCE, "blk"]


def fly_dim(flies: DataFrame, strains: DataFrame) -> DataFrame:
    """One row per fly_id: monitor, channel, genotype (strain code or null), sex (Female, Male or null), treatment."""
    first = F.upper(F.substring(F.trim("sex"), 1, 1))
    sex = F.when(first == "F", "Female").when(first == "M", "Male")
    known = strain_of(flies, strains).withColumn("_sex", sex)
    return known.where(F.col("fly_id").isNotNull()).groupBy("fly_id").agg(
        F.min("monitor").alias("monitor"),
        F.min("channel").alias("channel"),
        F.min("strain").alias("genotype"),
        F.min("_sex").alias("sex"),
        F.min(F.trim("treatment")).alias("treatment"),
    )


def timed_readings(readings: DataFrame, experiments: DataFrame, types: Sequence[str] = ("MT",), low: int | None = 0, high: int | None = 1000) -> DataFrame:
    """Counted readings from ``low`` to ``high`` with blk (the day), zt, phase, exp_day, lights_on, lights_off.

    Rows of experiments that are not listed are left out. One exchange places the rows by source and day; the
    experiments are a few rows that Spark sends along.
    """
    rows = counted_readings(readings, types)
    if low is not None:
        rows = rows.where(F.col("value").between(low, high))
    known = experiments.select(
        "experiment_id", "start_date", "end_date", F.col("lights_on_hour").alias("lights_on"), F.col("lights_off_hour").alias("lights_off")
    ).dropDuplicates(["experiment_id"])
    timed = rows.join(known, "experiment_id")
    ts, on = F.col("datetime"), F.col("lights_on")
    return timed.withColumns({"zt": T.zt(ts, on), "phase": T.phase(ts, on), "exp_day": T.exp_day(F.col("blk"), F.col("start_date"))})


def minute_series(timed: DataFrame) -> DataFrame:
    """Sums by minute: source, blk, exp_day, minute (timestamp), zt, phase, lights_on, lights_off, value. Minutes without readings have no row."""
    minute = F.expr("timestampadd(SECOND, -second(datetime), datetime)")
    return timed.groupBy(*DAY, "exp_day", "zt", "phase", "lights_on", "lights_off", minute.alias("minute")).agg(F.sum("value").alias("value"))


def dense_minutes(minutes: DataFrame) -> DataFrame:
    """The minute series with a row of value 0 for every minute between two of a day that has none.

    The missing minutes follow each present one, so nothing is joined and the rows stay where they are.
    """
    w = Window.partitionBy(*DAY).orderBy("minute")
    until = F.coalesce(F.expr("timestampadd(MINUTE, -1, _next)"), F.col("minute"))
    rows = minutes.withColumn("_next", F.lead("minute").over(w)).withColumn("_at", F.explode(F.sequence("minute", until, F.expr("interval 1 minute"))))
    value = F.when(F.col("_at") == F.col("minute"), F.col("value")).otherwise(F.lit(0))
    at, on = F.col("_at"), F.col("lights_on")
    return rows.select(*DAY, "exp_day", "lights_on", "lights_off", at.alias("minute"), T.zt(at, on).alias("zt"), T.phase(at, on).alias("phase"), value.alias("value"))


def with_flies(df: DataFrame, flies: DataFrame) -> DataFrame:
    """Adds the fly dimension; rows of flies that are not registered keep nulls."""
    return df.join(flies, "fly_id", "left")
