"""Sleep architecture of a source's day from runs of inactive rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.prepared import DAY
from ultradia.operators.runs import numbered_runs
from ultradia.params import DEFAULT, Params

DAILY = [
    "total_sleep", "day_sleep", "night_sleep", "total_bouts", "day_bouts", "night_bouts", "mean_bout", "max_bout", "mean_day_bout", "max_day_bout", "mean_night_bout", "max_night_bout",
    "frag_bouts_per_hour", "frag_bouts_per_min_sleep", "mean_wake_bout", "p_wake", "p_doze", "sleep_latency", "waso",
]


def asleep_rows(minutes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The rows with ``asleep``: in a run of inactive rows of at least the threshold; runs start anew each day."""
    numbered = numbered_runs(minutes, DAY, ["minute"], F.col("value") == 0)
    n = F.count(F.lit(1)).over(Window.partitionBy(*DAY, "run"))
    return numbered.withColumn("asleep", F.col("_flag") & (n * params.bin_length_min >= params.sleep_threshold_min)).drop("run", "_flag")


def daily_sleep(minutes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The 19 measures of DAILY per source and day, minutes where they are times.

    A bout belongs to the phase of its first row; the latency counts the dark rows of the calendar
    day before the first asleep one, and waso the awake dark rows from there on, in order of time (so
    the count begins at midnight). Undefined measures are null.
    """
    b = float(params.bin_length_min)
    w = Window.partitionBy(*DAY).orderBy("minute")
    rows = asleep_rows(minutes, params).withColumn("is_day", F.col("zt") < 12)
    before = F.lag("asleep").over(w)
    dark = ~F.col("is_day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "_before": before,
            "_start": F.col("asleep") & ~F.coalesce(before, F.lit(False)),
            "_wake_start": ~F.col("asleep") & F.coalesce(before, F.lit(True)),
            "_dark_slept": F.max((dark & F.col("asleep")).cast("int")).over(upto),
        }
    )
    rows = rows.withColumn("_bout", F.sum(F.col("_start").cast("int")).over(upto)).withColumn("_bout", F.when(F.col("asleep"), F.col("_bout")))
    parts = rows.groupBy(*DAY, "exp_day", "_bout").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("_start"), F.col("is_day").cast("int"))).alias("day_bout"),
        F.sum(F.when(F.col("asleep") & F.col("is_day"), 1).otherwise(0)).alias("day_n"),
        F.sum(F.when(F.col("_before") & ~F.col("asleep"), 1).otherwise(0)).alias("to_wake"),
        F.sum(F.when(~F.col("_before") & F.col("asleep"), 1).otherwise(0)).alias("to_sleep"),
        F.sum(F.when(F.col("_wake_start"), 1).otherwise(0)).alias("wake_bouts"),
        F.sum(F.when(dark & (F.col("_dark_slept") == 0), 1).otherwise(0)).alias("latent"),
        F.sum(F.when(dark & (F.col("_dark_slept") == 1) & ~F.col("asleep"), 1).otherwise(0)).alias("awake_after"),
        F.max("_dark_slept").alias("dark_slept"),
    )
    bout = F.col("_bout").isNotNull()
    n = F.col("n").cast("double")

    def over(kind: Column | None, f) -> Column:
        cond = bout if kind is None else bout & kind
        return f(F.when(cond, n * b))

    day, night = F.col("day_bout") == 1, F.col("day_bout") == 0
    total, slept, bouts = F.sum(n), F.sum(F.when(bout, n)), F.sum(F.when(bout, 1).otherwise(0))
    awake = F.sum(F.when(~bout, n))
    dark_slept = F.max("dark_slept") == 1
    zero = F.lit(0.0)
    return parts.groupBy(*DAY, "exp_day").agg(
        (F.coalesce(slept, zero) * b).alias("total_sleep"),
        (F.sum("day_n") * b).alias("day_sleep"),
        (F.coalesce(slept, zero) * b - F.sum("day_n") * b).alias("night_sleep"),
        bouts.alias("total_bouts"),
        F.sum(F.when(bout & day, 1).otherwise(0)).alias("day_bouts"),
        F.sum(F.when(bout & night, 1).otherwise(0)).alias("night_bouts"),
        over(None, F.avg).alias("mean_bout"),
        over(None, F.max).alias("max_bout"),
        over(day, F.avg).alias("mean_day_bout"),
        over(day, F.max).alias("max_day_bout"),
        over(night, F.avg).alias("mean_night_bout"),
        over(night, F.max).alias("max_night_bout"),
        (bouts / (total * b / 60)).alias("frag_bouts_per_hour"),
        F.try_divide(bouts.cast("double"), slept * b).alias("frag_bouts_per_min_sleep"),
        F.try_divide(awake * b, F.sum("wake_bouts").cast("double")).alias("mean_wake_bout"),
        F.try_divide(F.sum("to_wake").cast("double"), slept).alias("p_wake"),
        F.try_divide(F.sum("to_sleep").cast("double"), awake).alias("p_doze"),
        F.when(dark_slept, F.sum("latent") * b).alias("sleep_latency"),
        F.when(dark_slept, F.sum("awake_after") * b).alias("waso"),
    )


def legacy_daily_sleep(minutes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The older measures: a bout belongs to its most frequent phase, latency is the first bout's ZT in minutes, efficiency the dark share of 720."""
    w = Window.partitionBy(*DAY).orderBy("minute")
    rows = asleep_rows(minutes, params)
    start = F.col("asleep") & ~F.coalesce(F.lag("asleep").over(w), F.lit(False))
    rows = rows.withColumn("_bout", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bouts = rows.where("asleep").groupBy(*DAY, "exp_day", "_bout").agg(F.count(F.lit(1)).alias("n"), F.mode("phase", True).alias("phase"), F.min_by("zt", "minute").alias("zt"))
    dark = F.sum(F.when(F.col("phase") == "Dark", F.col("n")).otherwise(0)) * params.bin_length_min
    total = F.sum("n") * params.bin_length_min
    return bouts.groupBy(*DAY, "exp_day").agg(
        total.alias("total_sleep"),
        F.count(F.lit(1)).alias("bouts"),
        (F.min("zt") * 60).alias("latency"),
        (dark / F.lit(720.0)).alias("efficiency"),
        (total - dark).alias("waso"),
    )


def per_source_means(daily: DataFrame, excluded: tuple[int, ...] = DEFAULT.excluded_days) -> DataFrame:
    """Means over the days that are not excluded, named <measure>_mean, and n_days."""
    kept = daily.where(~F.col("exp_day").isin(list(excluded)))
    return kept.groupBy("experiment_id", "fly_id").agg(*[F.avg(c).alias(f"{c}_mean") for c in DAILY], F.count(F.lit(1)).alias("n_days"))
