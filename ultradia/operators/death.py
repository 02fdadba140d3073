"""Death times, windows anchored to them, sliding windows of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.readings import SOURCE
from ultradia.operators.runs import numbered_runs, quiet_gaps, run_lengths
from ultradia.params import DEFAULT, Params


def long_zero_starts(minutes: DataFrame, rows: int) -> DataFrame:
    """experiment_id, fly_id, death_datetime: the first run of at least ``rows`` zero rows of the whole series.

    Rows of a source meet, but as runs: within a day first, then a source's days' runs in order.
    """
    daily = run_lengths(minutes, [*SOURCE, "blk"], ["minute"], F.col("value") == 0)
    by_time = Window.partitionBy(*SOURCE).orderBy("start")
    joined = daily.withColumn("_new", F.when(F.lag("flag").over(by_time) == F.col("flag"), 0).otherwise(1))
    chains = joined.withColumn("_chain", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chains.where("flag").groupBy(*SOURCE, "_chain").agg(F.min("start").alias("start"), F.sum("length").alias("n"))
    return whole.where(F.col("n") >= rows).groupBy(*SOURCE).agg(F.min("start").alias("death_datetime"))


def dense_deaths(minutes: DataFrame, experiments: DataFrame, hours: int) -> DataFrame:
    """experiment_id, fly_id, death_datetime: the first ``hours`` without activity on the dense minute grid from the first reading to the experiment's end."""
    last = F.expr("timestampadd(MINUTE, -1, cast(date_add(end_date, 1) as timestamp_ntz))")
    ends = minutes.groupBy(*SOURCE).agg(F.min("minute").alias("data_start")).join(experiments.select("experiment_id", last.alias("data_end")).dropDuplicates(["experiment_id"]), "experiment_id")
    return quiet_gaps(minutes.where("value > 0"), ends.where("data_end >= data_start"), "minute", hours)


def death_periods(minutes: DataFrame, least_min: int = 1440) -> DataFrame:
    """Runs of zero rows that last at least ``least_min`` minutes by the clock: source, start, end, minutes."""
    runs = run_lengths(minutes, SOURCE, ["minute"], F.col("value") == 0).where("flag")
    length = F.expr("timestampdiff(MINUTE, start, end)") + 1
    return runs.withColumn("minutes", length).where(F.col("minutes") >= least_min).select(*SOURCE, "start", "end", "minutes")


def backward_windows(minutes: DataFrame, deaths: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Sleep features of windows of ``window_hours`` counted back from death: source, ttd (hours from window end to death), start, the nine measures.

    A window is dense: minutes without a row are inactive. The earliest window of a source is kept only with at
    least ``min_data_hours`` of data. A window's bucket follows from the distance to death, so this is a
    plain equi-group; only the active minutes of a window are sorted, the sleep between them is
    the difference of neighbours.
    """
    w_min = params.window_hours * 60
    span = deaths.join(minutes.groupBy(*SOURCE).agg(F.min("minute").alias("data_start")), SOURCE)
    total = F.expr("timestampdiff(MINUTE, data_start, death_datetime)")
    windows = span.withColumn("_m", total).where("_m > 0").withColumn("k", F.explode(F.expr(f"sequence(1L, cast(ceil(_m / {float(w_min)}) as bigint))")))
    covered = F.least(F.lit(w_min), F.col("_m") - (F.col("k") - 1) * w_min)
    windows = windows.withColumn("n", covered).where(F.col("n") >= params.min_data_hours * 60)
    windows = windows.select(*SOURCE, "k", F.col("n").cast("long").alias("n"), F.expr(f"timestampadd(MINUTE, cast(greatest(0, _m - k * {w_min}) as int), data_start)").alias("window_start"))
    back = F.expr("timestampdiff(MINUTE, minute, death_datetime)")
    active = minutes.where("value > 0").join(deaths, SOURCE).withColumn("_b", back).where("_b > 0").select(*SOURCE, F.expr(f"(_b - 1) div {w_min} + 1").alias("k"), "minute")
    points = (
        active.join(windows, [*SOURCE, "k"])
        .select(*SOURCE, "k", F.expr("timestampdiff(MINUTE, window_start, minute)").alias("at"))
        .unionByName(windows.select(*SOURCE, "k", F.lit(-1).cast("long").alias("at")))
        .unionByName(windows.select(*SOURCE, "k", F.col("n").alias("at")))
    )
    w = Window.partitionBy(*SOURCE, "k").orderBy("at")
    gaps = points.withColumn("gap", F.col("at") - F.lag("at").over(w) - 1)
    least = params.sleep_threshold_min
    slept = F.when(F.col("gap") >= least, F.col("gap"))
    per = gaps.groupBy(*SOURCE, "k").agg(
        F.sum(slept).alias("slept"),
        F.count(slept).alias("bouts"),
        F.max(slept).alias("longest"),
        F.max("at").alias("n"),
        F.max(F.when((F.col("gap") >= least) & (F.col("at") == F.col("gap")), 1).otherwise(0)).alias("starts_asleep"),
        F.max_by("gap", "at").alias("last_gap"),
    )
    joined = per.join(windows.select(*SOURCE, "k", "window_start"), [*SOURCE, "k"])
    b = float(params.bin_length_min)
    n = F.col("n").cast("double")
    s = F.coalesce(F.col("slept"), F.lit(0)).cast("double")
    bouts = F.col("bouts").cast("double")
    ends_asleep = F.when(F.col("last_gap") >= least, 1).otherwise(0)
    wake_bouts = F.when(s >= n, 0).otherwise(F.col("bouts") + 1 - F.col("starts_asleep") - ends_asleep)
    return joined.select(
        *SOURCE,
        ((F.col("k") - 1) * params.window_hours).cast("int").alias("ttd"),
        "window_start",
        (s * b).alias("total_sleep_min"),
        F.col("bouts").cast("int").alias("n_sleep_bouts"),
        F.when(bouts > 0, F.try_divide(s * b, bouts)).otherwise(0.0).alias("mean_bout_min"),
        (F.coalesce(F.col("longest"), F.lit(0)) * b).cast("double").alias("longest_bout_min"),
        (bouts / (n * b / 60)).alias("bouts_per_hour"),
        F.when(bouts > 0, F.try_divide(bouts - 1, bouts)).otherwise(0.0).alias("interruption_rate"),
        F.when(wake_bouts > 0, F.try_divide((n - s) * b, wake_bouts.cast("double"))).otherwise(0.0).alias("mean_wake_bout_min"),
        ((n - s) / n).alias("p_wake"),
        (s / n).alias("p_doze"),
    )


def sliding_days(timed: DataFrame, labels: DataFrame, least_rows: int = 60) -> DataFrame:
    """Windows of a day that end at lights on: source, day (of the end), n, mean, variance, longest_zero_h, sleep_min, status, days_until_death.

    A row belongs to the window that ends at the next lights on, so a shifted date replaces a range join. ``labels``:
    source, exp_day, status (daily). Windows with fewer than ``least_rows`` rows are left out.
    """
    day = F.expr("date_add(cast(timestampadd(HOUR, -lights_on, minute) as date), 1)")
    rows = timed.withColumn("day", day)
    keys = [*SOURCE, "day"]
    zero = numbered_runs(rows, keys, ["minute"], F.col("value") == 0)
    per_run = zero.groupBy(*keys, "run", "_flag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.sum(F.col("value").cast("double") * F.col("value")).alias("q"), F.max(F.datediff("day", "blk") + F.col("exp_day")).alias("window_day")
    )
    z = F.when(F.col("_flag"), F.col("n"))
    total = F.sum("n")
    mean = F.sum("v") / total
    windows = per_run.groupBy(*keys).agg(
        F.max("window_day").alias("exp_day"),
        total.alias("n"),
        mean.alias("mean"),
        (F.sum("q") / total - mean * mean).alias("variance"),
        (F.coalesce(F.max(z), F.lit(0)) / 60.0).alias("longest_zero_h"),
        F.coalesce(F.sum(F.when(z >= 5, z)), F.lit(0)).alias("sleep_min"),
    )
    deaths = labels.where("status = 'Dead'").groupBy(*SOURCE).agg(F.min("exp_day").alias("dead_day"))
    return (
        windows.where(F.col("n") >= least_rows)
        .join(labels.select(*SOURCE, "exp_day", "status"), [*SOURCE, "exp_day"], "left")
        .join(deaths, SOURCE, "left")
        .withColumn("days_until_death", F.col("dead_day") - F.col("exp_day"))
        .drop("dead_day")
    )
