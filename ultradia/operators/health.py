"""Daily health: metrics, startle response, reference day, status, irreversible death, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.prepared import DAY
from ultradia.operators.readings import SOURCE
from ultradia.operators.runs import numbered_runs
from ultradia.params import DEFAULT, Params

#: Thresholds of the status rules that are not parameters of the series.
ACTIVITY_LOW = 50
INDEX_LOW = 0.02
SLEEP_MAX = 1300
SLEEP_BOUT = 720


def daily_metrics(minutes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per source and day: total_activity, activity_index (share of rows above 0), longest_zero, total_sleep (both minutes), transition_counts.

    Runs count rows of the sparse series. transition_counts sums the rows within the window around
    lights on and lights off. All from one pass over rows placed by source and day.
    """
    hour = F.hour("minute") + F.minute("minute") / F.lit(60.0)
    edge = F.lit(params.transition_window_min / 60)
    near = (F.abs(hour - F.col("lights_on")) <= edge) | (F.abs(hour - F.col("lights_off")) <= edge)
    runs = (
        numbered_runs(minutes, DAY, ["minute"], F.col("value") == 0)
        .groupBy(*DAY, "exp_day", "run", "_flag")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.sum((F.col("value") > 0).cast("int")).alias("active"), F.sum(F.when(near, F.col("value")).otherwise(0)).alias("t"))
    )
    zero = F.when(F.col("_flag"), F.col("n"))
    bin_min = params.bin_length_min
    return runs.groupBy(*DAY, "exp_day").agg(
        F.sum("v").alias("total_activity"),
        (F.sum("active") / F.sum("n")).alias("activity_index"),
        (F.coalesce(F.max(zero), F.lit(0)) * bin_min).alias("longest_zero"),
        (F.coalesce(F.sum(F.when(zero >= params.sleep_threshold_min, zero)), F.lit(0)) * bin_min).alias("total_sleep"),
        F.sum("t").alias("transition_counts"),
    )


def missing_share(readings: DataFrame) -> DataFrame:
    """Per source and day the share of MT rows without a value: blk, missing_fraction."""
    rows = readings.where((F.col("reading_type") == "MT") & F.col("datetime").isNotNull())
    return rows.groupBy(*SOURCE, F.to_date("datetime").alias("blk")).agg(F.avg(F.col("value").isNull().cast("int")).alias("missing_fraction"))


def with_reference_day(daily: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds ref_activity, rel_activity (null without reference or with a reference of 0) and decline_status."""
    w = Window.partitionBy(*SOURCE)
    ref = F.max(F.when(F.col("exp_day") == params.ref_day, F.col("total_activity"))).over(w)
    rel = F.try_divide(F.col("total_activity").cast("double"), F.col("ref_activity").cast("double"))
    decline = (
        F.when(F.col("ref_activity").isNull(), "No Reference")
        .when(F.col("rel_activity") < params.death_threshold, "Dead (by decline)")
        .when(F.col("rel_activity") < params.decline_threshold, "Unhealthy (by decline)")
        .otherwise("Stable")
    )
    return daily.withColumn("ref_activity", ref).withColumn("rel_activity", rel).withColumn("decline_status", decline)


def status_of(params: Params = DEFAULT, decline: bool = False) -> Column:
    """The decision list over the columns of ``daily_metrics``, missing_fraction and decline_status.

    ``decline`` also lets the decline rules decide, as the file-based variant does.
    """
    no_startle = F.col("transition_counts") == 0
    low = (F.col("total_activity") <= ACTIVITY_LOW) | (F.col("activity_index") <= INDEX_LOW)
    sleepy = (F.col("total_sleep") >= SLEEP_MAX) | (F.col("longest_zero") >= SLEEP_BOUT)
    rules = F.when(F.col("longest_zero") >= 1440 / params.bin_length_min, "Dead").when((F.col("longest_zero") >= 720 / params.bin_length_min) & no_startle, "Dead")
    if decline:
        rules = rules.when(F.col("decline_status") == "Dead (by decline)", "Dead")
    rules = rules.when((low | sleepy) & no_startle, "Unhealthy")
    if decline:
        rules = rules.when(F.col("decline_status") == "Unhealthy (by decline)", "Unhealthy")
    return rules.when(F.col("missing_fraction") > params.max_missing, "QC_Fail").otherwise("Alive")


def irreversible(daily: DataFrame, status: str = "status", order: str = "exp_day") -> DataFrame:
    """Once Dead, Dead on every later day of the source."""
    w = Window.partitionBy(*SOURCE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ever = F.max((F.col(status) == "Dead").cast("int")).over(w)
    return daily.withColumn(status, F.when(ever == 1, "Dead").otherwise(F.col(status)))


def summary(daily: DataFrame) -> DataFrame:
    """Per source: days by status, first and last day, first dead day, the last day's status."""
    def days(s: str) -> Column:
        return F.count_if(F.col("status") == s).alias(f"days_{s.lower()}")

    return daily.groupBy(*SOURCE).agg(
        *[days(s) for s in ("Alive", "Unhealthy", "Dead", "QC_Fail")],
        F.min("exp_day").alias("first_day"),
        F.max("exp_day").alias("last_day"),
        F.min(F.when(F.col("status") == "Dead", F.col("exp_day"))).alias("first_dead_day"),
        F.max_by("status", "exp_day").alias("final_status"),
    )


def latest_reports(reports: DataFrame) -> DataFrame:
    """Of the reports of one source and date, the one that arrived last."""
    w = Window.partitionBy(*SOURCE, "report_date").orderBy(F.desc("health_report_id"))
    return reports.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mapped_status(c: Column) -> Column:
    """Dead, Unhealthy, QC_Fail and the rest as dead, dying, qc_fail and alive."""
    return F.when(c == "Dead", "dead").when(c == "Unhealthy", "dying").when(c == "QC_Fail", "qc_fail").otherwise("alive")
