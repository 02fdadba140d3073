"""Runs of equal flags in ordered rows (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.readings import SOURCE


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """One row per run: keys, flag, run (number of the island), start, end (by the first order column), length (rows)."""
    flagged = df.withColumn("_flag", flag)
    w = Window.partitionBy(*keys).orderBy(*order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_flag").orderBy(*order))
    return (
        flagged.withColumn("run", island)
        .groupBy(*keys, F.col("_flag").alias("flag"), "run")
        .agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("length"))
    )


def numbered_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """The rows with ``run``: 1, 2, ... whenever the flag changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_flag", flag)
    before = F.lag("_flag").over(w)
    new = F.when(before.isNull() | (before != F.col("_flag")), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def longest_zero_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bin_length_min: int = 1) -> DataFrame:
    """keys, longest_zero (minutes; 0 without zeros), sleep runs aside."""
    runs = run_lengths(df, keys, order, F.col(value) == 0)
    return runs.groupBy(*keys).agg((F.coalesce(F.max(F.when(F.col("flag"), F.col("length"))), F.lit(0)) * bin_length_min).alias("longest_zero"))


def first_long_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, least: int) -> DataFrame:
    """keys, start: where the first run of at least ``least`` true rows begins; keys without one are left out."""
    return run_lengths(df, keys, order, flag).where(F.col("flag") & (F.col("length") >= least)).groupBy(*keys).agg(F.min("start").alias("start"))


def relabelled_short_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, what: str, instead: str, least: int) -> DataFrame:
    """Rows of runs of ``what`` shorter than ``least`` get ``instead``; neighbours are not merged before."""
    numbered = numbered_runs(df, keys, order, F.col(label))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "run"))
    return numbered.withColumn("_n", n).withColumn(label, F.when((F.col(label) == what) & (F.col("_n") < least), instead).otherwise(F.col(label))).drop("_n", "run", "_flag")


def quiet_gaps(rows: DataFrame, ends: DataFrame, ts: str, hours: int) -> DataFrame:
    """Start of the first stretch of at least ``hours`` without activity of each source, on a dense minute grid, without building it.

    ``rows``: experiment_id, fly_id, ts of the minutes with activity above 0; ``ends``: for each
    source data_start and data_end. The stretch before the first active minute, between two, and
    after the last one to data_end count; only active minutes are sorted.
    """
    least = hours * 60
    active = rows.select(*SOURCE, F.col(ts).alias("at")).distinct()
    between = active.withColumn("_next", F.lead("at").over(Window.partitionBy(*SOURCE).orderBy("at")))
    minutes = "timestampdiff(MINUTE, {}, {})"
    inner = between.join(ends, SOURCE).select(*SOURCE, F.expr("timestampadd(MINUTE, 1, at)").alias("start"), F.expr(minutes.format("at", "coalesce(_next, timestampadd(MINUTE, 1, data_end))") + " - 1").alias("n"))
    firsts = active.groupBy(*SOURCE).agg(F.min("at").alias("at"))
    leading = ends.join(firsts, SOURCE, "left").select(*SOURCE, F.col("data_start").alias("start"), F.expr(minutes.format("data_start", "coalesce(at, timestampadd(MINUTE, 1, data_end))")).alias("n"))
    return inner.unionByName(leading).where(F.col("n") >= least).groupBy(*SOURCE).agg(F.min("start").alias("death_datetime"))
