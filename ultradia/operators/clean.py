"""Cleaning and standardising feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ultradia.functions.timecols import number_or_null

GROUP = ["genotype", "sex", "treatment"]
KEYS = {"feature_id", "experiment_id", "fly_id", "monitor", "channel", *GROUP}
#: Columns that are 0 where a fly has no bout of the kind, and those filled with the group's mean.
ZERO_COLUMNS = ("day_bouts_mean", "night_bouts_mean", "mean_day_bout_mean", "max_day_bout_mean", "mean_night_bout_mean", "max_night_bout_mean", "frag_bouts_per_min_sleep_mean")
MEAN_COLUMNS = ("sleep_latency_mean",)
MEAN_COLUMNS_INTENDED = ("sleep_latency_mean", "waso_mean", "mesor_sd", "amplitude_sd", "phase_sd")


def feature_columns(df: DataFrame, suffix: str = "") -> list[str]:
    """Numeric columns that are no keys, with the suffix."""
    kinds = ("double", "float", "int", "bigint", "smallint")
    return [c for c, t in df.dtypes if c not in KEYS and (t in kinds or t.startswith("decimal")) and c.endswith(suffix)]


def without_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN as null in the double columns."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float") and (columns is None or c in columns)]
    return df.withColumns({c: number_or_null(F.col(c)) for c in doubles})


def problem_rows(features: DataFrame, file_variant: bool = False) -> DataFrame:
    """Rows without sleep or bouts (0 or null), with why; the file variant keeps null sleep and also takes p_doze 0 or null."""
    sleep, bouts = F.col("total_sleep_mean"), F.col("total_bouts_mean")
    if file_variant:
        rules = [(sleep == 0, "no sleep"), (bouts == 0, "no bouts"), (F.col("p_doze_mean").isNull() | (F.col("p_doze_mean") == 0), "no p_doze")]
    else:
        rules = [(sleep.isNull() | (sleep == 0), "no sleep"), (bouts.isNull() | (bouts == 0), "no bouts")]
    why = F.concat_ws("; ", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules])
    return features.withColumn("why", why).where("why != ''")


def iqr_bounds(df: DataFrame, column: str = "total_sleep_mean", multiplier: float = 1.5, group: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """group, q1, q3, low, high, n: exact interpolated quartiles per group.

    Values are counted before they meet (a frequency per distinct value), so a hot group sends its
    distinct values, not its rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    q = counts.groupBy(*group).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)), F.col("_n")).alias("q"), F.sum("_n").alias("n"))
    spread = F.col("q")[1] - F.col("q")[0]
    return q.select(*group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[0] - multiplier * spread).alias("low"), (F.col("q")[1] + multiplier * spread).alias("high"), "n")


def iqr_marked(df: DataFrame, column: str = "total_sleep_mean", multiplier: float = 1.5) -> DataFrame:
    """Adds is_outlier (strictly outside its group's bounds; null values are kept). Rows with a null in the group columns are dropped."""
    rows = df.dropna(subset=GROUP)
    marked = rows.join(iqr_bounds(rows, column, multiplier), GROUP, "left")
    return marked.withColumn("is_outlier", F.coalesce((F.col(column) < F.col("low")) | (F.col(column) > F.col("high")), F.lit(False)))


def filled_nan(df: DataFrame, mean_columns: Sequence[str] = MEAN_COLUMNS) -> DataFrame:
    """Zero columns 0, mean columns the mean of genotype, sex and treatment, where null. Other columns stay.

    ``MEAN_COLUMNS_INTENDED`` also fills those whose names the reference spells otherwise than its tables.
    """
    means = df.groupBy(*GROUP).agg(*[F.avg(c).alias(f"_{c}") for c in mean_columns])
    same = [df[c].eqNullSafe(means[c]) for c in GROUP]
    joined = df.join(means, same[0] & same[1] & same[2], "left").select(df["*"], *[f"_{c}" for c in mean_columns])
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ZERO_COLUMNS if c in df.columns})
    return filled.withColumns({c: F.coalesce(c, f"_{c}") for c in mean_columns}).drop(*[f"_{c}" for c in mean_columns])


def z_scored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The other columns and <column>_z over all rows with the sample deviation; null where the deviation is 0 or null.

    Means and deviations are one row, which is sent along.
    """
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*[c for c in df.columns if c not in columns], *[F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"{c}_z") for c in columns])


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n_null, n: one row per column, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0)).alias("n_null")) for c in columns]))
    return counts.select("n", pairs.alias("x")).select("x.feature", "x.n_null", "n")
