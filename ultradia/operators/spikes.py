"""Implausible readings: impossible values, spikes over the usual level, stuck values.

Each source's values, in order of time, are split into undecimated Haar wavelet bands. With S_j the
mean of the last 2^j values (S_0 the value itself), the details are D_j = S_{j-1} - S_j and
    value - level = D_1 + ... + D_J + (S_J - level).
A source's deviation is 1.4826 times the median size of its first differences (twice the details of the finest band). A band
over three deviations makes a candidate; so does one over (factor - 1) x level / (J + 1),
which a value above factor x level always has in some band, so that none is lost where a source is noisy. The
exact factor then decides. A run of zero first details is a stuck sensor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.readings import SOURCE, counted_readings


def source_median(rows: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """The exact median of the values from low to high of each source: experiment_id, fly_id, level.

    From counts by value: a source gives at most high - low + 1 rows, however many readings it has.
    """
    counts = rows.where(F.col(value).between(low, high)).groupBy(*SOURCE, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*SOURCE)
    upto = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return (
        counts.withColumn("upto", upto)
        .withColumn("all", F.sum("n").over(w))
        .groupBy(*SOURCE)
        .agg(
            F.min(F.when(F.col("upto") >= F.floor((F.col("all") + 1) / 2), F.col("v"))).alias("lower"),
            F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("v"))).alias("upper"),
        )
        .select(*SOURCE, ((F.col("lower") + F.col("upper")) / F.lit(2.0)).alias("level"))
    )


def implausible_readings(
    readings: DataFrame, low: int = 0, high: int = 1000, factor: float = 6.0, stuck_after: int = 12, levels: int = 3, deviations: float = 3.0
) -> DataFrame:
    """Every counted MT reading with its flags.

    Columns: measurement_id, experiment_id, fly_id, datetime, value, level (the source's median of
    readings from 1 to ``high``; null if it has none), deviation (robust, of the source's first differences within days), score (the largest
    wavelet band over the level; null without level), run_length, is_impossible, is_spike, is_stuck.

    * impossible: below ``low`` or above ``high``
    * spike: above ``factor`` times the level, among the wavelet candidates
    * stuck: above 0 and one of at least ``stuck_after`` successive equal values (zero details)

    The rows cross the network once, placed by source and day: what reaches over the border of a
    day is the first and last run of each day, and the level, a few rows per source and day. The
    wavelets of a day start anew at its first value, which keeps the sum of the bands exact.
    """
    day = [*SOURCE, "blk"]
    rows = counted_readings(readings, ("MT",)).select(*day, "datetime", "measurement_id", "value")
    w = Window.partitionBy(*day).orderBy("datetime")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)

    # runs within the day: the first detail is zero inside a run
    runs = (
        rows.withColumn("_d1", F.col("value").cast("long") - F.lag("value").over(w))
        .withColumn("run", F.sum(F.when(F.col("_d1") == 0, 0).otherwise(1)).over(to_here))
    )
    in_day = runs.groupBy(*day, "run").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    edge = Window.partitionBy(*day)
    edges = (
        in_day.withColumn("last_run", F.max("run").over(edge))
        .where((F.col("run") == 1) | (F.col("run") == F.col("last_run")))
    )
    by_source = Window.partitionBy(*SOURCE).orderBy("blk", "run")
    # a run goes on over midnight where the last run of a day and the first of the next day seen are equal
    goes_on = (F.lag("value").over(by_source) == F.col("value")) & (F.lag("blk").over(by_source) != F.col("blk"))
    whole = Window.partitionBy(*SOURCE, "chain")
    chained = (
        edges.withColumn("_new", F.when(goes_on, 0).otherwise(1))
        .withColumn("chain", F.sum("_new").over(by_source.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("chain_length", F.sum("n").over(whole))
        .groupBy(*day)
        .agg(
            F.max("last_run").alias("last_run"),
            F.max(F.when(F.col("run") == 1, F.col("chain_length"))).alias("first_length"),
            F.max(F.when(F.col("run") == F.col("last_run"), F.col("chain_length"))).alias("last_length"),
        )
    )
    steps = runs.select(*SOURCE, F.abs("_d1").alias("step"))
    scale = source_median(steps, "step", 0, high - low).select(*SOURCE, (F.col("level") * F.lit(1.4826)).alias("deviation"))
    info = chained.join(source_median(rows, "value", 1, high).join(scale, SOURCE, "left"), SOURCE, "left")

    smooth: list[Column] = [F.col("value").cast("double")]
    smooth += [F.avg("value").over(w.rowsBetween(1 - (1 << j), 0)) for j in range(1, levels + 1)]
    bands = runs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*day, "run")))
    for j in range(1, levels + 1):
        bands = bands.withColumn(f"_band{j}", smooth[j - 1] - smooth[j])
    bands = bands.withColumn("_smooth", smooth[levels])
    names = [F.col(f"_band{j}") for j in range(1, levels + 1)]
    flagged = bands.join(info, day, "left").withColumn("score", F.greatest(*names, F.col("_smooth") - F.col("level")) / F.col("level"))
    threshold = F.least(deviations * F.coalesce("deviation", F.lit(0.0)) / F.col("level"), F.lit((factor - 1) / (levels + 1) * (1 - 1e-9)))
    candidate = F.col("score") > threshold
    length = F.when(F.col("run") == 1, F.col("first_length")).when(F.col("run") == F.col("last_run"), F.col("last_length")).otherwise(F.col("_n"))
    return flagged.withColumn("run_length", length).select(
        "measurement_id",
        *SOURCE,
        "datetime",
        "value",
        "level",
        "deviation",
        F.when(F.col("level").isNotNull(), F.col("score")).alias("score"),
        "run_length",
        (~F.col("value").between(low, high)).alias("is_impossible"),
        F.coalesce(candidate & (F.col("value") > factor * F.col("level")), F.lit(False)).alias("is_spike"),
        ((F.col("value") > 0) & (F.col("run_length") >= stuck_after)).alias("is_stuck"),
    )
