"""Rhythm: hourly totals, cosinor, periodogram, onset and offset, interdaily stability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.prepared import DAY
from ultradia.operators.readings import SOURCE


def hourly_totals(timed: DataFrame, by_day: bool = True) -> DataFrame:
    """Sums by source (and day) and zt: hourly."""
    keys = [*DAY, "exp_day"] if by_day else SOURCE
    return timed.groupBy(*keys, "zt").agg(F.sum("value").alias("hourly"))


def cosinor(df: DataFrame, keys: Sequence[str], hour: str, value: str, period: float = 24.0, corrected: bool = False) -> DataFrame:
    """Least-squares fit of mesor + A cos + B sin per key: mesor, amplitude, phase, p_value, n.

    In closed form from variances and covariances: one aggregate, no matrix, no Python. p is that of the F test, which with
    two numerator degrees of freedom is (1 + 2F/d) ^ (-d/2). Fewer than 3 points: all null;
    3 points or no variance: p null; a perfect fit: p 0. ``phase`` is (24 - peak) mod 24, as the
    reference gives it; ``corrected`` gives the peak itself. Null values are no points.
    """
    angle = F.lit(2.0) * F.pi() * F.col(hour) / F.lit(period)
    rows = df.where(F.col(value).isNotNull() & F.col(hour).isNotNull()).select(*keys, F.col(value).cast("double").alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(x).alias(f"m_{x}") for x in ("y", "c", "s")],
        *[F.covar_pop(a, b).alias(f"v_{a}{b}") for a, b in (("c", "c"), ("s", "s"), ("c", "s"), ("y", "c"), ("y", "s"), ("y", "y"))],
    )
    det = F.col("v_cc") * F.col("v_ss") - F.col("v_cs") * F.col("v_cs")
    ok = (F.col("n") >= 3) & (det > 1e-12)
    a = F.when(ok, (F.col("v_yc") * F.col("v_ss") - F.col("v_ys") * F.col("v_cs")) / det)
    b = F.when(ok, (F.col("v_ys") * F.col("v_cc") - F.col("v_yc") * F.col("v_cs")) / det)
    fit = m.withColumn("a", a).withColumn("b", b)
    explained = F.col("a") * F.col("v_yc") + F.col("b") * F.col("v_ys")
    left = F.greatest(F.lit(0.0), F.col("v_yy") - explained)
    d = (F.col("n") - 3).cast("double")
    ratio = (explained / 2) / (left / d)
    p = F.when((d <= 0) | (F.col("v_yy") <= 0) | F.col("a").isNull(), None).when(left <= 1e-12 * F.col("v_yy"), 0.0).otherwise(F.pow(1 + 2 * ratio / d, -d / 2))
    turn = F.atan2(-F.col("b"), F.col("a")) if not corrected else F.atan2(F.col("b"), F.col("a"))
    return fit.select(
        *keys,
        (F.col("m_y") - F.col("a") * F.col("m_c") - F.col("b") * F.col("m_s")).alias("mesor"),
        F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("amplitude"),
        F.pmod(turn * F.lit(period) / (F.lit(2.0) * F.pi()), F.lit(period)).alias("phase"),
        p.alias("p_value"),
        "n",
    )


def onset_offset(hourly: DataFrame, keys: Sequence[str] = (*DAY, "exp_day"), threshold_sd: float = 1.0) -> DataFrame:
    """onset_zt and offset_zt of each day's hourly profile (sustained for two hours).

    The profile is smoothed over three hours; above means more than its 10th percentile plus
    ``threshold_sd`` population standard deviations. Onset is the first of two hours above from the (first) minimum on;
    offset the last hour above that two hours below follow. Fewer than 3 hours: null.
    """
    w = Window.partitionBy(*keys).orderBy("zt")
    smooth = hourly.withColumn("s", F.avg("hourly").over(w.rowsBetween(-1, 1))).withColumn("i", F.row_number().over(w))
    level = smooth.groupBy(*keys).agg(
        (F.percentile("s", F.lit(0.1)) + threshold_sd * F.stddev_pop("s")).alias("level"),
        F.min(F.struct("s", "i")).alias("low"),
        F.count(F.lit(1)).alias("n"),
    )
    rows = smooth.join(level, list(keys)).withColumn("above", F.col("s") > F.col("level"))
    next1, next2 = F.lead("above", 1).over(w), F.lead("above", 2).over(w)
    rows = rows.withColumn("on", F.col("above") & next1 & (F.col("i") >= F.col("low.i"))).withColumn("off", F.col("above") & ~next1 & ~next2)
    enough = F.max("n") >= 3
    return rows.groupBy(*keys).agg(F.when(enough, F.min(F.when(F.col("on"), F.col("zt")))).alias("onset_zt"), F.when(enough, F.max(F.when(F.col("off"), F.col("zt")))).alias("offset_zt"))


def interdaily_stability(hourly: DataFrame) -> DataFrame:
    """Per source: n x sum over hours (mean of the hour - mean)^2 over p x sum (x - mean)^2; null without variance or with one point."""
    by_hour = hourly.groupBy(*SOURCE, "zt").agg(F.avg("hourly").alias("m"), F.count(F.lit(1)).alias("k"), F.sum("hourly").alias("t"), F.sum(F.col("hourly").cast("double") * F.col("hourly")).alias("q"))
    n, total, squares = F.sum("k"), F.sum("t"), F.sum("q")
    g = by_hour.groupBy(*SOURCE).agg(n.alias("n"), total.alias("total"), squares.alias("q"), F.count(F.lit(1)).alias("p"), F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("m")).alias("qm"))
    mean = F.col("total") / F.col("n")
    between = F.col("qm") - 2 * mean * F.col("sm") + F.col("p") * mean * mean
    within = F.col("q") - F.col("n") * mean * mean
    value = F.when((F.col("n") >= 2) & (within > 1e-9), F.col("n") * between / (F.col("p") * within))
    return g.select(*SOURCE, value.alias("interdaily_stability"))


def periodogram(hourly: DataFrame, keys: Sequence[str] = (*DAY, "exp_day"), corrected: bool = False, steps: int = 1000) -> DataFrame:
    """Normalised Lomb-Scargle period and power over 18 to 30 hours for each key's hourly profile.

    A profile has at most 24 hours, so it travels as one row of 24 cells; the tasks compare a batch
    of rows with the fixed basis in one matrix product. As the reference does, time is scaled by
    2 pi / 24 as well as the frequencies, unless ``corrected``. Fewer than 3 hours or no variance: null.
    """
    cells = [f"z{i}" for i in range(24)]
    rows = hourly.groupBy(*keys).agg(*[F.sum(F.when(F.col("zt") == i, F.col("hourly"))).cast("double").alias(cells[i]) for i in range(24)])
    periods = np.linspace(18, 30, steps)
    omega = 2 * np.pi / periods
    t = np.arange(24) * (1.0 if corrected else 2 * np.pi / 24)
    wt = t[:, None] * omega
    c, s, c2, s2 = np.cos(wt), np.sin(wt), np.cos(2 * wt), np.sin(2 * wt)
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[names].copy()
            period, power = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            for at in range(0, len(pdf), 2000):
                x = pdf[cells].to_numpy(float)[at : at + 2000]
                m = ~np.isnan(x)
                k = np.maximum(m.sum(1), 1)
                y = np.where(m, x - (np.where(m, x, 0).sum(1) / k)[:, None], 0)
                var = (y * y).sum(1)
                ok = (m.sum(1) >= 3) & (var > 0)
                tau = np.arctan2(m @ s2, m @ c2) / 2
                yc, ys = y @ c, y @ s
                cc, ss, cs = m @ (c * c), m @ (s * s), m @ (c * s)
                ct, st = np.cos(tau), np.sin(tau)
                num_c, num_s = yc * ct + ys * st, ys * ct - yc * st
                den_c = ct * ct * cc + 2 * ct * st * cs + st * st * ss
                den_s = ct * ct * ss - 2 * ct * st * cs + st * st * cc
                with np.errstate(divide="ignore", invalid="ignore"):
                    pw = np.nan_to_num(num_c**2 / den_c) + np.nan_to_num(num_s**2 / den_s)
                    pw = pw / var[:, None]
                best = np.nan_to_num(pw).argmax(1)
                period[at : at + 2000] = np.where(ok, periods[best], np.nan)
                power[at : at + 2000] = np.where(ok, pw[np.arange(len(x)), best], np.nan)
            out["period"], out["power"] = period, power
            yield out

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    found = rows.mapInPandas(run, f"{kinds}, period double, power double")
    return found.select(*names, *[F.when(~F.isnan(x), F.col(x)).alias(x) for x in ("period", "power")])


def rhythm_features(daily_cosinor: DataFrame, daily_period: DataFrame, edges: DataFrame, stability: DataFrame) -> DataFrame:
    """Per source: means and sample deviations of the daily measures, rhythmic days (p below 0.05), stability."""
    day = [*DAY, "exp_day"]
    joined = daily_cosinor.join(daily_period, day, "left").join(edges, day, "left")

    def both(c: str, name: str) -> list[Column]:
        return [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_sd")]

    per = joined.groupBy(*SOURCE).agg(
        *both("mesor", "mesor"),
        *both("amplitude", "amplitude"),
        *both("phase", "phase"),
        F.count_if(F.coalesce(F.col("p_value") < 0.05, F.lit(False))).cast("int").alias("rhythmic_days"),
        *both("period", "periodogram_period"),
        *both("power", "periodogram_power")[:1],
        *both("onset_zt", "activity_onset_zt"),
        *both("offset_zt", "activity_offset_zt"),
    )
    return per.join(stability, SOURCE, "left")
