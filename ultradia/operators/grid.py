"""Irregular readings onto a regular grid of clock hours, missing hours filled by low-rank factors.

The matrix is that of sources by time, its times folded into days: cell (source, day, hour) ~ u V', where V
has a row per hour of the day and u belongs to the source and, as far as the day's own cells say so, to
the day. Alternating least squares finds both over the observed cells: the factors of a day follow from its
own cells; the hours' factors from sums over all rows that Spark adds up (24 x (rank^2 + rank)
numbers, whatever the input). A source's factors follow from the sums over its days and fill the days without readings.
Nothing but the hours' sums ever reaches the driver, and a pass over the rows needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.readings import SOURCE, usable_readings
from ultradia.session import written

HOURS = [f"h{i}" for i in range(24)]


def hour_matrix(readings: DataFrame, low: int = 0, high: int = 1000) -> DataFrame:
    """experiment_id, fly_id, day, h0 to h23: the sum of the usable readings of each hour, null without any."""
    hours = usable_readings(readings, low, high).groupBy(*SOURCE, "blk", F.hour("datetime").alias("hour")).agg(F.sum("value").alias("v"))
    return hours.groupBy(*SOURCE, F.col("blk").alias("day")).agg(*[F.max(F.when(F.col("hour") == i, F.col("v"))).cast("double").alias(HOURS[i]) for i in range(24)])


def _rows_factors(x: np.ndarray, v: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of the rows of x (nan: missing), the mask and the values with 0 for missing."""
    m = ~np.isnan(x)
    z = np.where(m, x, 0.0)
    outer = np.einsum("ja,jb->jab", v, v).reshape(len(v), -1)
    r = v.shape[1]
    a = (m @ outer).reshape(-1, r, r) + ridge * np.eye(r)
    u = np.linalg.solve(a, (z @ v)[:, :, None])[:, :, 0]
    return u, m, z


def fit_factors(matrix: DataFrame, rank: int = 3, passes: int = 8, ridge: float = 0.1, still: float = 0.01) -> np.ndarray:
    """The 24 x rank factors of the hours, of log(1 + cell). Starts from a fixed smooth basis; no cells leave it as it is.

    It ends when a pass turns the space of the factors by less than ``still`` (sine of the largest angle), or after ``passes``.
    """
    t = 2 * np.pi * np.arange(24) / 24
    v = np.column_stack([np.ones(24), *[f(k * t) for k in range(1, rank) for f in (np.cos, np.sin)]])[:, :rank]
    size = rank * rank + rank

    for _ in range(passes):
        fixed = v.copy()

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((24, size))
            for pdf in batches:
                u, m, z = _rows_factors(np.log1p(pdf[HOURS].to_numpy(float)), fixed, ridge)
                total[:, : rank * rank] += m.T @ np.einsum("ia,ib->iab", u, u).reshape(len(u), -1)
                total[:, rank * rank :] += z.T @ u
            yield pd.DataFrame({"pos": np.arange(24 * size), "s": total.ravel()})

        got = matrix.select(*HOURS).mapInPandas(sums, "pos int, s double").groupBy("pos").agg(F.sum("s").alias("s")).collect()
        if not got:
            return v
        total = np.zeros(24 * size)
        for row in got:
            total[row["pos"]] = row["s"]
        total = total.reshape(24, size)
        a = total[:, : rank * rank].reshape(24, rank, rank) + ridge * np.eye(rank)
        v = np.linalg.solve(a, total[:, rank * rank :, None])[:, :, 0]
        before, now = np.linalg.qr(fixed)[0], np.linalg.qr(v)[0]
        if np.linalg.norm(now - before @ (before.T @ now), 2) < still:
            break
    return v


def _normal(x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mask of x (nan: missing), and the normal equations of its rows over v."""
    m = ~np.isnan(x)
    r = v.shape[1]
    a = (m @ np.einsum("ja,jb->jab", v, v).reshape(len(v), -1)).reshape(-1, r, r)
    return m, a, np.where(m, x, 0.0) @ v


def source_factors(matrix: DataFrame, v: np.ndarray, ridge: float = 0.1) -> DataFrame:
    """experiment_id, fly_id, f (rank numbers): the factors of each source over all its days; null with fewer observed cells than the rank."""
    rank = v.shape[1]
    n = rank * rank + rank + 1
    kinds = {k: matrix.schema[k].dataType.simpleString() for k in SOURCE}
    keys = ", ".join(f"{k} {t}" for k, t in kinds.items())

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m, a, b = _normal(np.log1p(pdf[HOURS].to_numpy(float)), v)
            out = pd.DataFrame(np.column_stack([a.reshape(len(a), -1), b, m.sum(axis=1)]), columns=[f"s{i}" for i in range(n)])
            yield pd.concat([pdf[SOURCE].reset_index(drop=True), out], axis=1)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = pdf[[f"s{i}" for i in range(n)]].to_numpy(float)
            a = sums[:, : rank * rank].reshape(-1, rank, rank) + ridge * np.eye(rank)
            f = np.linalg.solve(a, sums[:, rank * rank : -1, None])[:, :, 0]
            out = pdf[SOURCE].copy()
            out["f"] = [list(x) if k >= rank else None for x, k in zip(f, sums[:, -1])]
            yield out

    summed = matrix.select(*SOURCE, *HOURS).mapInPandas(parts, f"{keys}, " + ", ".join(f"s{i} double" for i in range(n)))
    return summed.groupBy(*SOURCE).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).mapInPandas(solved, f"{keys}, f array<double>")


def filled_matrix(matrix: DataFrame, v: np.ndarray, pull: float = 1.0) -> DataFrame:
    """experiment_id, fly_id, day, h0 to h23 (cells), g0 to g23 (what the source's factors give), seen (bits of the observed hours).

    Observed cells are as they are; the others come from the day's factors, which are pulled to the source's as by ``pull`` cells.
    A source with fewer observed cells than the rank has no support: its missing cells stay null.
    """
    rank = v.shape[1]
    guesses = [f"g{i}" for i in range(24)]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[HOURS].to_numpy(float)
            f = np.array([np.full(rank, np.nan) if k is None else k for k in pdf["f"]], float).reshape(-1, rank)
            m, a, b = _normal(np.log1p(x), v)
            u = np.linalg.solve(a + pull * np.eye(rank), (b + pull * f)[:, :, None])[:, :, 0]
            back = lambda w: np.clip(np.expm1(np.clip(w @ v.T, 0, 20)), 0, None)
            out = np.column_stack([np.where(m, x, back(u)), back(f)])
            rows = pd.DataFrame(out, columns=[*HOURS, *guesses])
            rows["seen"] = (m @ (1 << np.arange(24))).astype(np.int64)
            yield pd.concat([pdf[[*SOURCE, "day"]].reset_index(drop=True), rows], axis=1)

    d = matrix.schema
    keys = ", ".join(f"{k} {d[k].dataType.simpleString()}" for k in [*SOURCE, "day"])
    joined = matrix.join(source_factors(matrix, v), SOURCE, "left")
    return joined.mapInPandas(fill, f"{keys}, {', '.join(f'{h} double' for h in [*HOURS, *guesses])}, seen long")


def regular_grid(readings: DataFrame, rank: int = 3, passes: int = 8, low: int = 0, high: int = 1000) -> DataFrame:
    """One row per source and clock hour from its first to its last usable reading.

    Columns: experiment_id, fly_id, hour (timestamp of its beginning), total (double), status.
    status is ``observed`` (total is the exact sum of the hour's usable readings), ``filled`` (from
    the factors of the day, or of the source on a day without readings) or ``unsupported`` (total null: the
    source has fewer observed hours than the rank). A source with one usable reading has one row; one without has none. Readings that do
    not count are ignored. The hours are unrolled from day rows: no join, no shuffle but by source.
    """
    matrix = written(hour_matrix(readings, low, high), "hours")
    filled = filled_matrix(matrix, fit_factors(matrix, rank, passes))
    w = Window.partitionBy(*SOURCE).orderBy("day")
    days = (
        filled.withColumn("next_day", F.lead("day").over(w))
        .withColumn("is_first", F.lag("day").over(w).isNull())
        # days without any row: one row for each, with nothing seen
        .withColumn("at", F.explode(F.sequence("day", F.coalesce(F.date_sub("next_day", 1), F.col("day")))))
        .withColumn("here", F.col("at") == F.col("day"))
    )
    hours = days.select(*SOURCE, "at", "here", "is_first", "next_day", "seen", F.posexplode(F.arrays_zip(F.array(*HOURS).alias("own"), F.array(*[f"g{i}" for i in range(24)]).alias("usual"))).alias("h", "x"))
    first = F.length(F.regexp_extract(F.reverse(F.lpad(F.bin("seen"), 24, "0")), "^(0*)", 1))
    last = F.length(F.bin("seen")) - 1
    inside = (~F.col("is_first") | ~F.col("here") | (F.col("h") >= first)) & (F.col("next_day").isNotNull() | (F.col("h") <= last))
    observed = F.col("here") & (F.shiftright("seen", 0).bitwiseAND(F.expr("shiftleft(1L, h)")) != 0)
    value = F.when(F.col("here"), F.col("x.own")).otherwise(F.col("x.usual"))
    cell = F.when(~F.isnan(value), value)
    return hours.where(inside).select(
        *SOURCE,
        F.expr("timestampadd(HOUR, h, cast(at as timestamp_ntz))").alias("hour"),
        cell.alias("total"),
        F.when(observed, "observed").when(cell.isNotNull(), "filled").otherwise("unsupported").alias("status"),
    )


def hour_gaps(grid: DataFrame) -> DataFrame:
    """Longest runs of hours that are not observed: experiment_id, fly_id, gap_start, gap_end, n_hours.

    Within a source the hours are consecutive, so the missing ones of a run share the difference
    between hour and rank; only they are ordered.
    """
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', hour)")
    w = Window.partitionBy(*SOURCE).orderBy("hour")
    return (
        grid.where(F.col("status") != "observed")
        .select(*SOURCE, "hour", (hour - F.row_number().over(w)).alias("_run"))
        .groupBy(*SOURCE, "_run")
        .agg(F.min("hour").alias("gap_start"), F.max("hour").alias("gap_end"), F.count(F.lit(1)).alias("n_hours"))
        .drop("_run")
    )
