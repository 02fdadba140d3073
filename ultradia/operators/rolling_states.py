"""Bins labelled before a hidden-state model: dead, asleep, warming up, too little data, or a candidate, with z-scores over the active past."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.readings import SOURCE
from ultradia.operators.runs import first_long_run, relabelled_short_runs

#: Lengths in bins of five minutes, and the floor of a deviation as a share of the source's own.
MIN_BOUT_BINS = 6
DEATH_BINS = 144
ROLL_BINS = 288
WARMUP_ACTIVE = 144
SD_FLOOR = 0.01
#: Rows whose windows are laid out at once.
STRIDE = 4096


def _past(v: np.ndarray, roll: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of what is not NaN among the last ``roll`` values at each place; NaN where there are none, or not two."""
    mean, sd = np.empty(len(v)), np.empty(len(v))
    padded = np.concatenate([np.full(roll - 1, np.nan), v])
    for lo in range(0, len(v), STRIDE):
        x = np.lib.stride_tricks.sliding_window_view(padded[lo : lo + STRIDE + roll - 1], roll)
        there = ~np.isnan(x)
        n = there.sum(1)
        m = np.where(there, x, 0).sum(1) / np.where(n > 0, n, np.nan)
        d = np.where(there, x - m[:, None], 0)
        mean[lo : lo + STRIDE], sd[lo : lo + STRIDE] = m, np.sqrt((d * d).sum(1) / np.where(n > 1, n - 1, np.nan))
    return mean, sd


def _rolled(rows: DataFrame, names: tuple[str, ...], roll: int) -> DataFrame:
    """``rows`` with _name_mean and _name_sd of column _name over the last ``roll`` rows of the source.

    A window of Spark goes over all rows of its frame again for each row and aggregate; here the rows pass in the order
    of their source's bins, and the last ones of a batch are kept for the next.
    """
    def roll_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, kept = None, {n: np.empty(0) for n in names}
        for b in batches:
            keys = list(zip(*(b[c].to_pylist() for c in SOURCE)))
            begin = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            values = {n: b[f"_{n}"].to_numpy(zero_copy_only=False).astype(float) for n in names}
            got = {f"_{n}_{k}": np.empty(len(keys)) for n in names for k in ("mean", "sd")}
            for lo, hi in zip(begin, [*begin[1:], len(keys)]):
                for n, v in values.items():
                    before = kept[n] if keys[lo] == source else np.empty(0)
                    own = np.concatenate([before, v[lo:hi]])
                    for k, r in zip(("mean", "sd"), _past(own, roll)):
                        got[f"_{n}_{k}"][lo:hi] = r[len(before) :]
                    kept[n] = own[max(0, len(own) - roll + 1) :]
                source = keys[lo]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(r, from_pandas=True) for r in got.values())], [*b.schema.names, *got])

    made = "".join(f", _{n}_{k} double" for n in names for k in ("mean", "sd"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*SOURCE).sortWithinPartitions(*SOURCE, "bin").mapInArrow(roll_all, kinds + made)


def prelabelled(bins: DataFrame, min_bout: int = MIN_BOUT_BINS, death_bins: int = DEATH_BINS, roll: int = ROLL_BINS, warmup: int = WARMUP_ACTIVE) -> DataFrame:
    """bins with raw_state, hmm_state, mt_z, pn_z.

    A source is dead from its first ``death_bins`` bins in a row with neither MT nor variance of Pn; a bin
    without MT is Sleep, else Active; Active runs shorter than ``min_bout`` become Sleep. An Active bin is compared with mean and
    deviation of the Active ones of the last ``roll`` bins: Warmup before ``warmup`` of them, Low_Data where a
    deviation is under its floor, else HMM_candidate. A source has at most 288 bins a day.
    """
    dead_at = first_long_run(bins, SOURCE, ["bin"], (F.col("mt_sum") == 0) & (F.col("pn_var") == 0), death_bins).withColumnRenamed("start", "_dead_at")
    w = Window.partitionBy(*SOURCE).orderBy("bin")
    rows = bins.join(dead_at, SOURCE, "left")
    raw = F.when(F.col("bin") >= F.col("_dead_at"), "Dead").when(F.col("mt_sum") == 0, "Sleep").otherwise("Active")
    rows = relabelled_short_runs(rows.withColumn("raw_state", raw), SOURCE, ["bin"], "raw_state", "Active", "Sleep", min_bout)
    active = F.col("raw_state") == "Active"
    whole = Window.partitionBy(*SOURCE)
    values = {"mt": F.col("mt_sum").cast("double"), "pn": F.col("pn_var")}
    rows = _rolled(rows.withColumns({f"_{name}": F.when(active, c) for name, c in values.items()}), tuple(values), roll)
    for name, c in values.items():
        rows = rows.withColumn(f"_{name}_floor", F.coalesce(F.stddev_samp(f"_{name}").over(whole) * SD_FLOOR, F.lit(0.0)))
        floor = F.when(F.col(f"_{name}_floor") > 0, F.col(f"_{name}_floor")).otherwise(1e-6)
        spread = F.when(F.col(f"_{name}_sd") > 0, F.col(f"_{name}_sd")).otherwise(floor)
        rows = rows.withColumn(f"{name}_z", F.when(active, (c - F.col(f"_{name}_mean")) / spread)).withColumn(f"_{name}_low", F.coalesce(F.col(f"_{name}_sd") < floor, F.lit(False)))
    seen = F.sum(active.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(~active, F.col("raw_state")).when(F.col("_seen") < warmup, "Warmup").when(F.col("_mt_low") | F.col("_pn_low"), "Low_Data").otherwise("HMM_candidate")
    rows = rows.withColumn("_seen", seen).withColumn("hmm_state", state)
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def candidate_bouts(bins: DataFrame, gap_min: int = 5) -> DataFrame:
    """The HMM_candidate bins with ``bout``: a new one after more than ``gap_min`` minutes."""
    w = Window.partitionBy(*SOURCE).orderBy("bin")
    rows = bins.where("hmm_state = 'HMM_candidate'")
    new = F.coalesce((F.expr("timestampdiff(MINUTE, _before, bin)") > gap_min).cast("int"), F.lit(1))
    return rows.withColumn("_before", F.lag("bin").over(w)).withColumn("bout", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before")


def state_shares(bins: DataFrame) -> DataFrame:
    """Per source: n_bins, percent of each state (one decimal), first dead bin, and the flag Exclude where any bin is dead, else Keep."""
    def percent(s: str):
        return F.round(100 * F.avg((F.col("hmm_state") == s).cast("int")), 1).alias(f"pct_{s.lower()}")

    g = bins.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n_bins"), *[percent(s) for s in ("Dead", "Sleep", "Warmup", "Low_Data", "HMM_candidate")], F.min(F.when(F.col("hmm_state") == "Dead", F.col("bin"))).alias("first_dead"))
    return g.withColumn("qc", F.when(F.col("pct_dead") > 0, "Exclude").otherwise("Keep"))
