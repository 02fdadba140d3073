"""Flies taken out of the data in stages: by status, by fly, by day of a fly, by metadata; each row keeps the first stage that removes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ultradia.operators.readings import SOURCE

STAGES = ("status", "fly", "day", "metadata")


def fly_key(monitor: str = "monitor", channel: str = "channel") -> Column:
    """monitor-ch<channel> in lower case; a channel may be a number or begin with ch."""
    return F.lower(F.concat_ws("-ch", F.col(monitor).cast("string"), F.regexp_replace(F.lower(F.col(channel).cast("string")), "^ch", "")))


def _listed(c: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.col(c)).isin([v.lower() for v in values]), F.lit(False)) if values else F.lit(False)


def staged(
    rows: DataFrame,
    *,
    flies: DataFrame | None = None,
    fly_days: DataFrame | None = None,
    genotypes: Sequence[str] = (),
    sexes: Sequence[str] = (),
    treatments: Sequence[str] = (),
    statuses: Sequence[str] = (),
    reports: DataFrame | None = None,
) -> DataFrame:
    """rows with ``stage``: the first of STAGES that removes the row, else ``kept``.

    rows have experiment_id, fly_id, monitor, channel, exp_day, genotype, sex, treatment. ``flies`` (column
    fly_key) go whole, ``fly_days`` (fly_key, exp_day) for these days; both case aside, and repeats do not matter. Metadata
    are compared case aside. ``statuses`` need ``reports`` (experiment_id, fly_id, status): a source with any
    report of such a status goes whole. Nulls are in no list. Nothing given, nothing removed; no rows, no rows.
    """
    out = rows.withColumn("_key", fly_key())
    if statuses and reports is not None:
        bad = reports.where(F.col("status").isin(list(statuses))).select(*SOURCE).distinct().withColumn("_status", F.lit(True))
        out = out.join(bad, SOURCE, "left")
    else:
        out = out.withColumn("_status", F.lit(False))
    for name, given, on in (("_fly", flies, ["_key"]), ("_day", fly_days, ["_key", "exp_day"])):
        if given is None:
            out = out.withColumn(name, F.lit(False))
        else:
            listed = given.withColumn("_key", F.lower("fly_key")).select(*on).distinct().withColumn(name, F.lit(True))
            out = out.join(listed, on, "left")
    metadata = _listed("genotype", genotypes) | _listed("sex", sexes) | _listed("treatment", treatments)
    stage = F.when(F.col("_status"), "status").when(F.col("_fly"), "fly").when(F.col("_day"), "day").when(metadata, "metadata").otherwise("kept")
    return out.withColumn("stage", stage).drop("_key", "_status", "_fly", "_day")


def counters(rows: DataFrame) -> DataFrame:
    """stage, n, sources of staged rows."""
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*SOURCE).alias("sources"))


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("stage = 'kept'").drop("stage")
