"""Missing values from similar records: a sequential hot deck over nested groups.

Records are sorted within groups; a missing value takes that of the nearest earlier or later
record of its group that has one. A group without any takes the nearest donor of the next wider
group, and so on outwards. Wider levels work on the first and last donor of each distinct order, and every
level is ordered in blocks of the order, so that a group of a third of all records is no single task's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ultradia.session import written

#: Blocks into which the orders of all records are cut, about evenly.
BLOCKS = 64


def _nearest(parts: Sequence[str], cols: Sequence[str], what: str, forward: bool) -> Column:
    w = Window.partitionBy(*parts).orderBy(*[F.asc(c) if forward else F.desc(c) for c in cols]).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(what, ignorenulls=True).over(w)


def _neighbours(rows: DataFrame, keys: Sequence[str], at: Sequence[str], asking: Column) -> DataFrame:
    """The ``asking`` rows with _prev and _next: the donor (_last, _first) of the nearest rows before and after, by ``at`` within ``keys``.

    Within a block (_b) by a window over its rows; beyond it from the first and last donor per block.
    """
    block = [*keys, "_b"]
    ends = rows.groupBy(*block).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    ends = ends.select(*block, _nearest(keys, ["_b"], "_last", True).alias("_before"), _nearest(keys, ["_b"], "_first", False).alias("_after"))
    here = rows.withColumn("_prev", _nearest(block, at, "_last", True)).withColumn("_next", _nearest(block, at, "_first", False)).where(asking)
    here = here.join(ends, block)
    return here.withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")}).drop("_before", "_after")


def _nearer() -> Column:
    """The nearer of _prev and _next by order; of equally near ones the earlier."""
    back, ahead = F.col("_o") - F.col("_prev.o"), F.col("_next.o") - F.col("_o")
    return F.when(F.col("_next").isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))


def hot_deck(records: DataFrame, record: str, levels: Sequence[str], order: str, value: str, within: Sequence[str] = ()) -> DataFrame:
    """Fill ``value`` where it is null.

    ``levels`` are nested group columns from wide to narrow, ``order`` a number by which records are
    sorted (ties by ``record``). Adds: filled_value, was_filled, donor (its record), donor_scope (0: same narrowest group,
    1: same group one level wider, ...), distance (difference in order). Of two equally near donors the
    earlier one gives; from a wider group, of donors of the record's own order, the first. Nothing is ever taken from other values of
    ``within``. Without any donor the value stays null and was_filled is false. Null group keys are a group
    of their own; a null order is 0. Columns of the input named like a result are replaced by it. No records, no rows.
    """
    root = [f"_w{i}" for i in range(len(within))]
    keys = [*root, *[f"_k{i}" for i in range(len(levels))]]
    base = records.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, [*within, *levels])})
    base = base.withColumn("_o", F.coalesce(F.col(order).cast("double"), F.lit(0.0))).withColumn("_r", F.coalesce(F.col(record).cast("string"), F.lit("")))
    cuts = base.agg(F.percentile_approx("_o", [i / BLOCKS for i in range(1, BLOCKS)], 10_000).alias("_cuts"))
    base = base.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("_o")))).drop("_cuts")
    missing = F.col(value).isNull()
    donor = F.when(~missing, F.struct(F.col("_o").alias("o"), F.col("_r").alias("r"), F.col(value).alias("v")))
    base = written(base.withColumn("_missing", missing), "records")
    donors = base.select(*keys, "_b", "_o", "_r", "_missing", donor.alias("_first")).withColumn("_last", F.col("_first"))
    at = [*keys, "_b", "_o", "_r"]
    inside = _neighbours(donors, keys, ["_o", "_r"], F.col("_missing")).select(*at, _nearer().alias("_got"))
    inside = written(inside.dropDuplicates(at).withColumn("_scope", F.when(F.col("_got").isNotNull(), 0)), "inside")
    # only what has no donor in its own group looks further, level by level
    ends = written(donors.where("not _missing").groupBy(*keys, "_b", "_o").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")), "donors")
    found = inside
    for depth in range(1, len(levels) + 1):
        parent = keys[: len(keys) - depth]
        asks = found.where("_got is null").select(*parent, "_b", "_o").distinct()
        near = ends.join(asks.select(*parent).distinct(), parent, "left_semi") if parent else ends
        level = near.groupBy(*parent, "_b", "_o").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
        level = level.withColumn("_asks", F.lit(False)).unionByName(asks.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
        level = level.groupBy(*parent, "_b", "_o").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_asks").alias("_asks"))
        wider = _neighbours(level, parent, ["_o"], F.col("_asks")).select(*parent, "_b", "_o", F.coalesce("_first", _nearer()).alias("_wider"))
        found = found.join(wider, [*parent, "_b", "_o"], "left").withColumns(
            {"_scope": F.coalesce("_scope", F.when(F.col("_wider").isNotNull(), depth)), "_got": F.coalesce("_got", "_wider")}
        ).drop("_wider")
        found = written(found, "found")
    results = {"filled_value", "was_filled", "donor", "donor_scope", "distance"}
    plain = [c for c in records.columns if c not in results]
    got = base.where("_missing").join(found, at)
    filled = got.select(
        *plain,
        F.col("_got.v").alias("filled_value"),
        F.col("_got").isNotNull().alias("was_filled"),
        F.col("_got.r").alias("donor"),
        F.col("_scope").alias("donor_scope"),
        F.abs(F.col("_got.o") - F.col("_o")).alias("distance"),
    )
    own = base.where("not _missing").select(
        *plain, F.col(value).alias("filled_value"), F.lit(False).alias("was_filled"), F.lit(None).cast("string").alias("donor"), F.lit(None).cast("int").alias("donor_scope"), F.lit(None).cast("double").alias("distance")
    )
    return filled.unionByName(own)


def in_range(c: str, low: float, high: float) -> Column:
    """The value if it is a number from low to high, else null."""
    return F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c)) & F.col(c).between(low, high), F.col(c))


def strain_of(flies: DataFrame, strains: DataFrame) -> DataFrame:
    """flies with ``strain``: the valid code that genotype is, case and surrounding blanks aside, else null."""
    code = F.lower(F.regexp_replace("genotype", r"^\s+|\s+$", ""))
    codes = strains.select(code.alias("_code"), F.col("genotype").alias("strain")).dropDuplicates(["_code"])
    return flies.withColumn("_code", code).join(codes, "_code", "left").drop("_code")


def monitor_of(c: str) -> Column:
    return F.coalesce(F.regexp_extract(c, "^M(.*)_Ch[0-9]+$", 1), F.lit(""))


def channel_of(c: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({c}, '_Ch([0-9]+)$', 1) as int)")


def filled_fields(features: DataFrame, flies: DataFrame, strains: DataFrame) -> DataFrame:
    """One row per fly and field: experiment_id, fly_id, field, value, filled_value, was_missing, was_filled, donor, donor_scope, distance.

    Fields: p_doze_mean (a probability), total_sleep_mean (minutes of a day), genotype (a strain
    code). A value that is null, NaN or impossible is missing and is filled: a feature from the
    flies of the same experiment, monitor, and strain, sex and treatment, nearest by channel; a
    genotype from the nearest channel of the same experiment and monitor. Rows of one fly that repeat are
    one record; it is missing a value only if none of its rows has a true one. Values are strings
    in the common result. Flies without a row in features have no features to fill.
    """
    place = [monitor_of("fly_id").alias("monitor"), channel_of("fly_id").alias("channel")]
    by_fly = ["experiment_id", "fly_id"]
    known = (
        strain_of(flies, strains)
        .groupBy(*by_fly)
        .agg(F.min("strain").alias("strain"), F.lower(F.substring(F.min(F.trim("sex")), 1, 1)).alias("sex"), F.min(F.trim("treatment")).alias("treatment"))
    )
    alike = known.groupBy("fly_id").agg(F.min(F.concat_ws("|", "strain", "sex", "treatment")).alias("alike"))
    per_fly = features.groupBy(*by_fly).agg(
        F.min(in_range("p_doze_mean", 0.0, 1.0)).alias("p_doze_mean"), F.min(in_range("total_sleep_mean", 0.0, 1440.0)).alias("total_sleep_mean")
    )
    # one deck for all fields: what differs is the narrowest group, which genotypes do without
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("p_doze_mean", "total_sleep_mean")]))
    numbers = per_fly.join(alike, "fly_id", "left").select(*by_fly, "alike", *place, pairs.alias("x")).select(*by_fly, "alike", "monitor", "channel", "x.field", "x.value")
    strains_ = known.select(*by_fly, F.lit("").alias("alike"), *place, F.lit("genotype").alias("field"), F.col("strain").alias("value"))
    filled = hot_deck(numbers.unionByName(strains_), "fly_id", ["experiment_id", "monitor", "alike"], "channel", "value", within=["field"])
    none = F.col("field") == "genotype"
    return filled.select(
        *by_fly,
        "field",
        "value",
        "filled_value",
        F.col("value").isNull().alias("was_missing"),
        "was_filled",
        "donor",
        F.when(none, F.greatest(F.col("donor_scope") - 1, F.lit(0))).otherwise(F.col("donor_scope")).alias("donor_scope"),
        "distance",
    )
