"""Group statistics of many features at once: long rows (feature, group, value), ranks per feature, aggregates.

Ranks come from counts by distinct value, so what is ordered is distinct values, in blocks of the
feature's range whose sums carry over; a group or value that most rows share is counted before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ultradia.functions.dist import chi2_tail, f_tail, fisher_p, normal_two_sided


def long_features(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """feature, grp, value: the columns unpivoted; rows without value or group left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), pairs.alias("x")).select("x.feature", "grp", "x.value").where(F.col("value").isNotNull() & ~F.isnan("value"))


#: Blocks into which the values of a feature are cut, about evenly; no task orders more than one.
BLOCKS = 64


def blocked(counts: DataFrame) -> DataFrame:
    """counts with _b: the block of the value within its feature, by approximate quantiles (BLOCKS - 1 numbers a feature)."""
    cuts = counts.groupBy("feature").agg(F.percentile_approx("value", [i / BLOCKS for i in range(1, BLOCKS)], 1000).alias("_cuts"))
    return counts.join(F.broadcast(cuts), "feature").withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("value")))).drop("_cuts")


def running(df: DataFrame, keys: Sequence[str], n: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``n`` up to and at the value within keys, from blocks and the sums of the blocks before."""
    within = Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_b").agg(F.sum(n).alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    return df.withColumn("_in", F.sum(n).over(within)).join(sums, [*keys, "_b"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


def ranked_counts(long: DataFrame) -> DataFrame:
    """feature, grp, value, n, ties (rows of the value), rank (average rank of the value in the feature)."""
    counts = long.groupBy("feature", "grp", "value").agg(F.count(F.lit(1)).alias("n"))
    values = blocked(counts.groupBy("feature", "value").agg(F.sum("n").alias("ties")))
    ranks = running(values, ["feature"], "ties", "_upto").select("feature", "value", "ties", (F.col("_upto") - (F.col("ties") - 1) / 2.0).alias("rank"))
    return counts.join(ranks, ["feature", "value"])


def anova(long: DataFrame) -> DataFrame:
    """feature, n, k, f, p, eta2 (between over total sum of squares)."""
    g = long.groupBy("feature", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    t = t.withColumn("between", F.greatest(F.lit(0.0), F.col("q") - F.col("n") * F.col("mean") * F.col("mean")))
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.try_divide(F.col("within"), (F.col("n") - F.col("k")).cast("double")))
    eta = F.try_divide(F.col("between"), F.col("between") + F.col("within"))
    t = t.where("k >= 2").withColumn("f", f)
    p = f_tail(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))
    return t.select("feature", "n", "k", "f", p.alias("p"), eta.alias("eta2"))


def kruskal(long: DataFrame) -> DataFrame:
    """feature, n, k, h (tie corrected), p, epsilon2 = max(0, (h - k + 1) / (n - k))."""
    r = ranked_counts(long)
    g = r.groupBy("feature", "grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    ties = r.select("feature", "value", "ties").distinct().groupBy("feature").agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"))
    s = g.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).join(ties, "feature").where("k >= 2")
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.try_divide(F.col("t"), n * n * n - n))
    s = s.withColumn("h", h)
    eps = F.greatest(F.lit(0.0), F.try_divide(F.col("h") - F.col("k") + 1, n - F.col("k")))
    return s.select("feature", "n", "k", "h", chi2_tail(F.col("h"), (F.col("k") - 1).cast("double")).alias("p"), eps.alias("epsilon2"))


def dunn(long: DataFrame) -> DataFrame:
    """feature, a, b, z (tie corrected), p for every two groups a < b: from mean ranks and counts, no group is gathered."""
    r = ranked_counts(long)
    g = r.groupBy("feature", "grp").agg(F.sum("n").cast("double").alias("n"), (F.sum(F.col("n") * F.col("rank")) / F.sum("n")).alias("mean"))
    t = r.select("feature", "value", "ties").distinct().groupBy("feature").agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"), F.sum("ties").cast("double").alias("nn"))
    a, b = (g.select("feature", F.col("grp").alias(k), F.col("n").alias(f"n_{k}"), F.col("mean").alias(f"m_{k}")) for k in "ab")
    pairs = a.join(b, "feature").where("a < b").join(t, "feature")
    var = (F.col("nn") * (F.col("nn") + 1) / 12 - F.try_divide(F.col("t"), 12 * (F.col("nn") - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    z = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(var))
    return pairs.withColumn("z", z).select("feature", "a", "b", "z", normal_two_sided(F.col("z")).alias("p"))


def mann_whitney_one_vs_rest(long: DataFrame) -> DataFrame:
    """feature, grp, n1, n2, u, r (rank biserial, 2U / n1 n2 - 1), z (tie and continuity corrected), p of each group against all others.

    U follows from the group's rank sum, so all groups share one ranking of the feature.
    """
    ranks = ranked_counts(long)
    g = ranks.groupBy("feature", "grp").agg(F.sum("n").alias("n1"), F.sum(F.col("n") * F.col("rank")).alias("r1"))
    ties = ranks.select("feature", "value", "ties").distinct().groupBy("feature").agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"), F.sum("ties").alias("n"))
    s = g.join(ties, "feature").withColumn("n2", F.col("n") - F.col("n1")).where("n2 > 0")
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("n").cast("double")
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("t"), n * (n - 1)))
    off = F.col("u") - n1 * n2 / 2
    z = F.try_divide(F.signum(off) * F.greatest(F.lit(0.0), F.abs(off) - 0.5), F.sqrt(var))
    s = s.withColumn("z", z)
    return s.select("feature", "grp", "n1", "n2", "u", (2 * F.col("u") / (n1 * n2) - 1).alias("r"), "z", normal_two_sided(F.col("z")).alias("p"))


def benjamini_hochberg(tests: DataFrame, p: str, within: Sequence[str] = (), key: Sequence[str] = ("feature",)) -> DataFrame:
    """Adds p_adj; a null p counts as 1. One row per test: thousands at most, ordered within each family."""
    w = Window.partitionBy(*within)
    up = w.orderBy(F.col("_p"), *key)
    down = w.orderBy(F.desc("_p"), *[F.desc(k) for k in key]).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tests.withColumn("_p", F.coalesce(F.nanvl(F.col(p), F.lit(1.0)), F.lit(1.0))).withColumn("_r", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(w))
    raw = F.col("_p") * F.col("_n") / F.col("_r")
    return ranked.withColumn("_raw", raw).withColumn("p_adj", F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_p", "_r", "_n", "_raw")


def cliffs_delta(long: DataFrame) -> DataFrame:
    """feature, a, b, delta, magnitude for every two groups a < b, from the rank sums of merged counts: no pair of rows is built.

    The number of groups is that of the strain codes; for two groups, wins and losses come from the
    running counts of b at each value of a.
    """
    counts = long.groupBy("feature", "grp", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature", "grp").agg(F.sum("n").alias("total"))
    names = F.collect_set("grp")
    groups = counts.groupBy("feature").agg(names.alias("groups"))
    # each value row, with the running count of every group up to and at the value
    per_value = blocked(counts.groupBy("feature", "value").agg(F.map_from_entries(F.collect_list(F.struct("grp", "n"))).alias("here"))).join(groups, "feature")
    rows = per_value.select("feature", "value", "_b", "here", F.explode("groups").alias("b"))
    rows = rows.withColumn("nb", F.coalesce(F.element_at("here", F.col("b")), F.lit(0)))
    rows = running(rows, ["feature", "b"], "nb", "_upto").withColumn("below", F.col("_upto") - F.col("nb")).select("feature", "b", "below", "nb", F.explode("here").alias("a", "na")).where("a < b")
    sums = rows.groupBy("feature", "a", "b").agg(F.sum(F.col("na") * F.col("below")).alias("wins"), F.sum(F.col("na") * F.col("nb")).alias("even"))
    ta, tb = totals.select("feature", F.col("grp").alias("a"), F.col("total").alias("n_a")), totals.select("feature", F.col("grp").alias("b"), F.col("total").alias("n_b"))
    joined = sums.join(ta, ["feature", "a"]).join(tb, ["feature", "b"])
    all_pairs = F.col("n_a").cast("double") * F.col("n_b")
    delta = (2 * F.col("wins") + F.col("even")) / all_pairs - 1
    size = F.abs(F.col("delta"))
    return joined.withColumn("delta", delta).select(
        "feature", "a", "b", "delta", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large").alias("magnitude")
    )


def cohens_d_one_vs_rest(long: DataFrame) -> DataFrame:
    """feature, grp, d: difference of means over the pooled deviation, of each group against the rest; null without deviation."""
    g = long.groupBy("feature", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("feature")
    n_all, s_all = F.sum("n").over(w), F.sum(F.col("n") * F.col("m")).over(w)
    q_all = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))).over(w)
    r = g.withColumn("n2", n_all - F.col("n")).withColumn("m2", (s_all - F.col("n") * F.col("m")) / F.nullif(n_all - F.col("n"), F.lit(0)))
    r = r.withColumn("ss2", q_all - F.col("n") * (F.col("v") + F.col("m") * F.col("m")) - F.col("n2") * F.col("m2") * F.col("m2"))
    pooled = F.sqrt((F.col("n") * F.col("v") + F.col("ss2")) / F.nullif(F.col("n") + F.col("n2") - 2, F.lit(0)))
    return r.where("n >= 2 and n2 >= 2").select("feature", "grp", F.try_divide(F.col("m") - F.col("m2"), pooled).alias("d"))


def top_by_size(effects: DataFrame, per: str, size: str, k: int, ties: str = "feature") -> DataFrame:
    """The k largest by absolute value within each ``per``; Spark keeps k a task before it moves them."""
    w = Window.partitionBy(per).orderBy(F.desc(F.abs(size)), ties)
    return effects.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, rows, cols, chi2, dof, p of the table of two columns; a 2 x 2 table is corrected by Yates."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra, cb = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("total"))
    grid = ra.crossJoin(cb).crossJoin(F.broadcast(total)).join(cells, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    expected = F.col("ra") * F.col("cb") / F.col("total").cast("double")
    off = F.abs(F.col("n") - F.col("e"))
    s = grid.withColumn("e", expected).agg(
        F.max("total").alias("n"),
        F.count_distinct("a").alias("rows"),
        F.count_distinct("b").alias("cols"),
        F.sum(off * off / F.col("e")).alias("plain"),
        F.sum(F.pow(off - F.least(F.lit(0.5), off), F.lit(2)) / F.col("e")).alias("yates"),
    )
    s = s.withColumn("dof", (F.col("rows") - 1) * (F.col("cols") - 1)).withColumn("chi2", F.when(F.col("dof") == 1, F.col("yates")).otherwise(F.col("plain")))
    return s.select("n", "rows", "cols", "chi2", "dof", chi2_tail(F.col("chi2"), F.col("dof").cast("double")).alias("p"))


def fisher_one_vs_rest(df: DataFrame, group: str, trait: str) -> DataFrame:
    """grp, trait, a, b, c, d, p: for each group and trait, the group's rows with and without it, and all others' (rows with a null are left out).

    Only counts are compared: a row per group and trait.
    """
    cells = df.where(F.col(group).isNotNull() & F.col(trait).isNotNull()).groupBy(F.col(group).alias("grp"), F.col(trait).alias("trait")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy("grp").agg(F.sum("n").alias("row")), cells.groupBy("trait").agg(F.sum("n").alias("col"))
    total = cells.agg(F.sum("n").alias("total"))
    grid = rows.crossJoin(cols).crossJoin(F.broadcast(total)).join(cells, ["grp", "trait"], "left").withColumn("a", F.coalesce("n", F.lit(0)))
    full = grid.select("grp", "trait", "a", (F.col("row") - F.col("a")).alias("b"), (F.col("col") - F.col("a")).alias("c"), (F.col("total") - F.col("row") - F.col("col") + F.col("a")).alias("d"))
    return full.withColumn("p", fisher_p("a", "b", "c", "d"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, ari, nmi (arithmetic mean) of two labelings, from their table of counts."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def pairs(d: DataFrame) -> DataFrame:
        return d.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("c2"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nl"))

    t = pairs(cells)
    x, y = pairs(cells.groupBy("a").agg(F.sum("n").alias("n"))), pairs(cells.groupBy("b").agg(F.sum("n").alias("n")))
    j = t.crossJoin(x.select(F.col("c2").alias("ca"), F.col("nl").alias("la"))).crossJoin(y.select(F.col("c2").alias("cb"), F.col("nl").alias("lb")))
    n = F.col("n")
    expected = F.try_divide(F.col("ca") * F.col("cb"), n * (n - 1) / 2)
    ari = F.try_divide(F.col("c2") - expected, (F.col("ca") + F.col("cb")) / 2 - expected)
    ha, hb = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    mutual = (F.col("nl") - F.col("la") - F.col("lb")) / n + F.log(n)
    return j.select(n.cast("long").alias("n"), ari.alias("ari"), F.try_divide(mutual, (ha + hb) / 2).alias("nmi"))
