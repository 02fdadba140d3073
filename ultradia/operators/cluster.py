"""Density clusters and measures of clusterings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.linking import axis_names, distance2, linked_groups, points_of
from ultradia.session import written


def dbscan(rows: DataFrame, key: str, coords: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """key and cluster (smallest key of its core points; -1 for noise) of every row with all coordinates.

    A point is core with at least ``min_samples`` rows within eps, itself included. A grid cell of side eps / sqrt(d) with
    that many rows makes all its points core without a comparison; only points of thinner
    cells are compared with the cells around. Core points are then linked exactly; a
    border point joins the cluster of its nearest core point (ties: smallest cluster).
    """
    points = written(points_of(rows, key, coords), "points")
    names = axis_names(points)
    side = eps / len(names) ** 0.5 * (1 - 1e-12)
    cells = [f"c{i}" for i in range(len(names))]
    at = points.select("id", "n", *names, *[F.floor(F.col(n) / side).alias(c) for n, c in zip(names, cells)])
    sizes = at.groupBy(*cells).agg(F.sum("n").alias("_all"))
    at = written(at.join(sizes, cells), "cells")
    reach = int(len(names) ** 0.5) + 1
    around = at.where(F.col("_all") < min_samples).select(F.struct("id", *names).alias("a"), *[F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)).alias(c) if i == 0 else F.col(c) for i, c in enumerate(cells)])
    for c in cells[1:]:
        around = around.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
    near = around.join(at.select(F.struct("id", "n", *names).alias("b"), *cells), cells).where(distance2("a", "b", names) <= eps * eps)
    counted = near.groupBy(F.col("a.id").alias("id")).agg(F.sum("b.n").alias("k")).where(F.col("k") >= min_samples).select("id")
    core = written(at.where(F.col("_all") >= min_samples).select("id").unionByName(counted), "core")
    cores = written(points.join(core, "id"), "cores")
    groups = linked_groups(cores, eps, written)
    border = near.join(groups.select(F.col("id").alias("_b"), "c"), F.col("b.id") == F.col("_b"))
    joined = border.groupBy(F.col("a.id").alias("id")).agg(F.min(F.struct(distance2("a", "b", names).alias("d"), "c")).alias("m")).select("id", F.col("m.c").alias("c"))
    outer = joined.join(groups, "id", "left_anti")
    labels = groups.unionByName(outer)
    known = points.join(labels, "id", "left").select(*names, F.coalesce("c", F.lit(-1)).alias("cluster"))
    mine = rows.select(F.col(key), *[(F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip(coords, names)])
    return mine.join(known, names).select(key, "cluster")


def centroid_measures(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: n, clusters, calinski_harabasz, davies_bouldin over rows with a label and a whole vector; null with fewer than two clusters.

    All dimensions count: a vector that is shorter than the longest, or has a null or NaN in it, is left out. Centroids come from one
    aggregate per label and dimension, the mean distances to them from a second pass; only centroids are compared with one another.
    """
    labelled = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    longest = labelled.agg(F.max(F.size("x")).alias("_size"))
    ok = labelled.crossJoin(F.broadcast(longest)).where((F.size("x") == F.col("_size")) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x))).select("g", "x")

    def apart(a: str, b: str) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    parts = ok.select("g", F.posexplode("x").alias("i", "x")).groupBy("g", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    centers = parts.groupBy("g").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"), F.sum("v").alias("v"))
    spread = ok.join(centers.select("g", "m"), "g").groupBy("g").agg(F.avg(apart("x", "m")).alias("s"))
    known = centers.join(spread, "g")
    a, b = (known.select(F.col("g").alias(f"g{k}"), F.col("s").alias(f"s{k}"), F.col("m").alias(f"m{k}")) for k in "ab")
    worst = a.join(b, F.col("ga") != F.col("gb")).groupBy("ga").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), apart("ma", "mb"))).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))
    grand = parts.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    off = F.col("m") - F.col("grand")
    between = parts.join(grand, "i").agg(F.sum(F.col("n") * off * off).alias("between"))
    sums = centers.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum(F.col("n") * F.col("v")).alias("within"))
    ch = F.try_divide(F.col("between") * (F.col("n") - F.col("clusters")), F.col("within") * (F.col("clusters") - 1))
    return (
        sums.crossJoin(between)
        .crossJoin(db)
        .select("n", "clusters", F.when(F.col("clusters") >= 2, ch).alias("calinski_harabasz"), F.when(F.col("clusters") >= 2, F.col("davies_bouldin")).alias("davies_bouldin"))
    )


def knee_of(distances: DataFrame, value: str) -> DataFrame:
    """One row: eps, the value at the largest second difference of the sorted values (first of equals); null with fewer than 3.

    The curve is taken at its thousandths (1,001 exact percentiles), so what is sorted at the end does not grow.
    """
    at = [i / 1000 for i in range(1001)]
    curve = distances.agg(F.percentile(value, F.array(*[F.lit(x) for x in at])).alias("q"), F.count(value).alias("n")).select("n", F.posexplode("q").alias("i", "d"))
    w = Window.orderBy("i")
    bend = F.lead("d").over(w) - 2 * F.col("d") + F.lag("d").over(w)
    return curve.withColumn("bend", bend).where("bend is not null and n >= 3").agg(F.max_by("d", F.struct("bend", -F.col("i"))).alias("eps"))
