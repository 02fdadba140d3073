"""Points, connected components and exact groups of points that chains of short distances join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Written = Callable[[DataFrame, str], DataFrame]


def points_of(rows: DataFrame, key: str, coords: Sequence[str]) -> DataFrame:
    """id (smallest key of the point), p0, p1, ...: one row per distinct point, n rows each; null or NaN in any coordinate: left out."""
    ps = [F.col(c).cast("double") for c in coords]
    ok = F.col(key).isNotNull()
    for c in ps:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    names = [f"p{i}" for i in range(len(coords))]
    return (
        rows.where(ok)
        .select(F.col(key).cast("long").alias("id"), *[(c + F.lit(0.0)).alias(n) for c, n in zip(ps, names)])
        .groupBy(*names)
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    )


def axis_names(points: DataFrame) -> list[str]:
    """p0, p1, ... of a table of points."""
    return sorted(c for c in points.columns if c.startswith("p") and c[1:].isdigit())


def distance2(a: str, b: str, names: Sequence[str]) -> Column:
    """Squared distance of two structs."""
    total = F.lit(0.0)
    for n in names:
        d = F.col(f"{a}.{n}") - F.col(f"{b}.{n}")
        total = total + d * d
    return total


def components(edges: DataFrame, written: Written, most: int = 40) -> DataFrame:
    """id, root (smallest id of its component) of every node of the edges a, b: large star and small star in turn.

    Each turn hangs nodes on smaller ones; the number of turns grows with the logarithm of the
    longest path. Only two numbers a turn reach the driver.
    """
    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = written(df, "links")
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, before = kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        now, after = kept(small.where("a != b").distinct())
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


def relabelled(labels: DataFrame, links: DataFrame, written: Written) -> DataFrame:
    """labels id, c with c replaced by the root of its component over links a, b."""
    roots = components(links, written).select(F.col("id").alias("c"), "root")
    return written(labels.join(roots, "c", "left").select("id", F.coalesce("root", "c").alias("c")), "groups")


def cell_keys(names: Sequence[str], radius: float) -> list[Column]:
    """c0, c1, ...: the grid cell of a point. Its side is radius / sqrt(dimensions), so any two points of a cell are within the radius."""
    side = radius / len(names) ** 0.5 * (1 - 1e-12)
    return [F.floor(F.col(n) / side).alias(f"c{i}") for i, n in enumerate(names)]


def cells_of(points: DataFrame, radius: float) -> DataFrame:
    """One row per grid cell of the points (id, p0, ..., and n if they have it): c0, ..., id (smallest), n, p0, ... (the point
    nearest the middle of the cell; ties: smallest id), low0, high0, ... (the box of its points). A partial aggregate comes first."""
    names = axis_names(points)
    keys = cell_keys(names, radius)
    cs = [f"c{i}" for i in range(len(names))]
    side = radius / len(names) ** 0.5
    off = sum(((F.col(n) - (F.col(c) + F.lit(0.5)) * side) ** 2 for n, c in zip(names, cs)), F.lit(0.0))
    at = points.select("id", (F.col("n") if "n" in points.columns else F.lit(1)).cast("long").alias("n"), *names, *keys)
    boxes = [f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("low", F.min), ("high", F.max))]
    grouped = at.groupBy(*cs).agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.min(F.struct(off.alias("off"), "id", *names)).alias("near"), *boxes)
    return grouped.select(*cs, "id", "n", *[F.col(f"near.{n}").alias(n) for n in names], *[f"{k}{i}" for i in range(len(names)) for k in ("low", "high")])


def _gap2(x: str, y: str, dims: int) -> Column:
    """Squared distance of two boxes (columns low0, high0, ... with prefixes)."""
    total = F.lit(0.0)
    for i in range(dims):
        g = F.greatest(F.lit(0.0), F.col(f"{x}low{i}") - F.col(f"{y}high{i}"), F.col(f"{y}low{i}") - F.col(f"{x}high{i}"))
        total = total + g * g
    return total


def near_cells(cells: DataFrame, radius: float) -> DataFrame:
    """x, y (cells with different c whose boxes are within the radius), each pair once. The cells of the most frequent c only answer."""
    dims = len(axis_names(cells))
    wide = 2 * radius
    top = cells.groupBy("c").count().orderBy(F.desc("count"), "c").limit(1).select(F.col("c").alias("_top"))
    marked = cells.join(F.broadcast(top), F.col("c") == F.col("_top"), "left").withColumn("asks", F.col("_top").isNull()).drop("_top")
    ws = [f"w{i}" for i in range(dims)]

    def placed(df: DataFrame, name: str, margin: float) -> DataFrame:
        out = df.select(F.struct(*cells.columns, "asks").alias(name), *[F.sequence(F.floor((F.col(f"low{i}") - margin) / wide), F.floor((F.col(f"high{i}") + margin) / wide)).alias(f"s{i}") for i in range(dims)])
        for i in range(dims):
            out = out.withColumn(f"w{i}", F.explode(f"s{i}"))
        return out.select(name, *ws)

    both = placed(marked.where("asks"), "x", radius).join(placed(marked, "y", 0.0), ws)
    once = (F.col("x.c") != F.col("y.c")) & (~F.col("y.asks") | (F.col("x.id") < F.col("y.id")))
    return both.where(once & (_gap2("x.", "y.", dims) <= radius * radius * (1 + 1e-9))).select("x", "y").dropDuplicates(["x", "y"])


def links_across(points: DataFrame, cells: DataFrame, radius: float, written: Written, fineness: int = 8) -> DataFrame:
    """a, b: the labels c of cells that some pair of points within the radius joins, however many points they hold.

    Of the cells near one another with different labels, the points are put into boxes (``fineness`` a
    side). Two boxes whose sample points are within the radius settle their labels; only of
    boxes that leave it open are the points compared, and of these only those within the radius of the other box.
    """
    names = axis_names(points)
    dims = len(names)
    limit, slack = radius * radius, radius * radius * (1 + 1e-9)
    near = written(near_cells(cells, radius), "near")
    cs = [f"c{i}" for i in range(dims)]
    box = [f"{k}{i}" for i in range(dims) for k in ("low", "high")]
    met = near.select("x.*").unionByName(near.select("y.*")).select(*cs, F.col("id").alias("cell")).distinct()
    fine = radius / dims**0.5 / fineness
    at = written(points.select("id", *names, *cell_keys(names, radius)).join(met, cs).select("cell", F.xxhash64(*[F.floor(F.col(n) / fine) for n in names]).alias("part"), "id", *names), "boundary")
    parts = at.groupBy("cell", "part").agg(F.min(F.struct("id", *names)).alias("q"), *[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("low", F.min), ("high", F.max))])
    pairs = near.select(F.col("x.id").alias("xid"), F.col("y.id").alias("yid"), F.col("x.c").alias("a"), F.col("y.c").alias("b"), *[F.col(f"y.{c}").alias(f"y{c}") for c in box])
    left = pairs.join(parts.select(F.col("cell").alias("xid"), F.col("part").alias("xpart"), F.col("q").alias("xq"), *[F.col(c).alias(f"x{c}") for c in box]), "xid").where(_gap2("x", "y", dims) <= slack)
    left = left.drop(*[f"y{c}" for c in box])
    right = parts.select(F.col("cell").alias("yid"), F.col("part").alias("ypart"), F.col("q").alias("yq"), *[F.col(c).alias(f"y{c}") for c in box])
    open_pairs = written(
        left.join(right, "yid").where(_gap2("x", "y", dims) <= slack).withColumn("sure", distance2("xq", "yq", names) <= limit).drop("xq", "yq"), "pairs"
    )
    sure = written(open_pairs.where("sure").select("a", "b").distinct(), "sure")
    rest = open_pairs.join(sure, ["a", "b"], "left_anti").drop("sure")

    def off2(side: str) -> Column:
        total = F.lit(0.0)
        for i, n in enumerate(names):
            g = F.greatest(F.lit(0.0), F.col(f"{side}low{i}") - F.col(n), F.col(n) - F.col(f"{side}high{i}"))
            total = total + g * g
        return total

    ours = rest.join(at.select(F.col("cell").alias("xid"), F.col("part").alias("xpart"), *names), ["xid", "xpart"]).where(off2("y") <= slack)
    ours = ours.select("a", "b", "yid", "ypart", F.struct(*names).alias("p"))
    theirs = at.select(F.col("cell").alias("yid"), F.col("part").alias("ypart"), F.struct(*names).alias("q"))
    exact = ours.join(theirs, ["yid", "ypart"]).where(distance2("p", "q", names) <= limit).select("a", "b").distinct()
    return sure.unionByName(exact)


def linked_groups(points: DataFrame, radius: float, written: Written) -> DataFrame:
    """id, c: the exact groups of points that chains of pairs within the radius join.

    Points of a grid cell are joined at once; then cells whose sample points are within the radius; then, of
    the groups that leaves apart, whatever ``links_across`` finds.
    """
    names = axis_names(points)
    cells = written(cells_of(points, radius).withColumn("c", F.col("id")), "cells")
    first = written(near_cells(cells, radius), "near").where(distance2("x", "y", names) <= radius * radius).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    labels = relabelled(cells.select("id", "c"), first, written)
    cells = written(cells.drop("c").join(labels, "id"), "cells")
    labels = relabelled(labels, links_across(points, cells, radius, written), written)
    cs = [f"c{i}" for i in range(len(names))]
    known = cells.select("id", *cs).join(labels, "id").select(*cs, "c")
    return points.select("id", *cell_keys(names, radius)).join(known, cs).select("id", "c")
