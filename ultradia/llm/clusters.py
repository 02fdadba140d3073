"""Similarity clusters: neighbour descent, modularity communities, typical members.

Records fall into grid cells so small that all records of a cell are linked; each cell is one node with
the number of its records, at a record of its own. ``neighbour_graph`` finds approximate nearest
neighbours within the radius by neighbour descent: neighbours of a node are likely neighbours of one
another. ``communities`` moves nodes between communities, then communities between larger
ones, until modularity grows no more. Communities that an edge of the graph joins belong together;
``links_across`` compares the records of cells that this leaves apart, which makes the groups exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ultradia.operators.linking import Written, axis_names, cell_keys, cells_of, distance2, links_across, relabelled
from ultradia.session import Scratch, written

NEIGHBOURS = 6
#: Neighbours of a point that one round of descent pairs with one another.
PAIRED = 6
#: Sweeps of local moving, and rounds of merging, after which it stops even if something still gains.
SWEEPS, LEVELS = 10, 40


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u; ties by v."""
    w = Window.partitionBy("u").orderBy("d2", "v")
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def neighbour_graph(points: DataFrame, radius: float, written: Written, k: int = NEIGHBOURS, rounds: int = 2, share: int = 500) -> DataFrame:
    """u, v, d2 (both directions): up to k near points within the radius of each point, by neighbour descent.

    It starts from chance neighbours: those next to one another along one axis in a narrow column
    of space, for each axis; a column with more than ``share`` points is divided into shares by hash. Each round pairs up to PAIRED
    neighbours of every point with one another and keeps each point's k nearest.
    """
    names = axis_names(points)
    here = F.struct("id", *names)
    found = None
    for shift in range(max(3, len(names))):
        along = shift % len(names)
        sides = [radius * (4 if i == along else 0.5) for i in range(len(names))]
        cell = [F.floor((F.col(n) + shift * side / 3) / side).alias(f"c{i}") for i, (n, side) in enumerate(zip(names, sides))]
        keyed = points.select("id", *names, *cell)
        cs = [f"c{i}" for i in range(len(names))]
        sizes = keyed.groupBy(*cs).agg(F.count(F.lit(1)).alias("_n"))
        salted = keyed.join(sizes, cs).withColumn("_salt", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.expr(f"_n div {share}"))))
        w = Window.partitionBy(*cs, "_salt").orderBy(names[along], "id")
        ahead = salted.select(here.alias("a"), F.lead(here, 1).over(w).alias("b1"), F.lead(here, 2).over(w).alias("b2"), F.lead(here, 3).over(w).alias("b3"))
        pairs = ahead.select("a", F.explode(F.array("b1", "b2", "b3")).alias("b")).where("b is not null")
        found = pairs if found is None else found.unionByName(pairs)

    def graph(pairs: DataFrame) -> DataFrame:
        close = pairs.withColumn("d2", distance2("a", "b", names)).where(F.col("d2") <= radius * radius)
        both = close.select("a", "b", "d2").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "d2"))
        return nearest(both.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), "a", "b", "d2").dropDuplicates(["u", "v"]), k)

    edges = written(graph(found), "neighbours")
    for i in range(rounds):
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("b").alias("a"), F.col("a").alias("b"), "d2")
        near = edges.unionByName(back).dropDuplicates(["u", "v"])
        w = Window.partitionBy("u").orderBy(F.xxhash64("v", F.lit(i)))
        lists = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= PAIRED).groupBy("u").agg(F.collect_list("b").alias("near"))
        met = lists.select(F.posexplode("near").alias("i", "a"), "near").select("a", F.explode(F.expr("slice(near, i + 2, size(near))")).alias("b"))
        edges = written(graph(met.unionByName(edges.select("a", "b"))), "neighbours")
    both = edges.select("u", "v", "d2").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d2"))
    return both.dropDuplicates(["u", "v"])


def _kernel(d2: Column, radius: float) -> Column:
    return F.exp(-d2 / F.lit((radius / 2) ** 2))


def _moved(edges: DataFrame, temp: Written, sweeps: int = SWEEPS, still: float = 0.05) -> DataFrame:
    """id, c: labels after local moving over symmetric edges u, v, w (loops: u = v, both ends in w), until two sweeps move at most ``still`` of the nodes.

    Half of the nodes, by hash, may move at a time, or two neighbours would swap for ever. What still
    could move moves on the next level, with its community.
    """
    labels = temp(edges.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).select("id", "k", F.col("id").alias("c"), F.xxhash64("id").alias("h")), "labels")
    total = labels.agg(F.sum("k").alias("m2"))
    size, before = labels.count(), None
    for _ in range(sweeps):
        sums = labels.groupBy("c").agg(F.sum("k").alias("tot"))
        full = labels.join(sums, "c").crossJoin(F.broadcast(total))
        to = edges.where("u != v").join(full.select(F.col("id").alias("v"), "c", "tot"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"), F.first("tot").alias("tot"))
        own = full.where(F.pmod("h", F.lit(2)) == 0).select(F.col("id").alias("u"), "k", F.col("c").alias("own"), F.col("tot").alias("own_tot"), "m2")
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.col("m2")
        best = to.join(own, "u").withColumn("gain", gain).groupBy("u").agg(
            F.max(F.struct("gain", (-F.col("c")).alias("minus_c"))).alias("best"),
            F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"),
            F.first(F.struct("k", "own_tot", "m2")).alias("o"),
        )
        stay = F.coalesce("stay", -F.col("o.k") * (F.col("o.own_tot") - F.col("o.k")) / F.col("o.m2"))
        new = best.where(F.col("best.gain") > stay + 1e-9 * F.col("o.k")).select(F.col("u").alias("id"), (-F.col("best.minus_c")).alias("new"))
        labels = temp(labels.join(new, "id", "left").select("id", "k", F.coalesce("new", "c").alias("c"), F.xxhash64("h").alias("h"), F.col("new").isNotNull().alias("moved")), "labels")
        moved = labels.where("moved").count()
        labels = labels.drop("moved")
        if before is not None and before + moved <= still * size:
            break
        before = moved
    return labels.select("id", "c")


def _merged(edges: DataFrame, temp: Written) -> DataFrame:
    """id, c: pairs of communities that gain most by one another (symmetric edges u, v, w with loops); the best pair of all always is one."""
    total = edges.agg(F.sum("w").alias("m2"))
    strength = edges.groupBy("u").agg(F.sum("w").alias("k"))
    pairs = edges.where("u != v").join(strength, "u").join(strength.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v").crossJoin(F.broadcast(total))
    gains = pairs.select("u", "v", (F.col("w") - F.col("k") * F.col("kv") / F.col("m2")).alias("gain"), (F.col("m2") * 1e-9).alias("least")).where("gain > least")
    best = gains.groupBy("u").agg(F.max_by("v", F.struct("gain", -F.least("u", "v"), -F.greatest("u", "v"))).alias("v"))
    mutual = best.join(best.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"])
    return temp(mutual.where("u > v").select(F.col("u").alias("id"), F.col("v").alias("c")), "merged")


def communities(nodes: DataFrame, graph: DataFrame, radius: float, temp: Written) -> DataFrame:
    """id, c for every node (id, n): communities by modularity; local moving of nodes, then merging of communities until no pair gains.

    A graph edge weighs as its nodes' records times exp(-d2 / (radius / 2) ^ 2), a node with itself
    as its pairs of records at the mean distance of a cell. Labels move along edges only, so a
    community never reaches over a gap in the graph. Nodes without edges are on their own.
    """
    weight = nodes.select("id", F.col("n").cast("double").alias("n"))
    between = graph.join(weight.select(F.col("id").alias("u"), F.col("n").alias("a")), "u").join(weight.select(F.col("id").alias("v"), F.col("n").alias("b")), "v")
    loops = weight.where("n > 1").select(F.col("id").alias("u"), F.col("id").alias("v"), (F.col("n") * (F.col("n") - 1) * _kernel(F.lit(radius * radius / 6), radius)).alias("w"))
    edges = temp(between.select("u", "v", (F.col("a") * F.col("b") * _kernel(F.col("d2"), radius)).alias("w")).unionByName(loops), "weights")
    labels = nodes.select("id", F.col("id").alias("c"))
    step = _moved(edges, temp)
    for _ in range(LEVELS):
        labels = temp(labels.join(step.select(F.col("id").alias("c"), F.col("c").alias("new")), "c", "left").select("id", F.coalesce("new", "c").alias("c")), "communities")
        ends = edges.join(step.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u", "left").join(step.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v", "left")
        edges = temp(ends.groupBy(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).agg(F.sum("w").alias("w")), "lifted")
        step = _merged(edges, temp)
        if not step.limit(1).count():
            break
    return labels


def placed_records(rows: DataFrame, key: str, coords: Sequence[str]) -> DataFrame:
    """id (the key), p0, p1, ... of the rows with a key and all coordinates (no null, NaN or number beyond 1e300)."""
    ps = [F.col(c).cast("double") for c in coords]
    ok = F.col(key).isNotNull()
    for c in ps:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    return rows.where(ok).select(F.col(key).cast("long").alias("id"), *[(c + F.lit(0.0)).alias(f"p{i}") for i, c in enumerate(ps)])


def grouped_cells(records: DataFrame, radius: float, least: int, temp: Written) -> tuple[DataFrame, DataFrame]:
    """The cells with group, community, cluster_id and size of the groups of ``least`` records or more, and the graph of their nodes."""
    nodes = temp(cells_of(records, radius), "nodes")
    graph = temp(neighbour_graph(nodes, radius, temp), "graph")
    found = communities(nodes, graph, radius, temp)
    at = found.select("id", "c")
    joined = graph.select("u", "v").join(at.select(F.col("id").alias("u"), F.col("c").alias("a")), "u").join(at.select(F.col("id").alias("v"), F.col("c").alias("b")), "v")
    groups = relabelled(found, joined.where("a != b").select("a", "b").distinct(), temp)
    cells = temp(nodes.join(groups, "id"), "cells")
    groups = relabelled(groups, links_across(records, cells, radius, temp), temp)
    full = nodes.join(groups.withColumnRenamed("c", "grp"), "id").join(found.withColumnRenamed("c", "community"), "id")
    sizes = full.groupBy("grp").agg(F.sum("n").alias("size"), F.min("id").alias("cluster_id")).where(F.col("size") >= least)
    return temp(full.join(sizes, "grp").drop("grp"), "grouped"), graph


def similar_groups(rows: DataFrame, key: str, coords: Sequence[str], radius: float, least: int) -> DataFrame:
    """One row per row of the input in a group of at least ``least`` rows: key, cluster_id, size, community.

    Two rows belong together if their Euclidean distance is at most the radius or a chain of such
    rows joins them; cluster_id is the smallest key of the group. community is the modularity
    community within it (smallest key). Rows with a null key, or a null or NaN coordinate, are left
    out; rows of equal coordinates are members each; other columns do not matter. No rows, no groups.
    """
    temp = Scratch()
    records = placed_records(rows, key, coords)
    cells, _ = grouped_cells(records, radius, least, temp)
    cs = [f"c{i}" for i in range(len(coords))]
    known = written(cells.select(*cs, "cluster_id", "size", "community"), "labels")
    temp.clear()
    return records.select(F.col("id").alias(key), *cell_keys(axis_names(records), radius)).join(known, cs).select(key, "cluster_id", "size", "community")


def described(rows: DataFrame, key: str, coords: Sequence[str], radius: float, least: int, typical: int = 3) -> DataFrame:
    """One row per community: cluster_id, cluster_size, community, size, typical: its members of highest weighted degree within it, ties by key.

    The degree of a record sums, over the nodes of its community that the graph joins to its own node, their records by nearness.
    The best few are kept per cell first, then per share of a community, so no community is one task's.
    """
    temp = Scratch()
    records = placed_records(rows, key, coords)
    cells, graph = grouped_cells(records, radius, least, temp)
    names = axis_names(records)
    cs = [f"c{i}" for i in range(len(names))]
    inside = cells.select(F.col("id").alias("v"), F.col("community").alias("cv"), F.struct("n", *names).alias("to"))
    own = cells.select(F.col("id").alias("u"), "community", F.struct("n", *names).alias("to"))
    near = graph.select("u", "v").join(inside, "v").join(own.select("u", "community"), "u").where("cv = community").select("u", "to").unionByName(own.select("u", "to"))
    around = near.groupBy(F.col("u").alias("id")).agg(F.collect_list("to").alias("around"))  # at most NEIGHBOURS x directions + 1 each
    at = records.withColumnRenamed("id", "_key").select("_key", *[F.col(n).alias(f"x{n}") for n in names], *cell_keys(names, radius))
    joined = at.join(cells.select(*cs, "id", "cluster_id", F.col("size").alias("cluster_size"), "community").join(around, "id"), cs)

    def pull(s: Column, t: Column) -> Column:
        d2 = sum(((F.col(f"x{n}") - t[n]) ** 2 for n in names), F.lit(0.0))
        return s + t["n"] * _kernel(d2, radius)

    scored = joined.withColumn("degree", F.aggregate("around", F.lit(0.0), pull)).select("_key", "cluster_id", "cluster_size", "community", "degree")
    rank = F.struct((-F.col("degree")).alias("d"), F.col("_key").alias("k"))
    w = Window.partitionBy("community", "_salt").orderBy(F.desc("degree"), "_key")
    best = scored.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(64))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= typical)
    best = best.groupBy("community").agg(F.slice(F.sort_array(F.collect_list(rank)), 1, typical).alias("best"))
    sizes = cells.groupBy("cluster_id", F.col("size").alias("cluster_size"), "community").agg(F.sum("n").alias("size"), F.min("id").alias("first"))
    out = written(sizes.join(best, "community").select("cluster_id", "cluster_size", F.col("first").alias("community"), "size", F.transform("best", lambda b: b["k"]).alias("typical")), "described")
    temp.clear()
    return out
