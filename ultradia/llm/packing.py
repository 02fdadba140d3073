"""Items packed into containers of fixed capacity: non-negative least squares on the histogram of lengths.

1. Count the items of each length (a histogram of at most capacity + 1 numbers: all the driver sees).
2. Enumerate the combinations of at most three lengths that fill a container, and solve for how often to
   repeat each so that together they use up the histogram: non-negative least squares.
3. Round the counts down, and pack the residual histogram greedily, longest first, each length into
   the fullest kind of container that still has room.
4. Every kind of container and its count fix, for each length, which ranks of the items go where;
   Spark ranks the items of each length and looks their containers up.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ultradia.session import written

#: Rows of one length that one task ranks; a length that more items share is ranked in shares.
SHARE = 250_000


def combinations(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the lengths that fill the capacity exactly: rows of three, longest first, 0 where there is none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    a = np.flatnonzero(there)[None, :]
    b = np.flatnonzero(there)[:, None]
    c = capacity - a - b
    fit = (a >= b) & (b >= c) & (c >= 0)
    at_b, at_a = np.nonzero(fit)
    out = np.column_stack([a[0, at_a], b[at_b, 0], c[at_b, at_a]])
    return out[there[out[:, 2]] & (out[:, 0] > 0)]


def solve_nnls(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, h: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that minimises |A x - h|, A sparse by triples; accelerated projected gradient."""
    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, vals * x[cols], len(h))

    def back(y: np.ndarray) -> np.ndarray:
        return np.bincount(cols, vals * y[rows], n)

    v = np.ones(n)
    for _ in range(30):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm or 1.0
    step = 1.0 / (1.05 * norm or 1.0)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(times(y) - h))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        if (new - x) @ (y - new) > 0:
            y, t_new = new, 1.0
        x, t = new, t_new
    return x


def greedy_kinds(histogram: Counter, capacity: int) -> list[tuple[Counter, int]]:
    """Kinds of containers (lengths with their counts, and how many of the kind) for a histogram: longest first, best fit."""
    open_by_room: dict[int, list[tuple[Counter, int]]] = {}
    rooms: list[int] = []

    def put(room: int, kind: Counter, count: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            heapq.heappush(rooms, room)
        open_by_room[room].append((kind, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in open_by_room if r >= length):
            while left and open_by_room[room]:
                kind, count = open_by_room[room].pop()
                fit = min(room // length, max(1, left // count))
                use = min(count, left // fit)
                if use < count:
                    open_by_room[room].append((kind, count - use))
                filled = Counter(kind)
                filled[length] += fit
                left -= fit * use
                put(room - fit * length, filled, use)
            if not open_by_room[room]:
                del open_by_room[room]
            if not left:
                break
        if left:
            fit = capacity // length
            if left >= fit:
                put(capacity - fit * length, Counter({length: fit}), left // fit)
            if left % fit:
                put(capacity - left % fit * length, Counter({length: left % fit}), 1)
    return [x for kinds in open_by_room.values() for x in kinds]


def plan_kinds(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """All kinds of containers with their counts; together they hold exactly the histogram. Lengths are 1 to capacity."""
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    kinds: list[tuple[Counter, int]] = []
    combos = combinations(np.array(sorted(left)), capacity) if left else np.zeros((0, 3), int)
    if len(combos):
        h = np.zeros(capacity + 1)
        h[list(left)] = list(left.values())
        col, part = np.nonzero(combos)
        x = solve_nnls(combos[col, part], col, np.ones(len(col)), len(combos), h)
        whole = np.flatnonzero(x >= 1 - 1e-6)
        for j in whole[np.argsort(-x[whole], kind="stable")]:
            combo = Counter(int(k) for k in combos[j] if k)
            count = min(int(x[j] + 1e-6), *(left[k] // c for k, c in combo.items()))
            if count > 0:
                kinds.append((combo, count))
                for k, c in combo.items():
                    left[k] -= c * count
    return kinds + greedy_kinds(+left, capacity)


def layout(kinds: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, items of the length a container, first container) of every kind and length.

    At most some thousands of rows for a capacity of 2,048, however many items: it depends on the
    number of lengths only.
    """
    out, used, container = [], Counter(), 0
    for kind, count in kinds:
        for length, each in sorted(kind.items()):
            out.append((length, used[length], used[length] + each * count, each, container))
            used[length] += each * count
        container += count
    return out


def pieces(items: DataFrame, key: str, length: str, capacity: int) -> DataFrame:
    """key, piece, token_start, n_tokens: an item as one piece; one longer than the capacity as full pieces and a rest."""
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    cut = items.select(F.col(key), n.alias("_n")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / capacity)).cast("int"))))
    start = F.col("piece").cast("long") * capacity
    return cut.select(key, "piece", start.alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - start).alias("n_tokens"))


def pack(items: DataFrame, key: str, length: str, capacity: int = 2048, share: int = SHARE) -> DataFrame:
    """Every piece with its container: key, piece, token_start, n_tokens, container_id, container_start.

    Items longer than the capacity are cut at multiples of it, no others; items of length 0 or null
    take no room and have null container_id and container_start. The pieces of a container lie one after the other from
    container_start 0. ``items`` is read twice (the histogram, the assignment), so give a written
    table. Keys that repeat are separate items. A length that many items share is ranked in shares of
    about ``share`` items, whose sizes (a row per length and share) give each share its first rank.
    No items, no rows.
    """
    spark = items.sparkSession
    cut = pieces(items, key, length, capacity)
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in cut.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = _table(spark, [(k, n // share + 1) for k, n in histogram.items()], "n_tokens long, _shares int")
    placed = cut.join(F.broadcast(split), "n_tokens", "left").withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    shares = placed.where("n_tokens > 0").groupBy("n_tokens", "_salt").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    where_first = shares.withColumn("_first", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    where_first = written(where_first, "shares")
    rows = layout(plan_kinds(histogram, capacity))
    where_first = where_first.drop("n")
    where_to = _table(spark, rows, "n_tokens long, _from long, _end long, _each long, _container long")
    rank = F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(key, "piece")) - 1
    sized = placed.where("n_tokens > 0").withColumn("_in", rank).join(F.broadcast(where_first), ["n_tokens", "_salt"])
    sized = sized.withColumn("_rank", F.col("_first") + F.col("_in")).drop("_first", "_in")
    found = sized.join(F.broadcast(where_to), (sized["n_tokens"] == where_to["n_tokens"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_end"))).drop(where_to["n_tokens"])
    found = found.withColumn("container_id", (F.col("_container") + F.expr("(_rank - _from) div _each")).cast("long"))
    inside = Window.partitionBy("container_id").orderBy(F.desc("n_tokens"), key, "piece", "_rank")
    before = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    full = found.withColumn("container_start", F.coalesce(before, F.lit(0)).cast("long"))
    out = [key, "piece", "token_start", "n_tokens", "container_id", "container_start"]
    empty = placed.where("n_tokens = 0").select(key, "piece", "token_start", "n_tokens", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("container_start"))
    return full.select(*out).unionByName(empty)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows whose number depends on the capacity alone."""
    return spark.createDataFrame(rows, schema)
