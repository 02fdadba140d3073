"""Hidden Markov model of three activity states per genotype, fitted by expectation and maximisation over Spark.

The sequences are bouts (a source's consecutive candidate bins, 288 at most a day of unbroken activity), whole, so the
forward and backward passes of a bout are one small computation; the bouts of a genotype in a task are passed over
side by side, a bin of each at a time, so that a step is a few operations on arrays. A genotype with a third of all
bouts is spread like any other: what its tasks add up are the expected counts of the model, a few
dozen numbers, and only these come together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ultradia.operators.readings import SOURCE
from ultradia.session import Scratch, written

STATES = ("Healthy", "Declining", "Critical")
Model = dict[str, np.ndarray]
#: Bins that are computed on together, and passes after which the driver frees what finished ones held.
BLOCK = 1 << 17
EVERY = 8


def bout_rows(candidates: DataFrame) -> DataFrame:
    """genotype, source, bout, bins, x (MT z) and y (Pn z) as arrays, one row per bout, over midnight too."""
    rows = candidates.where(F.col("genotype").isNotNull() & F.col("mt_z").isNotNull() & F.col("pn_z").isNotNull())
    cells = F.sort_array(F.collect_list(F.struct("bin", "mt_z", "pn_z")))
    packed = rows.groupBy("genotype", *SOURCE, "bout").agg(cells.alias("cells"))
    return packed.select("genotype", *SOURCE, "bout", F.col("cells.bin").alias("bins"), F.col("cells.mt_z").alias("x"), F.col("cells.pn_z").alias("y"))


def _by_step(lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences that begin at ``begin``, longest first: the places of all first bins, then all second ones and so on; and how many each step has."""
    t = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return (np.repeat(begin, lengths) + t)[np.argsort(t, kind="stable")], np.bincount(t)


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _groups(names: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Per genotype the rows of its bouts, longest first, in parts of about BLOCK bins."""
    for g in np.unique(names):
        rows = np.flatnonzero(names == g)
        rows = rows[np.argsort(-lengths[rows], kind="stable")]
        part = np.cumsum(lengths[rows]) // BLOCK
        for one in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
            yield g, one


def _packed(bouts: DataFrame) -> DataFrame:
    """genotype, steps, cells: bouts of a genotype side by side, step by step, as a pass over them reads them."""
    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.concatenate([b["genotype"].to_numpy(zero_copy_only=False) for b in held]).astype(str)
        lengths = np.concatenate([pc.list_value_length(b["x"]).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        x, y = (np.concatenate([_flat(b[c]) for b in held]) for c in ("x", "y"))
        begin = np.cumsum(lengths) - lengths
        for g, own in _groups(names, lengths):
            at, steps = _by_step(lengths[own], begin[own])
            yield pa.RecordBatch.from_pydict({"genotype": [g], "steps": [steps.astype("<i8").tobytes()], "cells": [np.stack([x[at], y[at]]).astype("<f8").tobytes()]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(len(h["x"].flatten()) for h in held) >= BLOCK:
                yield from rows(held)
                held = []
        if held:
            yield from rows(held)

    return bouts.select("genotype", "x", "y").mapInArrow(pack, "genotype string, steps binary, cells binary")


def _densities(cells: np.ndarray, m: Model) -> np.ndarray:
    """Log densities, a row per state."""
    out = np.empty((3, cells.shape[1]))
    for k in range(3):
        d = cells - m["mean"][k][:, None]
        out[k] = -0.5 * (np.log(2 * np.pi * m["var"][k])[:, None] + d * d / m["var"][k][:, None]).sum(0)
    return out


def _expected(cells: np.ndarray, steps: np.ndarray, m: Model) -> np.ndarray:
    """Flat expected counts of sequences packed step by step: start (3), transitions (9), weights (3), sums (6), squares (6), log-likelihood, bins."""
    b = _densities(cells, m)
    top = b.max(0)
    e = np.exp(b - top)
    n, ends = cells.shape[1], np.cumsum(steps)
    alpha, scale, onward, before = np.empty((3, n)), np.empty(n), np.ascontiguousarray(m["trans"].T), 0
    for t, (hi, k) in enumerate(zip(ends.tolist(), steps.tolist())):
        lo = hi - k
        a = (onward @ alpha[:, before : before + k] if t else m["start"][:, None]) * e[:, lo:hi]
        s = np.maximum(a.sum(0), 1e-300, out=scale[lo:hi])
        np.divide(a, s, out=alpha[:, lo:hi])
        before = lo
    e /= scale
    beta, xi = np.ones((3, steps[0])), np.zeros((3, 3))
    for t in range(len(steps) - 2, -1, -1):
        hi, k = int(ends[t]), int(steps[t + 1])
        lo = hi - int(steps[t])
        q = e[:, hi : hi + k] * beta[:, :k]
        xi += alpha[:, lo : lo + k] @ q.T
        beta[:, :k] = m["trans"] @ q
        alpha[:, lo:hi] *= beta[:, : hi - lo]
    xi *= m["trans"]
    sums, squares = alpha @ cells.T, alpha @ (cells * cells).T
    return np.concatenate([alpha[:, : steps[0]].sum(1), xi.ravel(), alpha.sum(1), sums.ravel(), squares.ravel(), [np.log(scale).sum() + top.sum(), n]])


def _viterbi(cells: np.ndarray, steps: np.ndarray, m: Model) -> np.ndarray:
    """The likeliest state of each bin of sequences packed step by step."""
    b, lt = _densities(cells, m), np.log(m["trans"] + 1e-300)[:, :, None]
    ends = np.cumsum(steps)
    score = np.log(m["start"] + 1e-300)[:, None] + b[:, : steps[0]]
    back = np.empty(b.shape, np.int8)
    for hi, k in zip(ends[1:].tolist(), steps[1:].tolist()):
        step = score[:, None, :k] + lt
        back[:, hi - k : hi] = step.argmax(0)
        score[:, :k] = step.max(0) + b[:, hi - k : hi]
    path = np.empty(cells.shape[1], np.int8)
    state = score.argmax(0)
    for t in range(len(steps) - 1, -1, -1):
        k, hi = int(steps[t]), int(ends[t])
        path[hi - k : hi] = state[:k]
        if t:
            state[:k] = back[state[:k], np.arange(hi - k, hi)]
    return path


#: The quantiles that the states start from, one set per start, and the floor of a variance.
STARTS = ((0.15, 0.5, 0.85), (0.05, 0.5, 0.95), (0.25, 0.5, 0.75), (0.1, 0.3, 0.7))
FLOOR = 1e-3


def fit(bouts: DataFrame, passes: int = 100, least: int = 200, tolerance: float = 1e-6, tried: int = 5) -> dict[str, Model]:
    """A model per genotype with at least ``least`` bins; states ordered by falling mean MT, then Pn.

    Each genotype has a start per set of quantiles in STARTS. After ``tried`` passes the likeliest goes on, until
    the likelihood of no genotype grows by more than the tolerance a bin, or for ``passes``.
    """
    flat = bouts.select("genotype", F.explode(F.arrays_zip("x", "y")).alias("z"))
    q = F.array(*[F.lit(x) for s in STARTS for x in s])
    start = flat.groupBy("genotype").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("z.x", q, 1000).alias("qx"), F.percentile_approx("z.y", q, 1000).alias("qy"), F.var_pop("z.x").alias("vx"), F.var_pop("z.y").alias("vy")
    )
    models: dict[tuple[str, int], Model] = {}
    for r in start.where(F.col("n") >= least).collect():
        for i in range(len(STARTS)):
            cut = slice(3 * i, 3 * i + 3)
            models[r["genotype"], i] = {
                "start": np.full(3, 1 / 3), "trans": np.full((3, 3), 0.1) + 0.7 * np.eye(3), "mean": np.column_stack([r["qx"][cut][::-1], r["qy"][cut][::-1]]).astype(float),
                "var": np.tile(np.maximum([r["vx"], r["vy"]], FLOOR), (3, 1)),
            }
    scratch = Scratch()
    blocks = scratch(_packed(bouts), "blocks") if models else None
    before = dict.fromkeys(models, -np.inf)
    for turn in range(passes if models else 0):
        now = {k: dict(v) for k, v in models.items()}

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[str, int], np.ndarray] = {}
            for b in batches:
                for g, steps, cells in zip(*(b[c].to_pylist() for c in ("genotype", "steps", "cells"))):
                    n, z = np.frombuffer(steps, "<i8"), np.frombuffer(cells, "<f8").reshape(2, -1)
                    for i in range(len(STARTS)):
                        if (m := now.get((g, i))) is not None:
                            total[g, i] = total.get((g, i), 0) + _expected(z, n, m)
            for (g, i), c in total.items():
                yield pa.RecordBatch.from_pydict({"genotype": [g] * len(c), "which": pa.array([i] * len(c), pa.int32()), "pos": pa.array(range(len(c)), pa.int32()), "s": c})

        sums = blocks.mapInArrow(counts, "genotype string, which int, pos int, s double").groupBy("genotype", "which", "pos").agg(F.sum("s").alias("s")).collect()
        got: dict[tuple[str, int], np.ndarray] = {k: np.zeros(29) for k in models}
        for r in sums:
            got[r["genotype"], r["which"]][r["pos"]] = r["s"]
        grown = 0.0
        for k, c in got.items():
            w = np.maximum(c[12:15], 1e-9)
            mean = c[15:21].reshape(3, 2) / w[:, None]
            trans = c[3:12].reshape(3, 3) + 1e-6
            models[k] = {
                "start": (c[:3] + 1e-6) / (c[:3] + 1e-6).sum(), "trans": trans / trans.sum(1, keepdims=True), "mean": mean,
                "var": np.maximum(c[21:27].reshape(3, 2) / w[:, None] - mean * mean, FLOOR),
            }
            grown = max(grown, (c[27] - before[k]) / max(c[28], 1))
            before[k] = c[27]
        if turn % EVERY == EVERY - 1:
            bouts.sparkSession._jvm.System.gc()
        if turn + 1 == tried:
            best = {g: max((k for k in models if k[0] == g), key=lambda k: before[k]) for g in {k[0] for k in models}}
            models = {k: models[k] for k in best.values()}
        if grown < tolerance and turn + 1 >= tried:
            break
    scratch.clear()
    out: dict[str, Model] = {}
    for (g, i), m in sorted(models.items(), key=lambda x: before[x[0]]):
        order = np.lexsort((-m["mean"][:, 1], -m["mean"][:, 0]))
        out[g] = {"start": m["start"][order], "trans": m["trans"][np.ix_(order, order)], "mean": m["mean"][order], "var": m["var"][order]}
    return out


def decode(bouts: DataFrame, models: dict[str, Model]) -> DataFrame:
    """experiment_id, fly_id, bin, state of every bin by the Viterbi path of its bout; without a model for the genotype HMM_FAILED. Keys stay with their bins."""
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, lengths = b["genotype"].to_numpy(zero_copy_only=False).astype(str), pc.list_value_length(b["x"]).to_numpy(zero_copy_only=False).astype(np.int64)
            x, y, begin = _flat(b["x"]), _flat(b["y"]), np.cumsum(lengths) - lengths
            found = np.full(len(x), len(STATES), np.int32)
            for g, own in _groups(names, lengths):
                if (m := models.get(g)) is not None:
                    at, steps = _by_step(lengths[own], begin[own])
                    found[at] = _viterbi(np.stack([x[at], y[at]]), steps, m)
            offsets = pa.array(np.append(begin, len(x)).astype(np.int32))
            states = pa.ListArray.from_arrays(offsets, pa.array([*STATES, "HMM_FAILED"]).take(pa.array(found)))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keys), states], [*keys, "states"])

    d, keys = bouts.schema, [*SOURCE, "bout", "bins"]
    kinds = ", ".join(f"{k} {d[k].dataType.simpleString()}" for k in keys)
    found = bouts.select(*keys, "genotype", "x", "y").mapInArrow(paths, f"{kinds}, states array<string>")
    return found.select(*SOURCE, "bout", F.explode(F.arrays_zip("bins", "states")).alias("z")).select(*SOURCE, "bout", F.col("z.bins").alias("bin"), F.col("z.states").alias("state"))


def decoded_states(candidates: DataFrame, passes: int = 100) -> DataFrame:
    """Fit and decode; the packed bouts are written once."""
    bouts = written(bout_rows(candidates), "bouts")
    return decode(bouts, fit(bouts, passes))
