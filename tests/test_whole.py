"""Queries against results over all columns of the tables as they are."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tools.compare import canonical
from ultradia.operators import hotdeck
from ultradia.plans import features


def test_cluster_measures_read_every_dimension(spark, sf):
    e = duckdb.sql(f"select label, embedding from '{sf}/embeddings.parquet' where label is not null").df()
    x, labels = np.array([np.asarray(v, dtype=float) for v in e["embedding"]]), e["label"].to_numpy()
    assert x.shape[1] > 8
    names = np.unique(labels)
    centers = np.array([x[labels == g].mean(axis=0) for g in names])
    spread = np.array([np.linalg.norm(x[labels == g] - c, axis=1).mean() for g, c in zip(names, centers)])
    within = sum(((x[labels == g] - c) ** 2).sum() for g, c in zip(names, centers))
    between = sum((labels == g).sum() * ((c - x.mean(axis=0)) ** 2).sum() for g, c in zip(names, centers))
    n, k = len(x), len(names)
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in range(k) if j != i) for i in range(k)]
    got = features.m_cluster_measures(spark, sf).first()
    assert (got.n, got.clusters) == (n, k)
    assert got.calinski_harabasz == pytest.approx(between * (n - k) / (within * (k - 1)), abs=1e-3)
    assert got.davies_bouldin == pytest.approx(np.mean(worst), abs=1e-3)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def numeric(con, table, suffix=""):
    keys = {"feature_id", "experiment_id", "fly_id"}
    return [c for c, t in con.execute(f"select column_name, column_type from (describe {table})").fetchall() if t in ("DOUBLE", "INTEGER", "BIGINT") and c not in keys and c.endswith(suffix)]


@pytest.mark.parametrize("name", ["s_anova", "s_kruskal", "s_mann_whitney", "s_cliffs_delta", "s_cohens_d", "s_top_effects", "a_genotype_signature", "a_group_signature"])
def test_statistics_of_every_z_column(spark, sf, con, name):
    cols = numeric(con, "features_z", "_z")
    assert cols == list(features.TESTED)
    every = " UNION ALL ".join(f"SELECT '{c}' AS feature, genotype AS grp, CAST({c} AS DOUBLE) AS value FROM fz WHERE genotype IS NOT NULL AND {c} IS NOT NULL AND NOT isnan({c})" for c in cols)
    sql = features.ORACLE[name].replace(features._UNPIVOT, every)
    assert canonical(features.QUERIES[name](spark, sf).toPandas()).equals(canonical(con.execute(sql).df()))


def test_adjustment_counts_every_z_column(spark, sf, con):
    got = features.s_adjusted(spark, sf).toPandas()
    assert set(got["feature"]) == set(numeric(con, "features_z", "_z"))
    for _, g in got.groupby("grp"):
        p = np.sort(g["p"].to_numpy())
        want = np.minimum(1, np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
        assert np.sort(g["p_adj"].to_numpy()) == pytest.approx(want, abs=1e-4)


def test_z_scores_and_null_counts_of_every_column(spark, sf, con):
    cols = numeric(con, "features")
    f = con.execute("select * from features").df().set_index("feature_id").sort_index()[cols].astype(float)
    z = features.n_z_scores(spark, sf).toPandas().set_index("feature_id").sort_index()
    assert list(z.columns) == [f"{c}_z" for c in cols]
    assert np.allclose(z.to_numpy(dtype=float), ((f - f.mean()) / f.std()).to_numpy(), atol=1e-5, equal_nan=True)
    counts = {r.feature: (r.n_null, r.n) for r in features.n_diagnostics(spark, sf).collect()}
    assert counts == {c: (int(f[c].isna().sum()), len(f)) for c in cols}


def test_wider_donors_are_the_nearest_by_order(spark):
    rng = random.Random(7)
    rows = [(f"f{i:03d}", rng.choice("xy"), rng.choice("mnopq"), rng.randrange(1, 33), float(i) if rng.random() < 0.15 else None) for i in range(80)] + [("g", "z", "r", 9, None)]
    got = {r.fly: r for r in hotdeck.hot_deck(spark.createDataFrame(rows, "fly string, a string, b string, o int, v double"), "fly", ["a", "b"], "o", "v").collect()}
    scopes = set()
    for fly, a, b, o, v in rows:
        if v is not None:
            assert not got[fly].was_filled
            continue
        donors = [r for r in rows if r[4] is not None]
        near = next(d for d in ([r for r in donors if r[1:3] == (a, b)], [r for r in donors if r[1] == a], donors) if d)
        scope = 0 if near[0][1:3] == (a, b) and all(r[1:3] == (a, b) for r in near) else 1 if all(r[1] == a for r in near) else 2
        assert got[fly].distance == min(abs(r[3] - o) for r in near) and got[fly].donor_scope == scope
        assert abs(next(r[3] for r in near if r[0] == got[fly].donor) - o) == got[fly].distance
        scopes.add(scope)
    assert scopes == {0, 1, 2} or scopes == {0, 2}


def test_fields_take_the_nearest_fly_of_another_group(spark):
    strains = spark.createDataFrame([("Wt-A",), ("Obd",), ("Cyc",)], "genotype string")
    known = [("M1_Ch01", "Cyc", 10.0), ("M1_Ch20", "Obd", None), ("M1_Ch21", "Wt-A", 30.0)]
    flies = spark.createDataFrame([(f, 1, g, "F", "VEH") for f, g, _ in known], "fly_id string, experiment_id int, genotype string, sex string, treatment string")
    features_ = spark.createDataFrame([(i, 1, f, 0.5, v) for i, (f, _, v) in enumerate(known)], "feature_id long, experiment_id int, fly_id string, p_doze_mean double, total_sleep_mean double")
    got = hotdeck.filled_fields(features_, flies, strains).where("was_missing").collect()
    assert [(r.fly_id, r.donor, r.donor_scope, r.distance) for r in got] == [("M1_Ch20", "M1_Ch21", 1, 1.0)]
