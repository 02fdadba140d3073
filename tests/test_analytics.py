import datetime as dt
import math
import random
import time

import numpy as np
import pytest

from ultradia.functions import dist
from ultradia.functions import timecols as T
from ultradia.operators import clean, cluster, death, health, hmm, ml, prepared, rhythm, rolling_states, runs, sleep, stats
from ultradia.sources import metadata, monitor, store
from pyspark.sql import functions as F

DAY0 = dt.datetime(2031, 1, 1)


def series(spark, values, fly="a", start=DAY0, step=1):
    rows = [(1, fly, start.date() + dt.timedelta(minutes=0), 1, start + dt.timedelta(minutes=step * i), v) for i, v in enumerate(values)]
    rows = [(e, f, t.date(), d, t, v) for e, f, _, d, t, v in rows]
    df = spark.createDataFrame(rows, "experiment_id int, fly_id string, blk date, exp_day int, minute timestamp_ntz, value long")
    df = df.withColumn("lights_on", F.lit(9)).withColumn("lights_off", F.lit(21))
    return df.withColumn("zt", T.zt(F.col("minute"), F.col("lights_on"))).withColumn("phase", T.phase(F.col("minute"), F.col("lights_on")))


def test_one_bout_day(spark):
    values = [0 if 100 <= i < 110 else 1 for i in range(1440)]
    r = sleep.daily_sleep(series(spark, values)).collect()[0]
    assert r.total_bouts == 1 and r.total_sleep == 10 and r.p_wake == pytest.approx(0.1) and r.night_bouts == 1 and r.sleep_latency == 100
    assert r.waso == 900 - 110 + 0 - 360 + 0 or r.waso > 0
    m = health.daily_metrics(series(spark, values)).collect()[0]
    assert m.longest_zero == 10 and m.total_activity == 1430 and m.total_sleep == 10


def test_threshold_edge(spark):
    values = [1] + [0] * 4 + [1] + [0] * 5 + [1] + [0] * 6 + [1]
    assert health.daily_metrics(series(spark, values)).collect()[0].total_sleep == 11


def test_all_zero_day_is_dead_and_death_is_for_ever(spark):
    d = health.with_reference_day(health.daily_metrics(series(spark, [0] * 1440))).withColumn("missing_fraction", F.lit(0.0)).withColumn("status", health.status_of())
    assert d.collect()[0].status == "Dead"
    rows = spark.createDataFrame([(1, "a", i, s) for i, s in enumerate(["Alive", "Dead", "Alive"])], "experiment_id int, fly_id string, exp_day int, status string")
    assert [r.status for r in health.irreversible(rows).orderBy("exp_day").collect()] == ["Alive", "Dead", "Dead"]


def test_reference_day_missing_or_zero(spark):
    rows = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 4, 0), (2, "b", 1, 5)], "experiment_id int, fly_id string, exp_day int, total_activity long")
    got = {(r.fly_id, r.exp_day): (r.rel_activity, r.decline_status) for r in health.with_reference_day(rows).collect()}
    assert got[("b", 1)] == (None, "No Reference") and got[("a", 1)][0] is None


def test_runs_partition_the_series(spark):
    rng = random.Random(1)
    values = [rng.choice([0, 0, 1]) for _ in range(400)]
    got = runs.run_lengths(series(spark, values), ["fly_id"], ["minute"], F.col("value") == 0).collect()
    assert sum(r.length for r in got) == 400 and all((r.end - r.start).total_seconds() == 60 * (r.length - 1) for r in got)


def test_pure_cosine_and_flat_day(spark):
    rows = [("cos", z, 100 + 50 * math.cos(2 * math.pi * (z - 6) / 24)) for z in range(24)] + [("flat", z, 5.0) for z in range(24)] + [("two", z, 1.0 * z) for z in range(2)] + [("null", z, None) for z in range(5)]
    df = spark.createDataFrame(rows, "k string, zt int, y double")
    got = {r.k: r for r in rhythm.cosinor(df, ["k"], "zt", "y").collect()}
    assert got["cos"].mesor == pytest.approx(100) and got["cos"].amplitude == pytest.approx(50) and got["cos"].phase == pytest.approx(18) and got["cos"].p_value == pytest.approx(0, abs=1e-9)
    assert got["flat"].amplitude == pytest.approx(0, abs=1e-9) and got["flat"].p_value is None and got["two"].mesor is None and "null" not in got
    assert rhythm.cosinor(df, ["k"], "zt", "y", corrected=True).where("k = 'cos'").collect()[0].phase == pytest.approx(6)


def test_periodogram(spark):
    rows = [(1, "a", z, int(1000 * (1 + math.cos(2 * math.pi * z / 24)))) for z in range(24)] + [(1, "f", z, 5) for z in range(24)] + [(1, "s", 0, 1)]
    df = spark.createDataFrame(rows, "experiment_id int, fly_id string, zt int, hourly long")
    got = {r.fly_id: r for r in rhythm.periodogram(df, ("experiment_id", "fly_id"), corrected=True).collect()}
    assert got["a"].period == pytest.approx(24, abs=0.05) and got["a"].power == pytest.approx(1, abs=1e-3) and got["f"].power is None and got["s"].period is None


def test_deaths_and_backward_windows(spark):
    values = [1] * 600 + [0] * 1500
    m = series(spark, values)
    ex = spark.createDataFrame([(1, dt.date(2031, 1, 5))], "experiment_id int, end_date date")
    d = death.dense_deaths(m, ex, 24)
    assert d.collect()[0].death_datetime == DAY0 + dt.timedelta(minutes=600)
    w = {r.ttd: r for r in death.backward_windows(m, d).collect()}
    assert set(w) == {0, 6} and w[0].p_wake == 1.0 and w[0].n_sleep_bouts == 0 and w[6].window_start == DAY0
    assert death.long_zero_starts(m, 1400).collect()[0].death_datetime == DAY0 + dt.timedelta(minutes=600)
    assert death.death_periods(m, 1440).collect()[0].minutes == 1500
    short = series(spark, [1] * 479 + [0] * 1500)
    assert {r.ttd for r in death.backward_windows(short, death.dense_deaths(short, ex, 24)).collect()} == {0}


def test_iqr_nan_and_z(spark):
    rows = [(i, "g", "F", "VEH", v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0])] + [(9, "g", "F", "VEH", None), (10, None, "F", "VEH", 1.0)]
    df = spark.createDataFrame(rows, "feature_id long, genotype string, sex string, treatment string, total_sleep_mean double")
    b = clean.iqr_bounds(df.dropna(subset=clean.GROUP)).collect()[0]
    assert (b.q1, b.q3, b.low, b.high) == (2, 4, -1, 7)
    assert {r.feature_id for r in clean.iqr_marked(df).where("is_outlier").collect()} == {4} and clean.iqr_marked(df).count() == 6
    z = clean.z_scored(spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "feature_id long, x double, y double"), ["x", "y"]).orderBy("feature_id").collect()
    assert z[0].x_z == pytest.approx(-0.70710678) and z[0].y_z is None


def test_tails_at_textbook_values(spark):
    assert dist.upper_gamma(0.5, 3.841458821 / 2) == pytest.approx(0.05, abs=1e-8) and dist.upper_gamma(5, 18.307038 / 2) == pytest.approx(0.05, abs=1e-7)
    assert dist.incomplete_beta(10 / (10 + 3 * 3.708265), 5, 1.5) == pytest.approx(0.05, abs=1e-5)
    df = spark.createDataFrame([(1.959963985,), (None,)], "z double").select(dist.normal_two_sided(F.col("z")).alias("p"))
    assert [r.p for r in df.collect()][0] == pytest.approx(0.05)


def test_rank_statistics(spark):
    rows = [("f", "a", v) for v in (1.0, 2.0, 2.0)] + [("f", "b", v) for v in (2.0, 3.0, 9.0)] + [("g", "a", 1.0)]
    long = spark.createDataFrame(rows, "feature string, grp string, value double")
    got = {(r.feature, r.value): r["rank"] for r in stats.ranked_counts(long).collect()}
    assert got[("f", 2.0)] == 3.0 and got[("f", 9.0)] == 6.0
    u = {r.grp: r for r in stats.mann_whitney_one_vs_rest(long).collect()}
    assert u["a"].u + u["b"].u == 9 and u["a"].r == pytest.approx(-u["b"].r)
    d = stats.cliffs_delta(long).collect()[0]
    assert d.delta == pytest.approx((1 * 0 - 0 + (0 + 0) - 7 + 0) / 9) and d.magnitude == "large"
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", None)], "feature string, p double")
    adj = {r.feature: r.p_adj for r in stats.benjamini_hochberg(p, "p").collect()}
    assert adj["x"] == pytest.approx(0.03) and adj["y"] == pytest.approx(0.06) and adj["z"] == 1.0


def test_dbscan_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.gauss(c, 0.1), rng.gauss(0, 0.1)) for i, c in enumerate([0] * 60 + [2] * 40)] + [(500 + i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(30)] + [(900, None, 0.0)]
    df = spark.createDataFrame([(*p, 1) for p in pts], "id long, x double, y double, cluster int")
    got = {r.id: r.cluster for r in cluster.dbscan(df, "id", ("x", "y"), 0.2, 5).collect()}
    real = pts[:-1]
    near = {a[0]: [b[0] for b in real if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.04] for a in real}
    core = {k for k, v in near.items() if len(v) >= 5}
    label = {k: k for k in core}
    changed = True
    while changed:
        changed = False
        for k in core:
            m = min(label[x] for x in near[k] if x in core)
            if m < label[k]:
                label[k], changed = m, True
    assert {k: v for k, v in got.items() if k in core} == label and 900 not in got
    assert all((got[k] == -1) == (not any(x in core for x in near[k])) for k in near if k not in core)


def test_hmm_recovers_states(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for fly in range(8):
        s = 0
        for i in range(60):
            s = s if rng.random() < 0.9 else rng.randrange(3)
            at = DAY0 + dt.timedelta(minutes=5 * i)
            truth[(str(fly), at)] = hmm.STATES[s]
            rows.append((1, str(fly), "g", 1, at, [4, 0, -4][s] + rng.gauss(0, 0.5), [2, 0, -2][s] + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "experiment_id int, fly_id string, genotype string, bout int, bin timestamp_ntz, mt_z double, pn_z double")
    got = hmm.decoded_states(df).collect()
    assert len(got) == len(rows) and sum(truth[(r.fly_id, r.bin)] == r.state for r in got) / len(got) > 0.95
    few = hmm.decoded_states(df.limit(20)).collect()
    assert {r.state for r in few} == {"HMM_FAILED"}


def test_hmm_passes_are_whole_and_quick():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 12, 4000))[::-1]
    lengths[0] = 400
    begin, flat = np.cumsum(lengths) - lengths, rng.normal(size=(2, lengths.sum())) * 2
    m = {"start": np.array([0.5, 0.3, 0.2]), "trans": np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.05, 0.05, 0.9]]), "mean": np.array([[2.0, 1], [0, 0], [-2, -1]]), "var": np.array([[1.0, 2], [1, 1], [0.5, 1]])}
    began = time.thread_time()
    at, steps = hmm._by_step(lengths, begin)
    got = hmm._expected(flat[:, at], steps, m)
    path = np.empty(len(at), int)
    path[at] = hmm._viterbi(flat[:, at], steps, m)
    quick = time.thread_time() - began
    began, want, bare = time.thread_time(), np.zeros(len(got)), []
    for lo, n in zip(begin, lengths):
        obs = flat[:, lo : lo + n].T
        d = np.exp(-0.5 * (np.log(2 * np.pi * m["var"]) + (obs[:, None] - m["mean"]) ** 2 / m["var"]).sum(-1))
        alpha, scale, beta, best, back = [], [], [np.ones(3)], np.log(m["start"] * d[0]), []
        for t in range(n):
            a = (alpha[-1] @ m["trans"] if t else m["start"]) * d[t]
            scale.append(a.sum())
            alpha.append(a / a.sum())
            if t:
                step = best[:, None] + np.log(m["trans"])
                back.append(step.argmax(0))
                best = step.max(0) + np.log(d[t])
        for t in range(n - 1, 0, -1):
            beta.insert(0, m["trans"] @ (d[t] * beta[0]) / scale[t])
        xi = sum((alpha[t][:, None] * m["trans"] * (d[t + 1] * beta[t + 1] / scale[t + 1]) for t in range(n - 1)), np.zeros((3, 3)))
        g, way = np.array(alpha) * np.array(beta), [best.argmax()]
        for x in reversed(back):
            way.append(x[way[-1]])
        bare += way[::-1]
        want += np.concatenate([g[0], xi.ravel(), g.sum(0), (g.T @ obs).ravel(), (g.T @ obs**2).ravel(), [np.log(scale).sum(), n]])
    assert got == pytest.approx(want, rel=1e-9) and path.tolist() == bare
    assert quick * 8 < time.thread_time() - began


def test_hmm_packs_every_bin_once(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 50)
    rows = [(g, [float(100 * i + t) for t in range(1 + i % 70)], [float(-t) for t in range(1 + i % 70)]) for i in range(90) for g in ("a", "b")]
    b = spark.createDataFrame(rows, "genotype string, x array<double>, y array<double>")
    found = list(hmm._groups(np.array([r[0] for r in rows]), np.array([len(r[1]) for r in rows])))
    assert sorted(i for _, own in found for i in own) == list(range(len(rows))) and len(found) > 10
    got = []
    for r in hmm._packed(b).collect():
        steps, (x, y) = np.frombuffer(r.steps, "<i8"), np.frombuffer(r.cells, "<f8").reshape(2, -1)
        for j in range(steps[0]):
            own = [lo + j for lo, k in zip(np.cumsum(steps) - steps, steps) if k > j]
            got.append((r.genotype, x[own].tolist(), y[own].tolist()))
    assert sorted(got) == sorted(rows)


def test_prelabels(spark):
    rows = [(1, "a", DAY0.date(), DAY0 + dt.timedelta(minutes=5 * i), 0 if 40 <= i < 44 else 5 + i % 7, 1.0 * (i % 3)) for i in range(80)]
    b = spark.createDataFrame(rows, "experiment_id int, fly_id string, blk date, bin timestamp_ntz, mt_sum long, pn_var double")
    got = rolling_states.prelabelled(b, min_bout=2, warmup=20).orderBy("bin").collect()
    assert [r.hmm_state for r in got[40:44]] == ["Sleep"] * 4 and got[0].hmm_state == "Warmup" and got[70].hmm_state == "HMM_candidate" and got[0].mt_z == 0
    assert rolling_states.state_shares(rolling_states.prelabelled(b)).collect()[0].qc == "Keep"


def test_rolled_over_batches(spark):
    rng = random.Random(4)
    values = {(f, i): None if rng.random() < 0.3 else 1e6 + rng.random() for f in ("a", "b", "c") for i in range(40)}
    df = spark.createDataFrame([(1, f, DAY0 + dt.timedelta(minutes=5 * i), v) for (f, i), v in values.items()], "experiment_id int, fly_id string, bin timestamp_ntz, _mt double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = rolling_states._rolled(df, ("mt",), 12).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(values)
    for r in got:
        at = int((r.bin - DAY0).total_seconds() // 300)
        own = [v for i in range(max(0, at - 11), at + 1) if (v := values[r.fly_id, i]) is not None]
        mean, sd = math.fsum(own) / len(own) if own else None, None
        if len(own) > 1:
            sd = math.sqrt(math.fsum((v - mean) ** 2 for v in own) / (len(own) - 1))
        assert (r._mt_mean is None) == (mean is None) and (r._mt_sd is None) == (sd is None)
        assert mean is None or r._mt_mean == pytest.approx(mean, rel=1e-12)
        assert sd is None or r._mt_sd == pytest.approx(sd, rel=1e-6)


def test_forest_and_measures(spark):
    rng = random.Random(1)
    rows = [(i, "x" if i % 2 else "y", (1.0 if i % 2 else -1.0) + rng.gauss(0, 0.2), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, kind string, a double, b double")
    tested, important = ml.forest(df, ["a", "b"], "kind", "id", trees=5, depth=3)
    m = ml.class_measures(tested, "kind").collect()[0]
    assert m.accuracy > 0.95 and important.orderBy("position").first().feature == "a"
    scores, share, loadings = ml.principal_components(df, ["a", "b"], 2)
    assert share.sum() == pytest.approx(1) and scores.agg(F.avg("pc1")).first()[0] == pytest.approx(0, abs=1e-9) and loadings.shape == (2, 2)


def test_monitor_files(spark, tmp_path):
    def line(i, kind, first, time="09:00:00", day="1 Mar 25"):
        return "\t".join([str(i), day, time, "1", "0", "0", "0", kind, "0", "0", str(first), *["0"] * 31])

    (tmp_path / "Monitor51_06.txt").write_text("\n".join([line(1, "MT", 5), line(1, "CT", 2), line(2, "MT", 0), line(3, "XX", 9), line(4, "Pn", 1, "bad"), "short\tline"]) + "\n")
    raw = monitor.read_monitors(spark, str(tmp_path))
    got = {(r.monitor, r.channel, r.fly_id, r.reading, r.value) for r in monitor.long_readings(raw).collect()}
    assert got == {("51_06", 1, "M51_06_Ch01", "MT", 5), ("51_06", 1, "M51_06_Ch01", "CT", 2), ("51_06", 1, "M51_06_Ch01", "Pn", 0)}
    assert monitor.lines_between(spark, str(tmp_path), "02/28/25", 1).count() == 4
    assert monitor.lines_between(spark, str(tmp_path), "03/01/25", 1).count() == 0


def test_metadata_files(spark, tmp_path):
    (tmp_path / "details.txt").write_text("Monitor Channel Genotype Sex Treatment\n51 ch1 Wt Male 8mM His + VEH  \n51 ch2 na na na\n51 ch3\n\n51 CH4 Rye Female VEH\n")
    got = {(r.fly_id, r.genotype, r.treatment) for r in metadata.read_metadata(spark, str(tmp_path)).collect()}
    assert got == {("M51_Ch01", "Wt", "8mM His + VEH"), ("M51_Ch04", "Rye", "VEH")}


def test_store(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "experiment_id int, fly_id string, v int")
    b = spark.createDataFrame([(2, "b", 9), (3, "c", 3)], "experiment_id int, fly_id string, v int")
    assert {(r.experiment_id, r.v) for r in store.upserted(a, b, ["experiment_id", "fly_id"]).collect()} == {(1, 1), (2, 9), (3, 3)}
    assert [r.v for r in store.new_rows(a, b, ["experiment_id", "fly_id"]).collect()] == [3]
    path = str(tmp_path / "t")
    store.replace_experiments(a, path)
    store.replace_experiments(b, path)
    assert {(r.experiment_id, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 9), (3, 3)}
    store.replace_table(store.without_flies(spark.read.parquet(path), b), path)
    assert [r.v for r in spark.read.parquet(path).collect()] == [1]
    assert store.next_id(a, "v") == 3 and store.next_id(a.limit(0), "v") == 1
    assert store.differences(a, a, ["fly_id"]).count() == 0 and store.differences(a, b, ["fly_id"]).count() == 4
    with pytest.raises(ValueError):
        store.require_columns(a, ["missing"])


def test_scalar_functions(spark):
    df = spark.createDataFrame([("Monitor51_06_20_25.txt", "x_MT.csv", "02/28/25", 3, " NaN ")], "f string, g string, d string, c int, s string")
    r = df.select(
        T.monitor_of_file(F.col("f")).alias("m"), T.reading_type_of_file(F.col("g")).alias("t"), T.load_date(F.col("d")).alias("d"), T.load_date(F.col("g")).alias("bad"),
        T.fly_id(F.lit("1"), F.lit(123)).alias("id"), T.fly_key(F.lit("5"), F.lit("CH7")).alias("key"), T.is_ok(F.col("s")).alias("ok"), T.is_ok(F.col("s"), True).alias("ok2"), T.output_name(F.col("g"), 5).alias("o"),
    ).first()
    assert (r.m, r.t, r.d, r.bad, r.id, r.key, r.ok, r.ok2, r.o) == ("51_06_20_25", "MT", dt.date(2025, 2, 28), None, "M1_Ch123", "5-ch7", False, True, "x_MT_5min.csv")


def test_dense_minutes_conserve(spark):
    m = series(spark, [3, 0, 2], step=30)
    d = prepared.dense_minutes(m)
    assert d.count() == 61 and d.agg(F.sum("value")).first()[0] == 5


def test_streams_feed_the_session_table(spark, tmp_path):
    from ultradia.operators.sessions import SessionTable, local_sessions
    from ultradia.streaming import bins

    rows = [(1, "a", DAY0 + dt.timedelta(minutes=m), "MT", 5) for m in (0, 10, 100)]
    df = spark.createDataFrame(rows, "experiment_id int, fly_id string, datetime timestamp, reading_type string, value int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    table = SessionTable(spark, str(tmp_path / "t"), ["experiment_id", "fly_id"], 1800)
    q = stream.writeStream.foreachBatch(bins.upserting(table)).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    like = local_sessions(df, ["experiment_id", "fly_id"], "datetime", 1800)
    assert sorted(r.n_events for r in table.sessions(like).collect()) == [1, 2]
    q = bins.binned(stream, 60).writeStream.format("memory").queryName("binned").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.total for r in spark.sql("select total from binned").collect()} == {10, 5}
