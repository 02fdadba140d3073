import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ultradia.operators import grid, rolling, spikes
from ultradia.plans import pipeline

T0 = dt.datetime(2031, 1, 1)
READINGS = "measurement_id long, experiment_id int, fly_id string, datetime timestamp_ntz, reading_type string, value int, level string"


def readings(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], READINGS)


def brute_found(rows):
    out, by = set(), {}
    seen = set()
    for i, (e, f, t, kind, v) in enumerate(rows):
        if v is None or kind != "MT" or (e, f, t) in seen:
            continue
        seen.add((e, f, t))
        by.setdefault((e, f), []).append((t, i, v))
    for rs in by.values():
        rs.sort()
        usual = [v for _, _, v in rs if 1 <= v <= 1000]
        level = statistics.median(usual) if usual else None
        at = 0
        while at < len(rs):
            end = at
            while end < len(rs) and rs[end][2] == rs[at][2]:
                end += 1
            for _, i, v in rs[at:end]:
                if v < 0 or v > 1000 or (level is not None and v > 6 * level) or (v > 0 and end - at >= 12):
                    out.add(i)
            at = end
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spikes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for f in "abc":
        t, v = T0, 5
        for _ in range(300):
            t += dt.timedelta(seconds=rng.choice([60, 600, 7200]))
            v = v if rng.random() < 0.8 else rng.choice([0, 1, 3, 5, 8, 40, 90, -3, 1500, None])
            rows.append((1, f, t, "MT", v))
            if rng.random() < 0.1:
                rows.append((1, f, t, rng.choice(["MT", "CT"]), 7))
    found = spikes.implausible_readings(readings(spark, rows)).where("is_impossible or is_spike or is_stuck")
    assert {r.measurement_id for r in found.collect()} == brute_found(rows)


def test_a_run_over_several_days_is_one(spark):
    rows = [(1, "a", T0 + dt.timedelta(hours=5 * i), "MT", 4) for i in range(12)] + [(1, "b", T0 + dt.timedelta(hours=5 * i), "MT", 4) for i in range(11)]
    got = spikes.implausible_readings(readings(spark, rows)).collect()
    assert all(r.is_stuck == (r.fly_id == "a") and r.run_length == (12 if r.fly_id == "a" else 11) for r in got)


def test_spikes_without_rows_or_level(spark):
    assert spikes.implausible_readings(readings(spark, [])).count() == 0
    one = spikes.implausible_readings(readings(spark, [(1, "a", T0, "MT", 0), (1, "a", T0, "MT", None)])).collect()
    assert len(one) == 1 and one[0].level is None and not one[0].is_spike


def test_trailing_sums_equal_brute_force(spark):
    rng = random.Random(5)
    days = {("a", d): rng.randrange(0, 50) for d in range(0, 45) if rng.random() < 0.5} | {("a", 0): 3, ("b", 40): 1}
    rows = [(k, T0.date() + dt.timedelta(d), v, T0.date() + dt.timedelta(44), 1) for (k, d), v in days.items()] + [(None, T0.date(), 1, T0.date(), 1), ("c", T0.date() + dt.timedelta(60), 1, T0.date(), 1)]
    df = spark.createDataFrame(rows, "k string, d date, v long, until date, day int")
    out = rolling.trailing_sums(rolling.daily_grid(df, ["k"], "d", "v", "until"), ["k"], (1, 7, 30, 13)).collect()
    assert len(out) == 45 + 5
    for r in out:
        at = (r.day - T0.date()).days
        for n in (1, 7, 13, 30):
            want = sum(days.get((r.k, x), 0) for x in range(at - n + 1, at + 1))
            assert r[f"total_{n}"] == want and abs(r[f"mean_{n}"] - want / n) < 1e-9
    assert rolling.daily_grid(df.limit(0), ["k"], "d", "v", "until").count() == 0


def test_a_period_needs_a_day(spark):
    df = spark.createDataFrame([("a", T0.date(), 1)], "k string, day date, total long")
    with pytest.raises(ValueError):
        rolling.trailing_sums(df, ["k"], (0,))


def test_grid_marks_and_keeps(spark):
    hours = [0, 1, 2, 5, 9, 30, 31, 80]
    rows = [(1, "a", T0 + dt.timedelta(hours=h, minutes=7), "MT", h + 1) for h in hours] + [(1, "b", T0, "MT", 3), (1, "b", T0 + dt.timedelta(hours=30), "MT", 3), (1, "c", T0, "MT", 2000), (1, "d", T0, "CT", 2)]
    g = {(r.fly_id, int((r.hour - T0).total_seconds() // 3600)): (r.total, r.status) for r in grid.regular_grid(readings(spark, rows)).collect()}
    assert {k for k in g if k[0] == "a"} == {("a", h) for h in range(81)}
    assert {k[1] for k, v in g.items() if v[1] == "observed" and k[0] == "a"} == set(hours)
    assert all(g[("a", h)][0] == h + 1 for h in hours)
    assert g[("a", 3)][1] == "filled" and g[("a", 3)][0] >= 0
    assert g[("a", 60)][1] == "filled" and g[("a", 32)][1] == "filled"  # days without readings: from the source's factors
    assert g[("b", 5)] == (None, "unsupported")  # two observed hours cannot bear three factors
    assert g[("b", 0)] == (3.0, "observed") and not any(k[0] in "cd" for k in g)
    gaps = {(r.fly_id, int((r.gap_start - T0).total_seconds() // 3600), r.n_hours) for r in grid.hour_gaps(grid.regular_grid(readings(spark, rows))).collect()}
    assert gaps == {("a", 3, 2), ("a", 6, 3), ("a", 10, 20), ("a", 32, 48), ("b", 1, 29)}
    assert grid.regular_grid(readings(spark, [])).count() == 0


def test_factors_fill_better_than_the_mean(spark):
    """Held-out cells of a low-rank matrix."""
    rng = random.Random(1)
    rows, hidden = [], {}
    for f in range(40):
        size = 5 + 40 * rng.random()
        for h in range(24):
            v = int(size * (1.2 + __import__("math").cos(2 * 3.14159 * (h - 8) / 24)) + rng.random())
            if rng.random() < 0.2 and 0 < h < 23:
                hidden[(str(f), h)] = v
            else:
                rows.append((1, str(f), T0 + dt.timedelta(hours=h), "MT", v))
    got = {(r.fly_id, r.hour.hour): r.total for r in grid.regular_grid(readings(spark, rows)).where("status = 'filled'").collect()}
    means = {}
    for _, f, _, _, v in rows:
        means.setdefault(f, []).append(v)
    err = sum(abs(got[k] - v) for k, v in hidden.items())
    plain = sum(abs(statistics.mean(means[k[0]]) - v) for k, v in hidden.items())
    assert err < 0.3 * plain


def test_whole_missing_days_are_filled_better_than_by_the_mean(spark):
    """Held-out days of sources with a daily rhythm, against the mean of the source's hours."""
    rng = random.Random(2)
    rows, hidden = [], {}
    for f in range(25):
        size, peak = 5 + 40 * rng.random(), rng.choice((6, 9, 12))
        for h in range(24 * 6):
            v = int(size * (1.2 + __import__("math").cos(2 * 3.14159 * (h - peak) / 24)) + rng.random())
            if h // 24 == 1 + f % 4:
                hidden[(str(f), h)] = v
            else:
                rows.append((1, str(f), T0.replace(hour=0) + dt.timedelta(hours=h), "MT", v))
    at = T0.replace(hour=0)
    got = {(r.fly_id, int((r.hour - at).total_seconds() // 3600)): r.total for r in grid.regular_grid(readings(spark, rows)).where("status = 'filled'").collect()}
    means = {}
    for _, f, _, _, v in rows:
        means.setdefault(f, []).append(v)
    assert set(hidden) <= set(got)
    assert sum(abs(got[k] - v) for k, v in hidden.items()) < 0.4 * sum(abs(statistics.mean(means[k[0]]) - v) for k, v in hidden.items())


def test_pipeline_queries_run_on_the_smallest_tables(spark, sf):
    for name, f in pipeline.QUERIES.items():
        df = f(spark, sf)
        assert df.columns and df.limit(3).count() >= 0, name
    assert F is not None
