import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ultradia.operators import sessions
from ultradia.operators.readings import counted_readings, usable_readings
from ultradia.session import scratch_path

KEYS = ["experiment_id", "fly_id"]
T0 = dt.datetime(2031, 1, 1)
SCHEMA = "experiment_id int, fly_id string, datetime timestamp_ntz, slot string"


def events(spark, rows):
    return spark.createDataFrame([(e, f, None if s is None else T0 + dt.timedelta(seconds=s), "clash") for e, f, s in rows], SCHEMA)


def brute(rows, gap):
    out = set()
    for key in {(e, f) for e, f, _ in rows}:
        times = sorted(s for e, f, s in rows if (e, f) == key)
        start = prev = times[0]
        n = 0
        for s in times:
            if s - prev > gap:
                out.add((*key, start, prev, n))
                start, n = s, 0
            prev, n = s, n + 1
        out.add((*key, start, prev, n))
    return out


def as_set(df):
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    return {(r.experiment_id, r.fly_id, r.start_us // 10**6 - base, r.end_us // 10**6 - base, r.n_events) for r in df.collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from(["a", "b"]), st.integers(0, 40_000)), min_size=1, max_size=60))
def test_local_sessions_equal_brute_force(spark, rows):
    assert as_set(sessions.local_sessions(events(spark, rows), KEYS, "datetime", 1800)) == brute(rows, 1800)


def test_gap_edge_nulls_ties_and_empty(spark):
    rows = [(1, "a", 0), (1, "a", 1800), (1, "a", 3601), (1, "a", 3601)]
    df = events(spark, [*rows, (None, "a", 5), (1, None, 5), (1, "a", None)])
    assert as_set(sessions.local_sessions(df, KEYS, "datetime", 1800)) == {(1, "a", 0, 1800, 2), (1, "a", 3601, 3601, 2)}
    assert sessions.local_sessions(events(spark, []), KEYS, "datetime", 1800).count() == 0


def test_batches_in_any_order_give_the_sessions_of_all(spark):
    rng = random.Random(3)
    rows = [(1, rng.choice("abc"), rng.randrange(0, 200_000)) for _ in range(300)]
    table = sessions.SessionTable(spark, scratch_path(spark, "t"), KEYS, 1800, buckets=3)
    for part in (rows[200:], rows[:100], [], rows[100:200]):
        table.upsert(sessions.local_sessions(events(spark, part), KEYS, "datetime", 1800))
    like = sessions.local_sessions(events(spark, rows), KEYS, "datetime", 1800)
    assert as_set(table.sessions(like)) == brute(rows, 1800)


def test_a_bridge_merges_and_untouched_parts_stay(spark):
    table = sessions.SessionTable(spark, scratch_path(spark, "t"), KEYS, 1800, buckets=8)
    first = sessions.local_sessions(events(spark, [(1, "a", 0), (1, "a", 3000), (2, "z", 0)]), KEYS, "datetime", 1800)
    table.upsert(first)
    before = table.parts()
    table.upsert(sessions.local_sessions(events(spark, [(1, "a", 1500)]), KEYS, "datetime", 1800))
    assert as_set(table.sessions(first)) == {(1, "a", 0, 3000, 3), (2, "z", 0, 0, 1)}
    assert len(set(before.values()) - set(table.parts().values())) == 1


def test_a_failed_upsert_leaves_the_table(spark, monkeypatch):
    table = sessions.SessionTable(spark, scratch_path(spark, "t"), KEYS, 1800)
    first = sessions.local_sessions(events(spark, [(1, "a", 0)]), KEYS, "datetime", 1800)
    table.upsert(first)
    monkeypatch.setattr(table, "_commit", lambda *_a: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        table.upsert(sessions.local_sessions(events(spark, [(1, "a", 10)]), KEYS, "datetime", 1800))
    except RuntimeError:
        pass
    assert as_set(table.sessions(first)) == {(1, "a", 0, 0, 1)}


def test_a_batch_given_twice_counts_once(spark):
    table = sessions.SessionTable(spark, scratch_path(spark, "t"), KEYS, 1800)
    first = sessions.local_sessions(events(spark, [(1, "a", i) for i in range(5)]), KEYS, "datetime", 1800)
    for _ in range(3):
        table.upsert(first, name="one")
    assert as_set(table.sessions(first)) == {(1, "a", 0, 4, 5)} and table.batches() == ["one"]
    again = sessions.SessionTable(spark, table.path, KEYS, 1800, buckets=99)
    again.upsert(first, name="one")
    assert again.buckets == table.buckets and as_set(again.sessions(first)) == {(1, "a", 0, 4, 5)}


def test_repeats_in_a_later_batch_are_unseen_only_once(spark):
    old, new = events(spark, [(1, "a", 0), (1, "a", 10)]), events(spark, [(1, "a", 10), (1, "a", 20), (1, "a", 20), (2, "a", 0), (None, "a", 1)])
    got = sessions.unseen(new, old, KEYS, "datetime")
    table = sessions.SessionTable(spark, scratch_path(spark, "t"), KEYS, 1800)
    for batch in (old, got):
        table.upsert(sessions.local_sessions(batch, KEYS, "datetime", 1800))
    assert as_set(table.sessions(sessions.local_sessions(old, KEYS, "datetime", 1800))) == {(1, "a", 0, 20, 3), (2, "a", 0, 0, 1)}


def test_empty_table_has_no_sessions(spark):
    like = sessions.local_sessions(events(spark, []), KEYS, "datetime", 1800)
    assert sessions.SessionTable(spark, scratch_path(spark, "t"), KEYS, 1800).sessions(like).count() == 0


def test_counted_readings(spark):
    t = T0
    rows = [
        (5, 1, "a", t, "MT", 7, "x"), (3, 1, "a", t, "MT", 0, "x"), (1, 1, "a", t, "MT", None, "x"), (4, 1, "a", t, "CT", 9, "x"),
        (6, None, "a", t, "MT", 1, "x"), (7, 1, None, t, "MT", 1, "x"), (8, 1, "a", None, "MT", 1, "x"), (9, 1, "a", t + dt.timedelta(1), "MT", 2000, "x"),
    ]
    df = spark.createDataFrame(rows, "measurement_id long, experiment_id int, fly_id string, datetime timestamp_ntz, reading_type string, value int, blk string")
    assert {(r.measurement_id, r.value) for r in counted_readings(df, ("MT", "CT")).collect()} == {(3, 0), (4, 9), (9, 2000)}
    assert [r.value for r in usable_readings(df).collect()] == [0]
    assert usable_readings(df.limit(0)).count() == 0
    assert F is not None
