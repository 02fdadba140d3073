"""Removal of flies by stages, and of whole experiments."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ultradia.operators import removal
from ultradia.session import scratch_path
from ultradia.sources import store

ROWS = [(1, f"M{m}_Ch{c:02d}", str(m), c, d, g, s, t) for m, c, g, s, t in [(5, 7, "Obd", "Male", "VEH"), (6, 18, "wt", "female", "10mM Gly"), (6, 1, None, "Female", None), (7, 2, "cyc", None, "veh")] for d in (1, 2, 3)]
SCHEMA = "experiment_id int, fly_id string, monitor string, channel int, exp_day int, genotype string, sex string, treatment string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA + ", _fly string").drop("_fly")


def counts(df):
    return {r.stage: (r.n, r.sources) for r in removal.counters(df).collect()}


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "fly_key string")


def days(spark, *pairs):
    return spark.createDataFrame(list(pairs), "fly_key string, exp_day int")


def test_nothing_given_removes_nothing(spark, rows):
    assert counts(removal.staged(rows)) == {"kept": (12, 4)}
    assert removal.kept(removal.staged(rows)).columns == rows.columns
    assert removal.staged(rows.limit(0), flies=keys(spark, "5-ch7")).count() == 0


@pytest.mark.parametrize("key", ["5-ch7", "5-CH7"])
def test_flies_go_whole_whatever_their_case(spark, rows, key):
    assert counts(removal.staged(rows, flies=keys(spark, key, key, "9-ch9"))) == {"kept": (9, 3), "fly": (3, 1)}


def test_channels_may_be_names(spark, rows):
    named = rows.withColumn("channel", F.concat(F.lit("CH"), "channel"))
    assert counts(removal.staged(named, flies=keys(spark, "6-ch18"))) == {"kept": (9, 3), "fly": (3, 1)}


def test_days_of_some_flies(spark, rows):
    assert counts(removal.staged(rows, fly_days=days(spark, ("5-ch7", 1), ("5-ch7", 2), ("6-CH18", 3), ("6-ch18", 9)))) == {"kept": (9, 4), "day": (3, 2)}


@pytest.mark.parametrize("given, n", [({"genotypes": ["OBD"]}, 3), ({"genotypes": ["obd", "wt"]}, 6), ({"sexes": ["FEMALE"]}, 6), ({"treatments": ["veh"]}, 6), ({"genotypes": ["obd"], "sexes": ["female"], "treatments": ["VEH"]}, 12)])
def test_metadata_case_aside_and_nulls_stay(rows, given, n):
    got = counts(removal.staged(rows, **given))
    assert got.get("metadata", (0, 0))[0] == n and sum(v[0] for v in got.values()) == 12


def test_statuses_take_the_whole_source(spark, rows):
    reports = spark.createDataFrame([(1, "M5_Ch07", "Alive"), (1, "M5_Ch07", "Dead"), (2, "M6_Ch01", "Dead"), (1, "M7_Ch02", None)], "experiment_id int, fly_id string, status string")
    assert counts(removal.staged(rows, statuses=["Dead", "QC_Fail"], reports=reports)) == {"kept": (9, 3), "status": (3, 1)}
    assert counts(removal.staged(rows, statuses=["Dead"])) == {"kept": (12, 4)}


def test_the_first_stage_counts(spark, rows):
    reports = spark.createDataFrame([(1, "M5_Ch07", "Dead")], "experiment_id int, fly_id string, status string")
    got = removal.staged(rows, statuses=["Dead"], reports=reports, flies=keys(spark, "5-ch7", "6-ch1"), fly_days=days(spark, ("6-ch1", 1), ("7-ch2", 1)), treatments=["veh"])
    assert counts(got) == {"status": (3, 1), "fly": (3, 1), "day": (1, 1), "metadata": (2, 1), "kept": (3, 1)}


def test_experiments_go_from_every_table(spark):
    root = scratch_path(spark, "tables")
    at = dt.datetime(2030, 1, 1)
    spark.createDataFrame([(1, at), (2, at)], "experiment_id int, created_at timestamp").write.parquet(f"{root}/experiments.parquet")
    for name in ("readings", "flies"):
        spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "experiment_id int, x string").write.parquet(f"{root}/{name}.parquet")
    assert {(r.experiment_id, r.table_name): r.n for r in store.experiment_info(spark, root, ("readings",)).collect()} == {(1, "readings"): 1, (2, "readings"): 2, (None, "readings"): 1}
    assert store.delete_experiments(spark, root, [2]) == {"readings": 2, "flies": 2, "experiments": 1}
    assert store.delete_experiments(spark, root, [2]) == {"readings": 0, "flies": 0, "experiments": 0}
    assert {r.x for r in store.read_table(spark, root, "readings").collect()} == {"a", "d"}
    assert store.delete_experiments(spark, root) == {"readings": 1, "flies": 1, "experiments": 1}
    assert store.latest_experiment(store.read_table(spark, root, "experiments")) is None
