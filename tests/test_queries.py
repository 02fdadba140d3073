"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import canonical

CORE = {k: v for k, v in entry.queries().items() if not v.__module__.startswith("ultradia.llm")}


@pytest.fixture(scope="module")
def con(sf):
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(k for k in CORE if k in entry.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    got, want = canonical(CORE[name](spark, sf).toPandas()), canonical(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(any(k.startswith(f"p{n}_") for k in CORE) for n in range(1, 7))


def test_entry(spark):
    assert entry.entry(spark).columns == ["experiment_id", "fly_id", "session_start", "session_end", "duration_s", "n_events"]
