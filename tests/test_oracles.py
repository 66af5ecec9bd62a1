"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tideline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, float):
        return round(v, 6) if v != int(v) else int(v)
    return v.item() if hasattr(v, "item") else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


SLOW = {"order_projection_python_fold", "stream_foreach_batch_final_state", "catch_up_then_live", "stream_transform_with_state_final", "runner_gap_stateful"}


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - SLOW))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slower_forms_equal_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(catalogue.ORACLES[name]).df())


def test_time_batches_at_the_ends_of_days(spark, tmp_path):
    """Seconds are rounded before they are cut into days, and cut towards zero; a null time is a batch."""
    days = ["1969-12-30", "1969-12-31", "1970-01-01", "2024-01-01", "2024-01-31"]
    times = [f"TIMESTAMP '{d} {t}'" for d in days for t in ("00:00:00", "00:00:00.5", "12:00:00", "23:59:59", "23:59:59.499999", "23:59:59.5", "23:59:59.999999")] + ["NULL"]
    con = duckdb.connect()
    con.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    for i, t in enumerate(times):
        con.execute(f"insert into e values ({i}, {t}, {i % 3}, 'view', {i}, NULL)")
    con.execute(f"copy e to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = catalogue.QUERIES["time_based_batches"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(catalogue.ORACLES["time_based_batches"]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
