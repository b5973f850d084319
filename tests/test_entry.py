"""The driver contract: names, and a few queries against their DuckDB twins."""

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: None if v is None else str(round(float(v), 4)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    return sorted([tuple(norm(r[i]) for i in order) for r in data], key=repr)


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 4


@pytest.mark.parametrize("name", ["gst_exact_summary", "gst_amount_date_pass", "tds_challan_pass", "guard_control_totals", "sync_failures", "stream_event_windows", "rule_resolution"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = driver.queries()[name](spark, SF)
    want = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
