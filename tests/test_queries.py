"""The registered queries against their SQL, on the smallest data."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else "nan" if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    assert sorted(tables.sql(SQL[name]).columns) == names
    want = Counter(tuple(map(plain, r)) for r in tables.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in names)} from ({SQL[name]})").fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_packets_for_flows_are_made_in_tasks_of_bounded_size(spark, monkeypatch, tmp_path):
    """A split of events may hold millions; few are taken as they lie."""
    from rillflow.plans import fixtures

    spark.range(1000).selectExpr("id event_id", "timestamp_ntz'2024-01-02 03:04:05' ts", "id % 50 user_id", "'view' event_type", "1.5D value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert fixtures.dealt_packets_v(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(fixtures, "FEW_PACKETS", 100)
    told = fixtures.dealt_packets_v(spark, str(tmp_path))
    sizes = [len(p) for p in told.select("pkt_id").rdd.glom().collect()]
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) < 200
    assert told.exceptAll(fixtures.packets_v(spark, str(tmp_path))).count() == 0
