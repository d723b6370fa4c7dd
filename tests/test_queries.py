"""Every registered query against its SQL on the smallest tables."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sql, name):
    df = contract.queries()[name](spark, SF)
    rows = df.collect()
    spark.catalog.clearCache()
    if name not in contract.oracle_sql():
        assert rows
        return
    found = sql.execute(contract.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    assert (sorted(tuple(plain(r[c]) for c in key) for r in rows)
            == sorted(tuple(plain(r[c]) for c in key) for r in want))


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "entity_id", "risk_score", "risk_label", "escalation_action", "rule_flags"]
