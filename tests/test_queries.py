"""Every registered query that has SQL gives the rows that the SQL gives, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from millrace.plans.catalog import ORACLE_SQL, QUERIES
from millrace.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "null" if isinstance(value, float) and math.isnan(value) else f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert rows == want


def test_every_query_but_a_few_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"op74_columnar_eligibility", "op82b_crc_of_names", "op92b_budgeted_slots", "op93b_load_aware_allocations", "op94b_relaxed_placement"}
