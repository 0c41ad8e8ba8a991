"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from offermatch.sources.bridge import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"cascade_deals"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert ordered(got) == ordered(want)
    assert got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_cascade_invariants(spark):
    from offermatch.plans.audit_queries import full_run

    run = full_run(spark, SF)
    deals = run.deals.select("listing_id", "price_flag", "audit_source", "offer_price", "deal_price").collect()
    ids = [d.listing_id for d in deals if d.audit_source == "gemini"]
    assert deals and len(ids) == len(set(ids))
    assert all(d.price_flag not in ("placeholder_zero", "suspiciously_low") for d in deals)
    assert all(0 < d.offer_price <= d.deal_price for d in deals)
    model = set(ids)
    assert not model & {d.listing_id for d in deals if d.audit_source != "gemini"}
    assert run.listings.count() == 6000
