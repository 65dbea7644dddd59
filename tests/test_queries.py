"""A sample of the registered queries against their SQL; tools/check.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tillweave.sources.binding import BASE_TABLES
from tools.check import rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["v_sales_by_store_day", "v_customer_360", "mv_customer_rfm", "hier_gl_climb", "job_effective_price", "job_tax_3", "dq_orphans", "rec_compare", "job_movement_apply", "agg_keep_last"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in BASE_TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    assert got == rows([c[0] for c in res.description], res.fetchall())


def test_every_checking_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
