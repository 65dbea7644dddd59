"""Rows of seven tables cleaned as they arrive."""

import functools

import pytest
from pyspark.sql import functions as F

from tillweave.catalog import streams
from tillweave.streaming import handlers as h


@pytest.fixture(scope="module")
def once(t):
    return sorted(tuple(r) for r in streams.normalised(t, 1).collect())


@pytest.mark.parametrize("batches", [3, 7])
def test_ingest_does_not_depend_on_the_batches(t, once, batches):
    assert sorted((tuple(r) for r in streams.normalised(t, batches).collect()), key=str) == sorted(once, key=str)


def test_ids_given_are_unique_and_above_the_last(once):
    given = [(n, k) for n, k, *_ in once if k > streams.LAST_ID]
    assert {n for n, _ in given} == {n for n, key in h.INGEST_IDS.items() if key} and len(set(given)) == len(given)


def test_rows_without_values(spark):
    one = lambda table, schema, row: h.as_arrivals(spark.createDataFrame([row], schema), table, F.lit(4))
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        one("address", "address_id bigint, line1 string, city string", (None, "  1 High St ", None)),
        one("customer", "customer_id bigint, customer_ref string, email string, created_ts timestamp", (None, None, " ", None)),
        one("supplier", "supplier_id bigint, contact_name string, contact_email string, is_approved string", (9, "Ann", None, "Y")),
        one("promotion", "promotion_id bigint, start_ts timestamp, end_ts timestamp, spent_amount decimal(14,2)", (None, None, None, None)),
        one("sales_order", "channel_code string, shipping_amount decimal(14,2), sales_employee_id bigint", (None, None, 3)),
    ])
    got = {r.table_name: r for r in h.normalise_mixed(rows, streams.AS_OF, {"address": 10, "customer": 20}).collect()}
    assert tuple(got["address"].address) == (14, "1 High St", None)
    assert got["customer"].customer.customer_ref == "CU000000000024" and got["customer"].customer.email is None and got["customer"].customer.created_ts is not None
    assert tuple(got["supplier"].supplier) == (9, "Ann", None, "N")
    assert got["promotion"].promotion.promotion_id == 4 and got["promotion"].promotion.spent_amount == 0
    assert got["sales_order"].sales_order.shipping_amount is None and got["sales_order"].sales_order.sales_employee_id is None
    assert all(r.reject_reason is None for r in got.values())


def test_a_promotion_that_ends_before_it_starts_is_rejected(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2001-01-02', TIMESTAMP'2001-01-02'), (2, TIMESTAMP'2001-01-02', TIMESTAMP'2001-01-03') AS p(promotion_id, start_ts, end_ts)")
    judged = h.normalise_mixed(h.as_arrivals(rows.withColumn("spent_amount", F.lit(None).cast("decimal(14,2)")), "promotion", F.col("promotion_id")), streams.AS_OF, {})
    assert {r.promotion.promotion_id: r.reject_reason for r in judged.collect()} == {1: "Promotion end_ts must be after start_ts", 2: None}
