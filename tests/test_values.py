"""The value rules that differ from Spark's own."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tillweave.functions import rules as r
from tillweave.functions import values as v


def one(spark, **cols):
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first())


def test_empty_text_is_null(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "a string")
    assert v.blank_text_to_null(df).filter("a is null").count() == 2


def test_decode_matches_null_and_greatest_keeps_null(spark):
    df = spark.createDataFrame([(None, 1, None), ("A", 2, 5)], "k string, x int, y int")
    got = df.select(v.decode("k", {None: "none", "A": "a"}, "other"), v.greatest_null("x", "y"), v.nvl2("y", "p", "q")).collect()
    assert [tuple(x) for x in got] == [("none", None, "q"), ("a", 5, "p")]


def test_null_order_defaults(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [x[0] for x in df.orderBy(v.order_nulls("x")).collect()] == [1, 2, None]
    assert [x[0] for x in df.orderBy(v.order_nulls("x", desc=True)).collect()] == [None, 2, 1]


def test_rounding_is_half_away_from_zero(spark):
    rule = lambda c: F.round(v.nvl(c, F.lit(0).cast("decimal(10,3)")) * F.lit("1.20").cast("decimal(3,2)"), 2)
    df = spark.createDataFrame([(None,), (D("100"),), (D("1.234"),), (D("-10"),)], "x decimal(10,3)")
    assert [x[0] for x in df.select(rule("x")).collect()] == [D("0.00"), D("120.00"), D("1.48"), D("-12.00")]


def test_rate_pct_and_zero_denominator(spark):
    df = spark.createDataFrame([(D("1"), D("3")), (D("2"), D("0"))], "a decimal(14,2), b decimal(14,2)")
    assert [x[0] for x in df.select(v.rate_pct("a", "b")).collect()] == [D("33.33"), None]


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    got = one(spark, jan=v.fiscal_period(d("2024-01-31")), feb=v.fiscal_period(d("2024-02-01")),
              week=v.working_days(d("2024-03-01"), d("2024-03-10")), back=v.working_days(d("2024-03-10"), d("2024-03-01")),
              end=v.add_months_keep_end(d("2023-02-28"), 1), mid=v.add_months_keep_end(d("2023-01-30"), 1))
    assert got == (12, 1, 6, None, dt.date(2023, 3, 31), dt.date(2023, 2, 28))


def test_working_days_against_a_calendar(spark):
    days = [dt.date(2023, 12, 25) + dt.timedelta(n) for n in range(20)]
    pairs = [(a, b) for a in days for b in days]
    df = spark.createDataFrame(pairs, "a date, b date")
    want = [None if b < a else sum((a + dt.timedelta(n)).weekday() < 5 for n in range((b - a).days + 1)) for a, b in pairs]
    assert [x[0] for x in df.select(v.working_days("a", "b")).collect()] == want


def test_mail_masks(spark):
    df = spark.createDataFrame([("x@e.org",), ("anna@e.org",), ("@e.org",), ("none",), (None,)], "m string")
    assert [x[0] for x in df.select(v.mask_email("m")).collect()] == ["x*@e.org", "a***@e.org", "***", "***", None]


def test_labels_and_display(spark):
    df = spark.createDataFrame([("1 Main", None, "Cork", "T12", "IE")], "a string, b string, c string, d string, e string")
    assert df.select(v.address_label("a", "b", "c", "d", "e")).first()[0] == "1 Main, Cork, T12, IE"
    assert df.select(v.address_label("a", "b", "c", "d", "e", "MULTILINE")).first()[0] == "1 Main\nCork\nT12\nIE"
    got = one(spark, n=v.display(F.lit(D("1234.5")), "number"), t=v.display(F.lit("  "), "text"), e=v.display(F.lit("abcdefgh"), "ellipsis", 6),
              f=v.display(F.lit(None).cast("boolean"), "flag"), c=v.error_class(F.lit(-20101)), u=v.error_class(F.lit(-7)))
    assert got == ("1,234.50", "(none)", "abc...", "UNKNOWN", "APPLICATION_ERROR", "UNCLASSIFIED")


def test_price_compare_puts_missing_last(spark):
    df = spark.createDataFrame([(None, None), (None, 1), (1, None), (1, 2), (2, 1), (1, 1)], "a int, b int")
    assert [x[0] for x in df.select(v.price_compare("a", "b")).collect()] == [0, 1, -1, -1, 1, 0]


def test_benefits_in_force_and_attribute_numbers(spark):
    df = spark.sql("""select array(named_struct('code','a','valid_from',timestamp_ntz'2024-01-01','valid_to',cast(null as timestamp_ntz)),
                                   named_struct('code','b','valid_from',timestamp_ntz'2025-01-01','valid_to',cast(null as timestamp_ntz)),
                                   named_struct('code','c','valid_from',cast(null as timestamp_ntz),'valid_to',timestamp_ntz'2024-06-01')) b""")
    assert [x["code"] for x in df.select(v.active_benefits("b", "2024-06-01")).first()[0]] == ["a", "c"]
    nums = spark.createDataFrame([(" 1.5 ",), ("abc",), (None,)], "x string").select(v.attribute_number("x")).collect()
    assert [x[0] for x in nums] == [D("1.5000000000"), None, None]


def test_validators(spark):
    df = spark.createDataFrame([("4006381333931",), ("4006381333932",), ("12",), (None,)], "e string")
    assert [x[0] for x in df.select(r.valid_ean13("e")).collect()] == ["Y", "N", "N", "Y"]
    got = one(spark, amt=r.valid_amount(F.lit(D("1.23456")).cast("decimal(10,5)")), neg=r.valid_qty(F.lit(-5)), code=r.valid_code(F.lit(" ab_1 ")), bad=r.valid_code(F.lit("1ab")),
              pad=r.valid_country(F.lit("GB "), ("GB",)), text=r.valid_text(F.lit("é" * 60), 100), blank=r.valid_text(F.lit("  ")), ratio=r.valid_ratio(F.lit(11), F.lit(2), 5), zero=r.valid_ratio(F.lit(1), F.lit(0)))
    assert got == ("N", "Y", "Y", "N", "Y", "N", "N", "N", "Y")


def test_local_time_on_clock_changes(spark):
    from tillweave.operators.filters import local_time

    stores = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "store_id int, region_id int")
    regions = spark.createDataFrame([(10, "GB"), (20, "US")], "region_id int, country_code string")
    countries = spark.createDataFrame([("GB", "Europe/London"), ("US", "America/New_York")], "country_code string, tz_name string")
    ts = [(1, "2025-03-30 00:59:59"), (1, "2025-03-30 01:30:00"), (1, "2025-10-26 00:30:00"), (1, "2025-10-26 01:30:00"), (2, "2025-03-09 07:30:00"), (3, "2025-01-01 00:00:00")]
    df = spark.createDataFrame(ts, "store_id int, s string").select("store_id", F.col("s").cast("timestamp_ntz").alias("ts"))
    got = sorted(str(x[0]) for x in local_time(df, stores, regions, countries, "ts").select("local_ts").collect())
    assert got == sorted(["2025-03-30 00:59:59", "2025-03-30 02:30:00", "2025-10-26 01:30:00", "2025-10-26 01:30:00", "2025-03-09 03:30:00", "2025-01-01 00:00:00"])
