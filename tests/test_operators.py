"""Ranks, positions, hierarchies, merges and as-of joins against brute force."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillweave.functions.values import By, keep_last
from tillweave.operators import aggregates as a
from tillweave.operators import hierarchy as h
from tillweave.operators import joins as j
from tillweave.operators import merge as m
from tillweave.operators import positions as p
from tillweave.session import stash


def skewed(spark, n=600, seed=3):
    """One group holds most rows; values repeat and some are NULL."""
    rnd = random.Random(seed)
    data = [(i, "hot" if rnd.random() < 0.6 else rnd.choice("abc"), rnd.choice([None, 1, 2, 3, 5, 8])) for i in range(n)]
    return spark.createDataFrame(data, "id int, g string, v int")


@pytest.mark.parametrize("desc,nulls", [(True, "last"), (False, "first")])
def test_spread_ranks_equal_windows(spark, desc, nulls):
    df = skewed(spark)
    kinds = {"rn": "row_number", "rk": "rank", "dr": "dense_rank", "pr": "percent_rank", "cd": "cume_dist", "nt": ("ntile", 7)}
    key = By("v", desc, nulls).key()
    over, total = Window.partitionBy("g").orderBy(key), Window.partitionBy("g").orderBy(key, "id")
    plain = df.select("id", F.row_number().over(total).alias("rn"), F.rank().over(over).alias("rk"), F.dense_rank().over(over).alias("dr"),
                      F.percent_rank().over(over).alias("pr"), F.cume_dist().over(over).alias("cd"), F.ntile(7).over(total).alias("nt"))
    wide = p.rank_cols(df, ["g"], [By("v", desc, nulls)], kinds, ["id"])
    get = lambda x: sorted(map(tuple, x.select("id", *kinds).collect()))
    assert get(plain) == get(wide)


def test_running_total_and_ids(spark):
    df = skewed(spark).withColumn("v", F.coalesce("v", F.lit(0)))
    get = lambda x: sorted(map(tuple, x.select("id", "s").collect()))
    plain = df.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    assert get(p.running_total(df, ["g"], [F.col("id")], "v", "s")) == get(plain)
    ids = p.assign_ids(df, [F.col("id")], start=0, prefix="RMA", width=4, cycle=250).select("id", "ref").orderBy("id").collect()
    assert ids[0]["ref"] == "RMA0001" and ids[250]["ref"] == "RMA0001" and ids[249]["ref"] == "RMA0250"


def test_keep_last_takes_all_tied_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "b"), ("a", 2, "c"), ("b", 1, None)], "g string, o int, v string")
    assert sorted(map(tuple, df.groupBy("g").agg(keep_last("v", "o")).collect())) == [("a", "c"), ("b", None)]


def test_nth_from_last_and_limit_forms(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x int")
    assert df.select(a.nth_from_last([], [("x", False)], "x", 2)).first()[0] == 3
    assert [r[0] for r in a.top_n(df, [F.desc("x")], 2).collect()] == [4, 3]
    assert a.limit_then_sort(df, 2, [F.desc("x")]).count() == 2


def test_split_keeps_empty_parts(spark):
    df = spark.createDataFrame([("a,,b,",), (None,), ("",)], "t string")
    got = [(r["t"], r["part_no"], r["part"]) for r in a.split_rows(df, "t").collect()]
    assert got == [("a,,b,", 1, "a"), ("a,,b,", 2, ""), ("a,,b,", 3, "b"), ("a,,b,", 4, ""), ("", 1, "")]
    assert [r["part"] for r in a.split_rows(spark.createDataFrame([("a.|b.|c",)], "t string"), "t", ".|").collect()] == ["a", "b", "c"]


TREE = [(1, None, "r"), (2, 1, "a"), (3, 1, "b"), (4, 2, "c"), (5, 4, "d"), (7, 8, "x"), (8, 7, "y"), (9, 9, "s"), (10, 7, "tail"), (11, 99, "lost")]


def test_hierarchy_paths_leaves_and_holes(spark):
    df = spark.createDataFrame(TREE, "id int, pid int, name string")
    got = {r["id"]: r for r in h.hierarchy(df, "id", "pid", paths={"path": ("name", "/")}, roots={"top": "name"}, prior={"up": "name"}, sort=["name"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[5]["path"] == "/r/a/c/d" and got[5]["level"] == 4 and got[5]["is_leaf"] == 1 and got[4]["is_leaf"] == 0 and got[5]["up"] == "c"
    order = [r["id"] for r in h.order_siblings(h.hierarchy(df, "id", "pid", sort=["name"])).collect()]
    assert order == [1, 2, 4, 5, 3]


def test_rings_stop_and_are_reported(spark):
    df = spark.createDataFrame(TREE, "id int, pid int, name string")
    walk = {(r["id"], r["level"], r["is_cycle"]) for r in h.hierarchy(df, "id", "pid", start=F.col("id") == 7).collect()}
    assert walk == {(7, 1, 0), (8, 2, 1), (10, 2, 0)}
    assert sorted(r[0] for r in h.on_ring(df, "id", "pid").collect()) == [7, 8, 9]
    rep = h.cycle_report(df, "id", "pid").first().asDict()
    assert rep == {"nodes": 10, "roots": 1, "self_parents": 1, "dangling": 1, "reached": 5, "unreached": 5}
    assert {r["id"]: r["depth"] for r in h.depth_all(df, "id", "pid").collect()}[5] == 4


def test_ambiguous_path(spark):
    df = spark.createDataFrame([(1, None, "r"), (2, None, "q"), (3, 1, "x"), (3, 2, "x")], "id int, pid int, name string")
    assert {r["id"]: r["path"] for r in h.path_all(df, "id", "pid", "name").collect()} == {1: "r", 2: "q", 3: "(ambiguous)"}


def test_merge_delete_sees_only_updated_rows(spark):
    t = spark.createDataFrame([(1, "RESOLVED", "a"), (2, "RESOLVED", "b"), (3, "INFO", "c")], "k int, sev string, d string")
    s = spark.createDataFrame([(1, "n1"), (3, "n3"), (4, "n4")], "k int, nd string")
    out = m.upsert_delete(t, s, ["k"], {"d": F.col("s.nd")}, {"sev": F.lit("INFO"), "d": F.col("s.nd")}, F.lit(True), F.col("sev") == "RESOLVED")
    assert sorted(map(tuple, out.collect())) == [(2, "RESOLVED", "b"), (3, "INFO", "n3"), (4, "INFO", "n4")]


def test_null_safe_and_update_only(spark):
    x = spark.createDataFrame([(1, None), (2, "a")], "k int, v string")
    y = spark.createDataFrame([(1, "z"), (2, "a"), (3, "q")], "k int, v string")
    assert sorted(map(tuple, m.update_where_changed(x, y, ["k"], ["v"]).collect())) == [(1, "z"), (2, "a")]
    left, right = spark.createDataFrame([(None, 1)], "k int, a int"), spark.createDataFrame([(None, 2)], "k int, b int")
    assert [tuple(r) for r in j.null_safe_join(left, right, ["k"]).select("a", "b").collect()] == [(1, 2)]


def test_reject_duplicates_partitions_the_input(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "seq int, sku string")
    ok, dup = m.reject_duplicates(new, spark.createDataFrame([("c",)], "sku string"), "sku", ["seq"])
    assert sorted(r["seq"] for r in ok.collect()) == [1, 3] and sorted(r["seq"] for r in dup.collect()) == [2, 4]


def test_fx_asof_boundaries_and_inverse(spark):
    ts = lambda s: dt.datetime.fromisoformat(s)
    rates = spark.createDataFrame([("EUR", "GBP", ts("2024-01-10"), D("0.8")), ("EUR", "GBP", ts("2024-03-05"), D("0.9")), ("GBP", "USD", ts("2024-01-01"), D("1.25"))],
                                  "from_currency string, to_currency string, rate_date timestamp_ntz, rate decimal(18,8)")
    asks = [(1, "EUR", "GBP", ts("2024-01-09")), (2, "EUR", "GBP", ts("2024-01-10")), (3, "EUR", "GBP", ts("2024-03-04T23:59:59")), (4, "EUR", "GBP", ts("2025-06-01")),
            (5, "USD", "GBP", ts("2024-02-01")), (6, "GBP", "GBP", ts("2020-01-01")), (7, "JPY", "GBP", ts("2024-02-01"))]
    df = spark.createDataFrame(asks, "id int, f string, g string, d timestamp_ntz")
    got = {r["id"]: r["rate"] for r in j.fx_asof(df, rates, "f", "g", "d").collect()}
    assert got[1] is None and got[7] is None
    assert (got[2], got[3], got[4], got[5], got[6]) == (D("0.8"), D("0.8"), D("0.9"), D("0.8"), D("1"))


def test_asof_matches_brute_force(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    quotes = {(k, base + dt.timedelta(hours=rnd.randrange(5000))): rnd.randrange(1000) for k in "ab" for _ in range(40)}
    asks = [(i, rnd.choice("abc"), base + dt.timedelta(hours=rnd.randrange(6000))) for i in range(300)]
    right = spark.createDataFrame([(k, d, v) for (k, d), v in quotes.items()], "k string, d timestamp_ntz, v int")
    left = spark.createDataFrame(asks, "id int, k string, at timestamp_ntz")
    got = {r["id"]: r["v"] for r in j.asof(left, ["k"], "at", (right, "d", ["v"])).collect()}
    for i, k, at in asks:
        known = [d for (kk, d) in quotes if kk == k and d <= at]
        assert got[i] == (quotes[(k, max(known))] if known else None)
    assert len(got) == len(asks)


def test_dynamic_predicate_must_be_a_condition(spark):
    from tillweave.operators.filters import filter_text

    df = spark.range(5)
    assert filter_text(df, None).count() == 5 and filter_text(df, "id > 2").count() == 2
    with pytest.raises(ValueError):
        filter_text(df, "id + 1")


def test_asof_with_a_hot_key(spark):
    """One key holds most rows and fills several slices; times tie, and some slices hold no quote."""
    rnd = random.Random(5)
    asks = [(k, rnd.choice("aaaaaaaab") if k % 50 else None, rnd.randrange(1000) if k % 40 else None) for k in range(1500)]
    quotes = [(key, at, rnd.randrange(10**6)) for key in "ab" for at in sorted(rnd.sample(range(1000), 12))] + [(None, 1, 1), ("a", None, 2), ("c", 3, 3)]
    stamp = lambda df: df.withColumn("at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    left = stamp(spark.createDataFrame(asks, "id long, key string, at long")).repartition(5)
    right = stamp(spark.createDataFrame(quotes, "key string, at long, v long"))
    late = right.filter("v % 2 = 0").withColumnRenamed("v", "w")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = j.asof(left, ["key"], "at", (right, "at", ["v"]), (late, "at", ["w"])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

    def newest(key, at, even):
        fit = [(t, v) for k, t, v in quotes if None not in (key, at, k, t) and k == key and t <= at and (v % 2 == 0 or not even)]
        return max(fit)[1] if fit else None

    assert sorted((r.id, r.v, r.w) for r in out) == [(i, newest(k, t, False), newest(k, t, True)) for i, k, t in asks]


def test_climb_by_doubling(spark, monkeypatch):
    """A line of 5,000 in 14 rounds at most; rings, missing parents and lone nodes."""
    n, kept = 5000, []
    line = spark.createDataFrame([(k, k - 1 if k else None) for k in range(n)], "id long, up long")
    monkeypatch.setattr(h, "stash", lambda df: kept.append(1) or stash(df))
    folded = h.climb(line, "id", "up", {"depth": F.lit(1)}, {"depth": F.col("depth") + F.col("_up_depth")})
    assert len(kept) <= 15 and folded.filter("depth <> id + 1 OR _up IS NOT NULL").isEmpty() and folded.count() == n
    odd = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 99), (7, 7), (8, None), (9, 8), (10, None)]
    got = {r.id: r.depth for r in h.depth_all(spark.createDataFrame(odd, "id long, up long"), "id", "up").collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 1, 7: 1, 8: 1, 9: 2, 10: 1}
