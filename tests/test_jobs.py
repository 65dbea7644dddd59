"""Batch jobs: totals are conserved, rejects are disjoint, sequential rules hold."""

import random

from pyspark.sql import functions as F

from tillweave.plans import finance as fin
from tillweave.plans import inventory as inv
from tillweave.plans import loyalty as loy
from tillweave.plans import orders as ords
from tillweave.plans import procurement as proc
from tillweave.plans import quality as q
from tillweave.session import stash


def test_redeem_in_order_against_a_loop(spark, t):
    rnd = random.Random(11)
    balances = {i: rnd.randrange(0, 300) for i in range(20)}
    asks = [(rnd.choice([0, 0, 0, *range(22)]), n, rnd.randrange(1, 60)) for n in range(500)]
    accounts = spark.createDataFrame([(k, v) for k, v in balances.items()], "loyalty_id long, points_balance long")
    tables = t.replace(loyalty_account=accounts)
    ledger, after, rejects = loy.loyalty_redeem(tables, spark.createDataFrame(asks, "loyalty_id long, request_no long, points long"))
    left, taken = dict(balances), set()
    for lid, no, pts in asks:
        if left.get(lid, -1) >= pts:
            left[lid] -= pts
            taken.add((lid, no))
    assert {(r["loyalty_id"], r["request_no"]) for r in ledger.collect()} == taken
    assert {r["loyalty_id"]: r["points_balance"] for r in after.collect()} == left
    assert ledger.count() + rejects.count() == len(asks)


def test_tier_ladder(spark):
    tiers = spark.createDataFrame([("LOW", 100), ("HIGH", 1000)], "tier_code string, min_points long")
    df = spark.createDataFrame([(99,), (100,), (999,), (1000,), (None,)], "p long")
    assert [r["new_tier"] for r in loy.tiers_for(df, tiers, "p").collect()] == [None, "LOW", "LOW", "HIGH", None]


def test_movements_conserve_quantity(spark):
    stock = spark.createDataFrame([(1, 1, 10), (2, 1, 5), (3, 2, -50)], "location_id long, variant_id long, q int").select(
        "location_id", "variant_id", F.col("q").cast("decimal(14,3)").alias("qty_on_hand"), F.lit(0).cast("decimal(14,3)").alias("qty_reserved"),
        F.lit(None).cast("timestamp_ntz").alias("last_movement_ts"), F.col("q").cast("decimal(15,3)").alias("qty_available"))
    moves = spark.createDataFrame([(1, 1, 1, 2, 4), (2, 1, 1, 9, 1), (3, 1, 7, 2, 1), (4, 1, None, 1, 0), (5, 2, None, 3, 20)],
                                  "movement_id long, variant_id long, from_location_id long, to_location_id long, q int").withColumn("qty", F.col("q").cast("decimal(14,3)")).drop("q")
    new, rejects = inv.movement_apply(stock, moves, "2024-01-01")
    got = {(r["location_id"], r["variant_id"]): int(r["qty_on_hand"]) for r in new.collect()}
    assert got == {(1, 1): 5, (2, 1): 9, (9, 1): 1, (3, 2): -50}
    assert sorted(r["movement_id"] for r in rejects.collect()) == [3, 4]


def _moves(spark, rows):
    return spark.createDataFrame(rows, "movement_id long, variant_id long, from_location_id long, to_location_id long, q int").withColumn("qty", F.col("q").cast("decimal(14,3)")).drop("q")


def _replay(stock, moves):
    """Row by row in Python, to compare with batches of any size."""
    have, bad = {(r["location_id"], r["variant_id"]): int(r["qty_on_hand"]) for r in stock.collect()}, []
    for m, v, a, b, q in sorted(moves, key=lambda r: r[0]):
        if not q or (a is not None and (a, v) not in have and a != b):
            bad.append(m)
            continue
        if b is not None:
            old = have.get((b, v))
            have[b, v] = abs(q) if old is None else old + abs(q) if old + abs(q) >= 0 else old
        if a is not None:
            have[a, v] -= abs(q)
    return have, bad


def test_movements_do_not_depend_on_batches(spark):
    rnd = random.Random(8)
    stock = spark.createDataFrame([(k % 4, k // 4, rnd.choice([-30, -8, 0, 5, 20])) for k in range(12)], "location_id long, variant_id long, q int").select(
        "location_id", "variant_id", F.col("q").cast("decimal(14,3)").alias("qty_on_hand"), F.lit(0).cast("decimal(14,3)").alias("qty_reserved"),
        F.lit(None).cast("timestamp_ntz").alias("last_movement_ts"), F.lit(0).cast("decimal(15,3)").alias("qty_available"))
    rows = []
    for k in range(150):
        a, b = rnd.choice([None, 0, 1, 2, 3, 4, 5]), rnd.choice([None, 0, 1, 2, 4, 5, 6])
        rows.append((k, rnd.randrange(3), a if a != b else None, b, rnd.choice([0, 1, 3, 6, -9, 12])))
    want, bad = _replay(stock, rows)
    for n in (1, 3):
        now, rejected = stock, []
        for k in range(n):
            part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
            now, out = inv.movement_apply(now, _moves(spark, part), "2024-01-01")
            now = stash(now)
            rejected += [r["movement_id"] for r in out.collect()]
        assert {(r["location_id"], r["variant_id"]): int(r["qty_on_hand"]) for r in now.collect()} == want
        assert sorted(rejected) == bad


def test_posting_rejects_and_balances(t):
    orders = t.sales_order.limit(30)
    journals, lines, rejects = fin.sales_journal(orders, t.gl_period, 0, "2001-08-02")
    assert lines.count() == 3 * journals.count() and rejects.count() == 0
    none = fin.sales_journal(orders, t.gl_period.filter("status = 'CLOSED'"), 0, "2001-08-02")
    assert none[0].count() == 0 and none[2].count() == 30


def test_rules_pass_on_null_and_find_each_fault_once(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1), (4, 99)], "id int, x int")
    got = q.run_rules(df, "T", F.col("id"), {"LOW": "x >= 0", "HIGH": F.col("x") <= 50})
    assert sorted((r["entity_key"], r["rule_code"]) for r in got.collect()) == [("3", "LOW"), ("4", "HIGH")]


def test_generator_is_independent_of_partitioning_and_balanced(spark):
    from tillweave.generate.tables import generate

    a, b = generate(spark, 1, 7), generate(spark, 1, 7)
    for name in ("sales_order", "gl_journal_line", "product"):
        h = lambda df: df.select(F.xxhash64(*[c for c, k in df.dtypes if not k.startswith("map")]).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
        assert h(a[name]) == h(b[name].repartition(3))
    sums = a["gl_journal_line"].groupBy("journal_id").agg((F.sum("debit_amount") - F.sum("credit_amount")).alias("x"))
    assert sums.filter("x <> 0").count() == 0
    assert h(generate(spark, 1, 8, ["gen_orders"])["sales_order"]) != h(a["sales_order"])


def test_month_end_stops_after_a_failure(t, tmp_path):
    from tillweave.plans.batch import month_end

    assert [s for _, s in month_end(t, 199501, "1996-01-05", "2001-08-02", str(tmp_path))] == ["FAILED", "SKIPPED", "SKIPPED"]


def test_purchase_requests_that_share_an_id_are_numbered_alike_in_every_run(spark, t):
    asks = [(7, s, 1, "2001-08-01") for s in range(1, 40) if s % 7 not in (0,)]
    random.Random(5).shuffle(asks)
    frame = spark.createDataFrame(asks, "request_id long, supplier_id long, warehouse_id long, d string").withColumn("order_date", F.col("d").cast("timestamp_ntz")).drop("d")
    known = t.supplier.limit(1).select(*[F.col(c) for c in t.supplier.columns if c not in ("supplier_id", "is_approved")])
    suppliers = spark.range(1, 40).select(F.col("id").alias("supplier_id"), F.lit("Y").alias("is_approved")).crossJoin(known)
    made = proc.po_create(frame, t.replace(supplier=suppliers), 100)[0]
    assert [r["supplier_id"] for r in made.orderBy("po_id").collect()] == sorted(a[1] for a in asks)


def test_placing_prices_the_baskets_once(spark, t):
    """Heads and lines of the placed orders come from one written copy of the sound lines."""
    ok = t.sales_order_line.join(t.sales_order.select("order_id", "customer_id", "store_id", "channel_code"), "order_id").select(
        F.col("order_id").alias("basket_id"), "line_no", "variant_id", "qty", F.col("unit_price").alias("sell_price"), "customer_id", "store_id", "channel_code")
    lines = ords.orders_place(ok, t, 10, "2001-08-01")[1]
    assert not any(p.endswith(("lineitem.parquet", "orders.parquet")) for p in lines.inputFiles())
    assert lines.count() == ok.count()


def test_prices_of_one_small_file_are_made_by_many_tasks(spark, t):
    """A part becomes twenty prices, so one file of parts may not be one task; its variants stay together."""
    spread = t.price_list_item.select("variant_id", F.spark_partition_id().alias("task")).groupBy("variant_id").agg(
        F.min("task").alias("task"), F.count_distinct("task").alias("tasks"))
    out = spread.agg(F.count_distinct("task").alias("used"), F.max("tasks").alias("most")).first()
    assert out["used"] == int(spark.conf.get("spark.sql.shuffle.partitions")) and out["most"] == 1


def test_only_keys_whose_guard_can_fire_are_put_in_order(spark, monkeypatch):
    """Increases from a sound balance, unguarded decreases and a first copy are settled by one sum."""
    from tillweave.operators import merge

    seen, whole = [], merge.running_total
    monkeypatch.setattr(merge, "running_total", lambda events, *a: (seen.append({r["k"] for r in events.select("k").distinct().collect()}), whole(events, *a))[1])
    start = spark.createDataFrame([(1, 10), (2, 3), (3, -5), (4, 2), (None, 1)], "k int, balance int").withColumn("balance", F.col("balance").cast("decimal(14,3)"))
    rows = [(1, 1, 4, True), (1, 2, -10, True), (2, 1, -9, False), (3, 1, 4, True), (3, 2, 6, True), (4, 1, -3, True), (4, 2, 1, True), (5, 1, 7, True), (None, 1, 3, True), (None, 2, -1, True)]
    events = spark.createDataFrame(rows, "k int, o int, delta int, guarded boolean").withColumn("delta", F.col("delta").cast("decimal(14,3)"))
    out = {r["k"]: int(r["balance"]) for r in merge.ordered_balances(start, events, ["k"], ["o"]).collect()}
    assert seen == [{3, 4, None}]
    assert out == {1: 4, 2: -6, 3: 1, 4: 3, 5: 7, None: 2}


def test_rejected_movements_need_no_balances(spark, t, monkeypatch):
    want = sorted(r["movement_id"] for r in inv.movement_apply(t.inventory_stock, t.inventory_movement, "2001-08-02")[1].collect())
    monkeypatch.setattr(inv, "ordered_balances", None)
    assert sorted(r["movement_id"] for r in inv.rejected_movements(t.inventory_stock, t.inventory_movement).collect()) == want and want


def test_fulfilment_moves_each_row_once_and_unsummed(spark, t):
    """Orders and their rows are shuffled once each; nothing is aggregated below the shuffle."""
    from tillweave.plans import views

    df = views.order_fulfilment_status(t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Aggregate" not in plan[plan.index("REPARTITION_BY_NUM"):]


def test_fulfilment_of_repeated_and_unnumbered_lines(spark, t):
    """Both rows of a repeated line meet the whole shipped sum; a shipped row without a line number or without a line meets none."""
    from tillweave.plans import views

    rows = lambda data, names: spark.createDataFrame(data, names)
    num = lambda df, *cs: df.withColumns({c: F.col(c).cast("decimal(12,3)") for c in cs})
    lines = num(rows([(1, 1, 4), (1, 1, 6), (1, None, 2), (2, 1, 5)], "order_id long, line_no long, qty int"), "qty")
    shipped = num(rows([(1, 1, 3), (1, 1, 2), (1, None, 9), (2, 7, 1), (3, 1, 1)], "order_id long, order_line_no long, qty_shipped int"), "qty_shipped")
    paid = rows([(1, "CAPTURED", 8), (1, "CAPTURED", 1), (2, "PENDING", 7)], "order_id long, status string, a int").withColumn("amount", F.col("a").cast("decimal(14,2)"))
    orders = t.sales_order.filter("order_id <= 3 AND order_id >= 1")
    out = views.order_fulfilment_status(t.replace(sales_order=orders, sales_order_line=lines, shipment_line=shipped, order_payment=paid))
    got = {r["order_id"]: (r["line_count"], int(r["qty_ordered"]), int(r["qty_shipped"]), r["fulfilment_state"], int(r["amount_captured"])) for r in out.collect()}
    want = {1: (3, 12, 10, "PARTIAL", 9), 2: (1, 5, 0, "UNSHIPPED", 0), 3: (0, 0, 0, "UNSHIPPED", 0)}
    assert got == {k: v for k, v in want.items() if k in got} and len(got) == orders.count() > 0


def test_order_totals_rank_no_lines(spark, t, monkeypatch):
    monkeypatch.setattr(proc, "rank_cols", None)
    asks = t.purchase_order_line.select("po_id", F.col("line_no").alias("seq"), "variant_id", F.col("qty_ordered").alias("qty"), "unit_cost")
    before = {r["po_id"]: r["order_total"] for r in t.purchase_order_line.filter("coalesce(status, 'OPEN') <> 'CANCELLED'").groupBy("po_id").agg(F.sum(F.col("qty_ordered") * F.col("unit_cost")).alias("order_total")).collect()}
    added = {r["po_id"]: r["v"] for r in asks.groupBy("po_id").agg(F.sum(F.col("qty") * F.col("unit_cost")).alias("v")).collect()}
    after = {r["po_id"]: r["order_total"] for r in proc.po_totals(asks, t).collect()}
    assert after == {k: round(before.get(k, 0) + v, 2) for k, v in added.items()}
