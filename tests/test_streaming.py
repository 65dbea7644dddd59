"""A replay in one batch, in several batches and a full recompute agree."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tillweave.sources.extracts import publish, published
from tillweave.streaming import changes as ch
from tillweave.streaming import handlers as h
from tillweave.streaming import refresh as rf

SPEC = rf.AggregateSpec(("g",), "n", ("v",))


def feed(spark, path, rows, files):
    df = spark.createDataFrame(rows, "id int, g string, v int")
    images = df.select(F.lit("I").alias("op"), F.col("id").cast("bigint").alias("seq"), F.lit(None).cast("struct<id:int,g:string,v:int>").alias("old"), F.struct("id", "g", "v").alias("new"))
    gone = images.filter("id % 3 = 0").select(F.lit("D").alias("op"), "seq", F.col("new").alias("old"), F.lit(None).cast("struct<id:int,g:string,v:int>").alias("new"))
    images.unionByName(gone).repartition(files).write.parquet(path)
    return ch.read_changes(spark, path, ch.change_schema(df), 1)


EMPTY = "g string, n bigint, v bigint, v_cnt bigint"


def kept(spark, tmp_path, start, rows, files):
    start.write.parquet(str(tmp_path / "mv"))
    store = rf.KeptSums(spark, SPEC, start.schema, str(tmp_path / "cp"))
    deltas = rf.image_deltas(feed(spark, str(tmp_path / "in"), rows, files), SPEC, {"v": F.col("v")})
    return store, store.run(spark.readStream.schema(start.schema).parquet(str(tmp_path / "mv")), deltas, f"q{uuid.uuid4().hex[:6]}")


@pytest.mark.parametrize("files", [1, 3, 7])
def test_fast_refresh_equals_recompute(spark, tmp_path, files):
    rows = [(i, "abc"[i % 3], None if i % 5 == 0 else i) for i in range(60)]
    store, _ = kept(spark, tmp_path, spark.createDataFrame([("b", 2, 7, 1), ("z", 1, None, 0)], EMPTY), rows, files)
    want = {"b": (2, 7, 1), "z": (1, None, 0)}
    for i, g, v in rows:
        if i % 3:
            n, s, c = want.get(g, (0, None, 0))
            want[g] = (n + 1, (s or 0) + v if v is not None else s, c + (v is not None))
    assert {r["g"]: (r["n"], r["v"], r["v_cnt"]) for r in store.read().collect()} == want


def test_a_batch_does_not_read_earlier_ones(spark, tmp_path):
    """Rows read and groups touched stay the same from batch to batch while the state grows."""
    images = "struct<id:int,g:string,v:int>"
    for k in range(8):
        df = spark.createDataFrame([(i, f"g{k}", 1) for i in range(10)], "id int, g string, v int")
        df.select(F.lit("I").alias("op"), F.lit(k).cast("bigint").alias("seq"), F.lit(None).cast(images).alias("old"), F.struct("id", "g", "v").alias("new")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = spark.createDataFrame([], EMPTY)
    start.write.parquet(str(tmp_path / "mv"))
    store = rf.KeptSums(spark, SPEC, start.schema, str(tmp_path / "cp"))
    stream = ch.read_changes(spark, str(tmp_path / "in"), ch.change_schema(df), 1)
    query = store.run(spark.readStream.schema(start.schema).parquet(str(tmp_path / "mv")), rf.image_deltas(stream, SPEC, {"v": F.col("v")}), "reads")
    seen = [(p.numInputRows, p.stateOperators[0].numRowsUpdated) for p in query.recentProgress if p.numInputRows]
    assert len(seen) == 8 and all(x == seen[0] for x in seen)
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 8 and store.read().count() == 8


def test_diff_round_trip(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, v string")
    got = sorted((r["op"], (r["new"] or r["old"])["k"]) for r in ch.diff_changes(old, new, ["k"]).collect())
    assert got == [("D", 3), ("I", 4), ("U", 2)]


def test_refresh_modes_fall_back(spark, tmp_path):
    path = str(tmp_path / "mv")
    old, new = spark.range(10).withColumnRenamed("id", "k"), spark.range(100, 400).withColumnRenamed("id", "k")
    read = lambda: sorted(r["k"] for r in published(spark, path).collect())
    # fails on an executor after other rows were written
    broken = lambda: new.repartition(6).select(F.when(F.col("k") == 399, F.raise_error(F.lit("lost"))).otherwise(F.col("k")).cast("bigint").alias("k"))
    publish(old, path)
    with pytest.raises(Exception, match="lost"):
        rf.refresh("F", path, lambda: new, broken)
    assert read() == list(range(10))  # the attempt left the copy alone
    assert rf.refresh("?", path, lambda: new, broken) == "COMPLETE" and read() == list(range(100, 400))
    assert rf.refresh("F", path, lambda: old, lambda: published(spark, path).filter("k < 103")) == "FAST" and read() == [100, 101, 102]
    assert rf.refresh("?", path, lambda: old, lambda: new, lambda: False) == "COMPLETE" and read() == list(range(10))
    assert rf.refresh("C", path, lambda: old.limit(0), lambda: new) == "COMPLETE" and read() == []
    with pytest.raises(ValueError):
        rf.refresh("F", path, lambda: new)


def test_log_reaches_back(spark):
    log = lambda seqs: spark.createDataFrame([(k,) for k in seqs], "seq long")
    assert rf.covers(log([3, 4, 5]), 2) and rf.covers(log([1, 2]), 2) and rf.covers(log([]), 0)
    assert not rf.covers(log([4, 5]), 2) and not rf.covers(log([3, 5]), 2)


IMAGE = "named_struct('fulfil_location_id', 1L, 'variant_id', v, 'qty', CAST({} AS DECIMAL(12,3)))"


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_reservations_do_not_depend_on_batches(spark, tmp_path, batches):
    """Every change floors at zero, in order of seq; rows lie in files in any order."""
    rnd = random.Random(4)
    stock = spark.createDataFrame([(1, v, v * 4 - 4) for v in range(4)], "location_id long, variant_id long, b int").select(
        "location_id", "variant_id", F.lit(50).cast("decimal(14,3)").alias("qty_on_hand"), F.greatest("b", F.lit(0)).cast("decimal(14,3)").alias("qty_reserved"),
        F.lit(None).cast("timestamp_ntz").alias("last_movement_ts"), F.lit(0).cast("decimal(15,3)").alias("qty_available"))
    rows = [(k, rnd.choice("IDU"), rnd.randrange(3), rnd.randrange(1, 9), rnd.randrange(1, 9)) for k in range(84)] + [(90, "I", 9, 1, 1)]
    want = {v: max(v * 4 - 4, 0) for v in range(4)}
    for _, op, v, old, new in rows[:-1]:
        want[v] = max(want[v] + {"I": new, "D": -old, "U": new - old}[op], 0)
    for k in range(batches):
        part = rows[k * 85 // batches : (k + 1) * 85 // batches]
        rnd.shuffle(part)
        made = spark.createDataFrame(part, "seq long, op string, v long, o int, n int").selectExpr("op", "seq", f"IF(op <> 'I', {IMAGE.format('o')}, NULL) AS old", f"IF(op <> 'D', {IMAGE.format('n')}, NULL) AS new")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ch.run_kept(h.reservation_state(stream), str(tmp_path / "cp"), f"reserve{batches}")
    assert len([p for p in query.recentProgress if p.numInputRows]) == batches
    out = h.with_reservations(stock, ch.read_state(spark, str(tmp_path / "cp"), ["total", "floor"]), "2024-01-01").collect()
    assert {r["variant_id"]: int(r["qty_reserved"]) for r in out} == want
    assert all(int(r["qty_available"]) == 50 - want[r["variant_id"]] and (r["last_movement_ts"] is None) == (r["variant_id"] == 3) for r in out)


def test_neighbouring_places_share_one_state(spark, tmp_path):
    """A thousand places of one location are a few states, over several batches; rows without a place book nothing."""
    image = "named_struct('fulfil_location_id', {}, 'variant_id', {}, 'qty', CAST(2 AS DECIMAL(12,3)))"
    for k, place in enumerate(("1L", "1L", "CAST(NULL AS BIGINT)")):
        v = image.format(place, "id")
        spark.range(1000).selectExpr("'I' AS op", f"{k * 1000} + id AS seq", f"IF(id < 0, {v}, NULL) AS old", f"{v} AS new").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ch.run_kept(h.reservation_state(stream), str(tmp_path / "cp"), "pages")
    state = ch.read_state(spark, str(tmp_path / "cp"), ["total", "floor"])
    assert state.count() == 1 + (999 >> h.PAGE_BITS)
    stock = spark.range(1000).selectExpr("1L AS location_id", "id AS variant_id", "CAST(50 AS DECIMAL(14,3)) AS qty_on_hand", "CAST(1 AS DECIMAL(14,3)) AS qty_reserved",
                                         "CAST(NULL AS TIMESTAMP_NTZ) AS last_movement_ts", "CAST(49 AS DECIMAL(15,3)) AS qty_available")
    out = h.with_reservations(stock, state, "2024-01-01")
    assert {tuple(r) for r in out.select(F.col("qty_reserved").cast("int"), F.col("qty_available").cast("int")).collect()} == {(5, 45)}


def test_a_query_goes_on_from_its_state(spark, tmp_path):
    """A second run of the same checkpoint reads the new files only and keeps what was there."""
    orders = spark.createDataFrame([(1, "CART"), (2, "CART"), (3, "SHIPPED")], "order_id long, status string")
    orders.write.parquet(str(tmp_path / "orders"))
    kind = "struct<order_id:long,status:string>"
    pay = lambda i: spark.createDataFrame([("U", 1, (i, "OPEN"), (i, "CAPTURED"))], f"op string, seq long, old {kind}, new {kind}")
    seen = {}
    for i in (1, 3):
        pay(i).coalesce(1).write.mode("append").parquet(str(tmp_path / "pay"))
        streams = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "orders")), spark.readStream.schema(pay(1).schema).parquet(str(tmp_path / "pay"))
        query = ch.run_kept(h.payment_state(*streams), str(tmp_path / "cp"), f"pay{i}")
        seen[i] = sum(p.numInputRows for p in query.recentProgress)
    assert seen == {1: 4, 3: 1}
    state = ch.read_state(spark, str(tmp_path / "cp"), ["status", "paid"])
    assert sorted(map(tuple, h.captured_orders(state).collect())) == [(1, "PLACED"), (2, "CART"), (3, "SHIPPED")]


def test_mixed_audit_rows(spark):
    """Changes of several tables in one frame; a table with two rules gives two rows, one without none."""
    def change(table, op, old, new, kind):
        df = spark.createDataFrame([(op, old, new)], f"op string, old struct<{kind}>, new struct<{kind}>")
        return h.as_mixed(df, table)

    frames = [
        change("loyalty_account", "U", (7, "GOLD", None), (7, "GOLD", 12), "loyalty_id:long,tier_code:string,points_balance:long"),
        change("gl_journal_line", "D", (3, 2), None, "journal_id:long,line_no:int"),
        change("order_payment", "U", (1, "OPEN"), (1, "OPEN"), "payment_id:long,status:string"),
        change("order_payment", "U", (2, "OPEN"), (2, "CAPTURED"), "payment_id:long,status:string"),
        change("coupon", "D", (5, "X1", None, 4), None, "coupon_id:long,coupon_code:string,promotion_id:long,redemption_count:long"),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    assert sorted(map(tuple, h.audit_mixed(out).collect()), key=str) == sorted([
        ("LOYALTY_ACCOUNT", "7", "U", "GOLD|", "GOLD|12"), ("LOYALTY_ACCOUNT", "7", "U", "see application journal", "see application journal"),
        ("GL_JOURNAL_LINE", "3/2", "D", None, None), ("ORDER_PAYMENT", "2", "U", "OPEN", "CAPTURED"),
        ("COUPON", "5", "D", "X1|promo=|redemptions=4", None), ("COUPON", "5", "D", "see application journal", None)], key=str)
    assert len(h.AUDIT_RULES) == 14


def test_audit_of_mixed_rows_is_compiled_to_small_methods(spark):
    """No lambda that runs interpreted, and no method too long for the JVM to optimise."""
    kind = "struct<customer_id:long,customer_ref:string,last_name:string,status:string>"
    changes = h.as_mixed(spark.createDataFrame([], f"op string, old {kind}, new {kind}"), "customer")
    plan = h.audit_mixed(changes)._jdf.queryExecution().executedPlan()
    assert "lambda" not in plan.toString()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    assert stages.size() and max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
