"""Stock jobs: movements into balances, snapshots, reorder lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import as_time, nvl
from tillweave.operators.merge import ordered_balances, replace_qty, upsert
from tillweave.plans.views import inventory_reorder
from tillweave.session import stash
from tillweave.sources.tables import RetailTables

KEY = ["location_id", "variant_id"]

ORDER = ["movement_id", "qty", "to_location_id", "from_location_id"]


def _accepted(stock: DataFrame, moves: DataFrame) -> DataFrame:
    """Movements with `_ok`: a quantity, and a stock row at the place they leave.

    The row is there from the start or was created by an earlier accepted movement. Only places that
    movements leave and that hold no row are looked at, as a rule few; what a movement creates there
    may let others through, so the earliest creations are found in rounds until none is added.
    """
    place, when = ["from_location_id", "variant_id"], F.struct(*ORDER)
    has_qty = F.coalesce(F.col("qty") != 0, F.lit(False))
    left = moves.filter(has_qty & F.col("from_location_id").isNotNull()).select(*place).distinct()
    bare = stash(left.join(stock.select(F.col("location_id").alias("from_location_id"), "variant_id"), place, "left_anti").withColumn("_bare", F.lit(True)))
    judged = moves.join(bare, place, "left")
    free = F.col("from_location_id").isNull() | (F.col("variant_id").isNotNull() & F.col("_bare").isNull())
    created = lambda ok: ok.select(F.col("to_location_id").alias("from_location_id"), "variant_id", when.alias("_when")).join(
        bare, place, "left_semi").groupBy(*place).agg(F.min("_when").alias("_since"))
    if bare.isEmpty():
        return judged.withColumn("_ok", has_qty & free).drop("_bare")
    since, known = stash(created(judged.filter(has_qty & free))), None
    waiting = stash(judged.filter(has_qty & ~free))
    while (n := since.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()) != known:
        known = n
        more = waiting.join(since, place).filter(F.col("_since") < when).drop("_since")
        since = stash(since.unionByName(created(more)).groupBy(*place).agg(F.min("_since").alias("_since")))
    return judged.join(since, place, "left").withColumn(
        "_ok", has_qty & (free | F.coalesce(F.col("_since") < when, F.lit(False)))).drop("_since", "_bare")


def movement_rejects(judged: DataFrame) -> DataFrame:
    """The movements left out, each with its reason."""
    reason = F.when(F.col("qty").isNull() | (F.col("qty") == 0), "Movement quantity must be non-zero").otherwise(
        F.concat(F.lit("No stock record at location "), F.col("from_location_id").cast("string")))
    return judged.filter("NOT _ok").withColumn("reject_reason", reason).drop("_ok")


def rejected_movements(stock: DataFrame, moves: DataFrame) -> DataFrame:
    """The rejects of `movement_apply` alone; no balance is computed for them."""
    return movement_rejects(_accepted(stock, moves)).select(*moves.columns, "reject_reason")


def movement_apply(stock: DataFrame, moves: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Apply movements one by one in movement order: inbound adds |qty| (creating the stock row if
    need be, and left out where the balance would stay below zero), outbound subtracts it.

    Movements without quantity, or out of a location that holds no stock row at that point, are
    rejected whole. The result does not depend on how a feed is cut into batches.
    """
    judged = _accepted(stock, moves)
    amount, side = F.abs("qty").cast("decimal(14,3)"), F.struct(F.col("movement_id"), F.col("qty"), F.col("to_location_id"), F.col("from_location_id"))
    legs = judged.filter("_ok").select("variant_id", side.alias("_when"), F.inline(F.array(
        F.struct(F.col("to_location_id").alias("location_id"), amount.alias("delta"), F.lit(True).alias("guarded")),
        F.struct(F.col("from_location_id").alias("location_id"), (-amount).alias("delta"), F.lit(False).alias("guarded")),
    ))).filter(F.col("location_id").isNotNull()).select(*KEY, "_when.movement_id", "_when.qty", F.col("_when.to_location_id").alias("_to"), (~F.col("guarded")).alias("_out"), "delta", "guarded")
    ends = ordered_balances(stock.select(*KEY, F.col("qty_on_hand").alias("balance")), legs, KEY, ["movement_id", "qty", "_to", "_out"])
    new = upsert(
        stock, ends, KEY,
        {"qty_on_hand": F.col("s.balance"), "last_movement_ts": as_time(as_of)},
        {"qty_on_hand": F.col("s.balance"), "qty_reserved": F.lit(0), "last_movement_ts": as_time(as_of), "qty_available": F.col("s.balance")},
        update_if=F.col("s.applied"))
    new = new.withColumn("qty_available", (F.col("qty_on_hand") - F.col("qty_reserved")).cast("decimal(15,3)"))
    return new, movement_rejects(judged).select(*moves.columns, "reject_reason")


def movement_bulk(stock: DataFrame, moves: DataFrame, as_of) -> DataFrame:
    """The bulk form: raw quantities, the inbound location only, existing stock rows only."""
    net = moves.groupBy(F.col("to_location_id").alias("location_id"), "variant_id").agg(F.sum("qty").alias("_net"))
    hit = F.col("_net").isNotNull()
    return stock.join(net, KEY, "left").withColumns({
        "qty_on_hand": (F.col("qty_on_hand") + nvl("_net", 0)).cast("decimal(14,3)"),
        "last_movement_ts": F.when(hit, as_time(as_of)).otherwise(F.col("last_movement_ts")),
    }).withColumn("qty_available", (F.col("qty_on_hand") - F.col("qty_reserved")).cast("decimal(15,3)")).select(*stock.columns)


def stock_resnapshot(stock: DataFrame, moves: DataFrame, locations: DataFrame, as_of, warehouse: int | None = None) -> DataFrame:
    """On-hand becomes the sum of movements *into* each location; outbound movements are ignored."""
    if warehouse is not None:
        locations = locations.filter(F.col("warehouse_id") == warehouse)
    into = moves.filter(F.col("to_location_id").isNotNull()).groupBy(
        F.col("to_location_id").alias("location_id"), "variant_id").agg(F.sum("qty").alias("qty"))
    into = into.join(locations.select("location_id"), "location_id", "left_semi")
    out = replace_qty(stock, into, KEY, "qty_on_hand", "last_movement_ts", as_of)
    return out.withColumn("qty_available", (F.col("qty_on_hand") - F.col("qty_reserved")).cast("decimal(15,3)"))


def reorder_candidates(t: RetailTables, warehouse: int | None = None) -> DataFrame:
    """Distinct variants below their reorder point."""
    low = t.inventory_stock.filter(F.col("reorder_point").isNotNull() & (F.col("qty_available") < F.col("reorder_point")))
    places = t.inventory_location.select("location_id", "warehouse_id")
    if warehouse is not None:
        places = places.filter(F.col("warehouse_id") == warehouse)
    return low.join(places, "location_id", "left_semi").select("variant_id").distinct()


def replenishment(t: RetailTables, as_of, lookback: int = 42) -> DataFrame:
    """Nightly reorder proposal per warehouse and variant.

    The source schedules this job without supplying its body; here the proposal is the larger of
    the reorder view's suggestion and the quantity sold from the warehouse in the look-back days,
    from the cheapest valid primary supplier.
    """
    now = as_time(as_of)
    low = inventory_reorder(t, as_of).filter(F.col("warehouse_id").isNotNull())
    stocks = low.groupBy("warehouse_id", "location_id", "variant_id").agg(
        F.first("qty_on_hand").alias("q"), F.first("reorder_point").alias("r"), F.first("suggested_qty").alias("s"),
        F.min(F.struct("supplier_unit_cost", "supplier_id"))["supplier_id"].alias("sup"))
    per = stocks.groupBy("warehouse_id", "variant_id").agg(
        F.sum("q").alias("qty_on_hand"), F.sum("r").alias("reorder_point"), F.sum("s").alias("need"), F.min("sup").alias("supplier_id"))
    sold = t.inventory_movement.filter(
        (F.col("movement_type") == "SALE") & (F.col("movement_ts") >= now - F.make_dt_interval(F.lit(lookback))) & (F.col("movement_ts") < now)
    ).groupBy(F.col("from_location_id").alias("location_id"), "variant_id").agg(F.sum(F.abs("qty")).alias("sold"))
    demand = sold.join(t.inventory_location.select("location_id", "warehouse_id"), "location_id").groupBy(
        "warehouse_id", "variant_id").agg(F.sum("sold").alias("sold"))
    return per.join(demand, ["warehouse_id", "variant_id"], "left").select(
        "warehouse_id", "variant_id", "qty_on_hand", "reorder_point",
        F.greatest(F.col("need"), nvl("sold", 0)).alias("suggested_qty"), "supplier_id", now.alias("run_ts"))
