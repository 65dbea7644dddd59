"""Join shapes of the source, as DataFrame joins.

None of them carries a broadcast hint: small sides are broadcast by the planner's own size check.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.values import add_months_keep_end, as_time, nvl
from tillweave.operators.positions import carry_last
from tillweave.operators.scalars import beside
from tillweave.sources.tables import RetailTables


def star(fact: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Fact joined to dimensions that must exist."""
    for dim, on in dims:
        fact = fact.join(dim, on)
    return fact


def left_chain(df: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Optional dimensions, in the order given."""
    for dim, on in dims:
        df = df.join(dim, on, "left")
    return df


def outer_shape1(t: RetailTables) -> DataFrame:
    """Every order with its customer and delivered shipments: the status test belongs to the join."""
    delivered = t.shipment.filter(F.col("status") == "DELIVERED").select(
        "order_id", "tracking_ref", F.col("status").alias("shipment_status"))
    return (
        t.sales_order.join(t.customer.select("customer_id", "customer_ref", "last_name"), "customer_id", "left")
        .join(delivered, "order_id", "left")
        .select("order_id", "order_number", F.col("status").alias("order_status"), "customer_ref", "last_name",
                "tracking_ref", "shipment_status")
    )


def outer_shape2(t: RetailTables) -> DataFrame:
    """Live purchase orders with lines; the test on the line status comes after the outer join and
    treats a missing line as OPEN."""
    lines = t.purchase_order_line.select("po_id", "line_no", "qty_ordered", "qty_received", F.col("status").alias("_ls"))
    return (
        t.purchase_order.filter(F.col("status").isin("SENT", "PART_RECV"))
        .join(t.supplier.select("supplier_id", "supplier_code", "supplier_name"), "supplier_id")
        .join(lines, "po_id", "left").filter(nvl("_ls", "OPEN") != "CANCELLED")
        .select("po_id", "po_number", "order_date", "supplier_code", "supplier_name", "line_no", "qty_ordered",
                nvl("qty_received", 0).alias("qty_received"))
    )


def outer_shape3(t: RetailTables, as_of, months: int = 24) -> DataFrame:
    """Recent returns with lines, reasons and approvers, each optional."""
    since = add_months_keep_end(as_time(as_of), -months).cast("timestamp_ntz")
    return (
        t.return_request.filter(F.col("requested_ts") >= since)
        .join(t.return_line.select("return_id", "line_no", "qty_returned", "reason_code"), "return_id", "left")
        .join(t.return_reason.select("reason_code", "reason_desc", "is_restockable"), "reason_code", "left")
        .join(t.employee.select(F.col("employee_id").alias("approved_by_employee_id"), F.col("employee_number").alias("approver")),
              "approved_by_employee_id", "left")
        .select("return_id", "rma_number", F.col("status").alias("return_status"), "line_no", "qty_returned", "reason_desc",
                "is_restockable", "approver")
    )


def orphans(child: DataFrame, parent: DataFrame, fk: list[str], pk: list[str] | None = None) -> DataFrame:
    """Child rows whose complete foreign key has no parent; a NULL in the key is no reference."""
    pk = pk or fk
    keys = parent.select(*[F.col(p).alias(f"_pk{k}") for k, p in enumerate(pk)])
    for c in fk:
        child = child.filter(F.col(c).isNotNull())
    cond = [F.col(c) == F.col(f"_pk{k}") for k, c in enumerate(fk)]
    return child.join(keys, cond, "left_anti")


def exists_in(df: DataFrame, other: DataFrame, on: list[str] | str) -> DataFrame:
    return df.join(other, on, "left_semi")


def country_variants(t: RetailTables, country: str) -> DataFrame:
    """Active variants seen from one country: the country row is attached as a scalar."""
    variants = t.product_variant.filter(F.col("is_active") == "Y").join(
        t.product.select("product_id", "list_price", F.col("status").alias("product_status"), "launch_date"), "product_id")
    return beside(variants, t.country.filter(F.col("country_code") == country)).filter(F.col("country_code").isNotNull())


def currency_pairs_quoted(rates: DataFrame) -> DataFrame:
    """Ordered pairs of unequal currencies that have ever been quoted, in either direction."""
    both = rates.select("from_currency", "to_currency").union(rates.select("to_currency", "from_currency"))
    return both.filter(F.col("from_currency") != F.col("to_currency")).distinct()


def with_lookup_agg(df: DataFrame, child: DataFrame, on: list[str] | str, aggs: list[Column]) -> DataFrame:
    """Correlated scalar subqueries over one child: aggregated once per key, then joined."""
    keys = [on] if isinstance(on, str) else on
    return df.join(child.groupBy(*keys).agg(*aggs), keys, "left")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys match each other."""
    r = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    return a.join(r, [a[k].eqNullSafe(r[f"_r_{k}"]) for k in keys], how).drop(*[f"_r_{k}" for k in keys])


def asof(left: DataFrame, on: list[str], left_ts: str, *rights: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """Attach to each left row, of each right side (frame, time, values), the values of its newest
    row at or before the left row's time.

    All sides are sorted together by key and time, right rows first at equal times, in one range
    shuffle; inside a slice the last right row is carried forward, and one carry per slice brings in
    what the slices before it end with. No pairs are made, the output of every step has as many rows
    as its input, and a key that holds most rows is spread over the slices it fills. Right rows have
    one row per key and time (see keep_last); NULL keys and times match nothing.
    """
    when = lambda c: F.col(c).cast("timestamp_ntz").alias("_at")
    kinds = [F.lit(None).cast(_struct_of(df, values)) for df, _, values in rights]
    held = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    row_type = left.select(held.alias("r")).schema["r"].dataType
    both = left.select(*on, when(left_ts), F.lit(1).alias("_kind"), held.alias("_row"), *[k.alias(f"_v{i}") for i, k in enumerate(kinds)])
    for i, (df, ts, values) in enumerate(rights):
        known = df.filter(F.col(ts).isNotNull())
        for k in on:
            known = known.filter(F.col(k).isNotNull())
        own = [F.struct(*values).alias(f"_v{i}") if j == i else k.alias(f"_v{j}") for j, k in enumerate(kinds)]
        both = both.unionByName(known.select(*on, when(ts), F.lit(0).alias("_kind"), F.lit(None).cast(row_type).alias("_row"), *own))
    carried = carry_last(both, on, [F.col("_at"), F.col("_kind")], [f"_v{i}" for i in range(len(rights))])
    found = carried.filter("_kind = 1")
    return found.select("_row.*", *[F.col(f"_v{i}.{v}").alias(v) for i, (_, _, values) in enumerate(rights) for v in values])


def _struct_of(df: DataFrame, values: list[str]):
    return df.select(F.struct(*values).alias("s")).schema["s"].dataType


def fx_asof(df: DataFrame, rates: DataFrame, from_: str, to: str, date: str) -> DataFrame:
    """Attach `rate`: the newest quote at or before the date, else the inverse of the newest quote
    of the swapped pair, else NULL. Equal currencies take 1. `inverse` holds the swapped quote where
    it was used, so that a caller can divide by it instead of multiplying by a rounded 1/x.

    Requests are reduced to distinct (from, to, date) before the as-of join, so the join never
    sees more rows than there are pairs and dates.
    """
    asked = df.select(F.col(from_).alias("from_currency"), F.col(to).alias("to_currency"), F.col(date).alias("on_date")).filter(
        (F.col("from_currency") != F.col("to_currency")) & F.col("on_date").isNotNull()).distinct()
    quotes = rates.groupBy("from_currency", "to_currency", "rate_date").agg(F.max("rate").alias("rate"))
    swapped = quotes.filter(F.col("rate") != 0).select(
        F.col("to_currency").alias("from_currency"), F.col("from_currency").alias("to_currency"), "rate_date",
        F.col("rate").alias("inverse"))
    both = asof(asked, ["from_currency", "to_currency"], "on_date", (quotes, "rate_date", ["rate"]), (swapped, "rate_date", ["inverse"]))
    one = F.lit(1).cast("decimal(18,8)")
    found = both.select(
        F.col("from_currency").alias("_f"), F.col("to_currency").alias("_t"), F.col("on_date").alias("_d"),
        F.coalesce(F.col("rate").cast("decimal(38,18)"), (one / F.col("inverse")).cast("decimal(38,18)")).alias("rate"),
        F.when(F.col("rate").isNull(), F.col("inverse")).alias("inverse"))
    joined = df.join(found, (F.col(from_) == F.col("_f")) & (F.col(to) == F.col("_t")) & (F.col(date) == F.col("_d")), "left")
    return joined.withColumn(
        "rate", F.when(F.col(from_) == F.col(to), F.lit(1).cast("decimal(38,18)")).otherwise(F.col("rate"))).drop("_f", "_t", "_d")
