"""Row helpers over the given tables, and invariants of the queries whose rows are arbitrary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.functions import values as v
from tillweave.operators import aggregates as a
from tillweave.operators.scalars import beside
from tillweave.plans import finance as fin
from tillweave.plans import views as v_

c = F.col

# Codes that appear in the checked rows.
_CODES = (-1, -2291, -2292, -1400, -54, -12899, -1403, -1422, -20101, 7)
_CODE_SQL = "CASE order_id % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_CODES)) + " END"
_CLASS_SQL = "CASE " + " ".join(f"WHEN code = {k} THEN '{x}'" for k, x in v.ERROR_CLASSES.items()) + " WHEN code BETWEEN -20999 AND -20000 THEN 'APPLICATION_ERROR' ELSE 'UNCLASSIFIED' END"
query("fn_error_class", f"SELECT order_id, {_CLASS_SQL} AS class FROM (SELECT order_id, {_CODE_SQL} AS code FROM rt_sales_order)")(
    lambda t: t.sales_order.select("order_id", v.error_class(F.element_at(F.array(*map(F.lit, _CODES)), (c("order_id") % 10 + 1).cast("int"))).alias("class")))

query("fn_price_compare", """
SELECT product_id, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN 1 WHEN b IS NULL THEN -1 WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS cmp
FROM (SELECT product_id, CASE WHEN product_id % 3 <> 0 THEN list_price END AS a, CASE WHEN product_id % 4 <> 0 THEN CASE WHEN product_id % 5 = 0 THEN list_price ELSE unit_cost END END AS b FROM rt_product)""")(
    lambda t: t.product.select("product_id", F.when(c("product_id") % 3 != 0, c("list_price")).alias("a"), F.when(
        c("product_id") % 4 != 0, F.when(c("product_id") % 5 == 0, c("list_price")).otherwise(c("unit_cost"))).alias("b")).select("product_id", v.price_compare("a", "b").alias("cmp")))

query("fn_customer_label", """
SELECT c.customer_id, CONCAT('CUSTOMER:', CAST(c.customer_id AS STRING), ':', COALESCE(c.last_name, '(anonymous)'), CASE WHEN a.card_number IS NOT NULL THEN CONCAT(' [card ', a.card_number, ']') ELSE '' END) AS label
FROM rt_customer c LEFT JOIN rt_loyalty_account a ON a.customer_id = c.customer_id""")(
    lambda t: t.customer.select("customer_id", "last_name").join(t.loyalty_account.select("customer_id", "card_number"), "customer_id", "left").select(
        "customer_id", v.customer_label("customer_id", "last_name", "card_number").alias("label")))

query("fn_address_label", """
SELECT address_id, RTRIM(CONCAT(COALESCE(line1, ''), ', ', CASE WHEN NULLIF(line2, '') IS NOT NULL THEN CONCAT(line2, ', ') ELSE '' END, COALESCE(city, ''), ', ', COALESCE(postal_code, ''), ', ', COALESCE(country_code, '')), ', ') AS label
FROM rt_address""")(
    lambda t: t.address.select("address_id", v.address_label("line1", "line2", "city", "postal_code", "country_code").alias("label")))

query("fn_attribute_number", """
SELECT p_partkey, TRY_CAST(TRIM(CASE p_partkey % 3 WHEN 0 THEN CONCAT('  ', CAST(p_size AS STRING), ' ') WHEN 1 THEN p_brand ELSE CONCAT(CAST(p_size AS STRING), '.5') END) AS DOUBLE) AS value FROM part""")(
    lambda t: t.base("part").select("p_partkey", F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("  "), c("p_size").cast("string"), F.lit(" "))).when(
        c("p_partkey") % 3 == 1, c("p_brand")).otherwise(F.concat(c("p_size").cast("string"), F.lit(".5"))).alias("x")).select("p_partkey", v.attribute_number("x").alias("value")))

query("fn_bounded_list", """
SELECT order_id, CASE WHEN order_id % 4 <> 0 THEN CONCAT(status, ',', channel_code, ' (max 5)') END AS listed FROM rt_sales_order""")(
    lambda t: t.sales_order.select("order_id", F.when(c("order_id") % 4 != 0, F.array("status", "channel_code")).alias("a")).select("order_id", v.bounded_list("a", 5).alias("listed")))

query("fn_active_benefits", """
SELECT promotion_id, CONCAT_WS(',', CASE WHEN start_ts <= TIMESTAMP '1997-01-01' AND end_ts >= TIMESTAMP '1997-01-01' THEN 'BOTH' END, CASE WHEN start_ts <= TIMESTAMP '1997-01-01' THEN 'OPEN' END,
  CASE WHEN end_ts >= TIMESTAMP '1997-01-01' THEN 'PAST' END) AS codes FROM rt_promotion""")(
    lambda t: t.promotion.select("promotion_id", F.array(*[F.struct(F.lit(n).alias("code"), a.alias("valid_from"), b.alias("valid_to")) for n, a, b in (
        ("BOTH", c("start_ts"), c("end_ts")), ("OPEN", c("start_ts"), F.lit(None).cast("timestamp")), ("PAST", F.lit(None).cast("timestamp"), c("end_ts")))]).alias("b")).select(
            "promotion_id", F.concat_ws(",", F.transform(v.active_benefits("b", "1997-01-01"), lambda x: x["code"])).alias("codes")))

query("fn_display", """
SELECT order_id, FORMAT('{:,.2f}', CAST(subtotal_amount - discount_amount + tax_amount + shipping_amount AS DOUBLE)) AS n, CONCAT(currency_code, ' ', FORMAT('{:,.2f}', CAST(subtotal_amount - discount_amount + tax_amount + shipping_amount AS DOUBLE))) AS cur, COALESCE(NULLIF(TRIM(CASE WHEN order_id % 3 = 0 THEN '  ' ELSE status END), ''), '(none)') AS txt,
  CASE WHEN LENGTH(order_number) > 8 THEN CONCAT(SUBSTR(order_number, 1, 5), '...') ELSE order_number END AS ell, UPPER(STRFTIME(order_ts, '%d-%b-%Y')) AS dat,
  CASE WHEN order_id % 5 = 0 THEN '(no amount)' ELSE CONCAT(currency_code, ' ', FORMAT('{:,.2f}', CAST(subtotal_amount - discount_amount + tax_amount + shipping_amount AS DOUBLE))) END AS mon,
  CASE order_id % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'YES' ELSE 'NO' END AS flg FROM rt_sales_order""")(
    lambda t: t.sales_order.select(
        "order_id", v.display("order_total", "number").alias("n"), v.display("order_total", "currency", "currency_code").alias("cur"),
        v.display(F.when(c("order_id") % 3 == 0, "  ").otherwise(c("status")), "text").alias("txt"), v.display("order_number", "ellipsis", 8).alias("ell"), v.display("order_ts", "date").alias("dat"),
        v.display(F.when(c("order_id") % 5 != 0, F.struct("currency_code", c("order_total").alias("amount"))), "money").alias("mon"),
        v.display(F.when(c("order_id") % 3 != 0, c("order_id") % 3 == 1), "flag").alias("flg")))


def _invariants(got, source, key: str):
    """Rows of an arbitrary pick, keys that repeat in it, and keys that the source lacks."""
    got = got.select(key)
    lost = got.join(source.select(key), key, "left_anti").agg(F.count("*").alias("unknown"))
    return beside(got.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct(key)).alias("repeated")), lost)


for _name, _build, _table, _key, _n in (
    ("v_recent_orders_unsorted", v_.recent_orders_unsorted, "sales_order", "order_id", 50),
    ("limit_then_sort", lambda t: a.limit_then_sort(t.sales_order.select("order_id", "order_ts"), 100, [F.desc("order_ts")]), "sales_order", "order_id", 100),
    ("job_journal_batch", lambda t: fin.journal_batch(t.gl_journal, 50), "gl_journal", "journal_id", None),
):
    _limit = f"LEAST({_n}, COUNT(*))" if _n else "LEAST(50, COUNT(*) FILTER (WHERE status = 'DRAFT'))"
    query(f"{_name}_invariants", f"SELECT {_limit} AS rows, 0 AS repeated, 0 AS unknown FROM rt_{_table}")(
        lambda t, f=_build, s=_table, k=_key: _invariants(f(t), getattr(t, s), k))
