"""Data quality jobs. Every issue has rule_code, entity_name, entity_key, severity and detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.functions.rules import CHECKS, REFERENCES, valid_until
from tillweave.functions.values import as_time, decode, nvl, valid_on
from tillweave.operators.hierarchy import hierarchy
from tillweave.operators.joins import orphans
from tillweave.operators.scalars import beside
from tillweave.plans.views import SEVERITY_ORDER
from tillweave.sources.tables import RetailTables


def issues(df: DataFrame, rule, entity, key, detail, severity: str = "ERROR") -> DataFrame:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        lift(rule).alias("rule_code"), lift(entity).alias("entity_name"), lift(key).cast("string").alias("entity_key"),
        F.lit(severity).alias("severity"), lift(detail).cast("string").alias("detail"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Rules over columns that the bound tables do not have; every other rule must resolve.
UNBOUND_RULES = {("gl_period", "ck_gl_period_dates")}


def run_rules(df: DataFrame, entity: str, key: Column, rules: dict[str, str | Column], severity: str = "ERROR") -> DataFrame:
    """All rules over a table in one pass; one issue per row and failed rule.

    As in a database CHECK, only FALSE fails: a rule that is NULL for a row passes.
    """
    tests = {n: F.expr(r) if isinstance(r, str) else r for n, r in rules.items()}
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in tests.items()]))
    bad = df.select(key.cast("string").alias("_key"), failed.alias("_failed")).filter(F.size("_failed") > 0)
    return issues(bad.select("_key", F.explode("_failed").alias("_rule")), F.col("_rule"), entity, F.col("_key"), "check failed", severity)


def check_constraints(t: RetailTables, tables: dict[str, Column]) -> DataFrame:
    """The declared CHECK rules of the given tables (name -> key expression); each table is read once."""
    return union_all([
        run_rules(getattr(t, name), name, key, {r: e for r, e in CHECKS[name].items() if (name, r) not in UNBOUND_RULES})
        for name, key in tables.items()])


def run_validators(df: DataFrame, entity: str, key: Column, validators: dict[str, Column], severity: str = "WARN") -> DataFrame:
    """Y/N validator columns as issues."""
    return run_rules(df, entity, key, {n: v == "Y" for n, v in validators.items()}, severity)


def run_lookup_rules(df: DataFrame, t: RetailTables, entity: str, key: Column, as_of, currency: str | None = None,
                     country: str | None = None, date: str | None = None, valid_to: str | None = None) -> DataFrame:
    """Rules that need a lookup: validity at `as_of`, active currency, tax rate in force for the
    row's country on its date. NULL passes. Rates travel as one small array per country."""
    rules: dict[str, Column] = {}
    if valid_to:
        rules["VALID_UNTIL"] = valid_until(valid_to, as_of) == "Y"
    if currency:
        active = t.currency.groupBy(F.col("currency_code").alias("_cc")).agg(F.max("is_active").alias("_active"), F.count("*").alias("_n"))
        df = df.join(active, F.rtrim(F.col(currency)) == F.col("_cc"), "left")
        rules["CURRENCY_ACTIVE"] = F.col(currency).isNull() | ((F.col("_n") == 1) & (F.col("_active") == "Y")).eqNullSafe(F.lit(True))
    if country:
        rates = t.tax_rate.groupBy(F.col("country_code").alias("_tc")).agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("_rates"))
        df = df.join(rates, F.rtrim(F.col(country)) == F.col("_tc"), "left")
        when = F.col(date) if date else as_time(as_of)
        rules["TAX_RATE_KNOWN"] = F.exists(F.coalesce("_rates", F.array()), lambda r: valid_on(r["valid_from"], r["valid_to"], when))
    return run_rules(df, entity, key, rules, "WARN")


# ---- references -------------------------------------------------------------------------------------

def dq_orphans(t: RetailTables, pairs=REFERENCES) -> DataFrame:
    """Orphan count per checked reference; a NULL foreign key is no orphan.

    A child table is read once: its keys are counted first, so the joins to its parents see one row
    per combination of keys and a hot key is one row.
    """
    def of_child(child: str) -> DataFrame:
        refs = [(pa, fk, pk) for ch, pa, fk, pk in pairs if ch == child]
        rows = getattr(t, child).groupBy(*dict.fromkeys(fk for _, fk, _ in refs)).agg(F.count("*").alias("_n"))
        for k, (parent, fk, pk) in enumerate(refs):
            known = getattr(t, parent).select(F.col(pk).alias(f"_p{k}")).distinct()
            rows = rows.join(known, F.col(fk) == F.col(f"_p{k}"), "left")
        lost = [F.coalesce(F.sum(F.when(F.col(fk).isNotNull() & F.col(f"_p{k}").isNull(), F.col("_n"))), F.lit(0)).alias(f"_l{k}") for k, (_, fk, _) in enumerate(refs)]
        return rows.agg(*lost).select(F.inline(F.array(*[F.struct(
            F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.lit(fk).alias("foreign_key"), F.col(f"_l{k}").alias("orphans"))
            for k, (parent, fk, _) in enumerate(refs)])))

    return union_all([of_child(c) for c in dict.fromkeys(p[0] for p in pairs)])


def dq_soft_refs(t: RetailTables) -> DataFrame:
    """References the model does not declare: shipment and return lines to order lines, ledger rows
    to orders. One count per check, zero included."""
    line_key = t.sales_order_line.select("order_id", "line_no").distinct()
    checks = {
        "shipment_line_order_line": orphans(t.shipment_line, line_key, ["order_id", "order_line_no"], ["order_id", "line_no"]),
        "return_line_order_line": orphans(t.return_line, line_key, ["order_id", "line_no"], ["order_id", "line_no"]),
        "loyalty_transaction_order": orphans(t.loyalty_transaction, t.sales_order, ["order_id"]),
        "loyalty_transaction_account": orphans(t.loyalty_transaction, t.loyalty_account, ["loyalty_id"]),
    }
    return union_all([df.agg(F.count("*").alias("orphans")).select(F.lit(n).alias("check_name"), "orphans") for n, df in checks.items()])


def dq_row_minimums(t: RetailTables, expected: dict[str, tuple[int, float]], scale: float) -> DataFrame:
    """rows >= fixed + ceil(scaled * scale) per table."""
    return union_all([
        getattr(t, n).agg(F.count("*").alias("rows")).select(
            F.lit(n).alias("table_name"), "rows", (F.lit(fixed) + F.ceil(F.lit(float(scaled)) * F.lit(float(scale)))).cast("bigint").alias("minimum"))
        .withColumn("passed", F.when(F.col("rows") >= F.col("minimum"), "Y").otherwise("N")) for n, (fixed, scaled) in expected.items()])


# ---- stock, hierarchy, finance -------------------------------------------------------------------------

def dq_stock(t: RetailTables) -> DataFrame:
    """One row: rows, negative on-hand, expected negatives (one in forty), below -30, negative
    reserved, and locations without exactly one owner."""
    stock = t.inventory_stock.agg(
        F.count("*").alias("stock_rows"), F.count_if(F.col("qty_on_hand") < 0).alias("negative_rows"),
        F.floor(F.count("*") / 40).alias("expected_negative"), F.count_if(F.col("qty_on_hand") < -30).alias("below_floor"),
        F.count_if(F.col("qty_reserved") < 0).alias("negative_reserved"))
    owner = F.col("warehouse_id").isNotNull().cast("int") + F.col("store_id").isNotNull().cast("int")
    places = t.inventory_location.agg(F.count_if(owner != 1).alias("bad_owner"))
    return beside(stock, places)


def dq_hierarchy(df: DataFrame, entity: str, id: str, parent: str) -> DataFrame:
    """Issues of a tree: several or no roots, self-parents, rows no root reaches."""
    base = df.select(id, parent)
    roots = base.agg(F.count_if(F.col(parent).isNull()).alias("n")).filter(F.col("n") != 1)
    reached = hierarchy(base, id, parent).select(F.col(id).alias("_ok")).distinct()
    lost = base.join(reached, F.col(id) == F.col("_ok"), "left_anti")
    return union_all([
        issues(roots, "TREE_ROOTS", entity, "ALL", F.concat(F.col("n").cast("string"), F.lit(" roots"))),
        issues(base.filter(F.col(id) == F.col(parent)), "TREE_SELF_PARENT", entity, F.col(id), "row is its own parent"),
        issues(lost, "TREE_UNREACHABLE", entity, F.col(id), "not reachable from a root"),
    ])


def dq_finance(t: RetailTables) -> DataFrame:
    """Unbalanced journals, lines with both sides, negative loyalty balances."""
    sums = t.gl_journal_line.groupBy("journal_id").agg(F.sum("debit_amount").alias("dr"), F.sum("credit_amount").alias("cr"))
    both = t.gl_journal_line.filter((F.col("debit_amount") > 0) & (F.col("credit_amount") > 0))
    return union_all([
        issues(sums.filter(F.col("dr") != F.col("cr")), "JOURNAL_UNBALANCED", "GL_JOURNAL", F.col("journal_id"),
               F.concat(F.col("dr").cast("decimal(20,2)").cast("string"), F.lit(" <> "), F.col("cr").cast("decimal(20,2)").cast("string"))),
        issues(both, "LINE_BOTH_SIDES", "GL_JOURNAL_LINE", F.concat_ws("/", "journal_id", "line_no"), "debit and credit on one line"),
        issues(t.loyalty_account.filter(F.col("points_balance") < 0), "NEGATIVE_BALANCE", "LOYALTY_ACCOUNT", F.col("loyalty_id"), F.col("points_balance")),
    ])


def dq_journal_line(t: RetailTables, base_currency: str = "GBP") -> DataFrame:
    """Lines with both sides, foreign lines without a rate, and more than two OPEN periods."""
    lines, key = t.gl_journal_line, F.concat_ws("/", "journal_id", "line_no")
    rules = run_rules(lines, "GL_JOURNAL_LINE", key, {
        "LINE_BOTH_SIDES": ~((F.col("debit_amount") > 0) & (F.col("credit_amount") > 0)),
        "LINE_NEEDS_RATE": ~(F.col("fx_rate").isNull() & (F.col("currency_code") != base_currency))})
    open_ = t.gl_period.agg(F.count_if(F.col("status") == "OPEN").alias("n")).filter(F.col("n") > 2)
    return rules.unionByName(issues(open_, "TOO_MANY_OPEN_PERIODS", "GL_PERIOD", "ALL", F.lit("check failed")))


def dq_canaries(t: RetailTables) -> DataFrame:
    """Counts that move when empty text, outer joins or NULLs are handled wrongly."""
    a = t.address.agg(F.count("*").alias("addresses"), F.count("line2").alias("line2_present"),
                      F.count_distinct(nvl("line2", "<null>")).alias("line2_distinct"))
    c = t.customer.agg(F.count_if(F.col("mobile_phone").isNull()).alias("mobile_null"))
    sent = t.shipment.filter(F.col("status") == "DELIVERED").groupBy("order_id").agg(F.count("*").alias("n"))
    j = t.sales_order.select("order_id").join(sent, "order_id", "left").agg(F.sum(nvl("n", 1)).alias("outer_join_rows"))
    return reduce(beside, (a, c, j))


# ---- single checks -----------------------------------------------------------------------------------------

def dq_negative_margin(products: DataFrame) -> DataFrame:
    return issues(products.filter(F.col("list_price") < F.col("unit_cost")), "NEGATIVE_MARGIN", "PRODUCT", F.col("sku"), F.concat(
        F.lit("list_price "), F.col("list_price").cast("decimal(12,2)").cast("string"), F.lit(" below unit_cost "),
        F.col("unit_cost").cast("decimal(12,3)").cast("string")), "WARN")


def dq_unpriced(t: RetailTables) -> DataFrame:
    """Active variants without any price item, one row each."""
    return issues(t.product_variant.filter(F.col("is_active") == "Y").join(t.price_list_item.select("variant_id"), "variant_id", "left_anti"),
                  "UNPRICED_VARIANT", "PRODUCT_VARIANT", F.col("variant_id"), "no price list entry", "WARN")


def dq_ledger_drift(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Accounts whose ledger does not add up to their balance; only accounts with ledger rows count."""
    sums = ledger.groupBy("loyalty_id").agg(F.sum("points_delta").alias("_sum"))
    drift = accounts.join(sums, "loyalty_id").filter(F.col("_sum") != F.col("points_balance"))
    return issues(drift, "LOYALTY_LEDGER_DRIFT", "LOYALTY_ACCOUNT", F.col("loyalty_id"), F.concat(
        F.lit("ledger sum "), F.col("_sum").cast("string"), F.lit(" <> account balance "), F.col("points_balance").cast("string")), "WARN")


def dq_transitions(old: DataFrame, new: DataFrame, table: str, key: str) -> DataFrame:
    """Forbidden changes between two copies of a table: products from DISCONTINUED to ACTIVE,
    parameters un-encrypted, promotions ending before they start."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_old_{c}") for c in old.columns if c != key])
    both = new.join(o, F.col(key) == F.col("_k"), "left")
    bad = {
        "product": ("REACTIVATED_SKU", (F.col("_old_status") == "DISCONTINUED") & (F.col("status") == "ACTIVE") if "status" in new.columns else None),
        "app_parameter": ("UNENCRYPTED", (F.col("_old_is_encrypted") == "Y") & (F.col("is_encrypted") == "N") if "is_encrypted" in new.columns else None),
        "promotion": ("PROMO_WINDOW", F.col("end_ts") <= F.col("start_ts") if "end_ts" in new.columns else None),
    }[table]
    return issues(both.filter(bad[1]), bad[0], table.upper(), F.col(key), "forbidden change")


def severity_floor(df: DataFrame, floor: str) -> DataFrame:
    """Issues at or above a severity; unknown severities rank below all."""
    return df.filter(decode("severity", SEVERITY_ORDER, 9) <= SEVERITY_ORDER[floor])
