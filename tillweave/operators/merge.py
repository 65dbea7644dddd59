"""Row changes as pure functions: (target, source) -> new target.

Plain Parquet has no row-level update, so each result is written to a new path by the caller and
swapped in. Sources are reduced to one row per key before the join, which is also what keeps a hot
key to one row on that side.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.functions.values import as_time
from tillweave.operators.positions import _null_safe, running_total
from tillweave.session import stash


def _on(keys: list[str]) -> list[Column]:
    return [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]


def _marked(df: DataFrame, flag: str) -> DataFrame:
    return df.withColumn(flag, F.lit(True))


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    set_: dict[str, Column],
    insert: dict[str, Column],
    update_if: Column | None = None,
    delete_if: Column | None = None,
) -> DataFrame:
    """Update matched rows, insert unmatched source rows.

    Expressions refer to `t.col` and `s.col`. Matched rows change only where `update_if` holds.
    `delete_if` sees a row *after* its update and removes only rows the update touched.
    """
    t, s = _marked(target, "_in_t").alias("t"), _marked(source, "_in_s").alias("s")
    joined = t.join(s, _on(keys), "full_outer")
    hit = F.col("t._in_t").isNotNull() & F.col("s._in_s").isNotNull()
    touched = hit if update_if is None else hit & F.coalesce(update_if, F.lit(False))
    new = F.col("t._in_t").isNull()
    cols = []
    for f in target.schema.fields:
        old = F.col(f"t.{f.name}")
        value = F.when(touched, set_[f.name]).otherwise(old) if f.name in set_ else old
        fresh = insert.get(f.name, F.col(f"s.{f.name}") if f.name in keys else F.lit(None))
        cols.append(F.when(new, fresh).otherwise(value).cast(f.dataType).alias(f.name))
    out = joined.select(*cols, (touched if delete_if is not None else F.lit(False)).alias("_touched"))
    if delete_if is not None:
        out = out.filter(~(F.col("_touched") & F.coalesce(delete_if, F.lit(False))))
    return out.drop("_touched")


def upsert_delete(target, source, keys, set_, insert, update_if, delete_if) -> DataFrame:
    """Update where `update_if`, drop updated rows where `delete_if`, insert the rest."""
    return upsert(target, source, keys, set_, insert, update_if, delete_if)


def ordered_balances(start: DataFrame, events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Balance of each key after its events one by one: (keys, balance, applied).

    start: keys, balance. events: keys, order columns, delta, guarded. The first event of a key
    without a balance sets it; a guarded event that would leave it below zero is left out. A key
    without guarded events, or whose balance outlasts all its decreases, is settled by one sum; only
    events of the other keys are put in order. Where no running sum of guarded events falls below
    zero, the sum is the answer too; the keys that remain are walked in order, as a stream of sorted
    rows with one balance as state.
    """
    sums = events.groupBy(*keys).agg(
        F.sum("delta").alias("_sum"), F.coalesce(F.sum(F.when(F.col("delta") < 0, F.col("delta"))), F.lit(0)).alias("_down"), F.bool_or("guarded").alias("_guarded"))
    first = stash(sums.join(start, keys, "left"))
    outlasts = ~F.col("_guarded") | (F.coalesce("balance", F.lit(0)) + F.col("_down") >= 0)
    total = (F.coalesce("balance", F.lit(0)) + F.col("_sum")).cast("decimal(28,3)").alias("balance")
    settled = first.filter(outlasts).select(*keys, total, F.lit(True).alias("applied"))
    doubtful = first.filter(~outlasts).select(*keys)
    # summed per key in one global order, so a key with very many events is not one task's work
    run = running_total(_null_safe(events, doubtful, keys), keys, [F.col(c) for c in order], "delta", "_s")
    whole = run.groupBy(*keys).agg(F.sum("delta").alias("_sum"), F.min(F.when(F.col("guarded"), F.col("_s"))).alias("_low"), F.min("_s").alias("_least"))
    judged = stash(whole.join(start, keys, "left"))
    low = F.coalesce(F.col("balance") + F.col("_low"), F.when(F.col("balance").isNull(), F.col("_least")), F.lit(0))
    exact = settled.unionByName(judged.filter(low >= 0).select(*keys, total, F.lit(True).alias("applied")))
    rest = judged.filter(low < 0).select(*keys, "balance")
    rows = run.join(rest, keys).select(*keys, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], "delta", "guarded", "balance")
    spread = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{k}" for k in range(len(order))])
    schema = T.StructType([*[events.schema[k] for k in keys], T.StructField("balance", T.DecimalType(28, 3)), T.StructField("applied", T.BooleanType())])
    n = len(keys)

    def walk(parts):
        at = now = None
        used, out = False, []
        for part in parts:
            for row in part[[*keys, "delta", "guarded", "balance"]].itertuples(index=False):
                if row[:n] != at:
                    if at is not None:
                        out.append((*at, now, used))
                    at, now, used = row[:n], row[n + 2], False
                if now is None or not row[n + 1] or now + row[n] >= 0:
                    now, used = row[n] if now is None else now + row[n], True
            yield pd.DataFrame(out, columns=schema.names)
            out = []
        if at is not None:
            yield pd.DataFrame([(*at, now, used)], columns=schema.names)

    return exact.unionByName(spread.mapInPandas(walk, schema))


def add_qty(target: DataFrame, deltas: DataFrame, keys: list[str], qty: str = "qty_on_hand",
            stamp: str | None = None, moment=None, order: list[str] = ("qty",)) -> DataFrame:
    """Add deltas to a quantity one by one in `order`; one that would leave it below zero is left out."""
    events = deltas.select(*keys, *order, F.col("qty").alias("delta"), F.lit(True).alias("guarded"))
    summed = ordered_balances(target.select(*keys, F.col(qty).alias("balance")), events, keys, list(order))
    set_ = {qty: F.col("s.balance")}
    insert = {qty: F.col("s.balance"), "qty_reserved": F.lit(0)}
    if stamp:
        set_[stamp] = insert[stamp] = as_time(moment)
    return upsert(target, summed, keys, set_, insert, update_if=F.col("s.applied"))


def replace_qty(target: DataFrame, snapshot: DataFrame, keys: list[str], qty: str = "qty_on_hand",
                stamp: str | None = None, moment=None) -> DataFrame:
    """Set a quantity to the snapshot's; locations new to the target start with nothing reserved."""
    set_ = {qty: F.col("s.qty")}
    if stamp:
        set_[stamp] = as_time(moment)
    return upsert(target, snapshot, keys, set_, {qty: F.col("s.qty"), "qty_reserved": F.lit(0)})


def update_where_changed(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str],
                         extra: dict[str, Column] | None = None) -> DataFrame:
    """Take `cols` from a one-row-per-key source where any of them differs and is not NULL-equal."""
    t, s = target.alias("t"), _marked(source.select(*keys, *cols), "_in_s").alias("s")
    joined = t.join(s, _on(keys), "left")
    differs = reduce(lambda a, b: a | b, [~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cols])
    changed = F.col("s._in_s").isNotNull() & differs
    out = []
    for f in target.schema.fields:
        value = F.col(f"t.{f.name}")
        if f.name in cols:
            value = F.when(changed, F.col(f"s.{f.name}")).otherwise(value)
        elif extra and f.name in extra:
            value = F.when(changed, extra[f.name]).otherwise(value)
        out.append(value.cast(f.dataType).alias(f.name))
    return joined.select(*out)


def fill_from_lookup(df: DataFrame, lookup: DataFrame, on: list[str], col: str, agg: Column) -> DataFrame:
    """Fill NULLs of `col` with an aggregate of the matching lookup rows."""
    found = lookup.groupBy(*on).agg(agg.alias("_found"))
    return df.join(found, on, "left").withColumn(col, F.coalesce(col, "_found")).drop("_found").select(*df.columns)


def purge(df: DataFrame, ts: str, retain_days: int, as_of) -> tuple[DataFrame, DataFrame]:
    """Rows kept, and the count of rows past retention; a NULL stamp is kept."""
    old = F.coalesce(F.col(ts) < as_time(as_of) - F.make_dt_interval(F.lit(retain_days)), F.lit(False))
    return df.filter(~old), df.filter(old).agg(F.count("*").alias("rows_deleted"))


def archive_purge(issues: DataFrame, year: int, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """Resolved issues of one year are candidates; they go only when it is not a dry run."""
    start, stop = as_time(f"{year}-01-01"), as_time(f"{year + 1}-01-01")
    hit = (F.col("detected_ts") >= start) & (F.col("detected_ts") < stop) & F.col("resolved_ts").isNotNull()
    summary = issues.filter(hit).agg(F.count("*").alias("n")).select(
        F.lit("ARCHIVE_PURGE").alias("rule_code"), F.lit("data_quality_issue").alias("entity_name"),
        F.lit(str(year)).alias("entity_key"), F.lit("INFO").alias("severity"),
        F.concat(F.lit("candidates="), F.col("n").cast("string"), F.lit(f" dry_run={'Y' if dry_run else 'N'}")).alias("detail"),
        F.col("n").alias("candidates"),
    )
    return (issues if dry_run else issues.filter(~F.coalesce(hit, F.lit(False)))), summary


def quarantine(df: DataFrame, rules: dict[str, Column], entity: str, key: Column,
               severity: str = "ERROR") -> tuple[DataFrame, DataFrame]:
    """Split rows by rules that must hold: good rows, and one issue row per failed rule."""
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda r: r.isNotNull(),
    )
    judged = df.withColumn("_failed", failed)
    good = judged.filter(F.size("_failed") == 0).drop("_failed")
    bad = judged.filter(F.size("_failed") > 0).select(
        F.explode("_failed").alias("rule_code"), F.lit(entity).alias("entity_name"),
        key.cast("string").alias("entity_key"), F.lit(severity).alias("severity"),
        F.lit("row quarantined").alias("detail"),
    )
    return good, bad


def reject_duplicates(new: DataFrame, existing: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Accept the first new row of each key the target does not hold yet.

    The first row comes from a partial min over (order, row) rather than a window, so a key with
    very many copies never gathers in one task.
    """
    fresh = new.join(existing.select(key), key, "left_anti")
    clash = new.join(existing.select(key), key, "left_semi")
    rank = [F.col(c) if isinstance(c, str) else c for c in order]
    firsts = fresh.groupBy(key).agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(rank)])).alias("_first"))
    tagged = fresh.join(firsts, key).withColumn(
        "_is_first", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(rank)]) == F.col("_first"))
    ok = tagged.filter("_is_first").select(*new.columns)
    dup = tagged.filter(~F.col("_is_first")).select(*new.columns).unionByName(clash.select(*new.columns))
    return ok, dup.withColumn("reject_reason", F.lit("UNIQUE_VIOLATION"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def erase(customers: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Erasure of the listed customers: status, contact fields and the erasure stamp."""
    marked = customers.join(_marked(ids.select("customer_id").distinct(), "_erase"), "customer_id", "left")
    gone = F.col("_erase").isNotNull()
    return marked.withColumns({
        "status": F.when(gone, "ERASED").otherwise(F.col("status")),
        "email": F.when(~gone, F.col("email")),
        "mobile_phone": F.when(~gone, F.col("mobile_phone")),
        "gdpr_erasure_ts": F.when(gone, as_time(as_of)).otherwise(F.col("gdpr_erasure_ts")),
    }).select(*customers.columns)
