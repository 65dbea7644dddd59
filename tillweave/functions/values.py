"""Column expressions with the source system's value rules.

Empty text is NULL, ascending order puts NULLs last and descending order puts them first, ratios
are exact decimals rounded half away from zero, and dates carry a time part.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- null rules -----------------------------------------------------------------------------

def empty_to_null(c: str | Column) -> Column:
    """'' is NULL on every ingest."""
    c = as_col(c)
    return F.when(c != "", c)


def blank_text_to_null(df: DataFrame) -> DataFrame:
    """Apply the empty-text rule to every string column of a frame."""
    return df.withColumns({n: empty_to_null(n) for n, t in df.dtypes if t == "string"})


def nvl(c: str | Column, default) -> Column:
    return F.coalesce(as_col(c), default if isinstance(default, Column) else F.lit(default))


def nvl2(c: str | Column, present, absent) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(as_col(c).isNotNull(), lift(present)).otherwise(lift(absent))


def decode(c: str | Column, pairs: dict, default=None) -> Column:
    """Match by null-safe equality, so a None key matches NULL."""
    c = as_col(c)
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for key, value in pairs.items():
        hit = c.isNull() if key is None else c.eqNullSafe(F.lit(key))
        out = F.when(hit, lift(value)) if out is None else out.when(hit, lift(value))
    return out.otherwise(lift(default))


def _null_if_any(cols: list[Column], value: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]), value)


def greatest_null(*cols) -> Column:
    """GREATEST that is NULL when any argument is NULL."""
    cols = [c if isinstance(c, Column) else F.lit(c) if not isinstance(c, str) else F.col(c) for c in cols]
    return _null_if_any(cols, F.greatest(*cols))


def least_null(*cols) -> Column:
    cols = [c if isinstance(c, Column) else F.lit(c) if not isinstance(c, str) else F.col(c) for c in cols]
    return _null_if_any(cols, F.least(*cols))


def same(a: str | Column, b: str | Column) -> Column:
    """NULL-equal comparison."""
    return as_col(a).eqNullSafe(as_col(b))


# ---- order -----------------------------------------------------------------------------------

def order_nulls(c: str | Column, desc: bool = False, nulls: str | None = None) -> Column:
    """Sort key; without `nulls`, ascending puts NULLs last and descending puts them first."""
    c = as_col(c)
    nulls = nulls or ("first" if desc else "last")
    if desc:
        return c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last()


class By(NamedTuple):
    """A named sort column; NULL placement follows order_nulls unless given."""

    col: str
    desc: bool = False
    nulls: str | None = None

    def key(self, col: str | None = None) -> Column:
        return order_nulls(col or self.col, self.desc, self.nulls)


# ---- exact ratios ------------------------------------------------------------------------------

_WIDE = "decimal(22,2)"


def rate_pct(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """num / den * 100, rounded; NULL when the denominator is zero."""
    num, den = as_col(num).cast(_WIDE), as_col(den).cast(_WIDE)
    return F.round(num / F.nullif(den, F.lit(0).cast(_WIDE)) * 100, scale)


def share(value: str | Column, total: str | Column) -> Column:
    """value / total as a double; NULL when the total is zero or NULL."""
    total = as_col(total).cast("double")
    return as_col(value).cast("double") / F.nullif(total, F.lit(0.0))


def ratio_to_report(value: str | Column, part: list | None = None) -> Column:
    """Share of the partition total. For small partitions; see windows.with_part_total for large."""
    c = as_col(value)
    return share(c, F.sum(c).over(Window.partitionBy(*(part or []))))


# ---- dates -------------------------------------------------------------------------------------

def as_time(moment) -> Column:
    """A literal or column as a timestamp without zone."""
    return moment if isinstance(moment, Column) else F.lit(str(moment)).cast("timestamp_ntz")


def day_of(ts: str | Column) -> Column:
    return as_col(ts).cast("date").cast("timestamp_ntz")


def month_of(ts: str | Column) -> Column:
    return F.trunc(as_col(ts).cast("date"), "MM").cast("timestamp_ntz")


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    micros = lambda c: F.unix_micros(as_col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1_000_000).cast("decimal(7,0)")


def days_between(later: str | Column, earlier: str | Column, scale: int) -> Column:
    """Fractional days, as the source's date subtraction gives them, rounded half up."""
    whole = (F.unix_seconds(as_col(later).cast("timestamp")) - F.unix_seconds(as_col(earlier).cast("timestamp")))
    return F.round(whole.cast("decimal(20,0)") / F.lit(86400).cast("decimal(5,0)"), scale)


def add_months_keep_end(d: str | Column, n) -> Column:
    """Month addition under which a month's last day stays a last day."""
    d = as_col(d).cast("date")
    moved = F.add_months(d, n)
    return F.when(d == F.last_day(d), F.last_day(moved)).otherwise(moved)


def fiscal_period(d: str | Column) -> Column:
    """The fiscal year starts in February."""
    m = F.month(as_col(d))
    return F.when(m == 1, 12).otherwise(m - 1)


def working_days(start: str | Column, end: str | Column) -> Column:
    """Mondays to Fridays in [start, end], both ends included; NULL when end comes first.

    Closed form: weekdays up to a date, counted from a Monday, subtracted at both ends.
    """
    start, end = as_col(start), as_col(end)
    monday = F.lit("1900-01-01").cast("date")

    def upto(n: Column) -> Column:
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    first = F.datediff(start.cast("date"), monday)
    last = F.datediff(end.cast("date"), monday)
    return F.when(end >= start, (upto(last + 1) - upto(first)).cast("bigint"))


# ---- text keys ---------------------------------------------------------------------------------

def normalise_sku(c: str | Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(as_col(c)), "[^A-Za-z0-9]", ""))


def upper_one_to_one(c: str | Column) -> Column:
    """Upper case that never lengthens the text: sharp s stays, as in the source."""
    held = F.translate(as_col(c), "\u00df", "\ue000")
    return F.translate(F.upper(held), "\ue000", "\u00df")


def normalise_text(c: str | Column) -> Column:
    return upper_one_to_one(F.trim(F.regexp_replace(as_col(c), r"\s+", " ")))


def pad_ref(prefix: str, c: str | Column, width: int) -> Column:
    """A formatted reference; numbers wider than `width` keep all their digits."""
    digits = as_col(c).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def mask_email(c: str | Column) -> Column:
    """First character, stars, then the domain; '***' when '@' is absent or leads."""
    c = as_col(c)
    at = F.instr(c, "@")
    stars = F.repeat(F.lit("*"), F.greatest(at - 2, F.lit(1)))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(at <= 1, "***").otherwise(
        F.concat(F.substring(c, 1, 1), stars, F.substr(c, at))
    )


# Fixed value: the e-mail shape the source accepts.
EMAIL_SHAPE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def valid_email(c: str | Column) -> Column:
    return F.when(as_col(c).rlike(EMAIL_SHAPE), "Y").otherwise("N")


# ---- labels over structs -----------------------------------------------------------------------

def contact_label(contact: str | Column) -> Column:
    s = as_col(contact)
    return F.concat(
        nvl(s["contact_name"], "(unnamed contact)"),
        nvl2(s["role_title"], F.concat(F.lit(" ("), s["role_title"], F.lit(")")), ""),
        nvl2(s["email"], F.concat(F.lit(" <"), F.lower(s["email"]), F.lit(">")), ""),
    )


def address_label(line1, line2, city, postal, country, style: str = "SHORT") -> Column:
    """The parts that exist, joined; MULTILINE breaks lines instead of using commas."""
    sep = "\n" if style.upper() == "MULTILINE" else ", "
    text = lambda c: nvl(as_col(c), "")
    full = F.concat(
        text(line1), F.lit(sep), nvl2(line2, F.concat(as_col(line2), F.lit(sep)), ""),
        text(city), F.lit(sep), text(postal), F.lit(sep), text(country),
    )
    return F.rtrim(full, F.lit(sep + " "))


def customer_label(party_id, name, card) -> Column:
    return F.concat(
        F.lit("CUSTOMER:"), nvl(as_col(party_id).cast("string"), "?"), F.lit(":"), nvl(name, "(anonymous)"),
        nvl2(card, F.concat(F.lit(" [card "), as_col(card), F.lit("]")), ""),
    )


def supplier_label(code, name, approved) -> Column:
    return F.concat(
        F.lit("SUPPLIER:"), nvl(code, "?"), F.lit(":"), nvl(name, "(unnamed)"),
        decode(approved, {"Y": " [approved]", "N": " [unapproved]"}, " [unknown]"),
    )


def price_compare(a: str | Column, b: str | Column) -> Column:
    """-1, 0 or 1; a missing price sorts after any price."""
    a, b = as_col(a), as_col(b)
    return (
        F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1)
        .when(a < b, -1).when(a > b, 1).otherwise(0)
    )


# ---- display ----------------------------------------------------------------------------------

def display(c: str | Column, kind: str, arg=None) -> Column:
    """Report formatting by kind: number, decimals, currency, text, ellipsis, date, money, flag."""
    c = as_col(c)
    if kind == "number":
        return F.format_number(c, 2)
    if kind == "decimals":
        return F.round(c, arg).cast("string")
    if kind == "currency":
        return F.concat(as_col(arg), F.lit(" "), F.format_number(c, 2))
    if kind == "text":
        return nvl(empty_to_null(F.trim(c)), "(none)")
    if kind == "ellipsis":
        return F.when(F.length(c) > arg, F.concat(F.substring(c, 1, max(arg - 3, 1)), F.lit("..."))).otherwise(c)
    if kind == "date":
        return F.upper(F.date_format(c, arg or "dd-MMM-yyyy"))
    if kind == "money":
        return F.when(c.isNull(), "(no amount)").otherwise(
            F.concat(c["currency_code"], F.lit(" "), F.format_number(c["amount"], 2))
        )
    if kind == "flag":
        return F.when(c.isNull(), "UNKNOWN").when(c, "YES").otherwise("NO")
    raise ValueError(f"unknown display kind {kind}")


# Error numbers and the classes the source reports them under.
ERROR_CLASSES = {
    -1: "UNIQUE_VIOLATION",
    -2291: "FK_PARENT_MISSING",
    -2292: "FK_CHILD_EXISTS",
    -1400: "NOT_NULL_VIOLATION",
    -54: "RESOURCE_BUSY",
    -12899: "VALUE_TOO_LARGE",
    -1403: "NO_DATA_FOUND",
    -1422: "TOO_MANY_ROWS",
}


def error_class(code: str | Column) -> Column:
    code = as_col(code)
    other = F.when(code.between(-20999, -20000), "APPLICATION_ERROR").otherwise("UNCLASSIFIED")
    return decode(code, ERROR_CLASSES, other)


# ---- validity and windows of time ---------------------------------------------------------------

def valid_on(start: str | Column, end: str | Column, moment, upper: str = "open") -> Column:
    """start <= moment, and end is absent, later ('open') or not earlier ('closed')."""
    start, end, moment = as_col(start), as_col(end), as_time(moment)
    still = end >= moment if upper == "closed" else end > moment
    return (start <= moment) & (end.isNull() | still)


def in_window(ts: str | Column, start, stop) -> Column:
    """Half-open [start, stop)."""
    ts = as_col(ts)
    return (ts >= as_time(start)) & (ts < as_time(stop))


# ---- nested benefit and attribute arrays --------------------------------------------------------

def active_benefits(benefits: str | Column, moment) -> Column:
    """Benefits in force; both ends of their validity are inclusive, absent ends are unbounded."""
    moment = as_time(moment)
    return F.filter(
        as_col(benefits),
        lambda b: (b["valid_from"].isNull() | (moment >= b["valid_from"]))
        & (b["valid_to"].isNull() | (moment <= b["valid_to"])),
    )


def attribute_number(c: str | Column) -> Column:
    """Attribute text as a number; NULL when it is not one."""
    return F.trim(as_col(c)).try_cast("decimal(38,10)")


def bounded_list(c: str | Column, limit: int) -> Column:
    """Comma list of a bounded array with its bound; NULL for a NULL array."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.concat(F.array_join(c, ","), F.lit(f" (max {limit})")))


def keep_last(value: str | Column, order: str | Column, agg: str = "max") -> Column:
    """Aggregate of `value` over the rows tied at the greatest `order`.

    A max of (order, value) structs does it in one partial aggregate; a NULL order sorts last in
    the source's ascending order, so it wins here too.
    """
    value, order = as_col(value), as_col(order)
    rank = F.struct(order.isNull().alias("n"), order.alias("o"), value.isNotNull().alias("p"), value.alias("v"))
    if agg == "max":
        return F.max(rank)["v"]
    if agg == "sum":
        raise ValueError("sum over ties needs the two-step form: aggregate per order first")
    raise ValueError(agg)
