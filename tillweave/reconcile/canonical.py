"""Canonical text of typed values, by rule, as column expressions.

Both sides of a comparison are rendered by the same rules, so equal values give equal text
whatever types carry them: numbers in fixed point without trailing zeros, instants in UTC,
intervals as months|days|seconds, nested tables as sorted multisets.
"""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.functions.values import as_col

# The marks of the canonical form.
NULL_TOKEN = "\x00NULL\x00"
UNIT = "\x1f"
BIG_CELL_BYTES = 32768

# Source type names and their rule.
BINARY_TYPES = ("BLOB", "RAW", "LONG RAW", "BFILE")
LOB_TYPES = ("CLOB", "NCLOB", "LONG")
NUMBER_TYPES = ("NUMBER", "FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE")
CHAR_TYPES = ("CHAR", "NCHAR")


def classify(columns: list[dict], registry: dict[str, str] | None = None) -> dict[str, str]:
    """Rule per column from (name, type); `registry` names user types: object, varray or table."""
    registry = registry or {}
    return {col["name"]: _rule_of((col.get("type") or "").upper(), registry) for col in columns}


def _rule_of(kind: str, registry: dict[str, str]) -> str:
    plain = kind.strip('"')
    if kind == "XMLTYPE":
        return "xml"
    if plain in registry:
        return {"varray": "collection_varray", "table": "collection_nested"}.get(registry[plain], "object")
    for names, rule in ((BINARY_TYPES, "binary"), (LOB_TYPES, "lob_text"), (NUMBER_TYPES, "numeric"), (CHAR_TYPES, "char")):
        if kind in names:
            return rule
    if kind.startswith("INTERVAL"):
        return "interval_ym" if "YEAR" in kind else "interval_ds"
    if "LOCAL TIME ZONE" in kind:
        return "timestamp_ltz"
    if kind.startswith("TIMESTAMP"):
        return "timestamp"
    return "date" if kind == "DATE" else "varchar"


def rules_for(df: DataFrame) -> dict[str, str]:
    """Rule per column from a frame's own types."""
    def rule(t: T.DataType) -> str:
        if isinstance(t, T.NumericType):
            return "numeric"
        if isinstance(t, T.TimestampType):
            return "timestamp_ltz"
        if isinstance(t, (T.TimestampNTZType, T.DateType)):
            return "timestamp"
        if isinstance(t, T.BinaryType):
            return "binary"
        if isinstance(t, T.DayTimeIntervalType):
            return "interval_ds"
        if isinstance(t, T.YearMonthIntervalType):
            return "interval_ym"
        if isinstance(t, T.ArrayType):
            return "collection_varray"
        return "object" if isinstance(t, T.StructType) else "varchar"

    return {f.name: rule(f.dataType) for f in df.schema.fields}


@F.pandas_udf(T.StringType())
def _xml_c14n(texts: pd.Series) -> pd.Series:
    """Logical XML form; text that does not parse keeps its hash."""
    def one(text):
        if text is None:
            return None
        try:
            return ET.canonicalize(text)
        except ET.ParseError:
            return "XML_UNPARSEABLE:" + hashlib.sha256(text.encode("utf-8")).hexdigest()

    return texts.map(one)


def _strip_zeros(text: Column) -> Column:
    """Fixed-point text without trailing zeros or a negative zero."""
    cut = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(cut.isin("", "-", "-0"), "0").otherwise(cut)


def _fixed(c: Column, scale: int) -> Column:
    """Decimal as fixed-point text; the plain cast writes tiny values with an exponent when ANSI
    mode is off."""
    text = c.cast("string")
    return F.when(text.contains("E"), F.translate(F.format_number(c, scale), ",", "")).otherwise(text)


def _expanded(text: Column) -> Column:
    """Text of a double without its exponent, digit by digit; NaN and infinities stay as they are."""
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d+)\.(\d+)E(-?\d+)$", k)
    digits, point = F.concat(part(2), part(3)), F.length(part(2)) + part(4).try_cast("int")
    body = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))))
    return F.when(part(2) != "", F.concat(part(1), body)).otherwise(text)


def _number(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DecimalType):
        return _strip_zeros(_fixed(c, t.scale))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return _strip_zeros(_expanded(c.cast("string")))
    if isinstance(t, T.StringType):
        return _strip_zeros(c)
    return c.cast("string")


def _moment(c: Column) -> Column:
    micros = F.date_format(c, "SSSSSS")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def _interval(months: Column, days: Column, seconds: Column) -> Column:
    return F.concat_ws("|", months, days, seconds)


def render(c: Column, t: T.DataType, rule: str, type_name: str | None = None) -> Column:
    """Canonical text of a column of type `t`; NULL becomes the NULL token."""
    if rule == "numeric":
        text = _number(c, t)
    elif rule in ("char", "varchar", "lob_text"):
        text = c.cast("string")
    elif rule in ("date", "timestamp"):
        text = c if isinstance(t, T.StringType) else _moment(c.cast("timestamp_ntz"))
    elif rule == "timestamp_ltz":
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")) if isinstance(t, T.TimestampType) else c
        text = _moment(utc.cast("timestamp_ntz"))
    elif rule == "binary":
        text = F.lower(F.hex(c))
    elif rule == "interval_ym":
        text = _interval(c.cast("interval month").cast("bigint").cast("string"), F.lit("0"), F.lit("0"))
    elif rule == "interval_ds":
        micros = (c.cast("interval second").cast("decimal(22,6)") * 1_000_000).cast("decimal(22,0)").cast("bigint")
        day = F.lit(86_400_000_000)
        days, rest = F.floor(micros / day).cast("bigint"), F.pmod(micros, day)
        seconds = _strip_zeros(_fixed((rest.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,6)"), 6))
        text = _interval(F.lit("0"), days.cast("string"), seconds)
    elif rule == "xml":
        text = _xml_c14n(c)
    elif rule == "object":
        parts = [F.concat(F.lit(f"{f.name.lower()}="), render(c[f.name], f.dataType, _nested(f.dataType))) for f in t.fields]
        text = F.concat(F.lit(f"OBJ<{type_name or ''}>("), F.concat_ws(UNIT, *parts), F.lit(")"))
    elif rule in ("collection_varray", "collection_nested"):
        items = F.transform(c, lambda x: render(x, t.elementType, _nested(t.elementType)))
        if rule == "collection_varray":
            text = F.concat(F.lit("VARR["), F.array_join(items, UNIT), F.lit("]"))
        else:
            text = F.concat(F.lit("MSET{"), F.array_join(F.array_sort(items), UNIT), F.lit("}"))
    else:
        raise ValueError(f"unknown rule {rule}")
    return F.when(c.isNull(), F.lit(NULL_TOKEN)).otherwise(text)


def _nested(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.ArrayType):
        return "collection_varray"
    if isinstance(t, T.StructType):
        return "object"
    if isinstance(t, T.TimestampType):
        return "timestamp_ltz"
    if isinstance(t, (T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "binary" if isinstance(t, T.BinaryType) else "varchar"


def bound_cell(c: str | Column, limit: int = BIG_CELL_BYTES) -> Column:
    """Cells above the limit travel as length and hash; equal on both sides when the text is."""
    c = as_col(c)
    size = F.octet_length(c)
    return F.when(size > limit, F.concat(F.lit("BIG:len="), size.cast("string"), F.lit(":sha256="), F.sha2(c.cast("binary"), 256))).otherwise(c)


def canonicalize(df: DataFrame, rules: dict[str, str] | None = None, types: dict[str, str] | None = None,
                 limit: int = BIG_CELL_BYTES) -> DataFrame:
    """Every column as bounded canonical text; `types` names the user type of object columns."""
    rules = {**rules_for(df), **(rules or {})}
    types = types or {}
    return df.select(*[
        bound_cell(render(F.col(f"`{f.name}`"), f.dataType, rules[f.name], types.get(f.name)), limit).alias(f.name) for f in df.schema.fields])


def bool_flag(c: str | Column) -> Column:
    """Numeric flag: zero is false, anything else, fractions included, is true."""
    return as_col(c) != 0


def json_text(c: str | Column) -> Column:
    """Canonical JSON text: the value null stays apart from SQL NULL and long numbers keep every
    digit; text that is not JSON gives NULL_JSON_ERROR."""
    c = as_col(c)
    parsed = F.try_parse_json(c)
    text = F.when(F.trim(c) == "null", "null").otherwise(F.to_json(parsed))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(parsed.isNull(), "NULL_JSON_ERROR").otherwise(text)
