"""Outbound feeds: one entity per outside system, in the format of the system's transport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.plans.families import SYSTEMS
from tillweave.sources.tables import RetailTables

#: Characters of a text field in a fixed-width record.
TEXT_WIDTH = 60
#: Records of a text file. Text feeds travel as gzip, which one task reads from the start.
FILE_RECORDS = 500_000

_CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_XML = {"rowTag": "row", "ignoreSurroundingSpaces": False}
# Transports for which Spark has a writer. Those that exist by name only (COBOL_COPYBOOK, IDOC,
# ISO8583, EDIFACT) travel as Parquet, like PARQUET itself.
FORMATS: dict[str, tuple[str, dict]] = {
    "CSV": ("csv", _CSV), "DELIMITED": ("csv", _CSV | {"sep": "|"}), "JSON": ("json", {}), "REST": ("json", {}), "XML": ("xml", _XML), "SOAP": ("xml", _XML),
}


def outbound_entities() -> dict[str, tuple[str, str]]:
    """System code -> (transport, entity it is sent)."""
    return {code: (transport, entity) for code, transport, _, entity in SYSTEMS}


def wire_rows(df: DataFrame) -> DataFrame:
    """Every atomic column as text: numbers with all their digits, times as ISO text, NULL for ''.

    Structs, arrays and intervals are derived from atomic columns here and are not sent.
    """
    def text(f: T.StructField) -> Column:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.nullif(col.cast("string"), F.lit("")).alias(f.name)

    skipped = (T.StructType, T.ArrayType, T.MapType, T.DayTimeIntervalType, T.YearMonthIntervalType)
    return df.select(*[text(f) for f in df.schema.fields if not isinstance(f.dataType, skipped)])


def _widths(df: DataFrame) -> dict[str, int]:
    def width(kind: T.DataType) -> int:
        if isinstance(kind, T.DecimalType):
            return kind.precision + 3  # sign, leading zero, point
        if isinstance(kind, T.IntegralType):
            return 20
        return 26 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else TEXT_WIDTH

    return {f.name: width(f.dataType) for f in df.schema.fields}


def _fixed_width(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One record per row, its fields padded with blanks. A value that is too long or holds a line
    break ends the job: cutting it would lose data in silence."""
    def cell(name: str) -> Column:
        value, width = F.coalesce(F.col(f"`{name}`"), F.lit("")), widths[name]
        bad = (F.length(value) > width) | value.rlike("[\\r\\n]")
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} does not fit {width} characters: "), value))).otherwise(F.rpad(value, width, " "))

    return rows.select(F.concat(*[cell(n) for n in rows.columns]).alias("value"))


def _from_fixed_width(records: DataFrame, names: list[str], widths: dict[str, int]) -> DataFrame:
    out, start = [], 1
    for name in names:
        cell = F.rtrim(F.substring("value", start, widths[name]))
        out.append(F.when(cell != "", cell).alias(name))
        start += widths[name]
    return records.select(*out)


def write_feed(df: DataFrame, transport: str, path: str) -> None:
    """Write an entity in its transport's format; a folder that exists is an error.

    Text formats repeat names, tags or padding in every record, so their files are gzip.
    """
    rows = wire_rows(df)
    packed = {"compression": "gzip", "maxRecordsPerFile": FILE_RECORDS}
    if transport == "FIXED_WIDTH":
        _fixed_width(rows, _widths(df)).write.mode("errorifexists").options(**packed).text(path)
        return
    kind, options = FORMATS.get(transport, ("parquet", {}))
    options = {k: v for k, v in options.items() if k != "multiLine"} | ({"ignoreNullFields": False} if kind == "json" else {})
    rows.write.mode("errorifexists").format(kind).options(**options, **({} if kind == "parquet" else packed)).save(path)


def read_feed(spark: SparkSession, path: str, transport: str, like: DataFrame) -> DataFrame:
    """The text rows of a feed written from a frame with the columns of `like`."""
    names = wire_rows(like).columns
    if transport == "FIXED_WIDTH":
        return _from_fixed_width(spark.read.text(path), names, _widths(like))
    kind, options = FORMATS.get(transport, ("parquet", {}))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).format(kind).options(**options).load(path)


def write_feeds(t: RetailTables, folder: str, systems: list[str] | None = None) -> dict[str, str]:
    """Send every system its entity; system code -> folder of its feed."""
    made = {}
    for code, (transport, entity) in outbound_entities().items():
        if systems is None or code in systems:
            made[code] = f"{folder.rstrip('/')}/{code.lower()}"
            write_feed(getattr(t, entity), transport, made[code])
    return made
