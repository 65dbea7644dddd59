"""Named queries over a data folder, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.session import configure
from tillweave.sources.binding import with_ctes
from tillweave.sources.tables import RetailTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Reduce column types to the few that compare alike in any engine.

    Whole numbers become bigint, decimals the nearest double of all their digits, dates and zoned
    timestamps plain timestamps, intervals seconds or months.
    """
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        elif isinstance(t, (T.DateType, T.TimestampType)):
            c = c.cast("timestamp_ntz")
        elif isinstance(t, T.DayTimeIntervalType):
            c = c.cast("interval second").cast("decimal(20,6)").cast("double")
        elif isinstance(t, T.YearMonthIntervalType):
            c = c.cast("interval month").cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def tables(spark: SparkSession, folder: str) -> RetailTables:
    """The bound tables of a folder, listed anew for each call; plans only."""
    return RetailTables(configure(spark), folder)


def query(name: str, sql: str | None = None):
    """Register `fn(t) -> DataFrame` under `name`, with its checking SQL."""

    def put(fn: Callable[[RetailTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(tables(spark, folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return put


def d(expr: str) -> str:
    """A decimal as it appears in plain()."""
    return f"CAST({expr} AS DOUBLE)"


def i(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def day(expr: str) -> str:
    return f"CAST(CAST({expr} AS DATE) AS TIMESTAMP)"


def month(expr: str) -> str:
    return f"CAST(DATE_TRUNC('month', {expr}) AS TIMESTAMP)"


def pct(num: str, den: str) -> str:
    """ROUND(num / den * 100, 2) for non-negative decimals of scale 2, in exact integers."""
    n, m = (f"CAST(({x}) * 100 AS HUGEINT)" for x in (num, den))
    return (
        f"CASE WHEN ({den}) <> 0 THEN CAST((({n}) * 20000 + ({m})) // (2 * ({m})) AS DOUBLE) / 100 END"
    )


def half_up(num: str, den: str, scale: int) -> str:
    """ROUND(num / den, scale) for whole numbers of any sign, half away from zero."""
    f = 10**scale
    return (
        f"CASE WHEN ({den}) <> 0 THEN SIGN(CAST({num} AS DOUBLE)) * "
        f"CAST((ABS(CAST({num} AS HUGEINT)) * {2 * f} + CAST({den} AS HUGEINT)) // (2 * CAST({den} AS HUGEINT)) AS DOUBLE) / {f} END"
    )
