"""Attaching the values of a one-row frame as a scalar subquery: evaluated once, no join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """`df` with the columns of `one_row`; they are NULL when it is empty, and more than one row
    is an error."""
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("_one"))
    out = df.withColumn("_one", packed.scalar())
    return out.select(*df.columns, *[F.col(f"_one.{n}").alias(n) for n in names])
