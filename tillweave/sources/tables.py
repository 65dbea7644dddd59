"""Lazy access to the retail tables of one data folder, with their computed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.functions.derived import add_derived
from tillweave.session import configure
from tillweave.sources.binding import BASE_TABLES, BINDING, slots


class RetailTables:
    """`t.sales_order` is the retail table, `t.base("orders")` the given table behind it.

    Frames are built on first use and remembered, so two uses in one plan are the same scan.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._base: dict[str, DataFrame] = {}
        self._retail: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._base[name] = df
        return self._base[name]

    def __getattr__(self, name: str) -> DataFrame:
        key = f"rt_{name}"
        if name.startswith("_") or key not in BINDING:
            raise AttributeError(name)
        return self._bind(key)

    def _bind(self, key: str) -> DataFrame:
        if key not in self._retail:
            needs = {s: self.base(s) if s in BASE_TABLES else self._bind(s) for s in slots(key)}
            if key == "rt_price_list_item":
                # a part becomes up to twenty prices, so the few files of the parts are dealt out first, by variant
                slices = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                needs["part"] = needs["part"].repartition(max(slices, 1), "p_partkey")
            bound = self.spark.sql(BINDING[key], **needs)
            self._retail[key] = add_derived(self._shape(key, bound), key[3:])
        return self._retail[key]

    @staticmethod
    def _shape(key: str, df: DataFrame) -> DataFrame:
        """Columns whose types the shared dialect cannot spell: intervals and structs."""
        if key == "rt_store":
            minutes = lambda c: F.make_dt_interval(F.lit(0), F.lit(0), F.col(c), F.lit(0))
            return (
                df.withColumn("opening_offset", minutes("opening_minutes"))
                .withColumn("closing_offset", minutes("closing_minutes"))
                .withColumn("refit_cycle", F.make_ym_interval(F.lit(0), F.col("refit_months")))
            )
        if key == "rt_carrier":
            return df.withColumn(
                "cutoff_offset", F.make_dt_interval(F.lit(0), F.lit(0), F.col("cutoff_minutes"), F.lit(0))
            )
        if key == "rt_supplier":
            return df.withColumn(
                "primary_contact",
                F.struct(
                    F.col("contact_name"), F.col("contact_email").alias("email"),
                    F.col("contact_role").alias("role_title"),
                ),
            ).withColumn("lead_time", F.make_dt_interval(F.col("lead_time_days").cast("int")))
        if key == "rt_loyalty_tier":
            return df.withColumn("review_interval", F.make_ym_interval(F.lit(0), F.col("review_months")))
        return df

    def replace(self, **frames: DataFrame) -> "RetailTables":
        """A copy that sees other frames under the given names."""
        other = RetailTables(self.spark, self.folder)
        other._base = self._base
        other._retail = {**self._retail, **{f"rt_{k}": v for k, v in frames.items()}}
        return other
