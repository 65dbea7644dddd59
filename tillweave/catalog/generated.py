"""Edge-case rows beside the given ones, and the spec sheet reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.catalog.registry import query
from tillweave.generate.tables import edge_cases
from tillweave.plans.catalogue import spec_attributes

c = F.col


query("src_generate_mess", """
SELECT 'given' AS part, COUNT(*) AS rows, COUNT(NULLIF(line2, '')) AS line2_present FROM rt_address UNION ALL SELECT 'probes', 6, 2""")(
    lambda t: (lambda probes: t.address.agg(F.count("*").alias("rows"), F.count("line2").alias("line2_present")).select(F.lit("given").alias("part"), "rows", "line2_present").unionByName(
        probes.agg(F.count("*").alias("rows"), F.count(F.nullif(c("line2"), F.lit(""))).alias("line2_present")).select(F.lit("probes").alias("part"), "rows", "line2_present")))(
        edge_cases(t.spark)["address"].filter(c("line1").rlike("^(Empty|Null|Full)"))))

query("spec_attributes", """
SELECT p_partkey AS product_id, 'brand' AS attr_name, p_brand AS attr_value FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS STRING) FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, NULL, p_name FROM part WHERE p_partkey % 3 = 0""")(
    lambda t: spec_attributes(t.base("part").select(c("p_partkey").alias("product_id"), F.when(c("p_partkey") % 3 == 0, F.concat(
        F.lit("<spec><summary>"), "p_name", F.lit("</summary></spec>"))).otherwise(F.concat(
            F.lit('<spec><attribute name="brand">'), "p_brand", F.lit('</attribute><attribute name="size">'), c("p_size").cast("string"), F.lit("</attribute></spec>"))).alias("spec_sheet"))))
