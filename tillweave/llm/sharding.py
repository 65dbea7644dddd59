"""Sharding by global byte offsets, in DataFrame operations only.

All documents stand in one order: by the digest of their text, so equal texts are neighbours, then
by doc_id. A range shuffle of narrow rows cuts that order into slices; the totals per slice give
each slice's global byte and row offset, running sums inside the slices do the rest. Shards are
the stretches between equal byte targets: a document belongs to the shard that holds its middle,
so every shard's size is within one document of the target, whatever copies there are.

Defined cases: NULL text counts as empty (8 bytes, CRC 0); a NULL doc_id comes first among equal
texts; repeated rows each get a slot of their own; fewer documents than shards leave shards empty;
an empty table gives no rows. Other columns are kept; taken names get an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.mixing import running
from tillweave.llm.words import fresh
from tillweave.operators.scalars import beside

SHARDS = 24
OVERHEAD = 8  # bytes a document takes beside its text


def with_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """`docs` with a struct `_shard` of size, text_crc32, shard and slot.

    `carry` names the columns that travel through the range shuffle; all by default.
    """
    name = fresh(docs.columns, "_shard")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    carry = docs.columns if carry is None else carry
    narrow = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_doc"), F.col(key).alias("_key"), F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("bigint").alias("_digest"),
        (F.octet_length(body) + OVERHEAD).cast("bigint").alias("_bytes"), F.crc32(body).alias("_crc"), F.monotonically_increasing_id().alias("_tie"),
    )
    placed = running(narrow, [F.col("_digest"), F.col("_key"), F.col("_tie")], {"_before": F.col("_bytes")}, "_row")
    # whole-number division; twice the bytes times the shards stays a long up to some 10**17 bytes
    placed = beside(placed, placed.agg(F.sum("_bytes").alias("_all")))
    placed = placed.withColumn("_to", F.least(F.expr(f"(2 * _before + _bytes) * {shards} div (2 * _all)"), F.lit(shards - 1)).cast("int"))
    starts = placed.groupBy("_to").agg(F.min("_row").alias("_start"))  # a row per shard
    made = F.struct(F.col("_bytes").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_to").alias("shard"), (F.col("_row") - F.col("_start")).alias("slot"))
    return placed.join(F.broadcast(starts), "_to").select("_doc.*", made.alias(name))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: size, CRC of the text, shard and slot under the law `bytes`."""
    made = with_shards(docs.select("doc_id", "text"), shards, carry=["doc_id"])
    s = made.columns[-1]
    return made.select(
        "doc_id", F.col(f"{s}.size").alias("size"), F.col(f"{s}.text_crc32").alias("text_crc32"), F.lit("bytes").alias("law"), F.col(f"{s}.shard").alias("shard"),
        F.col(f"{s}.slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
