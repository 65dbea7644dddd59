"""Change feeds: diffing two copies, reading change files as a stream, and applying batches.

A change row has `op` (I, U or D), `seq`, and the images `old` and `new` as structs of the table's
columns. Handlers are written for one micro-batch and run through foreachBatch, so the same code
serves batch and stream, and a replay in other batch sizes gives the same state.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillweave.session import shared_dir

Handler = Callable[[DataFrame, int], None]


def diff_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes that turn `old` into `new`; rows that are equal give none. Keys are unique."""
    o = old.select(*[F.col(k).alias(f"_ok{i}") for i, k in enumerate(keys)], F.struct(*old.columns).alias("old"))
    n = new.select(*[F.col(k).alias(f"_nk{i}") for i, k in enumerate(keys)], F.struct(*new.select(*old.columns).columns).alias("new"))
    both = o.join(n, [F.col(f"_ok{i}") == F.col(f"_nk{i}") for i in range(len(keys))], "full_outer")
    same = F.col("old").eqNullSafe(F.col("new"))  # NULL fields count as equal inside structs
    op = F.when(F.col("old").isNull(), "I").when(F.col("new").isNull(), "D").when(~same, "U")
    return both.select(op.alias("op"), "old", "new").filter(F.col("op").isNotNull())


def change_schema(df: DataFrame, seq: str = "bigint"):
    """Schema of a change file for a table."""
    row = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return T.StructType([T.StructField("op", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("old", row), T.StructField("new", row)])


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Change files as a stream."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_stream(stream: DataFrame, handler: Handler, name: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Run a handler per micro-batch with a durable checkpoint; by default until the input is
    drained, which is how a scheduled job uses it."""
    spark = stream.sparkSession
    where = checkpoint or os.path.join(shared_dir(spark), "stream", name)
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", where).queryName(name)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        query.awaitTermination()
    return query


def run_kept(rows: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Run a stateful stream until its input is drained; what it keeps stays in Spark's state store,
    from which `read_state` reads it."""
    query = rows.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_state(spark: SparkSession, checkpoint: str, names: list[str]) -> DataFrame:
    """Keys and values of the state as of the last committed batch; `names` are those of the values,
    in the order in which the stateful operator holds them."""
    state = spark.read.format("statestore").load(checkpoint)
    held = state.schema["value"].dataType
    while len(held.fields) == 1 and isinstance(held.fields[0].dataType, T.StructType):  # a struct kept by a function per group
        state = state.withColumn("value", F.col(f"value.{held.fields[0].name}"))
        held = state.schema["value"].dataType
    value = F.col("value").cast(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, held.fields)]))
    return state.select(*[F.col(f"key.{k.name}").alias(k.name) for k in state.schema["key"].dataType.fields], value.alias("_v")).select(*state.schema["key"].dataType.names, *[F.col(f"_v.{n}").alias(n) for n in names])
