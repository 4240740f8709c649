"""Streams of the log: following it, consuming and delivering from it, and appending to it batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import claims


def follow(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New rows of a folder of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tail(spark: SparkSession, path: str, schema, queue: str, start: int = 0, files_per_trigger: int = 1) -> DataFrame:
    """Rows of one queue from an offset on, as they arrive."""
    return follow(spark, path, schema, files_per_trigger).filter((F.col("queue") == queue) & (F.col("offset") >= start))


def consume_stream(rows: DataFrame, groups: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of a stream for each consumer in ``requests`` (queue, group, consumer), from its group's cursor on, as pending entries.

    No delivery is counted and the cursor stays. Requests are few: they are broadcast.
    """
    asked = groups.join(requests, ["queue", "group"]).select("queue", "group", "consumer", "cursor")
    out = rows.join(F.broadcast(asked), "queue").filter(F.col("offset") >= F.col("cursor"))
    return out.select("queue", "group", "offset", "consumer", F.current_timestamp().alias("claimed_at"), F.lit(0).alias("deliveries"), "topic")


def delivery_loop(ops: DataFrame, log: DataFrame, groups: DataFrame, pending: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs micro-batches of claims and acknowledgements against the state under ``path``.

    ops: those of claims.settle and, with op ``claim``, queue, group, consumer, limit
    and at; a group claims once in a batch, at the latest time of its claims. Batch n
    reads the state that batch n - 1 wrote (the first: ``groups`` and ``pending``),
    settles, then claims, and writes state n and its deliveries. A batch that is
    repeated writes the same folders again.
    """
    spark = ops.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        held = (groups, pending) if number == 0 else tuple(spark.read.parquet(f"{path}/state={number - 1}/{name}") for name in ("groups", "pending"))
        _, entries, now = claims.settle(*held, batch.filter("op <> 'claim'"))
        asked = batch.filter("op = 'claim'").groupBy("queue", "group").agg(F.max_by("consumer", "seq").alias("consumer"), F.max_by("limit", "seq").alias("limit"))
        at = batch.filter("op = 'claim'").agg(F.max("at").cast("string")).first()[0]
        if at is not None:
            got = claims.claim_batch(now, entries, log, asked, at, **options)
            got.rows.write.mode("overwrite").parquet(f"{path}/delivered/batch={number}")
            entries, now = got.pending, got.groups
        entries.write.mode("overwrite").parquet(f"{path}/state={number}/pending")
        now.write.mode("overwrite").parquet(f"{path}/state={number}/groups")
        batch.unpersist()

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str, partition_by: str = "queue") -> StreamingQuery:
    """Writes each micro-batch once, named by its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(partition_by).parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(packets: DataFrame, keys: list[str], time_col: str, within: str = "10 minutes") -> DataFrame:
    """The first packet of a key within the watermark."""
    return packets.withWatermark(time_col, within).dropDuplicatesWithinWatermark(keys)
