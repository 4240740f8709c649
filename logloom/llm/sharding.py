"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded order, a row's fractional rank is
(2 rank - 1) / (2 n) within its source, and all rows sorted by fractional rank
are cut into shards of equal row counts. Every stretch of that order, and so
every shard, holds the sources in the proportions of the whole.

No window covers a source or the whole table: ranks come from hash buckets of
bounded size plus the running counts of the bucket table, summed in two levels. Text
is read once for its size and checksum and is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import totals_before
from .common import bucket_count, forget, hash_bucket, table, written

ROWS_PER_BUCKET = 500


def interleave(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
    seed: str = "logloom",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, source, fraction, shard, slot.

    ``keep`` names further columns to carry along. Shard row counts differ by one
    at most; ``slot`` numbers a shard's rows from 0 without gaps. Null sources form
    one stratum of their own; a null text has size 1 and the checksum of no bytes;
    a null id is ordered like the empty string. The seeded order is by a hash of id
    and checksum, so rows that repeat an id, or have none, are spread; only those that
    repeat the text too lie together. Repeated rows get a place each.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        (F.octet_length(text).cast("bigint") + F.lit(1)).alias("_size"),
        crc.alias("_crc"),
        *[F.col(c).alias(f"_k_{c}") for c in keep],
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("_crc").cast("string"))
    known = {"_h": F.md5(name.cast("binary")), "_null": F.col("_source").isNull(), "_s": F.coalesce("_source", F.lit(""))}
    stored = rows = written(rows.withColumns(known), "shard-rows")
    total = rows.count()
    buckets = bucket_count(total, rows_per_bucket)
    rows = rows.withColumn("_b", hash_bucket(F.col("_h"), buckets))
    ties = ["_h", "_id", "_crc", "_size"]

    # rank within the source: place in the hash bucket + rows in the buckets before
    key = ["_null", "_s", "_b"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    sums = counts.groupBy("_null", "_s").agg(F.sum("_n").alias("_of"))
    offsets = totals_before(counts, ["_null", "_s"], "_b", "_n", "_before").drop("_n").join(sums, ["_null", "_s"])
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*ties))).join(offsets, key)
    ranked = ranked.withColumn(
        "_f", (2 * (F.col("_before") + F.col("_rn")) - 1).cast("double") / (2 * F.col("_of")).cast("double")
    ).withColumn("_fb", F.floor(F.col("_f") * buckets).cast("int"))
    ranked = written(ranked.drop("_rn", "_before", "_of", "_b"), "shard-ranks")
    forget(stored)

    # place in the whole order, in the same way over buckets of the fraction
    starts = totals_before(ranked.groupBy("_fb").agg(F.count("*").alias("_n")), [], "_fb", "_n", "_start").drop("_n")
    order = Window.partitionBy("_fb").orderBy("_f", "_null", "_s", *ties)
    placed = ranked.withColumn("_rn", F.row_number().over(order)).join(starts, "_fb")
    placed = placed.withColumn("_p", F.col("_start") + F.col("_rn") - 1)
    whole = lambda a, b: F.expr(f"({a}) div ({b})")
    shard: Column = whole(f"_p * {shards}", max(total, 1))
    placed = placed.withColumn("_shard", shard)
    first = whole(f"_shard * {total} + {shards - 1}", shards)
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        *[F.col(f"_k_{c}").alias(c) for c in keep],
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_f").alias("fraction"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_p") - first).cast("bigint").alias("slot"),
    )


def op6_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    """Sixteen shards under the law ``rows``: counts at most one apart."""
    out = interleave(table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
