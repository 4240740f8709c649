"""Log reads, offsets, seeks and retention.

What is known of a queue (limits, policies, cuts) has one row for each queue, and is
broadcast to the log: a queue may hold most rows, which a join by queue would put in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import range_of, tasks_for, totals_before


def assign_offsets(rows: DataFrame, key: list[str], time_col: str, ties: list[str], rows_per_range: int = 100_000, start: DataFrame | None = None) -> DataFrame:
    """Adds dense ``offset`` from 0 per key, in order of time, then ties (integers or strings).

    A key, or one moment, may hold most of the rows: ranges of time and ties are
    numbered on their own and shifted by the rows before them. ``start`` has a key's
    next offset, to append. Null times come first. Tasks hold about a range each,
    however few partitions the session shuffles to.
    """
    order = [F.unix_micros(F.col(time_col)), *[F.col(c) for c in ties]]
    count = rows.count()
    rows = rows.withColumn("_range", range_of(rows, order, rows_per_range, count))
    if count > rows_per_range:
        rows = rows.repartition(tasks_for(rows, count, rows_per_range), *key, "_range")
    counts = totals_before(rows.groupBy(*key, "_range").agg(F.count("*").alias("_n")), key, "_range", "_n", "_before").drop("_n")
    inside = Window.partitionBy(*key, "_range").orderBy(time_col, *ties)
    out = rows.withColumn("_rn", F.row_number().over(inside) - 1).join(counts, [*key, "_range"])
    first = F.lit(0)
    if start is not None:
        out = out.join(start.withColumnRenamed("offset", "_start"), key, "left")
        first = F.coalesce("_start", F.lit(0))
    return out.withColumn("offset", (first + F.col("_before") + F.col("_rn")).cast("bigint")).drop("_range", "_before", "_rn", "_start")


def append(log: DataFrame, new: DataFrame, time_col: str = "created_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """The log with ``new`` after each queue's tail."""
    tails = log.groupBy("queue").agg((F.max("offset") + 1).alias("offset"))
    return log.unionByName(assign_offsets(new, ["queue"], time_col, list(ties), start=tails), allowMissingColumns=True)


def fits(payload: Column, most: int) -> Column:
    return F.coalesce(F.octet_length(payload), F.lit(0)) <= most


def bounds(log: DataFrame) -> DataFrame:
    """head (first kept), tail (next), n (tail - head) and rows of each queue."""
    return log.groupBy("queue").agg(
        F.min("offset").alias("head"),
        (F.max("offset") + 1).alias("tail"),
        (F.max("offset") + 1 - F.min("offset")).alias("n"),
        F.count("*").alias("rows"),
    )


def read_one(log: DataFrame, queue: str, offset: int) -> DataFrame:
    return log.filter((F.col("queue") == queue) & (F.col("offset") == offset))


def read_batch(log: DataFrame, queue: str, start: int, limit: int = 0) -> DataFrame:
    """Up to ``limit`` (0: 100) rows from ``start`` on; starts before the head begin there."""
    return log.filter((F.col("queue") == queue) & (F.col("offset") >= start)).orderBy("offset").limit(limit or 100)


def read_range(log: DataFrame, queue: str, start: int, end: int, most: int) -> DataFrame:
    return log.filter((F.col("queue") == queue) & (F.col("offset") >= start) & (F.col("offset") < end)).orderBy("offset").limit(most)


def live(expires_at: Column, as_of: str) -> Column:
    """Not expired: no expiry, or not yet passed."""
    return expires_at.isNull() | (expires_at >= F.lit(as_of).cast("timestamp"))


def peek_stream(log: DataFrame, queue: str, cursor: int, limit: int, as_of: str, matches: Column | None = None) -> DataFrame:
    """The next live, matching rows from a cursor; the cursor itself does not move."""
    rows = log.filter((F.col("queue") == queue) & (F.col("offset") >= cursor) & live(F.col("expires_at"), as_of))
    return (rows if matches is None else rows.filter(matches)).orderBy("offset").limit(limit)


def seek_offset(limits: DataFrame, wanted: Column) -> DataFrame:
    """Adds ``found`` and ``exact``: the wanted offset within [head, tail]."""
    found = F.least(F.greatest(wanted, F.col("head")), F.col("tail"))
    return limits.select("*", found.alias("found"), (found == wanted).alias("exact"))


def seek_time(log: DataFrame, limits: DataFrame, when: str) -> DataFrame:
    """First offset created at or after ``when`` of each queue, else its tail."""
    at = F.lit(when).cast("timestamp")
    first = log.filter(F.col("created_at") >= at).groupBy("queue").agg(F.min("offset").alias("_f"), F.min_by(F.col("created_at") == at, "offset").alias("_e"))
    return limits.join(first, "queue", "left").select(
        "queue", F.coalesce("_f", "tail").alias("found"), F.coalesce("_e", F.lit(False)).alias("exact")
    )


def offset_by_size(log: DataFrame, size: Column, limits: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """queue, by_size: the first offset from which a queue's messages fit ``max_bytes``.

    ``limits`` has queue and max_bytes; sizes are not negative. Ranges of offsets are
    summed, and only the one of a queue in which the limit is passed is looked at by
    rows.
    """
    rows = log.select("queue", "offset", size.alias("_size")).join(F.broadcast(limits.filter("max_bytes > 0")), "queue")
    rows = rows.withColumn("_range", F.floor(F.col("offset") / rows_per_range))
    sums = rows.groupBy("queue", "_range", "max_bytes").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_sum"), F.min("offset").alias("_first"))
    after = Window.partitionBy("queue").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_after", F.coalesce(F.sum("_sum").over(after), F.lit(0)))
    passed = sums.filter((F.col("_after") <= F.col("max_bytes")) & (F.col("_after") + F.col("_sum") > F.col("max_bytes")))
    inside = Window.partitionBy("queue", "_range").orderBy(F.desc("offset"))
    held = rows.join(F.broadcast(passed.select("queue", "_range", "_after")), ["queue", "_range"]).withColumn("_in", F.sum("_size").over(inside))
    over = held.filter(F.col("_in") + F.col("_after") > F.col("max_bytes")).groupBy("queue").agg((F.max("offset") + 1).alias("_over"))
    heads = sums.groupBy("queue").agg(F.min("_first").alias("_head"))
    return heads.join(F.broadcast(over), "queue", "left").select("queue", F.coalesce("_over", "_head").alias("by_size"))


def retention_offsets(log: DataFrame, limits: DataFrame, policies: DataFrame, size: Column, as_of: str) -> DataFrame:
    """queue, by_time, by_size, by_count and their greatest, retain_from, under each policy in force.

    ``policies``: queue, max_age_days, max_bytes, max_messages; 0 is no limit. Without
    any limit retain_from is null.
    """
    aged = log.join(F.broadcast(policies.filter("max_age_days > 0").select("queue", "max_age_days")), "queue")
    fresh = F.expr(f"created_at >= timestamp'{as_of}' - make_dt_interval(max_age_days)")
    by_time = aged.filter(fresh).groupBy("queue").agg(F.min("offset").alias("_t"))
    by_size = offset_by_size(log, size, policies.select("queue", "max_bytes"))
    out = limits.join(policies, "queue").join(by_time, "queue", "left").join(by_size, "queue", "left")
    out = out.withColumns(
        {
            "by_time": F.when(F.col("max_age_days") > 0, F.coalesce("_t", "tail")),
            "by_count": F.when(
                F.col("max_messages") > 0, F.greatest(F.col("head"), F.col("tail") - F.col("max_messages"))
            ),
        }
    )
    return out.select("queue", "head", "tail", "by_time", "by_size", "by_count", F.greatest("by_time", "by_size", "by_count").alias("retain_from"))


def truncate(log: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows from each queue's ``keep_from`` (not past its tail) on; null keeps all."""
    cut = limits.select("queue", F.least("keep_from", "tail").alias("_cut"))
    return log.join(F.broadcast(cut), "queue", "left").filter(F.col("_cut").isNull() | (F.col("offset") >= F.col("_cut"))).drop("_cut")


def truncate_segments(log: DataFrame, segs: DataFrame, before: DataFrame) -> DataFrame:
    """Without the leading whole segments of each queue that end before its ``keep_from``; the last segment stays.

    Segments and their rows join by queue and base, so a log stored by segment drops
    whole files.
    """
    w = Window.partitionBy("queue").orderBy("base")
    gone = segs.withColumn("_next", F.lead("base").over(w)).join(before.select("queue", "keep_from"), "queue")
    gone = gone.filter(F.col("_next") <= F.col("keep_from")).select("queue", F.col("base").alias("segment"))
    return log.join(gone, ["queue", "segment"], "left_anti")


def processed_offsets(retention: DataFrame, groups: DataFrame) -> DataFrame:
    """queue, keep_from: the lesser of the work groups' committed minimum (none: tail) and the retention offset."""
    least = groups.filter("mode = 'queue'").groupBy("queue").agg(F.min("committed").alias("_least"))
    return retention.join(least, "queue", "left").select(
        "queue", "tail", F.least(F.coalesce("_least", "tail"), F.col("retain_from")).alias("keep_from")
    )


def segments(log: DataFrame, size: Column, per_segment: int) -> DataFrame:
    """Facts of fixed ranges of offsets: base, rows, bytes, first and last time."""
    base = (F.floor(F.col("offset") / per_segment) * per_segment).alias("base")
    return log.groupBy("queue", base).agg(
        F.count("*").alias("rows"), F.sum(size).alias("bytes"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )


def expired_segments(segs: DataFrame, cutoff: str) -> DataFrame:
    """Leading segments of a queue whose rows are all at or before the cutoff; the last one stays."""
    w = Window.partitionBy("queue").orderBy("base")
    old = F.col("last_at") <= F.lit(cutoff).cast("timestamp")
    all_old = F.min(old.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    last = F.max("base").over(Window.partitionBy("queue"))
    return segs.withColumns({"_o": all_old, "_l": last}).filter("_o and base < _l").drop("_o", "_l")


def oversize_segments(segs: DataFrame, most: int) -> DataFrame:
    """Leading segments removed while the queue's total exceeds ``most`` bytes; the last one stays."""
    w = Window.partitionBy("queue").orderBy(F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("base").over(Window.partitionBy("queue"))
    return segs.withColumns({"_s": F.sum("bytes").over(w), "_l": last}).filter((F.col("_s") > most) & (F.col("base") < F.col("_l"))).drop("_s", "_l")


def decode_log_headers(rows: DataFrame) -> DataFrame:
    """Lifts the reserved headers into columns; the rest are properties."""
    h = F.col("headers")
    text = lambda k: F.element_at(h, F.lit(k)).cast("string")
    known = ("_id", "_state", "_expires_at", "topic")
    return rows.withColumns(
        {
            "message_id": text("_id"),
            "state": F.coalesce(text("_state"), F.lit("queued")),
            "expires_at": F.timestamp_millis(text("_expires_at").try_cast("bigint")),
            "topic": text("topic"),
            "properties": F.transform_values(F.map_filter(h, lambda k, v: ~k.isin(*known)), lambda k, v: v.cast("string")),
        }
    ).drop("headers")
