"""Consumer groups: progress, pending entries, redelivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import topics as t
from ..functions import values as v
from .ranking import DIRECT

VISIBILITY_S = 30
MAX_DELIVERIES = 5
PEL_SHARDS = 8


def group_name() -> Column:
    return t.effective_group(F.col("group_id"), F.col("pattern"))


def lag(groups: DataFrame) -> DataFrame:
    return groups.withColumns({"group": group_name(), "lag": F.greatest(F.col("tail") - F.col("committed"), F.lit(0))})


def of_queue(groups: DataFrame, queue: str) -> DataFrame:
    return groups.filter(F.col("queue") == queue)


def create(groups: DataFrame, wanted: DataFrame, limits: DataFrame) -> DataFrame:
    """The groups, and new ones from ``wanted`` (queue, group) at the head of their queue; an existing group stays, one without a queue isn't made."""
    new = wanted.select("queue", "group").distinct().join(groups.select("queue", "group"), ["queue", "group"], "left_anti")
    new = new.join(limits.select("queue", "head"), "queue").select("queue", "group", F.col("head").alias("cursor"), F.col("head").alias("committed"))
    return groups.select("queue", "group", "cursor", "committed").unionByName(new)


def pending_of(pending: DataFrame, queue: str, group: str | None = None, consumer: str | None = None) -> DataFrame:
    """Pending entries of a queue, or of one group or consumer of it."""
    rows = pending.filter(F.col("queue") == queue)
    for column, value in (("group", group), ("consumer", consumer)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows


def pending_summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("queue", "group").agg(F.count("*").alias("n_pending"), F.min("offset").alias("min_pending"))


def pending_by_consumer(pending: DataFrame) -> DataFrame:
    return pending.groupBy("queue", "group", "consumer").agg(F.count("*").alias("n"))


def pending_by_shard(pending: DataFrame, shards: int = PEL_SHARDS) -> DataFrame:
    return pending.groupBy("queue", "group", v.pel_shard(F.col("offset"), shards).alias("shard")).agg(F.count("*").alias("n"))


def min_committed(groups: DataFrame, limits: DataFrame, mode: str | None = None) -> DataFrame:
    """Least committed offset of a queue's groups (of one mode); the tail where there are none."""
    own = groups if mode is None else groups.filter(F.col("mode") == mode)
    least = own.groupBy("queue").agg(F.min("committed").alias("_c"))
    return limits.join(least, "queue", "left").select("queue", F.coalesce("_c", "tail").alias("committed"))


def advance_committed(groups: DataFrame, pending: DataFrame) -> DataFrame:
    """Committed offset after an acknowledgement: the cursor, or up to the first pending offset."""
    low = pending_summary(pending)
    out = groups.withColumn("group", group_name()).join(low, ["queue", "group"], "left")
    new = F.when(F.col("min_pending").isNull(), F.col("cursor")).otherwise(F.greatest("committed", "min_pending"))
    return out.withColumn("advanced", new)


def ack_floor(groups: DataFrame, pending: DataFrame) -> DataFrame:
    """Highest offset below which nothing after the old floor is pending.

    The scan starts one after the floor, so a pending offset equal to it (offset 0 at
    the start) is never seen.
    """
    g = groups.withColumn("group", group_name())
    above = pending.join(F.broadcast(g.select("queue", "group", "floor")), ["queue", "group"]).filter("offset > floor")
    gap = above.groupBy("queue", "group").agg(F.min("offset").alias("_gap"))
    new = F.greatest("floor", F.least(F.col("cursor"), F.coalesce("_gap", "cursor")) - 1)
    return g.join(gap, ["queue", "group"], "left").withColumn("ack_floor", new).drop("_gap")


def primary_progress(groups: DataFrame, primary: str) -> DataFrame:
    """Stream groups with the committed offset of the queue's primary work group of the same pattern."""
    work = groups.filter(F.col("group_id") == primary).filter("mode = 'queue'").select("queue", "pattern", F.col("committed").alias("work_committed"))
    return groups.filter("mode = 'stream'").join(work, ["queue", "pattern"], "left")


def stealable(pending: DataFrame, consumer: str, as_of: str, visibility_s: int = VISIBILITY_S) -> DataFrame:
    cutoff = F.timestamp_seconds(F.unix_seconds(F.lit(as_of).cast("timestamp")) - visibility_s)
    return pending.filter((F.col("consumer") != consumer) & (F.col("claimed_at") < cutoff))


def steal_outcome(rows: DataFrame, log: DataFrame, as_of: str, most: int = MAX_DELIVERIES) -> DataFrame:
    """What stealing makes of each stale entry: dead_letter, gone (truncated), expired or redeliver."""
    at = log.select("queue", "offset", "topic", F.col("expires_at").alias("_x"), F.lit(True).alias("_here"))
    expired = F.col("_x") < F.lit(as_of).cast("timestamp")
    outcome = (
        F.when(F.col("deliveries") >= most, "dead_letter").when(F.col("_here").isNull(), "gone").when(expired, "expired").otherwise("redeliver")
    )
    return rows.join(at, ["queue", "offset"], "left").withColumn("outcome", outcome).drop("_x", "_here")


def dead_letters(pending: DataFrame, log: DataFrame, queues: DataFrame, as_of: str, most: int = MAX_DELIVERIES, prefix: str = "$dlq/") -> DataFrame:
    """Messages delivered too often, addressed to the dead-letter topic of queues that have one."""
    due = pending.filter(F.col("deliveries") >= most).join(F.broadcast(queues.filter("dlq").select("queue", "dlq_topic")), "queue")
    rows = due.join(log.select("queue", "offset", "topic", "payload"), ["queue", "offset"])
    target = F.when(F.col("dlq_topic") == "", F.concat(F.lit(prefix), F.col("queue"))).otherwise(F.col("dlq_topic"))
    moved = F.lit(as_of).cast("timestamp")
    props = v.dlq_properties(F.lit(None).cast("map<string,string>"), F.col("queue"), F.col("topic"), F.col("group"), F.col("deliveries"), moved, F.lit(""))
    return rows.withColumns({"dlq_queue": target, "properties": props, "state": F.lit("dlq")})


def redelivery(pending: DataFrame, as_of: str, timeout_s: int, per_shard: int, shards: int = PEL_SHARDS) -> DataFrame:
    """Stale entries by shard, the first ``per_shard`` offsets of each."""
    cutoff = F.timestamp_seconds(F.unix_seconds(F.lit(as_of).cast("timestamp")) - timeout_s)
    rows = pending.filter(F.col("claimed_at") < cutoff).withColumn("shard", v.pel_shard(F.col("offset"), shards))
    place = F.row_number().over(Window.partitionBy("queue", "group", "shard").orderBy("offset"))
    return rows.withColumn("_p", place).filter(F.col("_p") <= per_shard).drop("_p")


def redelivery_batches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("queue", "group", "shard").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))


def shard_assignments(nodes: DataFrame, shards: int = PEL_SHARDS) -> DataFrame:
    """node, shards: shard i belongs to the node in place i modulo their number, nodes in order of name. Nodes are the few of a cluster."""
    one = nodes.select("node").distinct().agg(F.sort_array(F.collect_list("node")).alias("_n"))
    rows = one.select("_n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    rows = rows.select("shard", F.get("_n", F.col("shard") % F.size("_n")).alias("node"))
    return rows.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("shards"))


def by_node(consumers: DataFrame, own: str) -> DataFrame:
    return consumers.withColumn("remote", F.col("node") != own)


def cursor_start(position: Column, offset: Column, at_time: Column, head: Column, tail: Column, default: Column) -> Column:
    """Where a new group starts: earliest, latest, an offset within the log, a time, or the default."""
    return (
        F.when(position == "earliest", head)
        .when(position == "latest", tail)
        .when(position == "offset", F.least(F.greatest(offset, head), tail))
        .when(position == "timestamp", F.coalesce(at_time, tail))
        .otherwise(default)
    )


def seen_offsets(acks: DataFrame, groups: DataFrame) -> DataFrame:
    """Committed offset of auto-committing stream groups after acknowledgements: one past the highest, never back."""
    top = acks.groupBy("queue", "group").agg((F.max("offset") + 1).alias("_top"))
    out = groups.withColumn("group", group_name()).join(top, ["queue", "group"], "left")
    moves = (F.col("mode") == "stream") & F.col("auto_commit")
    return out.withColumn("advanced", F.when(moves, F.greatest("committed", F.coalesce("_top", "committed"))).otherwise(F.col("committed"))).drop("_top")


def commit_offsets(groups: DataFrame, commits: DataFrame) -> DataFrame:
    """Explicit commits: stream groups only, not past the cursor."""
    top = commits.groupBy("queue", "group").agg(F.max("offset").alias("_o"))
    out = groups.withColumn("group", group_name()).join(top, ["queue", "group"], "left")
    ok = (F.col("mode") == "stream") & (F.col("_o") <= F.col("cursor"))
    return out.withColumns({"accepted": F.coalesce(ok, F.lit(False)), "advanced": F.when(ok, F.col("_o")).otherwise(F.col("committed"))}).drop("_o")


def consumer_metrics(claims: DataFrame) -> DataFrame:
    """attempts, successes, rate and mean latency (whole) of (queue, ok, latency_ms)."""
    out = claims.groupBy("queue").agg(
        F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("latency_ms"))), F.lit(0)).alias("_l")
    )
    return out.select(
        "queue", "attempts", "successes", v.share_of(F.col("successes").cast("double"), F.col("attempts").cast("double")).alias("rate"),
        F.when(F.col("successes") > 0, F.expr("_l div successes")).otherwise(0).alias("mean_latency_ms"),
    )


def high_water(sizes: DataFrame, order: str = "seq", rows_per_range: int = 200_000) -> DataFrame:
    """Running maximum of pel_size by queue and group, over ranges of ``order`` (an integer)."""
    key = ["queue", "group"]
    part = F.floor(F.col(order) / rows_per_range).alias("_part")
    tops = sizes.groupBy(*key, part).agg(F.max("pel_size").alias("_top"))
    ahead = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*key, "_part", F.max("_top").over(ahead).alias("_ahead"))
    inside = Window.partitionBy(*key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # by number: a group's ranges are many, a session's partitions may be few
    rows = sizes.withColumn("_part", part).repartition(DIRECT, *key, "_part").withColumn("_in", F.max("pel_size").over(inside)).join(tops, [*key, "_part"])
    return rows.withColumn("high_water", F.greatest("_in", "_ahead")).drop("_part", "_in", "_ahead")
