"""Claims, acknowledgements and transfers of work groups, as joins and folds over tables.

A group's state is its row in ``groups`` (queue, group, pattern, cursor, committed) and
its rows in ``pending`` (queue, group, offset, consumer, claimed_at, deliveries). An
operation takes the tables and gives the new ones. Offsets of a group don't depend on
each other but for its cursor and committed offset, so they are folded apart.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import topics as t
from .groups import MAX_DELIVERIES, VISIBILITY_S
from .log import live
from .ranking import first_rows, totals_before

MAX_PENDING = 100_000
ROWS_PER_RANGE = 100_000
CLAIM_LIMIT = 10
GROUP = ["queue", "group"]
ENTRY = ["queue", "group", "offset"]
FIELDS = [*ENTRY, "consumer", "claimed_at", "deliveries"]


class Claimed(NamedTuple):
    """rows: what is delivered, with its source (new or stolen); dead: what goes to the dead-letter queue."""

    rows: DataFrame
    pending: DataFrame
    groups: DataFrame
    dead: DataFrame


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def _takes(pattern: Column, queue: Column, topic: Column) -> Column:
    return t.routing_key_match(pattern, t.routing_key(topic, t.queue_topic(queue)))


def next_rows(log: DataFrame, asked: DataFrame, limit: Column, as_of: str) -> DataFrame:
    """The next ``limit`` live rows of each group in ``asked`` from its cursor whose routing key its pattern takes."""
    ready = log.join(F.broadcast(asked), "queue").filter((F.col("offset") >= F.col("cursor")) & live(F.col("expires_at"), as_of))
    return first_rows(ready.filter(_takes(F.col("pattern"), F.col("queue"), F.col("topic"))), GROUP, "offset", limit)


def claim_batch(
    groups: DataFrame,
    pending: DataFrame,
    log: DataFrame,
    requests: DataFrame,
    as_of: str,
    visibility_s: int = VISIBILITY_S,
    most_deliveries: int = MAX_DELIVERIES,
    most_pending: int = MAX_PENDING,
    single: bool = False,
) -> Claimed:
    """One claim for each group in ``requests`` (queue, group, consumer, limit).

    New rows come first, as long as the group has fewer than ``most_pending`` entries (0: no limit),
    and move the cursor past the last one. What is missing of the limit is stolen, by
    offset, from other consumers' entries claimed longer than ``visibility_s`` ago: an
    entry delivered ``most_deliveries`` times is dead and goes, an expired one goes,
    one whose row is truncated or not taken by the pattern stays, another changes its
    owner and counts one delivery more. Entries after the last one needed are not
    looked at. With ``single`` (a claim of one row) a full list is an error: nothing
    is stolen either. The committed offset stays. Entries are looked at by ranges of
    offsets; groups, which are few beside their entries, are broadcast.
    """
    held = pending.groupBy(*GROUP).agg(F.count("*").alias("_held"))
    asked = groups.join(requests.select(*GROUP, F.col("consumer").alias("_by"), F.col("limit").cast("bigint").alias("_limit")), GROUP)
    room = F.greatest(most_pending - F.coalesce("_held", F.lit(0)), F.lit(0)) if most_pending > 0 else F.col("_limit")
    asked = asked.join(held, GROUP, "left").withColumn("_room", room)
    asked = asked.select(*GROUP, "pattern", "cursor", "_by", "_limit", "_room")

    fresh = next_rows(log, asked, F.least("_limit", "_room"), as_of)
    fresh = fresh.select(*ENTRY, F.col("_by").alias("consumer"), _now(as_of).alias("claimed_at"), F.lit(1).alias("deliveries"), "topic", F.lit("new").alias("source"))
    got = fresh.groupBy(*GROUP).agg(F.count("*").alias("_got"), (F.max("offset") + 1).alias("_next"))
    asked = asked.join(got, GROUP, "left").withColumn("_left", F.col("_limit") - F.coalesce("_got", F.lit(0)))
    if single:
        asked = asked.filter("_room > 0")

    stale = pending.join(F.broadcast(asked.filter("_left > 0")), GROUP).filter(
        (F.col("consumer") != F.col("_by")) & (F.unix_micros("claimed_at") < F.unix_micros(_now(as_of)) - F.lit(visibility_s * 1_000_000).cast("bigint"))
    )
    rows = log.select("queue", "offset", "topic", F.col("expires_at").alias("_x"), F.lit(True).alias("_here"))
    fate = (
        F.when(F.col("deliveries") >= most_deliveries, "dead")
        .when(F.col("_here").isNull(), "stays")
        .when(~live(F.col("_x"), as_of), "expired")
        .when(_takes(F.col("pattern"), F.col("queue"), F.col("topic")), "taken")
        .otherwise("stays")
    )
    stale = stale.join(rows, ["queue", "offset"], "left").withColumn("_fate", fate)
    part, taken = F.floor(F.col("offset") / ROWS_PER_RANGE).cast("bigint"), (F.col("_fate") == "taken").cast("int")
    stale = stale.withColumns({"_part": part, "_one": taken})
    # a row for each range of offsets; those after the last one needed are left out
    parts = totals_before(stale.groupBy(*GROUP, "_part", "_left").agg(F.sum("_one").alias("_n")), GROUP, "_part", "_n", "_before")
    parts = parts.filter("_before < _left").select(*GROUP, "_part", "_before")
    before = Window.partitionBy(*GROUP, "_part").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    seen = stale.join(F.broadcast(parts), [*GROUP, "_part"]).withColumn("_taken", F.col("_before") + F.coalesce(F.sum("_one").over(before), F.lit(0))).filter("_taken < _left")
    stolen = seen.filter("_fate = 'taken'").select(
        *ENTRY, F.col("_by").alias("consumer"), _now(as_of).alias("claimed_at"), (F.col("deliveries") + 1).alias("deliveries"), "topic", F.lit("stolen").alias("source")
    )
    out = fresh.unionByName(stolen)
    changed = seen.filter("_fate <> 'stays'").select(*ENTRY)
    entries = pending.select(*FIELDS).join(changed, ENTRY, "left_anti").unionByName(out.select(*FIELDS))
    moved = groups.join(got.select(*GROUP, "_next"), GROUP, "left").withColumn("cursor", F.coalesce("_next", "cursor")).drop("_next")
    return Claimed(out, entries, moved, seen.filter("_fate = 'dead' and _here").select(*FIELDS, "topic"))


def claim_stream(groups: DataFrame, log: DataFrame, requests: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Rows for one claim of each stream group, and the groups with moved cursors; there are no pending entries.

    The cursor goes past the last row delivered; groups that commit on their own move
    the committed offset with it. Neither ever goes back.
    """
    asked = groups.join(requests.select(*GROUP, F.col("consumer").alias("_by"), F.col("limit").cast("bigint").alias("_limit")), GROUP).filter("mode = 'stream'")
    out = next_rows(log, asked.select(*GROUP, "pattern", "cursor", "_by", "_limit"), F.col("_limit"), as_of)
    got = out.groupBy(*GROUP).agg((F.max("offset") + 1).alias("_next"))
    return out.select(*ENTRY, F.col("_by").alias("consumer"), "topic"), commit_cursors(groups, got.withColumnRenamed("_next", "cursor"))


def commit_cursors(groups: DataFrame, cursors: DataFrame) -> DataFrame:
    """Stream groups at the ``cursors`` (queue, group, cursor) that lie ahead of theirs.

    Where ``groups`` has ``committed_at`` (null: never), ``interval_s`` and ``now``, an
    auto-commit waits until that many seconds have passed since the last one.
    """
    out = groups.join(cursors.select(*GROUP, F.col("cursor").alias("_to")), GROUP, "left")
    ahead = (F.col("mode") == "stream") & (F.col("_to") > F.col("cursor"))
    due = F.lit(True)
    if {"committed_at", "interval_s", "now"} <= set(groups.columns):
        waited = F.unix_micros("now") - F.unix_micros("committed_at")
        due = (F.col("interval_s") <= 0) | F.col("committed_at").isNull() | (waited >= F.col("interval_s").cast("bigint") * 1_000_000)
    commits = ahead & F.col("auto_commit") & due
    return out.withColumns({"committed": F.when(commits, F.col("_to")).otherwise(F.col("committed")), "cursor": F.when(ahead, F.col("_to")).otherwise(F.col("cursor"))}).drop("_to")


def consume(groups: DataFrame, log: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """The next ``limit`` (0: 10) rows of each group from its cursor, as pending entries with no delivery counted.

    Neither pattern nor expiry is looked at, and the cursor stays: the same request
    gives the same rows again.
    """
    limit = F.when(F.col("limit") > 0, F.col("limit")).otherwise(CLAIM_LIMIT).cast("bigint")
    asked = groups.join(requests.select(*GROUP, F.col("consumer").alias("_by"), limit.alias("_limit")), GROUP).select(*GROUP, "cursor", "_by", "_limit")
    rows = first_rows(log.join(F.broadcast(asked), "queue").filter(F.col("offset") >= F.col("cursor")), GROUP, "offset", F.col("_limit"))
    return rows.select(*ENTRY, F.col("_by").alias("consumer"), _now(as_of).alias("claimed_at"), F.lit(0).alias("deliveries"), "topic")


def claim_idle(pending: DataFrame, log: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """Entries that pass to the claiming consumer: for each request (queue, group, consumer, min_idle_s, limit) those of others idle for at least that long.

    The first ``limit`` (0: 10) by offset, of those whose rows are still in the log.
    """
    limit = F.when(F.col("limit") > 0, F.col("limit")).otherwise(CLAIM_LIMIT).cast("bigint")
    asked = requests.select(*GROUP, F.col("consumer").alias("_by"), "min_idle_s", limit.alias("_limit"))
    idle = F.unix_micros(_now(as_of)) - F.unix_micros("claimed_at") >= F.col("min_idle_s").cast("bigint") * 1_000_000
    rows = pending.join(F.broadcast(asked), GROUP).filter((F.col("consumer") != F.col("_by")) & idle)
    rows = rows.join(log.select("queue", "offset", "topic", "payload"), ["queue", "offset"])
    out = first_rows(rows, GROUP, "offset", F.col("_limit"))
    return out.select(*ENTRY, F.col("_by").alias("consumer"), _now(as_of).alias("claimed_at"), (F.col("deliveries") + 1).alias("deliveries"), "topic", "payload")


def entry_step(entry: dict[str, Column], op: Column, visibility_s: int) -> tuple[dict[str, Column], Column]:
    """A pending entry (consumer, claimed_us, deliveries, here) after one operation, and whether that succeeded.

    ack and reject remove the entry, nack dates its claim back past the visibility
    timeout and transfer gives it to ``to``; only the owner's operations count. nack
    and transfer count a delivery each.
    """
    ok = entry["here"] & F.coalesce(entry["consumer"] == op["consumer"], F.lit(False))
    gone, back, over = (ok & op["op"].isin(*names) for names in (("ack", "ack_batch", "reject"), ("nack",), ("transfer",)))
    after = {
        "consumer": F.when(over, op["to"]).otherwise(entry["consumer"]),
        "claimed_us": F.when(back, op["at_us"] - F.lit((visibility_s + 1) * 1_000_000).cast("bigint")).when(over, op["at_us"]).otherwise(entry["claimed_us"]),
        "deliveries": entry["deliveries"] + F.when(back | over, 1).otherwise(0),
        "here": entry["here"] & ~gone,
    }
    return after, ok


def settle(groups: DataFrame, pending: DataFrame, ops: DataFrame, visibility_s: int = VISIBILITY_S) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes of the operations, the new pending entries and the new groups.

    ops: queue, group, seq, op (ack, ack_batch, reject, nack, transfer), offset,
    consumer, to, at. An entry's operations are folded in order of seq; they are as
    few as its deliveries. The committed offset moves up to the first entry left, or
    to the cursor, if any entry was removed, or if there was an ack_batch, which moves
    it even where all its acks fail.
    """
    item = F.struct("seq", "op", "consumer", "to", F.unix_micros("at").alias("at_us"))
    listed = ops.groupBy(*ENTRY).agg(F.sort_array(F.collect_list(item)).alias("_ops"))
    start = {
        "consumer": F.col("consumer"),
        "claimed_us": F.unix_micros("claimed_at"),
        "deliveries": F.coalesce("deliveries", F.lit(0)),
        "here": F.col("consumer").isNotNull(),
        "done": F.array().cast("array<struct<seq:bigint,op:string,ok:boolean>>"),
    }
    pack = lambda d: F.struct(*[v.alias(k) for k, v in d.items()])

    def step(a: Column, o: Column) -> Column:
        after, ok = entry_step({k: a[k] for k in start if k != "done"}, o, visibility_s)
        done = F.struct(o["seq"].cast("bigint").alias("seq"), o["op"].alias("op"), ok.alias("ok"))
        return pack(after | {"done": F.concat(a["done"], F.array(done))})

    folded = listed.join(pending.select(*FIELDS), ENTRY, "left").select(*ENTRY, F.aggregate("_ops", pack(start), step).alias("_e"))
    outcomes = folded.select(*ENTRY, F.explode("_e.done").alias("_d")).select(*ENTRY, "_d.seq", "_d.op", "_d.ok")
    left = folded.filter("_e.here").select(*ENTRY, "_e.consumer", F.timestamp_micros("_e.claimed_us").alias("claimed_at"), "_e.deliveries")
    entries = pending.select(*FIELDS).join(listed.select(*ENTRY), ENTRY, "left_anti").unionByName(left)
    moves = outcomes.groupBy(*GROUP).agg(F.max((F.col("op") == "ack_batch") | (F.col("ok") & F.col("op").isin("ack", "reject"))).alias("_moves"))
    return outcomes, entries, _advanced(groups, entries, moves)


def _advanced(groups: DataFrame, entries: DataFrame, moves: DataFrame) -> DataFrame:
    low = entries.groupBy(*GROUP).agg(F.min("offset").alias("_low"))
    out = groups.join(low, GROUP, "left").join(moves, GROUP, "left")
    to = F.when(F.col("_low").isNull(), F.col("cursor")).otherwise(F.greatest("committed", "_low"))
    return out.withColumn("committed", F.when(F.col("_moves"), to).otherwise(F.col("committed"))).drop("_low", "_moves")


def settle_directly(groups: DataFrame, pending: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acknowledgements without a manager: owned entries of an ack or a nack go, and the highest acked offset plus one is committed, pending or not.

    ops: queue, group, op (ack or nack), offset, consumer. Returns pending and groups.
    """
    gone = ops.select(*ENTRY, "consumer").distinct()
    top = ops.filter("op = 'ack'").groupBy(*GROUP).agg((F.max("offset") + 1).alias("_top"))
    moved = groups.join(top, GROUP, "left").withColumn("committed", F.coalesce("_top", "committed")).drop("_top")
    return pending.select(*FIELDS).join(gone, [*ENTRY, "consumer"], "left_anti"), moved


def oldest(pending: DataFrame, count: int) -> DataFrame:
    """The ``count`` entries of each group claimed first; of equal times the lower offset comes first."""
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("claimed_at", "offset"))
    return pending.withColumn("place", place).filter(F.col("place") <= count)


def pop_oldest(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entry of each group claimed first, and the entries left."""
    first = pending.groupBy(*GROUP).agg(F.min_by(F.struct("offset", "consumer", "claimed_at", "deliveries"), F.struct("claimed_at", "offset")).alias("_e"))
    first = first.select(*GROUP, "_e.offset", "_e.consumer", "_e.claimed_at", "_e.deliveries")
    return first, pending.join(first.select(*ENTRY), ENTRY, "left_anti")


def dead_letter_batches(pending: DataFrame, most_deliveries: int, per_group: int) -> DataFrame:
    """queue, group, offsets: the first ``per_group`` entries of each group delivered that often."""
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("offset"))
    due = pending.filter(F.col("deliveries") >= most_deliveries).withColumn("_p", place).filter(F.col("_p") <= per_group)
    return due.groupBy(*GROUP).agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
