"""Members of consumer groups, and what depends on them: references, queues without consumers, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import blocks_of, let
from .ranking import range_of, totals_before

MEMBER = ["queue", "group", "consumer"]
MEMBERS_PER_RANGE = 100_000
#: Tasks over which sessions are dealt: as many as a shuffle writes to without holding its rows in memory (spark.shuffle.sort.bypassMergeThreshold).
SESSION_TASKS = 200


def members(ops: DataFrame) -> DataFrame:
    """Registered consumers after ``ops`` (queue, group, consumer, client_id, node, seq, op, at).

    join registers (again: anew), leave removes, heartbeat touches a registered one.
    """
    joins, beats = F.col("op") == "join", F.col("op").isin("join", "heartbeat")
    last = lambda what, when: F.max_by(F.when(when, what), F.when(when, F.col("seq")))
    out = ops.groupBy(*MEMBER).agg(
        F.max(F.when(joins, F.col("seq"))).alias("_in"),
        F.max(F.when(F.col("op") == "leave", F.col("seq"))).alias("_out"),
        last(F.struct("client_id", "node", "at"), joins).alias("_j"),
        last(F.col("at"), beats).alias("last_heartbeat"),
    )
    here = F.col("_in").isNotNull() & (F.col("_out").isNull() | (F.col("_in") > F.col("_out")))
    return out.filter(here).select(*MEMBER, "_j.client_id", "_j.node", F.col("_j.at").alias("registered_at"), "last_heartbeat")


def of_queue(consumers: DataFrame, queue: str, group: str | None = None) -> DataFrame:
    """Consumers of a queue, or of one of its groups."""
    own = consumers.filter(F.col("queue") == queue)
    return own if group is None else own.filter(F.col("group") == group)


def subscription_snapshots(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions of all connections, by filter, then client."""
    return subscriptions.orderBy("filter", "client_id")


def timed_out(consumers: DataFrame, as_of: str, timeout_s: int) -> DataFrame:
    """Consumers without a heartbeat for longer than ``timeout_s``."""
    return consumers.filter(F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_heartbeat") > F.lit(timeout_s * 1_000_000).cast("bigint"))


def disconnected_queues(queues: DataFrame, ops: DataFrame) -> DataFrame:
    """queue, disconnected_at: the ephemeral queues whose last consumer has left, and when."""
    left = ops.filter("op = 'leave'").groupBy("queue").agg(F.max_by("at", "seq").alias("disconnected_at"))
    own = queues.filter(~F.col("durable") & ~F.col("reserved")).select("queue")
    return own.join(left, "queue").join(members(ops).select("queue").distinct(), "queue", "left_anti")


def references(ops: DataFrame) -> DataFrame:
    """client_id, queue, group, refs and last_seen of subscriptions that are still referred to.

    subscribe counts one up, unsubscribe one down but never below none; both and touch
    are seen. The count that never falls below none is the sum less the lowest of the
    running sums and 0.
    """
    key = ["client_id", "queue", "group"]
    change = F.when(F.col("op") == "subscribe", 1).when(F.col("op") == "unsubscribe", -1).otherwise(0)
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ops.withColumn("_sum", F.sum(change).over(w))
    out = rows.groupBy(*key).agg((F.max_by("_sum", "seq") - F.least(F.min("_sum"), F.lit(0))).alias("refs"), F.max_by(F.when(F.col("op") != "unsubscribe", F.col("at")), F.when(F.col("op") != "unsubscribe", F.col("seq"))).alias("last_seen"))
    return out.filter("refs > 0")


def pruned(refs: DataFrame, as_of: str, timeout_s: int) -> DataFrame:
    """References seen within twice the consumer timeout (five minutes if that is 0)."""
    idle = 2 * timeout_s if timeout_s > 0 else 300
    return refs.filter(F.unix_micros("last_seen") >= F.unix_micros(F.lit(as_of).cast("timestamp")) - F.lit(idle * 1_000_000).cast("bigint"))


def group_turns(consumers: DataFrame) -> DataFrame:
    """queue, group, turn and consumer: the order in which a group's members, by id, take turns."""
    ids = consumers.select("queue", "group", "consumer").filter("consumer is not null").distinct()
    part = range_of(ids, [F.col("consumer")], MEMBERS_PER_RANGE)
    ids = ids.withColumn("_part", part)
    ahead = totals_before(ids.groupBy("queue", "group", "_part").agg(F.count("*").alias("_n")), ["queue", "group"], "_part", "_n", "_before").drop("_n")
    inside = Window.partitionBy("queue", "group", "_part").orderBy("consumer")
    out = ids.withColumn("_rn", F.row_number().over(inside) - 1).join(ahead, ["queue", "group", "_part"])
    return out.select("queue", "group", (F.col("_before") + F.col("_rn")).cast("int").alias("turn"), "consumer")


def inflight_window(packets: DataFrame, most: int) -> DataFrame:
    """Adds ``outcome`` to a session's packets (client_id, direction, seq, op, packet_id).

    add of a new packet id is admitted while fewer than ``most`` ids of its direction
    are in flight, else full; add of one in flight replaces it; done releases one, or
    is unknown. A session's packets of a direction are folded in order of seq.
    """
    item = F.struct("seq", "op", "packet_id")
    # by number: the few partitions of a small setting would hold many long sessions each
    dealt = packets.repartition(SESSION_TASKS, "client_id", "direction")
    listed = dealt.groupBy("client_id", "direction").agg(F.sort_array(F.collect_list(item)).alias("_p"))
    kind = packets.schema["packet_id"].dataType.simpleString()

    def one(a: Column, p: Column) -> Column:
        # each packet takes one branch, which looks it up once and adds a letter to a short string: lists grow by copies
        held, x, add = a["held"], p["packet_id"], p["op"] == "add"
        to = lambda after, letter: F.struct(after.alias("held"), F.concat(a["out"], F.lit(letter)).alias("out"))
        known = F.array_contains(held, x)
        more = F.when(x.isNull(), held).otherwise(F.concat(held, F.array(x)))
        less = F.when(~add, F.array_remove(held, x)).otherwise(held)
        added = F.when(known, to(held, "r")).when(F.size(held) < most, to(more, "a")).otherwise(to(held, "f"))
        return F.when(add, added).when(known, to(less, "d")).otherwise(to(held, "u"))

    def block(a: Column, b: Column) -> Column:
        folded = F.aggregate(b, F.struct(a["held"].alias("held"), F.lit("").alias("out")), one)
        return let(folded, lambda r: F.struct(r["held"].alias("held"), F.concat(a["outs"], F.array(r["out"])).alias("outs")))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("held"), F.array().cast("array<string>").alias("outs"))
    letters = lambda bs: F.aggregate(bs, start, block, lambda a: a["outs"])
    blocks = let(blocks_of(F.col("_p")), lambda bs: F.arrays_zip(bs.alias("p"), letters(bs).alias("o")))
    out = listed.select("client_id", "direction", F.explode(blocks).alias("_b"))
    out = out.select("client_id", "direction", F.col("_b.o").alias("_o"), F.posexplode("_b.p").alias("_i", "_x"))
    letter = F.substr("_o", F.col("_i") + 1, F.lit(1))
    outcome = F.when(letter == "r", "replaced").when(letter == "a", "admitted").when(letter == "f", "full").when(letter == "d", "released").otherwise("unknown")
    return out.select("client_id", "direction", "_x.seq", "_x.op", "_x.packet_id", outcome.alias("outcome"))
