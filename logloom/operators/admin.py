"""Listings, merges and statistics of sessions, subscriptions and queues; housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INFLIGHT_MIN_ATTEMPT_MS = 500


def page(rows: DataFrame, key: str, limit: int, prefix: str = "", token: str = "") -> DataFrame:
    """The next ``limit`` rows by key after a token; ``next_token`` is the last key if more follow."""
    kept = rows.filter(F.col(key).startswith(prefix) & (F.col(key) > token)) if token else rows.filter(F.col(key).startswith(prefix))
    some = kept.orderBy(key).limit(limit + 1)
    w = Window.orderBy(key)  # limit + 1 rows
    some = some.withColumns({"_n": F.row_number().over(w), "_of": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    last = F.max(F.when(F.col("_n") <= limit, F.col(key))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return some.withColumn("next_token", F.when(F.col("_of") > limit, last).otherwise("")).filter(F.col("_n") <= limit).drop("_n", "_of")


def first_of(rows: list[DataFrame], key: str) -> DataFrame:
    """Union of tables; of equal keys the earlier table's row stays."""
    out = None
    for i, df in enumerate(rows):
        one = df.withColumn("_order", F.lit(i))
        out = one if out is None else out.unionByName(one)
    rest = [c for c in out.columns if c not in (key, "_order")]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), "_order").alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_live(stored: DataFrame, live: DataFrame, key: str = "client_id") -> DataFrame:
    """Stored and live sessions; what is live wins field by field."""
    rest = [c for c in stored.columns if c != key]
    l = live.select(key, *[F.col(c).alias(f"_l_{c}") for c in rest])
    out = stored.join(l, key, "full_outer")
    return out.select(key, *[F.coalesce(f"_l_{c}", c).alias(c) for c in rest])


def session_snapshot(sessions: DataFrame, subscriptions: DataFrame, inflight: DataFrame, offline: DataFrame, wills: DataFrame) -> DataFrame:
    """Sessions with counts of subscriptions, packets in flight and queued messages, and whether a will is set."""
    count = lambda df, name: df.groupBy("client_id").agg(F.count("*").alias(name))
    out = sessions
    for df, name in ((subscriptions, "n_subscriptions"), (inflight, "n_inflight"), (offline, "n_offline")):
        out = out.join(count(df, name), "client_id", "left")
    has = wills.select("client_id").distinct().withColumn("has_will", F.lit(True))
    return out.join(has, "client_id", "left").fillna(0, ["n_subscriptions", "n_inflight", "n_offline"]).fillna({"has_will": False})


def subscription_summary(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("filter").agg(F.count_distinct("client_id").alias("clients"), F.max("qos").alias("max_qos"))


def merge_summaries(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sums of clients and the highest qos by filter, for other protocols or nodes."""
    return first.unionByName(second).groupBy("filter").agg(F.sum("clients").alias("clients"), F.max("max_qos").alias("max_qos"))


def subscription_clients(subscriptions: DataFrame, topic_filter: str, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    return subscriptions.filter(F.col("filter") == topic_filter).groupBy(*keys).agg(F.max("qos").alias("qos"))


def missing_clients(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table's clients, and the second's that it lacks."""
    return first.unionByName(second.join(first.select("client_id"), "client_id", "left_anti"))


def contracts_merge(first: DataFrame, second: DataFrame, key: str = "queue") -> DataFrame:
    return first_of([first, second], key)


def contract_mismatch(expected: DataFrame, persisted: DataFrame, fields: list[str], key: str = "queue") -> DataFrame:
    """The first field that differs, null-safe, for each expected queue; 'missing' without a row."""
    p = persisted.select(F.col(key), *[F.col(c).alias(f"_p_{c}") for c in fields], F.lit(True).alias("_there"))
    out = expected.join(p, key, "left")
    reason = F.when(F.col("_there").isNull(), "missing")
    for c in fields:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_p_{c}")), c)
    return out.select(key, reason.alias("reason")).filter("reason is not null")


def config_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Leaves (path, value) that changed: added, removed or changed."""
    o, n = old.select("path", F.col("value").alias("old")), new.select("path", F.col("value").alias("new"))
    out = o.withColumn("_o", F.lit(True)).join(n.withColumn("_n", F.lit(True)), "path", "full_outer")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return out.withColumn("change", kind).filter("change is not null").select("path", "change", "old", "new")


def stats_by(rows: DataFrame, by: str, aggregates: list[Column]) -> DataFrame:
    """Totals (null) and one row for each value of ``by``."""
    return rows.rollup(by).agg(*aggregates)


def counters_as_topics(counters: DataFrame, root: str = "$SYS/broker/") -> DataFrame:
    """One row of counters as retained (topic, value) rows; __ in a name stands for a slash."""
    pairs = F.array(*[F.struct(F.lit(root + c.replace("__", "/")).alias("topic"), F.col(c).cast("string").alias("value")) for c in counters.columns])
    return counters.select(F.explode(pairs).alias("p")).select("p.topic", "p.value")


def bounded_queue(rows: DataFrame, key: str, order: list[str], most: int = 1000, evict_oldest: bool = True) -> DataFrame:
    """A bounded FIFO of each key: the newest ``most`` rows, or the first ones where new rows are refused."""
    by = [F.desc(c) for c in order] if evict_oldest else order
    place = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return rows.withColumn("_p", place).filter(F.col("_p") <= most).drop("_p")


def delivery_kind(expired: Column, connected: Column, qos: Column) -> Column:
    """What happens to a message for a session: drop_expired, send, drop_offline or queue."""
    return F.when(expired, "drop_expired").when(connected, "send").when(qos == 0, "drop_offline").otherwise("queue")


def expired_sessions(sessions: DataFrame, as_of: str) -> DataFrame:
    """Disconnected and past the expiry interval; 0 never expires."""
    gone = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("disconnected_at")
    return sessions.filter(~F.col("connected") & (F.col("expiry_s") > 0) & (gone > F.col("expiry_s")))


def pending_wills(wills: DataFrame, as_of: str) -> DataFrame:
    return wills.filter(F.unix_seconds("disconnected_at") + F.col("delay_s") <= F.unix_seconds(F.lit(as_of).cast("timestamp")))


def triggered_wills(wills: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """Due wills of clients that are not connected."""
    return pending_wills(wills, as_of).join(sessions.filter("connected").select("client_id"), "client_id", "left_anti")


def inflight_retries(inflight: DataFrame, timeout_ms: int) -> DataFrame:
    """Outbound packets sent longer ago than the timeout, or never sent and tried 500 ms ago or more."""
    late = (F.col("sent_age_ms") > timeout_ms) | (F.col("sent_age_ms").isNull() & (F.col("attempted_age_ms") >= INFLIGHT_MIN_ATTEMPT_MS))
    return inflight.filter((F.col("direction") == "out") & late)


def stale(rows: DataFrame, seen_at: str, as_of: str, timeout_s: int) -> DataFrame:
    return rows.filter(F.unix_seconds(seen_at) < F.unix_seconds(F.lit(as_of).cast("timestamp")) - timeout_s)


def ephemeral_expired(queues: DataFrame) -> DataFrame:
    """Queues neither durable nor reserved that were without a consumer for longer than allowed."""
    return queues.filter(~F.col("durable") & ~F.col("reserved") & (F.col("expires_after_s") > 0) & (F.col("idle_s") > F.col("expires_after_s")))


def valid_queue_config(q: dict[str, Column]) -> Column:
    """Bounds of a queue's configuration; durations in seconds."""
    return (
        (q["name"] != "") & (F.size(q["topics"]) > 0) & (q["max_message_size"] > 0) & (q["max_depth"] > 0) & (q["delivery_timeout"] > 0)
        & (q["batch_size"] > 0) & (q["heartbeat_timeout"] > 0) & (q["max_retries"] >= 0) & (q["initial_backoff"] >= 0)
        & (q["max_backoff"] >= q["initial_backoff"]) & (q["backoff_multiplier"] >= 1.0) & (q["durable"] | (q["expires_after"] > 0))
        & (~q["reserved"] | q["durable"]) & q["type"].isin("", "classic", "stream")
    )


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed and new rows replace those with the same key."""
    return first_of([changes, table], key)


def delete_queue(queues: DataFrame, name: str) -> DataFrame:
    """Without the queue, unless it is reserved."""
    return queues.filter((F.col("queue") != name) | F.col("reserved"))


def alias_topics(publishes: DataFrame) -> DataFrame:
    """The topic of each publish: its own, or the last one set for its connection's alias."""
    # a connection has its aliases to itself and numbers them from 1 to its maximum
    w = Window.partitionBy("connection", "alias").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("topic") != "", F.col("topic"))
    return publishes.withColumn("resolved", F.when(F.col("alias").isNull(), own).otherwise(F.last(own, ignorenulls=True).over(w)))


def first_packets(packets: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The first of repeated packets (or messages) of a key."""
    rest = [c for c in packets.columns if c not in key]
    return packets.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def delete_queues(queues: DataFrame, names: DataFrame) -> DataFrame:
    """Without the named queues, but for reserved ones."""
    gone = queues.filter(~F.col("reserved")).join(names.select("queue").distinct(), "queue", "left_semi").select("queue")
    return queues.join(gone, "queue", "left_anti")


def management_query(queues: DataFrame, attributes: list[str], equal: dict | None = None) -> DataFrame:
    """The named attributes of the queues that have the given values."""
    for column, value in (equal or {}).items():
        queues = queues.filter(F.col(column).eqNullSafe(F.lit(value)))
    return queues.select(*attributes)


def sys_counters(facts: DataFrame, version: str = "1.0") -> DataFrame:
    """The seventeen counters of a broker from one row of facts; names are topics, __ stands for a slash.

    Facts: up (seconds), connected, total, received, sent, bytes, sent_bytes, subscriptions,
    retained, errors. Errors of authentication, authorization and packets are 0 where
    facts don't tell them (auth_errors, authz_errors, packet_errors).
    """
    known = lambda c: F.col(c) if c in facts.columns else F.lit(0)
    return facts.select(
        F.lit(version).alias("version"), F.col("up").alias("uptime"), F.col("connected").alias("clients__connected"), F.col("total").alias("clients__total"), (F.col("total") - F.col("connected")).alias("clients__disconnected"),
        F.col("received").alias("messages__received"), F.col("sent").alias("messages__sent"), F.col("received").alias("messages__publish__received"), F.col("sent").alias("messages__publish__sent"),
        F.col("bytes").alias("bytes__received"), F.col("sent_bytes").alias("bytes__sent"), F.col("subscriptions").alias("subscriptions__count"), F.col("retained").alias("retained__count"),
        F.col("errors").alias("errors__protocol"), known("auth_errors").alias("errors__auth"), known("authz_errors").alias("errors__authz"), known("packet_errors").alias("errors__packet"),
    )


def get_or_create(queues: DataFrame, wanted: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The queues, and those in ``wanted`` (queue, ...) that don't exist, with ``defaults`` in the columns that wanted lacks.

    Adds created. A queue that is asked for twice is created once.
    """
    new = wanted.dropDuplicates(["queue"]).join(queues.select("queue"), "queue", "left_anti")
    new = new.select(*[F.col(c) if c in wanted.columns else defaults[c].alias(c) for c in queues.columns], F.lit(True).alias("created"))
    return queues.withColumn("created", F.lit(False)).unionByName(new)


def of_nodes(tables: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Listings of several nodes one after the other, with their node, in order; rows on two nodes stay twice."""
    out = None
    for node, df in tables.items():
        one = df.withColumn("node", F.lit(node))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(*order)


def overview(sessions: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """One row: sessions connected and in all, and the row counts of other tables by name."""
    out = sessions.agg(F.count_if("connected").alias("connected"), F.count("*").alias("sessions"))
    for name, df in counts.items():
        out = out.join(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
    return out


def message_metrics(rows: DataFrame, attribute: str, size: Column, bounds: list[float]) -> DataFrame:
    """Messages, bytes and a histogram of sizes by attribute: counts up to each bound, the last beyond all."""
    upto = F.array(*[F.lit(float(x)) for x in bounds])
    bucket = F.size(F.filter(upto, lambda b: b < size))  # a size equal to a bound is within it
    counts = [F.count_if(F.col("_bucket") == i) for i in range(len(bounds) + 1)]
    out = rows.select(F.col(attribute), size.alias("_size"), bucket.alias("_bucket"))
    return out.groupBy(attribute).agg(F.count("*").alias("messages"), F.sum("_size").alias("bytes"), F.array(*counts).alias("histogram"))


def within_qos(publishes: DataFrame, most: Column) -> DataFrame:
    """Publishes at or below the maximum that was agreed on; others are rejected."""
    return publishes.filter(F.col("qos") <= most)


def subscriptions_by(subscriptions: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Subscriptions whose client_id or filter is one of ``values``, letter by letter."""
    return subscriptions.join(values.select(column).distinct(), column, "left_semi")


def authorized_subscriptions(subscribes: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed``: a rule (client_id, filter, prefix, allow) for the filter, or for how it starts, allows it and none denies it."""
    rule = rules.select("client_id", F.col("filter").alias("_f"), "prefix", "allow")
    fits = F.when(F.col("prefix"), F.col("filter").startswith(F.col("_f"))).otherwise(F.col("filter") == F.col("_f"))
    found = subscribes.select("client_id", "filter").distinct().join(rule, "client_id").filter(fits)
    found = found.groupBy("client_id", "filter").agg(F.min("allow").alias("allowed"))
    return subscribes.join(found, ["client_id", "filter"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def apply_hooks(publishes: DataFrame, decide, fail_open: bool = False) -> DataFrame:
    """Publishes after a blocking hook, in batches: denied ones go, rewritten ones change.

    ``decide`` takes a pandas frame of publishes and returns it with an ``allowed``
    column; an exception denies the batch, or passes it unchanged with ``fail_open``.
    """
    from ..session import ship

    ship(publishes.sparkSession)

    def run(frames):
        for pdf in frames:
            try:
                out = decide(pdf.copy())
            except Exception:  # the hook's failure mode, not ours
                out = pdf.assign(allowed=fail_open)
            yield out[out["allowed"]][list(pdf.columns)]

    return publishes.mapInPandas(run, publishes.schema)


def authorized(publishes: DataFrame, grants: DataFrame) -> DataFrame:
    """Publishes whose client may use the exchange: an exact routing key, or a prefix of it."""
    g = grants.select("client_id", "exchange", F.col("routing_key").alias("_k"), "prefix")
    fit = F.when(F.col("prefix"), F.col("routing_key").startswith(F.col("_k"))).otherwise(F.col("routing_key") == F.col("_k"))
    return publishes.join(g, ["client_id", "exchange"]).filter(fit).select(*publishes.columns).distinct()
