"""Joins of publishes with queues, subscriptions, exchanges, endpoints and retained messages.

Wildcard joins are equality joins: for distinct topics the filters that can match are
enumerated, one for each shape (places of wildcards) that any filter has. Topics of
more than MAX_LEVELS levels are joined on the first level instead and checked by
pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import topics as t
from .log import assign_offsets

MAX_LEVELS = 8
#: Most pairs of a topic and a queue that are broadcast.
MAX_PAIRS = 500_000


def _matching(topics: DataFrame, filters: DataFrame, guard: bool) -> DataFrame:
    """(topic, _filter) for distinct topics and filters."""
    deep = F.size(F.split("topic", "/", -1)) > MAX_LEVELS
    # shapes of up to MAX_LEVELS levels: 3 * 2 ** MAX_LEVELS at most
    shapes = [r[0] for r in filters.filter(F.size(F.split("_filter", "/", -1)) <= MAX_LEVELS + 1).select(t.filter_shape(F.col("_filter"))).distinct().collect()]
    found = topics.filter(~deep).withColumn("_filter", F.explode(t.candidate_filters(F.col("topic"), sorted(shapes))))
    shallow = found.join(filters, "_filter", "left_semi").select("topic", "_filter")
    head = lambda c: F.substring_index(c, "/", 1)
    firsts = F.array_distinct(F.array(head(F.col("topic")), F.lit("+"), F.lit("#")))
    match = t.topic_match if guard else t.live_match
    rest = topics.filter(deep if guard else deep | F.col("topic").startswith("$")).withColumn("_first", F.explode(firsts))
    checked = rest.join(filters.withColumn("_first", head(F.col("_filter"))), "_first").filter(match(F.col("_filter"), F.col("topic")))
    return shallow.unionByName(checked.select("topic", "_filter")).distinct()


def match_filters(publishes: DataFrame, filters: DataFrame, filter_col: str, guard: bool = True) -> DataFrame:
    """publishes x filters where the filter matches the topic; a row for each pair.

    Filters must be valid. ``guard`` keeps ``$`` topics from filters without ``$``.
    """
    distinct = filters.select(F.col(filter_col).alias("_filter")).distinct()
    pairs = _matching(publishes.select("topic").distinct(), distinct, guard)
    targets = pairs.join(filters, pairs["_filter"] == filters[filter_col]).drop("_filter")
    return publishes.join(targets, "topic")


def match_bindings(publishes: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row for each publish and distinct queue with a pattern that matches.

    Topics are mostly few beside the publishes: up to MAX_PAIRS pairs are counted and
    broadcast, so that publishes are not shuffled by topic and a frequent topic is not
    one task; more are joined by topic.
    """
    distinct = bindings.select(F.col("pattern").alias("_filter")).distinct()
    pairs = _matching(publishes.select("topic").distinct(), distinct, True)
    queues = pairs.join(bindings, pairs["_filter"] == bindings["pattern"]).select("topic", "queue").distinct()
    return publishes.join(F.broadcast(queues) if queues.count() <= MAX_PAIRS else queues, "topic")


def forced_targets(publishes: DataFrame, targets: Column, queues: DataFrame) -> DataFrame:
    """A row for each existing queue in a comma-separated list, names trimmed, once each."""
    names = F.array_distinct(F.filter(F.transform(F.split(targets, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return publishes.withColumn("queue", F.explode(names)).join(queues.select("queue"), "queue", "left_semi")


def publish_targets(publishes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Matching queues of every publish; where there is none, the queue it creates.

    Adds queue and created (whether the queue is new).
    """
    found = match_bindings(publishes, bindings).withColumn("created", F.lit(False))
    missing = publishes.join(found.select("topic").distinct(), "topic", "left_anti")
    made = missing.withColumns({"queue": t.auto_queue(F.col("topic"))["queue"], "created": F.lit(True)})
    return found.unionByName(made.select(*found.columns))


def fan_out(publishes: DataFrame, subscriptions: DataFrame, order: list[str]) -> DataFrame:
    """Deliveries: publish columns, subscriber, filter, effective qos and retain.

    Plain subscriptions get one row each; a share group one row for each publish, to
    its members in turn. No-local subscriptions skip their own client. ``order`` puts
    the publishes in sequence for the turns.
    """
    share = t.parse_shared(F.col("filter"))
    subs = subscriptions.withColumns({"_shared": share["shared"], "_share": share["share"], "_inner": share["filter"]})
    subs = subs.withColumnRenamed("client_id", "subscriber").withColumnRenamed("qos", "_sub_qos")
    plain = match_filters(publishes, subs.filter("not _shared"), "_inner", guard=False)
    plain = plain.filter(~F.col("no_local") | (F.col("subscriber") != F.col("client_id")))
    members = subs.filter("_shared").groupBy("_share", "_inner", "filter").agg(
        F.sort_array(F.collect_list(F.struct("subscriber", "_sub_qos", "retain_as_published"))).alias("_members")
    )
    turns = match_filters(publishes, members, "_inner", guard=False)
    turns = round_robin(turns, ["_share", "_inner"], order, F.col("_members"), "_to")
    shared = turns.select(
        "*", F.col("_to.subscriber").alias("subscriber"), F.col("_to._sub_qos").alias("_sub_qos"), F.col("_to.retain_as_published").alias("retain_as_published")
    )
    columns = [*publishes.columns, "subscriber", "filter", "_sub_qos", "retain_as_published"]
    out = plain.select(*columns).unionByName(shared.select(*columns))
    return out.withColumns(
        {"qos": F.least("qos", "_sub_qos"), "retain": F.col("retain") & F.col("retain_as_published")}
    ).drop("_sub_qos", "retain_as_published")


def round_robin(rows: DataFrame, key: list[str], order: list[str], members: Column, name: str) -> DataFrame:
    """The i-th row of a key gets member i mod n; ``order`` is a time and what breaks its ties.

    Turns are counted over ranges of time, so one busy key is not one task.
    """
    turned = assign_offsets(rows, key, order[0], order[1:])
    return turned.withColumn(name, F.get(members, F.pmod(F.col("offset"), F.size(members)).cast("int"))).drop("offset")


def take_turns(rows: DataFrame, key: list[str], order: list[str], turns: DataFrame) -> DataFrame:
    """As round_robin for keys of very many members: ``turns`` has key, turn (from 0, without gaps) and the member's columns.

    No row carries a list of members: a row knows its turn, and meets the member by equality.
    """
    n = turns.groupBy(*key).agg(F.count("*").alias("_n"))
    turned = assign_offsets(rows, key, order[0], order[1:]).join(F.broadcast(n), key)
    turned = turned.withColumn("turn", F.pmod("offset", "_n")).drop("offset", "_n")
    return turned.join(turns.withColumn("turn", F.col("turn").cast("bigint")), [*key, "turn"]).drop("turn")


def best_per_client(matched: DataFrame, key: list[str]) -> DataFrame:
    """One subscription for each client: the highest qos, then the first filter."""
    return matched.groupBy(*key).agg(F.max_by(F.struct("filter", "qos"), F.struct("qos", F.col("filter"))).alias("_b")).select(*key, "_b.filter", "_b.qos")


def exchange_targets(publishes: DataFrame, exchanges: DataFrame, bindings: DataFrame) -> DataFrame:
    """Queues bound to a publish's exchange by a key that matches; exchange types join by name."""
    kinds = exchanges.select(F.col("name").alias("exchange"), F.col("type").alias("_type"))
    out = publishes.join(kinds, "exchange", "left").join(bindings, "exchange")
    return out.filter(t.exchange_match(F.col("_type"), F.col("binding_key"), F.col("routing_key"))).drop("_type")


def retained_latest(publishes: DataFrame) -> DataFrame:
    """The last retained payload of each topic; an empty one clears it."""
    last = publishes.filter("retain").groupBy("topic").agg(F.max_by(F.struct("payload", "qos", "seq"), "seq").alias("_r"))
    return last.select("topic", "_r.payload", "_r.qos", "_r.seq").filter(F.octet_length("payload") > 0)


def retained_match(filters: DataFrame, retained: DataFrame) -> DataFrame:
    """Retained messages of each subscription filter."""
    return match_filters(retained, filters, "filter")


def retained_replay(subscribes: DataFrame, retained: DataFrame) -> DataFrame:
    """What a new subscription gets: handling 0 always, 1 if it is new, 2 never; qos is the lesser."""
    due = subscribes.filter((F.col("retain_handling") == 0) | ((F.col("retain_handling") == 1) & F.col("is_new")))
    out = match_filters(retained.withColumnRenamed("qos", "_qos"), due, "filter")
    return out.withColumn("qos", F.least("qos", "_qos")).drop("_qos")


def webhook_targets(events: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Events of each endpoint: its event types (none: all) and, if both have topics, its filters.

    Events meet endpoints by type; endpoints are few and configured by hand.
    """
    types = F.when(F.size("event_types") > 0, F.col("event_types")).otherwise(F.array(F.lit("*")))
    ends = endpoints.withColumn("_type", F.explode(types))
    asked = events.withColumn("_type", F.explode(F.array("event_type", F.lit("*"))))
    both = asked.join(ends, "_type").drop("_type")
    topic_ok = (F.col("topic") == "") | (F.size("topic_filters") == 0) | F.exists("topic_filters", lambda f: t.webhook_match(f, F.col("topic")))
    return both.filter(topic_ok)


def route_to_nodes(matched: DataFrame, owners: DataFrame, own: str) -> DataFrame:
    """Distinct other nodes that own a subscriber of each publish."""
    return matched.join(owners, "subscriber").filter(F.col("node") != own).select("seq", "node").distinct()
