"""Topics, filters and queue addresses as Column expressions.

There are four matchers on purpose; see MATCHERS in the README. All of them are
regular expressions over the topic, built from the filter, so a literal filter is
compiled once and a filter column is compiled as its value changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Address prefixes, control verbs and acknowledgement suffixes.
QUEUE_PREFIX = "$queue/"
SHARE_PREFIX = "$share/"
CONTROL_VERBS = ("$ack", "$nack", "$reject", "$commit")
ACK_SUFFIXES = (("/$ack", "ack"), ("/$nack", "nack"), ("/$reject", "reject"))


def as_col(x: Column | str) -> Column:
    """A string is a literal here; columns are passed as columns."""
    return x if isinstance(x, Column) else F.lit(x)


def _quoted(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def filter_regex(topic_filter: Column | str) -> Column:
    """Anchored pattern of a filter: ``+`` is one level, which may be empty, ``#`` the rest.

    ``a/#`` also stands for ``a``. What follows the first ``#`` level has no effect.
    """
    levels = F.split(as_col(topic_filter), "/", -1)
    hash_at = F.array_position(levels, F.lit("#"))
    kept = F.when(hash_at > 0, F.slice(levels, F.lit(1), F.greatest(hash_at.cast("int") - 1, F.lit(0)))).otherwise(levels)
    body = F.array_join(F.transform(kept, lambda x: F.when(x == "+", F.lit("[^/]*")).otherwise(_quoted(x))), "/")
    tail = F.when(hash_at == 1, F.lit(".*")).when(hash_at > 1, F.lit("(/.*)?")).otherwise(F.lit(""))
    return F.concat(F.lit(r"(?s)\A"), body, tail, F.lit(r"\z"))


def dollar_guarded(topic_filter: Column, topic: Column) -> Column:
    return ~(topic.startswith("$") & ~topic_filter.startswith("$"))


def topic_match(topic_filter: Column | str, topic: Column | str) -> Column:
    """Subscription match with the ``$`` guard; empty filters and topics match nothing."""
    f, t = as_col(topic_filter), as_col(topic)
    return (f != "") & (t != "") & ((f == t) | (dollar_guarded(f, t) & F.regexp_like(t, filter_regex(f))))


def live_match(topic_filter: Column | str, topic: Column | str) -> Column:
    """Live-subscription match: no ``$`` guard."""
    f, t = as_col(topic_filter), as_col(topic)
    return (t != "") & F.regexp_like(t, filter_regex(f))


def webhook_match(topic_filter: Column | str, topic: Column | str) -> Column:
    """Endpoint match: no ``$`` guard; an empty filter matches the empty topic."""
    f, t = as_col(topic_filter), as_col(topic)
    return F.regexp_like(t, filter_regex(f))


def routing_key_match(pattern: Column | str, key: Column | str) -> Column:
    """Consumer filter: ``+`` is a non-empty level, ``#`` anything anywhere; ``a/#`` is not ``a``."""
    p, k = as_col(pattern), as_col(key)
    parts = F.split(p, "(?<=[+#])|(?=[+#])", -1)
    body = F.array_join(
        F.transform(parts, lambda x: F.when(x == "+", F.lit("[^/]+")).when(x == "#", F.lit(".*")).otherwise(_quoted(x))), ""
    )
    wild = F.regexp_like(k, F.concat(F.lit(r"\A"), body, F.lit(r"\z")))
    return F.when((p == "") | (p == "#"), F.lit(True)).when(~p.rlike("[+#]"), p == k).otherwise(wild)


def any_filter_matches(patterns: Column, key: Column | str) -> Column:
    return F.exists(patterns, lambda p: routing_key_match(p, key))


def is_wildcard(pattern: Column | str) -> Column:
    return as_col(pattern).rlike("[+#]")


def is_shared(topic_filter: Column | str) -> Column:
    return as_col(topic_filter).startswith(SHARE_PREFIX)


def parse_shared(topic_filter: Column | str) -> Column:
    """struct(share, filter, shared); without a second level it is no share."""
    f = as_col(topic_filter)
    rest = F.split(F.substring(f, len(SHARE_PREFIX) + 1, 1 << 30), "/", 2)
    shared = is_shared(f) & (F.size(rest) == 2)
    return F.struct(
        F.when(shared, F.get(rest, F.lit(0))).otherwise("").alias("share"),
        F.when(shared, F.get(rest, F.lit(1))).otherwise(f).alias("filter"),
        shared.alias("shared"),
    )


def valid_topic_name(topic: Column | str) -> Column:
    t = as_col(topic)
    return (t != "") & ~t.rlike(r"[+#\x00]") & F.is_valid_utf8(t)


def valid_topic_filter(topic_filter: Column | str) -> Column:
    f = as_col(topic_filter)
    share = parse_shared(f)
    inner = F.when(share["shared"], share["filter"]).otherwise(f)
    levels = F.split(inner, "/", -1)
    whole = F.forall(levels, lambda x: (~x.contains("#") | (x == "#")) & (~x.contains("+") | (x == "+")))
    hash_last = F.coalesce(F.array_position(levels, F.lit("#")) == F.size(levels), F.lit(False)) | (F.array_position(levels, F.lit("#")) == 0)
    share_ok = ~is_shared(f) | (share["shared"] & (share["share"] != "") & ~share["share"].rlike("[+#]") & (share["filter"] != ""))
    return (f != "") & F.is_valid_utf8(f) & ~f.contains("\x00") & share_ok & whole & hash_last


def valid_topic_filters(filters: Column) -> Column:
    return F.forall(filters, valid_topic_filter)


def amqp_filter_to_mqtt(x: Column | str) -> Column:
    return F.translate(as_col(x), ".*", "/+")


def amqp_topic_to_mqtt(x: Column | str) -> Column:
    return F.translate(as_col(x), ".", "/")


def mqtt_topic_to_amqp(x: Column | str) -> Column:
    return F.translate(as_col(x), "/", ".")


def _after_prefix(t: Column) -> Column:
    return F.substring(t, len(QUEUE_PREFIX) + 1, 1 << 30)


def parse_queue_filter(address: Column | str) -> Column:
    """struct(queue, pattern) of ``$queue/{name}[/{pattern}]``; both empty for other addresses."""
    t = as_col(address)
    rest = F.split(_after_prefix(t), "/", 2)
    ok = t.startswith(QUEUE_PREFIX)
    return F.struct(
        F.when(ok, F.get(rest, F.lit(0))).otherwise("").alias("queue"),
        F.when(ok, F.coalesce(F.get(rest, F.lit(1)), F.lit(""))).otherwise("").alias("pattern"),
    )


def parse_queue_subscription(address: Column | str) -> Column:
    """struct(root, pattern): the root is ``$queue/{name}``, empty without anything after the prefix."""
    t = as_col(address)
    parts = parse_queue_filter(t)
    ok = t.startswith(QUEUE_PREFIX) & (_after_prefix(t) != "")
    return F.struct(
        F.when(ok, F.concat(F.lit(QUEUE_PREFIX), parts["queue"])).otherwise("").alias("root"),
        F.when(ok, parts["pattern"]).otherwise("").alias("pattern"),
    )


def queue_root(topic: Column | str) -> Column:
    t = as_col(topic)
    return F.when(t.startswith(QUEUE_PREFIX), F.concat(F.lit(QUEUE_PREFIX), parse_queue_filter(t)["queue"])).otherwise("")


def matches_subscription(topic: Column | str, subscription: Column | str) -> Column:
    pub, sub = parse_queue_subscription(topic), parse_queue_subscription(subscription)
    return (sub["root"] != "") & (sub["root"] == pub["root"]) & routing_key_match(sub["pattern"], pub["pattern"])


def routing_key(topic: Column | str, root: Column | str) -> Column:
    """Levels of the topic after the root's; ``+`` stands for a level, ``#`` leaves the rest; '' without a match."""
    t, r = as_col(topic), as_col(root)
    levels, roots = F.split(t, "/", -1), F.split(r, "/", -1)
    hash_at = F.array_position(roots, F.lit("#")).cast("int")
    fixed = F.when(hash_at > 0, hash_at - 1).otherwise(F.size(roots))
    head = F.slice(roots, F.lit(1), fixed)
    agree = F.forall(F.zip_with(head, F.slice(levels, F.lit(1), fixed), lambda a, b: (a == "+") | (a == b)), lambda x: F.coalesce(x, F.lit(False)))
    ok = (t != "") & (r != "") & (F.size(levels) >= fixed) & agree
    rest = F.slice(levels, fixed + 1, F.greatest(F.size(levels) - fixed, F.lit(0)))
    return F.when(ok, F.array_join(rest, "/")).otherwise("")


def misplaced_control_verb(topic: Column | str) -> Column:
    """The first control verb before the last level, or null."""
    levels = F.split(as_col(topic), "/", -1)
    early = F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0)))
    return F.get(F.filter(early, lambda x: x.isin(*CONTROL_VERBS)), F.lit(0))


def ack_suffix(topic: Column | str) -> Column:
    """struct(kind, base) of an acknowledgement address; kind is null for others."""
    t = as_col(topic)
    kind = base = None
    for suffix, name in ACK_SUFFIXES:
        cut = F.substring(t, F.lit(1), F.char_length(t) - len(suffix))
        kind = F.when(t.endswith(suffix), F.lit(name)) if kind is None else kind.when(t.endswith(suffix), F.lit(name))
        base = F.when(t.endswith(suffix), cut) if base is None else base.when(t.endswith(suffix), cut)
    return F.struct(kind.alias("kind"), base.otherwise(t).alias("base"))


def resolve_route(topic: Column | str) -> Column:
    """struct(kind, queue, pattern, publish_topic, ack_kind, verb).

    kind is pubsub, queue, queue_ack, queue_commit or queue_malformed.
    """
    t = as_col(topic)
    queued, ack, verb = t.startswith(QUEUE_PREFIX), ack_suffix(t), misplaced_control_verb(t)
    kind = (
        F.when(~queued, "pubsub")
        .when(ack["kind"].isNotNull(), "queue_ack")
        .when(verb.isNotNull(), "queue_malformed")
        .when(t.endswith("/$commit"), "queue_commit")
        .otherwise("queue")
    )
    address = parse_queue_filter(F.when(ack["kind"].isNotNull(), ack["base"]).otherwise(t))
    inner = F.regexp_replace(_after_prefix(t), r"/\$commit\z", "")
    plain = kind.isin("queue", "queue_ack")
    return F.struct(
        kind.alias("kind"),
        F.when(plain, address["queue"]).when(kind == "queue_commit", inner).otherwise("").alias("queue"),
        F.when(plain, address["pattern"]).otherwise("").alias("pattern"),
        F.when(kind == "pubsub", F.lit("")).when(kind == "queue_ack", ack["base"]).otherwise(t).alias("publish_topic"),
        F.when(kind == "queue_ack", ack["kind"]).otherwise("").alias("ack_kind"),
        F.when(kind == "queue_malformed", verb).otherwise("").alias("verb"),
    )


def queue_topic(name: Column | str, *parts: Column | str) -> Column:
    whole = [F.when(as_col(p) != "", F.concat(F.lit("/"), as_col(p))).otherwise("") for p in parts]
    return F.concat(F.lit(QUEUE_PREFIX), as_col(name), *whole)


def effective_group(group: Column | str, pattern: Column | str) -> Column:
    return F.when(as_col(pattern) == "", as_col(group)).otherwise(F.concat(as_col(group), F.lit("@"), as_col(pattern)))


def default_group(client_id: Column | str) -> Column:
    return F.substring_index(as_col(client_id), "-", 1)


def parse_message_id(message_id: Column | str) -> Column:
    """The offset after the last colon; null if it is no number."""
    digits = F.substring_index(as_col(message_id), ":", -1)
    return F.when(digits.rlike(r"\A[0-9]+\z"), digits.try_cast("bigint"))


def auto_queue(topic: Column | str) -> Column:
    """struct(queue, pattern) that a publish without any queue creates."""
    t = as_col(topic)
    name = parse_queue_filter(t)["queue"]
    own = t.startswith(QUEUE_PREFIX) & (name != "")
    return F.struct(
        F.when(own, name).otherwise(t).alias("queue"),
        F.when(own, F.concat(F.lit(QUEUE_PREFIX), name, F.lit("/#"))).otherwise(t).alias("pattern"),
    )


def delivery_topic(queue: Column | str, topic: Column | str) -> Column:
    """The address under which a queue's message is delivered."""
    q = F.trim(F.trim(as_col(queue)), F.lit("/"))
    t = F.regexp_replace(F.trim(as_col(topic)), r"\A/", "")
    root = F.concat(F.lit(QUEUE_PREFIX), q)
    return (
        F.when(q == "", t)
        .when((t == "") | (t == q), root)
        .when((t == root) | t.startswith(F.concat(root, F.lit("/"))), t)
        .when(t.startswith(F.concat(q, F.lit("/"))), F.concat(F.lit(QUEUE_PREFIX), t))
        .otherwise(F.concat(root, F.lit("/"), t))
    )


def exchange_match(exchange_type: Column, binding_key: Column, routing_key_: Column) -> Column:
    """Binding match by exchange type; a null type is the default exchange."""
    return F.when(exchange_type == "fanout", F.lit(True)).when(
        exchange_type == "topic", topic_match(binding_key, routing_key_)
    ).otherwise(binding_key == routing_key_)


def consumer_match(queue: Column, pattern: Column, mqtt_filter: Column, topic: Column) -> Column:
    """Whether a consumer takes a topic: by its queue address, then by its topic filter."""
    root = queue_topic(queue)
    at_root = (topic == queue) | (topic == root)
    below = topic.startswith(F.concat(root, F.lit("/")))
    key = F.substring(topic, F.char_length(root) + 2, F.lit(1 << 30))
    by_filter = (mqtt_filter != "") & ((mqtt_filter == topic) | topic_match(mqtt_filter, topic))
    return (
        F.when((queue != "") & at_root, (pattern == "") | (pattern == "#"))
        .when((queue != "") & below, (pattern == "") | topic_match(pattern, key))
        .otherwise(by_filter)
    )


def filter_shape(topic_filter: Column | str) -> Column:
    """The filter with a dot for every level that is no wildcard."""
    return F.array_join(F.transform(F.split(as_col(topic_filter), "/", -1), lambda x: F.when(x.isin("+", "#"), x).otherwise(".")), "/")


def candidate_filters(topic: Column | str, shapes: list[str]) -> Column:
    """The filters of the given shapes that match the topic under topic_match, for an equality join.

    One for each shape that fits at most. ``#`` stands only at the end of a shape.
    """
    t = as_col(topic)
    levels = F.split(t, "/", -1)
    known = [x.split("/") for x in shapes if "#" not in x.split("/")[:-1]]
    if not known:
        return F.array().cast("array<string>")
    fits = lambda s: F.when(F.get(s, F.size(s) - 1) == "#", F.size(s) - 1 <= F.size(levels)).otherwise(F.size(s) == F.size(levels))
    fill = lambda s: F.array_join(F.transform(s, lambda x, i: F.when(x == ".", F.get(levels, i)).otherwise(x)), "/")
    found = F.transform(F.filter(F.array(*[F.array(*[F.lit(x) for x in s]) for s in known]), fits), fill)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.filter(found, lambda f: dollar_guarded(f, t)))
