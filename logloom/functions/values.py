"""Arguments, properties, sizes and delays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .topics import as_col

#: Properties that queue delivery manages.
DELIVERY_PROPERTIES = (
    "message-id",
    "group-id",
    "queue",
    "offset",
    "x-source-topic",
    "x-stream-offset",
    "x-stream-timestamp",
    "x-work-committed-offset",
    "x-work-acked",
    "x-work-group",
    "x-queue-forward-targets",
)
#: Seconds of each unit of a duration.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
#: Bytes counted for a message beside its own fields.
MESSAGE_OVERHEAD = 200


def strip_delivery_properties(props: Column) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(*DELIVERY_PROPERTIES))


def strip_prefixed_properties(props: Column, prefix: str) -> Column:
    """Without the broker's internal properties, whose keys start with ``prefix``."""
    return F.map_filter(props, lambda k, v: ~k.startswith(prefix))


def merge_properties(base: Column, updates: Column) -> Column:
    """Both maps; ``updates`` wins."""
    rest = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    return F.map_concat(rest, updates)


def _stamp(props: Column, stamps: dict[str, Column]) -> Column:
    new = F.create_map(*[x for k, v in stamps.items() for x in (F.lit(k), v.cast("string"))])
    return merge_properties(F.coalesce(props, F.create_map().cast("map<string,string>")), F.map_filter(new, lambda k, v: v.isNotNull()))


def client_property(props: Column, client_id: Column, key: str = "client_id") -> Column:
    return _stamp(props, {key: client_id})


def delivery_properties(props: Column, group: Column, queue: Column, offset: Column, topic: Column) -> Column:
    """The publisher's properties with the message's origin stamped over them."""
    at = offset.cast("string")
    return _stamp(
        props,
        {"message-id": F.concat(queue, F.lit(":"), at), "group-id": group, "queue": queue, "offset": at, "x-source-topic": topic},
    )


def stream_properties(props: Column, offset: Column, created_at: Column, committed: Column, group: Column) -> Column:
    """Stream position and, where a work group has one (``committed`` not null), its progress."""
    return _stamp(
        props,
        {
            "x-stream-offset": offset,
            "x-stream-timestamp": F.unix_millis(created_at),
            "x-work-committed-offset": committed,
            "x-work-acked": F.when(committed.isNotNull(), (offset < committed).cast("string")),
            "x-work-group": F.when(committed.isNotNull() & (group != ""), group),
        },
    )


def publish_properties(user: Column, content_type: Column, response_topic: Column, correlation: Column, payload_format: Column, prefix: str) -> Column:
    """User properties without internal ones, and the standard ones under their names."""
    return _stamp(
        strip_prefixed_properties(user, prefix),
        {
            "content-type": F.when(content_type != "", content_type),
            "response-topic": F.when(response_topic != "", response_topic),
            "correlation-id": F.base64(correlation),
            "payload-format": payload_format,
        },
    )


def dlq_properties(props: Column, queue: Column, topic: Column, group: Column, deliveries: Column, moved_at: Column, message_id: Column) -> Column:
    return _stamp(
        props,
        {
            "_dlq_original_queue": queue,
            "_dlq_original_topic": topic,
            "_dlq_group": group,
            "_dlq_delivery_count": deliveries,
            "_dlq_moved_at": F.date_format(moved_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "_dlq_original_id": F.when(message_id != "", message_id),
        },
    )


def int_argument(x: Column | str) -> Column:
    t = F.trim(as_col(x))
    return F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint"))


def ttl_seconds(x: Column | str) -> Column:
    """Seconds of a TTL argument in milliseconds; null if negative or no number."""
    ms = int_argument(x)
    return F.when(ms >= 0, ms / 1000.0)


def duration_seconds(x: Column | str) -> Column:
    """Seconds of ``1h30m``, ``1.5D``, ``2W``; null for anything else."""
    t = F.trim(as_col(x))
    number = r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+"
    unit = "ns|us|µs|ms|s|m|h"
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    each = F.regexp_extract_all(t, F.lit(f"((?:{number})(?:{unit}))"), F.lit(1))
    scale = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    value = lambda p: F.regexp_extract(p, f"({number})", 1).cast("double") * F.element_at(scale, F.regexp_extract(p, f"({unit})$", 1))
    total = F.aggregate(each, F.lit(0.0), lambda a, p: a + value(p))
    large = F.regexp_extract(F.upper(t), rf"\A([+-]?(?:{number}))[DW]\z", 1).try_cast("double")
    days = F.when(F.upper(t).endswith("W"), 7).otherwise(1)
    return (
        F.when(t == "0", 0.0)
        .when(t.rlike(rf"\A[+-]?(?:(?:{number})(?:{unit}))+\z"), sign * total)
        .when(large.isNotNull(), large * days * 86400.0)
    )


def stream_retention(age: Column, max_bytes: Column, max_messages: Column) -> Column:
    return F.struct(
        duration_seconds(age).alias("max_age_s"), int_argument(max_bytes).alias("max_bytes"), int_argument(max_messages).alias("max_messages")
    )


def unix_timestamp(x: Column | str) -> Column:
    """Milliseconds of a Unix time: above 1e12 it is milliseconds already, else seconds."""
    n = F.when(as_col(x).rlike(r"\A[+-]?[0-9]+\z"), as_col(x).try_cast("bigint"))
    return F.when(n > 10**12, n).otherwise(n * 1000)


def stream_offset(x: Column | str) -> Column:
    """struct(position, offset, timestamp_ms) of first, last, next, offset=, timestamp= or a number; null fields if none."""
    v = F.lower(F.trim(as_col(x)))
    plain = F.regexp_replace(v, r"\Aoffset=", "")
    number = F.when(plain.rlike(r"\A[0-9]+\z"), plain.try_cast("bigint"))
    stamp = F.when(plain.startswith("timestamp="), unix_timestamp(F.substring(plain, 11, 1 << 30)))
    position = (
        F.when(v == "first", "earliest").when(v.isin("last", "next"), "latest").when(stamp.isNotNull(), "timestamp").when(number.isNotNull(), "offset")
    )
    return F.struct(
        position.alias("position"), F.when(position == "offset", number).alias("offset"), F.when(position == "timestamp", stamp).alias("timestamp_ms")
    )


def link_cursor(x: Column | str) -> Column:
    """struct(position, offset) of earliest, latest or leading digits."""
    v = as_col(x)
    digits = F.regexp_extract(v, r"\A\s*\+?([0-9]+)", 1).try_cast("bigint")
    position = F.when(v == "earliest", "earliest").when(v == "latest", "latest").when(digits.isNotNull(), "offset")
    return F.struct(position.alias("position"), F.when(position == "offset", digits).alias("offset"))


def protocol_label(version: Column, client_id: Column, amqp091_prefix: str = "amqp091:", amqp1_prefix: str = "amqp:") -> Column:
    return (
        F.when(version == 3, "mqtt3.1")
        .when(version == 4, "mqtt3.1.1")
        .when(version == 5, "mqtt5")
        .when(client_id.startswith(amqp091_prefix), "amqp0.9.1")
        .when(client_id.startswith(amqp1_prefix), "amqp1.0")
        .otherwise("unknown")
    )


def retry_delay(attempt: Column, initial: float, multiplier: float, most: float) -> Column:
    return F.least(F.lit(float(initial)) * F.pow(F.lit(float(multiplier)), attempt), F.lit(float(most)))


def backoff_bound(attempt: Column, base_ms: int, most_ms: int) -> Column:
    """Upper bound of the jittered delay: the base doubled ``attempt`` times."""
    grown = F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt)
    return (F.least(grown, F.lit(float(most_ms))) if most_ms > 0 else grown).cast("bigint")


def pel_shard(offset: Column, shards: int = 8) -> Column:
    return F.pmod(offset, F.lit(shards)).cast("int")


def fnv1a_32(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda b: F.conv(b, 16, 10).cast("bigint"))
    # offset basis and prime of the 32-bit hash
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)


def consumer_shard(consumer: Column, shards: int) -> Column:
    return (fnv1a_32(consumer) % shards).cast("int")


def message_size(payload: Column, topic: Column, message_id: Column, props: Column) -> Column:
    """Bytes of payload, topic, id and properties, and a fixed overhead."""
    entries = F.coalesce(F.map_entries(props), F.array().cast("array<struct<key:string,value:string>>"))
    own = F.aggregate(entries, F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return (length(payload) + length(topic) + length(message_id) + own + MESSAGE_OVERHEAD).cast("bigint")


def payload_id(payload: Column) -> Column:
    """The part before the first bar; without one, the first 64 characters."""
    t = F.coalesce(payload.cast("string"), F.lit(""))
    bar = F.instr(t, "|")
    return F.when(bar > 1, F.substring_index(t, "|", 1)).otherwise(F.substring(t, 1, 64))


def share_of(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def delivery_ratio(received: Column, expected: Column) -> Column:
    """received / expected; with nothing expected 1 if anything was received, else 0."""
    return F.when(expected > 0, received / expected).when(received > 0, 1.0).otherwise(0.0)
