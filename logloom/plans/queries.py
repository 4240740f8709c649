"""Named queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import topics as t
from ..functions import values as v
from ..operators import admin, consumers, groups, log, routing
from ..session import shared_path
from ..sources import tables as s
from ..streaming import io, state
from .base import AS_OF, ORACLE_SQL, QUERIES, Base, long, micros, query, values

__all__ = ["ORACLE_SQL", "QUERIES"]

# log reads


@query('SELECT queue, "group", mode, n AS depth, cursor, committed, greatest(tail - committed, 0) AS lag FROM groups JOIN limits USING (queue, head, tail)')
def queue_lag(b: Base):
    return groups.lag(b.groups).select("queue", "group", "mode", (F.col("tail") - F.col("head")).alias("depth"), "cursor", "committed", "lag")


@query("SELECT queue, head, tail, tail - head AS n, n AS rows FROM limits")
def head_tail_count(b: Base):
    return b.limits


@query('SELECT queue, "offset", seq, topic, epoch_us(created_at) AS created_at FROM messages')
def assigned_offsets(b: Base):
    return b.messages.select("queue", "offset", "seq", "topic", micros("created_at"))


@query("""SELECT queue, "offset", seq FROM messages WHERE queue = 'clicks' AND "offset" = 42""")
def point_read(b: Base):
    return log.read_one(b.messages, "clicks", 42).select("queue", "offset", "seq")


@query("""SELECT queue, "offset", seq FROM messages WHERE queue = 'all' AND "offset" >= 150 ORDER BY "offset" LIMIT 100""")
def batch_read(b: Base):
    return log.read_batch(b.messages, "all", 150).select("queue", "offset", "seq")


@query("""SELECT queue, "offset", seq FROM messages WHERE queue = 'all' AND "offset" >= 200 AND "offset" < 400 ORDER BY "offset" LIMIT 150""")
def range_read(b: Base):
    return log.read_range(b.messages, "all", 200, 400, 150).select("queue", "offset", "seq")


@query("""SELECT queue, least(greatest(30, head), tail) AS found, least(greatest(30, head), tail) = 30 AS exact FROM limits""")
def seek_offset(b: Base):
    return log.seek_offset(b.limits, F.lit(30)).select("queue", long("found"), "exact")


@query("""SELECT l.queue, coalesce(min(m."offset"), max(l.tail)) AS found, coalesce(arg_min(m.created_at = TIMESTAMP '2024-01-15', m."offset"), false) AS exact
FROM limits l LEFT JOIN messages m ON m.queue = l.queue AND m.created_at >= TIMESTAMP '2024-01-15' GROUP BY l.queue""")
def seek_timestamp(b: Base):
    return log.seek_time(b.messages, b.limits, "2024-01-15 00:00:00")


@query(f'SELECT queue, "offset" FROM messages WHERE expires_at < {AS_OF}')
def expired_messages(b: Base):
    return b.messages.filter(~log.live(F.col("expires_at"), s.AS_OF)).select("queue", "offset")


@query(f"""SELECT "offset", seq FROM messages WHERE queue = 'all' AND "offset" >= 100 AND expires_at >= {AS_OF} AND topic LIKE 'events/click/%' ORDER BY "offset" LIMIT 50""")
def peek_stream(b: Base):
    matches = t.topic_match("events/click/+", F.col("topic"))
    return log.peek_stream(b.messages, "all", 100, 50, s.AS_OF, matches).select("offset", "seq")


@query("""SELECT queue, count(*) AS rows, max("offset") AS last FROM (SELECT queue, "offset" FROM messages UNION ALL
SELECT 'clicks', tail + i FROM limits, (SELECT row_number() OVER (ORDER BY seq) - 1 AS i FROM publishes WHERE topic LIKE 'events/signup/%') WHERE queue = 'clicks') GROUP BY queue""")
def append_batch(b: Base):
    new = b.publishes.filter(F.col("topic").startswith("events/signup/")).select(
        F.lit("clicks").alias("queue"), "seq", "client_id", "topic", "payload", F.col("published_at").alias("created_at")
    )
    return log.append(b.messages, new, ties=("seq",)).groupBy("queue").agg(F.count("*").alias("rows"), F.max("offset").alias("last"))


@query("SELECT count(*) AS kept FROM publishes WHERE strlen(payload) <= 9")
def payload_cap(b: Base):
    return b.publishes.filter(log.fits(F.col("payload"), 9)).agg(F.count("*").alias("kept"))


SIZES = """, sized AS (SELECT *, strlen(payload) + strlen(topic) + 200 AS size FROM messages),
held AS (SELECT queue, "offset", max_bytes, sum(size) OVER (PARTITION BY queue ORDER BY "offset" DESC) AS total FROM sized JOIN queues USING (queue) WHERE max_bytes > 0),
by_size AS (SELECT queue, coalesce(max(CASE WHEN total > max_bytes THEN "offset" + 1 END), min("offset")) AS by_size FROM held GROUP BY queue),
by_time AS (SELECT queue, min("offset") AS t FROM messages JOIN queues USING (queue) WHERE max_age_days > 0 AND created_at >= """ + AS_OF + """ - max_age_days * INTERVAL 1 DAY GROUP BY queue),
kept AS (SELECT queue, head, tail, CASE WHEN max_age_days > 0 THEN coalesce(t, tail) END AS by_time, by_size,
  CASE WHEN max_messages > 0 THEN greatest(head, tail - max_messages) END AS by_count FROM limits JOIN queues USING (queue) LEFT JOIN by_time USING (queue) LEFT JOIN by_size USING (queue)),
retained_from AS (SELECT *, greatest(by_time, by_size, by_count) AS retain_from FROM kept)
"""


def _size():
    none = F.lit(None).cast("map<string,string>")
    return v.message_size(F.col("payload"), F.col("topic"), F.lit(""), none)


def _retention(b: Base):
    policies = s.queues(b.spark).select("queue", "max_age_days", "max_bytes", "max_messages")
    return log.retention_offsets(b.messages, b.limits, policies, _size(), s.AS_OF)


@query(SIZES + "SELECT queue, by_size FROM by_size")
def offset_by_size(b: Base):
    return log.offset_by_size(b.messages, _size(), s.queues(b.spark).select("queue", "max_bytes"))


@query(SIZES + "SELECT queue, by_time, by_size, by_count, retain_from FROM retained_from")
def retention_offset(b: Base):
    return _retention(b).select("queue", long("by_time"), long("by_size"), long("by_count"), long("retain_from"))


@query(SIZES + """, cut AS (SELECT r.queue, least(coalesce(min(g.committed), r.tail), r.retain_from) AS keep_from FROM retained_from r
LEFT JOIN groups g ON g.queue = r.queue AND g.mode = 'queue' GROUP BY r.queue, r.tail, r.retain_from)
SELECT m.queue, count(*) AS rows, min(m."offset") AS head FROM messages m LEFT JOIN cut c USING (queue) WHERE keep_from IS NULL OR m."offset" >= keep_from GROUP BY m.queue""")
def retention_truncate(b: Base):
    cut = log.processed_offsets(_retention(b), b.groups)
    return log.truncate(b.messages, cut).groupBy("queue").agg(F.count("*").alias("rows"), F.min("offset").alias("head"))


SEGMENTS = SIZES + """, segs AS (SELECT queue, "offset" // 500 * 500 AS base, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes, min(created_at) AS first_at, max(created_at) AS last_at FROM sized GROUP BY ALL)
"""


@query(SEGMENTS + "SELECT queue, base, rows, bytes, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at FROM segs")
def segment_info(b: Base):
    return log.segments(b.messages, _size(), 500).select("queue", "base", "rows", "bytes", micros("first_at"), micros("last_at"))


@query(SEGMENTS + """, f AS (SELECT *, min(CAST(last_at <= TIMESTAMP '2024-01-12' AS INT)) OVER (PARTITION BY queue ORDER BY base) AS old, max(base) OVER (PARTITION BY queue) AS last FROM segs)
SELECT queue, base FROM f WHERE old = 1 AND base < last""")
def segment_time_retention(b: Base):
    return log.expired_segments(log.segments(b.messages, _size(), 500), "2024-01-12 00:00:00").select("queue", "base")


@query(SEGMENTS + """, f AS (SELECT *, sum(bytes) OVER (PARTITION BY queue ORDER BY base DESC) AS total, max(base) OVER (PARTITION BY queue) AS last FROM segs)
SELECT queue, base FROM f WHERE total > 300000 AND base < last""")
def segment_size_retention(b: Base):
    return log.oversize_segments(log.segments(b.messages, _size(), 500), 300000).select("queue", "base")


# routing


@query("SELECT queue, count(*) AS n, min(seq) AS first_seq FROM taken GROUP BY queue")
def topic_bindings(b: Base):
    out = routing.match_bindings(b.publishes, s.bindings(b.spark))
    return out.groupBy("queue").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("""SELECT queue, created, count(*) AS n FROM (SELECT p.seq, t.queue, false AS created FROM publishes p JOIN taken t USING (seq) WHERE t.queue IN ('clicks', 'errors')
UNION ALL SELECT seq, topic, true FROM publishes WHERE split_part(topic, '/', 2) NOT IN ('click', 'view', 'error')) GROUP BY ALL""")
def auto_create_targets(b: Base):
    some = s.bindings(b.spark).filter(F.col("queue").isin("clicks", "errors"))
    return routing.publish_targets(b.publishes, some).groupBy("queue", "created").agg(F.count("*").alias("n"))


def _forced(b: Base, publishes: DataFrame) -> DataFrame:
    listed = F.when(F.col("seq") % 2 == 0, "errors, all,nowhere").otherwise("errors,,errors")
    return routing.forced_targets(publishes, listed, s.queues(b.spark)).select("seq", "queue")


@query("""SELECT seq, queue FROM (SELECT DISTINCT seq, unnest(['errors', CASE WHEN seq % 2 = 0 THEN 'all' ELSE 'errors' END]) AS queue FROM publishes)""")
def forced_targets(b: Base):
    return _forced(b, b.publishes)


FAN = """, plain AS (SELECT p.seq, s.client_id AS subscriber, s.filter, least(p.qos, s.qos) AS qos, p.retain AND s.retain_as_published AS retain
  FROM publishes p JOIN subscriptions s ON NOT starts_with(s.filter, '$share/')
  AND regexp_full_match(p.topic, CASE WHEN s.filter = '#' THEN '.*' ELSE replace(replace(s.filter, '+', '[^/]*'), '/#', '(/.*)?') END) AND NOT (s.no_local AND s.client_id = p.client_id)),
turns AS (SELECT *, CAST((row_number() OVER (ORDER BY published_at, seq) - 1) % 3 AS INT) AS turn FROM publishes WHERE topic LIKE 'events/error/%'),
shared AS (SELECT seq, ['u3', 'u4', 'u5'][turn + 1] AS subscriber, '$share/pool/events/error/#' AS filter, least(qos, [1, 2, 0][turn + 1]) AS qos, false AS retain FROM turns),
deliveries AS (SELECT * FROM plain UNION ALL SELECT * FROM shared)
"""


def _fan(b: Base):
    return routing.fan_out(b.publishes, s.subscriptions(b.spark), ["published_at", "seq"])


@query(FAN + "SELECT seq, subscriber, filter, CAST(qos AS BIGINT) AS qos, retain FROM deliveries")
def subscription_fanout(b: Base):
    return _fan(b).select("seq", "subscriber", "filter", long("qos"), "retain")


@query(FAN + "SELECT subscriber, seq FROM shared")
def shared_round_robin(b: Base):
    return _fan(b).filter(t.is_shared(F.col("filter"))).select("subscriber", "seq")


def _effective_qos(b: Base, subscriptions: DataFrame) -> DataFrame:
    subs = subscriptions.select("client_id", "filter", F.col("qos"))
    matched = routing.match_filters(b.publishes.select("seq", "topic"), subs, "filter")
    return routing.best_per_client(matched, ["seq", "client_id"]).select("seq", "client_id", "filter", long("qos"))


@query("""SELECT p.seq, s.client_id, arg_max(s.filter, (s.qos, s.filter)) AS filter, CAST(max(s.qos) AS BIGINT) AS qos FROM publishes p JOIN subscriptions s
ON NOT starts_with(s.filter, '$share/') AND regexp_full_match(p.topic, CASE WHEN s.filter = '#' THEN '.*' ELSE replace(replace(s.filter, '+', '[^/]*'), '/#', '(/.*)?') END) GROUP BY ALL""")
def subscription_effective_qos(b: Base):
    return _effective_qos(b, s.subscriptions(b.spark))


EXCHANGES = [("fan", "fanout"), ("dir", "direct"), ("top", "topic")]
EX_BINDINGS = [("fan", "x", "q_all"), ("dir", "events/click/7", "q_seven"), ("top", "events/+/7", "q_top"), ("top", "events/error/#", "q_err"), ("", "events/view/3", "q_three")]


@query(f""", b AS (SELECT * FROM {values(EX_BINDINGS)} t(exchange, binding_key, queue)), p AS (SELECT seq, topic AS routing_key, ['fan', 'dir', 'top', ''][CAST(seq % 4 AS INT) + 1] AS exchange FROM publishes)
SELECT exchange, queue, count(*) AS n FROM p JOIN b USING (exchange) WHERE exchange = 'fan' OR (exchange = 'top' AND regexp_full_match(routing_key, replace(replace(binding_key, '+', '[^/]*'), '/#', '(/.*)?')))
OR (exchange IN ('dir', '') AND routing_key = binding_key) GROUP BY ALL""")
def exchange_routing(b: Base):
    names = F.array(*[F.lit(x) for x in ("fan", "dir", "top", "")])
    pubs = b.publishes.select("seq", F.col("topic").alias("routing_key"), F.get(names, (F.col("seq") % 4).cast("int")).alias("exchange"))
    kinds = b.spark.createDataFrame(EXCHANGES, "name string, type string")
    bound = b.spark.createDataFrame(EX_BINDINGS, "exchange string, binding_key string, queue string")
    return routing.exchange_targets(pubs, kinds, bound).groupBy("exchange", "queue").agg(F.count("*").alias("n"))


RETAINED = """, last AS (SELECT topic, arg_max(CASE WHEN seq % 20 = 0 THEN '' ELSE payload END, seq) AS payload, arg_max(qos, seq) AS qos, max(seq) AS seq FROM publishes WHERE retain GROUP BY topic),
retained AS (SELECT * FROM last WHERE payload <> '')
"""


def _retained(b: Base):
    return routing.retained_latest(b.publishes.withColumn("payload", F.when(F.col("seq") % 20 == 0, "").otherwise(F.col("payload"))))


@query(RETAINED + "SELECT topic, payload, seq FROM retained")
def retained_latest(b: Base):
    return _retained(b).select("topic", "payload", "seq")


@query(RETAINED + "SELECT f.filter, r.topic, r.seq FROM (SELECT DISTINCT filter FROM subscriptions WHERE NOT starts_with(filter, '$share/')) f JOIN retained r "
       "ON regexp_full_match(r.topic, CASE WHEN f.filter = '#' THEN '.*' ELSE replace(replace(f.filter, '+', '[^/]*'), '/#', '(/.*)?') END)")
def retained_match(b: Base):
    filters = s.subscriptions(b.spark).filter(~t.is_shared(F.col("filter"))).select("filter").distinct()
    return routing.retained_match(filters, _retained(b)).select("filter", "topic", "seq")


@query(RETAINED + "SELECT f.client_id, f.filter, r.topic, CAST(least(r.qos, f.qos) AS BIGINT) AS qos FROM subscriptions f JOIN retained r ON NOT starts_with(f.filter, '$share/') AND f.retain_handling < 2 "
       "AND regexp_full_match(r.topic, CASE WHEN f.filter = '#' THEN '.*' ELSE replace(replace(f.filter, '+', '[^/]*'), '/#', '(/.*)?') END)")
def retained_replay(b: Base):
    subs = s.subscriptions(b.spark).filter(~t.is_shared(F.col("filter"))).withColumn("is_new", F.lit(True))
    return routing.retained_replay(subs, _retained(b)).select("client_id", "filter", "topic", long("qos"))


ENDPOINTS = [("every", [], []), ("clicks", ["click"], ["events/click/#"]), ("sevens", ["click", "view"], ["events/+/7"]), ("none", ["missing"], [])]


@query("""SELECT endpoint, count(*) AS n FROM (SELECT 'every' AS endpoint FROM events UNION ALL SELECT 'clicks' FROM events WHERE event_type = 'click'
UNION ALL SELECT 'sevens' FROM events WHERE event_type IN ('click', 'view') AND user_id = 7) GROUP BY endpoint""")
def webhook_match(b: Base):
    ends = b.spark.createDataFrame(ENDPOINTS, "endpoint string, event_types array<string>, topic_filters array<string>")
    events = b.publishes.select("seq", F.element_at(F.split("topic", "/"), 2).alias("event_type"), "topic")
    return routing.webhook_targets(events, ends).groupBy("endpoint").agg(F.count("*").alias("n"))


@query(FAN + "SELECT DISTINCT seq, 'n' || (CAST(substr(subscriber, 2) AS INT) % 3) AS node FROM deliveries WHERE CAST(substr(subscriber, 2) AS INT) % 3 <> 0")
def cluster_nodes(b: Base):
    owners = s.subscriptions(b.spark).select(F.col("client_id").alias("subscriber")).distinct()
    owners = owners.withColumn("node", F.concat(F.lit("n"), (F.substring("subscriber", 2, 9).cast("int") % 3).cast("string")))
    return routing.route_to_nodes(_fan(b), owners, "n0")


# addresses and arguments

@query(""", k AS (SELECT topic, CASE WHEN NOT starts_with(topic, '$queue/') THEN 'pubsub' WHEN regexp_matches(topic, '/\\$(ack|nack|reject)$') THEN 'queue_ack'
 WHEN regexp_matches(topic, '(^|/)\\$(ack|nack|reject|commit)/') THEN 'queue_malformed' WHEN ends_with(topic, '/$commit') THEN 'queue_commit' ELSE 'queue' END AS kind,
 regexp_replace(topic, '/\\$(ack|nack|reject)$', '') AS base FROM addresses)
SELECT topic, kind, CASE WHEN kind IN ('queue', 'queue_ack') THEN split_part(substr(base, 8), '/', 1) WHEN kind = 'queue_commit' THEN substr(regexp_replace(topic, '/\\$commit$', ''), 8) ELSE '' END AS queue,
 CASE WHEN kind IN ('queue', 'queue_ack') AND contains(substr(base, 8), '/') THEN substr(base, 9 + length(split_part(substr(base, 8), '/', 1))) ELSE '' END AS pattern,
 CASE WHEN kind = 'queue_ack' THEN regexp_extract(topic, '\\$(ack|nack|reject)$', 1) ELSE '' END AS ack_kind FROM k""")
def route_resolve(b: Base):
    r = t.resolve_route(F.col("topic"))
    return b.addresses.select("topic", r["kind"].alias("kind"), r["queue"].alias("queue"), r["pattern"].alias("pattern"), r["ack_kind"].alias("ack_kind"))


@query("SELECT DISTINCT topic, substr(topic, 8) AS key FROM publishes")
def routing_key(b: Base):
    return b.publishes.select("topic").distinct().select("topic", t.routing_key(F.col("topic"), "events").alias("key"))


@query("""SELECT topic, CASE WHEN topic IN ('click', '$queue/click') THEN '$queue/click' WHEN starts_with(topic, '$queue/click/') THEN topic
WHEN starts_with(topic, 'click/') THEN '$queue/' || topic ELSE '$queue/click/' || topic END AS address FROM addresses""")
def delivery_topic(b: Base):
    return b.addresses.select("topic", t.delivery_topic(" /click/", F.col("topic")).alias("address"))


@query("""SELECT topic, topic <> '' AND NOT regexp_matches(topic, '[+#]') AS is_name,
 NOT regexp_matches(f, '[^/]#|#[^$]|[^/]\\+|\\+[^/]') AND NOT (starts_with(topic, '$share/') AND NOT regexp_matches(topic, '^\\$share/[^/]+/.+')) AS is_filter
FROM (SELECT topic, CASE WHEN regexp_matches(topic, '^\\$share/[^/]*/') THEN regexp_replace(topic, '^\\$share/[^/]*/', '') ELSE topic END AS f FROM addresses)""")
def topic_validation(b: Base):
    return b.addresses.select("topic", t.valid_topic_name(F.col("topic")).alias("is_name"), t.valid_topic_filter(F.col("topic")).alias("is_filter"))


@query("SELECT DISTINCT topic, replace(topic, '/', '.') AS amqp, replace(replace(replace(topic, '/', '.'), '.', '/'), '*', '+') AS back FROM publishes")
def topic_translation(b: Base):
    rows = b.publishes.select("topic").distinct().withColumn("amqp", t.mqtt_topic_to_amqp(F.col("topic")))
    return rows.withColumn("back", t.amqp_filter_to_mqtt(F.col("amqp")))


ARGUMENTS = """, arguments AS (SELECT DISTINCT CASE seq % 10 WHEN 0 THEN 'first' WHEN 1 THEN ' Last ' WHEN 2 THEN 'next' WHEN 3 THEN 'offset=' || seq WHEN 4 THEN CAST(seq AS VARCHAR) WHEN 5 THEN 'timestamp=' || (1700000000 + seq)
WHEN 6 THEN 'timestamp=' || (1700000000000 + seq) WHEN 7 THEN 'offset=x' || seq WHEN 8 THEN '' ELSE '-' || seq END AS arg FROM publishes)
"""


def _arguments(b: Base) -> DataFrame:
    n = F.col("seq").cast("string")
    plus = lambda k: (F.col("seq") + k).cast("string")
    c, x = F.concat, F.lit
    forms = [x("first"), x(" Last "), x("next"), c(x("offset="), n), n, c(x("timestamp="), plus(1700000000)), c(x("timestamp="), plus(1700000000000)), c(x("offset=x"), n), x(""), c(x("-"), n)]
    return b.publishes.select(F.get(F.array(*forms), (F.col("seq") % 10).cast("int")).alias("arg")).distinct()


@query(ARGUMENTS + """SELECT arg, CASE WHEN x = 'first' THEN 'earliest' WHEN x IN ('last', 'next') THEN 'latest' WHEN regexp_matches(x, '^timestamp=[0-9]+$') THEN 'timestamp' WHEN regexp_matches(x, '^(offset=)?[0-9]+$') THEN 'offset' END AS position,
CASE WHEN regexp_matches(x, '^(offset=)?[0-9]+$') THEN CAST(regexp_extract(x, '[0-9]+$') AS BIGINT) END AS "offset",
CASE WHEN regexp_matches(x, '^timestamp=[0-9]+$') THEN CASE WHEN CAST(substr(x, 11) AS BIGINT) > 1000000000000 THEN CAST(substr(x, 11) AS BIGINT) ELSE CAST(substr(x, 11) AS BIGINT) * 1000 END END AS timestamp_ms
FROM (SELECT arg, lower(trim(arg)) AS x FROM arguments)""")
def stream_offset_argument(b: Base):
    r = v.stream_offset(F.col("arg"))
    return _arguments(b).select("arg", r["position"].alias("position"), r["offset"].alias("offset"), r["timestamp_ms"].alias("timestamp_ms"))


DURATIONS = """, durations AS (SELECT DISTINCT CASE seq % 9 WHEN 0 THEN u || 'h' || (seq % 60) || 'm' WHEN 1 THEN u || '.5D' WHEN 2 THEN u || 'w' WHEN 3 THEN seq || 'ms' WHEN 4 THEN u || 's' WHEN 5 THEN '0' WHEN 6 THEN '-' || u || 'm' WHEN 7 THEN u || 'x'
ELSE u END AS arg FROM (SELECT seq, substr(client_id, 2) AS u FROM publishes))
"""


def _durations(b: Base) -> DataFrame:
    u, n = F.substring("client_id", 2, 20), F.col("seq").cast("string")
    c, x = F.concat, F.lit
    forms = [c(u, x("h"), (F.col("seq") % 60).cast("string"), x("m")), c(u, x(".5D")), c(u, x("w")), c(n, x("ms")), c(u, x("s")), x("0"), c(x("-"), u, x("m")), c(u, x("x")), u]
    return b.publishes.select(F.get(F.array(*forms), (F.col("seq") % 9).cast("int")).alias("arg")).distinct()


@query(DURATIONS + """SELECT arg, CASE WHEN arg = '0' THEN 0 WHEN regexp_full_match(arg, '[0-9]+h[0-9]+m') THEN CAST(split_part(arg, 'h', 1) AS DOUBLE) * 3600 + CAST(split_part(rtrim(arg, 'm'), 'h', 2) AS DOUBLE) * 60
WHEN ends_with(arg, 'D') THEN CAST(rtrim(arg, 'D') AS DOUBLE) * 86400 WHEN ends_with(arg, 'w') THEN CAST(rtrim(arg, 'w') AS DOUBLE) * 7 * 86400 WHEN ends_with(arg, 'ms') THEN CAST(rtrim(arg, 'ms') AS DOUBLE) * 0.001::DOUBLE
WHEN ends_with(arg, 's') THEN CAST(rtrim(arg, 's') AS DOUBLE) WHEN starts_with(arg, '-') THEN CAST(rtrim(arg, 'm') AS DOUBLE) * 60 END AS seconds FROM durations""")
def duration_argument(b: Base):
    return _durations(b).select("arg", v.duration_seconds(F.col("arg")).alias("seconds"))


def _stamped_delivery(rows: DataFrame) -> DataFrame:
    p = v.delivery_properties(F.create_map(F.lit("message-id"), F.lit("forged")), F.lit("g"), F.col("queue"), F.col("offset"), F.col("topic"))
    rows = rows.select("queue", "offset", p.alias("p"))
    at = lambda k: F.element_at("p", k)
    return rows.select("queue", "offset", at("message-id").alias("message_id"), at("offset").alias("at"), at("x-source-topic").alias("source"), t.parse_message_id(at("message-id")).alias("parsed"))


@query("""SELECT queue, "offset", queue || ':' || "offset" AS message_id, CAST("offset" AS VARCHAR) AS at, topic AS source, "offset" AS parsed FROM messages""")
def delivery_properties(b: Base):
    return _stamped_delivery(b.messages)


def _decorated(b: Base, rows: DataFrame) -> DataFrame:
    progress = groups.primary_progress(b.groups, "workers").select("queue", "group_id", "work_committed")
    rows = rows.join(progress, "queue")
    none = F.lit(None).cast("map<string,string>")
    p = v.stream_properties(none, F.col("offset"), F.col("created_at"), F.col("work_committed"), F.lit("workers"))
    return rows.select("queue", "group_id", "offset", p["x-stream-timestamp"].alias("stamp"), p["x-work-committed-offset"].alias("work_committed"), p["x-work-acked"].alias("acked"))


@query("""SELECT m.queue, a.group_id, m."offset", CAST(epoch_us(m.created_at) // 1000 AS VARCHAR) AS stamp, CAST(g.committed AS VARCHAR) AS work_committed,
CASE WHEN m."offset" < g.committed THEN 'true' WHEN m."offset" >= g.committed THEN 'false' END AS acked
FROM messages m JOIN groups a ON a.queue = m.queue AND a.mode = 'stream' LEFT JOIN groups g ON g.queue = a.queue AND g.pattern = a.pattern AND g.mode = 'queue' AND g.group_id = 'workers'""")
def stream_decorate(b: Base):
    return _decorated(b, b.messages)


@query("""SELECT DISTINCT client_id, CASE version WHEN 3 THEN 'mqtt3.1' WHEN 4 THEN 'mqtt3.1.1' WHEN 5 THEN 'mqtt5' ELSE 'unknown' END AS label FROM sessions""")
def protocol_labels(b: Base):
    return s.sessions(b.spark, b.dir).select("client_id", v.protocol_label(F.col("version"), F.col("client_id")).alias("label"))


@query("SELECT client_id, packet_id, least(100.0::DOUBLE * pow(2.5::DOUBLE, retries), 5000.0::DOUBLE) AS delay, CAST(least(50 * (1 << retries), 200) AS BIGINT) AS bound FROM inflight")
def retry_delays(b: Base):
    attempt = F.col("retries")
    return s.inflight(b.spark, b.dir).select("client_id", long("packet_id"), v.retry_delay(attempt, 100, 2.5, 5000).alias("delay"), v.backoff_bound(attempt, 50, 200).alias("bound"))


# groups


@query('SELECT queue, "group", consumer, count(*) AS n FROM pending GROUP BY ALL')
def pending_by_consumer(b: Base):
    return groups.pending_by_consumer(b.pending)


@query('SELECT queue, "group", CAST("offset" % 8 AS BIGINT) AS shard, count(*) AS n FROM pending GROUP BY ALL')
def pending_by_shard(b: Base):
    return groups.pending_by_shard(b.pending).select("queue", "group", long("shard"), "n")


@query('SELECT queue, "group", count(*) AS n_pending, min("offset") AS min_pending FROM pending GROUP BY ALL')
def pending_summary(b: Base):
    return groups.pending_summary(b.pending)


@query("SELECT l.queue, coalesce(min(g.committed), l.tail) AS committed FROM limits l LEFT JOIN groups g ON g.queue = l.queue AND g.mode = 'queue' GROUP BY l.queue, l.tail")
def min_committed(b: Base):
    return groups.min_committed(b.groups, b.limits, "queue")


@query("""SELECT g.queue, g."group", CASE WHEN count(p."offset") = 0 THEN g.cursor ELSE greatest(g.committed, min(p."offset")) END AS advanced
FROM groups g LEFT JOIN pending p ON p.queue = g.queue AND p."group" = g."group" GROUP BY g.queue, g."group", g.cursor, g.committed""")
def advance_committed(b: Base):
    return groups.advance_committed(b.groups, b.pending).select("queue", "group", "advanced")


@query("""SELECT g.queue, g."group", greatest(g.committed, least(g.cursor, coalesce(min(p."offset"), g.cursor)) - 1) AS ack_floor
FROM groups g LEFT JOIN pending p ON p.queue = g.queue AND p."group" = g."group" AND p."offset" > g.committed GROUP BY g.queue, g."group", g.cursor, g.committed""")
def ack_floor(b: Base):
    return groups.ack_floor(b.groups.withColumn("floor", F.col("committed")), b.pending).select("queue", "group", "ack_floor")


@query(f"""SELECT queue, "group", "offset", consumer FROM pending WHERE consumer <> 'c1' AND claimed_at < {AS_OF} - INTERVAL 10 DAY""")
def stealable(b: Base):
    return groups.stealable(b.pending, "c1", s.AS_OF, 864000).select("queue", "group", "offset", "consumer")


@query(f"""SELECT p.queue, p."group", CASE WHEN p.deliveries >= 5 THEN 'dead_letter' WHEN m.expires_at < {AS_OF} THEN 'expired' ELSE 'redeliver' END AS outcome, count(*) AS n
FROM pending p JOIN messages m USING (queue, "offset") WHERE p.consumer <> 'c1' AND p.claimed_at < {AS_OF} - INTERVAL 1 DAY GROUP BY ALL""")
def steal_outcome(b: Base):
    rows = groups.stealable(b.pending, "c1", s.AS_OF, 86400)
    return groups.steal_outcome(rows, b.messages, s.AS_OF).groupBy("queue", "group", "outcome").agg(F.count("*").alias("n"))


@query("""SELECT p.queue, p."offset", CASE WHEN q.dlq_topic = '' THEN '$dlq/' || p.queue ELSE q.dlq_topic END AS dlq_queue, CAST(p.deliveries AS VARCHAR) AS deliveries, m.topic AS original
FROM pending p JOIN queues q USING (queue) JOIN messages m USING (queue, "offset") WHERE q.dlq AND p.deliveries >= 5""")
def dead_letter(b: Base):
    out = groups.dead_letters(b.pending, b.messages, s.queues(b.spark), s.AS_OF)
    return out.select("queue", "offset", "dlq_queue", F.col("properties")["_dlq_delivery_count"].alias("deliveries"), F.col("properties")["_dlq_original_topic"].alias("original"))


@query(f"""SELECT queue, "group", CAST(shard AS BIGINT) AS shard, array_to_string(list_sort(list("offset")), ',') AS offsets FROM (SELECT *, "offset" % 8 AS shard,
 row_number() OVER (PARTITION BY queue, "group", "offset" % 8 ORDER BY "offset") AS i FROM pending WHERE claimed_at < {AS_OF} - INTERVAL 5 DAY) WHERE i <= 3 GROUP BY ALL""")
def redelivery_batches(b: Base):
    rows = groups.redelivery(b.pending, s.AS_OF, 5 * 86400, 3)
    return groups.redelivery_batches(rows).select("queue", "group", long("shard"), F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"))


@query("""SELECT node, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS shards FROM (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT node FROM members)), range(64) t(i) WHERE i % n = k GROUP BY node""")
def shard_assignment(b: Base):
    return groups.shard_assignments(consumers.members(b.consumer_ops), 64).select("node", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


@query("""SELECT queue, CASE position WHEN 'earliest' THEN head WHEN 'latest' THEN tail WHEN 'offset' THEN least(greatest(9999999, head), tail) ELSE head END AS start, position FROM limits, (VALUES ('earliest'), ('latest'), ('offset'), ('default')) t(position)""")
def subscribe_cursor(b: Base):
    rows = b.limits.withColumn("position", F.explode(F.array(*[F.lit(x) for x in ("earliest", "latest", "offset", "default")])))
    start = groups.cursor_start(F.col("position"), F.lit(9999999), F.lit(None).cast("bigint"), F.col("head"), F.col("tail"), F.col("head"))
    return rows.select("queue", "position", start.alias("start"))


OPS = """, o AS (SELECT *, "offset" % 2 = 0 AS nack, "offset" % 3 = 0 AS claim FROM pending WHERE "offset" % 5 <> 0)
"""


@query(OPS + """SELECT queue, "group", "offset", CASE WHEN claim THEN 'thief' ELSE consumer END AS consumer, 1 + CAST(nack AS INT) + CAST(claim AS INT) AS deliveries,
epoch_ms(claimed_at) + CASE WHEN claim THEN 2 WHEN nack THEN 1 ELSE 0 END AS last_attempt FROM o""")
def oplog_replay(b: Base):
    out = state.replay(s.group_ops(b.pending))
    return out.select("queue", "group", "offset", "consumer", long("deliveries"), "last_attempt")


@query('SELECT queue, "group", count(*) AS delivered, max("offset") + 1 AS cursor FROM pending GROUP BY ALL')
def oplog_cursor(b: Base):
    return state.replay_cursor(s.group_ops(b.pending))


@query("""SELECT queue, count(*) AS attempts, count(*) FILTER (deliveries < 5) AS successes, count(*) FILTER (deliveries < 5) / count(*) AS rate,
CASE WHEN count(*) FILTER (deliveries < 5) = 0 THEN 0 ELSE CAST(sum("offset") FILTER (deliveries < 5) AS BIGINT) // count(*) FILTER (deliveries < 5) END AS mean_latency_ms FROM pending GROUP BY queue""")
def consumer_metrics(b: Base):
    return groups.consumer_metrics(b.pending.select("queue", (F.col("deliveries") < 5).alias("ok"), F.col("offset").alias("latency_ms")))


# listings and housekeeping


@query("SELECT client_id, connected, CASE WHEN count(*) OVER () > 25 THEN 'c' || '00000124' ELSE '' END AS next_token FROM (SELECT client_id, connected FROM sessions WHERE starts_with(client_id, 'c000') AND client_id > 'c00000099' ORDER BY client_id LIMIT 26) ORDER BY client_id LIMIT 25")
def list_sessions_page(b: Base):
    return admin.page(s.sessions(b.spark, b.dir).select("client_id", "connected"), "client_id", 25, "c000", "c00000099")


@query("SELECT client_id, CASE WHEN connected IS NULL THEN true ELSE connected OR CAST(substr(client_id, 2) AS INT) % 7 = 0 END AS connected FROM sessions")
def session_merge(b: Base):
    stored = s.sessions(b.spark, b.dir).select("client_id", "connected")
    live = stored.filter(F.substring("client_id", 2, 9).cast("int") % 7 == 0).withColumn("connected", F.lit(True))
    return admin.merge_live(stored, live)


@query("""SELECT s.client_id, coalesce(i.n, 0) AS n_inflight, w.client_id IS NOT NULL AS has_will FROM sessions s LEFT JOIN (SELECT client_id, count(*) AS n FROM inflight GROUP BY 1) i USING (client_id)
LEFT JOIN (SELECT client_id FROM sessions WHERE version = 5) w USING (client_id)""")
def session_snapshot(b: Base):
    own = s.sessions(b.spark, b.dir)
    none = s.subscriptions(b.spark).select("client_id")
    out = admin.session_snapshot(own, none, s.inflight(b.spark, b.dir), none, own.filter("version = 5"))
    return out.select("client_id", "n_inflight", "has_will")


@query(f"SELECT client_id FROM sessions WHERE NOT connected AND expiry_s > 0 AND epoch({AS_OF}) - epoch(disconnected_at) > expiry_s")
def expired_sessions(b: Base):
    return admin.expired_sessions(s.sessions(b.spark, b.dir), s.AS_OF).select("client_id")


@query(f"SELECT client_id FROM sessions WHERE NOT connected AND disconnected_at + INTERVAL 36 HOUR <= {AS_OF}")
def pending_wills(b: Base):
    own = s.sessions(b.spark, b.dir)
    return admin.triggered_wills(own.withColumn("delay_s", F.lit(36 * 3600)), own, s.AS_OF).select("client_id")


@query("SELECT client_id, packet_id FROM inflight WHERE direction = 'out' AND (sent_age_ms > 30000 OR (sent_age_ms IS NULL AND attempted_age_ms >= 500))")
def inflight_retry(b: Base):
    return admin.inflight_retries(s.inflight(b.spark, b.dir), 30000).select("client_id", long("packet_id"))


@query(f"""SELECT consumer, count(*) AS n FROM pending WHERE claimed_at < {AS_OF} - INTERVAL 12 DAY GROUP BY consumer""")
def stale_consumers(b: Base):
    return admin.stale(b.pending, "claimed_at", s.AS_OF, 12 * 86400).groupBy("consumer").agg(F.count("*").alias("n"))


@query("SELECT client_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC) AS i FROM publishes) WHERE i <= 5")
def offline_queue_evict(b: Base):
    return admin.bounded_queue(b.publishes, "client_id", ["seq"], 5).select("client_id", "seq")


@query("SELECT client_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq) AS i FROM publishes) WHERE i <= 5")
def offline_queue_reject(b: Base):
    return admin.bounded_queue(b.publishes, "client_id", ["seq"], 5, evict_oldest=False).select("client_id", "seq")


@query(FAN + f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p.published_at + INTERVAL 7 DAY < {AS_OF} THEN 'drop_expired' WHEN subscriber IN ('u1', 'u2') THEN 'send' WHEN d.qos = 0 THEN 'drop_offline' ELSE 'queue' END AS kind
FROM deliveries d JOIN publishes p USING (seq)) GROUP BY kind""")
def session_delivery(b: Base):
    old = F.expr(f"published_at + interval 7 days < timestamp'{s.AS_OF}'")
    kind = admin.delivery_kind(old, F.col("subscriber").isin("u1", "u2"), F.col("qos"))
    return _fan(b).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT seq, topic, last_value(CASE WHEN seq % 3 = 0 THEN topic END IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY seq) AS resolved FROM publishes""")
def topic_alias(b: Base):
    own = F.when(F.col("seq") % 3 == 0, F.col("topic")).otherwise("")
    rows = b.publishes.select(F.col("client_id").alias("connection"), F.lit(1).alias("alias"), "seq", F.col("topic").alias("full"), own.alias("topic"))
    return admin.alias_topics(rows).select("seq", F.col("full").alias("topic"), "resolved")


@query("SELECT CASE WHEN grouping(version) = 1 THEN 'total' ELSE CAST(version AS VARCHAR) END AS protocol, count(*) AS sessions, count(*) FILTER (connected) AS connected FROM sessions GROUP BY ROLLUP (version)")
def stats_rollup(b: Base):
    out = admin.stats_by(s.sessions(b.spark, b.dir), "version", [F.count("*").alias("sessions"), F.count_if("connected").alias("connected")])
    return out.select(F.coalesce(F.col("version").cast("string"), F.lit("total")).alias("protocol"), "sessions", "connected")


@query("SELECT client_id, min(seq) AS seq FROM publishes GROUP BY client_id")
def qos2_dedup(b: Base):
    return admin.first_packets(b.publishes.select("client_id", "seq", "topic"), ["client_id"]).select("client_id", "seq")


@query("""SELECT filter, count(*) AS n FROM (SELECT DISTINCT topic FROM publishes) p JOIN (SELECT DISTINCT filter FROM subscriptions WHERE NOT starts_with(filter, '$share/')) f
ON regexp_full_match(p.topic, CASE WHEN f.filter = '#' THEN '.*' ELSE replace(replace(f.filter, '+', '[^/]*'), '/#', '(/.*)?') END) GROUP BY filter""")
def topic_match_counts(b: Base):
    filters = s.subscriptions(b.spark).filter(~t.is_shared(F.col("filter"))).select("filter").distinct()
    out = routing.match_filters(b.publishes.select("topic").distinct(), filters, "filter", guard=False)
    return out.groupBy("filter").agg(F.count("*").alias("n"))


# the rest of the catalogue, hooks and merges


@query("SELECT seq, CASE WHEN seq % 2 = 0 THEN topic || '/seen' ELSE topic END AS topic FROM publishes WHERE qos < 2")
def hook_rewrite(b: Base):
    def decide(pdf):
        pdf["allowed"] = pdf["qos"] < 2
        pdf.loc[pdf["seq"] % 2 == 0, "topic"] += "/seen"
        return pdf

    return admin.apply_hooks(b.publishes.select("seq", "topic", "qos"), decide).select("seq", "topic")


GRANTS = [("u1", "x", "events/click/", True), ("u2", "x", "events/view/2", False), ("u3", "y", "events/", True)]


@query("SELECT seq FROM publishes WHERE (client_id = 'u1' AND starts_with(topic, 'events/click/')) OR (client_id = 'u2' AND topic = 'events/view/2')")
def publish_grants(b: Base):
    grants = b.spark.createDataFrame(GRANTS, "client_id string, exchange string, routing_key string, prefix boolean")
    rows = b.publishes.select("seq", "client_id", F.lit("x").alias("exchange"), F.col("topic").alias("routing_key"))
    return admin.authorized(rows, grants).select("seq")


CONSUMERS = [("c1", "click", "", "", "n1"), ("c2", "view", "x/+", "", "n2"), ("c3", "", "", "events/+/7", "n1"), ("c4", "", "", "", "n3")]


@query(f"""SELECT consumer, topic FROM {values(CONSUMERS)} c(consumer, queue, pattern, filter, node), addresses
WHERE (queue = 'click' AND (topic IN ('click', '$queue/click') OR starts_with(topic, '$queue/click/'))) OR (queue = 'view' AND regexp_full_match(topic, '\\$queue/view/x/[^/]*')) OR (filter = 'events/+/7' AND regexp_full_match(topic, 'events/[^/]*/7'))""")
def amqp_consumer_match(b: Base):
    # the consumers of one connection travel as an array
    some = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("consumer", "queue", "pattern", "filter"), strict=False)]) for c in CONSUMERS])
    rows = b.addresses.select("topic", F.explode(some).alias("c"))
    return rows.filter(t.consumer_match(F.col("c.queue"), F.col("c.pattern"), F.col("c.filter"), F.col("topic"))).select("c.consumer", "topic")


@query("""SELECT g.queue, g."group", CASE WHEN g.mode = 'stream' AND g.auto_commit THEN greatest(g.committed, 1000) ELSE g.committed END AS advanced FROM groups g""")
def stream_acks(b: Base):
    acks = b.groups.select("queue", groups.group_name().alias("group"), F.explode(F.array(F.lit(3), F.lit(999))).alias("offset"))
    return groups.seen_offsets(acks, b.groups).select("queue", "group", "advanced")


@query("""SELECT queue, "group", mode = 'stream' AND cursor >= 10 AS accepted, CASE WHEN mode = 'stream' AND cursor >= 10 THEN 10 ELSE committed END AS advanced FROM groups""")
def commit_offsets(b: Base):
    commits = b.groups.select("queue", groups.group_name().alias("group"), F.lit(10).alias("offset"))
    return groups.commit_offsets(b.groups, commits).select("queue", "group", "accepted", long("advanced"))


@query("""SELECT queue, "group", "offset", max(deliveries) OVER (PARTITION BY queue, "group" ORDER BY "offset") AS high_water FROM pending""")
def pel_high_water(b: Base):
    rows = b.pending.select("queue", "group", F.col("offset").alias("seq"), F.col("deliveries").alias("pel_size"))
    return groups.high_water(rows).select("queue", "group", F.col("seq").alias("offset"), long("high_water"))


@query("""SELECT g.queue, g."group" AS stream_group, w.committed AS work_committed FROM groups g LEFT JOIN groups w ON w.queue = g.queue AND w.pattern = g.pattern AND w.group_id = 'workers' AND w.mode = 'queue' WHERE g.mode = 'stream'""")
def primary_group_progress(b: Base):
    return groups.primary_progress(b.groups, "workers").select("queue", groups.group_name().alias("stream_group"), "work_committed")


@query("""SELECT seq, message_id, state, k FROM (SELECT seq, 'm' || seq AS message_id, 'queued' AS state, CAST(qos AS VARCHAR) AS k FROM publishes)""")
def log_decode(b: Base):
    text = lambda c: F.encode(c, "UTF-8")
    headers = F.create_map(F.lit("_id"), text(F.concat(F.lit("m"), F.col("seq").cast("string"))), F.lit("topic"), text(F.col("topic")), F.lit("k"), text(F.col("qos").cast("string")))
    out = log.decode_log_headers(b.publishes.select("seq", "topic", "qos", headers.alias("headers")))
    return out.select("seq", "message_id", "state", F.col("properties")["k"].alias("k"))


@query("""SELECT queue, CAST(sum(strlen(payload) + strlen(topic) + 200) AS BIGINT) AS bytes FROM messages GROUP BY queue""")
def queue_sizes(b: Base):
    return b.messages.groupBy("queue").agg(F.sum(_size()).alias("bytes"))


@query(FAN + """SELECT client_id, received, expected, received / expected AS ratio FROM (SELECT subscriber AS client_id, count(DISTINCT seq) AS received, count(*) AS expected FROM deliveries GROUP BY subscriber)""")
def delivery_ratio(b: Base):
    out = _fan(b).groupBy(F.col("subscriber").alias("client_id")).agg(F.count_distinct("seq").alias("received"), F.count("*").alias("expected"))
    return out.withColumn("ratio", v.delivery_ratio(F.col("received"), F.col("expected")))


@query("""SELECT queue, 0 AS kept, n AS purged FROM limits WHERE queue = 'errors'""")
def purge(b: Base):
    own = b.limits.filter("queue = 'errors'")
    log_rows = b.messages.filter("queue = 'errors'")
    left = log.truncate(log_rows, own.select("queue", "tail", F.col("tail").alias("keep_from"))).groupBy("queue").agg(F.count("*").alias("k"))
    return own.join(left, "queue", "left").select("queue", F.coalesce("k", F.lit(0)).cast("int").alias("kept"), F.col("n").alias("purged"))


@query("SELECT event_type AS queue, count(*) AS n, count(*) AS distinct_offsets, count(*) - 1 AS last FROM events GROUP BY event_type")
def streamed_offsets(b: Base):
    """The events followed as a stream of several batches, numbered by stateful tasks and appended batch by batch."""
    own = b.spark.newSession()  # the state store is set for this stream alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path, out = shared_path(b.spark, "stream-input"), shared_path(b.spark, "streamed-offsets")
    events = b.spark.read.parquet(f"{b.dir}/events.parquet").select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"))
    events.repartition(3).write.parquet(path)
    rows = io.follow(own, path, events.schema)
    io.append_stream(state.stream_offsets(rows), out, shared_path(b.spark, "stream-checkpoint")).awaitTermination()
    return b.spark.read.parquet(out).groupBy("queue").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("distinct_offsets"), F.max("offset").alias("last"))


@query(f"""SELECT n.node, coalesce(m, 0) + coalesce(a, 0) AS active FROM (SELECT DISTINCT CAST(node AS BIGINT) AS node FROM sessions) n
LEFT JOIN (SELECT node, count(*) AS m FROM sessions WHERE connected GROUP BY node) USING (node)
LEFT JOIN (SELECT CAST(substr(node, 2) AS INT) AS node, count(*) AS a FROM {values(CONSUMERS)} c(consumer, queue, pattern, filter, node) GROUP BY 1) USING (node)""")
def node_overview(b: Base):
    own = s.sessions(b.spark, b.dir).withColumn("node", long("node"))
    amqp = b.spark.createDataFrame(CONSUMERS, "consumer string, queue string, pattern string, filter string, node string")
    amqp = amqp.groupBy(F.substring("node", 2, 9).cast("bigint").alias("node")).agg(F.count("*").alias("a"))
    out = own.groupBy("node").agg(F.count_if("connected").alias("m")).join(amqp, "node", "left")
    return out.select("node", (F.col("m") + F.coalesce("a", F.lit(0))).alias("active"))


@query("SELECT DISTINCT topic, seq FROM publishes WHERE topic LIKE 'events/%/7' OR topic LIKE 'events/error/%'")
def consumer_filter_set(b: Base):
    filters = F.array(F.lit("+/7"), F.lit("error/#"))
    key = t.routing_key(F.col("topic"), "events")
    return b.publishes.filter(t.any_filter_matches(filters, key)).select("topic", "seq")


@query("""SELECT DISTINCT topic, '$queue/events/' || substr(topic, 8) AS address, 'events' AS name, substr(topic, 8) AS pattern, 'events@' || substr(topic, 8) AS grp FROM publishes""")
def queue_addresses(b: Base):
    rows = b.publishes.select("topic").distinct().withColumn("address", t.queue_topic("events", t.routing_key(F.col("topic"), "events")))
    parts = t.parse_queue_filter(F.col("address"))
    return rows.select("topic", "address", parts["queue"].alias("name"), parts["pattern"].alias("pattern"), t.effective_group(parts["queue"], parts["pattern"]).alias("grp"))


# registers the queries of these modules
from . import catalogue_queries, group_queries  # noqa: E402, F401
