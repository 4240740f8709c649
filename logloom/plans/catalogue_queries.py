"""Queries of queues, subscriptions and sessions as listings and statistics, and of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import topics as t
from ..functions import values as v
from ..operators import admin, consumers, log, routing
from ..sources import tables as s
from .base import AS_OF, Base, long, query

# queues


@query("""SELECT queue, durable, CASE WHEN max(i) OVER () > 25 THEN max(CASE WHEN i <= 25 THEN queue END) OVER () ELSE '' END AS next_token FROM (SELECT queue, durable, row_number() OVER (ORDER BY queue) AS i FROM catalogue
WHERE starts_with(queue, 'q0000') AND queue > 'q00000010') WHERE i <= 26 QUALIFY i <= 25""")
def list_queues_page(b: Base):
    return admin.page(b.catalogue.select("queue", "durable"), "queue", 25, "q0000", "q00000010")


@query("SELECT queue FROM catalogue WHERE NOT durable AND NOT reserved AND expires_after_s > 0 AND idle_s > expires_after_s")
def ephemeral_expired(b: Base):
    return admin.ephemeral_expired(b.catalogue).select("queue")


@query("""SELECT queue AS path, CASE WHEN k % 4 = 0 THEN 'removed' ELSE 'changed' END AS change FROM catalogue WHERE k % 4 = 0 OR ttl_days > 30 UNION ALL SELECT s_name, 'added' FROM supplier""")
def config_diff(b: Base):
    old = b.catalogue.select(F.col("queue").alias("path"), F.col("ttl_days").cast("string").alias("value"), "k", "ttl_days")
    new = old.filter("k % 4 <> 0").select("path", F.when(F.col("ttl_days") > 30, "1").otherwise(F.col("value")).alias("value"))
    fresh = b.spark.read.parquet(f"{b.dir}/supplier.parquet").select(F.col("s_name").alias("path"), F.lit("1").alias("value"))
    return admin.config_diff(old, new.unionByName(fresh)).select("path", "change")


@query("SELECT queue, CASE k % 10 WHEN 1 THEN 'durable' WHEN 2 THEN 'ttl_days' WHEN 3 THEN 'max_bytes' WHEN 4 THEN 'missing' END AS reason FROM catalogue WHERE k % 10 IN (1, 2, 3, 4)")
def contract_mismatch(b: Base):
    kind = F.col("k") % 10
    held = b.catalogue.filter(kind != 4).withColumns(
        {
            "durable": F.when(kind == 1, ~F.col("durable")).otherwise(F.col("durable")),
            "ttl_days": F.when(kind.isin(1, 2), F.col("ttl_days") + 1).otherwise(F.col("ttl_days")),
            "max_bytes": F.when(kind != 3, F.col("max_bytes")),
        }
    )
    return admin.contract_mismatch(b.catalogue, held, ["durable", "ttl_days", "max_bytes"])


@query("""SELECT queue, CASE WHEN k % 3 = 0 THEN 1 ELSE CAST(ttl_days AS INT) END AS ttl_days FROM catalogue WHERE k % 3 = 0 OR k % 2 = 0""")
def contracts_merge(b: Base):
    """Contracts of two sources; the first one's stand."""
    first = b.catalogue.filter("k % 3 = 0").select("queue", F.lit(1).alias("ttl_days"))
    return admin.contracts_merge(first, b.catalogue.filter("k % 2 = 0").select("queue", "ttl_days"))


@query("""SELECT queue, CASE WHEN k % 5 = 0 THEN 99 ELSE CAST(ttl_days AS INT) END AS ttl_days FROM catalogue UNION ALL SELECT s_name, 1 FROM supplier""")
def queue_upsert(b: Base):
    fresh = b.spark.read.parquet(f"{b.dir}/supplier.parquet").select(F.col("s_name").alias("queue"), F.lit(1).alias("ttl_days"))
    changes = b.catalogue.filter("k % 5 = 0").select("queue", F.lit(99).alias("ttl_days")).unionByName(fresh)
    return admin.upsert(b.catalogue.select("queue", "ttl_days"), changes, "queue")


@query("SELECT queue FROM catalogue WHERE k % 4 <> 0 OR reserved")
def queue_delete(b: Base):
    return admin.delete_queues(b.catalogue, b.catalogue.filter("k % 4 = 0").select("queue")).select("queue")


@query("""SELECT queue, durable, expires_after_s, false AS created FROM catalogue UNION ALL SELECT s_name, false, 300, true FROM supplier""")
def get_or_create_queue(b: Base):
    names = b.spark.read.parquet(f"{b.dir}/supplier.parquet").select(F.col("s_name").alias("queue"))
    wanted = b.catalogue.filter("k % 2 = 0").select("queue").unionByName(names).unionByName(names)
    held = b.catalogue.select("queue", "durable", long("expires_after_s"))
    return admin.get_or_create(held, wanted, {"durable": F.lit(False), "expires_after_s": F.lit(300).cast("bigint")})


@query("""SELECT queue, k % 7 > 0 AND k % 13 > 0 AND k % 6 - 1 <= k % 4 + 1 AND (durable OR expires_after_s > 0) AND (NOT reserved OR durable) AND type <> 'odd' AND NOT ends_with(topic, '/x') AS valid FROM catalogue""")
def queue_config_valid(b: Base):
    k, one = F.col("k"), F.lit(1)
    config = {
        "name": F.col("queue"), "topics": F.array("topic"), "max_message_size": k % 7, "max_depth": k % 13, "delivery_timeout": one, "batch_size": one, "heartbeat_timeout": one, "max_retries": F.lit(0),
        "initial_backoff": F.greatest(k % 6 - 1, F.lit(0)), "max_backoff": k % 4 + 1, "backoff_multiplier": F.lit(1.0), "durable": F.col("durable"), "expires_after": F.col("expires_after_s"), "reserved": F.col("reserved"), "type": F.col("type"),
    }
    return b.catalogue.select("queue", (admin.valid_queue_config(config) & t.valid_topic_filters(F.array("topic"))).alias("valid"))


@query("SELECT queue, type, durable, ttl_days, max_bytes FROM catalogue WHERE type = 'stream'")
def management_query(b: Base):
    return admin.management_query(b.catalogue, ["queue", "type", "durable", "ttl_days", "max_bytes"], {"type": "stream"}).withColumn("ttl_days", long("ttl_days"))


@query("""SELECT queue, count(*) AS rows, min("offset") AS head FROM messages m WHERE NOT EXISTS (SELECT 1 FROM limits l WHERE l.queue = m.queue AND m."offset" // 100 * 100 + 100 <= l.tail // 2 + 30 AND m."offset" // 100 * 100 + 100 < l.tail) GROUP BY queue""")
def segment_truncate(b: Base):
    rows = b.messages.withColumn("segment", F.floor(F.col("offset") / 100) * 100)
    segs = log.segments(b.messages, F.lit(1), 100)
    before = b.limits.select("queue", (F.expr("tail div 2") + 30).alias("keep_from"))
    return log.truncate_segments(rows, segs, before).groupBy("queue").agg(F.count("*").alias("rows"), F.min("offset").alias("head"))


# subscriptions and sessions


@query("SELECT filter, count(DISTINCT client_id) AS clients, max(qos) AS max_qos FROM client_subscriptions GROUP BY filter")
def subscription_summary(b: Base):
    return admin.subscription_summary(b.client_subscriptions).select("filter", "clients", long("max_qos"))


MERGED = """, merged AS (SELECT filter, CAST(sum(c) AS BIGINT) AS clients, max(q) AS max_qos FROM (SELECT filter, count(DISTINCT client_id) AS c, max(qos) AS q FROM client_subscriptions GROUP BY filter
UNION ALL SELECT filter, count(DISTINCT client_id), max(qos) FROM amqp_subscriptions GROUP BY filter) GROUP BY filter)
"""


def _merged(b: Base) -> DataFrame:
    both = admin.merge_summaries(admin.subscription_summary(b.client_subscriptions), admin.subscription_summary(b.amqp_subscriptions))
    return both.select("filter", "clients", long("max_qos"))


@query(MERGED + "SELECT filter, clients, max_qos FROM merged")
def subscription_merge(b: Base):
    return _merged(b)


@query(MERGED + """SELECT filter, clients, max_qos, CASE WHEN max(i) OVER () > 10 THEN max(CASE WHEN i <= 10 THEN filter END) OVER () ELSE '' END AS next_token FROM (SELECT *, row_number() OVER (ORDER BY filter) AS i FROM merged WHERE starts_with(filter, 'orders/') AND filter > 'orders/+/20')
WHERE i <= 11 QUALIFY i <= 10""")
def list_subscriptions_page(b: Base):
    return admin.page(_merged(b), "filter", 10, "orders/", "orders/+/20")


CLIENTS = """, clients AS (SELECT client_id, max(qos) AS qos FROM client_subscriptions WHERE filter = 'orders/P/#' GROUP BY client_id),
every AS (SELECT * FROM clients UNION ALL SELECT client_id, qos FROM amqp_subscriptions WHERE filter = 'orders/P/#' AND client_id NOT IN (SELECT client_id FROM clients))
"""


def _clients(b: Base) -> DataFrame:
    own, other = (admin.subscription_clients(x, "orders/P/#").select("client_id", long("qos")) for x in (b.client_subscriptions, b.amqp_subscriptions))
    return admin.missing_clients(own, other)


@query(CLIENTS + "SELECT client_id, qos FROM clients")
def subscription_clients(b: Base):
    return admin.subscription_clients(b.client_subscriptions, "orders/P/#").select("client_id", long("qos"))


@query(CLIENTS + "SELECT client_id, qos FROM every")
def client_union(b: Base):
    return _clients(b)


@query(CLIENTS + """SELECT client_id, qos, CASE WHEN max(i) OVER () > 15 THEN max(CASE WHEN i <= 15 THEN client_id END) OVER () ELSE '' END AS next_token FROM (SELECT *, row_number() OVER (ORDER BY client_id) AS i FROM every WHERE client_id > 'c00000050') WHERE i <= 16 QUALIFY i <= 15""")
def list_subscription_clients_page(b: Base):
    return admin.page(_clients(b), "client_id", 15, "", "c00000050")


@query("""SELECT node, client_id, max(qos) AS qos FROM (SELECT * FROM client_subscriptions UNION ALL SELECT * FROM amqp_subscriptions) WHERE filter = 'orders/P/#' GROUP BY node, client_id""")
def subscription_clients_by_node(b: Base):
    both = b.client_subscriptions.unionByName(b.amqp_subscriptions)
    return admin.subscription_clients(both, "orders/P/#", ("node", "client_id")).select("node", "client_id", long("qos"))


@query("""SELECT client_id, filter, qos FROM client_subscriptions WHERE client_id IN (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer WHERE c_nationkey = 3)""")
def subscriptions_of_client(b: Base):
    some = b.sessions.filter("node = 3").select("client_id")
    return admin.subscriptions_by(b.client_subscriptions, "client_id", some).select("client_id", "filter", long("qos"))


@query("SELECT client_id, filter FROM client_subscriptions WHERE filter IN (SELECT filter FROM amqp_subscriptions)")
def subscriptions_of_filter(b: Base):
    """Filters are looked up letter by letter: ``orders/#`` does not find ``orders/P/#``."""
    return admin.subscriptions_by(b.client_subscriptions, "filter", b.amqp_subscriptions).select("client_id", "filter")


@query("SELECT filter, client_id, qos FROM amqp_subscriptions ORDER BY filter, client_id")
def amqp_subscription_snapshots(b: Base):
    return consumers.subscription_snapshots(b.amqp_subscriptions).select("filter", "client_id", long("qos"))


@query("""SELECT client_id, filter, ends_with(client_id, '3') OR (starts_with(filter, 'orders/+/') AND NOT ends_with(client_id, '7')) AS allowed FROM client_subscriptions""")
def authorized_subscriptions(b: Base):
    clients = b.client_subscriptions.select("client_id").distinct()
    rule = lambda df, f, prefix, allow: df.select("client_id", F.lit(f).alias("filter"), F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"))
    last = F.substring("client_id", -1, 1)
    exact = b.client_subscriptions.filter(last == "3").select("client_id", "filter", F.lit(False).alias("prefix"), F.lit(True).alias("allow"))
    rules = rule(clients, "orders/+/", True, True).unionByName(rule(clients.filter(last == "7"), "orders/+/", True, False)).unionByName(exact)
    return admin.authorized_subscriptions(b.client_subscriptions, rules).select("client_id", "filter", "allowed")


@query("""SELECT client_id, protocol, CASE WHEN max(i) OVER () > 20 THEN max(CASE WHEN i <= 20 THEN client_id END) OVER () ELSE '' END AS next_token FROM (SELECT *, row_number() OVER (ORDER BY client_id) AS i FROM
(SELECT client_id, 'mqtt' AS protocol FROM sessions WHERE connected UNION ALL SELECT client_id, 'amqp' FROM amqp_subscriptions WHERE client_id NOT IN (SELECT client_id FROM sessions WHERE connected)) WHERE client_id > 'b') WHERE i <= 21 QUALIFY i <= 20""")
def list_all_sessions_page(b: Base):
    """Connected sessions of both protocols; a client of both is listed with the first."""
    live = b.sessions.filter("connected").select("client_id", F.lit("mqtt").alias("protocol"))
    both = admin.first_of([live, b.amqp_subscriptions.select("client_id", F.lit("amqp").alias("protocol"))], "client_id")
    return admin.page(both, "client_id", 20, "", "b")


@query("SELECT 'n' || (node % 3) AS node, client_id FROM sessions UNION ALL SELECT 'n9', client_id FROM amqp_subscriptions ORDER BY client_id, node")
def sessions_across_nodes(b: Base):
    own = b.sessions.withColumn("on", F.col("node") % 3).drop("node")
    nodes = {f"n{i}": own.filter(F.col("on") == i).select("client_id") for i in range(3)} | {"n9": b.amqp_subscriptions.select("client_id")}
    return admin.of_nodes(nodes, ["client_id", "node"])


@query("""SELECT (SELECT count(*) FROM sessions WHERE connected) AS connected, (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM queues) AS queues, (SELECT count(*) FROM client_subscriptions) AS subscriptions,
(SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM pending) AS pending, (SELECT count(*) FROM members) AS consumers""")
def overview(b: Base):
    counts = {"queues": s.queues(b.spark), "subscriptions": b.client_subscriptions, "messages": b.messages, "pending": b.pending, "consumers": consumers.members(b.consumer_ops)}
    return admin.overview(b.sessions, counts)


@query(""", counters AS (SELECT (SELECT CAST(count(*) FILTER (connected) AS VARCHAR) FROM sessions) AS a, (SELECT CAST(count(*) AS VARCHAR) FROM sessions) AS b, (SELECT CAST(count(*) FILTER (NOT connected) AS VARCHAR) FROM sessions) AS c,
  (SELECT CAST(count(*) AS VARCHAR) FROM publishes) AS d, (SELECT CAST(count(*) AS VARCHAR) FROM messages) AS e, (SELECT CAST(sum(strlen(payload)) AS VARCHAR) FROM publishes) AS f, (SELECT CAST(sum(strlen(payload)) AS VARCHAR) FROM messages) AS g,
  (SELECT CAST(count(*) AS VARCHAR) FROM client_subscriptions) AS h, (SELECT CAST(count(DISTINCT topic) AS VARCHAR) FROM publishes WHERE retain) AS i, (SELECT CAST(count(*) AS VARCHAR) FROM publishes WHERE topic LIKE 'events/error/%') AS j,
  (SELECT CAST(epoch(max(published_at)) - epoch(min(published_at)) AS BIGINT) FROM publishes) AS up)
SELECT '$SYS/broker/' || topic AS topic, CAST(value AS VARCHAR) AS value FROM (SELECT unnest(['version', 'uptime', 'clients/connected', 'clients/total', 'clients/disconnected', 'messages/received', 'messages/sent', 'messages/publish/received', 'messages/publish/sent', 'bytes/received', 'bytes/sent',
  'subscriptions/count', 'retained/count', 'errors/protocol', 'errors/auth', 'errors/authz', 'errors/packet']) AS topic, unnest(['1.0', CAST(up AS VARCHAR), a, b, c, d, e, d, e, f, g, h, i, j, '0', '0', '0']) AS value FROM counters) WHERE topic <> 'uptime'""")
def sys_stats(b: Base):
    """All seventeen counters; the uptime is left out as a matter of rounding."""
    count = lambda df, name, what="*": df.agg(F.count(what).alias(name))
    rows = b.publishes.agg(
        F.count("*").alias("received"), F.sum(F.octet_length("payload")).alias("bytes"), F.count_distinct(F.when(F.col("retain"), F.col("topic"))).alias("retained"),
        F.count_if(F.col("topic").startswith("events/error/")).alias("errors"), (F.max(F.unix_seconds("published_at")) - F.min(F.unix_seconds("published_at"))).alias("up"),
    )
    sent = b.messages.agg(F.count("*").alias("sent"), F.sum(F.octet_length("payload")).alias("sent_bytes"))
    clients = b.sessions.agg(F.count_if("connected").alias("connected"), F.count("*").alias("total"))
    for one in (sent, clients, count(b.client_subscriptions, "subscriptions")):
        rows = rows.join(F.broadcast(one))  # one row each
    return admin.counters_as_topics(admin.sys_counters(rows)).filter("topic <> '$SYS/broker/uptime'")


@query("""SELECT qos, count(*) AS messages, CAST(sum(n) AS BIGINT) AS bytes, count(*) FILTER (n <= 7) || ',' || count(*) FILTER (n > 7 AND n <= 8) || ',' || count(*) FILTER (n > 8 AND n <= 9) || ',' || count(*) FILTER (n > 9) AS histogram FROM (SELECT qos, strlen(payload) AS n FROM publishes) GROUP BY qos""")
def received_by_qos(b: Base):
    out = admin.message_metrics(b.publishes, "qos", F.octet_length("payload"), [7, 8, 9])
    return out.select("qos", "messages", "bytes", F.array_join(F.col("histogram").cast("array<string>"), ",").alias("histogram"))


@query("SELECT seq FROM publishes WHERE qos <= 1 AND NOT (client_id = 'u7')")
def qos_cap_no_local(b: Base):
    """What a session that agreed on a QoS of 1 at most gets through, without its own publishes."""
    own = b.spark.createDataFrame([("u7", "events/#", 2, True, False, 0)], "client_id string, filter string, qos int, no_local boolean, retain_as_published boolean, retain_handling int")
    return routing.fan_out(admin.within_qos(b.publishes, F.lit(1)), own, ["published_at", "seq"]).select("seq")


# scalar functions over all addresses and publishes


@query("""SELECT topic, regexp_matches(topic, '[+#]') AS wildcard, CASE WHEN starts_with(topic, '$queue/') THEN '$queue/' || split_part(topic, '/', 2) ELSE '' END AS root,
CASE WHEN starts_with(topic, '$queue/') THEN substr(topic, 9 + length(split_part(topic, '/', 2))) ELSE '' END AS pattern, starts_with(topic, '$queue/click') AND regexp_full_match(topic, '\\$queue/click/[^/]+') AS fits, replace(topic, '.', '/') AS mqtt FROM addresses""")
def queue_subscriptions(b: Base):
    parts = t.parse_queue_subscription(F.col("topic"))
    return b.addresses.select(
        "topic", t.is_wildcard(F.col("topic")).alias("wildcard"), t.queue_root(F.col("topic")).alias("root"), parts["pattern"].alias("pattern"),
        t.matches_subscription(F.col("topic"), "$queue/click/+").alias("fits"), t.amqp_topic_to_mqtt(F.col("topic")).alias("mqtt"),
    )


@query("""SELECT seq, client_id || '-' || seq AS client, client_id AS grp, client_id || '-' || seq AS stamped, '7' AS kept FROM publishes""")
def client_properties(b: Base):
    client = F.concat("client_id", F.lit("-"), F.col("seq").cast("string"))
    props = v.client_property(F.create_map(F.lit("client_id"), F.lit("forged"), F.lit("k"), F.lit("7")), client)
    return b.publishes.select("seq", client.alias("client"), t.default_group(client).alias("grp"), props["client_id"].alias("stamped"), props["k"].alias("kept"))


@query("""SELECT seq, 2 AS left_by_delivery, 4 AS left_by_client, 'u' || seq AS id FROM publishes""")
def reserved_properties(b: Base):
    n = F.col("seq").cast("string")
    names = ["message-id", "offset", "x-stream-offset", "mine", "_internal-1"]
    props = F.create_map(*[x for k in names for x in (F.lit(k), n)])
    left = v.strip_delivery_properties(props)
    own = v.strip_prefixed_properties(props, "_internal")
    payload = F.concat(F.lit("u"), n, F.lit("|"), F.col("payload"))
    return b.publishes.select("seq", F.size(left).alias("left_by_delivery"), F.size(own).alias("left_by_client"), v.payload_id(payload).alias("id"))


@query("""SELECT seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE 'text/' || qos END AS content_type, base64(CAST(payload AS BLOB)) AS correlation, CASE WHEN seq % 2 = 0 THEN '1' END AS format, topic AS reply, 2 + CAST(seq % 3 <> 0 AS INT) + CAST(seq % 2 = 0 AS INT) + 1 AS n FROM publishes""")
def publish_properties(b: Base):
    user = F.create_map(F.lit("mine"), F.lit("x"), F.lit("_internal-a"), F.lit("y"))
    kind = F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("text/"), F.col("qos").cast("string")))
    fmt = F.when(F.col("seq") % 2 == 0, 1)
    p = v.publish_properties(user, kind, F.col("topic"), F.encode("payload", "UTF-8"), fmt, "_internal")
    return b.publishes.select(
        "seq", p["content-type"].alias("content_type"), p["correlation-id"].alias("correlation"), p["payload-format"].alias("format"), p["response-topic"].alias("reply"), F.size(p).alias("n"),
    )


NUMBERS = """, numbers AS (SELECT DISTINCT CASE seq % 7 WHEN 0 THEN ' ' || seq WHEN 1 THEN '-' || seq WHEN 2 THEN '+' || seq WHEN 3 THEN seq || '.5' WHEN 4 THEN seq || 'x' WHEN 5 THEN 'earliest' ELSE 'latest' END AS arg FROM publishes)
"""


def _numbers(b: Base) -> DataFrame:
    n, c, x = F.col("seq").cast("string"), F.concat, F.lit
    forms = F.array(c(x(" "), n), c(x("-"), n), c(x("+"), n), c(n, x(".5")), c(n, x("x")), x("earliest"), x("latest"))
    return b.publishes.select(F.get(forms, (F.col("seq") % 7).cast("int")).alias("arg")).distinct()


@query(NUMBERS + """SELECT arg, TRY_CAST(CASE WHEN regexp_full_match(trim(arg), '[+-]?[0-9]+') THEN ltrim(trim(arg), '+') END AS BIGINT) AS number, CASE WHEN regexp_full_match(trim(arg), '[+]?[0-9]+') OR trim(arg) = '-0' THEN CAST(ltrim(trim(arg), '+-') AS BIGINT) / 1000.0::DOUBLE END AS ttl,
CASE WHEN arg IN ('earliest', 'latest') THEN arg WHEN regexp_matches(arg, '^ *[+]?[0-9]') THEN 'offset' END AS position, CASE WHEN regexp_matches(arg, '^ *[+]?[0-9]') THEN CAST(regexp_extract(arg, '[0-9]+') AS BIGINT) END AS at FROM numbers""")
def number_arguments(b: Base):
    at = v.link_cursor(F.col("arg"))
    return _numbers(b).select("arg", v.int_argument(F.col("arg")).alias("number"), v.ttl_seconds(F.col("arg")).alias("ttl"), at["position"].alias("position"), at["offset"].alias("at"))


@query("""SELECT queue, CAST(ttl_days AS DOUBLE) * 86400 AS max_age_s, max_bytes, CAST(NULL AS BIGINT) AS max_messages FROM catalogue""")
def stream_retention_arguments(b: Base):
    r = v.stream_retention(F.concat(F.col("ttl_days").cast("string"), F.lit("D")), F.col("max_bytes").cast("string"), F.lit("many"))
    return b.catalogue.select("queue", r["max_age_s"].alias("max_age_s"), r["max_bytes"].alias("max_bytes"), r["max_messages"].alias("max_messages"))
