"""Tables shared by the queries, and the same tables as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups, log
from ..session import file_stamps, shared_path
from ..sources import tables as s

_stored: dict[tuple, str] = {}


def stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message log of a data folder, appended to storage and read from there; appended again if the folder's events have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, file_stamps(spark, f"{sf_dir}/events.parquet"))
    if key not in _stored:
        path = shared_path(spark, "messages")
        s.messages(spark, sf_dir).sortWithinPartitions("queue", "offset").write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

long = lambda c: F.col(c).cast("bigint").alias(c)
micros = lambda c: F.unix_micros(c).alias(c)


def query(sql: str | None = None):
    """Registers a query over the tables of a data folder, and the SQL that checks it."""

    def add(f: Callable[[Base], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = SQL + sql
        return f

    return add


class Base:
    """Lazy tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def publishes(self) -> DataFrame:
        return s.publishes(self.spark, self.dir)

    @cached_property
    def messages(self) -> DataFrame:
        return stored_messages(self.spark, self.dir)

    @cached_property
    def limits(self) -> DataFrame:
        return log.bounds(self.messages)

    @cached_property
    def groups(self) -> DataFrame:
        return s.groups(self.spark, self.limits)

    @cached_property
    def named_groups(self) -> DataFrame:
        """Groups under the name that their pattern gives them."""
        return self.groups.withColumn("group", groups.group_name())

    @cached_property
    def pending(self) -> DataFrame:
        return s.pending(self.messages, self.groups)

    @cached_property
    def consumer_ops(self) -> DataFrame:
        return s.consumer_ops(self.spark, self.dir)

    @cached_property
    def addresses(self) -> DataFrame:
        return s.addresses(self.publishes)

    @cached_property
    def client_subscriptions(self) -> DataFrame:
        return s.client_subscriptions(self.spark, self.dir)

    @cached_property
    def amqp_subscriptions(self) -> DataFrame:
        return s.amqp_subscriptions(self.spark, self.dir)

    @cached_property
    def catalogue(self) -> DataFrame:
        return s.catalogue(self.spark, self.dir)

    @cached_property
    def sessions(self) -> DataFrame:
        return s.sessions(self.spark, self.dir)


def _literal(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x}::DOUBLE"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


AS_OF = f"TIMESTAMP '{s.AS_OF}'"

SQL = f"""WITH RECURSIVE publishes AS (
  SELECT event_id AS seq, 'u' || user_id AS client_id, 'events/' || event_type || '/' || user_id AS topic, props AS payload,
    CAST(event_id % 3 AS INT) AS qos, event_id % 10 = 0 AS retain, ts AS published_at FROM events),
bindings AS (SELECT * FROM {values(s.BINDINGS)} t(queue, pattern)),
queues AS (SELECT * FROM {values(s.QUEUES)} t(queue, durable, reserved, ttl_days, max_age_days, max_bytes, max_messages, dlq, dlq_topic, expires_after_s, idle_s)),
subscriptions AS (SELECT * FROM {values(s.SUBSCRIPTIONS)} t(client_id, filter, qos, no_local, retain_as_published, retain_handling)),
taken AS (
  SELECT DISTINCT p.seq, p.client_id, p.topic, p.payload, p.published_at, b.queue FROM publishes p JOIN bindings b
  ON regexp_full_match(p.topic, replace(replace(b.pattern, '+', '[^/]*'), '/#', '(/.*)?'))),
messages AS (
  SELECT queue, row_number() OVER (PARTITION BY queue ORDER BY published_at, seq) - 1 AS "offset", seq, client_id, topic, payload,
    published_at AS created_at, published_at + ttl_days * INTERVAL 1 DAY AS expires_at FROM taken JOIN queues USING (queue)),
limits AS (SELECT queue, min("offset") AS head, max("offset") + 1 AS tail, count(*) AS n FROM messages GROUP BY queue),
groups AS (
  SELECT queue, group_id, pattern, mode, auto_commit, CAST(floor(c * tail) AS BIGINT) AS cursor, CAST(floor(k * tail) AS BIGINT) AS committed, head, tail,
    CASE WHEN pattern = '' THEN group_id ELSE group_id || '@' || pattern END AS "group"
  FROM {values(s.GROUPS)} t(queue, group_id, pattern, mode, auto_commit, c, k) JOIN limits USING (queue)),
pending AS (
  SELECT m.queue, g."group", m."offset", 'c' || (m."offset" % 3) AS consumer,
    date_trunc('second', m.created_at) + (m."offset" % 100) * INTERVAL 1 SECOND AS claimed_at, m."offset" % 6 + 1 AS deliveries
  FROM messages m JOIN groups g USING (queue) WHERE g.mode = 'queue' AND m."offset" >= g.committed AND m."offset" < g.cursor AND m."offset" % 7 = 0),
sessions AS (
  SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS client_id, c_custkey % 4 + 3 AS version, c_custkey % 3 = 0 AS connected,
    (c_custkey % 5) * 86400 AS expiry_s, CASE WHEN c_custkey % 3 <> 0 THEN {AS_OF} - (c_custkey % 200) * INTERVAL 1 HOUR END AS disconnected_at,
    c_nationkey AS node FROM customer),
inflight AS (
  SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS client_id, o_orderkey % 65535 + 1 AS packet_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'out' ELSE 'in' END AS direction, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 60000 END AS sent_age_ms,
    o_orderkey % 2000 AS attempted_age_ms, o_orderkey % 4 AS retries FROM orders),
consumer_ops AS (
  SELECT ['all', 'clicks', 'errors', 'purchases'][CAST(user_id % 4 AS INT) + 1] AS queue, 'workers' AS "group", 'u' || user_id AS consumer, 'u' || user_id AS client_id, 'n' || (user_id % 5) AS node,
    event_id AS seq, CASE event_type WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'heartbeat' END AS op, ts AS ats FROM events),
members AS (
  SELECT queue, "group", consumer, arg_max(client_id, seq) FILTER (op = 'join') AS client_id, arg_max(node, seq) FILTER (op = 'join') AS node, arg_max(ats, seq) FILTER (op = 'join') AS registered_at,
    arg_max(ats, seq) FILTER (op <> 'leave') AS last_heartbeat FROM consumer_ops GROUP BY ALL HAVING max(seq) FILTER (op = 'join') > coalesce(max(seq) FILTER (op = 'leave'), -1)),
addresses AS (
  SELECT DISTINCT CASE seq % 15 WHEN 0 THEN q WHEN 1 THEN q || '/' || u WHEN 2 THEN q || '/' || u || '/$ack' WHEN 3 THEN q || '/$nack' WHEN 4 THEN q || '/x/' || u || '/$reject' WHEN 5 THEN q || '/$commit'
    WHEN 6 THEN q || '/$ack/' || u WHEN 7 THEN topic WHEN 8 THEN '$share/g' || u || '/events/' || kind || '/#' WHEN 9 THEN 'events/+/' || u WHEN 10 THEN 'events/#/' || u WHEN 11 THEN kind || '+/' || u
    WHEN 12 THEN '$share/g' || u WHEN 13 THEN kind ELSE kind || '/' || u END AS topic
  FROM (SELECT seq, topic, split_part(topic, '/', 2) AS kind, split_part(topic, '/', 3) AS u, '$queue/' || split_part(topic, '/', 2) AS q FROM publishes)),
client_subscriptions AS (
  SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS client_id, CASE o_orderkey % 4 WHEN 0 THEN 'orders/' || o_orderstatus || '/#' WHEN 1 THEN 'orders/+/' || (o_custkey % 50) WHEN 2 THEN '$share/g' || (o_custkey % 5) || '/orders/#' ELSE 'orders/#' END AS filter,
    max(o_orderkey % 3) AS qos, 'n' || any_value(o_custkey % 3) AS node FROM orders GROUP BY 1, 2),
amqp_subscriptions AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE 'amqp091:' || c_custkey END AS client_id, 'orders/' || ['P', 'F', 'O'][CAST(c_custkey % 3 AS INT) + 1] || '/#' AS filter,
    CAST(1 AS BIGINT) AS qos, 'n' || (c_custkey % 3) AS node FROM customer),
catalogue AS (
  SELECT 'q' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS queue, p_partkey AS k, p_partkey % 3 <> 0 AS durable, p_partkey % 11 = 0 AS reserved, ['classic', 'stream', 'odd', ''][CAST(p_partkey % 4 AS INT) + 1] AS type, p_size AS ttl_days,
    CAST(p_size AS BIGINT) * 1000 AS max_bytes, p_partkey % 5 * 600 AS expires_after_s, p_partkey * 37 % 5000 AS idle_s, 'parts/' || p_size || CASE WHEN p_partkey % 7 = 0 THEN '/#/x' ELSE '/#' END AS topic FROM part)
"""
