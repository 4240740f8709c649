"""Operators on small tables, and every query against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.operators import admin, log, routing
from logloom.plans import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = [p.stem for p in DATA.glob("*.parquet")] if DATA.exists() else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_offsets_are_dense_across_ranges(spark):
    rows = spark.range(1000).select(F.lit("q").alias("queue"), F.timestamp_seconds(F.col("id") % 97).alias("at"), "id")
    out = log.assign_offsets(rows, ["queue"], "at", ["id"], rows_per_range=50).orderBy("offset").collect()
    assert [r.offset for r in out] == list(range(1000))
    assert [(r["at"], r.id) for r in out] == sorted((r["at"], r.id) for r in out)
    empty = log.assign_offsets(rows.limit(0), ["queue"], "at", ["id"])
    assert empty.count() == 0


def test_deep_topics_join_by_first_level(spark):
    deep = "/".join("abcdefghijkl")
    pubs = spark.createDataFrame([(1, deep), (2, "$sys/x"), (3, "a")], "seq int, topic string")
    binds = spark.createDataFrame([("q", "a/+/#"), ("q", "#"), ("r", "+/b/#"), ("s", "$sys/#"), ("t", "a/#")], "queue string, pattern string")
    got = {(r.seq, r.queue) for r in routing.match_bindings(pubs, binds).collect()}
    assert got == {(1, "q"), (1, "r"), (1, "t"), (2, "s"), (3, "q"), (3, "t")}
    live = routing.match_filters(pubs, binds.withColumnRenamed("pattern", "filter"), "filter", guard=False)
    assert {(r.seq, r.queue) for r in live.collect()} == got | {(2, "q")}


def test_header_decoding(spark):
    rows = spark.createDataFrame([({"_id": b"m1", "_expires_at": b"1000", "topic": b"t", "k": b"v"},)], "headers map<string,binary>")
    r = log.decode_log_headers(rows).first()
    assert (r.message_id, r.state, r.topic, r.properties) == ("m1", "queued", "t", {"k": "v"})


def test_pages_and_merges(spark):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(5)], "k string")
    assert [(r.k, r.next_token) for r in admin.page(rows, "k", 2, "k", "k0").collect()] == [("k1", "k2"), ("k2", "k2")]
    assert [r.next_token for r in admin.page(rows, "k", 9).collect()] == [""] * 5
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert {(r.k, r.v) for r in admin.first_of([a, b], "k").collect()} == {("x", 1), ("y", 3)}


def test_hooks_rewrite_and_deny(spark):
    pubs = spark.createDataFrame([(1, "a"), (2, "b")], "seq int, topic string")

    def decide(pdf):
        return pdf.assign(allowed=pdf["topic"] != "b", topic=pdf["topic"] + "/x")

    def broken(pdf):
        raise RuntimeError

    assert [(r.seq, r.topic) for r in admin.apply_hooks(pubs, decide).collect()] == [(1, "a/x")]
    assert admin.apply_hooks(pubs, broken).count() == 0
    assert admin.apply_hooks(pubs, broken, fail_open=True).count() == 2


@pytest.mark.parametrize("rows_per_range", [3, 100_000])
def test_claim_of_a_long_list_steals_by_offset_over_ranges(spark, monkeypatch, rows_per_range):
    from logloom.operators import claims

    monkeypatch.setattr(claims, "ROWS_PER_RANGE", rows_per_range)
    at = "timestamp'2024-01-01 00:00:00'"
    log = spark.range(12).selectExpr("'q' queue", "id offset", "'t' topic", "cast(null as timestamp) expires_at")
    pending = spark.range(10).selectExpr("'q' queue", "'g' group", "id offset", "'c2' consumer", f"{at} claimed_at", "cast(if(id % 4 = 1, 5, 1) as int) deliveries")
    groups = spark.sql("select 'q' queue, 'g' group, '' pattern, 10L cursor, 0L committed")
    requests = spark.sql("select 'q' queue, 'g' group, 'c1' consumer, 7 limit")
    out = claims.claim_batch(groups, pending, log, requests, "2024-02-01 00:00:00", most_pending=0)
    assert sorted((r.offset, r.source) for r in out.rows.collect()) == [(0, "stolen"), (2, "stolen"), (3, "stolen"), (4, "stolen"), (6, "stolen"), (10, "new"), (11, "new")]
    assert sorted(r.offset for r in out.dead.collect()) == [1, 5]
    full = claims.claim_batch(groups, pending, log, requests, "2024-02-01 00:00:00", most_pending=10)
    assert {r.source for r in full.rows.collect()} == {"stolen"}


def test_turns_of_many_members(spark, monkeypatch):
    from logloom.operators import consumers, routing

    monkeypatch.setattr(consumers, "MEMBERS_PER_RANGE", 4)
    members = spark.range(11).selectExpr("'q' queue", "'g' group", "concat('u', id) consumer")
    rows = spark.range(40).selectExpr("'q' queue", "timestamp_seconds(id div 3) at", "id seq")
    out = routing.take_turns(rows, ["queue"], ["at", "seq"], consumers.group_turns(members))
    names = sorted(f"u{i}" for i in range(11))
    assert {r.seq: r.consumer for r in out.collect()} == {i: names[i % 11] for i in range(40)}


def test_inflight_window_follows_a_plain_fold(spark):
    import random

    from logloom.operators import consumers

    rnd, rows, want = random.Random(5), [], {}
    for client, n, ids in (("a", 700, 12), ("b", 300, 4), ("c", 1, 1), ("d", 256, 30), ("e", 40, 3)):
        held = []
        for seq in range(n):
            op = rnd.choice(["add", "add", "done"] + [None] * (client == "e"))
            x = None if client == "e" and rnd.random() < 0.3 else rnd.randrange(ids)
            known, room = x is not None and x in held, len(held) < 5
            if op == "add":
                got = "replaced" if known else "admitted" if room else "full"
                held += [x] if got == "admitted" and x is not None else []
            else:
                got = "released" if known else "unknown"
                held = [y for y in held if y != x] if known and op else held
            rows.append((client, "out", seq, op, x))
            want[client, seq] = (op, x, got)
    rnd.shuffle(rows)
    packets = spark.createDataFrame(rows, "client_id string, direction string, seq long, op string, packet_id int")
    out = consumers.inflight_window(packets, 5)
    got = out.collect()
    assert len(got) == len(rows) and {(r.client_id, r.seq): (r.op, r.packet_id, r.outcome) for r in got} == want
    # sessions are dealt by number, and a packet is looked up once in each of its two branches
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in text and f", {consumers.SESSION_TASKS}" in text
    assert max(line.count("array_contains") for line in text.splitlines()) <= 2
