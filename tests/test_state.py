"""Group state: folds, streams and plain replays agree."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import arrays
from logloom.operators import claims, consumers, groups, log, ranking
from logloom.streaming import state
from logloom.streaming.io import append_stream, delivery_loop, follow

AT = "2024-01-01 00:10:00"
PENDING = "queue string, group string, offset bigint, consumer string, claimed_at timestamp, deliveries int"


def at(seconds):
    return F.timestamp_seconds(F.lit(1704067200 + seconds))


def table(spark, rows, schema, times):
    df = spark.createDataFrame(rows, schema.replace("timestamp", "bigint"))
    return df.withColumns({c: F.timestamp_seconds(F.col(c) + 1704067200) for c in times})


@pytest.fixture(scope="module")
def group(spark):
    """Offsets 0 to 9, 4 truncated, 6 expired; the group has read up to 5."""
    rows = [("q", o, f"$queue/q/{'a' if o % 2 else 'b'}", 100 if o == 6 else 9999) for o in range(10) if o != 4]
    msgs = table(spark, rows, "queue string, offset bigint, topic string, expires_at timestamp", ["expires_at"])
    own = spark.createDataFrame([("q", "g", "", 5, 0, "queue", True)], "queue string, group string, pattern string, cursor bigint, committed bigint, mode string, auto_commit boolean")
    held = table(spark, [("q", "g", 0, "a", 0, 1), ("q", "g", 1, "a", 0, 5), ("q", "g", 2, "b", 0, 1), ("q", "g", 3, "a", 590, 1), ("q", "g", 4, "a", 0, 1)], PENDING, ["claimed_at"])
    return msgs, own, held


def ask(spark, limit, who="b"):
    return spark.createDataFrame([("q", "g", who, limit)], "queue string, group string, consumer string, limit int")


def test_claims_take_new_rows_then_stale_ones(spark, group):
    msgs, own, held = group
    out = claims.claim_batch(own, held, msgs, ask(spark, 20), AT)
    assert sorted((r.offset, r.source, r.deliveries) for r in out.rows.collect()) == [(0, "stolen", 2), (5, "new", 1), (7, "new", 1), (8, "new", 1), (9, "new", 1)]
    assert [(r.cursor, r.committed) for r in out.groups.collect()] == [(10, 0)]
    assert [r.offset for r in out.dead.collect()] == [1]
    # 1 was delivered too often and goes; 2 is b's own, 3 too fresh, 4 truncated: they stay
    assert sorted((r.offset, r.consumer) for r in out.pending.collect()) == [(0, "b"), (2, "b"), (3, "a"), (4, "a"), (5, "b"), (7, "b"), (8, "b"), (9, "b")]
    few = claims.claim_batch(own, held, msgs, ask(spark, 2), AT)
    assert sorted(r.offset for r in few.rows.collect()) == [5, 7] and few.groups.first().cursor == 8 and few.dead.count() == 0


def test_claims_at_a_full_list_and_with_a_pattern(spark, group):
    msgs, own, held = group
    assert [r.offset for r in claims.claim_batch(own, held, msgs, ask(spark, 1), AT, most_pending=5).rows.collect()] == [0]
    assert claims.claim_batch(own, held, msgs, ask(spark, 1), AT, most_pending=5, single=True).rows.count() == 0
    odd = own.withColumn("pattern", F.lit("a"))
    out = claims.claim_batch(odd, held, msgs, ask(spark, 20), AT)
    assert sorted(r.offset for r in out.rows.collect()) == [5, 7, 9]  # 0 has another key and is not stolen


def test_settling_moves_the_committed_offset_only_if_an_entry_went(spark, group):
    _, own, held = group
    ops = "queue string, group string, seq bigint, op string, offset bigint, consumer string, to string, at timestamp"
    run = lambda rows: claims.settle(own, held, table(spark, [("q", "g", i, *r, None, 600) for i, r in enumerate(rows)], ops, ["at"]))
    outcomes, left, after = run([("ack", 0, "nobody"), ("ack", 7, "a")])
    assert [r.ok for r in outcomes.collect()] == [False, False] and after.first().committed == 0 and left.count() == 5
    outcomes, left, after = run([("ack", 0, "a"), ("reject", 1, "a"), ("ack", 0, "a")])
    assert sorted((r.seq, r.ok) for r in outcomes.collect()) == [(0, True), (1, True), (2, False)] and after.first().committed == 2
    assert run([("ack_batch", 0, "nobody")])[2].first().committed == 0
    outcomes, left, after = run([("nack", 3, "a"), ("nack", 2, "a")])
    assert {r.offset: (r.deliveries, r.consumer) for r in left.collect()}[3] == (2, "a") and after.first().committed == 0
    assert run([("ack_batch", o, "a") for o in (0, 1, 3, 4)] + [("ack", 2, "b")])[2].first().committed == 5


def plain_settle(held, ops):
    held, out = {k: list(v) for k, v in held.items()}, []
    for seq, op, offset, who, to in ops:
        entry = held.get(offset)
        if op == "deliver":
            ok = entry is None
            if ok:
                held[offset] = [who, 1]
        else:
            ok = entry is not None and entry[0] == who
            if ok and op in ("ack", "reject"):
                del held[offset]
            elif ok:
                held[offset] = [to if op == "transfer" else who, entry[1] + 1]
        out.append((seq, op, ok))
    return held, out


def test_batch_and_stream_settle_as_a_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    start = {o: (rng.choice("ab"), 1) for o in range(0, 30, 2)}
    ops = [(i, rng.choice(["ack", "nack", "transfer", "reject"]), rng.randrange(30), rng.choice("ab"), rng.choice("ab")) for i in range(200)]
    held = table(spark, [("q", "g", o, c, 0, d) for o, (c, d) in start.items()], PENDING, ["claimed_at"])
    own = spark.createDataFrame([("q", "g", 30, 0)], "queue string, group string, cursor bigint, committed bigint")
    rows = spark.createDataFrame([("q", "g", *x) for x in ops], "queue string, group string, seq bigint, op string, offset bigint, consumer string, to string")
    outcomes, left, _ = claims.settle(own, held, rows.withColumn("at", at(5)))
    want_left, want = plain_settle(start, ops)
    assert sorted((r.seq, r.op, r.ok) for r in outcomes.collect()) == want
    assert {r.offset: [r.consumer, r.deliveries] for r in left.collect()} == want_left

    delivers = [(i - 1000, "deliver", o, c, None) for i, (o, (c, _)) in enumerate(start.items())]
    every = spark.createDataFrame([("q", "g", o, s, op, c, t, 0) for s, op, o, c, t in delivers + ops], state.ENTRY_OPS)
    for low, high in ((-2000, 50), (50, 120), (120, 300)):
        every.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.stream_settle(follow(spark, str(tmp_path / "in"), every.schema))
    q = stream.writeStream.format("memory").queryName("settled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted((r.seq, r.op, r.ok) for r in spark.table("settled").collect() if r.seq >= 0) == want


def test_delivery_loop_carries_its_state(spark, group, tmp_path):
    msgs, own, _ = group
    own = own.withColumn("cursor", F.lit(0).cast("bigint"))
    none = spark.createDataFrame([], PENDING)
    schema = "queue string, group string, seq bigint, op string, offset bigint, consumer string, to string, at bigint, limit int"
    batches = [[("q", "g", 1, "claim", None, "a", None, 600, 3)], [("q", "g", 2, "ack", 0, "a", None, 601, None), ("q", "g", 3, "claim", None, "b", None, 602, 2)], [("q", "g", 4, "ack", 1, "a", None, 603, None)]]
    for i, rows in enumerate(batches):
        df = table(spark, rows, schema, ["at"]).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        delivery_loop(follow(spark, str(tmp_path / "in"), df.schema), msgs, own, none, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    given = spark.read.parquet(str(tmp_path / "out" / "delivered")).collect()
    assert sorted((r.offset, r.consumer) for r in given) == [(0, "a"), (1, "a"), (2, "a"), (3, "b"), (5, "b")]
    end = spark.read.parquet(str(tmp_path / "out" / "state=2" / "groups")).first()
    assert (end.cursor, end.committed) == (6, 2)


def test_replay(spark):
    ops = [("deliver", 1, "a"), ("nack", 1, None), ("deliver", 2, "a"), ("ack", 2, None), ("claim", 1, "b"), ("ack", 9, None), ("deliver", 3, "a"), ("ack", 3, None), ("deliver", 3, "c")]
    rows = spark.createDataFrame([("q", "g", i, op, o, c, 100 + i) for i, (op, o, c) in enumerate(ops)], "queue string, group string, seq int, op string, offset int, consumer string, ts int")
    got = {(r.offset, r.consumer, r.deliveries, r.last_attempt) for r in state.replay(rows).collect()}
    assert got == {(1, "b", 3, 104), (3, "c", 1, 108)}


@pytest.mark.parametrize("rows_per_range", [3, 200_000])
def test_token_bucket(spark, rows_per_range):
    rng = random.Random(2)
    rows = [("k", i, float(x)) for i, x in enumerate([0, 0, 0, 0.5, 1.0, 1.0, 10])]
    now = 100.0
    for i in range(700):
        now += rng.choice([0, 0.1, 0.5, 1.0, 4.0]) if i > 600 else rng.choice([0, 0.2, 0.9])
        rows.append(("busy", 100 + i, now))
    df = spark.createDataFrame(rows, "k string, i int, s double").withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")))
    out = {r.i: r.allowed for r in state.token_bucket(df, "k", "at", "i", rate=1, burst=2, rows_per_range=rows_per_range).collect()}
    assert [out[i] for i in range(7)] == [True, True, False, False, True, False, True]
    tokens, last = 2.0, None
    for _, i, s in sorted((r for r in rows if r[0] == "busy"), key=lambda r: (r[2], r[1])):
        s = int(s * 1e6) / 1e6
        tokens = tokens if last is None else min(2.0, tokens + max(0.0, s - last) * 1)
        last = s
        assert out[i] == (tokens >= 1), i
        tokens -= tokens >= 1


def test_offsets_stay_dense_over_batches(spark, tmp_path):
    rows = spark.range(40).select(F.lit("q").alias("queue"), F.col("id").alias("seq"))
    for i in range(4):
        rows.filter(F.col("seq") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.stream_offsets(follow(spark, str(tmp_path / "in"), rows.schema))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.offset for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))


def test_ranges_part_bursts_and_outliers(spark):
    rows = spark.range(3000).select(F.lit("q").alias("queue"), F.timestamp_seconds(F.when(F.col("id") < 2900, 7).otherwise(F.col("id") * 1_000_000)).alias("at"), "id")
    part = ranking.range_of(rows, [F.unix_micros("at"), F.col("id")], 100)
    sizes = [r[1] for r in rows.groupBy(part.alias("p")).count().collect()]
    assert len(sizes) >= 25 and max(sizes) < 400
    got = log.assign_offsets(rows, ["queue"], "at", ["id"], rows_per_range=100).orderBy("offset").collect()
    assert [r.offset for r in got] == list(range(3000)) == [r.id for r in got]


def test_totals_take_keys_of_any_name_and_null(spark):
    rows = spark.createDataFrame([(k, b, 1) for k in ("x", None) for b in range(9000)], "_inner string, b int, n int")
    out = ranking.totals_before(rows, ["_inner"], "b", "n", "before").filter("before <> b")
    assert out.count() == 0


def test_scan_carries_its_state_over_blocks(spark):
    df = spark.createDataFrame([(list(range(1000)),), ([],)], "xs array<int>")
    step = lambda s, x: ({"sum": s["sum"] + x}, s["sum"] + x)
    got = [r[0] for r in df.select(arrays.scan(F.col("xs"), {"sum": F.lit(0)}, step, "int")).collect()]
    assert got == [[i * (i + 1) // 2 for i in range(1000)], []]


def test_high_water_over_ranges(spark):
    rows = spark.createDataFrame([("q", "g", i, (i * 7919) % 1000) for i in range(500)], "queue string, group string, seq bigint, pel_size int")
    top = 0
    for r in groups.high_water(rows, rows_per_range=30).orderBy("seq").collect():
        top = max(top, r.pel_size)
        assert r.high_water == top


def test_members_and_references(spark):
    ops = [("join", 1), ("heartbeat", 2), ("leave", 3), ("heartbeat", 4), ("join", 5)]
    schema = "queue string, group string, consumer string, client_id string, node string, seq int, op string, at timestamp"
    rows = table(spark, [("q", "g", c, c, "n", s, op, s) for c, n in (("a", 5), ("b", 4)) for op, s in ops[:n]], schema, ["at"])
    assert [(r.consumer, r.registered_at.second, r.last_heartbeat.second) for r in consumers.members(rows).collect()] == [("a", 5, 5)]
    kinds = ["unsubscribe", "subscribe", "subscribe", "unsubscribe", "touch"]
    refs = table(spark, [("c", "q", "g", i, k, i) for i, k in enumerate(kinds)], "client_id string, queue string, group string, seq int, op string, at timestamp", ["at"])
    assert [(r.refs, r.last_seen.second) for r in consumers.references(refs).collect()] == [(1, 4)]
