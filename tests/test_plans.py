"""What the plans must look like: equality joins only, filters and columns pushed to the scan."""

import functools
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logloom.plans import queries
from logloom.plans.base import Base

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")

JOINS = [
    "topic_bindings", "subscription_fanout", "subscription_effective_qos", "exchange_routing", "retained_match", "retained_replay",
    "webhook_match", "auto_create_targets", "forced_targets", "steal_outcome", "dead_letter", "consume_batches", "retention_truncate", "publish_grants",
    "claim_batch", "claim_idle", "settle_groups", "authorized_subscriptions", "group_round_robin",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINS)
def test_no_join_compares_all_pairs(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_reads_are_pushed_to_the_scan(spark):
    rows = Base(spark, DATA).messages
    text = plan(queries.log.read_range(rows, "all", 10, 20, 5).select("offset", "seq"))
    pushed = text[text.index("PushedFilters") :].splitlines()[0]
    assert "EqualTo(queue,all)" in pushed and "GreaterThanOrEqual(offset,10)" in pushed and "LessThan" in pushed
    assert "payload" not in text[text.index("ReadSchema") :].splitlines()[0]
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["token_bucket", "claim_batch", "settle_pending", "inflight_window", "assigned_offsets"])
def test_state_is_folded_without_python(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_queries_read_whole_tables():
    for name, sql in queries.ORACLE_SQL.items():
        assert "seq % 100 = 0" not in sql and '"offset" % 50 = 0' not in sql, name


def test_no_row_carries_the_list_of_members(spark):
    text = plan(queries.QUERIES["group_round_robin"](spark, DATA))
    assert "collect_list" not in text and "collect_set" not in text


def test_claims_have_no_limit_of_pending_entries_that_their_sql_lacks(spark, monkeypatch):
    from logloom.operators import claims

    given, claim = [], claims.claim_batch
    monkeypatch.setattr(claims, "claim_batch", lambda *a, **k: given.append(k.get("most_pending")) or claim(*a, **k))
    for name in ("claim_batch", "claim_pending", "claim_cursors", "claim_dead_letters", "claim_at_full_list"):
        queries.QUERIES[name](spark, DATA)
    assert given == [0, 0, 0, 0, 1]


def test_a_queue_is_not_put_in_one_task_to_meet_its_facts(spark, monkeypatch):
    from logloom.operators import claims, log
    from logloom.sources import tables as s

    # several ranges of offsets: with one its number is a constant, and no key
    monkeypatch.setattr(s, "assign_offsets", functools.partial(log.assign_offsets, rows_per_range=100))

    rows, by_queue = s.messages(spark, DATA), re.compile(r"(?:SortMergeJoin|ShuffledHashJoin) \[(?:queue|group)#\d+(?:, group#\d+)?\]")
    held = spark.createDataFrame([("all", "g", "", "queue", 9, 3, 0)], "queue string, group_id string, pattern string, mode string, cursor bigint, committed bigint, floor bigint")
    pending = s.pending(rows, held)
    asked = held.select("queue", F.col("group_id").alias("group"), "pattern", "cursor")
    policies = s.queues(spark)
    frames = [
        rows, pending, log.truncate(rows, held.select("queue", F.col("cursor").alias("keep_from"), F.col("cursor").alias("tail"))),
        log.offset_by_size(rows, F.lit(1), policies.select("queue", "max_bytes")), claims.next_rows(rows, asked, F.lit(3), s.AS_OF),
    ]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [by_queue.findall(plan(f.select("*"))) for f in frames] == [[]] * len(frames)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def under(text, mark):
    """The lines of a plan below the first one with ``mark``, as far as its subtree goes."""
    lines, depth = text.splitlines(), lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if mark in line)
    end = next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))
    return "\n".join(lines[at + 1 : end])


def test_the_log_is_numbered_in_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    """F8, F10, F11, F13: with few shuffle partitions a task's share of the log grew with the log; and publishes were shuffled by topic."""
    from logloom.operators import log, routing
    from logloom.sources import tables as s

    taken = routing.match_bindings(s.publishes(spark, DATA), s.bindings(spark))
    assert "rightHint=(strategy=broadcast)" in optimized(taken)
    taken = taken.select("queue", "seq", F.col("published_at").alias("created_at"))
    rows = log.assign_offsets(taken, ["queue"], "created_at", ["seq"], rows_per_range=100)
    n = -(-taken.count() // 100)
    assert n > 4 and re.search(rf"RepartitionByExpression \[.*\], {2 * n}\b", optimized(rows))
    monkeypatch.setattr(routing, "MAX_PAIRS", 0)
    plain = routing.match_bindings(s.publishes(spark, DATA), s.bindings(spark))
    assert "strategy=broadcast" not in optimized(plain)
    whole = log.assign_offsets(plain.select("queue", "seq", F.col("published_at").alias("created_at")), ["queue"], "created_at", ["seq"])
    assert sorted(map(tuple, rows.select("queue", "offset", "seq").collect())) == sorted(map(tuple, whole.select("queue", "offset", "seq").collect()))


def test_high_water_is_dealt_by_number(spark):
    """with few shuffle partitions a task's share of the entries grew with them."""
    from logloom.operators import groups
    from logloom.operators.ranking import DIRECT

    sizes = [("q", "g", i, (i * 7919) % 101) for i in range(300)]
    out = groups.high_water(spark.createDataFrame(sizes, "queue string, group string, seq long, pel_size long"), rows_per_range=40)
    assert re.search(rf"RepartitionByExpression \[.*\], {DIRECT}\b", optimized(out))
    assert {r.seq: r.high_water for r in out.collect()} == {i: max(x[3] for x in sizes[: i + 1]) for i in range(300)}


def test_offset_by_size_looks_at_the_rows_of_one_range(spark):
    """all rows of a limited queue were sorted and summed, though its limit is passed in one range."""
    import random

    from logloom.operators import log

    rnd, rows, limits, want = random.Random(3), [], [], {}
    for i in range(40):
        sizes = [rnd.choice([None, 0, 0, 1, 5, 30]) for _ in range(rnd.randrange(1, 60))]
        head, most = rnd.randrange(0, 25), rnd.choice([0, 1, 5, 40, 200, 10_000])
        limits.append((f"q{i}", most))
        rows += [(f"q{i}", head + k, x) for k, x in enumerate(sizes)]
        over = [head + k + 1 for k in range(len(sizes)) if sum(x or 0 for x in sizes[k:]) > most]
        if most > 0:
            want[f"q{i}"] = max(over, default=head)
    out = log.offset_by_size(spark.createDataFrame(rows, "queue string, offset long, size long"), F.col("size"), spark.createDataFrame(limits, "queue string, max_bytes long"), rows_per_range=10)
    assert {r.queue: r.by_size for r in out.collect()} == want
    assert "AS _after#" in under(optimized(out), "AS _in#")
