"""Topic functions against a plain matcher over all short topics and filters."""

import itertools

import pytest
from pyspark.sql import functions as F

from logloom.functions import topics as t


#: Levels of topics, and of the filters beside them.
WORDS = ["k", "mm", "", "$x", "z.9"]
NAMES = ["/".join(p) for n in (1, 2, 3) for p in itertools.product([*WORDS, "+", "#"], repeat=n)]


def covered(f):
    """The topics of up to three levels over WORDS that a filter stands for, written out."""
    out = [()]
    for i, level in enumerate(f.split("/")):
        if level == "#":
            tails = [t for n in range(4) for t in itertools.product(WORDS, repeat=n)]
            # with levels before it, # also stands for none
            return {"/".join(o + t) for o in out for t in tails if (t or i) and len(o + t) <= 3}
        out = [(*o, x) for o in out for x in (WORDS if level == "+" else [level])]
    return {"/".join(o) for o in out}


COVERED = {f: covered(f) for f in NAMES if f}


def plain_match(f, topic, guard=True):
    """Membership in what the filter stands for; a topic always matches itself, the empty one nothing."""
    hidden = guard and topic[:1] == "$" and f[:1] != "$"
    return bool(f and topic) and (topic == f or (topic in COVERED[f] and not hidden))


VALID = [f for f in NAMES if f and "#" not in f.split("/")[:-1]]
TOPICS = [x for x in NAMES if not set("+#") & set(x)]


def pairs(spark, filters, topics):
    return spark.createDataFrame([(f, x) for f in filters for x in topics], "f string, t string")


def test_topic_match_equals_plain_matcher(spark):
    rows = pairs(spark, NAMES, TOPICS).withColumn("m", t.topic_match(F.col("f"), F.col("t"))).collect()
    assert not [r for r in rows if r.m != plain_match(r.f, r.t)]


def test_live_and_webhook_match_have_no_dollar_guard(spark):
    rows = pairs(spark, VALID, TOPICS).withColumns(
        {"live": t.live_match(F.col("f"), F.col("t")), "hook": t.webhook_match(F.col("f"), F.col("t"))}
    )
    for r in rows.collect():
        if r.t:
            assert r.live == plain_match(r.f, r.t, guard=False), r
            assert r.hook == plain_match(r.f, r.t, guard=False), r


def test_candidates_are_exactly_the_matching_filters(spark):
    shapes = [r[0] for r in spark.createDataFrame([(f,) for f in VALID], "f string").select(t.filter_shape(F.col("f"))).distinct().collect()]
    topics = spark.createDataFrame([(x,) for x in TOPICS], "t string").withColumn("c", t.candidate_filters(F.col("t"), shapes))
    found = {r.t: r.c for r in topics.collect()}
    for x in TOPICS:
        assert len(set(found[x])) == len(found[x])
        assert {f for f in VALID if plain_match(f, x)} == {f for f in found[x] if f in set(VALID)}, x


@pytest.mark.parametrize(
    "pattern, key, want",
    [("", "x", True), ("#", "", True), ("images/#", "images", False), ("images/#", "images/a/b", True), ("+/png", "a/png", True),
     ("+/png", "/png", False), ("a.b/+", "axb/c", False), ("a.b/+", "a.b/c", True), ("x", "x", True), ("x", "y", False), ("a#b", "a1/2b", True)],
)
def test_routing_key_filter(spark, pattern, key, want):
    assert spark.range(1).select(t.routing_key_match(pattern, key)).first()[0] is want


def test_routing_key_extraction(spark):
    cases = [
        ("$queue/tasks/images/png", "$queue/tasks", "images/png"), ("$queue/tasks", "$queue/tasks", ""), ("a/b/c", "+/b", "c"),
        ("a/b/c", "a/#", "b/c"), ("a/b", "x", ""), ("", "a", ""), ("a", "a/b", ""),
    ]
    rows = spark.createDataFrame(cases, "t string, r string, want string").withColumn("got", t.routing_key(F.col("t"), F.col("r")))
    assert not [r for r in rows.collect() if r.got != r.want]


def test_regex_characters_are_literal(spark):
    cases = [("a\\Eb/+", "a\\Eb/c", True), ("(a)/[b]", "(a)/[b]", True), (".*/x", "ab/x", False), ("+/#", "a", True)]
    rows = spark.createDataFrame(cases, "f string, t string, want boolean").withColumn("got", t.topic_match(F.col("f"), F.col("t")))
    assert not [r for r in rows.collect() if r.got != r.want]


def test_consumer_match(spark):
    cases = [
        ("q", "", "", "q", True), ("q", "a", "", "$queue/q", False), ("q", "", "", "$queue/q/x/y", True),
        ("q", "x/+", "", "$queue/q/x/y", True), ("q", "x", "", "$queue/q/y", False), ("", "", "s/#", "s/1", True), ("", "", "", "s", False),
    ]
    rows = spark.createDataFrame(cases, "q string, p string, f string, t string, want boolean")
    rows = rows.withColumn("got", t.consumer_match(F.col("q"), F.col("p"), F.col("f"), F.col("t")))
    assert not [r for r in rows.collect() if r.got != r.want]
