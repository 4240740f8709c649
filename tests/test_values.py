from pyspark.sql import functions as F

from logloom.functions import values as v


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv(spark):
    for x in ("", "a", "consumer-1", "é"):
        assert one(spark, v.fnv1a_32(F.lit(x)))[0] == fnv(x)


def test_properties(spark):
    props = F.create_map(F.lit("queue"), F.lit("forged"), F.lit("own"), F.lit("1"))
    p = one(spark, v.delivery_properties(props, F.lit("g"), F.lit("q"), F.lit(7), F.lit("t")))[0]
    assert p == {"own": "1", "message-id": "q:7", "group-id": "g", "queue": "q", "offset": "7", "x-source-topic": "t"}
    assert one(spark, v.strip_delivery_properties(F.lit(None).cast("map<string,string>")))[0] is None
    assert one(spark, v.strip_delivery_properties(props))[0] == {"own": "1"}


def test_publish_properties_drop_internal_keys(spark):
    user = F.create_map(F.lit("_in.x"), F.lit("1"), F.lit("y"), F.lit("2"))
    p = one(spark, v.publish_properties(user, F.lit("text/plain"), F.lit(""), F.lit(b"ab"), F.lit(1), "_in."))[0]
    assert p == {"y": "2", "content-type": "text/plain", "correlation-id": "YWI=", "payload-format": "1"}


def test_sizes_and_ratios(spark):
    none = F.lit(None).cast("map<string,string>")
    assert one(spark, v.message_size(F.lit("ab"), F.lit("é"), F.lit(None).cast("string"), none))[0] == 204
    assert one(spark, v.delivery_ratio(F.lit(1), F.lit(0)), v.delivery_ratio(F.lit(1), F.lit(2)))[:] == (1.0, 0.5)
    assert one(spark, v.payload_id(F.lit("id|x")), v.payload_id(F.lit("|x")), v.payload_id(F.lit("z" * 70)))[:] == ("id", "|x", "z" * 64)
    assert one(spark, v.link_cursor(F.lit("12x"))["offset"], v.link_cursor(F.lit("latest"))["position"])[:] == (12, "latest")
    assert one(spark, v.ttl_seconds(F.lit("1500")), v.ttl_seconds(F.lit("-1")), v.int_argument(F.lit(" +7 ")))[:] == (1.5, None, 7)
