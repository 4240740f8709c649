"""Mixing, sharding, weighted fingerprints, WARC and the pipeline."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from logloom.llm import mixing, sharding, warc, weighted
from logloom.llm.queries import QUERIES


def test_shards_follow_the_mixture(docs, none, raw):
    out = sharding.interleave(docs, 7, rows_per_bucket=5).collect()
    assert collections.Counter((str(r.doc_id), r.size, r.text_crc32) for r in out) == collections.Counter(
        (str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in raw
    )
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    for source in ("a", "b", None):
        counts = [sum(r.source == source for r in rows) for rows in by.values()]
        assert max(counts) - min(counts) <= 2
    assert sharding.interleave(none).count() == 0


def test_shards_equal_a_plain_ranking(docs, raw):
    md5 = lambda i, crc: hashlib.md5(f"logloom:{i}:{crc}".encode()).hexdigest()
    out = sharding.interleave(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), 4, rows_per_bucket=3).collect()
    groups = collections.defaultdict(list)
    for r in out:
        groups[r.source].append(r)
    order = []
    for source, g in groups.items():
        for i, r in enumerate(sorted(g, key=lambda r: md5(r.doc_id, r.text_crc32))):
            order.append(((2 * i + 1) / (2 * len(g)), source is None, source or "", md5(r.doc_id, r.text_crc32), r))
    order = [x[-1] for x in sorted(order, key=lambda x: x[:-1])]
    assert [r.shard for r in order] == [i * 4 // len(order) for i in range(len(order))]


def test_targets_share_the_excess():
    t = mixing.shared_targets([100, 10, 10], [3, 1, 2])
    assert sum(t) == pytest.approx(180) and t[1:] == [20.0, 20.0]
    assert mixing.shared_targets([0, 0], [3, 1]) == [0.0, 0.0]
    assert mixing.shared_targets([], []) == []


def test_flow_uses_overlaps_and_spreads_repeats():
    patterns = [(("a",), 10), (("b",), 10), (("a", "b"), 10)]
    flow = mixing.min_cost_flow(patterns, {"a": 15, "b": 15})
    assert [sum(f.values()) for f in flow] == [10, 10, 10]  # no repeats while first copies last
    flow = mixing.min_cost_flow(patterns, {"a": 40, "b": 0})
    assert sum(f.get("a", 0) for f in flow) == 40
    assert sum(sum(f.values()) for f in mixing.min_cost_flow(patterns, {"a": 1000, "b": 0})) == 40
    apart = [((i,), i) for i in range(20_000)]
    flow = mixing.min_cost_flow([*apart, (("x",), 5)], {i: 1.5 * i for i in range(20_000)})
    assert [sum(f.values()) for f in flow] == [int(1.5 * i) for i in range(20_000)] + [0]


def test_flow_is_maximal_and_cheapest():
    rng = random.Random(1)
    for _ in range(40):
        sources = "abc"[: rng.randint(1, 3)]
        patterns = [(tuple(rng.sample(sources, rng.randint(1, len(sources)))), rng.randint(0, 3)) for _ in range(rng.randint(1, 3))]
        quotas = {s: rng.randint(0, 6) for s in sources}
        arcs = [(p, s) for p, (members, _) in enumerate(patterns) for s in members]
        best = (0, 0)
        for amounts in itertools.product(*[range(min(2 * patterns[p][1], quotas[s]) + 1) for p, s in arcs]):
            used, filled = collections.Counter(), collections.Counter()
            for (p, s), n in zip(arcs, amounts):
                used[p] += n
                filled[s] += n
            if all(used[p] <= 2 * t for p, (_, t) in enumerate(patterns)) and all(filled[s] <= quotas[s] for s in sources):
                repeated = sum(max(0, used[p] - t) for p, (_, t) in enumerate(patterns))
                best = max(best, (sum(amounts), -repeated))
        flow = mixing.min_cost_flow(patterns, quotas)
        repeated = sum(max(0, sum(f.values()) - t) for f, (_, t) in zip(flow, patterns))
        assert (sum(sum(f.values()) for f in flow), -repeated) == best
        assert all(set(f) <= set(m) for f, (m, _) in zip(flow, patterns))


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 50), rng.choice([["a"], ["b"], ["a", "b"], ["b", "c"], [None, "c"]]), "mine") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, words int, members array<string>, _h string")
    quotas = {"a": 4000, "b": 3000, "c": 2500, None: 1000}
    out, _ = mixing.mix(df, "words", "members", quotas)
    got = out.collect()
    assert out.columns == [*df.columns, "taken"] and {r._h for r in got} == {"mine"}
    totals, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r.taken <= 2 * r.words
        totals[tuple(r.members)] += r.words
        taken[tuple(r.members)] += r.taken
    flow = dict(zip(totals, (sum(f.values()) for f in mixing.min_cost_flow(list(totals.items()), quotas))))
    repeated = lambda x: sum(max(0, x[k] - totals[k]) for k in totals)
    assert sum(taken.values()) == sum(flow.values()) and repeated(taken) == repeated(flow)


def test_mix_meets_its_targets(docs, none, raw):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(raw)
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix_sources(none).count() == 0


def bag(a, b):
    a, b = collections.Counter(a.lower().split()), collections.Counter(b.lower().split())
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0


def test_collision_rate_is_the_generalised_jaccard(spark):
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(voc, weights=range(1, 61), k=rng.randint(20, 120)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = weighted.fingerprint_pairs(df, samples=256, rows_per_range=20)
    got = {r.doc_id: r for r in out.select("doc_id", "n_chars", "edited_sha256", weighted.likeness(out.marks, out.edited_marks, 256).alias("e"), weighted.likeness(out.marks, out.next_marks, 256).alias("n")).collect()}
    text, errors = dict(rows), []
    for i, t in rows:
        other = text[(i - 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        errors += [got[i].e - bag(t, edited), got[i].n - bag(t, other)]
    assert abs(sum(errors) / len(errors)) < 0.01
    assert max(map(abs, errors)) < 0.16


def edited_by_rank(rows):
    """Rows (id, text) in descending order with the edited text of each; ``rows`` hold their text's hash."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -r[2], r[1]))
    for k, (i, t, _) in enumerate(order):
        yield i, t, t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]


@pytest.mark.parametrize("rows_per_range", [1, 6, 1000])
def test_weighted_edges(docs, none, rows_per_range):
    out = weighted.fingerprint_pairs(docs, samples=4, rows_per_range=rows_per_range).collect()
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    want = collections.Counter((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in edited_by_rank([tuple(r) for r in hashed]))
    assert collections.Counter((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == want
    assert weighted.fingerprint_pairs(none, samples=4).count() == 0


def test_draws_equal_plain_arithmetic(spark):
    texts = ["a b a C c c", "one two two", "", "é \t x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.marks for r in weighted.fingerprint_pairs(df, samples=3).collect()}
    gamma = [round(weighted._gamma_quantile((i + 0.5) / weighted.STEPS), 6) for i in range(weighted.STEPS)]
    for i, t in enumerate(texts):
        terms = collections.Counter(t.lower().split()) or {None: 1}
        # a text without words draws from the null term
        term = F.when(F.col("w").isNotNull(), F.xxhash64("w"))
        hashes = spark.createDataFrame([(w,) for w in terms], "w string").select("w", *[F.xxhash64(term, F.lit(d)).alias(f"h{d}") for d in range(3)]).collect()
        for d in range(3):
            draws = []
            for r in hashes:
                h = r[f"h{d}"] % 2**64
                gr, gc, b = gamma[h >> 54], gamma[h >> 44 & 1023], ((h >> 24 & 0xFFFFF) + 0.5) / 2**20
                level = math.floor(math.log(terms[r.w]) / gr + b)
                draws.append((math.log(gc) - gr * (level - b + 1), (r[f"h{d}"] + level * 0x9E3779) & 0xFFFF))
            assert got[i][d] == min(draws)[1]


def test_ranges_stay_small_with_outliers_and_nulls(spark):
    few = [(i if i < 19_000 else None, f"text {i}") for i in range(20_000)] + [(10**15, "far")] + [(77, f"again {i}") for i in range(5000)]
    df = spark.createDataFrame(few, "doc_id bigint, text string")
    sizes = [r[1] for r in weighted.with_next(df, "doc_id", "text", 1000).groupBy("range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 3000


def test_warc_round_trip(spark):
    rng = random.Random(1)
    long = ["<html>" + "".join(rng.choice("abc é") for _ in range(1500)) for _ in range(3)]
    pages = [(i, f"http://s{i % 3}.example.com/p/{i}?q=é\nx", rng.choice(long)) for i in range(40)]
    pages += [(100, None, "short"), (101, "not a url", "short"), (102, "http://[bad/", None), (103, "", ""), (104, "http://a.b/", long[0] + "\r\n\r\nWARC/1.1\r\n\x00")]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id bigint, url string, html string, page int, payload string").repartition(4)
    best = collections.defaultdict(int)
    for i, _, html in pages:
        best[html or ""] = max(best[html or ""], i)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and best[html] != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best[html] if revisit else None))
    out = warc.archive_pages(df).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_index_look_up(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"body {i}") for i in range(300)], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/warc"
    captures = warc.write_archives(warc.roles(pages, "page_id", "url", "html"), path, file_bytes=2000)
    blocks = warc.build_index(captures, block_records=16)
    keys = spark.createDataFrame([(warc.capture_key("http://h3.org/3", 3),), ("zzz",), ("",), (None,)], "key string")
    for bound in (1_000_000, 4, 1):  # an entry a block, and entries for runs of blocks
        located = warc.look_up(keys, blocks, max_directory=bound)
        assert [(r.page, bytes(r.payload)) for r in warc.read_ranges(located, path).collect()] == [(3, b"body 3")]
    everything = captures.select("key")
    for bound in (1_000_000, 4, 1):
        assert warc.look_up(everything, blocks, max_directory=bound).select("key").distinct().count() == 300
    assert warc.url_key("http://WWW.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"body {i} " * 200) for i in range(60)], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/warc"
    captures = warc.write_archives(warc.roles(pages.repartition(4), "page_id", "url", "html"), path, file_bytes=2000)
    files = captures.select("file").distinct().count()
    records = warc.read_archives(captures, path)
    assert files >= 4 and records.rdd.getNumPartitions() == min(files, spark.sparkContext.defaultParallelism)
    assert records.count() == 60


def test_warc_takes_repeated_and_null_ids_and_long_payloads(spark):
    long, other = "é" * 700_000, "y" * 1200
    rows = [(1, "http://a/", long), (1, "http://b/", long), (2, "http://a/", long), (None, "http://a/", long), (None, None, other), (3, "", other), (3, "u", "short")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    # a null id is never the one referred to, nor a revisit
    assert out == sorted([("1", 1_400_000, "revisit", 2)] * 2 + [("2", 1_400_000, "response", None), ("None", 1_400_000, "response", None), ("None", 1200, "response", None), ("3", 1200, "response", None), ("3", 5, "response", None)])


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
