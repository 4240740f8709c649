"""Every stage of the pipeline against brute force, on awkward rows."""

import collections
import hashlib
import re
import zlib

import pytest
import xxhash
from test_dedup import classes, split_words
from test_filters import brute, items_for

import corpus_pipeline
from logloom.llm import mixing

STAGES = dict(corpus_pipeline.STAGES)
key = lambda r: (str(r.doc_id), r.text, r.lang, r.source, r.n_chars)


@pytest.fixture(scope="module")
def folder(spark, docs, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(items_for(raw), "item_id int, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def own(docs):
    return docs.select(*corpus_pipeline.COLUMNS)


def test_language_stage(spark, own, folder):
    rows = own.collect()
    want = collections.Counter(key(r) for r in rows if any(map(str.isalpha, r.text or "")))
    assert collections.Counter(map(key, STAGES["language_id"](spark, own, folder).collect())) == want


def test_near_duplicate_stage(spark, own, folder):
    rows = own.collect()

    def parts(t):
        w = split_words(t)
        shingles = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        hashes = [[xxhash.xxh64_intdigest(x, 42 + k) for x in shingles] for k in range(4)]
        return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in hashes]

    values = [parts(r.text) for r in rows]
    found = classes(values, lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b)) <= 51)
    ids = collections.defaultdict(set)
    for c, r in zip(found, rows):
        ids[r.doc_id].add(c)
    kept = collections.Counter(map(key, STAGES["simhash_near_dedup"](spark, own, folder).collect()))
    assert not kept - collections.Counter(map(key, rows))
    assert sum(k[0] == "None" for k in kept.elements()) == sum(r.doc_id is None for r in rows)
    for c in set(found):
        members = [r for f, r in zip(found, rows) if f == c and r.doc_id is not None]
        if members:
            # the smallest id that stands in no other class, if there is one
            best = min((len(ids[r.doc_id]) > 1, r.doc_id) for r in members)[1]
            mine = {key(r) for r in members}
            assert [k[0] for k in kept.elements() if k in mine and (k[0] == str(best) or len(ids[int(k[0])]) == 1)] == [str(best)]


def test_decontamination_stage(spark, own, raw, folder):
    rows = own.collect()
    hits = brute([r.text for r in rows], items_for(raw))
    want = collections.Counter(key(r) for r, h in zip(rows, hits) if not h[1])
    assert collections.Counter(map(key, STAGES["benchmark_decontamination"](spark, own, folder).collect())) == want


def test_mixing_stage(spark, own, folder):
    found = own.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    some = spark.createDataFrame(found, own.schema)
    rows = [(r, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in found]
    totals = collections.Counter()
    for r, n in rows:
        totals[(r.source,)] += n
    targets = mixing.by_source_weights(dict(totals))
    want = collections.Counter()
    for source, target in targets.items():
        mine = [(r, n) for r, n in rows if r.source == source]
        full, left = divmod(int(target), totals[(source,)]) if totals[(source,)] else (0, 0)
        for r, n in sorted(mine, key=lambda x: hashlib.md5(f"logloom:{x[0].doc_id}:{x[1]}".encode()).hexdigest()):
            taken, left = n * full + min(n, left), max(left - n, 0)
            want[key(r)] += int(taken / max(n, 1) + 0.5)
    assert collections.Counter(map(key, STAGES["source_mixing"](spark, some, folder).collect())) == +want


def test_sharding_stage(spark, own, folder):
    out = STAGES["sharding"](spark, own.unionByName(own), folder).collect()
    rows = own.collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    want = collections.Counter((str(r.doc_id), r.source, r.lang, r.n_chars, crc(r.text)) for r in rows)
    got = collections.Counter((str(r.doc_id), r.source, r.lang, r.n_chars, r.text_crc32) for r in out)
    assert got == want + want and len({(r.shard, r.slot) for r in out}) == len(out)
    sizes = collections.Counter(r.shard for r in out)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1


def test_stages_in_turn_and_of_nothing(spark, own, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, own.limit(0), folder)
        assert none.count() == 0
        assert name == "sharding" or none.columns == corpus_pipeline.COLUMNS
