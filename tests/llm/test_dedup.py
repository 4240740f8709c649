"""SimHash, substring and line dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from logloom.llm import graph, lines, simhash, substrings

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text):
    return (text or "").translate(LOW).encode().split()


def fingerprint(text, shingle):
    w = split_words(text)
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(values, link):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if link(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(docs, raw):
    out = simhash.near_duplicates(docs, shingle=4, words=1, radius=4, segments=4, tile=16).collect()
    prints = [fingerprint(r[1], 4) for r in raw]
    found = classes(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for c, r in zip(found, raw):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), p, str(least.get(c))) for r, p, c in zip(raw, prints, found))
    assert sorted((str(r.doc_id), r.fp[0] % 2**64, str(r.component)) for r in out) == want


@pytest.mark.parametrize("segments, radius, words", [(1, 12, 1), (4, 4, 1), (2, 6, 1), (1, 51, 4)])
def test_links_are_complete_over_tiles(spark, segments, radius, words):
    rng = random.Random(segments)
    base = [[rng.getrandbits(64) for _ in range(words)] for _ in range(30)]
    rows = {tuple(x) for x in base}
    for x in base[:20]:
        y = list(x)
        for _ in range(rng.randint(1, radius)):
            k = rng.randrange(words)
            y[k] ^= 1 << rng.randrange(64)
        rows.add(tuple(y))
    rows = sorted(rows)
    df = spark.createDataFrame([([int(np.uint64(p).view(np.int64)) for p in r],) for r in rows], "fp array<bigint>")
    first = radius if words == 1 else 64
    edges = simhash.near_links(df, words, radius, first, segments, tile=3)
    got = {}
    for r in graph.connected_components(edges).collect():
        got.setdefault(tuple(r.root), set()).add(tuple(r.node))
    link = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b)) <= radius
    want = collections.defaultdict(set)
    for r, c in zip(rows, classes(rows, link)):
        want[c].add(tuple(int(np.uint64(p).view(np.int64)) for p in r))
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_default_links_do_not_depend_on_the_first_part(spark):
    rng = random.Random(9)
    rows, want = [], 0
    for parts in [(51, 0, 0, 0), (21, 10, 10, 10), (0, 0, 0, 51), (25, 26, 0, 0), (40, 0, 0, 11), (51, 1, 0, 0)]:
        x = [rng.getrandbits(64) for _ in range(4)]
        y = [v ^ sum(1 << b for b in rng.sample(range(64), n)) for v, n in zip(x, parts, strict=True)]
        rows += [x, y]
        want += sum(parts) <= 51
    df = spark.createDataFrame([([int(np.uint64(p).view(np.int64)) for p in r],) for r in rows], "fp array<bigint>")
    assert simhash.near_links(df, 4, 51, None, 1, tile=3).distinct().count() == want == 5


def test_keep_first_and_empty(docs, none, raw):
    kept = simhash.keep_first(docs).collect()
    assert kept and len({r.doc_id for r in kept if r.doc_id is not None}) == len([r for r in kept if r.doc_id is not None])
    assert 0 in {r.doc_id for r in kept} and 120 not in {r.doc_id for r in kept}
    assert simhash.near_duplicates(none).count() == 0


def test_every_class_keeps_one_row_when_ids_repeat(spark, docs, raw):
    kept = [r for r in simhash.keep_first(docs).collect() if r.doc_id is not None]
    assert [sum(r.text == raw[k][1] for r in kept) for k in (3, 4)] == [1, 1]
    assert {r.component for r in simhash.near_duplicates(docs).collect() if r.doc_id == 5} == {5}
    rows = [(5, "one text of its own here", "a"), (5, "quite another one that is longer", "a"), (5, "quite another one that is longer", "b"), (7, "one text of its own here", "c")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    for some in (df, df.filter("doc_id = 5")):
        assert sorted(r.text for r in simhash.keep_first(some).collect()) == [rows[0][1], rows[1][1]]


@pytest.mark.parametrize("most", [2, 0])
def test_links_are_confirmed_by_their_shingles(spark, monkeypatch, most):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = ["a " * 40 + word(), "a " * 90 + word(), "", None]
    footer = " ".join(word() for _ in range(8))
    texts += [f"{word()} {word()} " + f"{footer} " * 30 + f"{word()} {word()} {word()}" for _ in range(6)]
    for changes in (2, 6, 10, 12, 14, 16) * 3:
        w = [word() for _ in range(300)]
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for at in rng.sample(range(300), changes):
                v[at] = word()
            texts.append(" ".join(v))

    def shingles(t):
        w = split_words(t)
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    values = [(shingles(t), simhash.shingle_fingerprint(t, 5, 4, True)) for t in texts]
    near = lambda a, b: sum(bin((x ^ y) % 2**64).count("1") for x, y in zip(a[1], b[1])) <= 64
    alike = lambda a, b: a[0] == b[0] or 25 * len(a[0] & b[0]) ** 2 >= 16 * len(a[0]) * len(b[0]) > 0
    want = classes(values, lambda a, b: near(a, b) and alike(a, b))
    assert want != classes(values, near)
    monkeypatch.setattr(simhash, "CANDIDATES", most)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.doc_id: r.component for r in simhash.near_duplicates(df, similarity=0.8, tile=16).collect()}
    assert [out[i] for i in range(len(texts))] == want
    if most:
        assert sorted(r.doc_id for r in simhash.keep_first(df, similarity=0.8).collect()) == sorted(set(want))


def test_near_copies_over_the_threshold_are_found(spark):
    rng = random.Random(3)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    rows, copies = [], 0
    for i in range(60):
        w = [rng.choice(voc) for _ in range(300)]
        rows.append((2 * i, " ".join(w)))
        for at in rng.sample(range(300), 3):  # each change spoils five shingles of about 600 in the union
            w[at] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    together = sum(r.component == r.doc_id - 1 for r in out if r.doc_id % 2)
    assert together >= 58
    assert all(r.component in (r.doc_id, r.doc_id - 1) for r in out)


def removed(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        runs = [x for x in bytes(gone).split(b"\0") if x]
        out.append((len(d), sum(gone), len(runs), bytes(c for c, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("least, anchor_rows", [(40, 20_000), (200, 20_000), (200, 1), (200, 3)])
def test_substrings_equal_brute_force(docs, raw, least, anchor_rows):
    want = collections.Counter((str(r[0]), *x) for r, x in zip(raw, removed([r[1] for r in raw], least)))
    out = substrings.remove_repeats(docs, least=least, anchor_rows=anchor_rows).collect()
    assert collections.Counter((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out) == want


def test_slices_of_a_long_text_keep_every_window(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    monkeypatch.setattr(substrings, "SLICE", 700)
    starts = [s for _, _, first, last in substrings.anchored_runs(data) for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == list(range(len(data) - 199))


def test_substrings_of_nothing(none):
    assert substrings.remove_repeats(none).count() == 0


def test_lines_equal_brute_force(docs, none, raw):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holds = collections.defaultdict(set)
    for r in raw:
        for x in (r[1] or "").split("\n"):
            if r[0] is not None:
                holds[key(x)].add(r[0])
    want = []
    for r in raw:
        all_lines = (r[1] or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= 10 and len(holds[key(x)]) > 1 and min(holds[key(x)]) != r[0])]
        text = "\n".join(kept)
        want.append((str(r[0]), len(all_lines), len(all_lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    out = lines.drop_repeated_lines(docs).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256, r.kept_text) for r in out) == sorted(want)
    assert lines.drop_repeated_lines(none).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    mph = lines.PerfectHash.build(keys)
    assert sorted(mph.index(keys)) == list(range(len(keys)))
    assert lines.PerfectHash.build(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]


def test_lines_that_share_half_their_hash_are_told_apart():
    h = np.array([[5, 1 << 50], [5, 3 << 50], [5, 7 << 50], [9, 11 << 50], [4, 5]], np.uint64)
    counts, keepers = np.array([1, 2, 300, 0, 2]), np.arange(5) + 10
    names = ["seed", "sizes", "bits", "prints", "counts", "keepers"]
    shard = lines.Shard(dict(zip(names, lines.pack(h, counts, keepers), strict=True)))
    count, keeper = shard.probe(h)
    assert sorted(shard.mph.index(lines._joint(h, shard.seed))) == list(range(5))
    assert count.tolist() == [1, 2, 255, 0, 2] and keeper.tolist() == [0, 11, 12, 0, 14]


def test_lines_by_small_chunks_and_shards(docs):
    want = sorted(map(str, lines.drop_repeated_lines(docs).collect()))
    assert sorted(map(str, lines.drop_repeated_lines(docs, shard_keys=7, chunk_bytes=500).collect())) == want


@pytest.mark.parametrize(("words", "radius", "first_radius"), [(4, 51, 51), (4, 51, 9), (1, 4, 4), (2, 20, 20), (4, 200, 64)])
def test_pairs_of_tiles_are_those_of_brute_force(words, radius, first_radius):
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**63), 2**63, (150, words), dtype=np.int64).view(np.uint64)
    flips = np.packbits(rng.random((90, words * 64)) < radius / words / 64, axis=1).view(np.uint64)
    y = np.concatenate([x[:90] ^ flips, x[90:100], x[:5]])
    for right in (y, None):
        both = x if right is None else np.concatenate([x, y])
        apart = np.bitwise_count(both[:, None] ^ both[None])
        near = (apart.sum(axis=2, dtype=int) <= radius) & (apart[:, :, 0] <= first_radius)
        wanted = {(r, c) for r, c in np.argwhere(near).tolist() if r < c and (right is None or r < len(x) <= c)}
        assert {(r, c) for a, b in simhash.near_pairs(x, right, radius, first_radius) for r, c in zip(a.tolist(), b.tolist())} == wanted


def test_few_unrelated_fingerprints_are_compared_in_full():
    lead = simhash.lead_parts(4, 51)
    x = np.random.default_rng(6).integers(0, 2**32, (2000, lead), dtype=np.uint32)
    passed = np.bitwise_count(x[:1000, None] ^ x[None, 1000:]).sum(axis=2, dtype=int) <= 51
    assert lead < 8 and passed.mean() < 1e-4


def test_every_distinct_shingle_is_hashed_once_for_each_part(monkeypatch):
    seen, digest = [], simhash.xxhash.xxh64_intdigest
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", lambda x, seed: seen.append((x, seed)) or digest(x, seed))
    simhash.shingle_fingerprint("a b c d e f g h", 5, 4, distinct=True)
    assert len(seen) == 16 == len(set(seen))
