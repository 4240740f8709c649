"""SimHash near-dedup by tiled exact comparison.

Fingerprints are dealt into cells by their population counts and cells into tiles of
bounded size. Pairs of tiles whose population counts differ by more than the radius
are never formed; all others are compared in full with numpy exclusive-or and bit
counts. A tile pair yields a spanning forest of its links, never all pairs.

Population counts are taken over SEGMENTS equal parts of a fingerprint's first 64
bits: two fingerprints within the radius differ in these counts by at most the radius
in sum, so a finer split skips more pairs and loses none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import hot_keys, spread_join
from ..session import ship
from .common import forget, written
from .common import table as read_table
from .graph import connected_components

#: Shingle hashes turned into bits at once, and rows compared at once.
BLOCK = 1 << 15
ROWS = 64
COLUMNS = 4096
#: Pairs a row of a tile pair up to which all are compared at once; a tile pair with more
#: gives two for each row first, then those that are still in different classes.
CANDIDATES = 2
#: Parts of a row after the fingerprint: its text's key and its number of distinct shingles.
KEYED = 3
#: Texts that a task remembers so as to give repeated ones once.
SEEN = 1_000_000


def _shingles(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased words, joined by one space, and the bounds of each shingle in them."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return b"", [], []
    n = max(1, len(tokens) - shingle + 1)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    return b" ".join(tokens), starts, (ends - 1)[min(shingle, len(tokens)) - 1 :].tolist()


def _pieces(joined: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
    return [joined[a:b] for a, b in zip(starts, ends, strict=True)]


def _digests(pieces: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, itertools.repeat(seed)), np.uint64, len(pieces))


def _hashes(joined: bytes, starts: list[int], ends: list[int], seed: int) -> np.ndarray:
    return _digests(_pieces(joined, starts, ends), seed)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def shingle_fingerprint(text: str | None, shingle: int, words: int, distinct: bool = False) -> list[int]:
    """64-bit parts of the SimHash: part k takes the XXH64 hashes with seed 42 + k.

    With ``distinct`` a shingle counts once, however often it stands in the text. Every
    shingle that counts is cut out and hashed once for each part.
    """
    joined, starts, ends = _shingles(text, shingle)
    if not starts:
        return [0] * words
    bits = np.zeros((words, 64), np.int64)
    first = None
    if distinct:
        first, at = np.unique(_hashes(joined, starts, ends, 42), return_index=True)
        starts, ends = [starts[i] for i in at.tolist()], [ends[i] for i in at.tolist()]
    n = len(starts)
    for at in range(0, n, BLOCK):
        pieces = _pieces(joined, starts[at : at + BLOCK], ends[at : at + BLOCK])
        for k in range(words):
            bits[k] += _ones(_digests(pieces, 42 + k) if k or first is None else first[at : at + BLOCK])
    return [int(x) for x in np.packbits(2 * bits > n, axis=1, bitorder="little").view(np.int64)[:, 0]]


def _keyed(text: str | None, shingle: int) -> list[int]:
    joined, starts, ends = _shingles(text, shingle)
    return [*text_key(joined), len({joined[a:b] for a, b in zip(starts, ends, strict=True)})]


def text_key(joined: bytes) -> list[int]:
    """128 bits that tell texts of different words apart."""
    return np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64).tolist()


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int, texts: bool = False, distinct: bool = False
) -> DataFrame:
    """(id, text_hash, fp: array of ``words`` 64-bit parts) of every row, over whole texts.

    With ``distinct`` each shingle of a text counts once; with ``texts`` too, and the
    text's key and the number of its shingles follow the parts.
    """
    distinct = distinct or texts

    def run(batches):
        for b in batches:
            parts = [
                shingle_fingerprint(t, shingle, words, distinct) + (_keyed(t, shingle) if texts else [])
                for t in b.column(2).to_pylist()
            ]
            columns = [b.column(0), b.column(1), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, fp array<bigint>")


def _offsets(segments: int, radius: int) -> list[list[int]]:
    """Differences of two cells within the radius, one of each opposite pair, zero first."""
    width = 64 // segments
    reach = range(-min(radius, width), min(radius, width) + 1)
    near = [list(o) for o in itertools.product(reach, repeat=segments) if sum(map(abs, o)) <= radius]
    return [o for o in near if o >= [0] * segments]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges (a, b) of small integers."""
    size = int(max(a.max(), b.max())) + 1
    label = np.arange(size)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    nodes = np.flatnonzero(label != np.arange(size))
    return nodes, label[nodes]


def lead_parts(words: int, radius: int) -> int:
    """Parts of 32 bits that are compared for all pairs: as many as it takes to leave a few pairs in a million of unrelated texts.

    Parts of these differ in 16 bits, give or take 2.8; every pair within the radius is left.
    """
    return next((k for k in range(1, 2 * words) if 16 * k - 13 * k**0.5 >= radius), 2 * words)


def near_pairs(left: np.ndarray, right: np.ndarray | None, radius: int, first_radius: int):
    """Index arrays (r, c), r < c, of the pairs of two tiles [row, part], or within one, block by block.

    Indexes of ``right`` follow those of ``left``. The leading parts (lead_parts) are
    compared for all pairs, in arrays used again for each block, the others for the
    pairs left.
    """
    same = right is None
    right = left if same else right
    base, words = 0 if same else len(left), left.shape[1]
    if not len(left) or not len(right):
        return
    bounded = first_radius < min(64, radius)
    lead = 2 if bounded else lead_parts(words, radius)
    whole = lead // 2
    rows, cols = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    ahead = [(rows[k], cols[k]) for k in range(whole)]
    if lead % 2:
        ahead.append((rows[whole].astype(np.uint32), cols[whole].astype(np.uint32)))
    high, wide = min(ROWS, len(left)), min(COLUMNS, len(right))
    spaces = {kind: np.empty(high * wide, kind) for kind in {x.dtype for x, _ in ahead}}
    counts, totals = np.empty(high * wide, np.uint8), np.empty(high * wide, np.uint8 if lead < 8 else np.uint16)
    for i in range(0, len(left), ROWS):
        h = min(ROWS, len(left) - i)
        for j in range(i if same else 0, len(right), COLUMNS):
            w = min(COLUMNS, len(right) - j)
            total = totals[: h * w]
            for k, (x, y) in enumerate(ahead):
                space = spaces[x.dtype][: h * w]
                np.bitwise_xor(x[i : i + h, None], y[None, j : j + w], out=space.reshape(h, w))
                if k == 0:
                    np.copyto(total, np.bitwise_count(space, out=counts[: h * w]))
                else:
                    np.add(total, np.bitwise_count(space, out=counts[: h * w]), out=total)
            at = np.flatnonzero(total <= (first_radius if bounded else radius))
            if not len(at):
                continue
            r, c = np.divmod(at, w)
            r, c = r + i, c + j
            if same:
                r, c = r[(up := c > r)], c[up]
            if len(r) and lead < 2 * words:
                bits = sum(np.bitwise_count(x[r] ^ y[c]).astype(np.int64) for x, y in zip(rows, cols, strict=True))
                r, c = r[(ok := bits <= radius)], c[ok]
            if len(r):
                yield r, c + base


def linked(left: np.ndarray, right: np.ndarray | None, radius: int, first_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links between two tiles, or within one, indexed as in near_pairs."""
    found = list(near_pairs(left, right, radius, first_radius))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found]))


def _tile_pairs(distinct: DataFrame, first_radius: int, segments: int, tile: int) -> DataFrame:
    """(left, right, itself, key): the flattened rows of each pair of tiles that may hold links.

    Rows are ``fp`` and, where there is one, ``label``.
    """
    width = 64 // segments
    mask = (1 << width) - 1
    first = F.col("fp")[0]
    counts = [
        F.bit_count(F.shiftrightunsigned(first, width * k).bitwiseAND(F.lit(mask if width < 64 else -1).cast("bigint"))).cast("int")
        for k in range(segments)
    ]
    label = [F.array("label")] if "label" in distinct.columns else []
    celled = distinct.select("fp", F.concat("fp", *label).alias("row"), F.array(*counts).alias("cell"))
    # at most (width + 1) ** segments rows, whatever the number of fingerprints
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = sizes.select("cell", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    small = (width + 1) ** segments <= 100_000
    hint = F.broadcast if small else (lambda df: df)
    tiles = (
        celled.join(hint(sizes), "cell")
        .select("cell", F.pmod(F.xxhash64("fp"), F.col("tiles").cast("bigint")).cast("int").alias("t"), "row")
        .groupBy("cell", "t")
        .agg(F.flatten(F.collect_list("row")).alias("fps"))
    )
    tiles = written(tiles, "tiles")
    moves = F.from_json(F.lit(str(_offsets(segments, first_radius))), "array<array<int>>")
    to = tiles.select(F.col("cell").alias("from_cell"), F.col("t").alias("from_t"), F.col("fps").alias("left"), F.explode(moves).alias("step"))
    to = to.withColumn("cell", F.zip_with("from_cell", "step", lambda x, y: x + y)).drop("step")
    to = to.join(hint(sizes), "cell").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    to = to.filter((F.col("cell") != F.col("from_cell")) | (F.col("t") >= F.col("from_t")))
    itself = (F.col("cell") == F.col("from_cell")) & (F.col("t") == F.col("from_t"))
    key = F.xxhash64("from_cell", "from_t", "cell", "t").alias("key")
    pairs = to.select("cell", "t", "left", itself.alias("itself"), key).join(
        tiles.select("cell", "t", F.col("fps").alias("right")), ["cell", "t"]
    )
    return pairs.select("left", "right", "itself", "key")


def near_links(distinct: DataFrame, words: int, radius: int, first_radius: int | None, segments: int, tile: int) -> DataFrame:
    """(a, b): a spanning forest, within each tile pair, of the fingerprints that link.

    ``distinct`` has one row for each fingerprint ``fp``; a and b are fingerprints.
    Without ``first_radius`` no link within the radius is lost.
    """
    first_radius = min(64, radius) if first_radius is None else first_radius
    pairs = _tile_pairs(distinct, first_radius, segments, tile)

    def run(batches):
        for b in batches:
            a, z = [], []
            for lhs, rhs, own in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                x = lhs.values.to_numpy().view(np.uint64).reshape(-1, words)
                y = None if own else rhs.values.to_numpy().view(np.uint64).reshape(-1, words)
                both = x if own else np.concatenate([x, y])
                member, hub = linked(x, y, radius, first_radius)
                a += both[member].view(np.int64).tolist()
                z += both[hub].view(np.int64).tolist()
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(z, kind)], names=["a", "b"])

    return pairs.select("left", "right", "itself").mapInArrow(run, "a array<bigint>, b array<bigint>")


def _candidates(pairs: DataFrame, words: int, radius: int, first_radius: int, similarity: float, labelled: bool) -> DataFrame:
    """(a, b, again): pairs of rows within the radius, to be confirmed.

    Pairs whose numbers of shingles alone keep their similarity below ``similarity``
    are left out.
    A tile pair with more than CANDIDATES pairs a row gives each row's least partner on
    either side only, and its key in ``again``. If rows end in a label, all pairs of
    different labels are given, whatever their number.
    """

    stride = words + KEYED + labelled

    def batch(both, r, c, again=()):
        kind, none = pa.list_(pa.int64()), [None] * len(again)
        node = lambda at: both[at][:, : words + KEYED].view(np.int64).tolist() + none
        columns = [pa.array(node(r), kind), pa.array(node(c), kind), pa.array([None] * len(r) + list(again), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "again"])

    def run(batches):
        for b in batches:
            for lhs, rhs, own, key in zip(b.column(0), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = lhs.values.to_numpy().view(np.uint64).reshape(-1, stride)
                y = None if own else rhs.values.to_numpy().view(np.uint64).reshape(-1, stride)
                both = x if own else np.concatenate([x, y])
                count = both[:, words + KEYED - 1].astype(np.float64)
                found, held = [], 0
                after = before = None
                for r, c in near_pairs(x[:, :words], None if own else y[:, :words], radius, first_radius):
                    # the cosine of two sets is at most the root of the ratio of their sizes
                    alike = np.minimum(count[r], count[c]) >= similarity**2 * np.maximum(count[r], count[c]) - 1e-6
                    r, c = r[alike], c[alike]
                    if labelled:
                        r, c = r[(differ := both[r, -1] != both[c, -1])], c[differ]
                        for at in range(0, len(r), BLOCK):
                            yield batch(both, r[at : at + BLOCK], c[at : at + BLOCK])
                        continue
                    found.append((r, c))
                    held += len(r)
                    if before is None and held > CANDIDATES * len(both):
                        before, after = np.full(len(both), len(both)), np.full(len(both), len(both))
                    if before is not None:
                        for p, q in found:
                            np.minimum.at(before, q, p)
                            np.minimum.at(after, p, q)
                        found = []
                if before is not None:
                    c, r = np.flatnonzero(before < len(both)), np.flatnonzero(after < len(both))
                    yield batch(both, np.concatenate([before[c], r]), np.concatenate([c, after[r]]), [key])
                elif found:
                    yield batch(both, np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found]))

    return pairs.mapInArrow(run, "a array<bigint>, b array<bigint>, again bigint")


def _confirmed(found: DataFrame, docs: DataFrame, text_col: str, shingle: int, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts whose sets of shingles have a cosine similarity of ``similarity`` or more, computed exactly."""
    key = lambda c: F.slice(c, words + 1, 2)
    some = found.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    wanted = some.select(key("a").alias("key")).unionByName(some.select(key("b").alias("key"))).distinct()

    def keys(batches):
        seen = set()
        for b in batches:
            made, texts = [], []
            for t in b.column(0).to_pylist():
                if (one := tuple(text_key(_shingles(t, shingle)[0]))) not in seen:
                    if len(seen) < SEEN:
                        seen.add(one)
                    made.append(list(one))
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["key", "text"])

    def sets(batches):
        for b in batches:
            made = [np.unique(_hashes(*_shingles(t, shingle), 42)).view(np.int64).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], names=["key", "h"])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(keys, "key array<bigint>, text string")
    texts = texts.join(wanted, "key", "left_semi").dropDuplicates(["key"])
    hashed = written(texts.mapInArrow(sets, "key array<bigint>, h array<bigint>"), "shingle-sets")
    # a text may be in very many pairs, on either side
    pairs = written(some.select("a", "b", key("a").alias("ka"), key("b").alias("kb")), "candidate-pairs")
    total = pairs.count()
    out = pairs
    for k, h in (("ka", "_ha"), ("kb", "_hb")):
        hot = hot_keys(pairs.groupBy(k).agg(F.count("*").alias("n")), [k], "n", total)
        out = spread_join(out, hashed.select(F.col("key").alias(k), F.col("h").alias(h)), [k], hot)
    both = F.size(F.array_intersect("_ha", "_hb"))
    return out.filter(both / F.sqrt(F.size("_ha").cast("double") * F.size("_hb")) >= similarity - 1e-9).select("a", "b")


def confirmed_links(
    distinct: DataFrame,
    docs: DataFrame,
    text_col: str,
    shingle: int,
    words: int,
    radius: int,
    first_radius: int | None,
    segments: int,
    tile: int,
    similarity: float,
) -> DataFrame:
    """(a, b): links of texts within the radius whose shingles are similar enough, enough to span every class.

    Every pair within the radius is compared exactly, but for those in tile pairs with
    very many of them that share a class by the pairs compared first.
    """
    first_radius = min(64, radius) if first_radius is None else first_radius
    pairs = _tile_pairs(distinct, first_radius, segments, tile)
    found = written(_candidates(pairs, words, radius, first_radius, similarity, False), "candidates")
    links = written(_confirmed(found, docs, text_col, shingle, words, similarity), "confirmed")
    again = found.filter("again is not null").select(F.col("again").alias("key"))
    if again.isEmpty():
        return links
    roots = connected_components(links).withColumnRenamed("node", "fp")
    labelled = distinct.join(roots, "fp", "left").select("fp", F.xxhash64(F.coalesce("root", "fp")).alias("label"))
    pairs = _tile_pairs(labelled, first_radius, segments, tile).join(again, "key", "left_semi").select("left", "right", "itself", "key")
    found = written(_candidates(pairs, words, radius, first_radius, similarity, True), "candidates")
    return links.unionByName(_confirmed(found, docs, text_col, shingle, words, similarity))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    words: int = 4,
    radius: int | None = None,
    first_radius: int | None = None,
    segments: int = 1,
    tile: int = 16_384,
    similarity: float | None = None,
    distinct: bool = False,
) -> DataFrame:
    """(id, fp, component) of every row: the class of texts that link, directly or not.

    Texts link if their fingerprints of ``words`` * 64 bits differ in ``radius`` bits
    or fewer (default: a fifth, a similarity of 0.8). ``first_radius`` may bound the
    difference of the first 64 bits further, which loses links; by default it loses none.
    With ``distinct`` a shingle counts once, however often it stands in a text, so a
    much repeated line weighs no more than another. With ``similarity`` texts of different words within the radius (of fingerprints over
    distinct shingles) link only if the cosine similarity of their sets of shingles,
    which SimHash estimates, reaches it when computed exactly; the default radius is then a
    quarter of the bits, which a pair at 0.8 misses in 4 % of cases and one at 0.85 in
    none. Every such pair may have to be compared, where without ``similarity`` a spanning
    forest of the links is enough: a group of texts that are within the radius and don't
    reach the similarity costs the square of its size. ``component`` is the smallest id
    of the class.
    Null, empty and blank texts have fingerprint 0 and link to each other; texts
    shorter than a shingle are one shingle; rows that repeat an id share a class only
    if their fingerprints link. ``component`` is null only in classes without any id.
    An empty table gives no rows.
    """
    out = _classes(docs, id_col, text_col, shingle, words, radius, first_radius, segments, tile, similarity, distinct)
    return out.select(F.col("id").alias(id_col), F.slice("fp", 1, words).alias("fp"), "component")


def _classes(docs, id_col, text_col, shingle, words, radius, first_radius, segments, tile, similarity, distinct) -> DataFrame:
    """As near_duplicates, with text_hash and the class's ``root``, which no other class has."""
    radius = words * 64 // (5 if similarity is None else 4) if radius is None else radius
    fps = written(fingerprints(docs, id_col, text_col, shingle, words, similarity is not None, distinct), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    distinct = written(distinct, "distinct-fingerprints")
    if similarity is None:
        links = near_links(distinct.select("fp"), words, radius, first_radius, segments, tile)
    else:
        links = confirmed_links(distinct.select("fp"), docs, text_col, shingle, words, radius, first_radius, segments, tile, similarity)
    roots = connected_components(links)
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", "n", F.coalesce("root", "fp").alias("root")
    )
    classes = written(classes, "fingerprint-classes")
    forget(distinct)
    lowest = classes.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n"))
    # classes of very many fingerprints, then fingerprints of very many rows
    facts = classes.agg(F.count("*"), F.sum("n")).first()
    named = spread_join(classes.select("fp", "root"), lowest.drop("n"), ["root"], hot_keys(lowest, ["root"], "n", facts[0]))
    hot = hot_keys(classes, ["fp"], "n", facts[1] or 0)
    return spread_join(fps, named, ["fp"], hot).select("id", "text_hash", "fp", "root", "component")


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    words: int = 4,
    radius: int | None = None,
    first_radius: int | None = None,
    segments: int = 1,
    tile: int = 16_384,
    similarity: float | None = None,
    distinct: bool = True,
) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id.

    An id that stands in several classes is passed over where a class has another id;
    where it has none, the id stays once for each such class. Of rows of a class that
    repeat the id kept, one stays: that with the smallest hash of its text, then of
    the row. Rows with a null id can't be named and all stay.
    """
    classes = _classes(docs, id_col, text_col, shingle, words, radius, first_radius, segments, tile, similarity, distinct)
    classes = written(classes.filter("id is not null").select("id", "text_hash", "root"), "classes")
    shared = classes.groupBy("id").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b")
    classes = classes.join(shared.select("id", F.lit(True).alias("_shared")), "id", "left")
    rank = F.struct(F.col("_shared").isNotNull(), "id", "text_hash")
    kept = classes.groupBy("root").agg(F.min(rank).alias("_k"))
    kept = kept.select(F.col("_k.id").alias(id_col), F.col("_k.text_hash").alias("_text_hash"))
    named = docs.filter(F.col(id_col).isNotNull()).withColumn("_text_hash", F.xxhash64(text_col))
    order = Window.partitionBy(id_col, "_text_hash").orderBy(F.xxhash64(*docs.columns))
    named = named.join(kept, [id_col, "_text_hash"], "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return named.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def op1_tiled_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(
        read_table(spark, sf_dir, "documents"), shingle=4, words=1, radius=4, segments=4, tile=4096
    )
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"),
        F.col("component").cast("bigint").alias("component_id"),
    )
