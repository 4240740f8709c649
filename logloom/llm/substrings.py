"""Suffix-array dedup: removal of byte strings that occur elsewhere.

Every byte of a window of MIN_BYTES bytes that also starts anywhere else goes.

Each window is assigned to its anchor, the ANCHOR-byte string of least hash inside
it: equal windows have equal anchors at equal places. Only anchors that occur twice
or more can stand in a repeated window; consecutive windows of one such anchor make
a snippet. Snippets of one anchor meet in one block, equal ones counted once with
their number. In a block a Burrows-Wheeler transform is extended backwards by one
byte at a time, breadth-first over the intervals of all anchors: rows of an interval
that are preceded by the same byte make up an interval of the next level, and the
common prefix of neighbours is one more than the least common prefix between them.
Common prefixes so come in increasing order and stop at MIN_BYTES. As rows of an
anchor are aligned by it, a level is one column of the block (the positional form of
the transform), and suffixes of different anchors never need to be sorted together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import hot_keys, spread_join
from ..session import ship
from .common import forget, shared_path, table, written

MIN_BYTES = 200
ANCHOR = 32
#: The filter of repeated anchors that tasks load has 2 ** 26 bits or more, 16 for each
#: of them, and 2 ** 30 at most (128 MB). Beyond 67 million repeated anchors its share
#: of set bits, 1 - exp(-anchors / 2 ** 30), is that of the other snippets that pass and
#: then meet no partner: more shuffle, the same result.
FILTER_BITS = 26
MAX_FILTER_BITS = 30
#: Window starts handled at once, and snippet bytes of a block (one anchor at least).
SLICE = 1 << 20
#: Snippet bytes that a task holds to count equal ones before it gives them on.
HELD_BYTES = 32 << 20
BLOCK_BYTES = 2 << 20
#: Different snippets of one anchor that a task compares; those of busier anchors are
#: compared window by window in a shuffle.
ANCHOR_ROWS = 20_000
#: Mean snippet bytes of a shuffle partition.
PARTITION_BYTES = 16 << 20

_M = np.uint64(0xFF51AFD7ED558CCD)  # multiplier of the 64-bit finalizer of MurmurHash3
_S = np.uint64(32)
_P = np.uint64(28)


def _gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the ANCHOR bytes from each position."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    m = len(data) - ANCHOR + 1
    h = words[:m] * _M
    for at in range(8, ANCHOR, 8):
        h ^= h >> _S
        h += words[at : at + m]
        h *= _M
    h ^= h >> _S
    h *= _M
    h ^= h >> _S
    return h


def anchored_runs(data: bytes, least: int = MIN_BYTES):
    """(anchor hash, anchor position, first and last window start) arrays for each slice of the data.

    Consecutive windows of one anchor make a run; every window start is in one run.
    """
    span = least - ANCHOR + 1
    for base in range(0, len(data) - least + 1, SLICE):
        piece = data[base : base + SLICE + least - 1]
        h = _gram_hashes(piece)
        # high bits of the hash, then the position: the leftmost of equal hashes wins
        key = (h >> _P << _P) | np.arange(len(h), dtype=np.uint64)
        blocks = np.concatenate([key, np.full(-len(h) % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(piece) - least + 1
        low = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        pos = (low & np.uint64(2**28 - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(pos)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [n]]) - 1
        yield h[pos[first]], pos[first] + base, first + base, last + base


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


@lru_cache(maxsize=2)
def _filter(path: str, size: int) -> np.ndarray:
    """The filter's 2 ** size bits, from the shared folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    bits = np.zeros(1 << (size - 6), np.int64)
    for part in ds.dataset(where, filesystem=store, format="parquet").to_batches():
        bits[part.column("word").to_numpy()] = part.column("bits").to_numpy()
    return bits.view(np.uint64)


def _may_repeat(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def repeated_anchor_filter(texts: DataFrame, least: int, anchor_rows: int = ANCHOR_ROWS) -> tuple[tuple[str, int], DataFrame]:
    """Writes a bit array with the anchors that occur twice or more.

    Returns its path and the log of its size, and the busy anchors (h): those met more
    than ``anchor_rows`` times and in over a thousandth of all places, so never more
    than a thousand.
    """

    def run(batches):
        for b in batches:
            found = [r[0] for t in b.column(0).to_pylist() for r in anchored_runs(_bytes(t), least)]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found) if found else np.zeros(0, np.uint64))], names=["h"])

    anchors = texts.select("text").mapInArrow(run, "h bigint")
    twice = written(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-anchors")
    count, total = twice.agg(F.count("*"), F.sum("n")).first()
    busy = written(hot_keys(twice, ["h"], "n", total or 0, least=anchor_rows), "busy-anchors")
    size = min(MAX_FILTER_BITS, max(FILTER_BITS, (16 * count).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = twice.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    path = shared_path(texts.sparkSession, "anchor-filter")
    words.write.parquet(path)
    forget(twice)
    return (path, size), busy


def _candidates(data: bytes, bits: np.ndarray, least: int):
    """(anchor hash, anchor offset in the snippet, start, snippet) of runs that may repeat."""
    for h, pos, first, last in anchored_runs(data, least):
        keep = np.flatnonzero(_may_repeat(bits, h))
        for a, p, i, j in zip(h[keep].tolist(), pos[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
            yield a, p - i, i, data[i : j + least]


def distinct_snippets(texts: DataFrame, bits_at: tuple[str, int], least: int) -> DataFrame:
    """(h, s, n, off, snippet): each task's distinct snippets and how often it met them."""

    def run(batches):
        bits, held = _filter(*bits_at), {}

        def flush():
            keys = list(held)
            cols = list(zip(*held.values(), strict=True)) or [[], [], []]
            held.clear()
            key = np.array(keys, np.uint64).reshape(-1, 2)
            arrays = [_signed(key[:, 0]), _signed(key[:, 1]), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["h", "s", "n", "off", "snippet"])

        size = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                for h, off, _, snippet in _candidates(_bytes(t), bits, least):
                    one = held.get(key := (h, xxhash.xxh64_intdigest(snippet)))
                    if one is None:
                        held[key] = [1, off, snippet]
                        size += len(snippet) + 200
                    else:
                        one[0] += 1
                    if size > HELD_BYTES:  # memory of the task stays bounded
                        yield flush()
                        size = 0
        yield flush()

    return texts.select("text").mapInArrow(run, "h bigint, s bigint, n bigint, off int, snippet binary")


def repeated_starts(group: np.ndarray, count: np.ndarray, off: np.ndarray, snippets: list[bytes], least: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated window start of each snippet (-1: none).

    Snippets are ordered by group (anchor) and aligned at ``off``. ``order`` has the
    rows as the transform sorts them: by group, then by the bytes from the current
    column on; ``lcp`` the common prefix of each row with the one before it.
    """
    m = len(snippets)
    sizes = np.fromiter(map(len, snippets), np.int64, m)
    data = np.frombuffer(b"".join(snippets), np.uint8)
    zero = np.cumsum(sizes) - sizes + off  # place of column 0 in data
    right, left = sizes - off - 1, -off  # last and first column
    last_start = sizes - least - off  # last column where a window starts
    first_hit, last_hit = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    enters = np.argsort(-right, kind="stable")
    entered = 0
    for q in range(int(right.max()), int(left.min()) - 1, -1):
        upto = entered + np.searchsorted(-right[enters[entered:]], -q, side="right")
        if upto > entered:
            fresh = enters[entered:upto]
            entered = upto
            order = np.concatenate([order, fresh])
            lcp = np.concatenate([lcp, np.zeros(len(fresh), np.int64)])
            place = np.argsort(group[order], kind="stable")
            order, lcp = order[place], lcp[place]
        here = np.flatnonzero(left[order] <= q)
        if not len(here):
            continue
        rows = order[here]
        key = group[rows] * 256 + data[zero[rows] + q]
        step = np.argsort(key, kind="stable")
        key, at = key[step], here[step]
        # least common prefix between neighbours of the new interval, by their old places
        new = np.zeros(len(at), np.int64)
        if len(at) > 1:
            same = key[1:] == key[:-1]
            lo, hi = np.where(same, at[:-1] + 1, 0), np.where(same, at[1:] + 1, 1)
            edges = np.empty(2 * len(lo), np.int64)
            edges[::2], edges[1::2] = lo, hi
            least_between = np.minimum.reduceat(np.append(lcp, 0), edges)[::2]
            new[1:] = np.where(same, np.minimum(least_between + 1, least), 0)
        order, lcp = order[at], new
        long = lcp >= least
        twice = long | np.append(long[1:], False) | (count[order] > 1)
        hit = order[twice & (q <= last_start[order])]
        first_hit[hit] = q + off[hit]
        last_hit[hit] = np.where(last_hit[hit] < 0, q + off[hit], last_hit[hit])
    return first_hit, last_hit


def expand_blocks(snippets: DataFrame, least: int, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(h, s, start, end, w1, w2, n): ranges of repeated bytes, and windows left to compare; n is the snippet's count.

    Where w1 is null the row is a result: the bytes of a snippet that repeated windows
    cover. Windows of a snippet start within less than ``least`` bytes, so these bytes
    are one range. Other rows are single windows, hashed to 128 bits, of anchors that
    are ``busy`` or have more than ``anchor_rows`` snippets. Rows arrive in order of h;
    blocks are cut between anchors, and a task never holds more than that many rows of
    one anchor.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["h", "s", "start", "end", "w1", "w2", "n"]

    def as_batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def block(rows):
        h = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.concatenate([[0], (np.diff(h) != 0).astype(np.int64)]))
        first, last = repeated_starts(
            group, np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), [r[4] for r in rows], least
        )
        hit = np.flatnonzero(first >= 0)
        s, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        none = [None] * len(hit)
        return as_batch([h[hit], s[hit], first[hit], last[hit] + least, none, none, n[hit]])

    def windows(rows):
        out = []
        for h, s, n, _, snippet, _ in rows:
            for at in range(len(snippet) - least + 1):
                w = xxhash.xxh3_128_intdigest(snippet[at : at + least])
                out.append((h, s, at, at + least, (w >> 64) - 2**63, (w & (2**64 - 1)) - 2**63, n))
        return as_batch(list(zip(*out, strict=True)))

    def run(batches):
        rows, own, size, busy_rows = [], 0, 0, []  # own: rows of the last anchor
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[5]:
                    busy_rows.append(r)
                    if len(busy_rows) == 500:
                        yield windows(busy_rows)
                        busy_rows = []
                    continue
                if own and r[0] == last:
                    own += 1
                    if own > anchor_rows:  # a busy anchor
                        busy = [x for x in rows if x[0] == last]
                        for i in range(0, len(busy), 500):
                            yield windows(busy[i : i + 500])
                        yield windows([r])
                        rows = rows[: len(rows) - len(busy)]
                        continue
                else:
                    if size >= BLOCK_BYTES and rows:
                        yield block(rows)
                        rows, size = [], 0
                    last, own = r[0], 1
                rows.append(r)
                size += len(r[4])
        if busy_rows:
            yield windows(busy_rows)
        if rows:
            yield block(rows)

    schema = "h bigint, s bigint, start int, end int, w1 bigint, w2 bigint, n bigint"
    return snippets.select("h", "s", "n", "off", "snippet", "busy").mapInArrow(run, schema)


def settled(expanded: DataFrame) -> DataFrame:
    """(h, s, start, end, n) of all anchors: results as they are, windows compared by their hashes."""
    done = expanded.filter("w1 is null").select("h", "s", "start", "end", "n")
    left = expanded.filter("w1 is not null")
    same = ["h", "w1", "w2"]
    twice = left.groupBy(*same).agg(F.sum("n").alias("_n"), F.count("*").alias("_rows")).filter("_n > 1")
    # a window may be in all snippets of its anchor
    found = spread_join(left, twice.select(*same), same, hot_keys(twice, same, "_rows", left.count()), "left_semi")
    return done.unionByName(found.groupBy("h", "s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("n").alias("n")))


def snippet_places(texts: DataFrame, bits_at: tuple[str, int], least: int) -> DataFrame:
    """(t1, t2, h, s, at): where each text has which snippet; texts met again in a task are skipped."""

    def run(batches):
        bits, seen = _filter(*bits_at), set()
        for b in batches:
            rows = []
            for t1, t2, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (t1, t2) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add((t1, t2))
                rows += [(t1, t2, h, xxhash.xxh64_intdigest(s), at) for h, _, at, s in _candidates(_bytes(t), bits, least)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())]
            arrays += [_signed(np.array(cols[2], np.uint64)), _signed(np.array(cols[3], np.uint64)), pa.array(cols[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["t1", "t2", "h", "s", "at"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "t1 bigint, t2 bigint, h bigint, s bigint, at bigint")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_BYTES, anchor_rows: int = ANCHOR_ROWS
) -> DataFrame:
    """id, n_bytes, n_removed, spans (maximal removed byte ranges) and kept (bytes) of every row.

    Texts are UTF-8 bytes; matches never cross rows; strings are judged on the input.
    A null text is empty, texts of fewer than ``least`` bytes stay whole. Rows that
    repeat an id or a text are all judged, each against the others. An empty table
    gives no rows. Ids of any type, null ones too, are only passed on.
    """
    if least < ANCHOR + 1:
        raise ValueError(f"least must be over {ANCHOR}")
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    texts = rows.filter(F.octet_length("text") >= least)
    bits, busy = repeated_anchor_filter(texts, least, anchor_rows)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PARTITION_BYTES))
    found = distinct_snippets(texts, bits, least).join(F.broadcast(busy.withColumn("busy", F.lit(True))), "h", "left")
    # snippets of one anchor meet in one task, those of a busy one are dealt over many
    together = (
        found.withColumn("_deal", F.when(F.col("busy"), F.col("s")).otherwise(0))
        .repartition(parts, "h", "_deal")
        .groupBy("h", "_deal", "s")
        .agg(F.sum("n").alias("n"), F.first("off").alias("off"), F.first("snippet").alias("snippet"), F.first("busy").alias("busy"))
        .sortWithinPartitions("h")
    )
    expanded = written(expand_blocks(together, least, anchor_rows), "repeated-ranges")
    covered = written(settled(expanded), "snippet-ranges")
    forget(expanded)
    # a snippet may stand in a third of all texts
    hot = hot_keys(covered, ["h", "s"], "n", covered.agg(F.sum("n")).first()[0] or 0)
    places = spread_join(snippet_places(texts, bits, least), covered.drop("n"), ["h", "s"], hot)
    ranges = places.select("t1", "t2", (F.col("at") + F.col("start")).alias("a"), (F.col("at") + F.col("end")).alias("b"))
    ranges = ranges.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("ranges"))
    ranges = written(ranges, "repeated-spans")
    forget(covered)

    def cut(batches):
        for b in batches:
            out = []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, spans = _bytes(t), []
                for r in found or ():
                    if spans and r["a"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["b"])
                    else:
                        spans.append([r["a"], r["b"]])
                kept, at = [], 0
                for x, y in spans:
                    kept.append(data[at:x])
                    at = y
                kept.append(data[at:])
                out.append((len(data), sum(y - x for x, y in spans), spans, b"".join(kept)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["id", "n_bytes", "n_removed", "spans", "kept"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"
    joined = rows.join(ranges, ["t1", "t2"], "left").select("id", "text", "ranges")
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def op5_backward_extension(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
