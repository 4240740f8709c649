"""Line dedup: a sharded minimal perfect hash over the hashes of all distinct lines.

Spark counts the documents of each line hash. The distinct hashes are dealt into
shards; each shard is a minimal perfect hash that indexes an array of 16-bit
fingerprints and one of 8-bit counts, and for lines in two or more documents the
document that keeps them. Documents probe the arrays from the shared folder: a task
hashes the lines of CHUNK_BYTES of text, sorts them by shard and probes every shard
once. Lines are never joined. All lines of the table are in the index, so a probe
always meets its own line.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import forget, shared_path, table, written

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Mean number of line hashes in a shard, and bytes of shards a task keeps; 3.5 bytes a
#: line and 8 more for one that repeats. With more lines than that a task reads the
#: shards again for each chunk.
SHARD_KEYS = 250_000
CACHE_BYTES = 128 << 20
#: Text bytes whose lines are probed together.
CHUNK_BYTES = 32 << 20


def line_keys(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """Lines of the text and their 128-bit key hashes [line, 2]; 0, 0 for short keys."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    out = np.zeros((len(lines), 2), np.uint64)
    for i, line in enumerate(lines):
        key = line.strip(SPACE).lower()
        # a code point has one byte that is no continuation byte
        if len(key) >= MIN_CHARS and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS):
            out[i] = divmod(xxhash.xxh3_128_intdigest(key) | 1, 1 << 64)
    return lines, out


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    # constants of the 64-bit finalizer of MurmurHash3
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _joint(h: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of the pair h[:, 0], h[:, 1], in a way of their own for each seed."""
    return h[:, 0] ^ (h[:, 1] * np.uint64((0x9E3779B97F4A7C15 + 2 * seed) % 2**64))


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays: a key sits at the first level where it has a bit alone."""

    GAMMA = 2

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        """words: the levels' bits, 64 to a word."""
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.rank = (np.cumsum(counts) - counts).astype(np.int32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        sizes, parts, level = [], [], 0
        while len(keys):
            size = max(64, -(-cls.GAMMA * len(keys) // 64) * 64)
            at = (_mix(keys, level) % np.uint64(size)).astype(np.int64)
            count = np.bincount(at, minlength=size)
            parts.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[count[at] != 1]
            level += 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, some index or -1 for others."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = np.uint64(base) + _mix(keys[left], level) % np.uint64(size)
            word, bit = self.words[at >> np.uint64(6)], at & np.uint64(63)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.rank[at >> np.uint64(6)] + np.bitwise_count(below))[hit]
            left, base = left[~hit], base + size
        return out


def _print16(hashes: np.ndarray) -> np.ndarray:
    return (hashes[:, 1] >> np.uint64(48)).astype(np.uint16)


def pack(hashes: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> tuple[int, list[int], bytes, bytes, bytes, bytes]:
    """seed, level sizes, bits, fingerprints, counts and keepers of distinct hashes [line, 2].

    The seed is the first for which 64 bits tell the shard's lines apart. Counts stop
    at 255; keepers are those of the lines of count 2 and more, in order of the index.
    """
    seed = next(k for k in range(1000) if len(np.unique(_joint(hashes, k))) == len(hashes))
    keys = _joint(hashes, seed)
    mph = PerfectHash.build(keys)
    order = np.argsort(mph.index(keys))
    count = np.minimum(counts, 255).astype(np.uint8)[order]
    return seed, mph.sizes, mph.words.tobytes(), _print16(hashes)[order].tobytes(), count.tobytes(), keepers.astype(np.int64)[order][count > 1].tobytes()


class Shard:
    """One shard's arrays."""

    def __init__(self, r: dict) -> None:
        self.mph = PerfectHash(r["sizes"], np.frombuffer(r["bits"], np.uint64))
        self.prints = np.frombuffer(r["prints"], np.uint16)
        self.counts = np.frombuffer(r["counts"], np.uint8)
        self.keepers = np.frombuffer(r["keepers"], np.int64)
        self.seed = r["seed"]
        repeated = self.counts > 1
        # place of a repeated line among the repeated ones, by blocks of 64 lines
        padded = np.concatenate([repeated, np.zeros(-len(repeated) % 64, bool)])
        self.repeated = np.packbits(padded, bitorder="little").view(np.uint64)
        sums = np.bitwise_count(self.repeated).astype(np.int64)
        self.before = np.cumsum(sums) - sums
        self.cost = 12 * len(self.mph.words) + 3 * len(self.counts) + 8 * len(self.keepers) + len(self.counts) // 4

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each line (0: not in the shard) and the document that keeps it, if it repeats."""
        at = self.mph.index(_joint(hashes, self.seed))
        count, keeper = np.zeros(len(hashes), np.uint8), np.zeros(len(hashes), np.int64)
        known = np.flatnonzero(at >= 0)
        known = known[self.prints[at[known]] == _print16(hashes[known])]
        count[known] = self.counts[at[known]]
        twice = np.flatnonzero(count > 1)
        place = at[twice].astype(np.uint64)
        below = self.repeated[place >> np.uint64(6)] & ((np.uint64(1) << (place & np.uint64(63))) - np.uint64(1))
        keeper[twice] = self.keepers[self.before[place >> np.uint64(6)] + np.bitwise_count(below)]
        return count, keeper


class Shards:
    """Shards under a path, loaded when probed and kept within CACHE_BYTES."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.store, self.where = fs.FileSystem.from_uri(path)
        self.held: OrderedDict[int, Shard | None] = OrderedDict()
        self.used = 0

    def get(self, shard: int) -> Shard | None:
        import pyarrow.dataset as ds
        from pyarrow import fs

        if shard not in self.held:
            one, folder = None, f"{self.where}/shard={shard}"
            if self.store.get_file_info(folder).type == fs.FileType.Directory:
                one = Shard(ds.dataset(folder, filesystem=self.store, format="parquet").to_table().to_pylist()[0])
            self.held[shard] = one
            self.used += one.cost if one else 0
            while self.used > CACHE_BYTES and len(self.held) > 1:
                gone = self.held.popitem(last=False)[1]
                self.used -= gone.cost if gone else 0
        self.held.move_to_end(shard)
        return self.held[shard]

    def probe(self, hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts and keepers of lines; each shard is probed once. Short lines have count 0."""
        count, keeper = np.zeros(len(hashes), np.uint8), np.zeros(len(hashes), np.int64)
        shard = (hashes[:, 0] % np.uint64(shards)).astype(np.int64)
        real = np.flatnonzero(hashes[:, 1])
        real = real[np.argsort(shard[real], kind="stable")]
        for rows in np.split(real, np.flatnonzero(np.diff(shard[real])) + 1) if len(real) else ():
            if (one := self.get(int(shard[rows[0]]))) is not None:
                count[rows], keeper[rows] = one.probe(hashes[rows])
        return count, keeper


@lru_cache(maxsize=2)
def _open(path: str) -> Shards:
    return Shards(path)


def line_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, n, keeper) of every distinct line hash: its documents and the least of them.

    Rows without an id are no documents: n is 0 for lines that only they have.
    """

    def run(batches):
        for b in batches:
            ids, hashes = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = line_keys(text)[1]
                h = np.unique(h[h[:, 1] != 0], axis=0)
                ids += [key] * len(h)
                hashes.append(h)
            h = np.concatenate(hashes) if hashes else np.zeros((0, 2), np.uint64)
            h = np.ascontiguousarray(h.T).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(ids, pa.int64())], names=["h1", "h2", "doc"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    each = rows.mapInArrow(run, "h1 bigint, h2 bigint, doc bigint")
    counted = each.groupBy("h1", "h2").agg(F.count("doc").alias("_n"), F.min("doc").alias("keeper"), F.max("doc").alias("_other"))
    # rows that repeat an id are one document
    n = F.when(F.col("keeper") < F.col("_other"), F.col("_n")).otherwise(F.least("_n", F.lit(1)))
    return counted.select("h1", "h2", n.alias("n"), F.coalesce("keeper", F.lit(0)).alias("keeper"))


def build_shards(counted: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Writes the arrays of every shard to a folder of its own in the shared folder: the path and the number of shards."""
    spark = counted.sparkSession
    counted = written(counted, "line-counts")
    shards = max(1, -(-counted.count() // shard_keys))
    shard = F.expr(f"cast(pmod(h1 % {shards} + if(h1 < 0, {2**64 % shards}, 0), {shards}) as int)")

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf[["h1", "h2"]].to_numpy(np.int64).view(np.uint64)
        row = [int(key[0]), *pack(h, pdf["n"].to_numpy(), pdf["keeper"].to_numpy())]
        return pd.DataFrame([row], columns=["shard", "seed", "sizes", "bits", "prints", "counts", "keepers"])

    out = shared_path(spark, "line-shards")
    schema = "shard int, seed int, sizes array<bigint>, bits binary, prints binary, counts binary, keepers binary"
    made = counted.withColumn("_shard", shard).groupBy("_shard").applyInPandas(make, schema)
    made.write.partitionBy("shard").parquet(out)
    forget(counted)
    return out, shards


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = True,
    shard_keys: int = SHARD_KEYS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256 and (``keep_text``) kept_text of every row.

    Lines end at \\n. A line's key is the line without ASCII white space at its ends and
    with A-Z in lower case. Keys of MIN_CHARS code points or more in two documents or
    more stay only in the smallest id that holds them, where all their lines stay.
    A null or empty text is one empty line. A null id keeps its lines only where no
    other document repeats them. Rows that repeat an id count as one document. An
    empty table gives no rows. The id must be an integer; other columns are ignored.
    """
    ship(docs.sparkSession)
    path, shards = build_shards(line_counts(docs, id_col, text_col), shard_keys)

    def cut(ids: list, texts: list, store: Shards) -> pa.RecordBatch:
        split = [line_keys(t) for t in texts]
        sizes = [len(x[0]) for x in split]
        count, keeper = store.probe(np.concatenate([x[1] for x in split]), shards)
        own = np.repeat(np.array([-1 if i is None else i for i in ids], np.int64), sizes)
        known = np.repeat(np.array([i is not None for i in ids], bool), sizes)
        drop = (count > 1) & ((keeper != own) | ~known)
        rows, at = [], 0
        for (lines, _), n in zip(split, sizes, strict=True):
            gone = drop[at : at + n]
            at += n
            kept = b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g) if gone.any() else b"\n".join(lines)
            rows.append((n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
        names = ["id", "n_lines", "n_dropped", "kept_sha256"]
        if keep_text:
            arrays.append(pa.array(cols[3], pa.string()))
            names.append("kept_text")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        store = _open(path)
        ids, texts, size = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(key)
                texts.append(text)
                size += len(text or "") + 100
                if size > chunk_bytes:
                    yield cut(ids, texts, store)
                    ids, texts, size = [], [], 0
        if ids:
            yield cut(ids, texts, store)

    schema = "id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string" + ", kept_text string" * keep_text
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_perfect_hash_lines(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents"), keep_text=False)
