"""WARC archives with a two-level capture index.

Pages are written as records of their own gzip member each, so a record can be read
by its byte range. Equal payloads are written once; later captures are revisit
records. The capture index sorts reversed-host URL keys into compressed blocks and
keeps a sparse directory of the blocks' first keys: a lookup searches the directory,
then the block, then reads one range of one archive.

Archives lie in the shared folder. A task writes files under names of its own and
reports them with its rows, so files of a task attempt that was lost are never read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import hot_keys, spread_join
from ..session import ship
from .common import shared_path, table, written

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
BLOCK_RECORDS = 512
#: Directory entries that every task may hold; beyond it they stand for runs of blocks, each with a directory of its own.
MAX_DIRECTORY = 100_000
#: Blocks are numbered from a multiple of this in each partition of the index.
PARTITION = 1 << 40
#: Bytes of archives, and of record ranges, that a task reads.
READ_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
CRLF = b"\r\n"
#: The tables have no capture time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then the path and query; other text stays as it is."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname, parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A").replace("\t", "%09")


def capture_key(url: str | None, page_id) -> str:
    """Key of a capture: from the URL as the record's header has it."""
    return f"{url_key(_header_value(url or ''))} {page_id}"


def record(page_id, url: str | None, payload: bytes, refers_to=None, refers_url: str | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_header_value(refers_url)}")
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + 2 * CRLF + block + 2 * CRLF


def _page(uri: str | None):
    text = (uri or "")[len("<urn:page:") : -1]
    return None if text in ("", "None") else int(text)


def parse(stream: io.BufferedIOBase):
    """(headers, payload bytes) of each record in a stream of uncompressed records."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline().rstrip(CRLF)):
            name, _, value = line.partition(b": ")
            headers[name.decode().lower()] = value.decode("utf-8", "surrogatepass")
        block = stream.read(int(headers["content-length"]))
        yield headers, block.partition(2 * CRLF)[2]


def roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page, url, payload, refers_to, refers_url: refers_to is null for responses.

    Of equal payloads of ``least`` bytes or more the one with the largest id is the
    response. Counts are pre-aggregated by digest; payloads are shuffled once, by id.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    narrow = rows.select("page", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    narrow = written(narrow.filter(F.col("bytes") >= least), "payload-digests")
    kept = narrow.groupBy("digest", "bytes").agg(F.max("page").alias("refers_to"), F.max_by("url", "page").alias("refers_url"), F.count("*").alias("n"))
    kept = written(kept.filter("n > 1"), "repeated-payloads")
    total = kept.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(kept, ["digest", "bytes"], "n", total)
    later = spread_join(narrow, kept.drop("n"), ["digest", "bytes"], hot).filter("page <> refers_to")
    later = later.select("page", "digest", "refers_to", "refers_url").distinct()
    own = rows.withColumn("digest", F.sha1("payload"))
    return own.join(later, ["page", "digest"], "left").select("page", "url", "payload", "refers_to", "refers_url")


def write_archives(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of roles() under ``path``; returns the captures.

    Captures: key, page, record_type, file, offset, length, digest. They are written
    to the shared folder too, so the archives are made once.
    """
    store, where = _store(path)
    store.create_dir(where, recursive=True)

    def run(batches):
        store, where = _store(path)
        out, name, at = None, "", 0
        try:
            for b in batches:
                found: dict[str, list] = {k: [] for k in ("key", "page", "record_type", "file", "offset", "length", "digest")}
                for r in b.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{where}/{name}", compression=None)
                    payload = r["payload"].encode("utf-8", "surrogatepass")
                    revisit = r["refers_to"] is not None
                    member = gzip.compress(record(r["page"], r["url"], payload, r["refers_to"], r["refers_url"], revisit), 6, mtime=0)
                    out.write(member)
                    values = (capture_key(r["url"], r["page"]), r["page"], "revisit" if revisit else "response", name, at, len(member), hashlib.sha1(payload).hexdigest())
                    for k, v in zip(found, values, strict=True):
                        found[k].append(v)
                    at += len(member)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], names=list(found))
        finally:
            if out is not None:
                out.close()

    ship(rows.sparkSession)
    schema = "key string, page bigint, record_type string, file string, offset bigint, length bigint, digest string"
    rows = rows.withColumns({"page": F.col("page").cast("bigint"), "refers_to": F.col("refers_to").cast("bigint")})
    return written(rows.mapInArrow(run, schema), "captures")


def build_index(captures: DataFrame, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Blocks (block, first_key, blob): entries in key order, compressed, in the shared folder."""

    def run(batches):
        at, held = TaskContext.get().partitionId() * PARTITION, []

        def block():
            nonlocal at
            lines = "\n".join("\t".join(map(str, e)) for e in held).encode("utf-8", "surrogatepass")
            one = pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([held[0][0]], pa.string()), pa.array([zlib.compress(lines)], pa.binary())],
                names=["block", "first_key", "blob"],
            )
            at, held[:] = at + 1, []
            return one

        for b in batches:
            for e in zip(*[c.to_pylist() for c in b.columns], strict=True):
                held.append(e)
                if len(held) == block_records:
                    yield block()
        if held:
            yield block()

    ship(captures.sparkSession)
    rows = captures.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key")
    return written(rows.mapInArrow(run, "block bigint, first_key string, blob binary"), "capture-index")


def _entries(blob: bytes) -> tuple[list[bytes], list[list[str]]]:
    rows = [x.split("\t") for x in zlib.decompress(blob).decode("utf-8", "surrogatepass").split("\n")]
    return [r[0].encode("utf-8", "surrogatepass") for r in rows], rows


def _directory(entries: DataFrame) -> tuple[list[bytes], list[int]]:
    found = sorted((r["first_key"].encode("utf-8", "surrogatepass"), r["block"]) for r in entries.select("first_key", "block").collect())
    return [x[0] for x in found], [x[1] for x in found]


def look_up(keys: DataFrame, blocks: DataFrame, max_directory: int = MAX_DIRECTORY) -> DataFrame:
    """(key, file, offset, length) of the distinct ``key`` values that the index holds.

    Tasks search a sparse directory, then the block. The directory has an entry for
    each block; where these are more than ``max_directory``, an entry for each run of
    neighbouring blocks, and a key is searched in the run's entries before its block.
    """
    ship(keys.sparkSession)
    schema = "key string, file string, offset bigint, length bigint"
    keys = keys.select("key").filter("key is not null").distinct()
    run_length = max(1, -(-blocks.count() // max_directory))
    first = F.col("block") - F.pmod(F.pmod(F.col("block"), F.lit(PARTITION)), F.lit(run_length))
    # max_directory entries, and one for each partition of the index, at most
    firsts, numbers = _directory(blocks.filter(F.col("block") == first))

    def place(names: list, firsts: list[bytes], numbers: list[int]) -> list[tuple]:
        found = [bisect.bisect_right(firsts, k.encode("utf-8", "surrogatepass")) - 1 for k in names]
        return [(k, numbers[i]) for k, i in zip(names, found, strict=True) if i >= 0]

    def placed(here):
        cols = list(zip(*here, strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["key", "block"])

    def assign(batches):
        for b in batches:
            yield placed(place(b.column(0).to_pylist(), firsts, numbers))

    asked = keys.mapInArrow(assign, "key string, block bigint")
    if run_length > 1:

        def assign_in_run(batches):
            for b in batches:
                here = []
                for names, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    run = sorted((e["first_key"].encode("utf-8", "surrogatepass"), e["block"]) for e in run)
                    here += place(names, [e[0] for e in run], [e[1] for e in run])
                yield placed(here)

        runs = blocks.groupBy(first.alias("block")).agg(F.collect_list(F.struct("first_key", "block")).alias("run"))
        asked = asked.groupBy("block").agg(F.collect_list("key").alias("keys")).join(runs, "block")
        asked = asked.select("keys", "run").mapInArrow(assign_in_run, "key string, block bigint")
    # distinct keys: a block is asked for its own entries at most once each
    asked = asked.groupBy("block").agg(F.collect_list("key").alias("keys"))

    def search(batches):
        for b in batches:
            out = []
            for blob, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names, rows = _entries(blob)
                for k in wanted:
                    raw = k.encode("utf-8", "surrogatepass")
                    i = bisect.bisect_left(names, raw)
                    if i < len(names) and names[i] == raw:
                        out.append((rows[i][0], rows[i][1], int(rows[i][2]), int(rows[i][3])))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "file", "offset", "length"])

    return blocks.select("block", "blob").join(asked, "block").select("blob", "keys").mapInArrow(search, schema)


def read_ranges(located: DataFrame, path: str) -> DataFrame:
    """(page, payload_bytes, payload_digest, payload) of the records at file, offset, length.

    Ranges are dealt by their bytes, neighbours to one task.
    """

    def run(batches):
        store, where = _store(path)
        for b in batches:
            out = []
            for r in sorted(b.to_pylist(), key=lambda r: (r["file"], r["offset"])):
                with store.open_input_file(f"{where}/{r['file']}") as f:
                    f.seek(r["offset"])
                    raw = f.read(r["length"])
                for head, payload in parse(io.BytesIO(gzip.decompress(raw))):
                    out.append((_page(head["warc-record-id"]), len(payload), hashlib.sha1(payload).hexdigest(), payload))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page", "payload_bytes", "payload_digest", "payload"])

    ship(located.sparkSession)
    located = written(located.select("file", "offset", "length"), "warc-ranges")
    size = located.agg(F.sum("length")).first()[0] or 0
    dealt = located.repartitionByRange(max(1, -(-size // RANGE_BYTES)), "file", "offset")
    return dealt.mapInArrow(run, "page bigint, payload_bytes bigint, payload_digest string, payload binary")


def read_archives(captures: DataFrame, path: str, batch: int = 200) -> DataFrame:
    """Every record of the archives that ``captures`` names, read from start to end, each file by one task.

    page, url, record_type, refers_to, refers_url, payload_bytes and payload_digest of
    the payload that the record itself holds, and the digest in its header.
    """
    names = ("page", "record_type", "refers_to", "refers_key", "payload_bytes", "payload_digest", "header_digest")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        store, where = _store(path)

        def as_batch(rows):
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))

        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with store.open_input_file(f"{where}/{name}") as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, payload in parse(io.BufferedReader(stream)):
                        target = _page(head.get("warc-refers-to"))
                        key = None if target is None else capture_key(head.get("warc-refers-to-target-uri"), target)
                        digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                        rows.append((_page(head["warc-record-id"]), head["warc-type"], target, key, len(payload), hashlib.sha1(payload).hexdigest(), digest))
                        if len(rows) == batch:
                            yield as_batch(rows)
                            rows = []
                yield as_batch(rows)

    ship(captures.sparkSession)
    held = captures.groupBy("file").agg((F.max("offset") + F.max("length")).alias("bytes"))
    facts = held.agg(F.count("*"), F.sum("bytes")).first()
    # no more tasks than files, and none of many small files alone
    parts = max(1, min(facts[0], max(-(-(facts[1] or 0) // READ_BYTES), captures.sparkSession.sparkContext.defaultParallelism)))
    files = held.select("file").repartition(parts)
    schema = "page bigint, record_type string, refers_to bigint, refers_key string, payload_bytes bigint, payload_digest string, header_digest string"
    return files.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Writes the pages, indexes and reads them back: one row per page.

    id, payload_bytes and payload_digest of the full payload, record_type, refers_to.
    A revisit's payload is found through the capture index and read from the response's
    range. A null html is an empty payload; a null url has no target header and the
    empty key; ids are integers, a null id reads back as null. Rows that repeat an id
    and payload are all responses or all revisits. An empty table gives no rows.
    """
    path = path or shared_path(pages.sparkSession, "warc")
    captures = write_archives(roles(pages, id_col, url_col, html_col), path)
    blocks = build_index(captures)
    records = written(read_archives(captures, path), "warc-records")
    revisits = records.filter("record_type = 'revisit'")
    located = look_up(revisits.select(F.col("refers_key").alias("key")), blocks)
    full = read_ranges(located, path).select(F.col("page").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    full = written(full.dropDuplicates(["refers_to"]), "warc-payloads")
    named = [F.col("page").alias(id_col)]
    whole = records.filter("record_type = 'response'").select(*named, "payload_bytes", "payload_digest", "record_type", "refers_to")
    resolved = revisits.join(full, "refers_to", "left").select(
        *named, F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return whole.unionByName(resolved)


def op7_two_level_index(spark, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))
