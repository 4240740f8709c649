"""Benchmark decontamination by a broadcast hash set of n-grams, in DataFrame operations only.

Test items become normalised windows, hashed. One pass over the documents hashes
every window of every text and probes the broadcast set; a hash hit counts only if
the words are equal. Only hits and one summary row per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import hot_keys, spread_join
from .common import ascii_lower, count_below, let, running, table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: n-grams of a length that are broadcast at most. Beyond it hashes of all windows are
#: shuffled to those of the n-grams, narrow, and hits are verified in the same way.
MAX_BROADCAST = 500_000
#: Tasks over which the windows of one hash are dealt there.
WINDOW_SALTS = 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _window_hash(n: int) -> Column:
    return F.xxhash64(*[F.get("_words", F.col("_pos") + k) for k in range(n)])


def benchmark_grams(benchmark: DataFrame, n: int, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows of ``n`` words with their hash and the ids that hold them."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("_item"), words(F.col(text_col)).alias("_words")
    )
    size = F.size("_words")
    items = items.filter(size >= n if n == window else size == n)
    each = items.withColumn("_pos", F.explode(F.sequence(F.lit(0), size - n)))
    return (
        each.select("_item", _window_hash(n).alias(f"_h{n}"), F.slice("_words", F.col("_pos") + 1, n).alias(f"_g{n}"))
        .groupBy(f"_h{n}", f"_g{n}")
        .agg(F.array_sort(F.collect_set("_item")).alias(f"_items{n}"))
    )


def _shuffled_hits(rows: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """(_row, _far_spans, _far_items): the occurrences of more n-grams than are broadcast. ``rows`` (_row, _words) must be stored.

    No text is shuffled before its hits are known, and then once.
    """
    size = F.size("_words")
    own = rows.filter(size >= n).select("_row", "_words", F.explode(F.sequence(F.lit(0), size - n)).alias("_pos"))
    own = own.select("_row", "_pos", _window_hash(n).alias("h")).withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(WINDOW_SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(WINDOW_SALTS - 1).cast("bigint"))).alias("salt")
    hits = written(own.join(grams.select(F.col(f"_h{n}").alias("h"), salts), ["h", "salt"], "left_semi").drop("salt"), "window-hits")
    hot = hot_keys(hits.groupBy("h").agg(F.count("*").alias("k")), ["h"], "k", hits.count())
    found = spread_join(hits, grams.select(F.col(f"_h{n}").alias("h"), F.col(f"_g{n}").alias("g"), F.col(f"_items{n}").alias("items")), ["h"], hot)
    found = found.groupBy("_row").agg(F.collect_list(F.struct("_pos", "g", "items")).alias("found")).join(rows.select("_row", "_words"), "_row")
    same = F.filter("found", lambda x: F.slice("_words", x["_pos"] + 1, n) == x["g"])
    found = found.select("_row", same.alias("found")).filter(F.size("found") > 0)
    span = F.transform("found", lambda x: F.struct(x["_pos"].alias("pos"), F.lit(n).alias("len")))
    return found.select("_row", span.alias("_far_spans"), F.flatten(F.transform("found", lambda x: x["items"])).alias("_far_items"))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids), spans, and ``keep``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but
    not none, is one window. ``spans`` are (pos, len) word ranges of occurrences.
    Null and empty texts have no words and no hits; items without words never occur;
    a null item id reads 'null'. Repeated documents give a row each. With no items
    or no documents nothing is hit or returned.
    """
    size = F.size("_words")
    lengths = sorted(
        r[0]
        for r in benchmark.select(F.least(F.size(words(F.col(item_text_col))), F.lit(window)).alias("n"))
        .filter("n > 0")
        .distinct()
        .collect()  # at most `window` numbers
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        words(F.col(text_col)).alias("_words"),
        *[F.col(c).alias(f"_k_{c}") for c in keep],
    )
    grams = {n: benchmark_grams(benchmark, n, item_col, item_text_col, window) for n in lengths}
    far = [n for n in lengths if grams[n].limit(max_broadcast + 1).count() > max_broadcast]
    if far:
        rows = written(rows, "document-words")  # row numbers must last
    stored, lengths = rows, [n for n in lengths if n not in far]
    # position -1 stands for the document itself
    last = size - (lengths[0] if lengths else 1)
    where = F.sequence(F.lit(-1), F.greatest(last, F.lit(-1))) if lengths else F.array(F.lit(-1))
    rows = rows.withColumn("_pos", F.explode(where))
    hit = F.lit(False)
    found = []
    for n in lengths:
        inside = (F.col("_pos") >= 0) & (F.col("_pos") + n <= size)
        rows = rows.withColumn("_h", F.when(inside, _window_hash(n)))
        same = F.col("_h") == F.col(f"_h{n}")
        for k in range(n):
            same = same & (F.get("_words", F.col("_pos") + k) == F.get(f"_g{n}", F.lit(k)))
        # max_broadcast n-grams at most
        rows = rows.join(F.broadcast(grams[n]), same, "left").drop("_h", f"_h{n}", f"_g{n}")
        hit = hit | F.col(f"_items{n}").isNotNull()
        span = F.struct(F.col("_pos").alias("pos"), F.lit(n).alias("len"))
        found.append(F.when(F.col(f"_items{n}").isNotNull(), span))
    rows = rows.filter((F.col("_pos") == -1) | hit)
    spans = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<struct<pos:int,len:int>>")
    items = (
        F.flatten(F.array(*[F.coalesce(F.col(f"_items{n}"), F.array().cast("array<string>")) for n in lengths]))
        if lengths
        else F.array().cast("array<string>")
    )
    per = (
        rows.select("_row", "_id", size.alias("_n"), spans.alias("_spans"), items.alias("_items"), *[F.when(F.col("_pos") == -1, F.col(f"_k_{c}")).alias(f"_k_{c}") for c in keep])
        .groupBy("_row")
        .agg(
            F.first("_id").alias("_key"),
            F.max("_n").cast("bigint").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("_spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
            *[F.first(f"_k_{c}", ignorenulls=True).alias(f"_k_{c}") for c in keep],
        )
    )
    for n in far:
        per = per.join(_shuffled_hits(stored, grams[n], n), "_row", "left")
        more = lambda c, x: F.when(F.col(x).isNull(), F.col(c)).otherwise(F.array_sort(F.array_distinct(F.concat(c, x))))
        per = per.withColumns({"spans": more("spans", "_far_spans"), "items": more("items", "_far_items")}).drop("_far_spans", "_far_items")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["to"], x["pos"]))).alias("n"),
            F.greatest(a["to"], x["pos"] + x["len"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    return per.select(F.col("_key").alias(id_col), "n_words", covered.alias("n_hit"), "items", "spans", *[F.col(f"_k_{c}").alias(c) for c in keep])


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` (in order) and the separators that follow them."""
    original = F.regexp_extract_all(text, F.lit(CASED_WORD), F.lit(0))
    gaps = F.split(text, CASED_WORD, -1)
    starts, reach = F.transform(spans, lambda s: s["pos"]), running(F.transform(spans, lambda s: s["pos"] + s["len"]), F.greatest)
    # a word goes if a span that starts at it or before reaches beyond it
    inside = lambda i, at, to: F.coalesce(F.get(to, count_below(at, i + 1) - 1) > i, F.lit(False))
    kept = lambda at, to, g: lambda w, i: F.when(inside(i, at, to), F.lit("")).otherwise(F.concat(w, F.get(g, i + 1)))
    rest = let(starts, lambda at: let(reach, lambda to: let(gaps, lambda g: F.concat(F.get(g, F.lit(0)), F.array_join(F.transform(original, kept(at, to, g)), "")))))
    return rest


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """The documents without contamination.

    mode "documents" drops every contaminated document; "spans" keeps them without
    the hit words. Clean documents come back unchanged, null texts included; rows that
    repeat a text or an id are judged each. Ids and other columns, whatever their
    names, are only passed on. An empty table gives no rows; without benchmark items
    all rows stay.
    """
    # a text's hits depend on the text alone: 128 bits of its hash name it, so no text is shuffled with its hits
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    found = find_hits(docs.select(named.alias("text_id"), text.alias("text")), benchmark, id_col="text_id", text_col="text", **options)
    hit = found.filter("n_hit > 0").select("text_id", "spans").dropDuplicates(["text_id"])
    # the caller's columns travel in a struct, so none clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named.alias("text_id"))
    if mode == "documents":
        return rows.join(hit.select("text_id"), "text_id", "left_anti").select("row.*")
    if mode != "spans":
        raise ValueError("mode is 'documents' or 'spans'")
    out = rows.join(hit, "text_id", "left")
    own = F.col("row").getField(text_col)
    cut = F.when(F.col("spans").isNotNull(), remove_spans(own, F.col("spans"))).otherwise(own)
    return out.select(*[cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_broadcast_ngrams(spark, sf_dir: str) -> DataFrame:
    out = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
