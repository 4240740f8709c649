"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a weighted set: its words, each with its number of occurrences S. For
each of SAMPLES draws and each term, r and c are Gamma(2, 1) and b is uniform, all
fixed by the term's hash; with t = floor(ln S / r + b) the draw takes the term with
the least ln a = ln c - r (t - b + 1), and the sample is (term, t). Two texts share a
sample with a probability equal to the generalised Jaccard similarity of their
weights. Gamma values are inverse-CDF draws from a table of STEPS equal steps.

Rows are dealt once, into ranges of ids; terms are counted and sampled where a
document already is, so no term is ever shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import range_of
from .common import table

SAMPLES = 48
STEPS = 1024
ROWS_PER_RANGE = 1000
SPACE = r"[\x20\x09-\x0D]+"


def _gamma_quantile(p: float) -> float:
    """x with 1 - (1 + x) e^-x = p, by bisection."""
    low, high = 0.0, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        if 1 - (1 + mid) * math.exp(-mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _gamma_tables() -> tuple[Column, Column]:
    draws = [_gamma_quantile((i + 0.5) / STEPS) for i in range(STEPS)]
    as_column = lambda xs: F.from_json(F.lit(str([round(x, 6) for x in xs])), "array<double>")
    return as_column(draws), as_column([math.log(x) for x in draws])


def _draw(term: Column, log_weight: Column, d: int, gamma: Column, log_gamma: Column) -> Column:
    """The draw's ln a in the high bits and 24 bits that stand for (term, t) in the low ones."""
    h = F.xxhash64(term, F.lit(d))
    bits = lambda shift, n: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
    r = F.get(gamma, bits(54, 10).cast("int"))
    log_c = F.get(log_gamma, bits(44, 10).cast("int"))
    b = (bits(24, 20) + F.lit(0.5)) / F.lit(float(1 << 20))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + F.lit(1.0))
    mark = (h + t * F.lit(0x9E3779)).bitwiseAND(F.lit(0xFFFFFF).cast("bigint"))
    return F.shiftleft(((log_a + F.lit(64.0)) * F.lit(float(1 << 25))).cast("bigint"), 24).bitwiseOR(mark)


def weighted_terms(text: Column) -> Column:
    """array of (term hash, count) of the lower-cased words."""
    words = F.array_remove(F.split(F.lower(text), SPACE), "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows (range, place, guest, id, text, next_text) in descending id order.

    Rows are dealt into ranges of ids, parted further by the hash of the text where an
    id repeats. The largest row of a range is also a guest of the range above, whose
    last row it follows; the largest of all is a guest of the lowest range. Each text
    is shuffled once. Null ids come after all others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    keys = rows.select("id", "hash")
    rows = rows.withColumn("_r", range_of(keys, [F.col("id"), F.col("hash")], rows_per_range))
    key = F.struct("id", "hash")
    # a row for each range
    tops = keys.withColumn("_r", range_of(keys, [F.col("id"), F.col("hash")], rows_per_range))
    tops = tops.groupBy("_r").agg(F.max(key).alias("top")).orderBy("_r").select(F.to_json("top")).collect()
    ranges = max(1, len(tops))
    top = F.get(F.from_json(F.lit("[" + ",".join(r[0] for r in tops) + "]"), "array<struct<id:bigint,hash:bigint>>"), F.col("_r"))
    is_top = F.col("id").eqNullSafe(top["id"]) & (F.col("hash") == top["hash"])
    own = F.struct(F.col("_r").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(((F.col("_r") + 1) % ranges).alias("range"), F.lit(1).alias("guest"))
    rows = rows.withColumn("_to", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select("_to.range", "_to.guest", "id", "hash", "text")
    order = Window.partitionBy("range").orderBy("guest", F.desc("id"), F.desc("hash"), "text")
    return rows.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """id, n_chars, edited_text_sha256, samples and edited samples, and the next row's samples.

    The edited text is the text whose last floor(n/2) code points are replaced by the
    first as many (or all) of the next row's, in descending id order; the row after
    the last is the first. Null texts are empty; texts without words share one
    fingerprint. Rows that repeat an id follow each other by the hash of their text,
    downwards; only rows that repeat the text too share a range however many they are.
    The id must be an integer; null ids come last. An empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col, rows_per_range)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half),
    )
    rows = rows.select("range", "place", "guest", "id", "n_chars", "text", edited.alias("edited"))
    rows = rows.select(
        "range", "place", "guest", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("v"),
    )
    key = ["range", "place", "guest", "id", "n_chars", "edited_sha256", "side"]
    rows = rows.select(*key[:-1], F.col("v.side").alias("side"), weighted_terms(F.col("v.t")).alias("terms"))
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("terms") - 1, F.lit(0))),
        lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)),
    )
    rows = rows.withColumn("starts", starts)
    rows = rows.select(*key, "terms", "starts", F.explode(F.sequence(F.lit(0), F.size("starts") - 1)).alias("i"))
    at = F.get("starts", F.col("i"))
    to = F.coalesce(F.get("starts", F.col("i") + 1), F.size("terms"))
    rows = rows.select(*key, F.get("terms", at).alias("term"), F.log(F.greatest(to - at, F.lit(1)).cast("double")).alias("lw"))
    gamma, log_gamma = _gamma_tables()
    mins = [F.min(_draw(F.col("term"), F.col("lw"), d, gamma, log_gamma)).alias(f"s{d}") for d in range(samples)]
    drawn = rows.groupBy(*key).agg(*mins)
    # 16 bits stand for a sample; a text without words has the samples of the null term
    marks = F.array(*[F.col(f"s{d}").bitwiseAND(F.lit(0xFFFF).cast("bigint")) for d in range(samples)])
    drawn = drawn.select(*key, marks.alias("marks"))
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("marks")))
    both = drawn.groupBy(*key[:-1]).agg(side(0).alias("marks"), side(1).alias("edited_marks"))
    order = Window.partitionBy("range").orderBy("place")
    both = both.withColumn("next_marks", F.lead("marks").over(order)).filter("guest = 0")
    return both.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "marks", "edited_marks", F.coalesce("next_marks", "marks").alias("next_marks"))


def as_text(marks: Column) -> Column:
    return F.lower(F.array_join(F.transform(marks, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(float(samples))


def op10_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    out = fingerprint_pairs(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("marks")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
