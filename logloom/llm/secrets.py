"""Secret scans with a randomness test battery, in DataFrame operations only.

Base findings are regular-expression matches. In addition every long token without a
base finding is tested for randomness under the encoding it seems to have: a
chi-squared test of the uniform use of the alphabet, a runs test (symbols above and
below the middle of the alphabet) and a serial-correlation test. The three p-values
are combined by Fisher's method. A random token's p is uniform, that of a word or an
identifier is near 0, so tokens with a high p are reported: in each class of encoding
and length the number of random tokens is estimated from the p-values of UPPER_P and
more, and the cut is the lowest at which the estimated share of non-random tokens
among those reported stays within FALSE_DISCOVERY. Short classes, where words pass as
random, get a high cut or none at all.

A token that is not reported as a whole, or is of mixed alphabets, is tested again by
its parts between slashes, plus, minus and underscore signs, with cuts of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_below, let, running, table, written

#: The base patterns. Kinds in the order of the report.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6

#: Tokens that are tested, and their classes. An equals sign separates, or pads the end.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])"
#: Parts of a token that are tested where the whole isn't reported: runs of these characters.
PARTS = ("A-Za-z0-9+_-", "A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")
LENGTHS = (20, 24, 32, 40, 64, 128)
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
FALSE_DISCOVERY = 0.1
BINS = 50
#: p-values from here on are taken for those of random tokens, in the estimate of their number.
UPPER_P = 0.1


def _spans(text: Column, pattern: str, kind: str, order: int) -> Column:
    """array of (start, end, order, kind, match): leftmost matches that do not overlap.

    The pieces between matches come from the same scan as the matches, so running sums
    of their lengths are the offsets.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,order:int,kind:string,match:string>>")
    # a gap and its match end where the match ends; the gap after the last match has none
    ends = lambda g, m: running(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda n, x: n + F.char_length(x)))
    span = lambda m, e: F.struct(
        (e - F.char_length(m)).alias("start"), e.alias("end"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m.alias("match")
    )
    all_spans = let(found, lambda m: let(gaps, lambda g: F.zip_with(m, ends(g, m), span)))
    return F.when(text.rlike(pattern), all_spans).otherwise(empty)


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    x = F.abs(z)
    k = 1 / (1 + 0.2316419 * x)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    rules = [
        (r"^[0-9a-f]+$", "hex"),
        (r"^[0-9A-F]+$", "HEX"),
        (r"^[A-Z2-7]+$", "base32"),
        (r"^[0-9a-z]+$", "lower36"),
        (r"^[0-9A-Z]+$", "upper36"),
        (r"^[0-9A-Za-z]+$", "base62"),
        (r"^[0-9A-Za-z+/]+$", "base64"),
        (r"^[0-9A-Za-z_-]+$", "base64url"),
    ]
    out = F.when(token.rlike(rules[0][0]), F.lit(rules[0][1]))
    for pattern, name in rules[1:]:
        out = out.when(token.rlike(pattern), F.lit(name))
    return out  # null: mixed alphabets, not tested


def test_tokens(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, chi2_p, runs_p, serial_p and the combined p to rows with ``token``.

    Padding is not tested. Tokens of no known alphabet have nulls; so do null and
    empty ones. A token of one symbol, for which runs and serial correlation are not
    defined, has p-values of 1e-6. Rows equal in every column give one row.
    """
    names = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    keys = tokens.columns
    df = tokens.withColumn("_t", F.regexp_replace("token", "=+$", ""))
    df = df.withColumns({"encoding": _encoding(F.col("_t")), "n": F.char_length("_t")})
    df = df.withColumn("_abc", F.element_at(names, F.col("encoding")))
    keys = [*keys, "encoding", "n"]
    # a row for each symbol, with the one before it
    df = df.withColumn("_i", F.explode_outer(F.sequence(F.lit(0), F.when(F.col("n") > 0, F.col("n") - 1))))
    code = lambda at: (F.expr(f"locate(substring(_t, {at}, 1), _abc)") - 1).cast("double")
    df = df.select(
        *keys,
        F.char_length("_abc").cast("double").alias("_k"),
        code("_i + 1").alias("_x"),
        F.when(F.col("_i") > 0, code("_i")).alias("_y"),
    )
    high = lambda c: F.col(c) >= F.col("_k") / 2
    df = df.groupBy(*keys, "_k", "_x").agg(
        F.count("*").cast("double").alias("_c"),
        F.sum(F.when(high("_x") != high("_y"), 1.0).otherwise(0.0)).alias("_turns"),
        F.sum(F.col("_x") * F.col("_y")).alias("_xy"),
        F.sum("_y").alias("_sy"),
        F.max(F.when(F.col("_y").isNull(), F.col("_x"))).alias("_first"),
    )
    df = df.groupBy(*keys, "_k").agg(
        F.sum(F.col("_c") * F.col("_c")).alias("_squares"),
        F.sum(F.when(high("_x"), F.col("_c")).otherwise(0.0)).alias("_up"),
        (F.sum("_turns") + 1).alias("_runs"),
        F.sum(F.col("_c") * F.col("_x")).alias("_sx"),
        F.sum(F.col("_c") * F.col("_x") * F.col("_x")).alias("_xx"),
        F.coalesce(F.sum("_xy"), F.lit(0.0)).alias("_xy"),
        F.coalesce(F.sum("_sy"), F.lit(0.0)).alias("_sy"),
        F.max("_first").alias("_first"),
    )
    n = F.col("n").cast("double")
    df = df.withColumn("_mean", F.col("_sx") / n)
    df = df.withColumn("_var", F.col("_xx") - n * F.col("_mean") * F.col("_mean"))
    # the symbols with one before them sum to all but the first; those before, to all but the last
    df = df.withColumn("_cov", F.col("_xy") - F.col("_mean") * (F.col("_sx") - F.col("_first") + F.col("_sy")) + (n - 1) * F.col("_mean") * F.col("_mean"))
    least = F.lit(1e-6)
    chi2 = F.col("_k") / n * F.col("_squares") - n
    chi2_z = (chi2 - (F.col("_k") - 1)) / F.sqrt(2 * (F.col("_k") - 1) * (n - 1) / n)
    expected = 2 * F.col("_up") * (n - F.col("_up")) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    df = df.withColumns(
        {
            "_chi2_z": F.when(n > 1, chi2_z),
            "_runs_z": F.when((n > 1) & (expected > 2), (F.col("_runs") - expected) / F.sqrt(spread)),
            "_serial_z": F.when(F.col("_var") > 0, (F.col("_cov") / F.col("_var") + 1 / n) * F.sqrt(n)),
        }
    )
    zs = F.array("_chi2_z", F.abs("_runs_z"), F.abs("_serial_z"))
    df = df.withColumn("_tails", F.transform(zs, lambda z: _normal_tail(z)))
    p = lambda i, sides: F.when(
        F.col("encoding").isNotNull(), F.greatest(F.coalesce(sides * F.get("_tails", F.lit(i)), least), least)
    )
    df = df.withColumns({"chi2_p": p(0, 1), "runs_p": p(1, 2), "serial_p": p(2, 2)})
    # Fisher: -2 times the sum of ln p is chi-squared with 6 degrees of freedom
    half = F.array(-(F.ln("chi2_p") + F.ln("runs_p") + F.ln("serial_p")))
    df = df.withColumn("p", F.get(F.transform(half, lambda x: F.exp(-x) * (1 + x + x * x / 2)), F.lit(0)))
    return df.select(*keys, "chi2_p", "runs_p", "serial_p", "p")


def _class(n: Column) -> Column:
    out = F.lit(LENGTHS[0])
    for low in LENGTHS[1:]:
        out = F.when(n >= low, F.lit(low)).otherwise(out)
    return out


def cuts(tested: DataFrame, share: float = FALSE_DISCOVERY, bins: int = BINS) -> DataFrame:
    """(encoding, length class, cut): the least p reported in each class, where there is one.

    Counts of all tokens by class and p are aggregated first: at most bins rows for
    each of the few classes.
    """
    counts = tested.groupBy("encoding", "size_class", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("k")
    )
    each = Window.partitionBy("encoding", "size_class")
    above = each.orderBy(F.desc("bin"))
    upper = F.sum(F.when(F.col("bin") >= round(bins * UPPER_P), F.col("k")).otherwise(0)).over(each)
    random = F.least(upper / (1 - UPPER_P), F.sum("k").over(each).cast("double"))
    table_ = counts.select("encoding", "size_class", "bin", F.sum("k").over(above).alias("reported"), random.alias("random"))
    false_share = 1 - F.col("random") * (1 - F.col("bin") / bins) / F.col("reported")
    return (
        table_.filter((false_share <= share) & (F.col("random") > 0))
        .groupBy("encoding", "size_class")
        .agg((F.min("bin") / bins).alias("cut"))
    )


def _reported(tested: DataFrame) -> DataFrame:
    """The rows whose p reaches the cut of their class."""
    # one row for each class of encoding and length at most
    return tested.join(F.broadcast(cuts(tested)), ["encoding", "size_class"]).filter("p >= cut")


def _parts(tokens: DataFrame) -> DataFrame:
    """The parts of tokens (_row, start, end, token, ...), with ``whole``, the token's start."""
    rows = tokens.filter(F.col("token").rlike("[+/_-]"))
    runs = F.array_distinct(F.concat(*[_spans(F.col("token"), f"[{c}]{{20,}}={{0,2}}", "random", 3) for c in PARTS]))
    rows = rows.select("_row", F.col("start").alias("whole"), F.char_length("token").alias("_n"), F.explode(runs).alias("_s"))
    rows = rows.filter(F.col("_s.end") - F.col("_s.start") < F.col("_n"))
    at = lambda c: (F.col("whole") + F.col(f"_s.{c}")).alias(c)
    return rows.select("_row", "whole", at("start"), "_s.order", at("end"), "_s.kind", F.col("_s.match").alias("token"))


def _outermost(parts: DataFrame) -> DataFrame:
    """Without the parts that lie in another one."""
    before = Window.partitionBy("_row", "whole").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_reach", F.max("end").over(before)).filter("_reach is null or _reach < end").drop("_reach")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans of every row: arrays of (start, order, end, kind), in report order.

    ``base`` has the assign, access and hex findings, ``spans`` these and the tokens
    that the randomness tests add (kind ``random``). Offsets are code points, end
    exclusive. Whole texts are read; null texts are empty; rows that repeat an id are
    scanned each; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assigned = F.filter(
        _spans(text, ASSIGN, "assign", 0),
        lambda x: F.char_length(F.regexp_extract(x["match"], ASSIGN, 2)) >= MIN_ASSIGNED,
    )
    plain = lambda xs: F.transform(
        xs, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))
    )
    found = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.array_sort(plain(F.concat(assigned, _spans(text, ACCESS, "access", 1), _spans(text, HEX, "hex", 2)))).alias("base"),
        _spans(text, TOKEN, "random", 3).alias("tokens"),
    )
    found = written(found, "secret-candidates")
    # a token meets a base finding if one of those that start before its end reaches beyond its start
    starts, reach = F.transform("base", lambda x: x["start"]), running(F.transform("base", lambda x: x["end"]), F.greatest)
    hit = lambda t, b, r: F.coalesce(F.get(r, count_below(b, t["end"]) - 1) > t["start"], F.lit(False))
    marked = let(starts, lambda b: let(reach, lambda r: F.transform("tokens", lambda t: F.struct(t.alias("s"), hit(t, b, r).alias("hit")))))
    each = found.select("_row", F.explode(marked).alias("_s"))
    each = each.select("_row", "_s.hit", "_s.s.start", "_s.s.order", "_s.s.end", "_s.s.kind", F.col("_s.s.match").alias("token"))
    tested = test_tokens(each.filter("not hit").drop("hit")).withColumn("size_class", _class(F.col("n")))
    tested = written(tested, "secret-tokens")
    chosen = _reported(tested.filter("p is not null"))
    rest = _parts(tested.join(chosen.select("_row", "start"), ["_row", "start"], "left_anti"))
    # parts beside a base finding in the same token
    beside = _parts(each.filter("hit")).alias("t")
    base = found.select("_row", F.explode("base").alias("b"))
    over = (F.col("t._row") == base["_row"]) & (F.col("b.start") < F.col("t.end")) & (F.col("t.start") < F.col("b.end"))
    parts = test_tokens(rest.unionByName(beside.join(base, over, "left_anti"))).filter("p is not null")
    parts = written(parts.withColumn("size_class", _class(F.col("n"))), "secret-parts")
    span = ["_row", "start", "order", "end", "kind"]
    chosen = chosen.select(*span).unionByName(_outermost(_reported(parts)).select(*span))
    added = chosen.groupBy("_row").agg(F.collect_list(F.struct("start", "order", "end", "kind")).alias("added"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return found.join(added, "_row", "left").select(
        F.col("_id").alias(id_col),
        "base",
        F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"),
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; of overlapping spans the first counts in full."""
    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    before = lambda r, i: F.coalesce(F.get(r, i - 1), F.lit(0))
    gap = lambda s, at: F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
    piece = lambda r: lambda s, i: F.when(s["end"] <= before(r, i), "").otherwise(F.concat(gap(s, before(r, i)), F.lit(mark)))
    cut = lambda r: F.concat(F.array_join(F.transform(spans, piece(r)), ""), F.substring(text, before(r, F.size(r)) + 1, F.char_length(text)))
    return let(reach, cut)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_randomness_battery(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans")
    )
