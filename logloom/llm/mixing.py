"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A flow network carries token capacity from patterns to source quotas; each
further repetition of a pattern's tokens is a parallel arc of higher cost, so the
total cost is convex in the repetitions. The network has one node per pattern and
per source, whatever the number of documents. The flow then says how many words
each pattern gives, and documents are taken in a seeded order up to it.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import totals_before
from .common import bucket_count, hash_bucket, table, written

ROWS_PER_BUCKET = 500
#: Most membership patterns the driver plans for; more is an error, not a cut. Measured:
#: 100,000 overlapping patterns of two to four of 40 sources in one network took 6 seconds.
MAX_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def shared_targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(3, 2), cap: int = 2) -> list[float]:
    """Targets that share ``share`` of all sizes by weight, none above ``cap`` times its size.

    Excess is shared again by weight among the others until none is above. The
    result is min(cap, level * weight) with one common level.
    """
    goal = float(share * sum(sizes))
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    capped, left, level = 0, sum(weights), float("inf")
    for i in order:
        level = (goal - capped) / left
        if level <= cap * sizes[i] / weights[i]:
            break
        capped, left = capped + cap * sizes[i], left - weights[i]
    return [float(min(cap * s, level * w)) for s, w in zip(sizes, weights, strict=True)]


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = 2) -> list[dict]:
    """Tokens each pattern sends to each of its sources, at least total cost.

    patterns: (sources, tokens). The k-th copy of a pattern's tokens costs k. Sources
    that no document shares, directly or through others, make networks of their own.
    """
    root = {s: s for s in quotas}

    def find(s):
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    known = [tuple(s for s in members if s in root) for members, _ in patterns]
    for members in known:
        for s in members[1:]:
            root[find(s)] = find(members[0])
    parts: dict = {}
    for p, members in enumerate(known):
        if members:
            parts.setdefault(find(members[0]), []).append(p)
    of: dict = {}
    for s, quota in quotas.items():
        of.setdefault(find(s), {})[s] = quota
    out: list[dict] = [{} for _ in patterns]
    for key, own in parts.items():
        for p, f in zip(own, _network_flow([(known[p], patterns[p][1]) for p in own], of[key], repeats), strict=True):
            out[p] = f
    return out


def _network_flow(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int) -> list[dict]:
    """The flow is maximal and, among the maximal ones, cheapest.

    Costs rise with the copy alone, so the cheapest flow uses as many first copies as any
    flow can, then as many second ones: capacities of one more copy are opened at a time
    and the flow is made maximal along shortest paths (level by level, as Dinic does),
    which never takes words back from a pattern.
    """
    sources = list(quotas)
    at = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    head: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]
    to: list[int] = []
    room: list[int] = []

    def arc(u: int, v: int, capacity: int) -> int:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((capacity, 0))
        return len(to) - 2

    supply = [arc(0, 2 + p, 0) for p in range(len(patterns))]
    carried = [(p, s, arc(2 + p, at[s], repeats * tokens)) for p, (members, tokens) in enumerate(patterns) for s in members if s in at]
    for s in sources:
        arc(at[s], 1, int(quotas[s]))

    def levels() -> list[int]:
        level = [-1] * len(head)
        level[0], todo = 0, [0]
        for u in todo:
            for e in head[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        return level

    def block(level: list[int]) -> None:
        tried = [0] * len(head)
        path: list[int] = []
        u = 0
        while True:
            if u == 1:
                send = min(room[e] for e in path)
                for e in path:
                    room[e] -= send
                    room[e ^ 1] += send
                # back to where the path is full
                cut = next(i for i, e in enumerate(path) if not room[e])
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            edges = head[u]
            while tried[u] < len(edges) and not (room[edges[tried[u]]] and level[to[edges[tried[u]]]] == level[u] + 1):
                tried[u] += 1
            if tried[u] < len(edges):
                path.append(edges[tried[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                tried[u] += 1
            else:
                return

    for _ in range(repeats):
        for e, (_, tokens) in zip(supply, patterns, strict=True):
            room[e] += tokens
        while (level := levels())[1] >= 0:
            block(level)
    out: list[dict] = [{} for _ in patterns]
    for p, s, e in carried:
        if room[e ^ 1]:
            out[p][s] = room[e ^ 1]
    return out


def mix(
    docs: DataFrame,
    size_col: str,
    pattern_col: str,
    quotas: dict | None = None,
    id_col: str = "doc_id",
    repeats: int = 2,
    seed: str = "logloom",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    plan=None,
) -> tuple[DataFrame, dict]:
    """Adds ``taken``, the words the mix takes of each row, and returns the quotas too.

    ``pattern_col`` is an array of source names (null names allowed); ``quotas`` maps
    source to words, or ``plan(totals)`` makes them from {pattern: words}. A row is
    taken 0 to ``repeats`` times: as often as its pattern's flow goes in full
    rounds, and once more for rows in the seeded order until the rest is used; of the
    row on that edge only the first words that fit are taken. Rows of size 0 take 0.
    The seeded order is by a hash of id and size, so rows that repeat an id (or have
    none) are spread; only rows that repeat both lie together, ordered by id and size.
    A ``taken`` column is replaced; other columns, whatever their names, are passed on.
    Empty tables give no rows.
    """
    known = F.array_sort(F.transform(pattern_col, lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("~"))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.to_json(F.array_distinct(known)).alias("_pattern"),
        F.md5(F.concat(F.lit(f"{seed}:"), text(id_col), F.lit(":"), text(size_col)).cast("binary")).alias("_h"),
        F.col(id_col).alias("_id"),
        F.col(size_col).alias("_size"),
    )
    per = rows.groupBy("_pattern").agg(F.sum("_size").alias("words"), F.count("*").alias("rows")).take(MAX_PATTERNS + 1)
    if len(per) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    import json

    names = [tuple(None if x == "~" else x[1:] for x in json.loads(r["_pattern"] or "[]")) for r in per]
    totals = {n: int(r["words"] or 0) for n, r in zip(names, per, strict=True)}
    quotas = plan(totals) if quotas is None else quotas
    flow = min_cost_flow(list(totals.items()), quotas, repeats)
    spark = docs.sparkSession
    takes = []
    for r, n, f in zip(per, names, flow, strict=True):
        t, words = sum(f.values()), totals[n]
        takes.append((r["_pattern"], t // words if words else 0, t % words if words else 0))
    takes_df = spark.createDataFrame(takes, "_pattern string, _full bigint, _rest bigint")

    buckets = bucket_count(sum(r["rows"] for r in per), rows_per_bucket)
    rows = rows.withColumn("_b", hash_bucket(F.col("_h"), buckets))
    key = ["_pattern", "_b"]
    sums = totals_before(rows.groupBy(*key).agg(F.sum("_size").alias("_sum")), ["_pattern"], "_b", "_sum", "_before").drop("_sum")
    # one row per pattern, MAX_PATTERNS at most
    sums = sums.join(F.broadcast(takes_df), "_pattern")
    inside = Window.partitionBy(*key).orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(sums, key)
    left = F.greatest(F.col("_rest") - F.col("_before") - F.col("_in"), F.lit(0))
    taken = F.col("_size") * F.col("_full") + F.least(F.col("_size"), left)
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != "taken"]
    return out.select(*own, taken.alias("taken")), quotas


def by_source_weights(totals: dict, weights: tuple[int, ...] = (3, 1, 2)) -> dict:
    """Targets of single sources in code-point order, null last, weights repeating."""
    words: dict = {}
    for members, n in totals.items():
        words[members[0]] = words.get(members[0], 0) + n
    order = sorted(words, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    targets = shared_targets([words[s] for s in order], [weights[i % len(weights)] for i in range(len(order))])
    return dict(zip(order, targets, strict=True))


def mix_sources(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and ``keep``) for every row of documents.

    A null text has size 0; null sources are one source, last in order.
    """
    sized = docs.select(
        "doc_id",
        "source",
        *keep,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.array("source").alias("_member"),
    )
    if not keep:
        sized = written(sized, "mix-sizes")
    totals: dict = {}

    def plan(found: dict) -> dict:
        totals.update({m[0]: n for m, n in found.items()})
        return by_source_weights(found)

    out, quotas = mix(sized, "size", "_member", plan=plan)
    facts = [(s, totals[s], quotas[s]) for s in quotas]
    schema = T.StructType.fromDDL("_source string, source_size bigint, target double")
    facts_df = F.broadcast(docs.sparkSession.createDataFrame(facts, schema))
    return out.join(facts_df, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", *keep, "size", "source_size", "target", "taken"
    )


def op3_flow_mix(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
