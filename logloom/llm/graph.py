"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import hot_keys, spread_join
from .common import forget, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; each round is
    written to the shared folder, the one before deleted. An edge is kept once, from
    its larger end u to its smaller v. Minima are aggregated before the shuffle, and
    ends of very many edges are dealt over many tasks when the minima are joined, so
    no hub meets all its edges in one task. Self-loops and repeated edges are allowed;
    no edges give no rows.
    """
    spark = edges.sparkSession
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        starred = written(_large_star(now, state[0]), "edges")
        forget(now)
        now = written(_small_star(starred, state[0]), "edges")
        forget(starred)
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct() if state[0] else (
        spark.createDataFrame([], roots.schema)
    )


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def _lowest(edges: DataFrame) -> DataFrame:
    """The smallest of the smaller neighbours of every node that has one."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """The larger end of every edge points to the smallest of the neighbourhood of the smaller end, which is itself if it has no smaller neighbour."""
    low = _lowest(edges).withColumnRenamed("u", "v")
    hot = hot_keys(edges.groupBy("v").agg(F.count("*").alias("n")), ["v"], "n", n)
    return spread_join(edges, low, ["v"], hot, "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """The smaller neighbours of a node, and the node, point to the smallest of them."""
    low = _lowest(edges)
    hot = hot_keys(edges.groupBy("u").agg(F.count("*").alias("n")), ["u"], "n", n)
    moved = spread_join(edges, low, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
