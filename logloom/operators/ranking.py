"""Ordered numbering and joins that stay spread when one key, time or id holds most rows.

Rows are cut into ranges of their order by sampled bounds; ranges are numbered on
their own and shifted by running totals, which are summed in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most ranges that bounds are made for, and sampled keys for each of them: what reaches the driver.
MAX_RANGES = 65_536
SAMPLES = 8
#: Ranges summed in one window, and tasks over which a hot key of a join is dealt.
BLOCK = 4096
SALTS = 256
#: Partitions that a shuffle writes to without holding rows (spark.shuffle.sort.bypassMergeThreshold).
DIRECT = 200


def range_of(rows: DataFrame, order: list[Column], rows_per_range: int, count: int | None = None) -> Column:
    """Number of the range, from 0 in ascending order, that a row with these order columns falls into.

    Bounds are every SAMPLES-th of the keys in a hashed sample, so bursts, far outliers
    and nulls (which come first) don't crowd a range; only rows equal in all of
    ``order`` can't be parted. Order columns are integers or strings. A row's range is
    found by binary search in the bounds.
    """
    count = rows.count() if count is None else count
    ranges = min(MAX_RANGES, -(-count // rows_per_range))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    if ranges < 2:
        return F.lit(0)
    stride = max(1, count // (ranges * SAMPLES))
    keys = rows.select(key.alias("key")).filter(F.pmod(F.xxhash64("key"), F.lit(stride)) == 0)
    schema = keys.schema["key"].dataType
    # about MAX_RANGES * SAMPLES rows at most
    found = [r[0] for r in keys.distinct().orderBy("key").select(F.to_json("key")).collect()][SAMPLES - 1 :: SAMPLES]
    if not found:
        return F.lit(0)
    bounds = F.from_json(F.lit("[" + ",".join(found) + "]"), f"array<{schema.simpleString()}>")
    middle = lambda a: F.shiftright(a["low"] + a["high"], 1)
    step = lambda a, _: F.when(
        a["low"] < a["high"],
        F.when(F.get(bounds, middle(a)) <= key, F.struct((middle(a) + 1).alias("low"), a["high"].alias("high"))).otherwise(
            F.struct(a["low"].alias("low"), middle(a).alias("high"))
        ),
    ).otherwise(a)
    start = F.struct(F.lit(0).alias("low"), F.lit(len(found)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(found).bit_length())), start, step, lambda a: a["low"])


def tasks_for(rows: DataFrame, count: int, rows_per_task: int) -> int:
    """Partitions for ``count`` rows dealt by hash, not fewer than the session shuffles to.

    Two for each ``rows_per_task`` up to DIRECT; with more a task that writes holds its
    rows in memory, so there are more only from five times ``rows_per_task`` each on.
    """
    wanted = min(2 * -(-count // rows_per_task), max(DIRECT, -(-count // (5 * rows_per_task))))
    return max(wanted, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def totals_before(counts: DataFrame, key: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` in the rows of the key with a smaller ``order``, an integer that is unique in the key."""
    block = F.floor(F.col(order) / BLOCK).alias("_tb_block")
    sums = counts.groupBy(*key, block).agg(F.sum(value).alias("_tb_sum"))
    by_key = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    outer = F.coalesce(F.sum("_tb_sum").over(ahead(by_key.orderBy("_tb_block"))), F.lit(0)).alias("_tb_outer")
    sums = sums.select(*[F.col(c).alias(f"_tb_key_{c}") for c in key], F.col("_tb_block").alias("_tb_of"), outer)
    inside = ahead(Window.partitionBy(*key, "_tb_block").orderBy(order))
    rows = counts.withColumn("_tb_block", block).withColumn("_tb_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_tb_block") == F.col("_tb_of")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_tb_key_{c}"))
    return rows.join(sums, same).select(*counts.columns, (F.col("_tb_outer") + F.col("_tb_inner")).alias(name))


def first_rows(rows: DataFrame, key: list[str], offset: str, limit: Column, rows_per_range: int = 100_000) -> DataFrame:
    """Adds ``place`` from 1 in order of ``offset`` (an integer) and keeps the first ``limit`` rows of each key.

    Ranges of offsets are counted first; only those that can hold the first rows are numbered.
    """
    part = F.floor(F.col(offset) / rows_per_range).cast("bigint")
    ranged = rows.withColumn("_part", part)
    counts = totals_before(ranged.groupBy(*key, "_part").agg(F.count("*").alias("_n")), key, "_part", "_n", "_before").drop("_n")
    # the ranges that can hold the first rows, of ``rows_per_range`` offsets each
    out = ranged.join(F.broadcast(counts), [*key, "_part"]).filter(F.col("_before") < limit)
    place = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(offset)) + F.col("_before")
    return out.withColumn("place", place.cast("bigint")).filter(F.col("place") <= limit).drop("_part", "_before")


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``one`` (a row for each key), where the keys in ``hot`` are dealt over ``salts`` tasks.

    ``hot`` is broadcast: its size must be bounded (see hot_keys).
    """
    flag = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")).otherwise(0)
    left = many.join(flag, keys, "left").withColumn("_salt", salt).drop("_hot")
    all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(flag, keys, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def hot_keys(counts: DataFrame, keys: list[str], count: str, total: int, most: int = 1000, least: int = 64) -> DataFrame:
    """The keys with more than a ``most``-th of ``total``: never more than ``most`` rows."""
    return counts.filter(F.col(count) > max(least, total // most)).select(*keys)
