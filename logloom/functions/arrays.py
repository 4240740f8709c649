"""Folds over long arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded one by one; blocks of as many are put together at once.
RUN = 256


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body, or a function in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(xs: Column, op=lambda a, b: a + b) -> Column:
    """Running sums (or another associative ``op``) of an array without nulls.

    Arrays are immutable: appending to one for each element takes quadratic time. So
    blocks of RUN elements are folded apart, and each is shifted by the blocks before.
    """
    last = lambda a: F.get(a, F.size(a) - 1)
    fold = lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(op(last(a), x))))

    def folded(blocks: Column, empty: Column) -> Column:
        ends = let(F.aggregate(F.transform(blocks, last), empty, fold), lambda e: e)
        shift = lambda e: F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(e, i - 1), x))))
        return F.flatten(let(ends, shift))

    def whole(a: Column) -> Column:
        empty = F.slice(a, F.lit(1), F.lit(0))
        blocks = F.transform(blocks_of(a), lambda b: F.aggregate(b, empty, fold))
        return let(blocks, lambda b: folded(b, empty))

    return let(xs, whole)


def count_below(xs: Column, x: Column) -> Column:
    """How many of an ascending array's elements are smaller than ``x``, by binary search. ``xs`` should be a column or bound by let()."""
    middle = lambda a: F.shiftright(a["low"] + a["high"], 1)
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    step = lambda a, _: F.when(a["low"] >= a["high"], a).when(F.get(xs, middle(a)) < x, pair(middle(a) + 1, a["high"])).otherwise(pair(a["low"], middle(a)))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs) + F.lit(1.0))).cast("int"))
    return F.aggregate(rounds, pair(F.lit(0), F.size(xs)), step, lambda a: a["low"])


def blocks_of(xs: Column) -> Column:
    """The array cut into arrays of RUN elements."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(RUN)), lambda i: i <= F.size(xs))
    return F.transform(starts, lambda i: F.slice(xs, i, F.lit(RUN)))


def scan(xs: Column, state: dict[str, Column], step, out_type: str) -> Column:
    """What ``step`` gives for each element, in order.

    ``step(state, x)`` returns the next state (name: Column) and the element's output,
    of type ``out_type``. ``state`` holds the first one. Outputs are gathered in blocks,
    so the time is linear.
    """
    names = list(state)
    none = F.array().cast(f"array<{out_type}>")
    packed = lambda values, out: F.struct(*[values[n].alias(n) for n in names], out.alias("_out"))

    def one(a: Column, x: Column) -> Column:
        after, out = step({n: a[n] for n in names}, x)
        return packed(after, F.concat(a["_out"], F.array(out)))

    def block(a: Column, b: Column) -> Column:
        folded = F.aggregate(b, packed({n: a[n] for n in names}, none), one)
        return let(folded, lambda r: packed({n: r[n] for n in names}, F.concat(a["_out"], F.array(r["_out"]))))

    whole = lambda v: F.aggregate(blocks_of(v), packed(state, F.array().cast(f"array<array<{out_type}>>")), block, lambda a: F.flatten(a["_out"]))
    return let(xs, whole)
