"""Ordered state of consumer groups and rate limits, in batch and as streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.arrays import scan
from ..operators.ranking import range_of, totals_before
from ..session import ship

# a stateful processor is also unpickled by a worker of the driver, which gets no shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def replay(ops: DataFrame) -> DataFrame:
    """Pending entries after deliver, ack, nack, claim operations: (queue, group, offset, consumer, deliveries, last_attempt).

    Offsets don't depend on each other, so each is folded alone: what follows its
    last delivery counts, unless it was acknowledged after it.
    """
    key = ["queue", "group", "offset"]
    w = Window.partitionBy(*key).orderBy("seq")
    rows = ops.withColumn("_life", F.sum(F.when(F.col("op") == "deliver", 1).otherwise(0)).over(w)).filter("_life > 0")
    last = F.max("_life").over(Window.partitionBy(*key))
    rows = rows.withColumn("_last", last).filter("_life = _last")
    owner = F.max_by(F.when(F.col("op").isin("deliver", "claim"), F.col("consumer")), F.when(F.col("op").isin("deliver", "claim"), F.col("seq")))
    counted = F.count_if(F.col("op").isin("deliver", "nack", "claim"))
    out = rows.groupBy(*key).agg(
        owner.alias("consumer"), counted.cast("int").alias("deliveries"), F.max(F.when(F.col("op") != "ack", F.col("ts"))).alias("last_attempt"), F.max(F.col("op") == "ack").alias("_gone")
    )
    return out.filter("not _gone").drop("_gone")


def replay_cursor(ops: DataFrame) -> DataFrame:
    """delivered (count) and cursor (one past the highest delivery) of each group."""
    return ops.filter("op = 'deliver'").groupBy("queue", "group").agg(F.count("*").alias("delivered"), (F.max("offset") + 1).alias("cursor"))


def bucket_pieces(events: DataFrame, key: str, time_col: str, order: str, rate: float, burst: int, rows_per_range: int = 200_000) -> DataFrame:
    """_key, _order, _at (seconds) and _piece: a key's events cut wherever its bucket has filled up again.

    A gap of burst / rate seconds fills it from any state, so pieces don't depend on
    each other. Gaps are looked for within ranges of time and between them, so no task
    holds all events of a key.
    """
    rows = events.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.unix_micros(time_col).alias("_us"))
    rows = rows.withColumn("_range", range_of(rows, [F.col("_us"), F.col("_order")], rows_per_range))
    by_key = Window.partitionBy("_key").orderBy("_range")
    # a row for each key and range
    ends = rows.groupBy("_key", "_range").agg(F.max("_us").alias("_end")).withColumn("_ahead", F.lag("_end").over(by_key)).drop("_end")
    inside = Window.partitionBy("_key", "_range").orderBy("_us", "_order")
    gap = (F.col("_us") - F.coalesce(F.lag("_us").over(inside), F.col("_ahead"))) / 1e6
    rows = rows.join(ends, ["_key", "_range"]).withColumn("_cut", F.coalesce(gap * rate >= burst, F.lit(True)).cast("int"))
    counts = totals_before(rows.groupBy("_key", "_range").agg(F.sum("_cut").alias("_n")), ["_key"], "_range", "_n", "_before").drop("_n")
    rows = rows.withColumn("_in", F.sum("_cut").over(inside)).join(counts, ["_key", "_range"])
    return rows.select("_key", "_order", (F.col("_us") / 1e6).alias("_at"), (F.col("_before") + F.col("_in")).alias("_piece"))


def token_bucket(events: DataFrame, key: str, time_col: str, order: str, rate: float, burst: int, rows_per_range: int = 200_000) -> DataFrame:
    """key, order column and ``allowed``: a token bucket per key, full at its first event.

    ``rate`` tokens a second flow in, up to ``burst``; an event takes one if there is
    one. A key's events are folded by the pieces of bucket_pieces(); a piece has to fit
    a task. Keys must not be null.
    """
    rows = bucket_pieces(events, key, time_col, order, rate, burst, rows_per_range)
    listed = rows.groupBy("_key", "_piece").agg(F.sort_array(F.collect_list(F.struct("_at", "_order"))).alias("_e"))

    def step(state: dict[str, Column], e: Column) -> tuple[dict[str, Column], Column]:
        flow = F.greatest(F.lit(0.0), e["_at"] - state["last"]) * rate
        tokens = F.when(state["last"].isNull(), state["tokens"]).otherwise(F.least(F.lit(float(burst)), state["tokens"] + flow))
        return {"tokens": F.when(tokens >= 1, tokens - 1).otherwise(tokens), "last": e["_at"]}, tokens >= 1

    start = {"tokens": F.lit(float(burst)), "last": F.lit(None).cast("double")}
    allowed = scan(F.col("_e"), start, step, "boolean")
    out = listed.select("_key", F.explode(F.arrays_zip(F.col("_e").alias("e"), allowed.alias("a"))).alias("z"))
    return out.select(F.col("_key").alias(key), F.col("z.e._order").alias(order), F.col("z.a").alias("allowed"))


ENTRY_OPS = "queue string, group string, offset bigint, seq bigint, op string, consumer string, to string, at_us bigint"
OUTCOMES = "queue string, group string, offset bigint, seq bigint, op string, ok boolean, consumer string, deliveries int"


class _EntryProcessor(StatefulProcessor):
    """One pending entry: owner, claim time and deliveries; nothing is kept once it is gone."""

    def __init__(self, visibility_us: int) -> None:
        self.visibility_us = visibility_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "consumer string, claimed_us bigint, deliveries int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.entry.get()) if self.entry.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            ok = held is None if r.op == "deliver" else held is not None and held[0] == r.consumer
            if ok and r.op == "deliver":
                held = (r.consumer, int(r.at_us), 1)
            elif ok and r.op == "nack":
                held = (held[0], int(r.at_us) - self.visibility_us - 1_000_000, held[2] + 1)
            elif ok and r.op == "transfer":
                held = (r.to, int(r.at_us), held[2] + 1)
            elif ok:
                held = None
            out.append((*key, int(r.seq), r.op, ok, held[0] if held else None, held[2] if held else None))
        if held is None:
            self.entry.clear()
        else:
            self.entry.update(held)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])
        yield frame.astype({"deliveries": "Int32"})

    def close(self) -> None:
        pass


def stream_settle(ops: DataFrame, visibility_s: int = 30) -> DataFrame:
    """Outcomes of a stream of operations on pending entries (ENTRY_OPS), and the entry after each.

    op is deliver, ack, reject, nack or transfer, with the rules of claims.settle. State
    is one small row for each entry, keyed by its offset, so a busy group is spread
    over all tasks. Needs the RocksDB state store.
    """
    ship(ops.sparkSession)
    return ops.groupBy("queue", "group", "offset").transformWithStateInPandas(
        statefulProcessor=_EntryProcessor(visibility_s * 1_000_000), outputStructType=OUTCOMES, outputMode="append", timeMode="None"
    )


class _OffsetProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "offset bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        for pdf in rows:
            pdf = pdf.sort_values("seq")
            yield pdf.assign(offset=range(at, at + len(pdf)))
            at += len(pdf)
        self.next.update((at,))

    def close(self) -> None:
        pass


def stream_offsets(rows: DataFrame) -> DataFrame:
    """Dense offsets of a stream's rows (queue, seq, ...), kept from batch to batch."""
    from pyspark.sql import types as T

    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("offset", T.LongType())])
    return rows.groupBy("queue").transformWithStateInPandas(
        statefulProcessor=_OffsetProcessor(), outputStructType=schema, outputMode="append", timeMode="None"
    )
