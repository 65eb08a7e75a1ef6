"""N events of a key within T: a ring of the last N times that empties when it trips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipscan.functions import kinds

SEPARATOR = "\u001f"


def key_of(columns: list[str]) -> Column:
    """Null and '' are one group; without columns all rows are."""
    if not columns:
        return F.lit("*")
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def epoch_ms(column: str, schema: T.StructType) -> Column:
    """The time in milliseconds, or null where a row cannot be placed."""
    kind = kinds.kind_of(kinds.field_type(schema, column))[1]
    c = F.col(column)
    if kind == kinds.TIMESTAMP:
        return F.unix_millis(c.cast("timestamp"))
    if kind == kinds.TIMESTAMPTZ:
        return F.unix_millis(c)
    if kind == kinds.DATE:
        return F.unix_date(c).cast("long") * 86_400_000
    if kind == kinds.INTEGRAL:
        return c.cast("long")
    return F.unix_millis(F.try_to_timestamp(c.cast("string")))


def candidates(df: DataFrame, key: str, ts: str, n: int, within_ms: int) -> DataFrame:
    """Events that end a run of n within the time, without the emptying of the ring."""
    order = Window.partitionBy(key).orderBy(ts)
    return df.withColumn("first_ts", F.lag(ts, n - 1).over(order)).where(F.col(ts) - F.col("first_ts") <= within_ms)


def trips(df: DataFrame, key: str, ts: str, n: int, within_ms: int) -> DataFrame:
    """key, start_ts, end_ts of each trip, with events in the order of time.

    Only keys with a candidate are folded: the others cannot trip."""
    busy = candidates(df.select(key, ts), key, ts, n, within_ms).select(key).distinct()
    times = df.join(busy, key, "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(ts)).alias("all"))
    empty = F.array().cast("array<bigint>")
    start = F.struct(empty.alias("ring"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        full = F.slice(F.concat(a["ring"], F.array(t)), -n, n)
        ring = F.when(F.size(a["ring"]) + 1 > n, full).otherwise(F.concat(a["ring"], F.array(t)))
        trip = (F.size(ring) == n) & (t - F.element_at(ring, 1) <= within_ms)
        return F.when(trip, F.struct(empty.alias("ring"), F.concat(a["out"], F.array(F.struct(F.element_at(ring, 1).alias("s"), t.alias("e")))).alias("out"))).otherwise(F.struct(ring.alias("ring"), a["out"].alias("out")))

    folded = times.select(key, F.explode(F.aggregate("all", start, step)["out"]).alias("x"))
    return folded.select(key, F.col("x.s").alias("start_ts"), F.col("x.e").alias("end_ts"))


def push(ring: list[int], t: int, n: int, within_ms: int) -> tuple[list[int], tuple[int, int] | None, bool]:
    """(ring, trip, late) after an event, which may come out of order: one that is
    older than all of a full ring is late and dropped; equal times are kept."""
    if len(ring) >= n and t < ring[0]:
        return ring, None, True
    at = len(ring)
    while at and t < ring[at - 1]:
        at -= 1
    ring = (ring[:at] + [t] + ring[at:])[-n:]
    if len(ring) == n and ring[-1] - ring[0] <= within_ms:
        return [], (ring[0], ring[-1]), False
    return ring, None, False


STREAM_OUT = "key string, start_ts long, end_ts long, late long"


def stream_trips(df: DataFrame, key: str, ts: str, n: int, within_ms: int, forget_ms: int | None = None) -> DataFrame:
    """trips() over a stream: the ring of a key is its state, in each batch events
    come in the order of time, and a key without events is forgotten after forget_ms."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring, late, out = list(state.get[0]) if state.exists else [], 0, []
        for t in sorted(int(x) for b in batches for x in b[ts].dropna()):
            ring, trip, dropped = push(ring, t, n, within_ms)
            late += dropped
            if trip:
                out.append((k[0], *trip, 0))
        state.update((ring,))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        if late:
            out.append((k[0], None, None, late))
        yield pd.DataFrame(out, columns=["key", "start_ts", "end_ts", "late"]).astype({"start_ts": "Int64", "end_ts": "Int64", "late": "int64"})

    return df.groupBy(key).applyInPandasWithState(step, STREAM_OUT, "ring array<long>", "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")
