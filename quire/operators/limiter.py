"""The sliding-window limiter over a log of requests.

A rejected request isn't recorded, so acceptance feeds back into later
decisions: a fold over each caller's requests in order, not a window count. The
state of a caller is no longer than the allowance. Callers are cut into sessions
first, which is exact: a gap longer than the window empties the state. Where
gaps lie shows in the first and last request of each window-wide slice of time,
so no caller's requests meet in one task before they are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Requests and seconds of each group of routes.
LIMITS = {"convert": (30, 300), "auth": (20, 300), "history": (30, 300)}


def caller(uid: Column, address: Column) -> Column:
    return F.coalesce(F.nullif(uid, F.lit("")), F.nullif(address, F.lit("")), F.lit("unknown"))


def decide(seen: list[int], now: int, allowance: int, window: int) -> tuple[list[int], bool, int]:
    """(times kept, limited, seconds to wait) of one request; times in microseconds, both ends of the window included."""
    if allowance <= 0:
        return seen, False, 0
    seen = [t for t in seen if now - t <= window]
    if len(seen) >= allowance:
        return seen, True, max(1, -(-(window - (now - seen[0])) // 1_000_000))
    return [*seen, now], False, 0


def sessions(log: DataFrame, window: Column) -> DataFrame:
    """log (group, caller, micros, event_id) with session, a number that grows where a caller paused for longer than the window (microseconds)."""
    slices = log.withColumn("slice", F.floor(F.col("micros") / window))
    ends = slices.groupBy("group", "caller", "slice").agg(F.min("micros").alias("first"), F.max("micros").alias("last"), F.first(window).alias("window"))
    order = Window.partitionBy("group", "caller").orderBy("slice")  # of slices, not requests
    pause = F.col("first") - F.lag("last").over(order) > F.col("window")
    cut = ends.withColumn("session", F.sum(F.coalesce(pause, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one, two = slices.alias("x"), cut.select("group", "caller", "slice", "session").alias("y")
    same = F.col("x.group").eqNullSafe(F.col("y.group")) & F.col("x.caller").eqNullSafe(F.col("y.caller")) & (F.col("x.slice") == F.col("y.slice"))
    return one.join(two, same).select("x.group", "x.caller", "y.session", "x.micros", "x.event_id")


def limited(spark: SparkSession, log: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """(group, caller, event_id, limited, retry_after) for each request of log (group, caller, micros, event_id).

    limits has (requests, seconds) of each group; other groups, and those of no
    requests, are never limited. Requests of equal time are taken in order of
    event_id. Partitions are of sessions in order and are folded as they stream
    by; no group is held.
    """
    widths = F.create_map(*(F.lit(x) for g, (_, seconds) in limits.items() for x in (g, max(1, seconds) * 1_000_000))) if limits else F.create_map().cast("map<string,bigint>")
    ordered = sessions(log, F.coalesce(F.try_element_at(widths, F.col("group")), F.lit(1_000_000)).cast("bigint")).repartition("group", "caller", "session").sortWithinPartitions("group", "caller", "session", "micros", "event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, []
        for b in batches:
            out = []
            for g, c, s, t in zip(*(x.to_pylist() for x in b.columns[:4]), strict=True):
                if (g, c, s) != now:
                    now, seen = (g, c, s), []
                allowance, seconds = limits.get(g, (0, 0))
                seen, over, wait = decide(seen, t, allowance, seconds * 1_000_000)
                out.append((over, wait))
            cols = [pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), *cols], names=["group", "caller", "event_id", "limited", "retry_after"])

    kinds = dict(log.dtypes)
    return ordered.mapInArrow(fold, f"`group` {kinds['group']}, caller {kinds['caller']}, event_id {kinds['event_id']}, limited boolean, retry_after bigint")
