"""The framing and session operators on event time, for streams (key, ts, v) and tables alike."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phonoduct.runtime import shared_folder


def framed_stats(df: DataFrame, key: str, ts: str, value: str, frame: str = "1 hour", hop: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, n, min, max, mean) of sliding windows; events later than ``late`` are left out of a stream."""
    w = F.window(ts, frame, hop).alias("w")
    a = df.withWatermark(ts, late).groupBy(key, w).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return a.select(key, F.col("w.start").alias("start"), "n", "min", "max", "mean")


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): events no farther apart than ``gap``."""
    a = df.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return a.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_breaks(v: np.ndarray, within: float, before: float | None) -> np.ndarray:
    """Where runs begin among values in order; the first begins one too, unless it is near the value before it."""
    new = np.ones(len(v), bool)
    new[1:] = ~(np.abs(np.diff(v)) <= within)
    if len(v) and before is not None:
        new[0] = not abs(v[0] - before) <= within
    return np.flatnonzero(new)


def repeated_values(df: DataFrame, key: str, ts: str, value: str, within: float = 0.0, idle: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of consecutive events whose value stays within ``within`` of the one before.

    Events wait in the state until the watermark has passed them, so that those that come out of order, within ``late``, are
    taken in the order of their times (of equal times by value). A run is emitted when an event breaks it, or when the watermark
    has passed its end by ``idle`` and no later event waits. The state is the run's ends and last value, and the events of the last ``late``.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1_000_000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n, last, ts0, vs0 = state.getOption or (0, 0, 0, 0.0, [], [])
        parts = [] if state.hasTimedOut else list(batches)
        t = np.concatenate([np.asarray(ts0, np.int64), *[b["us"].to_numpy(np.int64) for b in parts]])
        v = np.concatenate([np.asarray(vs0, float), *[b["v"].to_numpy(float) for b in parts]])
        mark = state.getCurrentWatermarkMs() * 1000
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        ripe = int(np.searchsorted(t, mark, "right"))
        rows = []
        at = run_breaks(v[:ripe], within, last if n else None)
        if ripe:
            edges = np.append(at, ripe)
            if n and (not len(at) or at[0] > 0):  # the open run goes on
                stop = int(edges[0])
                end, n = int(t[stop - 1]), n + stop
            for a, z in zip(edges[:-1], edges[1:]):
                if n:
                    rows.append((start, end, n))
                start, end, n = int(t[a]), int(t[z - 1]), int(z - a)
            last = float(v[ripe - 1])
        t, v = t[ripe:], v[ripe:]
        if n and end + wait <= mark and not len(t):
            rows.append((start, end, n))
            n = 0
        if n or len(t):
            state.update((start, end, n, last, t.tolist(), v.tolist()))
            due = min([end + wait] * (n > 0) + [int(x) for x in t[:1]])
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame({"k": [k[0]] * len(rows), **{c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(("start", "end", "n"))}})

    kind, clock = dict(df.dtypes)[key], dict(df.dtypes)[ts]
    d = df.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("v")).where("k is not null and v is not null")
    d = d.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    kept = "start bigint, end bigint, n bigint, last double, ts array<bigint>, vs array<double>"
    out = d.groupBy("k").applyInPandasWithState(step, f"k {kind}, start bigint, end bigint, n bigint", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("k").alias(key), *[F.timestamp_micros(c).cast(clock).alias(c) for c in ("start", "end")], "n")


def finished(df: DataFrame) -> DataFrame:
    """What a streaming query gives for all that its source holds now, as a table in the shared folder."""
    spark = df.sparkSession
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
