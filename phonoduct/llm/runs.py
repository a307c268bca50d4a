"""Collapse runs of repeated consecutive events into one event each.

A sorted stream of events passes a state machine that compares each event with its run's anchor, the
run's latest event, under a tolerance and an index gap. Entities are cut into blocks that share the
event at their border, so a hot entity is spread over tasks; runs that touch a border join afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.runtime import cut_lineage, per_groups

_OUT = pa.schema([("k", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("open", pa.bool_())])


def _flat(v: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components end to end, where each event's begin, their number); 0 marks an event that is null, empty or holds a null or NaN."""
    v = v.combine_chunks()
    if isinstance(v, pa.ChunkedArray):
        v = pa.concat_arrays(v.chunks)
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(v).to_numpy(zero_copy_only=False).astype(float)
    at = np.cumsum(size) - size
    odd = np.bincount(np.repeat(np.arange(len(size)), size), np.isnan(flat), len(size)) > 0
    return flat, at, np.where(odd, 0, size)


def _alike(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, within: float) -> np.ndarray:
    """Whether the ``size`` components from a and from b differ by at most ``within`` each."""
    pair = np.repeat(np.arange(len(size)), size)
    into = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(invalid="ignore"):
        far = ~(np.abs(flat[a[pair] + into] - flat[b[pair] + into]) <= within)
    return np.bincount(pair, far, len(size)) == 0


def _machine(within: float, max_gap: int, block: int, min_events: int):
    def blocks(t: pa.Table, at: np.ndarray) -> pa.Table:
        idx = t.column("idx").to_numpy()
        first = np.zeros(len(idx), bool)
        first[at] = True
        keep = first.copy()
        keep[1:] |= idx[1:] != idx[:-1]
        row = np.flatnonzero(keep)
        flat, begin, size = _flat(t.column("v"))
        idx, begin, size, first = idx[row], begin[row], size[row], first[row]
        same = np.zeros(len(row), bool)
        same[1:] = ~first[1:] & (idx[1:] - idx[:-1] <= max_gap) & (size[1:] == size[:-1]) & (size[1:] > 0)
        pair = np.flatnonzero(same)
        same[pair] = _alike(flat, begin[pair], begin[pair - 1], size[pair], within)
        start = np.flatnonzero(~same & (size > 0))
        end = np.append(np.flatnonzero(~same)[1:], len(row)) - 1
        end = end[size[~same] > 0]
        a, z = idx[start], idx[end]
        b = t.column("block").to_numpy()[row[start]]
        border = (z + max_gap >= (b + 1) * block) | (a < b * block)
        # an event that only a neighbour's halo brought here is reported by that neighbour; a short run off the borders is final
        mine = (z >= b * block) & (border | (z - a + 1 >= min_events))
        return pa.table([t.column("k").take(pa.array(row[start][mine])), pa.array(a[mine]), pa.array(z[mine]), pa.array(border[mine])], schema=_OUT)

    return blocks


def collapse_runs(df: DataFrame, key: str, order: str, value: str, within: float = 0.0025, min_events: int = 2, max_gap: int = 1, block: int = 65_536) -> DataFrame:
    """(key, first_idx, last_idx, n_frames): each longest run of events that differ from the one before by at most ``within``.

    ``value`` is an array of numbers; all components must be within the tolerance and as many as before. An event
    that is null, empty or holds a null or NaN belongs to no run and ends one, as does a step of ``order`` by
    more than ``max_gap``. n_frames counts positions from first to last (with max_gap 1, the events). Rows with a
    null key or order are dropped. Repeated rows count once; of differing rows at one position, the one whose
    value sorts first counts. An empty input gives an empty result; other columns are ignored.
    """
    d = df.select(F.col(key).cast("string").alias("k"), F.col(order).cast("bigint").alias("idx"), F.col(value).cast("array<double>").alias("v")).dropna(subset=["k", "idx"])
    b = F.floor(F.col("idx") / F.lit(block)).cast("bigint")
    ahead = (F.col("b") + 1) * block - F.col("idx") <= max_gap
    d = (
        d.withColumn("b", b)
        .select("k", F.explode(F.when(ahead, F.array(F.col("b"), F.col("b") + 1)).otherwise(F.array("b"))).alias("block"), "idx", "v")
        .repartition("k", "block")
        .sortWithinPartitions("k", "block", "idx", "v")
    )
    runs = d.mapInArrow(per_groups(_machine(within, max_gap, block, min_events), ["k", "block"], _OUT), "k string, first bigint, last bigint, open boolean")
    runs = cut_lineage(runs)  # read twice below: the machine must run once
    # at most two runs of a block touch its borders
    w = Window.partitionBy("k").orderBy("first", "last")
    upto = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = (
        runs.where("open").withColumn("new", (upto.isNull() | (F.col("first") > upto)).cast("int"))
        .withColumn("run", F.sum("new").over(w)).groupBy("k", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    )
    both = runs.where("not open").select("k", "first", "last").unionByName(joined)
    n = F.col("last") - F.col("first") + 1
    return both.select(F.col("k").alias(key), F.col("first").alias("first_idx"), F.col("last").alias("last_idx"), n.alias("n_frames")).where(F.col("n_frames") >= min_events)


def with_duration(runs: DataFrame, meta: DataFrame, key: str = "series_id", rate: str = "rate") -> DataFrame:
    """Runs with duration_s = n_frames / rate; null where a series has no finite positive rate. Of several sound rates the smallest counts."""
    r = F.col(rate)
    sound = meta.where(r.isNotNull() & ~F.isnan(r) & (r > 0) & (r < float("inf"))).groupBy(key).agg(F.min(r).alias("_rate"))
    return runs.join(sound, key, "left").withColumn("duration_s", F.col("n_frames") / F.col("_rate")).drop("_rate")
