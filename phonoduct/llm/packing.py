"""Fill containers of fixed capacity with items of varying size.

The plan is made over the histogram of sizes, not over items: best fit, largest first, where one step places a
whole run of equal items. Items then take their planned slots by their rank within their size. The
histogram and the plan are bounded by the capacity, whatever the number of items.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.runtime import cut_lineage


@dataclass(frozen=True)
class Plan:
    """Slots: items of ``size`` with rank ``rank`` or above fill containers from ``first`` on, ``each`` per container."""

    size: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    containers: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        key = (self.size.astype(np.int64) << 44) | self.rank
        i = np.maximum(np.searchsorted(key, (size.astype(np.int64) << 44) | rank, "right") - 1, 0)
        if not len(key):
            return np.zeros(len(size), np.int64)
        at = self.first[i] + (rank - self.rank[i]) // self.each[i]
        return np.where(size > 0, at, rank % max(self.containers, 1))


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing over counts. Equal to placing item after item, since a container that took one item of a size stays the best fit for the next as long as it has room."""
    room: list[int] = []  # remaining capacities in use, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs (first container, how many)
    slots: list[tuple[int, int, int, int]] = []
    opened = 0

    def put(left: int, first: int, n: int) -> None:
        if left <= 0 or n <= 0:
            return
        if left not in runs:
            runs[left] = []
            bisect.insort(room, left)
        runs[left].append((first, n))

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        count, rank = histogram[size], 0
        while count:
            i = bisect.bisect_left(room, size)
            if i < len(room):
                left = room[i]
                first, n = runs[left].pop()
                if not runs[left]:
                    del runs[left], room[i]
            else:
                left, first = capacity, opened
                n = -(-count // (capacity // size))
                opened += n
            each = left // size
            full = min(n, count // each)
            if full:
                slots.append((size, rank, first, each))
                put(left - each * size, first, full)
                rank, count = rank + full * each, count - full * each
            if full < n and count and count < each:
                slots.append((size, rank, first + full, count))
                put(left - count * size, first + full, 1)
                rank, count, full = rank + count, 0, full + 1
            put(left, first + full, n - full)
    slots.sort()
    cols = [np.array([s[i] for s in slots], np.int64) for i in range(4)]
    return Plan(*cols, containers=opened)


def pack(df: DataFrame, key: str, size: str, capacity: int, rank_rows: int = 2_000_000) -> DataFrame:
    """(key, part, first_unit, n_units, container) for each item, or each part of an item larger than ``capacity``.

    An item above the capacity is cut into parts of ``capacity`` units and a rest; no other item is divided. Items
    of size 0 (also null or negative sizes) take no room; they are dealt over all containers. Equal sizes are
    ranked by key and part, so the result depends on nothing else; repeated keys are items of their own.
    An empty input gives an empty result; other columns are ignored.
    """
    kind = dict(df.dtypes)[key]
    d = df.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    d = d.withColumn("p", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)).cast("int"))))
    d = d.select("k", "p", (F.col("p") * F.lit(capacity)).cast("bigint").alias("a"), F.least(F.col("n") - F.col("p") * capacity, F.lit(capacity)).alias("n"))
    d = d.withColumn("h", F.pmod(F.xxhash64("k", "p"), F.lit(1 << 20)))
    d = cut_lineage(d)  # ranks must come from the rows that were counted
    # at most capacity + 1 rows
    histogram = {int(r["n"]): int(r["c"]) for r in d.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    plan = best_fit(histogram, capacity)
    # a size that many items share is ranked in slices of hashed keys
    slices = 1 << max(0, (max(histogram.values(), default=0) // rank_rows)).bit_length()
    d = d.withColumn("h", F.pmod("h", F.lit(slices)))
    before = Window.partitionBy("n").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    offset = d.groupBy("n", "h").agg(F.count(F.lit(1)).alias("c")).select("n", "h", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("n", "h").orderBy("k", "p")) - 1)
    ranked = ranked.join(offset, ["n", "h"]).select("k", "p", "a", "n", (F.col("r") + F.col("o")).alias("r"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = plan.place(b.column(3).to_numpy(), b.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(at)], ["k", "part", "first_unit", "n_units", "container"])

    return ranked.mapInArrow(place, f"k {kind}, part int, first_unit bigint, n_units bigint, container bigint").withColumnRenamed("k", key)
