"""Mergeable percentiles with a deterministic rank error (q-digest).

Values are quantized to 2**bits cells between ``low`` and ``high``. A digest holds counts of nodes of the
dyadic tree over the cells (node 1 is the root, node 2**bits + c the leaf of cell c). A pair of siblings
moves into its parent while the three together hold fewer than n / k values, k = bits / error; so a
rank taken from a digest of n values is off by at most error * n, and digests merge by adding counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoduct.runtime import changes, cut_lineage


@dataclass(frozen=True)
class Universe:
    low: float = math.log(20)
    high: float = math.log(2000)
    bits: int = 16
    error: float = 0.001

    @property
    def cells(self) -> int:
        return 1 << self.bits

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.low) * (self.cells / (self.high - self.low))).astype(np.int64), 0, self.cells - 1)

    def edge(self, c: np.ndarray) -> np.ndarray:
        return self.low + np.asarray(c) * ((self.high - self.low) / self.cells)

    def span(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell below each node."""
        node = np.asarray(node, np.int64)
        up = self.bits - (np.frexp(node.astype(float))[1] - 1)
        return (node << up) - self.cells, ((node + 1) << up) - self.cells - 1


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, bits: int, error: float):
    """Digests of all groups at once: (group, node, count) with small siblings moved into their parents."""
    groups = int(group.max()) + 1 if len(group) else 0
    least = np.floor(np.bincount(group, weights=count, minlength=groups) * error / bits).astype(np.int64)
    if (least <= 1).all():  # no siblings hold fewer values than one
        return _add(group, node, count)
    level = np.frexp(node.astype(float))[1] - 1
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    g, v, c = (a[:0] for a in (group, node, count))
    for at in range(bits, 0, -1):
        own = level == at
        g, v, c = _add(np.append(g, group[own]), np.append(v, node[own]), np.append(c, count[own]))
        if not len(g):
            continue
        above = level == at - 1
        pg, pv, pc = _add(np.append(g, group[above]), np.append(v >> 1, node[above]), np.append(c, count[above]))
        small = pc < least[pg]
        i = np.searchsorted(_key(pg, pv), _key(g, v >> 1))
        move = small[i]
        done.append((g[~move], v[~move], c[~move]))
        g, v, c = g[move], v[move] >> 1, c[move]
    own = level == 0
    done.append(_add(np.append(g, group[own]), np.append(v, node[own]), np.append(c, count[own])))
    g, v, c = (np.concatenate(x) for x in zip(*done))
    order = np.lexsort((v, g))
    return g[order], v[order], c[order]


def _key(g: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (g.astype(np.int64) << 32) | v


def _add(g: np.ndarray, v: np.ndarray, c: np.ndarray):
    """Sorted sums of equal (g, v)."""
    if not len(g):
        return g, v, c
    key = _key(g, v)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at] >> 32, key[at] & 0xFFFFFFFF, np.add.reduceat(c[order], at)


def rank_bounds(nodes: np.ndarray, counts: np.ndarray, values: np.ndarray, u: Universe) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many of the digest's values are surely smaller, and how many can at most be smaller or equal."""
    first, last = u.span(nodes)
    cell = np.where(values < u.low, -1, np.where(values > u.high, u.cells, u.cell(np.where(np.isfinite(values), values, u.low))))
    by_last, by_first = np.argsort(last, kind="stable"), np.argsort(first, kind="stable")
    below = np.append(0, np.cumsum(counts[by_last]))[np.searchsorted(last[by_last], cell, "left")]
    upto = np.append(0, np.cumsum(counts[by_first]))[np.searchsorted(first[by_first], cell, "right")]
    return below, upto


def quantile_bounds(nodes: np.ndarray, counts: np.ndarray, p: np.ndarray, u: Universe) -> tuple[np.ndarray, np.ndarray]:
    """Values that surely enclose the order statistic at rank floor((n - 1) p)."""
    first, last = u.span(nodes)
    k = np.floor((counts.sum() - 1) * np.asarray(p))
    by_first, by_last = np.argsort(first, kind="stable"), np.argsort(last, kind="stable")
    lo = first[by_first][np.searchsorted(np.cumsum(counts[by_first]), k, "right")]
    hi = last[by_last][np.searchsorted(np.cumsum(counts[by_last]), k, "right")]
    return u.edge(lo), u.edge(hi + 1)


def _fields(df: DataFrame, keys: Sequence[str]) -> list[pa.Field]:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32(), "smallint": pa.int16(), "boolean": pa.bool_(), "double": pa.float64()}
    return [pa.field(k, kinds[dict(df.dtypes)[k]]) for k in keys]


#: Most nodes of a row between tasks, so that batches of rows stay small however large a digest is.
PIECE = 512


def digests(df: DataFrame, keys: Sequence[str], value: str, unique: Sequence[str] = (), universe: Universe | None = None) -> DataFrame:
    """One digest per key: keys, n, nodes array<int>, counts array<bigint>.

    Values that are null, NaN or outside the universe's limits don't count. With ``unique`` (the columns that
    identify a reading), readings that repeat them, the keys and the value count once. Null keys form a
    group of their own. An empty input gives no digests. Other columns are ignored.

    Readings are spread over tasks by ``unique``, never by key, and each task adds its readings into packed partial
    digests; these alone are moved by key, where they merge by node addition.
    """
    u = universe or Universe()
    keys, unique = list(keys), list(unique)
    names = {c: f"_u{i}" for i, c in enumerate(unique)}
    d = df.select(*keys, *(F.col(c).alias(n) for c, n in names.items()), F.col(value).cast("double").alias("_x"))
    d = d.where(F.col("_x").between(u.low, u.high))
    columns = d.columns
    if unique:
        # keys lie together and repeated readings side by side; almost every comparison ends at this one number
        place = F.shiftleft(F.hash(*keys).cast("bigint") if keys else F.lit(0).cast("bigint"), 32).bitwiseOR(F.hash(*names.values(), "_x").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
        d = d.repartition(*keys, *(F.floor(F.col(n) / F.lit(4096)) if t in ("int", "bigint") else F.col(n) for n, t in d.select(*names.values()).dtypes))
        d = d.withColumn("_o", place).sortWithinPartitions("_o", *keys, *names.values(), "_x").select(*columns)
    part = d.mapInArrow(_partial(keys, list(names.values()), u, _packed_schema(df, keys)), _ddl(df, keys) + _PACKED)
    return _merge(part, keys, u, df)


def merge_digests(df: DataFrame, keys: Sequence[str], universe: Universe | None = None) -> DataFrame:
    """Digests of coarser keys, by adding the nodes of finer ones (e.g. of days, speakers or partitions).

    Each task first merges what it holds, so that at most one digest per task and key is moved.
    """
    u, keys = universe or Universe(), list(keys)
    d = df.select(*keys, "nodes", "counts")
    d = (d.sortWithinPartitions(*keys) if keys else d).mapInArrow(_merger(keys, u, _packed_schema(df, keys), PIECE), _ddl(df, keys) + _PACKED)
    return _merge(d, keys, u, df)


_PACKED = "nodes array<int>, counts array<bigint>"


def _packed_schema(df: DataFrame, keys: Sequence[str], whole: bool = False) -> pa.Schema:
    return pa.schema([*_fields(df, keys), *[pa.field("n", pa.int64())] * whole, pa.field("nodes", pa.list_(pa.int32())), pa.field("counts", pa.list_(pa.int64()))])


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {t}, " for k, t in df.select(*keys).dtypes)


def _rows(keys: pa.Table, g: np.ndarray, v: np.ndarray, c: np.ndarray, schema: pa.Schema, piece: int | None) -> pa.Table:
    """Packed digests of at most ``piece`` nodes a row; row i of ``keys`` has the keys of group i."""
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    at = first
    if piece and len(g):
        into = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        at = np.flatnonzero(into % piece == 0)
    offsets = pa.array(np.append(at, len(g)).astype(np.int32))
    columns = {"nodes": pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))), "counts": pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int64)))}
    if not piece:
        columns["n"] = pa.array(np.add.reduceat(c, at) if len(g) else c)
    take = keys.take(pa.array(g[at]))
    return pa.table([columns.get(f.name) if f.name in columns else take.column(f.name) for f in schema], schema=schema)


def _partial(keys: list[str], unique: list[str], u: Universe, schema: pa.Schema):
    same = [*keys, *unique, "_x"]

    def flush(kept: list[pa.RecordBatch], last: pa.Table | None) -> tuple[pa.Table, pa.Table]:
        t = pa.Table.from_batches(kept)
        whole = (pa.concat_tables([last, t]) if last is not None else t).combine_chunks()
        skip = 0 if last is None else 1
        if unique:
            rows = np.flatnonzero(changes(whole, same))
            rows = rows[rows >= skip]
        else:
            rows = np.arange(skip, whole.num_rows)
        new = changes(whole, keys) if keys else np.zeros(whole.num_rows, bool)
        end = whole.slice(whole.num_rows - 1)
        if not len(rows):
            return schema.empty_table(), end
        group = np.cumsum(new)[rows]
        group -= group[0]
        node = u.cell(whole.column("_x").to_numpy()[rows]) + u.cells
        g, v, c = compress(*_add(group, node, np.ones(len(node), np.int64)), u.bits, u.error)
        at = np.searchsorted(group, np.arange(group[-1] + 1))
        return _rows(whole.take(pa.array(rows[np.minimum(at, len(rows) - 1)])), g, v, c, schema, PIECE), end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count, last = [], 0, None
        for b in batches:
            kept.append(b)
            count += b.num_rows
            if count >= 250_000:
                out, last = flush(kept, last)
                yield from out.to_batches(max_chunksize=4_000)
                kept, count = [], 0
        if count:
            yield from flush(kept, last)[0].to_batches(max_chunksize=4_000)

    return run


def _merger(keys: list[str], u: Universe, schema: pa.Schema, piece: int | None, rows: int = 4_000):
    """Merge consecutive packed rows of a key. Only the digest of the last key is carried from batch to batch, so a key may have any number of rows."""
    between = pa.schema([f for f in schema if f.name != "n"])

    def merged(t: pa.Table):
        new = changes(t, keys) if keys else np.zeros(t.num_rows, bool)
        new[:1] = True
        nodes, counts = (pa.concat_arrays(t.column(x).chunks) if t.column(x).num_chunks != 1 else t.column(x).chunk(0) for x in ("nodes", "counts"))
        size = np.diff(nodes.offsets.to_numpy())
        group = np.repeat(np.cumsum(new) - 1, size)
        values = nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False)
        return (t.select(keys) if keys else t).take(pa.array(np.flatnonzero(new))), *compress(*_add(group, *values), u.bits, u.error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        count = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, count
            first, g, v, c = merged(pa.Table.from_batches(kept).combine_chunks())
            done = g < (first.num_rows if last else first.num_rows - 1)
            yield from _rows(first, g[done], v[done], c[done], schema, piece).to_batches(max_chunksize=200)
            kept = [] if last else _rows(first, g[~done], v[~done], c[~done], between, PIECE).combine_chunks().to_batches()
            count = 0

        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b.select(between.names))
            count += b.num_rows
            if count >= rows:
                yield from flush(False)
        if kept:
            yield from flush(True)

    return run


def _merge(part: DataFrame, keys: list[str], u: Universe, like: DataFrame) -> DataFrame:
    d = part.repartition(*keys).sortWithinPartitions(*keys) if keys else part.repartition(1)
    schema = _packed_schema(like, keys, whole=True)
    return d.mapInArrow(_merger(keys, u, schema, None), _ddl(like, keys) + "n bigint, " + _PACKED)


def digest_quantiles(df: DataFrame, probs: Sequence[float], universe: Universe | None = None) -> DataFrame:
    """The digests' columns and, per probability, an array of (p, low, high): values that enclose the quantile's order statistic."""
    u = universe or Universe()
    ps = np.array(probs, float)

    @F.pandas_udf("array<struct<p: double, low: double, high: double>>")
    def bounds(nodes: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(nodes, counts):
            lo, hi = quantile_bounds(np.asarray(a, np.int64), np.asarray(b, np.int64), ps, u)
            out.append([{"p": p, "low": x, "high": y} for p, x, y in zip(ps, lo, hi)])
        return pd.Series(out, dtype=object)

    return df.withColumn("quantiles", bounds("nodes", "counts"))


INSIDE, OUTSIDE, UNSURE = 0, 1, 2
#: Most keys that are sent to all executors; more are joined by a shuffle.
BROADCAST_KEYS = 50_000


def judge(n: int, below: np.ndarray, upto: np.ndarray, p: np.ndarray, slack: float) -> np.ndarray:
    """Whether values of these rank bounds lie between the quantiles p - slack and p + slack (linear between neighbours)."""
    lo, hi = (n - 1) * np.maximum(p - slack, 0), (n - 1) * np.minimum(p + slack, 1)
    k, j = np.floor(lo), np.floor(hi)
    ends = lambda h, k: np.where(h > k, k + 2, k + 1)  # noqa: E731  values smaller that put the quantile below
    sure_low, not_low = upto <= k, below >= ends(lo, k)
    sure_high, not_high = below >= ends(hi, j), upto <= j
    return np.where(sure_low | sure_high, OUTSIDE, np.where(not_low & not_high, INSIDE, UNSURE))


def enclosure(frames: DataFrame, quantiles: DataFrame, keys: Sequence[str], value: str, unique: Sequence[str], universe: Universe | None = None, levels: int = 1) -> DataFrame:
    """(keys, p, n, holds) of the rows of :func:`digest_quantiles`, by counting all readings.

    holds: the bounds enclose the order statistic at rank floor((n - 1) p), and no more than 2 * levels * error * n readings,
    besides those in the bounds' outer cells, lie between them; ``levels`` is how often digests were merged to coarser keys, plus 1.
    """
    u, keys = universe or Universe(), list(keys)
    d = frames.where(F.col(value).between(u.low, u.high)).select(*keys, *(F.col(c).alias(f"_u{i}") for i, c in enumerate(unique)), F.col(value).alias("_x"))
    d = d.distinct() if unique else d
    q = quantiles.select(*keys, F.col("n").alias("_n"), F.inline("quantiles"))
    x, cell = F.col("_x"), (u.high - u.low) / u.cells
    near = 1e-9  # a value on a cell's edge may be quantized to either side
    c = (d.join(q, keys) if keys else d.crossJoin(F.broadcast(q))).groupBy(*keys, "_n", "p", "low", "high").agg(  # without keys one row per p
        F.count(F.lit(1)).alias("n"), F.sum((x < F.col("low") - near).cast("bigint")).alias("_below"), F.sum((x <= F.col("high") + near).cast("bigint")).alias("_upto"),
        F.sum(((x > F.col("low") + cell) & (x < F.col("high") - cell)).cast("bigint")).alias("_inside"),
    )
    k = F.floor((F.col("n") - 1) * F.col("p"))
    holds = (F.col("n") == F.col("_n")) & (F.col("_below") <= k) & (F.col("_upto") > k) & (F.col("_inside") <= 2 * levels * u.error * F.col("n"))
    return c.select(*keys, "p", "n", holds.alias("holds"))


def check_stored(frames: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, unique: Sequence[str], stats: dict[str, float], slack: float = 0.002, universe: Universe | None = None) -> DataFrame:
    """(keys, stat) of stored percentiles outside the quantiles p - slack to p + slack of their key's readings.

    The digests decide all stored values but those whose rank bounds straddle a limit; these are then counted
    exactly. A null stored value is never wrong, NaN always is; a key without readings is not judged.
    """
    u = universe or Universe()
    keys, names = list(keys), list(stats)
    ps = np.array([stats[s] for s in names])
    digest = digests(frames, keys, value, unique, u)
    wide = stored.select(*keys, *names).join(digest, keys)

    @F.pandas_udf("array<int>")
    def verdicts(n: pd.Series, nodes: pd.Series, counts: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for m, a, b, v in zip(n, nodes, counts, values):
            v = np.array([np.nan if x is None else x for x in v], float)
            below, upto = rank_bounds(np.asarray(a, np.int64), np.asarray(b, np.int64), v, u)
            out.append(np.where(np.isnan(v), OUTSIDE, judge(m, below, upto, ps, slack)).astype("i4"))
        return pd.Series(out, dtype=object)

    rows = F.explode(F.arrays_zip(F.array(*(F.lit(s) for s in names)).alias("stat"), F.array(*(F.lit(float(p)) for p in ps)).alias("p"), F.array(*names).alias("s"), F.col("_v").alias("v")))
    judged = cut_lineage(
        wide.withColumn("_v", verdicts("n", "nodes", "counts", F.array(*names))).select(*keys, "n", rows.alias("z"))
        .select(*keys, "n", "z.stat", "z.p", "z.s", "z.v").where(F.col("s").isNotNull() & (F.col("v") != INSIDE))
    )
    unsure = judged.where(F.col("v") == UNSURE)
    sure = judged.where(F.col("v") == OUTSIDE).select(*keys, "stat")
    return sure if unsure.isEmpty() else sure.unionByName(_count_exactly(frames, unsure, keys, value, unique, slack, u))


def _count_exactly(frames: DataFrame, unsure: DataFrame, keys: list[str], value: str, unique: Sequence[str], slack: float, u: Universe) -> DataFrame:
    """Exact check of stored values by counts and neighbours, with partial sums; no group of readings is gathered."""
    d = frames.where(F.col(value).between(u.low, u.high)).select(*keys, *(F.col(c).alias(f"_u{i}") for i, c in enumerate(unique)), F.col(value).alias("_x"))
    few = unsure.select(*keys).distinct()
    if few.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        few = F.broadcast(few)
    d = d.join(few, keys, "left_semi")
    if unique:
        d = d.distinct()
    asked = unsure.select(*keys, F.col("stat").alias("_stat"), F.col("p").alias("_p"), F.col("s").alias("_s"))
    x, s = F.col("_x"), F.col("_s")
    c = (
        d.join(asked, keys).groupBy(*keys, "_stat", "_p", "_s")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((x < s).cast("bigint")).alias("lt"), F.sum((x <= s).cast("bigint")).alias("le"),
            F.max(F.when(x < s, x)).alias("lt_x"), F.min(F.when(x >= s, x)).alias("ge_x"),
            F.max(F.when(x <= s, x)).alias("le_x"), F.min(F.when(x > s, x)).alias("gt_x"),
        )
    )
    lo, hi = (F.col("n") - 1) * F.greatest(F.col("_p") - slack, F.lit(0.0)), (F.col("n") - 1) * F.least(F.col("_p") + slack, F.lit(1.0))
    k, j = F.floor(lo), F.floor(hi)
    # s is below Q = x_k + f (x_k+1 - x_k): none of x_k, x_k+1 <= s; or x_k <= s < x_k+1 and the blend is larger
    low = (F.col("le") <= k) | ((F.col("le") == k + 1) & (F.col("le_x") + (lo - k) * (F.coalesce("gt_x", "le_x") - F.col("le_x")) > s))
    high = (F.col("lt") >= j + 2) | ((F.col("lt") == j + 1) & (F.col("lt_x") + (hi - j) * (F.coalesce("ge_x", "lt_x") - F.col("lt_x")) < s))
    return c.where(low | high).select(*keys, F.col("_stat").alias("stat"))
