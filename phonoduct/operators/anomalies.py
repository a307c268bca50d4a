"""Readings that cannot be true for their source: impossible values, stuck runs, spikes, bad rates.

One pass over the frames, in blocks of a series with a halo, does in numpy

* the range check and the constant-run check,
* a robust seasonal-trend decomposition of the readings that remain (running-median trend,
  per-phase medians as season), and on its residuals the generalised extreme studentised deviate
  (ESD) test per source,
* for each reading the height of its excursion over its two neighbours.

A block never needs more than its halo, so a hot series is split over tasks. In a series of several blocks they only take
the trend away; season, centre, test and median change are those of the whole series, whatever the number of its blocks.

:func:`esd_frames` makes the ESD test the verdict. :func:`flag_frames` compares every excursion's height with the
series' median absolute change, whether the ESD test calls it or not, and says of each spike if that test calls it too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.operators.ranks import exact_percentiles
from phonoduct.runtime import cut_lineage, per_groups


@dataclass(frozen=True)
class Limits:
    """What counts as bad; the defaults are those of natural-log pitch."""

    low: float = math.log(20)
    high: float = math.log(2000)
    stuck_frames: int = 20
    stuck_within: float = 0.00015
    spike_frames: int = 3
    spike_times: float = 13.0
    trend_window: int = 7
    period: int | None = None
    alpha: float = 0.5
    block: int = 65_536


_OUT = pa.schema([("series_id", pa.string()), ("what", pa.int8()), ("idx", pa.int64()), ("value", pa.float64())])
_DDL = "series_id string, what tinyint, idx bigint, value double"
BAD, CANDIDATE, MEDIAN, RESIDUAL, CALLED = 0, 1, 2, 3, 4
# The rational approximation 26.2.23 of Abramowitz and Stegun to normal quantiles.
TAIL_UP, TAIL_DOWN = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)


def normal_tail(q: np.ndarray) -> np.ndarray:
    """z with P(Z > z) = q, for q <= 1/2, to 0.00045."""
    t = np.sqrt(-2 * np.log(q))
    return t - (TAIL_UP[0] + t * (TAIL_UP[1] + t * TAIL_UP[2])) / (1 + t * (TAIL_DOWN[0] + t * (TAIL_DOWN[1] + t * TAIL_DOWN[2])))


def esd_limits(n: np.ndarray, i: np.ndarray, alpha: float) -> np.ndarray:
    """Critical value of the i-th (from 1) generalised ESD statistic of n values (Rosner 1983)."""
    nu = np.maximum(n - i - 1, 1).astype(float)
    z = normal_tail(np.minimum(alpha / (2 * (n - i + 1)), 0.5))
    t = z + (z**3 + z) / (4 * nu) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * nu**2)
    return (n - i) * t / np.sqrt((nu + t * t) * (n - i + 1))


def esd_outliers(r: np.ndarray, starts: np.ndarray, alpha: float) -> np.ndarray:
    """Outliers of each group of residuals by the generalised ESD test, up to half of a group.

    The statistics after each removal come from suffix sums of the group in order of distance from
    its median, so all groups are tested at once without a loop. Of equal distances the later is removed first.
    """
    out = np.zeros(len(r), bool)
    if not len(r):
        return out
    sizes = np.diff(np.append(starts, len(r)))
    group = np.repeat(np.arange(len(starts)), sizes)
    order = np.lexsort((r, group))
    mid = (r[order[starts + (sizes - 1) // 2]] + r[order[starts + sizes // 2]]) / 2
    away = np.abs(r - mid[group])
    order = np.lexsort((-np.arange(len(r)), -away, group))
    x = (r - mid[group])[order]
    c1, c2 = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
    at, end = np.arange(len(x)), (starts + sizes)[group]
    left = end - at
    mean = (c1[end] - c1[at]) / left
    var = np.maximum(c2[end] - c2[at] - left * mean * mean, 0) / np.maximum(left - 1, 1)
    i = at - starts[group] + 1
    n = sizes[group]
    dev = np.abs(x - mean)
    beyond = (dev > esd_limits(n, i, alpha) * np.sqrt(var)) & (i <= np.maximum(n // 2, 1)) & (left > 2)
    count = np.zeros(len(starts), int)
    np.maximum.at(count, group[beyond], i[beyond])
    out[order] = i <= count[group]
    return out


def decompose(x: np.ndarray, starts: np.ndarray, window: int, period: int | None = None, phase: np.ndarray | None = None):
    """(trend, season) of consecutive groups of readings.

    Trend is the running median of ``window`` readings, at the edges of the first or last ``window``; season,
    with a period, the median of what the trend leaves at each phase of each group.
    """
    n = len(x)
    sizes = np.diff(np.append(starts, n))
    s, e = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    first = np.clip(np.arange(n) - window // 2, s, np.maximum(s, e - window))
    trend = np.empty(n)
    for a in range(0, n, 100_000):
        at = np.minimum(first[a : a + 100_000, None] + np.arange(window), e[a : a + 100_000, None] - 1)
        trend[a : a + 100_000] = np.median(x[at], axis=1)
    season = np.zeros(n)
    if period:
        key = np.repeat(np.arange(len(starts)), sizes) * period + (np.arange(n) - s if phase is None else phase) % period
        order = np.lexsort((x - trend, key))
        new = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        size = np.diff(np.append(new, n))
        rest = (x - trend)[order]
        season[order] = np.repeat((rest[new + (size - 1) // 2] + rest[new + size // 2]) / 2, size)
    return trend, season


def _runs(link: np.ndarray) -> np.ndarray:
    return np.cumsum(~link)


def stuck(x: np.ndarray, link: np.ndarray, frames: int, within: float) -> np.ndarray:
    """Rows in ``frames`` or more linked rows that lie within ``within`` of each other."""
    n, out = len(x), np.zeros(len(x), bool)
    if n < frames:
        return out
    run, low, high, have = _runs(link), x, x, 1
    while have < frames:  # windows double, the last step overlaps
        step = min(have, frames - have)
        m = len(low) - step
        low, high, have = np.minimum(low[:m], low[step:]), np.maximum(high[:m], high[step:]), have + step
    good = (run[: n - frames + 1] == run[frames - 1 :]) & (high - low <= within)
    edge = np.zeros(n + 1, int)
    np.add.at(edge, np.flatnonzero(good), 1)
    np.add.at(edge, np.flatnonzero(good) + frames, -1)
    return np.cumsum(edge)[:n] > 0


def heights(x: np.ndarray, link: np.ndarray, longest: int) -> np.ndarray:
    """For each row the most that an excursion of at most ``longest`` linked rows holding it rises above, or falls below, both its neighbours."""
    n, out, run = len(x), np.full(len(x), -np.inf), _runs(link)
    for size in range(1, longest + 1):
        m = n - size - 1
        if m <= 0:
            break
        low = high = x[1 : 1 + m]
        for k in range(1, size):
            low, high = np.minimum(low, x[1 + k : 1 + k + m]), np.maximum(high, x[1 + k : 1 + k + m])
        a, b = x[:m], x[size + 1 :]
        h = np.maximum(low - np.maximum(a, b), np.minimum(a, b) - high)
        h = np.where(run[:m] == run[size + 1 :], h, -np.inf)
        for k in range(size):
            out[1 + k : 1 + k + m] = np.maximum(out[1 + k : 1 + k + m], h)
    return out


def group_medians(v: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(median, count) of v in each group; NaN for an empty one."""
    order = np.lexsort((v, group))
    size = np.bincount(group, minlength=groups)
    at = np.cumsum(size) - size
    w = np.append(v[order], np.nan)
    lo, hi = np.minimum(at + np.maximum(size - 1, 0) // 2, len(v)), np.minimum(at + size // 2, len(v))
    return np.where(size > 0, (w[lo] + w[hi]) / 2, np.nan), size


def _clean(t: pa.Table, at: np.ndarray, lim: Limits):
    """The distinct frames of a table of whole blocks: (row, group, idx, value, impossible, stuck, usable, link)."""
    idx = t.column("idx").to_numpy()
    x = t.column("x").to_numpy()
    first = np.zeros(len(idx), bool)
    first[at] = True
    keep = first.copy()
    keep[1:] |= idx[1:] != idx[:-1]
    row = np.flatnonzero(keep)
    group = np.cumsum(first)[row] - 1
    idx, x = idx[row], x[row]
    next_to = np.zeros(len(row), bool)
    next_to[1:] = (group[1:] == group[:-1]) & (idx[1:] == idx[:-1] + 1)
    with np.errstate(invalid="ignore"):
        impossible = ~np.isfinite(x) | ((x != 0) & ((x < lim.low) | (x > lim.high)))
    fine = ~impossible & (x != 0)
    link = next_to.copy()
    link[1:] &= fine[1:] & fine[:-1]
    still = stuck(np.where(fine, x, 0.0), link, lim.stuck_frames, lim.stuck_within)
    use = fine & ~still
    return row, group, idx, x, impossible, still, use, next_to


def _excursions(ux: np.ndarray, u: np.ndarray, next_to: np.ndarray, frames: int):
    """(link, height, change) of the usable readings ``u``: whether each follows the one before it, its excursion's height, its change."""
    link = next_to[u].copy()
    link[1:] &= u[1:] == u[:-1] + 1
    if len(link):
        link[0] = False
    return link, heights(ux, link, frames), np.abs(np.diff(ux, prepend=0.0))


def _scan(lim: Limits):
    """The verdicts on blocks that are whole series, and a row for each block that holds usable readings.

    A spike is ``CALLED`` where the ESD test calls it an outlier too, else ``CANDIDATE``.
    """

    def blocks(t: pa.Table, at: np.ndarray) -> pa.Table:
        row, group, idx, x, impossible, still, use, next_to = _clean(t, at, lim)
        own = _owner(idx, lim.block) == t.column("block").to_numpy()[row]
        u = np.flatnonzero(use)
        ux, ug = x[u], group[u]
        starts = np.flatnonzero(np.append(True, np.diff(ug) != 0)) if len(u) else np.zeros(0, int)
        trend, season = decompose(ux, starts, lim.trend_window, lim.period, idx[u])
        odd = esd_outliers(ux - trend - season, starts, lim.alpha)

        link, h, change = _excursions(ux, u, next_to, lim.spike_frames)
        mine = link & own[u]
        med, _ = group_medians(change[mine], ug[mine], len(at))
        spike = own[u] & (h > 0) & (h > lim.spike_times * med[ug])
        b, c, m = np.flatnonzero((impossible | still) & own), u[spike], np.flatnonzero(np.bincount(ug[own[u]], minlength=len(at)))
        rows = np.concatenate([row[b], row[c], at[m]])
        what = np.concatenate([np.full(len(b), BAD), np.where(odd[spike], CALLED, CANDIDATE), np.full(len(m), MEDIAN)]).astype("i1")
        return pa.table(
            [t.column("series_id").take(pa.array(rows)), pa.array(what), pa.array(np.concatenate([idx[b], idx[c], m])), pa.array(np.concatenate([np.zeros(len(b)), h[spike], med[m]]))],
            schema=_OUT,
        )

    return blocks


def _detrend(lim: Limits):
    """The fixed bad frames of each block, and what the trend leaves of its usable readings."""

    def blocks(t: pa.Table, at: np.ndarray) -> pa.Table:
        row, group, idx, x, impossible, still, use, _ = _clean(t, at, lim)
        own = _owner(idx, lim.block) == t.column("block").to_numpy()[row]
        u = np.flatnonzero(use)
        starts = np.flatnonzero(np.append(True, np.diff(group[u]) != 0)) if len(u) else np.zeros(0, int)
        rest = x[u] - decompose(x[u], starts, lim.trend_window)[0]
        b, mine = np.flatnonzero((impossible | still) & own), own[u]
        rows = np.concatenate([b, u[mine]])
        return pa.table(
            [
                t.column("series_id").take(pa.array(row[rows])),
                pa.array(np.repeat(np.array([BAD, RESIDUAL], "i1"), [len(b), int(mine.sum())])),
                pa.array(idx[rows]),
                pa.array(np.concatenate([np.zeros(len(b)), rest[mine]])),
            ],
            schema=_OUT,
        )

    return blocks


def _esd(lim: Limits):
    """The verdict on blocks that are whole series, and a row that says that there is such a block."""

    def blocks(t: pa.Table, at: np.ndarray) -> pa.Table:
        row, group, idx, x, impossible, still, use, _ = _clean(t, at, lim)
        own = _owner(idx, lim.block) == t.column("block").to_numpy()[row]
        u = np.flatnonzero(use)
        starts = np.flatnonzero(np.append(True, np.diff(group[u]) != 0)) if len(u) else np.zeros(0, int)
        trend, season = decompose(x[u], starts, lim.trend_window, lim.period, idx[u])
        b, c = np.flatnonzero((impossible | still) & own), u[esd_outliers(x[u] - trend - season, starts, lim.alpha)]
        some = np.flatnonzero(np.bincount(group[own], minlength=len(at)))  # not by a neighbour's halo alone
        rows = np.concatenate([row[b], row[c], at[some]])
        what = np.repeat(np.array([BAD, CANDIDATE, MEDIAN], "i1"), [len(b), len(c), len(some)])
        return pa.table([t.column("series_id").take(pa.array(rows)), pa.array(what), pa.array(np.concatenate([idx[b], idx[c], some])), pa.array(np.zeros(len(rows)))], schema=_OUT)

    return blocks


def _changes(lim: Limits):
    """The change to each usable reading from the one before it, as ``RESIDUAL``, and the height of each excursion."""

    def blocks(t: pa.Table, at: np.ndarray) -> pa.Table:
        row, _, idx, x, _, _, use, next_to = _clean(t, at, lim)
        own = _owner(idx, lim.block) == t.column("block").to_numpy()[row]
        u = np.flatnonzero(use)
        link, h, change = _excursions(x[u], u, next_to, lim.spike_frames)
        mine, high = link & own[u], own[u] & (h > 0)
        rows = np.concatenate([u[mine], u[high]])
        return pa.table(
            [
                t.column("series_id").take(pa.array(row[rows])),
                pa.array(np.repeat(np.array([RESIDUAL, CANDIDATE], "i1"), [int(mine.sum()), int(high.sum())])),
                pa.array(idx[rows]),
                pa.array(np.concatenate([change[mine], h[high]])),
            ],
            schema=_OUT,
        )

    return blocks


def _owner(idx: np.ndarray, block: int) -> np.ndarray:
    return np.maximum(idx // block, 0)


def _blocks(frames: DataFrame, lim: Limits) -> DataFrame:
    """Frames sorted by series, block and idx; each block also holds the frames within a halo of it."""
    halo = lim.stuck_frames + lim.spike_frames + lim.trend_window + 2
    b = F.greatest(F.floor(F.col("idx") / F.lit(lim.block)), F.lit(0)).cast("bigint")
    near_start = (F.col("b") > 0) & (F.col("idx") - F.col("b") * lim.block < halo)
    near_end = (F.col("b") + 1) * lim.block - F.col("idx") <= halo
    where = F.filter(F.array("b", F.when(near_start, F.col("b") - 1), F.when(near_end, F.col("b") + 1)), lambda k: k.isNotNull())
    return (
        frames.withColumn("b", b)
        .select("series_id", F.explode(where).alias("block"), "idx", "x")
        .repartition("series_id", "block")
        .sortWithinPartitions("series_id", "block", "idx", "x")
    )


def exact_group_median(df: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """(keys, median) of doubles, exact, without gathering a key in one task."""
    keys = [key] if isinstance(key, str) else list(key)
    return exact_percentiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("median"))


def esd_limit(n: Column, i: Column, alpha: float) -> Column:
    """Critical value of the i-th (from 1) generalised ESD statistic of n values, as :func:`esd_limits`, as an expression."""
    nu = F.greatest(n - i - 1, F.lit(1)).cast("double")
    t = F.sqrt(-2 * F.ln(F.least(F.lit(alpha) / (2 * (n - i + 1)), F.lit(0.5))))
    z = t - (TAIL_UP[0] + t * (TAIL_UP[1] + t * TAIL_UP[2])) / (1 + t * (TAIL_DOWN[0] + t * (TAIL_DOWN[1] + t * TAIL_DOWN[2])))
    student = z + (z**3 + z) / (4 * nu) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * nu * nu)
    return (n - i) * student / F.sqrt((nu + student * student) * (n - i + 1))


def esd_outliers_by_group(df: DataFrame, key: str, value: str, order: str, alpha: float) -> DataFrame:
    """(key, order) of each group's outliers by the generalised ESD test, up to half of a group, ranked by distance from 0.

    A group's values are summed by cells of their distance first. The statistics of a value, which need all values no farther
    out, come from the cells below and a running sum within its cell, so that no task sees a whole group. Of equal
    distances the later in ``order`` is removed first. Only the outer half of a group's values is looked at one by one.
    """
    x = F.col("x")
    d = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).alias("x")).withColumn("d", F.abs("x"))
    d = d.withColumn("c", F.floor(F.log2(F.greatest("d", F.lit(1e-300))) * 64).cast("bigint"))
    below, all_ = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("k")
    sums = {"n": F.count(F.lit(1)), "s": F.sum(x), "q": F.sum(x * x)}
    cells = d.groupBy("k", "c").agg(*[v.alias(k) for k, v in sums.items()])
    cells = cells.select("k", "c", F.col("n").alias("here"), F.sum("n").over(all_).alias("total"), *[F.coalesce(F.sum(k).over(below), F.lit(0)).alias(f"{k}0") for k in sums])
    cells = cells.where(F.col("n0") + F.col("here") > F.col("total") / 2).drop("here")
    upto = Window.partitionBy("k", "c").orderBy("d", "o").rowsBetween(Window.unboundedPreceding, 0)
    left, s, q = F.count(F.lit(1)).over(upto) + F.col("n0"), F.sum(x).over(upto) + F.col("s0"), F.sum(x * x).over(upto) + F.col("q0")
    e = d.join(cells, ["k", "c"]).select("k", "o", "x", "total", left.alias("left"), s.alias("s"), q.alias("q")).withColumn("i", F.col("total") - F.col("left") + 1)
    mean = F.col("s") / F.col("left")
    spread = F.sqrt(F.greatest(F.col("q") - F.col("left") * mean * mean, F.lit(0.0)) / F.greatest(F.col("left") - 1, F.lit(1)))
    beyond = (F.abs(x - mean) > esd_limit(F.col("total"), F.col("i"), alpha) * spread) & (F.col("i") <= F.greatest(F.floor(F.col("total") / 2), F.lit(1))) & (F.col("left") > 2)
    e = cut_lineage(e.select("k", "o", "i", beyond.alias("beyond")))
    many = e.where("beyond").groupBy("k").agg(F.max("i").alias("many"))
    return e.join(many, "k").where("i <= many").select(F.col("k").alias(key), F.col("o").alias(order))


def esd_frames(df: DataFrame, series: str = "series_id", idx: str = "idx", value: str = "lf0", limits: Limits | None = None) -> DataFrame:
    """(series_id, idx, kind) of each bad reading, judged by decomposition and ESD: ``fixed`` for range and stuck runs, ``spike``.

    The remaining readings of a series lose their running-median trend, with ``limits.period`` also the median of their phase,
    then the series' median; what the ESD test at ``limits.alpha`` calls an outlier is a spike. Season, centre and test
    are those of the whole series. Nulls, repeated and clashing rows are treated as by :func:`flag_frames`; an empty input gives
    an empty result. A block's trend differs from the whole series' only where fewer than half a trend window of
    readings lie within its halo.
    """
    lim = limits or Limits(alpha=0.05)
    readings = _readings(df, series, idx, value)
    found = cut_lineage(_blocks(readings, lim).mapInArrow(per_groups(_esd(lim), ["series_id", "block"], _OUT), _DDL))
    spikes = found.where(F.col("what") == CANDIDATE).select("series_id", "idx")
    split = found.where(F.col("what") == MEDIAN).groupBy("series_id").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("series_id")
    if not split.isEmpty():  # series of several blocks are judged as a whole
        spikes = spikes.join(split, "series_id", "left_anti").unionByName(_esd_of_split(readings.join(split, "series_id", "left_semi"), lim))
    return found.where(F.col("what") == BAD).select("series_id", "idx", F.lit("fixed").alias("kind")).unionByName(spikes.select("series_id", "idx", F.lit("spike").alias("kind")))


def _esd_of_split(readings: DataFrame, lim: Limits) -> DataFrame:
    """(series_id, idx) of spikes of series that lie in several blocks: only the trend is taken away block by block."""
    found = _blocks(readings, lim).mapInArrow(per_groups(_detrend(lim), ["series_id", "block"], _OUT), _DDL)
    r = cut_lineage(found.where(F.col("what") == RESIDUAL).select("series_id", "idx", "value"))
    if lim.period:
        r = r.withColumn("phase", F.pmod("idx", F.lit(lim.period)))
        r = cut_lineage(r.join(exact_group_median(r, ["series_id", "phase"], "value"), ["series_id", "phase"]).select("series_id", "idx", (F.col("value") - F.col("median")).alias("value")))
    x = cut_lineage(r.join(exact_group_median(r, "series_id", "value"), "series_id").select("series_id", "idx", (F.col("value") - F.col("median")).alias("x")))
    return esd_outliers_by_group(x, "series_id", "x", "idx", lim.alpha)


def _readings(df: DataFrame, series: str, idx: str, value: str) -> DataFrame:
    frames = df.select(F.col(series).cast("string").alias("series_id"), F.col(idx).cast("bigint").alias("idx"), F.col(value).cast("double").alias("x"))
    return frames.dropna(subset=["series_id", "idx"]).where(F.col("x").isNotNull())


def flag_frames(df: DataFrame, series: str = "series_id", idx: str = "idx", value: str = "lf0", limits: Limits | None = None) -> DataFrame:
    """(series_id, idx, kind, esd) of each bad reading; kind is ``range``/``stuck`` as ``fixed``, or ``spike``.

    A spike is an excursion of at most ``limits.spike_frames`` readings more than ``limits.spike_times`` times the series' median
    absolute change above, or below, both its neighbours. ``esd`` says whether decomposition and ESD test, as in :func:`esd_frames`,
    call it an outlier too; it neither adds nor removes a spike, and is null for fixed ones.
    Null readings are no readings, 0 means unvoiced; neither is ever bad. Rows with a null series or idx have
    no place in a series and are dropped. Repeated rows count once; of differing rows at one idx the
    smallest value counts (NaN is the largest). Empty input gives an empty result; other columns are ignored.
    """
    lim = limits or Limits(alpha=0.05)
    readings = _readings(df, series, idx, value)
    found = cut_lineage(_blocks(readings, lim).mapInArrow(per_groups(_scan(lim), ["series_id", "block"], _OUT), _DDL))
    spikes = found.where(F.col("what").isin(CANDIDATE, CALLED)).select("series_id", "idx", (F.col("what") == CALLED).alias("esd"))
    split = found.where(F.col("what") == MEDIAN).groupBy("series_id").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("series_id")
    if not split.isEmpty():  # series of several blocks are judged as a whole
        spikes = spikes.join(split, "series_id", "left_anti").unionByName(_spikes_of_split(readings.join(split, "series_id", "left_semi"), lim))
    fixed = found.where(F.col("what") == BAD).select("series_id", "idx", F.lit("fixed").alias("kind"), F.lit(None).cast("boolean").alias("esd"))
    return fixed.unionByName(spikes.select("series_id", "idx", F.lit("spike").alias("kind"), "esd"))


def _spikes_of_split(readings: DataFrame, lim: Limits) -> DataFrame:
    """(series_id, idx, esd) of spikes of series that lie in several blocks."""
    found = cut_lineage(_blocks(readings, lim).mapInArrow(per_groups(_changes(lim), ["series_id", "block"], _OUT), _DDL))
    medians = exact_group_median(found.where(F.col("what") == RESIDUAL), "series_id", "value")
    spikes = found.where(F.col("what") == CANDIDATE).join(medians, "series_id").where(F.col("value") > lim.spike_times * F.col("median"))
    called = _esd_of_split(readings, lim).withColumn("esd", F.lit(True))
    return spikes.select("series_id", "idx").join(called, ["series_id", "idx"], "left").select("series_id", "idx", F.coalesce("esd", F.lit(False)).alias("esd"))


def bad_rates(meta: DataFrame, within: float = 0.05) -> DataFrame:
    """series_id of ``f0`` series whose rate is not within ``within`` of the rate most ``f0`` series of their tracker have.

    Repeated rows count once. Null rates are never bad; a series without a tracker has no norm and is never bad. The
    smallest of tied rates is the norm; rates that are not finite and positive are never the norm.
    """
    f0 = meta.where("feature = 'f0' and series_id is not null").select("series_id", "tracker", "rate").distinct()
    sound = f0.where("rate > 0 and not isnan(rate) and rate < double('infinity')")
    norm = (
        sound.groupBy("tracker", "rate").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tracker").agg(F.max_by("rate", F.struct("n", -F.col("rate"))).alias("norm"))
    )
    near = F.abs(F.col("rate") - F.col("norm")) <= within * F.col("norm")
    bad = F.col("rate").isNotNull() & (F.isnan("rate") | ~near)
    return f0.join(norm, "tracker").where(bad).select("series_id").distinct()
