"""Pitch tracks (series_id, idx, lf0, voiced): natural-log Hz, null where unvoiced.

The stored form with 0 for unvoiced frames is made and read at the boundary only (:func:`stored`, :func:`loaded`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.operators.ranks import exact_percentiles
from phonoduct.operators.series import KEY, with_nearest
from phonoduct.runtime import cut_lineage

PERCENTS = [0.0, 0.1, 0.3, 0.5, 1.0, 99.0, 99.5, 99.7, 99.9, 100.0]
STATISTICS = ["mean", "median", "std", "min", "max", "q001", "q003", "q005", "q01", "q99", "q995", "q997", "q999"]


def frame_rate(frame_period_ms: float) -> int:
    """Frames a second, as a whole number: a period of 7.5 ms gives 133."""
    return int(1000 // frame_period_ms)


def from_frequency(df: DataFrame, hz: str = "hz") -> DataFrame:
    """(series_id, idx, lf0, voiced) of frequencies in Hz, 0 (or null) for unvoiced."""
    voiced = F.coalesce(F.col(hz) != 0, F.lit(False))
    return df.select(KEY, "idx", F.when(voiced, F.ln(hz)).alias("lf0"), voiced.alias("voiced"))


def stored(df: DataFrame) -> DataFrame:
    """lf0 with 0 for unvoiced frames."""
    return df.select(KEY, "idx", F.coalesce("lf0", F.lit(0.0)).alias("lf0"))


def loaded(df: DataFrame, lf0: str = "lf0", vuv: str | None = None) -> DataFrame:
    """Read the stored form; with a ``vuv`` column that decides what is voiced, else lf0 != 0."""
    voiced = F.coalesce((F.col(vuv) if vuv else F.col(lf0)) != 0, F.lit(False))
    return df.select(KEY, "idx", F.when(voiced | F.lit(vuv is not None), F.col(lf0)).alias("lf0"), voiced.alias("voiced"))


def fill_unvoiced(df: DataFrame, block: int = 65_536) -> DataFrame:
    """lf0 of unvoiced frames by linear interpolation between voiced ones, constant at the ends; voiced says which were measured.

    A series without a voiced frame keeps null lf0.
    """
    d = with_nearest(df, F.col("voiced"), "lf0", block)
    a, b = F.col("before"), F.col("after")
    blend = a.v + (b.v - a.v) * (F.col("idx") - a.idx) / (b.idx - a.idx)
    inner = F.when(a.idx == b.idx, a.v).otherwise(F.coalesce(blend, a.v, b.v))
    return d.withColumn("lf0", inner).drop("before", "after")


def voiced(df: DataFrame) -> DataFrame:
    return df.where("voiced")


def hertz(df: DataFrame) -> DataFrame:
    """(series_id, idx, hz) of voiced frames."""
    return voiced(df).select(KEY, "idx", F.exp("lf0").alias("hz"))


def statistics(df: DataFrame) -> DataFrame:
    """One row (mean, var): mean and population variance of the voiced lf0."""
    return voiced(df).agg(F.avg("lf0").alias("mean"), F.var_pop("lf0").alias("var"))


def _side(stats: DataFrame | None, mean: float | None, var: float | None, spark) -> DataFrame:
    if (stats is None) == (mean is None and var is None):
        raise ValueError("give either statistics or mean and var")
    return stats.select("mean", "var") if stats is not None else spark.createDataFrame([(float(mean), float(var))], "mean double, var double")


def convert(
    df: DataFrame, input_statistics: DataFrame | None = None, target_statistics: DataFrame | None = None, input_mean: float | None = None, input_var: float | None = None,
    target_mean: float | None = None, target_var: float | None = None, with_vuv: bool = False, scale: str = "var",
) -> DataFrame:
    """Move lf0 from one speaker's mean and variance to another's: (tv / iv) * (lf0 - im) + tm.

    The ratio is that of variances; ``scale="std"`` takes that of deviations. ``with_vuv`` converts all frames, else only
    voiced ones. Statistics are one-row DataFrames.
    """
    i = _side(input_statistics, input_mean, input_var, df.sparkSession).select(F.col("mean").alias("im"), F.col("var").alias("iv"))
    t = _side(target_statistics, target_mean, target_var, df.sparkSession).select(F.col("mean").alias("tm"), F.col("var").alias("tv"))
    ratio = F.col("tv") / F.col("iv")
    new = (F.sqrt(ratio) if scale == "std" else ratio) * (F.col("lf0") - F.col("im")) + F.col("tm")
    d = df.crossJoin(F.broadcast(i)).crossJoin(F.broadcast(t))  # one row each
    return d.withColumn("lf0", new if with_vuv else F.when(F.col("voiced"), new).otherwise(F.col("lf0"))).drop("im", "iv", "tm", "tv")


def percentiles(df: DataFrame, percents: Sequence[float] = PERCENTS) -> DataFrame:
    """(percent, hz int): percentiles of the voiced frequencies, rounded half to even."""
    q = exact_percentiles(hertz(df), [], "hz", [p / 100 for p in percents])
    at = F.array(*[F.lit(float(p)) for p in percents])
    return q.select(F.inline(F.arrays_zip(at.alias("percent"), F.col("q").alias("hz")))).select("percent", F.rint("hz").cast("int").alias("hz"))


def log_statistics(df: DataFrame, lf0: str = "lf0", by: Sequence[str] = ()) -> DataFrame:
    """The 13 statistics of ln f0, one row, or one per group.

    Percentiles are exact, by counts of cells and values (:func:`exact_percentiles`), as a hot group's values fit no task.
    """
    by = list(by)
    q = exact_percentiles(df, by, lf0, [0.5, 0.001, 0.003, 0.005, 0.01, 0.99, 0.995, 0.997, 0.999])
    a = df.groupBy(*by).agg(F.avg(lf0).alias("mean"), F.stddev_pop(lf0).alias("std"), F.min(lf0).alias("min"), F.max(lf0).alias("max"))
    if by:
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"q.{k}")) for k in by]
        a = a.alias("a").join(q.alias("q"), reduce(Column.__and__, same), "left").select("a.*", "q.q")
    else:
        a = a.join(F.broadcast(q), how="left")  # one row each
    return a.select(*by, "mean", F.get("q", F.lit(0)).alias("median"), "std", "min", "max", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(STATISTICS[5:], 1)])


# ---------------------------------------------------------------- range finding

def expand_in_logspace(floor: float, ceil: float, ratio: float) -> tuple[float, float]:
    """Widen a range by ``ratio`` of its logarithmic width on both sides."""
    a, b = math.log(floor), math.log(ceil)
    return math.exp(a - ratio * (b - a)), math.exp(b + ratio * (b - a))


def drop_quiet(df: DataFrame, volume: str = "volume", below: float = 45.0) -> DataFrame:
    """Rows at most ``below`` under the loudest."""
    top = df.agg(F.max(volume).alias("_top"))
    return df.crossJoin(F.broadcast(top)).where(F.col(volume) >= F.col("_top") - below).drop("_top")  # one row


def unit_volume(df: DataFrame, volume: str = "volume") -> DataFrame:
    """Add norm_volume, volume from 0 to 1; null where all rows are as loud."""
    ends = df.agg(F.min(volume).alias("_lo"), F.max(volume).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    norm = F.when(width != 0, (F.col(volume) - F.col("_lo")) / width)
    return df.crossJoin(F.broadcast(ends)).withColumn("norm_volume", norm).drop("_lo", "_hi")  # one row


def vote_bins(df: DataFrame, hz: str, floor: float, ceil: float, bins: int = 99) -> Column:
    """0-based bin of ``bins`` equal ones on a log scale over the range widened by 5 %; the last bin is closed."""
    a, b = (math.log(x) for x in expand_in_logspace(floor, ceil, 0.05))
    return F.least(F.floor((F.ln(hz) - a) / ((b - a) / bins)), F.lit(bins - 1)).cast("int")


def drop_low_votes(df: DataFrame, hz: str = "hz", weight: str = "norm_volume", floor: float = 40.0, ceil: float = 800.0, share: float = 0.003, bins: int = 99, next_bin: bool = True) -> DataFrame:
    """Rows whose bin holds at least ``share`` of all weight.

    By default a row is judged by the bin after its own (the last by itself), as the established results are; ``next_bin=False``
    judges it by its own.
    """
    d = df.withColumn("_bin", vote_bins(df, hz, floor, ceil, bins))
    votes = d.where(F.col("_bin").between(0, bins - 1)).groupBy("_bin").agg(F.sum(weight).alias("_votes"))
    total = votes.agg(F.sum("_votes").alias("_all"))
    judged = F.least(F.col("_bin") + (1 if next_bin else 0), F.lit(bins - 1))
    d = d.withColumn("_bin", judged).join(F.broadcast(votes), "_bin", "left").crossJoin(F.broadcast(total))  # at most `bins` rows, and one
    return d.where(F.coalesce("_votes", F.lit(0.0)) >= share * F.col("_all")).drop("_bin", "_votes", "_all")


def histogram(df: DataFrame, hz: str, floor: float, ceil: float, weight: str | None = None, bins: int = 99) -> DataFrame:
    """(bin, n): log-scale histogram, weighted if asked for."""
    d = df.select(vote_bins(df, hz, floor, ceil, bins).alias("bin"), F.col(weight).alias("w") if weight else F.lit(1.0).alias("w"))
    return d.where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.sum("w").alias("n"))


def histogram_2d(df: DataFrame, hz: str, volume: str, floor: float, ceil: float, bins: int = 99, volume_bins: int = 100) -> DataFrame:
    """(bin, volume_bin, n) over log frequency and volume from 0 to 1."""
    v = F.least(F.floor(F.col(volume) * volume_bins), F.lit(volume_bins - 1)).cast("int")
    d = df.select(vote_bins(df, hz, floor, ceil, bins).alias("bin"), v.alias("volume_bin"))
    return d.where(F.col("bin").between(0, bins - 1)).groupBy("bin", "volume_bin").agg(F.count(F.lit(1)).alias("n"))


def weighted_percentiles(df: DataFrame, value: str, weight: str, percents: Sequence[float], cells: int = 4096) -> DataFrame:
    """(percent, value): interpolated on the running sum of weights in order of value.

    With C the running sums and t = percent / 100 of their last: the first value for t <= C[0], else linear between the
    neighbours of the first C >= t. Sums are made per value, then per cell of the value range; only the cell that
    holds t is looked at value by value, so no task sees all values in order.
    """
    d = df.select(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).where("v is not null and w is not null")
    per = d.groupBy("v").agg(F.sum("w").alias("w"), F.min("w").alias("first"))
    ends = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))).otherwise(0).cast("int")
    per = per.crossJoin(F.broadcast(ends)).withColumn("cell", cell)  # one row
    w = Window.orderBy("cell")  # at most `cells` rows
    sums = per.groupBy("cell").agg(F.sum("w").alias("w"), F.max("v").alias("top")).select(
        "cell", F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"), F.sum("w").over(w).alias("upto"),
        F.lag("top").over(w).alias("prev_top"), F.sum("w").over(Window.partitionBy()).alias("total"),
    )
    at = sums.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn("t", F.col("percent") / 100 * F.col("total"))
    first = F.row_number().over(Window.partitionBy("percent").orderBy("cell"))
    at = at.where("upto >= t or upto >= total").withColumn("_r", first).where("_r = 1").select("percent", "t", "cell", "base", "prev_top")
    inside = Window.partitionBy("percent").orderBy("v")
    v = per.join(F.broadcast(at), "cell").withColumn("c", F.sum("w").over(inside) + F.col("base")).withColumn("p", F.coalesce(F.lag("v").over(inside), F.col("prev_top")))
    v = v.where(F.col("c") >= F.col("t") * (1 - 1e-15)).withColumn("_r", F.row_number().over(inside)).where("_r = 1")
    start = F.col("c") - F.col("w")
    into = F.least((F.col("t") - start) / F.col("first"), F.lit(1.0))
    out = F.when(F.col("p").isNull() | (F.col("first") == 0), F.col("v")).otherwise(F.col("p") + F.greatest(into, F.lit(0.0)) * (F.col("v") - F.col("p")))
    return v.select("percent", out.alias("value"))


def duration_groups(files: DataFrame, target: float, seed: int = 0, key: str = KEY, seconds: str = "seconds") -> DataFrame:
    """(key, grp): shuffle files (by a digest of key and seed) and close a group whenever its running sum exceeds ``target``.

    What is left over at the end is dropped unless no group was closed. Where a group closes depends on all groups before it, so
    the list, one row per file, passes one task in order; that task holds no more than its batch and the open group's sum.
    """
    kind = dict(files.dtypes)[key]
    shuffled = files.select(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))).alias("o"), F.col(key).alias("k"), F.col(seconds).cast("double").alias("s"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, group = 0.0, 0
        for b in batches:
            groups = []
            for x in b.column(1).to_pylist():
                total += x or 0.0
                groups.append(group)
                if total > target:
                    total, group = 0.0, group + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(groups, pa.int32())], ["k", "grp"])

    d = cut_lineage(shuffled.repartition(1).sortWithinPartitions("o", "k").select("k", "s").mapInArrow(fold, f"k {kind}, grp int"))
    # only the last group can be left open
    sums = d.join(files.select(F.col(key).alias("k"), F.col(seconds).cast("double").alias("s")), "k").groupBy("grp").agg(F.sum("s").alias("s"))
    open_ = sums.where(F.coalesce("s", F.lit(0.0)) <= target).select("grp")
    closed = sums.where(F.col("s") > target).limit(1).count()
    return (d.join(F.broadcast(open_), "grp", "left_anti") if closed else d).select(F.col("k").alias(key), "grp")
