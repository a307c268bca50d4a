"""Kernels over packed waves (series_id, sampling_rate int, samples array<float>), one wave a row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoduct.kernels import ebu, pitch, spectral, zwicker
from phonoduct.operators.series import KEY

MATRIX = "array<array<float>>"


def _apply(kernel: Callable[[np.ndarray, float], object], kind: str) -> Callable[..., Column]:
    """A vectorised UDF of (samples, sampling_rate); null and empty waves give null."""

    @F.pandas_udf(kind)
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or not len(s) or not r else kernel(np.asarray(s, float), float(r)) for s, r in zip(samples, rate)], dtype=object)

    return run


def spread(df: DataFrame) -> DataFrame:
    """A scan of waves over all cores, before any kernel; one of many splits stays where it is.

    For scans only: counting the partitions of anything that was shuffled would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, KEY)


def resample(df: DataFrame, target: int) -> DataFrame:
    udf = _apply(lambda x, r: spectral.resample(x, r, target).astype("f4"), "array<float>")
    return df.select(KEY, F.lit(target).alias("sampling_rate"), F.when(F.col("sampling_rate") == target, F.col("samples")).otherwise(udf("samples", "sampling_rate")).alias("samples"))


def melspectrogram(df: DataFrame, hop: int = 256, **options) -> DataFrame:
    """(series_id, rate, array): log-mel frames, rate sampling_rate / hop."""
    udf = _apply(lambda x, r: list(spectral.log_mel(x, int(r), hop=hop, **options)), MATRIX)
    return df.select(KEY, (F.col("sampling_rate") / hop).alias("rate"), udf("samples", "sampling_rate").alias("array"))


def mel_extent(df: DataFrame, eliminate_silence: bool = False, **options) -> DataFrame:
    """One row (min, max) of unnormalised log-mel levels; ``eliminate_silence`` leaves out those at the floor."""
    floor = 1e-15
    m = melspectrogram(df, min_level=floor, normalize=False, **options).select(F.explode(F.flatten("array")).alias("x"))
    if eliminate_silence:
        m = m.where(F.col("x") > float(np.float32(np.log(floor))))
    return m.agg(F.min("x").cast("double").alias("min"), F.max("x").cast("double").alias("max"))


def f0(df: DataFrame, frame_period: float = 5.0, f0_floor: float = 71.0, f0_ceil: float = 800.0, f0_type: str = "world") -> DataFrame:
    """(series_id, idx, hz) every ``frame_period`` ms, 0 where unvoiced."""
    udf = _apply(lambda x, r: pitch.track(x, r, frame_period, f0_floor, f0_ceil, f0_type), "array<double>")
    return df.select(KEY, F.posexplode(udf("samples", "sampling_rate")).alias("idx", "hz")).withColumn("idx", F.col("idx").cast("bigint"))


def loudness(df: DataFrame, rate: int = 100, calibration: float = 1.0, field: str = "diffuse") -> DataFrame:
    """(series_id, rate, array<double>): medians of centred windows of 500 // rate loudness values (2 ms each)."""
    if 500 % rate:
        raise ValueError("the rate must divide 500")
    size = 500 // rate

    def middle(n: np.ndarray) -> np.ndarray:
        p = np.pad(n, size // 2)
        return np.median(np.lib.stride_tricks.sliding_window_view(p, size)[::size], axis=1) if len(p) >= size else np.zeros(0)

    run = F.pandas_udf("array<double>")(_sones(calibration, field, middle))
    return df.select(KEY, F.lit(float(rate)).alias("rate"), run("samples", "sampling_rate").alias("array"))


def _sones(calibration: float, field: str, result: Callable[[np.ndarray], object]):
    """result of each wave's loudness; null and empty waves give null."""

    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        xs = [spectral.resample(np.asarray(s, float), float(r), zwicker.RATE) * calibration if s is not None and len(s) and r else np.zeros(0) for s, r in zip(samples, rate)]
        return pd.Series([result(n) if len(n) else None for n in zwicker.loudness_many(xs, field)], dtype=object)

    run.__annotations__ = {"samples": pd.Series, "rate": pd.Series, "return": pd.Series}
    return run


def loudness_percentiles(df: DataFrame, calibration: float = 1.0, field: str = "diffuse") -> DataFrame:
    """(percent, loudness): percentiles over waves of their loudest moment."""
    q = [0, 1, 5, 25, 50, 75, 95, 99, 100]
    top = F.pandas_udf("double")(_sones(calibration, field, lambda n: float(n.max())))
    p = df.select(top("samples", "sampling_rate").alias("m")).agg(F.percentile("m", F.array(*[F.lit(x / 100) for x in q])).alias("p"))
    return p.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(x)) for x in q]).alias("percent"), F.col("p").alias("loudness"))))


def ebur128(df: DataFrame) -> DataFrame:
    """(series_id, i, lra_low, lra_high, text)."""
    @F.pandas_udf("i double, lra_low double, lra_high double")
    def run(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
        rows = [vars(ebu.ebur128(np.asarray(s, float), float(r))) if s is not None and len(s) and r else {} for s, r in zip(samples, rate)]
        return pd.DataFrame(rows, columns=["i", "lra_low", "lra_high"], dtype=float)

    d = df.select(KEY, run("samples", "sampling_rate").alias("e")).select(KEY, "e.*")
    return d.withColumn("text", F.format_string("I=%.2f, LRA_low=%.2f, LRA_high=%.2f", "i", "lra_low", "lra_high"))


def ebur128_summary(df: DataFrame) -> DataFrame:
    """(measure, mean, median, max, min) over waves."""
    e = ebur128(df).select(F.expr("stack(3, 'I', i, 'LRA_low', lra_low, 'LRA_high', lra_high) as (measure, x)"))
    return e.groupBy("measure").agg(F.avg("x").alias("mean"), F.median("x").alias("median"), F.max("x").alias("max"), F.min("x").alias("min"))
