"""Waveforms in long form (series_id, idx, v): gain, clipping, pre-emphasis, framed levels and volume."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoduct.operators.series import KEY, lengths, with_neighbours


class RangeError(ValueError):
    """Samples lie outside -1 to 1."""


def db_to_amplitude(db: float) -> float:
    return 10 ** (db / 20)


def power_to_db(x: Column, floor: float = 1e-10) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(floor)))


def amplitude_to_db(x: Column, floor: float = 1e-5) -> Column:
    return 20 * F.log10(F.greatest(F.abs(x), F.lit(floor)))


def gain(df: DataFrame, db: float) -> DataFrame:
    return df.withColumn("v", F.col("v") * F.lit(db_to_amplitude(db)))


def calibrate(df: DataFrame, value: float) -> DataFrame:
    return df.withColumn("v", F.col("v") * F.lit(float(value)))


def clip(df: DataFrame, low: float, high: float) -> DataFrame:
    """Limit samples to low..high and divide by the larger of their absolute values."""
    return df.withColumn("v", F.least(F.greatest(F.col("v"), F.lit(float(low))), F.lit(float(high))) / F.lit(float(max(abs(low), abs(high)))))


def peaks(df: DataFrame) -> DataFrame:
    """(series_id, peak): largest absolute sample."""
    return df.groupBy(KEY).agg(F.max(F.abs("v")).alias("peak"))


def normalise(df: DataFrame, margin: float = 0.999) -> DataFrame:
    """Divide by margin times the peak, so the new peak is 1 / margin, just above 1. A silent series stays as it is."""
    p = F.when(F.col("peak") > 0, F.col("peak") * margin).otherwise(1.0)
    return df.join(peaks(df), KEY).withColumn("v", F.col("v") / p).drop("peak")


def out_of_range(df: DataFrame) -> DataFrame:
    """(series_id, low, high) of series with samples outside -1 to 1."""
    return df.groupBy(KEY).agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < -1 or high > 1")


def extract_wave(df: DataFrame, scale_db: float | None = None, clipping_range: tuple[float, float] | None = None, clipping_auto: bool = False, check_out_of_range: bool = False) -> DataFrame:
    """At most one of gain, clipping and normalisation; then, if asked for, the range check, which raises."""
    if (scale_db is not None) + (clipping_range is not None) + clipping_auto > 1:
        raise ValueError("scale_db, clipping_range and clipping_auto exclude each other")
    if scale_db is not None:
        df = gain(df, scale_db)
    if clipping_range is not None:
        df = clip(df, *clipping_range)
    if clipping_auto:
        df = normalise(df)
    if check_out_of_range and (odd := out_of_range(df).limit(5).collect()):
        raise RangeError(f"samples outside -1 to 1 in {[r[0] for r in odd]}")
    return df


def extent(df: DataFrame) -> DataFrame:
    """One row (max, min) over all samples."""
    return df.agg(F.max("v").alias("max"), F.min("v").alias("min"))


def pre_emphasis(df: DataFrame, p: float) -> DataFrame:
    """v[n] - p * v[n-1], with 0 before the first sample."""
    d = with_neighbours(df)
    return d.withColumn("v", F.col("v") - F.lit(p) * F.coalesce("prev", F.lit(0.0))).drop("prev", "next")


def framed_rms(df: DataFrame, frame_length: int, hop: int) -> DataFrame:
    """(series_id, idx, rms) of centred frames over the zero-padded wave; 1 + n // hop frames for even lengths.

    Samples add up to energies of blocks first, which frames are made of: as long as frame, hop and half a frame divide by.
    So a table smaller by the block is shuffled, and once. Padding adds no energy, so each frame divides by its full length.
    """
    pad = frame_length // 2
    size = math.gcd(math.gcd(frame_length, hop), pad)
    blocks = df.groupBy(KEY, F.floor(F.col("idx") / F.lit(size)).alias("b")).agg(F.sum(F.col("v") * F.col("v")).alias("e"), F.max("idx").alias("z"))
    count = (F.floor((F.col("n") + 2 * pad - frame_length) / F.lit(hop)) + 1).cast("bigint")
    n = blocks.groupBy(KEY).agg((F.max("z") + 1).alias("n")).select(KEY, count.alias("count")).where("count > 0")
    j = F.col("b") + pad // size  # block j lies in the frames k with k * hop <= j * size < k * hop + frame_length
    first = F.greatest(F.ceil((j * size - frame_length + size) / F.lit(hop)), F.lit(0)).cast("bigint")
    last = F.floor(j * size / F.lit(hop)).cast("bigint")
    parts = blocks.where(first <= last).select(KEY, F.explode(F.sequence(first, last)).alias("idx"), "e")
    every = n.select(KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("idx"))  # frames of nulls only, too
    power = parts.groupBy(KEY, "idx").agg(F.sum("e").alias("e"))
    return every.join(power, [KEY, "idx"], "left").select(KEY, "idx", F.sqrt(F.coalesce("e", F.lit(0.0)) / frame_length).alias("rms"))


VOLUME_TYPES = ("rms_power", "mse_power", "rms_db", "mse_db")


def volume(df: DataFrame, sampling_rate: int, frame_length: int = 800, hop: int = 200, top_db: float = 80, normalize: bool = False, volume_type: str = "mse_db") -> DataFrame:
    """(series_id, idx, v): volume every ``hop`` samples, rate sampling_rate // hop.

    The dB types take 10 log10 of RMS or of mean square alike, floored at top_db below the series' loudest frame.
    ``normalize`` maps the top_db below the loudest frame to 0..1.
    """
    if sampling_rate % hop:
        raise ValueError("the sampling rate must be a multiple of the hop")
    if volume_type not in VOLUME_TYPES:
        raise ValueError(f"volume_type is one of {VOLUME_TYPES}")
    rms = framed_rms(df, frame_length, hop)
    v = F.col("rms") * F.col("rms") if volume_type.startswith("mse") else F.col("rms")
    out = rms.select(KEY, "idx", (power_to_db(v) if volume_type.endswith("db") else v).alias("v"))
    out = out.join(out.groupBy(KEY).agg(F.max("v").alias("top")), KEY)
    if volume_type.endswith("db"):
        out = out.withColumn("v", F.greatest(F.col("v"), F.col("top") - top_db))
    if normalize:
        out = out.withColumn("v", F.least(F.greatest((F.col("v") - F.col("top")) / F.lit(float(top_db)) + 1, F.lit(0.0)), F.lit(1.0)))
    return out.drop("top")
