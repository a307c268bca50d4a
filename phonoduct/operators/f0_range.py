"""Find the pitch range of a corpus: track, weigh by volume, narrow the range, repeat."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoduct.kernels import pitch, spectral
from phonoduct.operators import f0
from phonoduct.operators.series import KEY, evenly_spaced
from phonoduct.runtime import cut_lineage


class RateError(ValueError):
    """Waves differ in sampling rate."""


def check_rates(waves: DataFrame) -> int:
    """The one sampling rate of all waves; raises where they differ."""
    rates = [r[0] for r in waves.select("sampling_rate").distinct().limit(2).collect()]
    if len(rates) != 1:
        raise RateError(f"sampling rates differ: {rates}")
    return rates[0]


def features(groups: DataFrame, floor: float, ceil: float) -> DataFrame:
    """(hz, volume) at 200 Hz of each group's joined waves (grp, sampling_rate, samples)."""

    @F.pandas_udf("array<struct<hz: double, volume: double>>")
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for x, r in zip(samples, rate):
            x = np.asarray(x, float)
            hz = pitch.track(x, r, 5.0, floor, ceil, "true_world")
            rms = np.sqrt((spectral.frames(x, 2048, 512) ** 2).mean(axis=1))
            db = 20 * np.log10(np.maximum(rms, 1e-5))
            db = np.maximum(db, db.max() - 80)
            frame_rate = r / 512
            k = np.floor(np.arange(int(len(db) / frame_rate * 200)) * frame_rate / 200).astype(int)
            n = min(len(hz), len(k))
            out.append([{"hz": a, "volume": b} for a, b in zip(hz[:n], db[k[:n]])])
        return pd.Series(out, dtype=object)

    return groups.select(F.inline(run("samples", "sampling_rate")))


def joined(waves: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, sampling_rate, samples): each group's waves end to end. A group's duration is bounded by its target and one wave."""
    parts = F.array_sort(F.collect_list(F.struct(KEY, "samples")))
    d = waves.join(groups, KEY).groupBy("grp", "sampling_rate").agg(parts.alias("p"))
    return d.select("grp", "sampling_rate", F.flatten("p.samples").alias("samples"))


def kept(feats: DataFrame, floor: float, ceil: float, next_bin: bool = True) -> DataFrame:
    """Voiced frames that are loud enough and whose pitch enough of the volume votes for."""
    d = f0.unit_volume(f0.drop_quiet(feats.where("hz > 0")))
    return f0.drop_low_votes(d, floor=floor, ceil=ceil, next_bin=next_bin)


def find_range(waves: DataFrame, max_num: int = 100, num_loop: int = 10, target_duration: float = 180, seed: int = 0, floor: float = 40.0, ceil: float = 800.0, next_bin: bool = True, on_round: Callable[[int, DataFrame, float, float], None] | None = None) -> DataFrame:
    """One row of the 13 statistics of ln f0 of at most ``max_num`` evenly spaced waves, after ``num_loop`` rounds.

    Each round regroups the waves (seeded), tracks pitch within the range so far and sets the next range to the
    volume-weighted 0.1 % and 99.9 % points, widened by a tenth. The statistics themselves are unweighted. ``next_bin`` is
    that of :func:`f0.drop_low_votes`: voices glide, but steady tones leave the bin after theirs empty.
    ``on_round`` is called with each round's number, kept frames, floor and ceiling.
    """
    rate = check_rates(waves)
    chosen = cut_lineage(waves.join(evenly_spaced(waves, KEY, max_num), KEY, "left_semi"))
    seconds = chosen.select(KEY, (F.size("samples") / F.lit(rate)).alias("seconds"))
    last = None
    for k in range(num_loop):
        feats = cut_lineage(features(joined(chosen, f0.duration_groups(seconds, target_duration, seed + k)).repartition("grp"), floor, ceil))
        last = kept(feats, floor, ceil, next_bin)
        if on_round is not None:
            on_round(k, last, floor, ceil)
        ends = {r["percent"]: r["value"] for r in f0.weighted_percentiles(last, "hz", "norm_volume", (0.1, 99.9)).collect()}  # two rows
        if len(ends) == 2 and ends[0.1] < ends[99.9]:
            floor, ceil = f0.expand_in_logspace(ends[0.1], ends[99.9], 0.1)
    return f0.log_statistics(last.select(F.ln("hz").alias("lf0")))
