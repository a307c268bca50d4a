"""The operators in SQL: ``register(spark)`` once, then call them by name.

Expressions are SQL functions that Catalyst inlines; kernels are vectorised functions over (samples, sampling_rate).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from phonoduct.functions.vocabularies import VOCABULARIES
from phonoduct.kernels import ebu, pitch, spectral, zwicker
from phonoduct.operators.signals import MATRIX

EXPRESSIONS = {
    "power_to_db(x double)": ("double", "10 * log10(greatest(x, 1e-10))"),
    "amplitude_to_db(x double)": ("double", "20 * log10(greatest(abs(x), 1e-5))"),
    "db_to_amplitude(db double)": ("double", "power(10, db / 20)"),
    "stem(path string)": ("string", r"regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1)"),
    "seconds_to_frame(seconds double, rate double)": ("bigint", "cast(rint(seconds * rate) as bigint)"),
    "frame_to_seconds(frame bigint, rate double)": ("double", "frame / rate"),
    "hertz_to_lf0(hz double)": ("double", "if(hz > 0, ln(hz), 0)"),
    "lf0_to_hertz(lf0 double)": ("double", "if(lf0 <> 0, exp(lf0), 0)"),
    "convert_lf0(lf0 double, from_mean double, from_var double, to_mean double, to_var double)": ("double", "to_var / from_var * (lf0 - from_mean) + to_mean"),
}


def _waves(kernel, kind: str):
    """A function of (samples, sampling_rate); null and empty waves give null."""

    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or not len(s) or not r else kernel(np.asarray(s, float), float(r)) for s, r in zip(samples, rate)], dtype=object)

    return F.pandas_udf(run, kind)


KERNELS = {
    "log_mel": (lambda x, r: list(spectral.log_mel(x, int(r), fmin=0, fmax=min(12_000, r / 2))), MATRIX),
    "track_hertz": (pitch.track, "array<double>"),
    "sones": (lambda x, r: zwicker.loudness_many([spectral.resample(x, r, zwicker.RATE)], "diffuse")[0].tolist(), "array<double>"),
    "programme_loudness": (lambda x, r: float(ebu.ebur128(x, r).i), "double"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for head, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {head} returns {kind} return {body}")
    names = [h.split("(")[0] for h in EXPRESSIONS]
    lists = ", ".join(f"'{t}', array({', '.join(repr(p) for p in v)})" for t, v in VOCABULARIES.items())
    spark.sql(f"create or replace temporary function phoneme_id(phoneme string, kind string) returns int return nullif(array_position(map({lists})[kind], phoneme), 0) - 1")
    for name, (kernel, kind) in KERNELS.items():
        spark.udf.register(name, _waves(kernel, kind))

    @F.pandas_udf("array<float>")
    def resample_wave(samples: pd.Series, rate: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else spectral.resample(np.asarray(s, float), float(r), float(t)).astype("f4") for s, r, t in zip(samples, rate, target)], dtype=object)

    spark.udf.register("resample_wave", resample_wave)
    return [*names, "phoneme_id", *KERNELS, "resample_wave"]
