"""Import of .npy arrays, and of {array, rate} envelopes pickled in them, without running code from them."""

from __future__ import annotations

import io
import pickle

import numpy as np
import pandas as pd
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoduct.operators.series import KEY
from phonoduct.sources.files import check_stems, read_binary

_ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar")}


class _Restricted(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in _ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed")
        return getattr(__import__(module, fromlist=[name]), name)


def load_object(raw: bytes) -> dict:
    """A dict of arrays and numbers pickled in an array, as {array, rate} or {mean, var}; runs no code from it."""
    f = io.BytesIO(raw)
    version = npy.read_magic(f)
    _, _, kind = npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)
    if not kind.hasobject:
        raise ValueError("an array, not an object")
    value = _Restricted(f).load()
    return dict(value.item() if isinstance(value, np.ndarray) else value)


def load(raw: bytes) -> tuple[np.ndarray, float | None]:
    """(array with time on axis 0 and at least two axes, rate or None) of .npy, or of .npz with an array and a rate."""
    rate = None
    if raw[:2] == b"PK":
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            array, rate = z["array"].astype(float), float(z["rate"]) if "rate" in z else None
    else:
        try:
            array = np.load(io.BytesIO(raw), allow_pickle=False).astype(float)
        except ValueError:
            value = load_object(raw)
            if not {"array", "rate"} <= set(value):
                raise ValueError("an object with an array and its rate is needed") from None
            array, rate = np.asarray(value["array"], float), float(value["rate"])
    return (array[:, None] if array.ndim == 1 else array.reshape(len(array), -1)), rate


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row (mean, var) of a statistics file."""

    @F.pandas_udf("mean double, var double")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = [load_object(bytes(c)) for c in content]
        return pd.DataFrame({k: [float(r[k]) for r in rows] for k in ("mean", "var")})

    return read_binary(spark, path).select(run("content").alias("s")).select("s.*")


def read_arrays(spark: SparkSession, glob: str) -> DataFrame:
    """(series_id, rate, array array<array<float>>); rate is null for bare arrays."""

    @F.pandas_udf("rate double, array array<array<float>>")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = [load(bytes(c)) for c in content]
        return pd.DataFrame({"rate": [r for _, r in rows], "array": [[list(map(float, x)) for x in a] for a, _ in rows]})

    return check_stems(read_binary(spark, glob)).select(KEY, run("content").alias("a")).select(KEY, "a.*")
