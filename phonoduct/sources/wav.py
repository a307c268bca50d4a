"""RIFF waveforms: PCM of 8, 16, 24 and 32 bits and floats of 32 and 64 bits."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoduct.operators import signals
from phonoduct.operators.series import KEY, stem
from phonoduct.sources import arrays
from phonoduct.sources.files import check_stems, read_binary, write_files


#: An accumulator that counts decoded files, where one is set before the plan is made.
DECODED: Accumulator | None = None


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    bits: int
    is_float: bool
    start: int
    size: int

    @property
    def frames(self) -> int:
        return self.size // (self.channels * self.bits // 8)

    @property
    def seconds(self) -> float:
        return self.frames / self.rate


def header(raw: bytes, length: int | None = None) -> Header:
    """Read the format and data chunks; raises ValueError on anything that is no such wave. ``raw`` may be the head of a file of ``length`` bytes."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave")
    at, fmt = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if code == 0xFFFE:
                code = struct.unpack_from("<H", raw, at + 32)[0]
            if code not in (1, 3) or bits not in ((8, 16, 24, 32) if code == 1 else (32, 64)):
                raise ValueError(f"format {code} with {bits} bits is not read")
            fmt = rate, channels, bits, code == 3
        elif name == b"data" and fmt:
            return Header(*fmt, at + 8, min(size, (length or len(raw)) - at - 8))
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """(mono samples in -1..1 as float32, rate); channels are averaged. Arrays with a rate (.npy, .npz) are waves too."""
    if raw[:6] == b"\x93NUMPY" or raw[:2] == b"PK":
        array, rate = arrays.load(raw)
        if rate is None or array.shape[1] != 1:
            raise ValueError("a wave is one column with a rate")
        return array[:, 0].astype(np.float32), int(rate)
    h = header(raw)
    size = h.frames * h.channels * h.bits // 8
    body = raw[h.start : h.start + size]
    if h.is_float:
        x = np.frombuffer(body, f"<f{h.bits // 8}").astype(float)
    elif h.bits == 8:
        x = (np.frombuffer(body, "u1").astype(float) - 128) / 128
    elif h.bits == 24:
        b = np.frombuffer(body, "u1").reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        x = np.frombuffer(body, f"<i{h.bits // 8}") / float(1 << (h.bits - 1))
    return x.reshape(-1, h.channels).mean(axis=1).astype(np.float32), h.rate


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM; samples beyond -1..1 are clipped."""
    pcm = np.clip(np.rint(np.asarray(samples, float) * 32768), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


#: Bytes of a file that are looked at for its header.
HEAD = 65_536


def read_headers(spark: SparkSession, glob: str) -> DataFrame:
    """(series_id, path, sampling_rate, channels, seconds), from the first bytes of each file.

    Only paths and sizes are listed by Spark; a task then opens its files by the session's file system where that is a local
    or mounted one, else it reads them through the scan.
    """

    def parse(head: bytes, size: int) -> tuple[int, int, float]:
        h = header(head, size)
        return h.rate, h.channels, h.seconds

    @F.pandas_udf("sampling_rate int, channels int, seconds double")
    def opened(path: pd.Series, size: pd.Series) -> pd.DataFrame:
        rows = []
        for p, n in zip(path, size):
            with open(unquote(p.removeprefix("file:")), "rb") as f:
                rows.append(parse(f.read(HEAD), n))
        return pd.DataFrame(rows, columns=["sampling_rate", "channels", "seconds"])

    @F.pandas_udf("sampling_rate int, channels int, seconds double")
    def scanned(head: pd.Series, size: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(bytes(h), n) for h, n in zip(head, size)], columns=["sampling_rate", "channels", "seconds"])

    files = spark.read.format("binaryFile").load(glob)
    first = files.select("path").first()
    mounted = first is not None and first[0].startswith("file:")
    h = opened("path", "length") if mounted else scanned(F.substring("content", 1, HEAD), "length")
    return files.select(stem(F.col("path")).alias(KEY), "path", h.alias("h")).select(KEY, "path", "h.*")


def read_waves(spark: SparkSession, glob: str, sampling_rate: int | None = None) -> DataFrame:
    """(series_id, sampling_rate, samples array<float>), resampled where a rate is asked for and differs."""
    seen = DECODED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):  # a wave at a time: they are large
                x, r = decode(content.as_buffer().to_pybytes())
                if seen is not None:
                    seen.add(1)
                samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([r], pa.int32()), samples], [KEY, "sampling_rate", "samples"])

    d = signals.spread(check_stems(read_binary(spark, glob))).select(KEY, "content").mapInArrow(run, f"{KEY} string, sampling_rate int, samples array<float>")
    return d if sampling_rate is None else signals.resample(d, sampling_rate)


def write_waves(df: DataFrame, folder: str) -> None:
    """Write (series_id, sampling_rate, samples) as <series_id>.wav."""

    @F.pandas_udf("binary")
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([encode(np.asarray(s if s is not None else [], float), int(r)) for s, r in zip(samples, rate)], dtype=object)

    write_files(df.select(F.concat(F.col(KEY), F.lit(".wav")).alias("name"), run("samples", "sampling_rate").alias("content")), folder)
