"""The toolkit's commands: read files, apply an operator, write Parquet (or files), with the arguments beside the output.

``python -m phonoduct COMMAND name=value ...`` runs one. Series go out in long form (series_id, idx, v) with their rate in
series_meta beside them; labels and waves as files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoduct.operators import f0, f0_range, labels, series, signals, silence, waves
from phonoduct.plans.shipping import ship
from phonoduct.runtime import cut_lineage
from phonoduct.sources import arrays, julius, manifest, wav
from phonoduct.sources.files import write_files

COMMANDS: dict[str, Callable] = {}


def command(f: Callable) -> Callable:
    COMMANDS[f.__name__] = f
    return f


# ---------------------------------------------------------------- stored form
def save_series(df: DataFrame, folder: str, rate: series.Rate, arguments: dict) -> None:
    """Write (series_id, idx, v) and (series_id, rate). The frames are computed once: which series there are is read from what was written."""
    df.write.mode("overwrite").parquet(f"{folder}/series")
    ids = df.sparkSession.read.parquet(f"{folder}/series").select(series.KEY).distinct()
    meta = ids.join(rate.select(series.KEY, "rate").distinct(), series.KEY) if isinstance(rate, DataFrame) else ids.withColumn("rate", F.lit(float(rate)))
    meta.write.mode("overwrite").parquet(f"{folder}/series_meta")
    manifest.save_arguments({k: v for k, v in arguments.items() if k not in ("df", "d")}, folder, df.sparkSession)


def _one_rate(rates: DataFrame) -> series.Rate:
    """The rate of all series, or (series_id, rate) where they differ."""
    few = [r[0] for r in rates.select("rate").distinct().limit(2).collect()]
    return float(few[0]) if len(few) == 1 and few[0] is not None else rates


def load_series(spark: SparkSession, folder: str) -> tuple[DataFrame, series.Rate]:
    """Frames and their rate, or (series_id, rate) where they differ."""
    return spark.read.parquet(f"{folder}/series"), _one_rate(spark.read.parquet(f"{folder}/series_meta"))


def _waves(spark: SparkSession, glob: str, rate: int | None) -> tuple[DataFrame, series.Rate]:
    """Waves, decoded once however often they are read, and their rate: the one asked for, else each wave's own."""
    w = cut_lineage(wav.read_waves(spark, glob, rate))
    return w, rate or _one_rate(w.select(series.KEY, F.col("sampling_rate").cast("double").alias("rate")))


def _long(spark: SparkSession, glob: str, rate: int | None) -> tuple[DataFrame, series.Rate]:
    w, r = _waves(spark, glob, rate)
    return series.unpack(w).withColumn("v", F.col("v").cast("double")), r


def _whole(rate: series.Rate) -> int:
    """The one rate of waves that are treated as one."""
    if isinstance(rate, DataFrame):
        raise f0_range.RateError("waves of different rates can't be joined; give a sampling_rate")
    return int(rate)


def _flat(df: DataFrame, array: str = "array") -> DataFrame:
    return df.select(series.KEY, F.posexplode(array).alias("idx", "v")).withColumn("idx", F.col("idx").cast("bigint"))


# ---------------------------------------------------------------- waves
@command
def extract_wave(spark, input_glob: str, output_directory: str, sampling_rate: int | None = None, scale_db: float | None = None, clipping_range: Sequence[float] | None = None, clipping_auto: bool = False, check_out_of_range: bool = False):
    a = dict(locals())
    x, rate = _long(spark, input_glob, sampling_rate)
    save_series(waves.extract_wave(x, scale_db, tuple(clipping_range) if clipping_range else None, clipping_auto, check_out_of_range), output_directory, rate, a)


@command
def extract_volume(spark, input_glob: str, output_directory: str, sampling_rate: int | None = None, frame_length: int = 800, hop_length: int = 200, top_db: float = 80, normalize: bool = False, volume_type: str = "mse_db"):
    a = dict(locals())
    x, rate = _long(spark, input_glob, sampling_rate)
    v = waves.volume(x, _checked(rate, hop_length), frame_length, hop_length, top_db, normalize, volume_type)
    save_series(v, output_directory, series.scaled(rate, lambda r: F.floor(r / hop_length) if isinstance(rate, DataFrame) else r // hop_length), a)


def _checked(rate: series.Rate, hop: int) -> int:
    """A rate for :func:`waves.volume`, which only asks whether the hop divides it; raises where that fails for some wave."""
    if not isinstance(rate, DataFrame):
        return int(rate)
    odd = rate.where(F.col("rate") % hop != 0).limit(5).collect()
    if odd:
        raise ValueError(f"the sampling rate must be a multiple of the hop: {[r[0] for r in odd]}")
    return hop


@command
def extract_melspectrogram(spark, input_glob: str, output_directory: str, sampling_rate: int = 24000, preemph: float | None = None, n_mels: int = 80, n_fft: int = 2048, win_length: int = 1024, hop_length: int = 256, fmin: float = 125, fmax: float = 12000, min_level: float = 1e-5, max_level: float | None = None, disable_normalize: bool = False):
    a = dict(locals())
    m = signals.melspectrogram(wav.read_waves(spark, input_glob, sampling_rate), hop_length, preemph=preemph, n_mels=n_mels, n_fft=n_fft, win_length=win_length, fmin=fmin, fmax=fmax, min_level=min_level, max_level=max_level, normalize=not disable_normalize)
    save_series(_flat(m), output_directory, sampling_rate / hop_length, a)


@command
def extract_loudness(spark, input_glob: str, output_directory: str, sampling_rate: int = 100, calibration_value: float = 1, field_type: str = "diffuse"):
    a = dict(locals())
    save_series(_flat(signals.loudness(wav.read_waves(spark, input_glob), sampling_rate, calibration_value, field_type)), output_directory, sampling_rate, a)


@command
def extract_silence(spark, input_glob: str, output_directory: str, sampling_rate: int | None = None, silence_top_db: float = 60):
    a = dict(locals())
    x, rate = _long(spark, input_glob, sampling_rate)
    _whole(rate)
    save_series(silence.extract_silence(x, silence_top_db).withColumnRenamed("silent", "v"), output_directory, rate, a)


@command
def tool_split_wave(spark, input_glob: str, output_directory: str, sampling_rate: int | None = None, silence_top_db: float = 60, min_silence_second: float = 0.45, pad_second: float = 0.3, prefix: str = ""):
    a = dict(locals())
    x, rate = _long(spark, input_glob, sampling_rate)
    rate = _whole(rate)
    clips = silence.split_corpus(x, rate, silence_top_db, min_silence_second, pad_second, prefix)
    b = 1 << 20  # clips and samples meet in buckets of the corpus
    at = x.join(silence.offsets(x), series.KEY).select((F.col("offset") + F.col("idx")).alias("g"), "v").withColumn("b", F.floor(F.col("g") / F.lit(b)))
    spread = clips.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / F.lit(b)), F.floor(F.col("end") / F.lit(b)))))
    cut = spread.join(at, "b").where((F.col("g") >= F.col("start")) & (F.col("g") < F.col("end")))
    packed = cut.select(F.regexp_replace("name", r"\.wav$", "").alias(series.KEY), F.col("g").alias("idx"), "v")
    wav.write_waves(series.pack(packed).withColumn("sampling_rate", F.lit(rate)), output_directory)
    manifest.save_arguments(a, output_directory, spark)


@command
def analyze_wave(spark, input_glob: str, sampling_rate: int | None = None) -> DataFrame:
    return waves.extent(_long(spark, input_glob, sampling_rate)[0])


@command
def analyze_loudness(spark, input_glob: str, calibration_value: float = 1, field_type: str = "diffuse") -> DataFrame:
    return signals.loudness_percentiles(wav.read_waves(spark, input_glob), calibration_value, field_type)


@command
def analyze_ebur128(spark, input_glob: str, sampling_rate: int | None = None) -> DataFrame:
    return signals.ebur128_summary(wav.read_waves(spark, input_glob, sampling_rate))


@command
def analyze_melspectrogram(spark, input_glob: str, sampling_rate: int = 24000, preemph: float | None = None, n_mels: int = 80, n_fft: int = 2048, win_length: int = 1024, hop_length: int = 256, fmin: float = 125, fmax: float = 12000, eliminate_silence: bool = False) -> DataFrame:
    return signals.mel_extent(wav.read_waves(spark, input_glob, sampling_rate), eliminate_silence, hop=hop_length, preemph=preemph, n_mels=n_mels, n_fft=n_fft, win_length=win_length, fmin=fmin, fmax=fmax)


# ---------------------------------------------------------------- pitch
@command
def extract_f0(spark, input_glob: str, output_directory: str, sampling_rate: int | None = None, frame_period: float = 5.0, f0_floor: float = 71.0, f0_ceil: float = 800.0, with_vuv: bool = False, f0_type: str = "world"):
    a = dict(locals())
    p = f0.from_frequency(signals.f0(wav.read_waves(spark, input_glob, sampling_rate), frame_period, f0_floor, f0_ceil, f0_type))
    if with_vuv:
        d = f0.fill_unvoiced(p).select(series.KEY, "idx", F.array("lf0", F.col("voiced").cast("double")).alias("v"))
    else:
        d = f0.stored(p).withColumnRenamed("lf0", "v")
    save_series(d, output_directory, f0.frame_rate(frame_period), a)


def _pitch(spark, folder: str) -> tuple[DataFrame, series.Rate, bool]:
    """A stored pitch track; with two columns the second says what is voiced."""
    d, rate = load_series(spark, folder)
    if dict(d.dtypes)["v"].startswith("array"):
        two = d.select(series.KEY, "idx", F.get("v", F.lit(0)).alias("lf0"), F.get("v", F.lit(1)).alias("vuv"))
        return f0.loaded(two, vuv="vuv"), rate, True
    return f0.loaded(d, "v"), rate, False


@command
def extract_f0_statistics(spark, input_directory: str, output: str):
    f0.statistics(_pitch(spark, input_directory)[0]).write.mode("overwrite").parquet(output)


@command
def extract_converted_f0(spark, input_directory: str, output_directory: str, input_statistics: str | None = None, target_statistics: str | None = None, input_mean: float | None = None, input_var: float | None = None, target_mean: float | None = None, target_var: float | None = None):
    a = dict(locals())
    p, rate, vuv = _pitch(spark, input_directory)
    read = lambda s: (arrays.read_statistics(spark, s) if s.endswith(".npy") else spark.read.parquet(s)) if s else None
    c = f0.convert(p, read(input_statistics), read(target_statistics), input_mean, input_var, target_mean, target_var, with_vuv=vuv)
    d = c.select(series.KEY, "idx", F.array("lf0", F.col("voiced").cast("double")).alias("v")) if vuv else f0.stored(c).withColumnRenamed("lf0", "v")
    save_series(d, output_directory, rate, a)


@command
def analyze_f0(spark, input_directory: str) -> DataFrame:
    return f0.percentiles(_pitch(spark, input_directory)[0])


@command
def extract_f0_range(spark, input_glob: str, output: str, sampling_rate: int | None = None, max_num: int = 100, num_loop: int = 10, target_duration: float = 180, verbose_dir: str | None = None):
    def histograms(k: int, kept: DataFrame, floor: float, ceil: float) -> None:
        """What the plots of a round show: counts and volumes over log frequency, and over both."""
        d = kept.withColumn("volume_01", F.coalesce("norm_volume", F.lit(0.0)))
        f0.histogram(d, "hz", floor, ceil).join(f0.histogram(d, "hz", floor, ceil, "volume_01").withColumnRenamed("n", "volume"), "bin").write.mode("overwrite").parquet(f"{verbose_dir}/{k}/histogram")
        f0.histogram_2d(d, "hz", "volume_01", floor, ceil).write.mode("overwrite").parquet(f"{verbose_dir}/{k}/histogram_2d")

    s = f0_range.find_range(_waves(spark, input_glob, sampling_rate)[0], max_num, num_loop, target_duration, on_round=histograms if verbose_dir else None)
    folder, _, name = output.rpartition("/")
    write_files(s.select(F.lit(name).alias("name"), F.to_json(F.struct(*s.columns)).alias("content")), folder or ".")


# ---------------------------------------------------------------- series
@command
def extract_sampling_data(spark, input_glob: str, output_directory: str, sampling_rate: float | None = None, frame_second: float | None = None, time_axis: int = 0):
    a = dict(locals())
    w = series.wrap_arrays(arrays.read_arrays(spark, input_glob), "array", sampling_rate, frame_second, time_axis)
    save_series(_flat(w), output_directory, w.select(series.KEY, "rate"), a)


@command
def extract_framed_local(spark, input_directory: str, output_directory: str, frame_length: int, hop_length: int, centering: bool = False, padding_value: float | None = None, degenerate_type: str = "mean", padding_mode: str = "constant"):
    a = dict(locals())
    d, rate = load_series(spark, input_directory)
    f = series.framed(d, frame_length, hop_length, centering, padding_value, (degenerate_type,), padding_mode)
    save_series(f.withColumnRenamed(degenerate_type, "v"), output_directory, series.scaled(rate, lambda r: r / hop_length), a)


@command
def extract_splited_local(spark, input_directory: str, output_directory: str, keypoint_seconds: Sequence[float], padding: bool = False, remove_all_same: bool = False, file_format: str = "{stem}-{i}"):
    a = dict(locals())
    d, rate = load_series(spark, input_directory)
    s = series.split_local(d, keypoint_seconds, rate, padding, remove_all_same, file_format)
    if isinstance(rate, DataFrame):
        segments = F.explode(F.sequence(F.lit(0), F.lit(len(keypoint_seconds)))).alias("segment")
        rate = rate.select(series.KEY, "rate", segments).select(series.segment_name(file_format).alias(series.KEY), "rate")
    save_series(s.select(F.col("name").alias(series.KEY), "idx", "v"), output_directory, rate, a)


@command
def extract_collected_local(spark, input_directories: Sequence[str], output_directory: str, rate: float, mode: str = "min", error_time_length: float = 0.015, only_union: bool = False, ignore_error: bool = False) -> DataFrame | None:
    """With ``ignore_error`` series whose sources differ too much in length are left out and listed in dead_letters."""
    a = dict(locals())
    sources = [load_series(spark, f) for f in input_directories]
    keys, dead = "inner" if only_union else "strict", None
    if ignore_error:
        series.length_errors(sources, rate, error_time_length).write.mode("overwrite").parquet(f"{output_directory}/dead_letters")
        dead = spark.read.parquet(f"{output_directory}/dead_letters")
    both = series.collect(sources, rate, mode, None if ignore_error else error_time_length, keys, skip=dead.select(series.KEY) if ignore_error else None)
    save_series(both, output_directory, rate, a)
    return dead


# ---------------------------------------------------------------- labels
@command
def extract_phoneme(spark, input_glob: str, output_directory: str, input_start_accent_glob: str | None = None, input_end_accent_glob: str | None = None, phoneme_type: str = "seg_kit", with_phoneme_id: bool = False, with_pre_post: bool = False, with_duration: bool = False, with_relative_pos: bool = False, rate: float = 100, ignore_error: bool = False) -> DataFrame | None:
    a = dict(locals())
    s = julius.read_flags(spark, input_start_accent_glob, "start_accent") if input_start_accent_glob else None
    e = julius.read_flags(spark, input_end_accent_glob, "end_accent") if input_end_accent_glob else None
    d, dead = labels.extract_phoneme(julius.read_labels(spark, input_glob), phoneme_type, rate, s, e, ignore_error, with_phoneme_id=with_phoneme_id, with_pre_post=with_pre_post, with_duration=with_duration, with_relative_pos=with_relative_pos)
    save_series(d.withColumnRenamed(labels.UTT, series.KEY), output_directory, rate, a)
    return dead


@command
def extract_silence_from_phoneme(spark, wave_glob: str, phoneme_glob: str, output_directory: str, phoneme_type: str = "seg_kit", sampling_rate: int | None = None):
    a = dict(locals())
    x, rate = _long(spark, wave_glob, sampling_rate)
    n, own = series.with_rate(series.lengths(x), rate)
    n = n.select(F.col(series.KEY).alias(labels.UTT), "n", own.alias("rate"))
    m = labels.silence_from_phonemes(julius.read_labels(spark, phoneme_glob, phoneme_type), n, phoneme_type)
    save_series(m.select(F.col(labels.UTT).alias(series.KEY), "idx", F.col("silent").alias("v")), output_directory, rate, a)


@command
def extract_silence_expanded_label(spark, label_glob: str, silence_directory: str, output_directory: str, phoneme_type: str = "seg_kit", phoneme_minimum_second: float = 0.03):
    a = dict(locals())
    m, rate = load_series(spark, silence_directory)
    mask = m.select(F.col(series.KEY).alias(labels.UTT), "idx", F.col("v").cast("boolean").alias("silent"))
    rate = rate.withColumnRenamed(series.KEY, labels.UTT) if isinstance(rate, DataFrame) else rate
    new = labels.expand_silence(julius.read_labels(spark, label_glob, phoneme_type), labels.silence_runs(mask, rate), phoneme_type, phoneme_minimum_second)
    julius.write_labels(cut_lineage(new), output_directory, phoneme_type)
    manifest.save_arguments(a, output_directory, spark)


def main(argv: Sequence[str]) -> None:
    """Run ``COMMAND name=value ...``; values are JSON, or text where they are none."""
    if not argv or argv[0] not in COMMANDS:
        raise SystemExit("commands: " + ", ".join(sorted(COMMANDS)))

    def value(x: str):
        try:
            return json.loads(x)
        except ValueError:
            return x

    spark = SparkSession.builder.appName(argv[0]).getOrCreate()
    ship(spark)
    out = COMMANDS[argv[0]](spark, **{k: value(v) for k, _, v in (x.partition("=") for x in argv[1:])})
    if out is not None:
        out.show(100, truncate=False)
