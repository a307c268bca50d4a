import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoduct.kernels import ebu, pitch, spectral, zwicker
from phonoduct.operators import f0_range, signals, silence, waves
from phonoduct.operators.waves import RangeError

LONG = "series_id string, idx bigint, v double"


def sine(f, seconds, rate, amp=1.0):
    return amp * np.sin(2 * np.pi * f * np.arange(int(seconds * rate)) / rate)


def buzz(f, seconds, rate):
    return sum(sine(f * k, seconds, rate, 0.3 / k) for k in range(1, 8))


def long(spark, **named):
    return spark.createDataFrame([(k, i, float(x)) for k, v in named.items() for i, x in enumerate(v)], LONG)


def packed(spark, rate, **named):
    return spark.createDataFrame([(k, rate, [float(x) for x in v] if v is not None else None) for k, v in named.items()], "series_id string, sampling_rate int, samples array<float>")


def test_rms_of_a_sine(spark):
    r = waves.framed_rms(long(spark, a=sine(100, 0.5, 2000)), 200, 50).orderBy("idx").collect()
    assert len(r) == 1 + 1000 // 50
    assert [x.rms for x in r[3:-3]] == pytest.approx([2**-0.5] * (len(r) - 6), abs=1e-6)


def test_volume_types_and_normalisation(spark):
    d = long(spark, a=sine(100, 0.5, 2000))
    get = lambda t, **k: [x.v for x in waves.volume(d, 2000, 200, 50, 80, volume_type=t, **k).orderBy("idx").collect()]
    assert np.array(get("mse_db")) == pytest.approx(2 * np.array(get("rms_db")))
    v = get("mse_db", normalize=True)
    assert min(v) >= 0 and max(v) == 1
    with pytest.raises(ValueError):
        waves.volume(d, 2000, 200, 30)


def test_gain_clip_and_range(spark):
    d = long(spark, a=[0.5, -2.0], silent=[0.0, 0.0])
    v = lambda x: [r.v for r in x.where("series_id = 'a'").orderBy("idx").collect()]
    assert v(waves.clip(d, -1, 0.5)) == [0.5, -1.0]
    assert v(waves.normalise(d)) == pytest.approx([0.25 / 0.999, -1 / 0.999])
    assert v(waves.pre_emphasis(d, 0.5)) == [0.5, -2.25]
    with pytest.raises(RangeError):
        waves.extract_wave(d, check_out_of_range=True)
    with pytest.raises(ValueError):
        waves.extract_wave(d, scale_db=3, clipping_auto=True)


def test_mel_bounds_and_peak():
    rate = 24_000
    m = spectral.log_mel(sine(1000, 1, rate), rate)
    assert m.shape == (1 + rate // 256, 80) and m.dtype == np.float32 and m.min() >= 0 and m.max() <= 1
    edges = spectral.hz_of(np.linspace(spectral.mel_of(125), spectral.mel_of(12_000), 82))
    assert edges[np.argmax(m[40])] < 1000 < edges[np.argmax(m[40]) + 2]
    raw = spectral.log_mel(sine(1000, 1, rate), rate, min_level=1e-5, max_level=10, normalize=False)
    assert raw.min() >= np.float32(np.log(1e-5)) and raw.max() <= np.float32(np.log(10))


def test_resampler_keeps_a_sine():
    y = spectral.resample(sine(440, 1, 24_000), 24_000, 16_000)
    assert len(y) == 16_000 and np.abs(y - sine(440, 1, 16_000))[200:-200].max() < 1e-4


@pytest.mark.parametrize("f", [110.0, 240.0])
@pytest.mark.parametrize("kind", ["world", "true_world", "refine_world"])
def test_pitch_of_harmonics(f, kind):
    x = np.concatenate([np.zeros(8000), buzz(f, 1, 16_000), np.zeros(8000)])
    y = pitch.track(x, 16_000, kind=kind)
    assert len(y) == 1 + 2000 // 5 and not y[:80].any() and not y[-80:].any()
    assert y[110:290] == pytest.approx([f] * 180, rel=0.01)


def test_loudness_of_pure_tones():
    for db, sone in ((40, 1), (60, 4)):
        n = zwicker.loudness(sine(1000, 0.8, 48_000, 2**0.5 * 2e-5 * 10 ** (db / 20)), "free")
        assert n[250:380].mean() == pytest.approx(sone, rel=0.05)
    assert not zwicker.loudness(np.zeros(4800)).any()
    assert len(zwicker.loudness_many([np.zeros(960), np.zeros(0), np.zeros(480)])[1]) == 0


def test_programme_loudness():
    e = ebu.ebur128(sine(997, 6, 48_000, 0.1), 48_000)
    assert (e.i, e.lra_low, e.lra_high) == pytest.approx((-23.01, -23.01, -23.01), abs=0.05)
    assert str(e) == "I=-23.01, LRA_low=-23.01, LRA_high=-23.01"
    assert ebu.ebur128(np.zeros(9600), 48_000).i == -70


def test_kernels_over_rows(spark):
    d = packed(spark, 16_000, a=buzz(150, 0.4, 16_000), empty=[], none=None)
    assert {r.series_id for r in signals.f0(d).collect()} == {"a"}
    assert {r.series_id: r.array is None for r in signals.melspectrogram(d, fmax=8000).collect()} == {"a": False, "empty": True, "none": True}
    assert {r.series_id: r.i is None for r in signals.ebur128(d).collect()} == {"a": False, "empty": True, "none": True}
    values = int(0.4 * 500)  # one each 2 ms; half a window of padding on both sides
    size = 500 // 100
    assert [len(r.array) for r in signals.loudness(d, 100).where("series_id = 'a'").collect()] == [1 + (values + 2 * (size // 2) - size) // size]


def gliding(a, b, seconds, rate):
    """A voice whose pitch moves evenly, in ln, from a to b Hz."""
    t = np.arange(int(seconds * rate)) / rate
    phase = 2 * np.pi * np.cumsum(a * (b / a) ** (t / seconds)) / rate
    return sum(0.3 / k * np.sin(k * phase) for k in range(1, 8))


def test_range_finder(spark):
    d = packed(spark, 8000, **{f"w{i}": buzz(100 + 10 * i, 0.8, 8000) for i in range(6)})
    s = f0_range.find_range(d, num_loop=2, target_duration=2, next_bin=False).collect()[0]  # steady tones leave the next bin empty
    assert np.exp(s["median"]) == pytest.approx(125, rel=0.1) and 90 < np.exp(s["min"]) and np.exp(s["max"]) < 170
    with pytest.raises(f0_range.RateError):
        f0_range.check_rates(d.union(packed(spark, 16_000, x=[0.0])))


def test_range_finder_judges_voices_by_the_next_bin(spark):
    d = packed(spark, 8000, **{f"w{i}": gliding(100, 160, 0.8, 8000) for i in range(6)})
    s = f0_range.find_range(d, num_loop=2, target_duration=2).collect()[0]
    assert np.exp(s["median"]) == pytest.approx((100 * 160) ** 0.5, rel=0.1) and 90 < np.exp(s["min"]) and np.exp(s["max"]) < 170


def test_range_finder_is_registered_with_its_defaults(spark, monkeypatch, tmp_path):
    from phonoduct.plans import signal_queries as Q

    spark.createDataFrame([(k, [float(i) for i in range(64)]) for k in range(30)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    calls = []
    monkeypatch.setattr(f0_range, "find_range", lambda waves, **given: calls.append((waves.selectExpr("size(samples) n", "samples[40] = samples[0] short").distinct().collect(), given)))
    Q.QUERIES["i10_f0_range_defaults"](spark, str(tmp_path))
    (got, given), = calls
    assert given == {} and {r.n for r in got} == {4000} and {r.short for r in got} == {True, False}


def test_each_tone_is_tracked_once_for_all_of_its_series(spark, monkeypatch, tmp_path):
    from phonoduct.plans import signal_queries as Q

    sizes = {f"a{i}": 300 * i for i in range(6)} | {f"b{i}": 300 * i + 299 for i in range(6)} | {"none": None, None: 7}
    rows = [(k, None if n is None else [0.0] * n) for k, n in sizes.items()] + [("b0", [0.0])]  # the longest row of a series counts
    spark.createDataFrame(rows, "series_id string, samples array<float>").write.parquet(f"{tmp_path}/packed_series.parquet")
    track, tracked = signals.f0, []

    def f0(waves, **given):
        tracked.extend(waves.select("samples").collect())
        silent = F.transform("samples", lambda x: F.lit(0.0).cast("float"))
        return track(waves.withColumn("samples", F.when(F.get("samples", F.lit(1)) > 0.4, silent).otherwise(F.col("samples"))), **given)  # those of 389 Hz

    monkeypatch.setattr(signals, "f0", f0)
    got = Q.QUERIES["i3_pitch_tones"](spark, str(tmp_path)).collect()
    assert sorted(len(r.samples) for r in tracked) == [4000] * 3
    for r in tracked:
        f = min((90, 97, 389), key=lambda f: np.abs(buzz(f, 0.5, 8000) - r.samples).max())
        assert r.samples == pytest.approx(buzz(f, 0.5, 8000), abs=1e-6)
    assert {r.series_id: r.holds for r in got} == {k: not str(k).startswith("b") for k in sizes} and len(got) == len(sizes)


def test_corpus_silence(spark):
    loud, quiet = sine(50, 1, 1000), np.zeros(1000)
    d = long(spark, a=np.concatenate([loud, quiet]), b=np.concatenate([quiet, loud]))
    mask = silence.extract_silence(d, 40, 64, 16)
    share = {r.series_id: r.s for r in mask.groupBy("series_id").agg({"idx": "count"}).join(mask.where("silent").groupBy("series_id").count().withColumnRenamed("count", "s"), "series_id").collect()}
    assert all(940 <= s <= 1000 for s in share.values())
    clips = silence.split_corpus(d, 1000, 40, 0.45, 0.1, "c", 64, 16, block=512).orderBy("number").collect()
    assert [r.name for r in clips] == ["c0.wav", "c1.wav"]
    assert (clips[0].start, clips[1].end) == (0, 3999) and 1000 <= clips[0].end <= 1150 and 2850 <= clips[1].start <= 3000
