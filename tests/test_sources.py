import io
import json
import pickle

import numpy as np
import pytest

from phonoduct.operators.f0_range import RateError
from phonoduct.operators.series import KEY, AlignmentError
from phonoduct.plans import commands
from phonoduct.sources import arrays, julius, manifest, wav
from phonoduct.sources.files import DuplicateStem


def test_wave_files(spark, tmp_path):
    x = np.sin(np.arange(800) / 9).astype("f4") * 0.5
    df = spark.createDataFrame([("a", 8000, x.tolist()), ("b", 8000, [0.0, 2.0])], "series_id string, sampling_rate int, samples array<float>")
    wav.write_waves(df, str(tmp_path / "w"))
    got = {r.series_id: r for r in wav.read_waves(spark, str(tmp_path / "w" / "*.wav")).collect()}
    assert got["a"].sampling_rate == 8000 and np.abs(np.array(got["a"].samples) - x).max() < 1e-4 and got["b"].samples[1] == pytest.approx(1, abs=1e-4)
    assert {r.series_id: r.seconds for r in wav.read_headers(spark, str(tmp_path / "w" / "*.wav")).collect()} == {"a": 0.1, "b": 0.00025}
    assert len(wav.read_waves(spark, str(tmp_path / "w" / "a.wav"), 16_000).collect()[0].samples) == 1600


@pytest.mark.parametrize(("code", "bits", "kind"), [(1, 8, None), (1, 24, None), (1, 32, "<i4"), (3, 32, "<f4"), (3, 64, "<f8")])
def test_sample_formats(code, bits, kind):
    import struct

    x = np.array([0.0, 0.5, -0.5, 0.25])
    if bits == 8:
        body = (x * 128 + 128).astype("u1").tobytes()
    elif bits == 24:
        body = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x)
    else:
        body = (x * (1 << 31) if code == 1 else x).astype(kind).tobytes()
    raw = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, code, 2, 100, 0, 0, bits) + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body
    got, rate = wav.decode(raw)
    assert rate == 100 and got == pytest.approx([0.25, -0.125])
    with pytest.raises(ValueError):
        wav.header(b"no wave at all")


def test_label_files(spark, tmp_path, rows):
    (tmp_path / "u.lab").write_text("0.0 0.1 silB\n\n0.1 0.3 a\n0.3 0.4 silE\n")
    d = julius.read_labels(spark, str(tmp_path / "*.lab"), "jvs")
    assert [r.phoneme for r in d.orderBy("pos").collect()] == ["pau", "a", "pau"]
    julius.write_labels(d, str(tmp_path / "out"), "jvs")
    assert (tmp_path / "out" / "u.lab").read_text() == "0.0000\t0.1000\tpau\n0.1000\t0.3000\ta\n0.3000\t0.4000\tpau"
    (tmp_path / "u.txt").write_text("0 1\n1")
    assert rows(julius.read_flags(spark, str(tmp_path / "*.txt"), "start_accent"), "pos", "start_accent") == [(0, False), (1, True), (2, True)]


def test_arrays_without_running_code(spark, tmp_path):
    np.save(tmp_path / "a.npy", {"array": np.arange(3.0), "rate": 200}, allow_pickle=True)
    np.save(tmp_path / "b.npy", np.ones((2, 2)))
    got = {r.series_id: (r.rate, r.array) for r in arrays.read_arrays(spark, str(tmp_path / "*.npy")).collect()}
    assert got == {"a": (200.0, [[0.0], [1.0], [2.0]]), "b": (None, [[1.0, 1.0], [1.0, 1.0]])}

    class Evil:
        def __reduce__(self):
            return print, ("ran",)

    f = io.BytesIO()
    np.save(f, np.array({"array": Evil(), "rate": 1}, dtype=object), allow_pickle=True)
    with pytest.raises(pickle.UnpicklingError):
        arrays.load(f.getvalue())


def test_same_stems_are_noticed(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.wav").write_bytes(wav.encode(np.zeros(4), 8000))
    with pytest.raises(DuplicateStem):
        wav.read_waves(spark, str(tmp_path / "*" / "*.wav"))


def test_manifest(tmp_path):
    manifest.save_arguments({"b": tmp_path, "a": 1, "spark": object()}, str(tmp_path))
    assert json.loads((tmp_path / "arguments.json").read_text()) == {"a": 1, "b": str(tmp_path)}


def test_commands_end_to_end(spark, tmp_path):
    t = np.arange(8000) / 8000
    x = sum(np.sin(2 * np.pi * 150 * k * t) / k for k in range(1, 6)) * 0.2
    df = spark.createDataFrame([("a", 8000, x.tolist()), ("b", 8000, np.concatenate([x, np.zeros(8000), x]).tolist())], "series_id string, sampling_rate int, samples array<float>")
    wav.write_waves(df, str(tmp_path / "wav"))
    glob, out = str(tmp_path / "wav" / "*.wav"), lambda n: str(tmp_path / n)
    commands.extract_volume(spark, glob, out("volume"))
    d, rate = commands.load_series(spark, out("volume"))
    assert rate == 40 and d.count() == 41 + 121 and (tmp_path / "volume" / "arguments.json").exists()
    commands.extract_f0(spark, glob, out("f0"), with_vuv=True)
    commands.extract_f0_statistics(spark, out("f0"), out("stats"))
    assert np.exp(spark.read.parquet(out("stats")).collect()[0]["mean"]) == pytest.approx(150, rel=0.02)
    commands.extract_converted_f0(spark, out("f0"), out("f0b"), input_statistics=out("stats"), target_mean=5.0, target_var=0.1)
    assert commands.analyze_f0(spark, out("f0")).count() == 10
    commands.extract_framed_local(spark, out("volume"), out("framed"), 4, 2, True, 0.0)
    commands.extract_splited_local(spark, out("volume"), out("split"), [0.5])
    commands.extract_collected_local(spark, [out("volume"), out("volume")], out("both"), 40)
    assert {len(r.v) for r in commands.load_series(spark, out("both"))[0].collect()} == {2}
    commands.extract_silence(spark, glob, out("silence"))
    commands.tool_split_wave(spark, glob, out("clips"), prefix="c")
    assert (tmp_path / "clips" / "c0.wav").exists()
    assert commands.analyze_wave(spark, glob).columns == ["max", "min"]
    assert len(commands.COMMANDS) == 22 and KEY == "series_id"


def tone(seconds, rate):
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.sin(2 * np.pi * 150 * k * t) / k for k in range(1, 6)) * 0.2


@pytest.fixture
def two_rates(spark, tmp_path):
    rows = [("a", 8000, tone(1, 8000).tolist()), ("b", 4000, np.concatenate([tone(1, 4000), np.zeros(4000), tone(1, 4000)]).tolist())]
    wav.write_waves(spark.createDataFrame(rows, "series_id string, sampling_rate int, samples array<float>"), str(tmp_path / "wav"))
    return str(tmp_path / "wav" / "*.wav")


def test_commands_keep_each_wave_at_its_rate(spark, tmp_path, two_rates):
    out = lambda n: str(tmp_path / n)
    rates = lambda n: {r.series_id: r.rate for r in spark.read.parquet(out(n) + "/series_meta").collect()}
    commands.extract_wave(spark, two_rates, out("wave"), clipping_auto=True)
    assert rates("wave") == {"a": 8000, "b": 4000}
    commands.extract_volume(spark, two_rates, out("volume"))
    assert rates("volume") == {"a": 40, "b": 20}
    d, rate = commands.load_series(spark, out("volume"))
    assert {r.series_id: r.n for r in d.groupBy("series_id").count().withColumnRenamed("count", "n").collect()} == {"a": 41, "b": 61}
    assert {(r.series_id, r.rate) for r in rate.collect()} == {("a", 40), ("b", 20)}
    commands.extract_framed_local(spark, out("volume"), out("framed"), 4, 2, True, padding_mode="edge")
    assert rates("framed") == {"a": 20, "b": 10}
    commands.extract_splited_local(spark, out("volume"), out("split"), [0.5], file_format="{stem}_part{i}{suffix}")
    assert rates("split") == {"a_part0": 40, "a_part1": 40, "b_part0": 20, "b_part1": 20}
    n = {r.series_id: r.n for r in commands.load_series(spark, out("split"))[0].groupBy("series_id").agg({"idx": "count"}).withColumnRenamed("count(idx)", "n").collect()}
    assert n == {"a_part0": 20, "a_part1": 21, "b_part0": 10, "b_part1": 51}
    commands.extract_collected_local(spark, [out("volume"), out("wave")], out("both"), 20, error_time_length=0.1)
    assert rates("both") == {"a": 20, "b": 20}
    with pytest.raises(RateError):
        commands.extract_silence(spark, two_rates, out("silence"))
    with pytest.raises(ValueError, match="names are made of"):
        commands.extract_splited_local(spark, out("volume"), out("odd"), [0.5], file_format="{name}")


def test_frames_of_many_components_are_collected(spark, tmp_path, two_rates):
    out = lambda n: str(tmp_path / n)
    commands.extract_melspectrogram(spark, two_rates, out("mel"), sampling_rate=8000, n_mels=10, n_fft=512, win_length=256, hop_length=200, fmax=4000)
    commands.extract_volume(spark, two_rates, out("volume"), sampling_rate=8000)
    commands.extract_f0(spark, two_rates, out("f0"), with_vuv=True)
    commands.extract_collected_local(spark, [out("mel"), out("volume"), out("f0")], out("all"), 40, error_time_length=0.1)
    assert {len(r.v) for r in commands.load_series(spark, out("all"))[0].collect()} == {13}


def test_length_errors_are_dead_letters(spark, tmp_path):
    def stored(name, **n):
        rows = [(k, i, float(i)) for k, m in n.items() for i in range(m)]
        commands.save_series(spark.createDataFrame(rows, "series_id string, idx bigint, v double"), str(tmp_path / name), 100, {})
        return str(tmp_path / name)

    both = [stored("x", a=100, b=100, c=100), stored("y", a=101, b=150, c=100)]
    with pytest.raises(AlignmentError):
        commands.extract_collected_local(spark, both, str(tmp_path / "out"), 100)
    dead = commands.extract_collected_local(spark, both, str(tmp_path / "out"), 100, ignore_error=True)
    assert [r.series_id for r in dead.collect()] == ["b"]
    assert {r.series_id for r in commands.load_series(spark, str(tmp_path / "out"))[0].collect()} == {"a", "c"}


@pytest.mark.parametrize("name", ["extract_volume", "extract_wave", "extract_melspectrogram", "extract_loudness", "extract_f0", "extract_silence", "tool_split_wave"])
@pytest.mark.parametrize("rate", [None, 8000])
def test_each_file_is_decoded_once(spark, tmp_path, monkeypatch, name, rate):
    rows = [(k, 8000, tone(0.5, 8000).tolist()) for k in "abcd"]
    wav.write_waves(spark.createDataFrame(rows, "series_id string, sampling_rate int, samples array<float>"), str(tmp_path / "wav"))
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(wav, "DECODED", seen)
    options = {"n_mels": 10, "n_fft": 512, "win_length": 256, "fmax": 4000} if name == "extract_melspectrogram" else {}
    if name == "extract_loudness":
        options = {"sampling_rate": 100}
    elif rate or name == "extract_melspectrogram":
        options |= {"sampling_rate": 8000}
    commands.COMMANDS[name](spark, str(tmp_path / "wav" / "*.wav"), str(tmp_path / "out"), **options)
    assert seen.value == 4


def test_arrays_are_waves_too(spark, tmp_path):
    x = np.sin(np.arange(100) / 9)
    np.save(tmp_path / "a.npy", {"array": x, "rate": 8000}, allow_pickle=True)
    np.savez(tmp_path / "b.npz", array=x[:, None], rate=4000)
    got = {r.series_id: (r.sampling_rate, r.samples) for r in wav.read_waves(spark, str(tmp_path / "*.np[yz]")).collect()}
    assert {k: r for k, (r, _) in got.items()} == {"a": 8000, "b": 4000} and all(np.allclose(s, x, atol=1e-6) for _, s in got.values())
    with pytest.raises(ValueError):
        wav.decode((tmp_path / "a.npy").read_bytes().replace(b"rate", b"rat_"))


def test_statistics_files(spark, tmp_path):
    np.save(tmp_path / "s.npy", {"mean": np.float32(5.0), "var": 0.25}, allow_pickle=True)
    assert [tuple(r) for r in arrays.read_statistics(spark, str(tmp_path / "s.npy")).collect()] == [(5.0, 0.25)]


def test_range_of_a_corpus_with_its_histograms(spark, tmp_path):
    t = np.arange(8000) / 8000
    glide = 2 * np.pi * np.cumsum(100 * 1.6 ** t) / 8000
    x = sum(0.3 / k * np.sin(k * glide) for k in range(1, 8))
    wav.write_waves(spark.createDataFrame([(k, 8000, x.tolist()) for k in "ab"], "series_id string, sampling_rate int, samples array<float>"), str(tmp_path / "wav"))
    commands.extract_f0_range(spark, str(tmp_path / "wav" / "*.wav"), str(tmp_path / "range.json"), num_loop=2, target_duration=1, verbose_dir=str(tmp_path / "verbose"))
    assert set(json.loads((tmp_path / "range.json").read_text())) >= {"mean", "median", "q999"}
    assert spark.read.parquet(str(tmp_path / "verbose" / "1" / "histogram")).columns == ["bin", "n", "volume"]
    assert spark.read.parquet(str(tmp_path / "verbose" / "0" / "histogram_2d")).count() > 0


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from phonoduct import runtime

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.cut_lineage(Frame())
