import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonoduct.operators import f0, series as S
from phonoduct.operators.series import AlignmentError
from phonoduct.plans import series_queries as Q

LONG = "series_id string, idx bigint, v double"


def long(spark, **named):
    return spark.createDataFrame([(k, i, float(x)) for k, v in named.items() for i, x in enumerate(v)], LONG)


def values(df, key="a"):
    return [r.v for r in df.where(df.series_id == key).orderBy("idx").collect()]


@pytest.mark.parametrize("scale", [1, 2, 7])
def test_resampling_by_a_whole_number_repeats(spark, scale):
    x = [3, 1, 4, 1, 5]
    assert values(S.resample_nearest(long(spark, a=x), 100, 100 * scale)) == list(np.repeat(x, scale).astype(float))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(20, 300), st.integers(20, 300), st.floats(0, 0.99))
def test_resampled_frames_are_near(spark, source, target, phase):
    got = values(S.resample_nearest(long(spark, a=range(40)), source, target, phase=phase))
    want = [int((phase + k) * source / target) for k in range(int(40 / source * target))]
    assert got == [float(x) for x in want if x < 40]


def test_linear_resampling_extrapolates(spark):
    assert values(S.resample_linear(long(spark, a=[0, 10, 20, 40]), 100, 200)) == [0, 5, 10, 15, 20, 30, 40, 50]
    assert values(S.resample_linear(long(spark, a=[7]), 100, 300)) == [7, 7, 7]


def test_split_into_equal_parts(spark, rows):
    parts = S.split(long(spark, a=range(100)), (0.2, 0.4, 0.6, 0.8), 100)
    for k in range(5):
        assert [r.v for r in parts.where(f"segment = {k}").orderBy("idx").collect()] == list(range(20 * k, 20 * k + 20))
    assert rows(S.segment_lengths(long(spark, a=range(5)), (0.02, 0.02, 0.09), 100), "segment", "n") == [(0, 2), (1, 0), (2, 3), (3, 0)]


def test_split_and_pad_with_the_edge_value(spark):
    x = [0] * 5 + list(range(1, 91)) + [0] * 5
    d = S.split_local(long(spark, a=x), (0.10, 0.30, 0.60), 100, padding=True)
    got = {r.name: r.n for r in d.groupBy("name").count().withColumnRenamed("count", "n").collect()}
    assert got == {f"a-{k}": 40 for k in range(4)}
    assert d.where("segment = 0 and idx >= 10 and v <> 0").count() == 0


def test_constant_series_and_edges(spark, rows):
    d = long(spark, a=[0] * 10, b=range(10))
    assert rows(S.all_same(d)) == [("a", True), ("b", False)]
    assert [(r.padding, r.problem) for r in S.edge_value(d).orderBy("series_id").collect()] == [(0.0, None), (None, "the edges differ")]


def test_components_are_taken_each_for_itself(spark):
    x = np.array([[0, 9], [4, 1], [2, 5], [8, 3]], float)
    d = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "series_id string, idx bigint, v array<float>")
    kinds = ("min", "max", "mean", "median")
    got = S.framed(d, 2, 1, True, 0.0, kinds).orderBy("idx").collect()
    padded = np.vstack([np.zeros((1, 2)), x, np.zeros((1, 2))])
    want = np.stack([padded[:-1], padded[1:]], 1)
    assert [[r[k] for k in kinds] for r in got] == [[getattr(np, k)(w, 0).tolist() for k in kinds] for w in want]
    assert values(S.resample_linear(d, 100, 200)) == [[0, 9], [2, 5], [4, 1], [3, 3], [2, 5], [5, 4], [8, 3], [11, 2]]
    one = long(spark, a=[7, 6])
    assert values(S.collect([(d, 100), (one, 100)], 100, "max")) == [[0, 9, 7], [4, 1, 6], [2, 5, 0], [8, 3, 0]]
    assert values(S.collect([(one, 100), (d, 100)], 100, "min")) == [[7, 0, 9], [6, 4, 1]]
    assert values(S.collect([(d, 100), (d.where("idx < 1"), 100)], 100, "first"))[1] == [4, 1, 0, 0]


def test_series_that_differ_after_the_fourth_frame_are_not_same(spark, rows, tmp_path):
    e = [(i, user, 1000.0 if user == 2 and i == 9 else 10.0) for user in (1, 2) for i in range(10)]
    spark.createDataFrame(e, "event_id bigint, user_id bigint, value double").selectExpr("*", "timestamp_seconds(event_id) ts", "'view' event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(Q.QUERIES["c4_all_same"](spark, str(tmp_path)), "series_id", "same") == [("1", True), ("2", False)]
    f = [("a", i, [1.0, 2.0]) for i in range(6)] + [("b", i, [1.0, 2.0 + (i == 5)]) for i in range(6)]
    spark.createDataFrame(f, "series_id string, idx bigint, v array<double>").write.parquet(f"{tmp_path}/series_frames.parquet")
    assert rows(Q.QUERIES["c4_all_same_frames"](spark, str(tmp_path)), "series_id", "same") == [("a", True), ("b", False)]


def test_frames(spark):
    x = [1, 5, 2, 8, 3, 9]
    f = S.framed(long(spark, a=x), 4, 2, True, 0.0, ("min", "max", "mean", "median")).orderBy("idx").collect()
    p = np.pad(np.array(x, float), 2)
    want = [p[k : k + 4] for k in range(0, len(p) - 3, 2)]
    assert [(r["min"], r["max"], r["mean"], r["median"]) for r in f] == [(w.min(), w.max(), w.mean(), np.median(w)) for w in want]
    assert S.framed(long(spark, a=[1, 2]), 4, 2).count() == 0
    with pytest.raises(ValueError):
        S.framed(long(spark, a=x), 4, 2, True)


def test_collect_policies(spark):
    a, b = long(spark, a=[1, 2, 3, 4], only=[1]), long(spark, a=[5, 6])
    get = lambda mode: values(S.collect([(a, 100), (b, 100)], 100, mode))
    assert get("min") == [[1, 5], [2, 6]]
    assert get("max") == get("first") == [[1, 5], [2, 6], [3, 0], [4, 0]]
    assert values(S.collect([(b, 50), (a, 100)], 100, "first")) == [[5, 1], [5, 2], [6, 3], [6, 4]]
    with pytest.raises(AlignmentError):
        S.collect([(a, 100), (b, 100)], 100, keys="strict")
    with pytest.raises(AlignmentError):
        S.collect([(a, 100), (b, 100)], 100, error_time_length=0.015)


def test_forms(spark):
    d = long(spark, a=[3, 1, 2])
    assert S.pack(d).collect()[0].samples == [3, 1, 2]
    assert values(S.unpack(S.pack(d))) == [3, 1, 2]
    assert [r[0] for r in spark.createDataFrame([("/x/y/one.two.npy",), ("plain",)], "p string").select(S.stem(F.col("p"))).collect()] == ["one.two", "plain"]


def test_neighbours_over_blocks(spark):
    d = long(spark, a=range(10)).where("idx <> 6")
    got = {r.idx: (r.prev, r.next) for r in S.with_neighbours(d, block=2).collect()}
    assert got == {i: (i - 1.0 if i not in (0, 7) else None, i + 1.0 if i not in (5, 9) else None) for i in (0, 1, 2, 3, 4, 5, 7, 8, 9)}


# ------------------------------------------------------------- pitch

def pitch(spark, hz):
    return f0.from_frequency(long(spark, a=hz).withColumnRenamed("v", "hz"))


@pytest.mark.parametrize(("vuv", "want"), [(False, [0, 200, 400, 600]), (True, [200, 200, 400, 600])])
def test_conversion_doubles(spark, vuv, want):
    p = pitch(spark, [0, 100, 200, 300])
    if vuv:
        p = f0.fill_unvoiced(p)
    c = f0.convert(p, input_mean=math.log(1), input_var=1, target_mean=math.log(2), target_var=1, with_vuv=vuv).orderBy("idx").collect()
    assert [round(math.exp(r.lf0)) if r.lf0 is not None else 0 for r in c] == want
    with pytest.raises(ValueError):
        f0.convert(p, target_mean=1.0, target_var=1.0)


def test_statistics_of_low_and_high(spark):
    hz = np.linspace(80, 120, 9)
    low, high = (f0.statistics(pitch(spark, list(hz * k))).collect()[0] for k in (0.5, 2))
    both = f0.statistics(pitch(spark, [*(hz * 0.5), *(hz * 2)])).collect()[0]
    assert [round(x, 2) for r in (low, high, both) for x in r] == [3.9, 0.02, 5.29, 0.02, 4.6, 0.5]


def test_filling_keeps_unvoiced_series_null(spark):
    assert [r.lf0 for r in f0.fill_unvoiced(pitch(spark, [0, 0])).collect()] == [None, None]
    assert f0.frame_rate(7.5) == 133


def weighted(v, w, p):
    o = np.lexsort((w, v))
    v, c = np.array(v)[o], np.cumsum(np.array(w)[o])
    t = p / 100 * c[-1]
    if t <= c[0]:
        return v[0]
    i = min(np.searchsorted(c, t, "left"), len(c) - 1)
    return v[i - 1] + (t - c[i - 1]) / (c[i] - c[i - 1]) * (v[i] - v[i - 1])


def test_weighted_percentiles(spark):
    rng = np.random.default_rng(5)
    v, w = rng.integers(50, 90, 300).astype(float), rng.random(300)
    ps = (0.1, 1, 10, 50, 99, 99.9)
    got = {r.percent: r.value for r in f0.weighted_percentiles(spark.createDataFrame(list(zip(v.tolist(), w.tolist())), "v double, w double"), "v", "w", ps, cells=16).collect()}
    assert got == {float(p): pytest.approx(weighted(v, w, p)) for p in ps}


def test_groups_close_above_the_target(spark):
    files = spark.createDataFrame([(f"f{i}", 2.0) for i in range(10)], "series_id string, seconds double")
    sizes = [r["count"] for r in f0.duration_groups(files, 5.0).groupBy("grp").count().collect()]
    assert sorted(sizes) == [3, 3, 3]
    assert f0.duration_groups(files, 100.0).count() == 10
