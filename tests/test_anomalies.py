import math
import random
from statistics import median

import numpy as np
import pytest

from phonoduct.operators.anomalies import Limits, bad_rates, decompose, esd_frames, esd_limit, esd_limits, esd_outliers, esd_outliers_by_group, exact_group_median, flag_frames

LOW, HIGH = math.log(20), math.log(2000)
SCHEMA = "series_id string, idx bigint, lf0 double, x double, block int"


def brute(frames):
    """The rules, one frame at a time."""
    out = set()
    for s in {f[0] for f in frames if f[0] is not None}:
        v = {}
        for k, i, x in frames:
            if k == s and i is not None and x is not None:
                v[i] = min(v[i], x) if i in v and not math.isnan(x) and not math.isnan(v[i]) else (v[i] if i in v and math.isnan(x) else x)
        bad = {i for i, x in v.items() if not math.isfinite(x) or (x != 0 and not LOW <= x <= HIGH)}
        fine = {i for i, x in v.items() if i not in bad and x != 0}
        stuck = set()
        for i in fine:
            w = range(i, i + 20)
            if all(j in fine for j in w) and max(v[j] for j in w) - min(v[j] for j in w) <= 0.00015:
                stuck |= set(w)
        use = fine - stuck
        m = [abs(v[i] - v[i - 1]) for i in use if i - 1 in use]
        out |= {(s, i) for i in bad | stuck}
        if not m:
            continue
        m = 13 * median(m)
        for i in use:
            for n in (1, 2, 3):
                w = range(i, i + n)
                if i - 1 in use and i + n in use and all(j in use for j in w):
                    a, b = v[i - 1], v[i + n]
                    if all(v[j] - a > m and v[j] - b > m for j in w) or all(a - v[j] > m and b - v[j] > m for j in w):
                        out |= {(s, j) for j in w}
    return out


def noisy(seed):
    r = random.Random(seed)
    out = []
    for s in "abcd":
        x = 5.0
        for i in range(400):
            x += r.gauss(0, 0.004)
            out.append((s, i, round(x, 4)))
        for _ in range(8):
            i, d = r.randrange(2, 390), r.choice([-1, 1]) * r.uniform(0.2, 0.7)
            for j in range(r.choice([1, 2, 3, 4])):
                out[-400 + i + j] = (s, i + j, round(out[-400 + i + j][2] + d, 4))
        at = r.randrange(0, 350)
        for j in range(r.choice([19, 20, 30])):
            out[-400 + at + j] = (s, at + j, 5.2 + 0.0001 * (j % 2))
        for _ in range(20):
            i = r.randrange(400)
            out[-400 + i] = (s, i, r.choice([0.0, None, float("nan"), float("inf"), 9.0, 1.0, -3.0]))
    return [x for x in out if r.random() > 0.03] + out[100:130]


@pytest.mark.parametrize("block", [65_536, 64])
def test_against_the_rules(spark, block):
    frames = noisy(3)
    df = spark.createDataFrame([(*f, 1.0, 2) for f in frames], SCHEMA)
    found = {(r.series_id, r.idx) for r in flag_frames(df, limits=Limits(block=block)).collect()}
    assert found == brute(frames)


def test_edge_cases(spark):
    assert flag_frames(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [("z", 0, 0.0), ("z", 1, 0.0), ("n", 0, None), (None, 0, 9.0), ("y", None, 9.0), ("one", 5, 9.0), ("one", 5, 9.0)]
    df = spark.createDataFrame([(*f, 1.0, 2) for f in odd], SCHEMA)
    assert [(r.series_id, r.idx) for r in flag_frames(df).collect()] == [("one", 5)]


def test_flat_series_has_no_scale(spark):
    frames = [("s", i, 5.0 + 0.001 * (i // 15) + (0.3 if i == 31 else 0)) for i in range(60)]
    df = spark.createDataFrame([(*f, 1.0, 2) for f in frames], SCHEMA)
    assert {(r.series_id, r.idx) for r in flag_frames(df).collect()} == brute(frames) == {("s", 31)}


def test_rates(spark):
    meta = [("a", "t", "f0", 100.0), ("b", "t", "f0", 100.0), ("c", "t", "f0", 104.0), ("d", "t", "f0", 106.0), ("d", "t", "f0", 106.0), ("e", "t", "f0", None),
            ("f", "t", "f0", float("nan")), ("g", "t", "f0", 0.0), ("h", "t", "mel", 5.0), ("i", None, "f0", 5.0), (None, "t", "f0", 5.0)]
    df = spark.createDataFrame(meta, "series_id string, tracker string, feature string, rate double")
    assert sorted(r[0] for r in bad_rates(df).collect()) == ["d", "f", "g"]
    assert bad_rates(df.limit(0)).count() == 0


def test_exact_median(spark):
    r = random.Random(1)
    v = [(k, abs(r.gauss(0, 1)) if r.random() > 0.3 else 0.5) for k in "abc" for _ in range(301 if k == "a" else 200)] + [("z", 0.0), ("z", 0.0)]
    got = {x.k: x.median for x in exact_group_median(spark.createDataFrame(v, "k string, v double"), "k", "v").collect()}
    assert got == {k: median(x for j, x in v if j == k) for k in "abcz"}


def test_decomposition_and_esd():
    t = np.arange(200)
    x = 0.01 * t + np.sin(2 * np.pi * t / 10)
    trend, season = decompose(x, np.array([0]), 21, 10)
    assert np.abs(x - trend - season)[20:-20].max() < 0.15
    rng = np.random.default_rng(0)
    r = rng.normal(size=300)
    r[[5, 50, 250]] = [9, -12, 10]
    assert set(np.flatnonzero(esd_outliers(r, np.array([0, 200]), 0.05))) == {5, 50, 250}


def seasonal(seed, series=4, n=1500, period=24, spikes=15):
    """(frames, planted): a drifting level, a season of each series' own, noise, and spikes of 8 to 30 deviations."""
    r, frames, planted = np.random.default_rng(seed), [], set()
    for s in range(series):
        noise = 0.004 * (s + 1)
        season = 0.2 * r.random(period) * (s + 1) / series
        x = 5 + 0.1 * np.sin(np.arange(n) / 400) + season[np.arange(n) % period] + r.normal(0, noise, n)
        at = r.choice(np.arange(40, n - 40), spikes, replace=False)
        x[at] += r.choice([-1, 1], spikes) * r.uniform(8, 30, spikes) * noise
        planted |= {(f"s{s}", int(i)) for i in at}
        frames += [(f"s{s}", i, float(v)) for i, v in enumerate(x)]
    return frames, planted


def test_esd_verdict_finds_planted_spikes_whatever_the_blocks(spark):
    frames, planted = seasonal(1)
    df = spark.createDataFrame([(*f, 1.0, 2) for f in frames + frames[:200]], SCHEMA)
    by_block = [{(r.series_id, r.idx) for r in esd_frames(df, limits=Limits(alpha=0.05, period=24, trend_window=49, block=b)).collect()} for b in (65_536, 256)]
    assert by_block[0] == by_block[1]
    hit = len(by_block[0] & planted)
    assert hit / len(planted) >= 0.95 and hit / len(by_block[0]) >= 0.95
    # without the season its swings drown the spikes
    plain = {(r.series_id, r.idx) for r in esd_frames(df, limits=Limits(alpha=0.05, trend_window=49)).collect()}
    assert len(plain & planted) < hit


def test_esd_verdict_keeps_range_and_stuck_checks(spark):
    r = np.random.default_rng(2)
    frames = [("s", i, float(v)) for i, v in enumerate(5 + r.normal(0, 0.01, 300))]
    frames[10], frames[20] = ("s", 10, 1.0), ("s", 20, float("nan"))
    frames[100:125] = [("s", i, 5.1) for i in range(100, 125)]
    got = {(x.idx, x.kind) for x in esd_frames(spark.createDataFrame([(*f, 1.0, 2) for f in frames], SCHEMA)).collect()}
    assert {i for i, k in got if k == "fixed"} == {10, 20, *range(100, 125)}
    assert esd_frames(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [("z", 0, 0.0), ("n", 0, None), (None, 0, 9.0), ("y", None, 9.0), ("one", 5, 9.0), ("one", 5, 9.0), ("two", 1, 5.0)]
    assert [(x.series_id, x.idx) for x in esd_frames(spark.createDataFrame([(*f, 1.0, 2) for f in odd], SCHEMA)).collect()] == [("one", 5)]


@pytest.mark.parametrize("seed", range(3))
def test_distributed_esd_agrees_with_removal_one_by_one(spark, seed):
    r = np.random.default_rng(seed)
    groups = {"a": r.standard_t(2, 200), "b": np.round(r.normal(size=101), 1), "c": np.array([0.0, 0.0, 5.0, 1.0]), "d": np.zeros(7)}
    want = set()
    for k, x in groups.items():
        left, last, removed = list(np.lexsort((np.arange(len(x)), np.abs(x)))), 0, []
        for i in range(1, max(len(x) // 2, 1) + 1):
            y = x[left]
            limit = esd_limits(np.array([len(x)]), np.array([i]), 0.05)[0]
            removed.append(left[-1])
            if len(left) > 2 and abs(x[left[-1]] - y.mean()) > limit * y.std(ddof=1):
                last = i
            left.pop()
        want |= {(k, int(i)) for i in removed[:last]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in groups.items() for i, v in enumerate(x)], "k string, i bigint, v double")
    assert {tuple(t) for t in esd_outliers_by_group(df, "k", "v", "i", 0.05).collect()} == want


def test_critical_values_as_expressions(spark):
    d = spark.createDataFrame([(n, i) for n in (5, 50, 5000) for i in (1, 2, n // 2)], "n bigint, i bigint")
    for r in d.withColumn("l", esd_limit(d.n, d.i, 0.05)).collect():
        assert r.l == pytest.approx(esd_limits(np.array([r.n]), np.array([r.i]), 0.05)[0], rel=2e-3)


def test_exact_median_of_signed_values(spark):
    r = random.Random(2)
    v = [(k, s, r.gauss(0, 1)) for k in "ab" for s in (1, 2) for _ in range(100 + s)]
    got = {(x.k, x.s): x.median for x in exact_group_median(spark.createDataFrame(v, "k string, s int, v double"), ["k", "s"], "v").collect()}
    assert got == {(k, s): median(x for a, b, x in v if (a, b) == (k, s)) for k in "ab" for s in (1, 2)}


def held(seed, n=300):
    """Levels held for two frames: half of all changes are small, so most readings are spikes by the rule and none stands out of the residuals."""
    r = np.random.default_rng(seed)
    return [("held", i, float(v)) for i, v in enumerate(np.repeat(r.uniform(5, 6, n), 2) + r.normal(0, 0.001, 2 * n))]


@pytest.mark.parametrize("block", [65_536, 256])
def test_no_spike_is_lost_where_esd_calls_none(spark, block):
    frames = held(5) + noisy(4)
    want = brute(frames)
    assert sum(s == "held" for s, _ in want) > 300
    df = spark.createDataFrame([(*f, 1.0, 2) for f in frames], SCHEMA)
    assert {(r.series_id, r.idx) for r in flag_frames(df, limits=Limits(alpha=0.05, period=24, block=block)).collect()} == want


def test_spikes_carry_the_verdict_of_the_whole_series(spark):
    frames, planted = seasonal(1)
    frames += held(6)
    df = spark.createDataFrame([(*f, 1.0, 2) for f in frames], SCHEMA)
    found = []
    for block in (65_536, 256):
        lim = Limits(alpha=0.05, period=24, trend_window=49, spike_times=2, block=block)
        rows = flag_frames(df, limits=lim).collect()
        assert {(r.series_id, r.idx) for r in rows if r.esd} == {(r.series_id, r.idx) for r in rows} & {(r.series_id, r.idx) for r in esd_frames(df, limits=lim).collect()}
        found.append({(r.series_id, r.idx, r.kind, r.esd) for r in rows})
    assert found[0] == found[1] and {x[3] for x in found[0]} == {True, False}
    assert len(planted & {x[:2] for x in found[0] if x[3]}) > len(planted) / 3
    # the season is part of the verdict
    plain = flag_frames(df, limits=Limits(alpha=0.05, trend_window=49, spike_times=2)).where("esd").collect()
    assert {(r.series_id, r.idx) for r in plain} != {x[:2] for x in found[0] if x[3]}
