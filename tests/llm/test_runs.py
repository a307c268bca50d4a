import random

import pytest

from phonoduct.llm.runs import collapse_runs, with_duration

SCHEMA = "s string, i bigint, v array<double>, k string, block int"


def brute(frames, within=0.0025, least=2):
    out = set()
    for s in {f[0] for f in frames}:
        v = {i: x for k, i, x in frames if k == s}
        run = []
        ok = lambda x: x is not None and len(x) > 0 and all(c is not None and c == c for c in x)
        for i in sorted(v):
            if run and ok(v[i]) and i == run[-1] + 1 and len(v[i]) == len(v[run[-1]]) and all(abs(a - b) <= within for a, b in zip(v[i], v[run[-1]])):
                run.append(i)
            else:
                if len(run) >= least:
                    out.add((s, run[0], len(run)))
                run = [i] if ok(v[i]) else []
        if len(run) >= least:
            out.add((s, run[0], len(run)))
    return out


def random_frames(seed):
    r = random.Random(seed)
    out = []
    for s, dim in (("a", 1), ("b", 3), ("hot", 2)):
        x = [0.0] * dim
        for i in range(400 if s == "hot" else 120):
            if r.random() < 0.3:
                x = [round(c + r.choice([0.001, 0.002, 0.003, 0.5]), 3) for c in x]
            out.append((s, i, r.choice([None, [], [float("nan")] * dim, [None] * dim]) if r.random() < 0.04 else list(x)))
    return [f for f in out if r.random() > 0.03]


@pytest.mark.parametrize("block", [65_536, 16])
@pytest.mark.parametrize("least", [1, 2])
def test_against_the_rule(spark, block, least):
    frames = random_frames(block)
    df = spark.createDataFrame([(*f, "clash", 1) for f in frames + frames[:40]], SCHEMA)
    got = collapse_runs(df, "s", "i", "v", min_events=least, block=block)
    assert {(r.s, r.first_idx, r.n_frames) for r in got.collect()} == brute(frames, least=least)
    assert got.count() == len(brute(frames, least=least))


def test_edge_cases(spark):
    df = spark.createDataFrame([("a", None, [1.0], "", 1), (None, 1, [1.0], "", 1), ("b", 0, [1.0], "", 1), ("b", 0, [5.0], "", 1), ("b", 1, [1.0], "", 1)], SCHEMA)
    assert [(r.s, r.first_idx, r.n_frames) for r in collapse_runs(df, "s", "i", "v").collect()] == [("b", 0, 2)]
    assert collapse_runs(df.limit(0), "s", "i", "v").count() == 0


def test_long_runs_cross_many_blocks(spark):
    df = spark.createDataFrame([("a", i, [1.0], "", 1) for i in range(100)], SCHEMA)
    assert [(r.first_idx, r.n_frames) for r in collapse_runs(df, "s", "i", "v", block=7).collect()] == [(0, 100)]


def test_durations(spark):
    runs = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4)], "series_id string, n_frames bigint")
    meta = spark.createDataFrame([("a", 100.0), ("a", 100.0), ("b", None), ("b", float("nan")), ("b", 0.0)], "series_id string, rate double")
    assert {r.series_id: r.duration_s for r in with_duration(runs, meta).collect()} == {"a": 0.04, "b": None, "c": None}
