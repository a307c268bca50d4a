import random

from phonoduct.llm.splitting import cut_series, forced, pieces

SCHEMA = "series_id string, rate double, samples array<float>, n int, x string"


def make(seed):
    r = random.Random(seed)
    out = []
    for k in range(30):
        rate = r.choice([5.0, 7.5, 8.0])
        x = []
        while len(x) < r.choice([20, 200, 400]):
            x += [r.choice([0.5, -0.5])] * r.randrange(1, 90) + [r.choice([0.0, 0.01, -0.019])] * r.randrange(1, 5)
        if r.random() < 0.3:
            x[r.randrange(len(x))] = float("nan")
        out.append((f"s{k}", rate, x))
    return out


def pauses(x, rate):
    out, i = [], 0
    while i < len(x):
        j = i
        while j < len(x) and abs(x[j]) < 0.02:
            j += 1
        if j - i and j - i >= 0.2 * rate - 1e-9:
            out.append((i, j))
        i = max(j, i + 1)
    return out


def test_pieces_and_forced_stretches(spark):
    rows = make(1)
    cut = cut_series(spark.createDataFrame([(*r, 1, "clash") for r in rows + rows[:3]], SCHEMA))
    got, want = {}, set()
    for r in pieces(cut).collect():
        got.setdefault(r.series_id, []).append(r)
    for s, rate, x in rows:
        limit, over = int(10 * rate), int(0.5 * rate)
        p = sorted(got[s], key=lambda r: r.piece)
        quiet = {i for a, b in pauses(x, rate) for i in range(a, b)}
        assert [r.piece for r in p] == list(range(len(p))) and p[0].first_idx == 0 and p[-1].last_idx == len(x) - 1
        for a, b in zip(p, p[1:]):
            assert b.first_idx == a.last_idx + 1 - over
        for r in p:
            assert r.last_idx - r.first_idx + 1 <= limit
            new = r.first_idx + (over if r.piece else 0)
            reach = range(new, min(r.first_idx + limit, len(x)))
            if r.last_idx < len(x) - 1:
                ends = [i for i in reach if i in quiet]
                assert r.last_idx == (max(ends) if ends else r.first_idx + limit - 1)
        if len(x) > 10 * rate:
            edges = [(-1, 0), *pauses(x, rate), (len(x), None)]
            f = [a[1] for a, b in zip(edges, edges[1:]) if b[0] - a[1] > 10 * rate]
            want |= {(s, i) for i in f or [-1]}
    assert {(r.series_id, r.forced_from) for r in forced(cut).collect()} == want


def test_edge_cases(spark):
    rows = [("null", 8.0, None), ("empty", 8.0, []), ("norate", None, [0.5] * 200), ("nan", float("nan"), [0.5] * 3), ("zero", 0.0, [0.5]), (None, 8.0, [0.5, None]), ("quiet", 8.0, [0.0] * 300)]
    cut = cut_series(spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA))
    got = sorted((r.series_id or "", r.first_idx, r.last_idx) for r in pieces(cut).where("series_id <> 'quiet' or series_id is null").collect())
    assert got == [("", 0, 1), ("nan", 0, 2), ("norate", 0, 199), ("zero", 0, 0)]
    assert [(r.series_id, r.forced_from) for r in forced(cut).collect()] == [("quiet", -1)]
    assert cut_series(spark.createDataFrame([], SCHEMA)).count() == 0
