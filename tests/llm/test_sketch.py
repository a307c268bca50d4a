import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonoduct.llm.sketch import OUTSIDE, Universe, check_stored, compress, digest_quantiles, digests, enclosure, judge, merge_digests, rank_bounds

U = Universe(0.0, 1.0, 10, 0.05)
SCHEMA = "sp string, day int, s string, i bigint, v double, node bigint, n int"


def data(seed=0, days=2):
    rng = np.random.default_rng(seed)
    return [("hot" if rng.random() < 0.6 else "cold", int(rng.integers(days)), f"s{k % 9}", k, float(rng.beta(2, 5)), 1, 1) for k in range(4000)]


def test_rank_error_is_bounded_and_merging_keeps_it(spark):
    x = data()
    df = spark.createDataFrame(x + x[:500], SCHEMA)  # repeated readings count once
    fine = digests(df, ["sp", "day"], "v", ["s", "i"], U)
    for d, keys in ((fine, ("sp", "day")), (merge_digests(fine, ["sp"], U), ("sp",)), (merge_digests(fine, [], U), ())):
        for r in d.collect():
            own = np.sort([t[4] for t in x if all(t[{"sp": 0, "day": 1}[k]] == r[k] for k in keys)])
            assert r.n == len(own) == sum(r.counts)
            assert len(r.nodes) <= 3 * 10 / 0.05 + 1
            at = np.linspace(0, 1, 97)
            below, upto = rank_bounds(np.array(r.nodes), np.array(r.counts), at, U)
            less, most = np.searchsorted(own, at, "left"), np.searchsorted(own, at, "right")
            assert (below <= less).all() and (upto >= most).all()
            in_cell = np.bincount(U.cell(own), minlength=U.cells).max()
            levels = len(keys) and 1 or 2
            assert (upto - below <= 2 * levels * 0.05 * r.n + in_cell + 1).all()


def test_quantiles_are_enclosed(spark):
    x = data(1)
    q = digest_quantiles(digests(spark.createDataFrame(x, SCHEMA), ["sp"], "v", ["s", "i"], U), [0.0, 0.5, 0.999, 1.0], U)
    for r in q.collect():
        own = np.sort([t[4] for t in x if t[0] == r.sp])
        for b in r.quantiles:
            assert b.low <= own[int((len(own) - 1) * b.p)] <= b.high


def test_bounds_are_counted(spark):
    x = data(5)
    df = spark.createDataFrame(x + x[:100], SCHEMA)
    q = digest_quantiles(digests(df, ["sp"], "v", ["s", "i"], U), [0.0, 0.5, 0.999], U)
    got = enclosure(df, q, ["sp"], "v", ["s", "i"], U).collect()
    assert len(got) == 6 and all(r.holds for r in got) and {r.n for r in got} == {sum(t[0] == k for t in x) for k in ("hot", "cold")}
    low = q.withColumn("quantiles", F.transform("quantiles", lambda b: F.struct(b.p, (b.low - 0.5).alias("low"), (b.high - 0.5).alias("high"))))
    wide = q.withColumn("quantiles", F.transform("quantiles", lambda b: F.struct(b.p, (b.low - 0.5).alias("low"), b.high)))
    for odd in (low, wide):
        assert not all(r.holds for r in enclosure(df, odd, ["sp"], "v", ["s", "i"], U).where("p = 0.5").collect())


@pytest.mark.parametrize("rows", [1, 3])
def test_a_key_may_have_more_pieces_than_a_batch(spark, rows):
    """Digests of many small parts, merged a few rows at a time, equal the digest of all."""
    from phonoduct.llm import sketch

    x = np.random.default_rng(6).integers(0, 1024, 3000)
    keys, schema = pa.table({"k": ["a", "b"]}), pa.schema([("k", pa.string()), ("nodes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    parts = [sketch._rows(keys, *sketch._add((np.arange(len(p)) >= len(p) // 2).astype(int), p + 1024, np.ones(len(p), int)), schema, 7) for p in np.split(x, 30)]
    table = pa.concat_tables(parts).sort_by("k")
    whole = pa.schema([schema.field(0), ("n", pa.int64()), schema.field(1), schema.field(2)])
    out = pa.Table.from_batches(list(sketch._merger(["k"], U, whole, None, rows)(iter(table.to_batches(max_chunksize=rows))))).to_pylist()
    assert [(r["k"], r["n"], sum(r["counts"])) for r in out] == [("a", 1500, 1500), ("b", 1500, 1500)]
    assert [len(r["nodes"]) <= 3 * 10 / 0.05 + 1 for r in out] == [True, True]


def test_compress_keeps_counts():
    rng = np.random.default_rng(2)
    node = np.sort(rng.choice(1024, 300, replace=False)) + 1024
    count = rng.integers(1, 50, 300)
    g, v, c = compress(np.zeros(300, int), node, count, 10, 0.1)
    assert c.sum() == count.sum() and len(v) < 300
    again = compress(g, v, c, 10, 0.1)
    assert again[2].sum() == count.sum()


def test_judgement_agrees_with_exact_quantiles():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 57):
        x = np.sort(rng.integers(0, 8, n) / 8)
        for p in (0.001, 0.5, 0.999):
            lo, hi = np.quantile(x, [max(p - 0.1, 0), min(p + 0.1, 1)])
            for s in np.linspace(-0.2, 1.2, 29):
                below, upto = np.searchsorted(x, s, "left"), np.searchsorted(x, s, "right")
                v = judge(n, np.array([below]), np.array([upto]), np.array([p]), 0.1)[0]
                if v < 2:
                    assert (v == OUTSIDE) == (s < lo or s > hi)


def test_stored_values_against_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    u = Universe(0.0, 1.0, 6, 0.2)  # so coarse that most values need the exact count
    x = [("a", 1, "s", i, float(v), 1, 1) for i, v in enumerate(rng.random(300))] + [("b", 1, "s", i, 0.25, 1, 1) for i in range(5)]
    own = {k: [t[4] for t in x if t[0] == k] for k in "ab"}
    stored, want = [], set()
    for j in range(40):
        for k in "ab":
            day = 1
            s = float(rng.choice([rng.random(), np.quantile(own[k], 0.5), np.quantile(own[k], 0.52), np.quantile(own[k], 0.48), 0.25]))
            lo, hi = np.quantile(own[k], [0.48, 0.52])
            stored.append((f"{k}", day, s, j))
            if s < lo or s > hi:
                want.add((k, j))
    frames = spark.createDataFrame([(sp, d, s, i, v) for sp, d, s, i, v, _, _ in x], "sp string, day int, s string, i bigint, v double")
    many = frames.crossJoin(spark.range(40).withColumnRenamed("id", "j"))
    table = spark.createDataFrame(stored, "sp string, day int, median double, j bigint")
    got = check_stored(many, table, ["sp", "day", "j"], "v", ["s", "i"], {"median": 0.5}, 0.02, u)
    assert {(r.sp, r.j) for r in got.collect()} == want


def test_edge_cases(spark):
    df = spark.createDataFrame([("a", 1, "s", 0, None, 1, 1), ("a", 1, "s", 1, float("nan"), 1, 1), ("a", 1, "s", 2, 7.0, 1, 1), (None, None, None, None, 0.5, 1, 1), (None, None, None, None, 0.5, 1, 1)], SCHEMA)
    assert [(r.sp, r.n) for r in digests(df, ["sp", "day"], "v", ["s", "i"], U).collect()] == [(None, 1)]
    assert digests(df.limit(0), ["sp"], "v", ["s", "i"], U).count() == 0
    stored = spark.createDataFrame([("a", 1, 0.5), ("b", 1, None), ("c", 1, float("nan"))], "sp string, day int, median double")
    frames = spark.createDataFrame([(k, 1, "s", i, 0.1 * i, 1, 1) for k in "bc" for i in range(5)], SCHEMA)
    assert [(r.sp, r.stat) for r in check_stored(frames, stored, ["sp", "day"], "v", ["s", "i"], {"median": 0.5}, universe=U).collect()] == [("c", "median")]


@pytest.mark.parametrize("x", [0.0, 1.0])
def test_limits_of_the_universe(x):
    assert 0 <= U.cell(np.array([x]))[0] < U.cells
