import random

import numpy as np
import pytest

from phonoduct.operators import f0, silence
from phonoduct.operators import series as S
from phonoduct.operators.ranks import exact_percentiles, numbered


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_numbers_follow_the_order(spark):
    r = random.Random(1)
    rows = [(f"k{i:04d}", r.randrange(1, 9)) for i in range(300)]
    d = spark.createDataFrame(r.sample(rows, 300), "k string, n int").repartition(7)
    plain, total = numbered(d, ["k"])
    assert total == 300 and [(x.k, x.before) for x in plain.orderBy("k").collect()] == [(k, i) for i, (k, _) in enumerate(rows)]
    weighted, total = numbered(d, ["k"], "n", "offset")
    sums = np.cumsum([0, *(n for _, n in rows)])
    assert total == sums[-1] and [x.offset for x in weighted.orderBy("k").collect()] == sums[:-1].tolist()
    assert numbered(d.limit(0), ["k"])[1] == 0 and numbered(d.limit(0), ["k"])[0].count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_percentiles_are_exact(spark, seed):
    r = np.random.default_rng(seed)
    groups = {"a": r.normal(size=501), "b": np.round(r.normal(size=40), 1), None: np.array([2.0]), "z": np.zeros(5)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("empty", None)]
    probs = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    got = {x.k: list(x.q) for x in exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k] == pytest.approx(np.quantile(x, probs))
    all_ = np.concatenate(list(groups.values()))
    assert exact_percentiles(spark.createDataFrame(rows, "k string, v double"), [], "v", probs).collect()[0].q == pytest.approx(np.quantile(all_, probs))
    assert exact_percentiles(spark.createDataFrame([], "k string, v double"), [], "v", probs).count() == 0


def test_no_task_sees_all_rows(spark):
    d = spark.createDataFrame([(f"s{i}", j, 5.0, True) for i in range(5) for j in range(10)], "series_id string, idx bigint, lf0 double, voiced boolean")
    v = d.withColumnRenamed("lf0", "v")
    keys = v.select("series_id")
    for df in (silence.offsets(v), S.zip_by_position(keys, keys, "series_id", "series_id"), S.evenly_spaced(v, "series_id", 3), S.resample_linear(v, 100, 48), f0.log_statistics(d, by=["series_id"])):
        assert "SinglePartition" not in plan(df)


@pytest.mark.parametrize(("n", "most"), [(1, 1), (7, 1), (7, 7), (8, 7), (100, 7), (101, 100), (1000, 100), (50, 2)])
def test_evenly_spaced_positions(spark, n, most):
    keys = [f"{i:05d}" for i in range(n)]
    got = sorted(r[0] for r in S.evenly_spaced(spark.createDataFrame([(k,) for k in keys], "k string"), "k", most).collect())
    want = keys if n <= most else sorted({keys[int(i)] for i in np.linspace(0, n - 1, most)})
    assert got == want
