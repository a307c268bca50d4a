import random

from phonoduct.operators.intervals import label_ticks, periods_and_gaps

SCHEMA = "u string, s bigint, e bigint, k string, b int"


def expected(intervals):
    out = []
    for u in {i[0] for i in intervals}:
        merged = []
        for s, e in sorted((s, e) for k, s, e in intervals if k == u and s < e):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(u, "period", s, e) for s, e in merged]
        out += [(u, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


def run(spark, rows, data, bucket=6_000_000):
    df = spark.createDataFrame([(u, s, e, "clash", 1) for u, s, e in data], SCHEMA)
    return rows(periods_and_gaps(df, "u", "s", "e", bucket))


def test_overlaps_touches_nests_and_gaps(spark, rows):
    data = [("a", 0, 10), ("a", 10, 20), ("a", 12, 15), ("a", 30, 40), ("a", 35, 50), ("b", -5, 3), ("a", 0, 10)]
    assert run(spark, rows, data) == expected(data)


def test_rows_that_do_not_count(spark, rows):
    data = [("a", 5, 5), ("a", 9, 2), (None, 0, 1), ("a", None, 4), ("a", 4, None)]
    assert run(spark, rows, data) == []
    assert run(spark, rows, []) == []


def test_random_intervals_over_small_buckets(spark, rows):
    r = random.Random(7)
    data = [(r.choice("abc"), s := r.randrange(-500, 3000), s + r.randrange(0, 60)) for _ in range(300)]
    data += [("hot", s := r.randrange(0, 90_000), s + r.choice([5, 5, 5, 9_000])) for _ in range(200)]
    assert run(spark, rows, data, bucket=100) == expected(data)
    assert run(spark, rows, data) == expected(data)


def test_labels_that_count(spark, rows):
    nan, inf = float("nan"), float("inf")
    data = [
        ("u", "a", -0.00001, 0.10004), ("u", "sil", 0.1, 0.2), ("u", None, 0.2, 0.3), ("u", " 　", 0.3, 0.4), ("u", "b", nan, 0.5),
        ("u", "b", 0.5, inf), ("u", "b", None, 0.6), ("u", "b", 0.7, 0.69), (None, "b", 0.1, 0.2), ("u", "", 0.1, 0.9),
    ]
    df = spark.createDataFrame(data, "utt_id string, phoneme string, start_s double, end_s double")
    assert rows(label_ticks(df)) == [("u", 0, 1000), ("u", 1000, 2000)]
