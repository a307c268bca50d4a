import random
from collections import Counter

import numpy as np
import pytest

from phonoduct.llm.packing import best_fit, pack

SCHEMA = "doc_id bigint, n bigint, k int, h string, container int"


def one_by_one(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in room if r >= s]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - s)
        else:
            room.append(capacity - s)
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randrange(1, 101), r.randrange(1, 20), 34]) for _ in range(400)]
    plan = best_fit(Counter(sizes), 100)
    assert plan.containers == one_by_one(sizes, 100)
    fill = np.zeros(plan.containers, int)
    for s, n in Counter(sizes).items():
        at = plan.place(np.full(n, s), np.arange(n))
        np.add.at(fill, at, s)
    assert fill.max() <= 100 and fill.sum() == sum(sizes) and fill.min() > 0


@pytest.mark.parametrize("rank_rows", [2_000_000, 8])
def test_items_take_planned_slots(spark, rank_rows):
    r = random.Random(5)
    sizes = [r.choice([0, 7, 7, 7, r.randrange(1, 64), 64, 65, 200]) for _ in range(500)]
    df = spark.createDataFrame([(i, s, 1, "x", 3) for i, s in enumerate(sizes)], SCHEMA)
    got = pack(df, "doc_id", "n", 64, rank_rows).collect()
    fill = Counter()
    for x in got:
        fill[x.container] += x.n_units
    assert max(fill.values()) <= 64
    parts = {}
    for x in got:
        parts.setdefault(x.doc_id, []).append((x.part, x.first_unit, x.n_units))
    for i, s in enumerate(sizes):
        p = sorted(parts[i])
        assert sum(q[2] for q in p) == s and [q[0] for q in p] == list(range(len(p))) and [q[1] for q in p] == [64 * q[0] for q in p]
        assert len(p) == 1 or s > 64
    items = [64] * sum(s // 64 for s in sizes if s > 64) + [s % 64 for s in sizes if s > 64 and s % 64] + [s for s in sizes if 0 < s <= 64]
    assert len([c for c, n in fill.items() if n]) == one_by_one(items, 64)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 1, "", 1), (2, 0, 1, "", 1), (3, -4, 1, "", 1), (None, 5, 1, "", 1), (4, 5, 1, "", 1), (4, 5, 1, "", 1)], SCHEMA)
    got = pack(df, "doc_id", "n", 10).collect()
    assert len(got) == 6 and len({x.container for x in got if x.n_units}) == 2
    assert pack(df.limit(0), "doc_id", "n", 10).count() == 0
    assert {x.container for x in pack(df.where("n is null or n <= 0"), "doc_id", "n", 10).collect()} == {0}
