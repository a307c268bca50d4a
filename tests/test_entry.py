import os

import duckdb
import pytest

import __spark_entry__ as entry
from phonoduct.plans import registry

DATA = "/root/testdata/sf0.001"
HEAVY = {"i3_pitch", "i5_loudness", "e4_loudness_percentiles", "i10_f0_range"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["utt_id", "kind", "start_t", "end_t"]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - HEAVY))
def test_query_against_sql(spark, name):
    df = entry.queries()[name](spark, DATA)
    got = df.select(*sorted(df.columns)).collect()
    sql = registry.SQL.get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    names = ", ".join(f'"{c}"' for c in sorted(df.columns))
    assert plain(got) == plain(con.execute(f"select {names} from ({sql})").fetchall())
