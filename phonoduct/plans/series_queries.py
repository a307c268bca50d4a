"""Queries of series, pitch and weighted statistics, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonoduct.operators import f0
from phonoduct.operators import series as S
from phonoduct.plans.inputs import EVENTS, FRAMES, PITCH, SOURCES, WEIGHTED, dense_frames, events, frames, pitch, rates, series, source, weighted

KEYPOINTS = (0.1, 0.25, 0.6)
QUERIES, SQL = {}, {}


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _known(c: Column) -> Column:
    """NaN as null, so that results compare in any way."""
    return F.when(~F.isnan(c), c)


def _parts(n: int, digits: int = 6) -> list[Column]:
    return [F.round(_known(F.get("v", F.lit(i)).cast("double")), digits).alias(f"v{i}") for i in range(n)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ------------------------------------------------------------- framing and resampling
_FRAMED = "with " + EVENTS + """,
p as (select series_id, idx + {pad} j, v from e {ends}),
f as (select series_id, unnest(range(0, (n + 2 * {pad} - 8) // 4 + 1)) k from n)
select f.series_id, k as idx, min(v) as "min", max(v) as "max", round(avg(v), 6) as mean, median(v) as median
from f join p on f.series_id = p.series_id and j >= k * 4 and j < k * 4 + 8 group by 1, 2"""
_ENDS = "union all select series_id, unnest(range(0, 4)), 0.0 from n union all select series_id, unnest(range(n + 4, n + 8)), 0.0 from n"


@query("f1_framed_centered", _FRAMED.format(pad=4, ends=_ENDS))
def f1_framed_centered(spark, d):
    return S.framed(series(spark, d), 8, 4, True, 0.0, ("min", "max", "mean", "median")).select("series_id", "idx", "min", "max", *_r("mean"), "median")


@query("f1_framed", _FRAMED.format(pad=0, ends=""))
def f1_framed(spark, d):
    return S.framed(series(spark, d), 8, 4, kinds=("min", "max", "mean", "median")).select("series_id", "idx", "min", "max", *_r("mean"), "median")


@query("f1_framed_parts", "with " + FRAMES + """,
q as (select series_id, n, unnest(range(0, w)) part from n),
p as (select series_id, part, idx + 4 j, v[part + 1] v from e join q using (series_id) union all select series_id, part, unnest(range(0, 4)), 0.0 from q union all select series_id, part, unnest(range(n + 4, n + 8)), 0.0 from q),
f as (select series_id, part, unnest(range(0, n // 4 + 1)) k from q)
select f.series_id, k as idx, cast(f.part as integer) part, case when not isnan(min(v)) then min(v) end as "min", case when not isnan(max(v)) then max(v) end as "max", round(case when not isnan(avg(v)) then avg(v) end, 6) as mean, case when not isnan(median(v)) then median(v) end as median
from f join p on f.series_id = p.series_id and f.part = p.part and j >= k * 4 and j < k * 4 + 8 group by 1, 2, 3""")
def f1_framed_parts(spark, d):
    kinds = ("min", "max", "mean", "median")
    f = S.framed(dense_frames(spark, d), 8, 4, True, 0.0, kinds)
    return f.select("series_id", "idx", F.posexplode(F.arrays_zip(*kinds)).alias("part", "s")).select("series_id", "idx", "part", *[_known(F.col(f"s.{k}")).alias(k) for k in kinds]).withColumn("mean", F.round("mean", 6))


@query("f6_resample_nearest", "with " + EVENTS + """,
k as (select series_id, unnest(range(0, cast(floor(n / 1e2 * 150e0) as bigint))) k from n)
select k.series_id, k as idx, v from k join e on k.series_id = e.series_id and e.idx = cast(floor(k * 1e2 / 150e0) as bigint)""")
def f6_resample_nearest(spark, d):
    return S.resample_nearest(series(spark, d), 100, 150)


@query("f5_resample_200", "with " + EVENTS + """,
k as (select series_id, unnest(range(0, cast(floor(n / 46.875e0 * 200e0) as bigint))) k from n)
select k.series_id, k as idx, v from k join e on k.series_id = e.series_id and e.idx = cast(floor(k * 46.875e0 / 200e0) as bigint)""")
def f5_resample_200(spark, d):
    return S.resample_nearest(series(spark, d), 24000 / 512, 200)


@query("f7_resample_linear", "with " + EVENTS + """,
k as (select series_id, n, unnest(range(0, cast(floor(n / 1e2 * 48e0) as bigint))) k from n),
x as (select *, k * 1e2 / 48e0 t, greatest(least(cast(floor(k * 1e2 / 48e0) as bigint), n - 2), 0) i from k)
select x.series_id, k as idx, round(a.v + (t - i) * coalesce(b.v - a.v, 0), 6) v from x join e a on x.series_id = a.series_id and a.idx = i left join e b on x.series_id = b.series_id and b.idx = i + 1""")
def f7_resample_linear(spark, d):
    return S.resample_linear(series(spark, d), 100, 48).select("series_id", "idx", *_r("v"))


_PARTS = ", ".join("round(case when not isnan({0}[%d]) then {0}[%d] end, 6) v%d" % (i + 1, i + 1, i) for i in range(3))


@query("f7_resample_linear_parts", "with " + FRAMES + """,
k as (select series_id, n, unnest(range(0, cast(floor(n / 1e2 * 48e0) as bigint))) k from n),
x as (select *, k * 1e2 / 48e0 t, greatest(least(cast(floor(k * 1e2 / 48e0) as bigint), n - 2), 0) i from k),
y as (select x.series_id, k as idx, list_transform([1, 2, 3], lambda c: a.v[c] + (t - i) * coalesce(b.v[c] - a.v[c], 0)) v from x join e a on x.series_id = a.series_id and a.idx = i left join e b on x.series_id = b.series_id and b.idx = i + 1)
select series_id, idx, """ + _PARTS.format("v") + " from y")
def f7_resample_linear_parts(spark, d):
    r = S.resample_linear(dense_frames(spark, d), 100, 48)
    return r.select("series_id", "idx", *_parts(3))


# ------------------------------------------------------------- splitting
_SPLIT = "with " + EVENTS + """,
s as (select series_id, idx, v, case when idx < 10 then 0 when idx < 25 then 1 when idx < 60 then 2 else 3 end segment from e),
t as (select series_id, segment, idx - case segment when 0 then 0 when 1 then 10 when 2 then 25 else 60 end idx, v from s)"""


@query("h1_split", _SPLIT + " select series_id, segment, idx, v from t")
def h1_split(spark, d):
    return S.split(series(spark, d), KEYPOINTS, 100)


@query("h1_segment_lengths", "with " + EVENTS + """ select series_id, s.i as segment, greatest(least(n, s.z) - least(n, s.a), 0) n
from n, (values (0, 0, 10), (1, 10, 25), (2, 25, 60), (3, 60, 1000000000)) s(i, a, z)""")
def h1_segment_lengths(spark, d):
    return S.segment_lengths(series(spark, d), KEYPOINTS, 100)


@query("h2_padding", "with " + EVENTS + """, m as (select max(n) m from n)
select series_id, idx, v from e union all select series_id, unnest(range(n, m)), -1.0 from n, m where n < m""")
def h2_padding(spark, d):
    return S.pad_tail(series(spark, d), -1.0)


@query("h2_padding_parts", "with " + FRAMES + """, m as (select max(n) m from n),
x as (select series_id, idx, v from e union all select series_id, unnest(range(n, m)), list_transform(range(0, w), lambda i: -1e0) from n, m where n < m)
select series_id, idx, """ + _PARTS.format("v") + " from x")
def h2_padding_parts(spark, d):
    p = S.pad_tail(dense_frames(spark, d), -1.0)
    return p.select("series_id", "idx", *_parts(3))


_RATES = "r as (select series_id, min(rate) rate from series_meta where rate > 0 and rate < 'infinity'::double group by 1)"


@query("f6_resample_rates", "with " + FRAMES + ", " + _RATES + """,
k as (select series_id, rate, unnest(range(0, cast(floor(n / rate * 50e0) as bigint))) k from n join r using (series_id))
select k.series_id, k as idx, """ + _PARTS.format("v") + " from k join e on k.series_id = e.series_id and e.idx = cast(floor(k * rate / 50e0) as bigint)")
def f6_resample_rates(spark, d):
    """Frames of one to three components, each series from its own rate to 50."""
    p = S.resample_nearest(dense_frames(spark, d), rates(spark, d), 50)
    return p.select("series_id", "idx", *_parts(3))


@query("f7_resample_linear_rates", "with " + FRAMES + ", " + _RATES + """,
k as (select series_id, n, rate, unnest(range(0, cast(floor(n / rate * 50e0) as bigint))) k from n join r using (series_id)),
x as (select *, k * rate / 50e0 t, greatest(least(cast(floor(k * rate / 50e0) as bigint), n - 2), 0) i from k),
y as (select x.series_id, k as idx, list_transform([1, 2, 3], lambda c: a.v[c] + (t - i) * coalesce(b.v[c] - a.v[c], 0)) v from x join e a on x.series_id = a.series_id and a.idx = i left join e b on x.series_id = b.series_id and b.idx = i + 1)
select series_id, idx, """ + _PARTS.format("v") + " from y")
def f7_resample_linear_rates(spark, d):
    r = S.resample_linear(dense_frames(spark, d), rates(spark, d), 50)
    return r.select("series_id", "idx", *_parts(3))


@query("h1_split_rates", "with " + FRAMES + ", " + _RATES + """,
x as (select e.series_id, idx, v, cast(floor(rate * 2) as bigint) b from e join r using (series_id))
select series_id, case when idx < b then 0 else 1 end segment, case when idx < b then idx else idx - b end idx, """ + _PARTS.format("v") + " from x")
def h1_split_rates(spark, d):
    """Each series cut after two seconds of its own rate."""
    p = S.split(dense_frames(spark, d), (2.0,), rates(spark, d))
    return p.select("series_id", "segment", "idx", *_parts(3))


@query("d5_collect_rates", "with " + FRAMES + ", " + _RATES + """,
m as (select series_id, rate, w, cast(floor(n * 50e0 / rate) as bigint) a, cast(floor(n * 50e0 / 80e0) as bigint) b from n join r using (series_id)),
k as (select series_id, rate, w, a, b, unnest(range(0, greatest(a, b))) k from m where least(a, b) > 0),
x as (select k.series_id, k as idx, list_concat(list_transform(range(1, w + 1), lambda i: case when k < a then coalesce(p.v[i], 0) else 0 end), list_transform(range(1, w + 1), lambda i: case when k < b then coalesce(q.v[i], 0) else 0 end)) v
  from k left join e p on p.series_id = k.series_id and p.idx = cast(floor(k * rate / 50e0) as bigint) left join e q on q.series_id = k.series_id and q.idx = cast(floor(k * 80e0 / 50e0) as bigint))
select series_id, idx, """ + ", ".join(f"round(case when not isnan(v[{i + 1}]) then cast(cast(v[{i + 1}] as float) as double) end, 4) v{i}" for i in range(6)) + " from x")
def d5_collect_rates(spark, d):
    """Frames at the rate of their series beside the same frames taken for 80 a second, at 50."""
    f = dense_frames(spark, d)
    c = S.collect([(f, rates(spark, d)), (f, 80)], 50, "max")
    return c.select("series_id", "idx", *_parts(6, 4))


for _mode, _sql in [("edge", "greatest(least(j - 4, n - 1), 0)"), ("reflect", "case when n = 1 then 0 when (j - 4 + 20 * (n - 1)) % (2 * (n - 1)) < n then (j - 4 + 20 * (n - 1)) % (2 * (n - 1)) else 2 * (n - 1) - (j - 4 + 20 * (n - 1)) % (2 * (n - 1)) end"), ("wrap", "(j - 4 + 20 * n) % n")]:

    def _padded(spark, d, mode=_mode):
        return S.framed(series(spark, d), 8, 4, True, kinds=("min", "mean"), padding_mode=mode).select("series_id", "idx", "min", *_r("mean"))

    query(f"f2_framed_{_mode}", "with " + EVENTS + f""",
j as (select series_id, n, unnest(range(0, n + 8)) j from n),
p as (select j.series_id, j, v from j join e on e.series_id = j.series_id and e.idx = {_sql}),
f as (select series_id, unnest(range(0, n // 4 + 1)) k from n)
select f.series_id, k as idx, min(v) as "min", round(avg(v), 6) as mean from f join p on f.series_id = p.series_id and j >= k * 4 and j < k * 4 + 8 group by 1, 2""")(_padded)


@query("h2b_split_local", "with " + EVENTS + """,
q as (select series_id, idx, case when v > 60 then 1e0 else 0e0 end v from e),
s as (select series_id, idx, v, case when idx < 3 then 0 when idx < 6 then 1 else 2 end segment from q),
t as (select series_id, segment, idx - segment * 3 idx, v from s),
c as (select series_id, segment, count(*) n from t group by 1, 2 having min(v) <> max(v)),
x as (select series_id, case when min(v) = max(v) then min(v) end pad from q join n using (series_id) where idx < 5 or idx >= n - 5 group by 1),
m as (select series_id, max(n) m from c group by 1),
o as (select t.series_id, segment, idx, v from t semi join c using (series_id, segment)
  union all select c.series_id, segment, unnest(range(n, m)), pad from c join m using (series_id) join x using (series_id) where n < m)
select *, series_id || '-' || segment as name from o""")
def h2b_split_local(spark, d):
    q = series(spark, d).withColumn("v", F.when(F.col("v") > 60, 1.0).otherwise(0.0))
    return S.split_local(q, (0.03, 0.06), 100, padding=True, remove_all_same=True)


@query("c4_all_same", "with " + EVENTS + " select series_id, count(distinct cast(v as bigint) // 250) = 1 and count(v) = count(*) same from e group by 1")
def c4_all_same(spark, d):
    """Whole series of events, binned by 250 so that some are constant."""
    return S.all_same(series(spark, d).withColumn("v", F.floor(F.rint("v") / 250)))


@query("c4_all_same_frames", "select series_id, count(distinct v) = 1 and count(v) = count(*) same from series_frames group by 1")
def c4_all_same_frames(spark, d):
    """Frames of one to three components as they are stored."""
    return S.all_same(frames(spark, d))


@query("c5_drop_constant", "with " + EVENTS + """, s as (select series_id, idx, case when idx < 2 then 0 when idx < 4 then 1 else 2 end segment, case when v > 60 then 1e0 else 0e0 end v from e),
k as (select series_id, segment from s group by 1, 2 having min(v) <> max(v))
select series_id, segment, idx - segment * 2 idx, v from s semi join k using (series_id, segment)""")
def c5_drop_constant(spark, d):
    q = series(spark, d).withColumn("v", F.when(F.col("v") > 60, 1.0).otherwise(0.0))
    return S.drop_constant(S.split(q, (0.02, 0.04), 100)).select("series_id", "segment", "idx", "v")


@query("c11_edge_value", "with " + EVENTS + """, q as (select series_id, idx, case when v > 60 then 1e0 else 0e0 end v from e)
select series_id, case when min(v) = max(v) then min(v) end padding, case when min(v) <> max(v) then 'the edges differ' end problem
from q join n using (series_id) where idx < 5 or idx >= n - 5 group by 1""")
def c11_edge_value(spark, d):
    return S.edge_value(series(spark, d).withColumn("v", F.when(F.col("v") > 60, 1.0).otherwise(0.0)))


@query("a5_wrap_transposed", """with w as (select cast(vec_id as varchar) series_id, embedding, unnest(range(0, 64)) i from embeddings)
select series_id, 1 / 5e-3 rate, cast(i % 32 as integer) as frame, cast(i // 32 as integer) part, cast(embedding[i + 1] as double) v from w""")
def a5_wrap_transposed(spark, d):
    """Two rows of 32 values, time on the second axis, as 32 frames of two components."""
    from phonoduct.runtime import table

    raw = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("series_id"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("x"))
    w = S.wrap_arrays(raw, "x", frame_second=0.005, time_axis=1).select("series_id", "rate", F.posexplode("array").alias("frame", "x"))
    return w.select("series_id", "rate", "frame", F.posexplode("x").alias("part", "v")).withColumn("v", F.col("v").cast("double"))


# ------------------------------------------------------------- alignment
_LEN = "k as (select series_id, count(*) na from a group by 1), m as (select series_id, count(*) nb from b group by 1)"


@query("d5_collect_min", f"with {SOURCES} select a.series_id, idx, a.v v0, b.v v1 from a join b using (series_id, idx)")
def d5_collect_min(spark, d):
    return _collect(spark, d, "min")


@query("d5_collect_max", f"with {SOURCES}, {_LEN} select series_id, idx, coalesce(a.v, 0) v0, coalesce(b.v, 0) v1 from a full join b using (series_id, idx) where series_id in (select series_id from k join m using (series_id))")
def d5_collect_max(spark, d):
    return _collect(spark, d, "max")


@query("d5_collect_first", f"with {SOURCES}, {_LEN} select a.series_id, idx, a.v v0, coalesce(b.v, 0) v1 from a left join b using (series_id, idx) where series_id in (select series_id from m)")
def d5_collect_first(spark, d):
    return _collect(spark, d, "first")


def _collect(spark, d, mode):
    c = S.collect([(source(spark, d, "view"), 100), (source(spark, d, "click"), 100)], 100, mode)
    return c.select("series_id", "idx", *[F.round(F.get("v", F.lit(i)).cast("double"), 2).alias(f"v{i}") for i in range(2)])


@query("d5_collect_parts", "with " + FRAMES + """,
b as (select series_id, idx // 3 idx, v from e where idx % 3 = 0),
m as (select series_id, coalesce(max(len(v)), 0) u from b group by 1),
x as (select e.series_id, e.idx, list_concat(list_transform(range(1, w + 1), lambda i: coalesce(e.v[i], 0)), list_transform(range(1, u + 1), lambda i: coalesce(b.v[i], 0))) v
  from e join n using (series_id) join m on m.series_id = e.series_id left join b on b.series_id = e.series_id and b.idx = e.idx)
select series_id, idx, """ + ", ".join(f"round(case when not isnan(v[{i + 1}]) then cast(cast(v[{i + 1}] as float) as double) end, 4) v{i}" for i in range(6)) + " from x")
def d5_collect_parts(spark, d):
    """Frames of one to three components beside every third of them, which ends early."""
    f = dense_frames(spark, d)
    third = f.where("idx % 3 = 0").withColumn("idx", F.floor(F.col("idx") / 3).cast("bigint"))
    c = S.collect([(f, 100), (third, 100)], 100, "max")
    return c.select("series_id", "idx", *_parts(6, 4))


@query("d5_length_spread", f"with {SOURCES}, {_LEN} select series_id, least(na, nb) shortest, greatest(na, nb) longest, abs(na - nb) / 1e2 as seconds from k join m using (series_id) where abs(na - nb) / 1e2 > 0.015")
def d5_length_spread(spark, d):
    return S.length_spread([source(spark, d, "view"), source(spark, d, "click")], 100, 0.015)


@query("d4_zip_by_position", f"""with {SOURCES}, x as (select distinct series_id from a), y as (select distinct series_id from b),
p as (select series_id left_key, row_number() over (order by series_id) - 1 pos from x), q as (select series_id right_key, row_number() over (order by series_id) - 1 pos from y)
select cast(pos as integer) pos, left_key, right_key from p join q using (pos)""")
def d4_zip_by_position(spark, d):
    z = S.zip_by_position(source(spark, d, "view"), source(spark, d, "click"), "series_id", "series_id", strict=False)
    return z.withColumn("pos", F.col("pos").cast("int"))


@query("c8_evenly_spaced", "with " + EVENTS + """, r as (select series_id, row_number() over (order by series_id) - 1 pos, count(*) over () c from n)
select series_id from r where c <= 7 or pos in (select cast(floor(k * ((c - 1) / 6e0)) as bigint) from (select distinct c from r), (select unnest(range(0, 7)) k))""")
def c8_evenly_spaced(spark, d):
    return S.evenly_spaced(series(spark, d), "series_id", 7)


# ------------------------------------------------------------- pitch
@query("b7_from_frequency", "with " + PITCH + " select series_id, idx, round(coalesce(lf0, 0), 6) lf0 from p")
def b7_from_frequency(spark, d):
    return f0.stored(pitch(spark, d)).select("series_id", "idx", *_r("lf0"))


@query("b8_fill_unvoiced", "with " + PITCH + """,
q as (select *, last_value(case when voiced then idx end ignore nulls) over w i, last_value(lf0 ignore nulls) over w a,
  first_value(case when voiced then idx end ignore nulls) over u j, first_value(lf0 ignore nulls) over u b from p
  window w as (partition by series_id order by idx rows between unbounded preceding and current row), u as (partition by series_id order by idx rows between current row and unbounded following))
select series_id, idx, voiced, round(case when i = j then a else coalesce(a + (b - a) * (idx - i) / (j - i), a, b) end, 6) lf0 from q""")
def b8_fill_unvoiced(spark, d):
    return f0.fill_unvoiced(pitch(spark, d), block=16).select("series_id", "idx", "voiced", *_r("lf0"))


@query("b12_voiced_hertz", "with " + PITCH + " select series_id, idx, round(exp(lf0), 6) hz from p where voiced")
def b12_voiced_hertz(spark, d):
    return f0.hertz(f0.loaded(f0.stored(pitch(spark, d)))).select("series_id", "idx", *_r("hz"))


@query("e1_statistics", "with " + PITCH + " select round(avg(lf0), 6) mean, round(var_pop(lf0), 6) var from p where voiced")
def e1_statistics(spark, d):
    return f0.statistics(pitch(spark, d)).select(*_r("mean", "var"))


@query("b10_convert", "with " + PITCH + ", s as (select avg(lf0) m, var_pop(lf0) v from p where voiced) select series_id, idx, voiced, round(0.25 / v * (lf0 - m) + 5, 6) lf0 from p, s")
def b10_convert(spark, d):
    p = pitch(spark, d)
    return f0.convert(p, f0.statistics(p), target_mean=5.0, target_var=0.25).select("series_id", "idx", "voiced", *_r("lf0"))


@query("b10_convert_with_vuv", "with " + PITCH + " select series_id, idx, voiced, round(0.25 / 0.5 * (coalesce(lf0, 0) - 4) + 5, 6) lf0 from p")
def b10_convert_with_vuv(spark, d):
    p = pitch(spark, d).withColumn("lf0", F.coalesce("lf0", F.lit(0.0)))
    return f0.convert(p, input_mean=4.0, input_var=0.5, target_mean=5.0, target_var=0.25, with_vuv=True).select("series_id", "idx", "voiced", *_r("lf0"))


@query("e2_percentiles", "with " + PITCH + """, q as (select quantile_cont(exp(lf0), [0, 0.001, 0.003, 0.005, 0.01, 0.99, 0.995, 0.997, 0.999, 1]) q from p where voiced)
select unnest([0e0, 0.1e0, 0.3e0, 0.5e0, 1e0, 99e0, 99.5e0, 99.7e0, 99.9e0, 100e0]) percent, cast(round_even(unnest(q), 0) as integer) hz from q""")
def e2_percentiles(spark, d):
    return f0.percentiles(pitch(spark, d))


@query("e7_log_statistics", "with " + PITCH + ", a as (select avg(lf0) a, median(lf0) b, stddev_pop(lf0) c, min(lf0) d, max(lf0) e, quantile_cont(lf0, [0.001, 0.003, 0.005, 0.01, 0.99, 0.995, 0.997, 0.999]) q from p where voiced) select round(a, 6) mean, round(b, 6) median, round(c, 6) std, round(d, 6) \"min\", round(e, 6) \"max\", " + ", ".join(f"round(q[{i + 1}], 6) {n}" for i, n in enumerate(f0.STATISTICS[5:])) + " from a")
def e7_log_statistics(spark, d):
    return f0.log_statistics(f0.voiced(pitch(spark, d))).select(*_r(*f0.STATISTICS))


_LS = ", ".join(f"round(q[{i + 1}] + 13e-8, 6) {n}" for i, n in enumerate(f0.STATISTICS[5:]))


@query("e7_speaker_days", f"""with f as (select distinct speaker_id, rec_day, series_id, idx, lf0 from f0_frames where lf0 between ln(20) and ln(2000)),
a as (select speaker_id, rec_day, avg(lf0) a, median(lf0) b, stddev_pop(lf0) c, min(lf0) d, max(lf0) e, quantile_cont(lf0, [0.001, 0.003, 0.005, 0.01, 0.99, 0.995, 0.997, 0.999]) q from f group by 1, 2)
select speaker_id, rec_day, round(a + 13e-8, 6) mean, round(b + 13e-8, 6) median, round(c + 13e-8, 6) std, round(d + 13e-8, 6) "min", round(e + 13e-8, 6) "max", {_LS} from a""")
def e7_speaker_days(spark, d):
    from phonoduct.runtime import table

    f = table(spark, d, "f0_frames").where(F.col("lf0").between(math.log(20), math.log(2000))).select("speaker_id", "rec_day", "series_id", "idx", "lf0").distinct()
    return f0.log_statistics(f, by=("speaker_id", "rec_day")).select("speaker_id", "rec_day", *[F.round(F.col(n) + 13e-8, 6).alias(n) for n in f0.STATISTICS])  # stored with 4 decimals, so that means end in ties


# ------------------------------------------------------------- range finding
@query("c2_drop_quiet", f"with {WEIGHTED} select hz, round(volume, 6) volume from w where volume >= (select max(volume) from w) - 45")
def c2_drop_quiet(spark, d):
    return f0.drop_quiet(weighted(spark, d)).select("hz", *_r("volume"))


@query("b22_unit_volume", f"with {WEIGHTED}, m as (select min(volume) a, max(volume) b from w) select hz, round((volume - a) / (b - a), 6) norm_volume from w, m")
def b22_unit_volume(spark, d):
    return f0.unit_volume(weighted(spark, d)).select("hz", *_r("norm_volume"))


_A, _B = (math.log(x) for x in f0.expand_in_logspace(20, 600, 0.05))
_VOTES = f"""with {WEIGHTED}, m as (select min(volume) a, max(volume) b from w),
u as (select hz, (volume - a) / (b - a) nv, least(cast(floor((ln(hz) - {_A!r}::double) / (({_B!r}::double - {_A!r}::double) / 99)) as integer), 98) bin from w, m),
h as (select bin, sum(nv) n from u where bin between 0 and 98 group by 1)"""


@query("c3_drop_low_votes", _VOTES + ", t as (select sum(n) t from h) select hz, round(nv, 6) norm_volume from u left join h on h.bin = least(u.bin + 1, 98), t where coalesce(n, 0) >= 0.003 * t")
def c3_drop_low_votes(spark, d):
    return f0.drop_low_votes(f0.unit_volume(weighted(spark, d)), floor=20, ceil=600).select("hz", *_r("norm_volume"))


@query("i11_histogram", _VOTES + " select bin, round(n, 6) n from h")
def i11_histogram(spark, d):
    return f0.histogram(f0.unit_volume(weighted(spark, d)), "hz", 20, 600, "norm_volume").select("bin", *_r("n"))


@query("i11_histogram_2d", _VOTES + " select bin, least(cast(floor(nv * 100) as integer), 99) volume_bin, count(*) n from u where bin between 0 and 98 group by 1, 2")
def i11_histogram_2d(spark, d):
    return f0.histogram_2d(f0.unit_volume(weighted(spark, d)), "hz", "norm_volume", 20, 600)


@query("e8_weighted_percentiles", f"""with {WEIGHTED}, m as (select min(volume) a, max(volume) b from w),
u as (select hz v, (volume - a) / (b - a) w from w, m),
c as (select v, row_number() over (order by v, w) r, sum(w) over (order by v, w rows unbounded preceding) c, lag(v) over (order by v, w) p from u),
k as (select *, coalesce(lag(c) over (order by r), 0) b, max(c) over () t from c),
q as (select unnest([0.1e0, 50e0, 99.9e0]) percent),
x as (select percent, percent / 100 * t t, min(r) r from k, q where c >= percent / 100 * t group by 1, 2)
select percent, round(case when p is null then v else p + (x.t - b) / (c - b) * (v - p) end, 6) "value" from x join k using (r)""")
def e8_weighted_percentiles(spark, d):
    return f0.weighted_percentiles(f0.unit_volume(weighted(spark, d)), "hz", "norm_volume", (0.1, 50, 99.9)).select("percent", *_r("value"))


@query("e10_duration_groups", "with recursive " + EVENTS + """,
f as (select series_id, n / 1e2 s, row_number() over (order by md5(series_id || '0'), series_id) k from n),
g as (select 0::bigint k, ''::varchar series_id, 0::bigint g, 0::double t union all
  select f.k, f.series_id, case when g.t > 5 then g.g + 1 else g.g end, case when g.t > 5 then 0 else g.t end + f.s from g join f on f.k = g.k + 1),
c as (select count(*) c from g where t > 5)
select series_id, cast(g as integer) grp from g, c where k > 0 and (c = 0 or g < c)""")
def e10_duration_groups(spark, d):
    files = events(spark, d).groupBy("series_id").agg((F.count(F.lit(1)) / 100).alias("seconds"))
    return f0.duration_groups(files, 5.0)
