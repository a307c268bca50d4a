"""Queries of waves, levels and silence, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from phonoduct.operators import silence, waves as W
from phonoduct.plans.inputs import WAVES, waves

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(df, *names: str, keep=("series_id", "idx")):
    return df.select(*keep, *[F.round(n, 6).alias(n) for n in names])


@query("b1_gain", f"with {WAVES} select series_id, idx, round(v * {10 ** 0.3!r}::double, 6) v from x")
def b1_gain(spark, d):
    return _r(W.extract_wave(waves(spark, d), scale_db=6), "v")


@query("b2_clip", f"with {WAVES} select series_id, idx, round(least(greatest(v, -0.1e0), 0.2e0) / 0.2e0, 6) v from x")
def b2_clip(spark, d):
    return _r(W.extract_wave(waves(spark, d), clipping_range=(-0.1, 0.2)), "v")


@query("b3_normalise", f"with {WAVES}, p as (select series_id, max(abs(v)) p from x group by 1) select series_id, idx, round(v / (p * 0.999e0), 6) v from x join p using (series_id)")
def b3_normalise(spark, d):
    return _r(W.extract_wave(waves(spark, d), clipping_auto=True), "v")


@query("b4_out_of_range", f"with {WAVES} select series_id, round(min(v * 4), 6) low, round(max(v * 4), 6) high from x group by 1 having min(v * 4) < -1 or max(v * 4) > 1")
def b4_out_of_range(spark, d):
    return _r(W.out_of_range(W.calibrate(waves(spark, d), 4)), "low", "high", keep=("series_id",))


@query("b16_pre_emphasis", f"with {WAVES} select series_id, idx, round(v - 0.97e0 * coalesce(lag(v) over (partition by series_id order by idx), 0), 6) v from x")
def b16_pre_emphasis(spark, d):
    return _r(W.pre_emphasis(waves(spark, d), 0.97), "v")


@query("e3_extent", f'with {WAVES} select max(v) as "max", min(v) as "min" from x')
def e3_extent(spark, d):
    return W.extent(waves(spark, d))


@query("e12_peaks", f"with {WAVES} select series_id, round(max(abs(v)), 6) peak from x group by 1")
def e12_peaks(spark, d):
    return _r(W.peaks(waves(spark, d)), "peak", keep=("series_id",))


_RMS = f"""with {WAVES}, f as (select series_id, unnest(range(0, n // 4 + 1)) k from n),
r as (select f.series_id, k idx, sqrt(coalesce(sum(v * v), 0) / 16) rms from f left join x on f.series_id = x.series_id and x.idx >= k * 4 - 8 and x.idx < k * 4 + 8 group by 1, 2)"""


@query("f3_rms", _RMS + " select series_id, idx, round(rms, 6) rms from r")
def f3_rms(spark, d):
    return _r(W.framed_rms(waves(spark, d), 16, 4), "rms")


for _kind, _norm in [("rms_power", False), ("mse_power", False), ("rms_db", False), ("mse_db", False), ("mse_db", True)]:
    _v = "rms * rms" if _kind.startswith("mse") else "rms"
    _v = f"10 * log10(greatest({_v}, 1e-10))" if _kind.endswith("db") else _v
    _out = "greatest(v, t - 20)" if _kind.endswith("db") else "v"
    _out = f"least(greatest(({_out} - t) / 20e0 + 1, 0), 1)" if _norm else _out
    _sql = _RMS + f", a as (select series_id, idx, {_v} v from r), t as (select series_id, max(v) t from a group by 1) select series_id, idx, round({_out}, 6) v from a join t using (series_id)"

    def _volume(spark, d, kind=_kind, norm=_norm):
        return _r(W.volume(waves(spark, d), 100, 16, 4, 20, norm, kind), "v")

    query(f"i8_volume_{_kind}" + "_normalised" * _norm, _sql)(_volume)


@query("f4_amplitude_db", _RMS + " select series_id, idx, round(20 * log10(greatest(rms, 1e-5)), 6) db from r")
def f4_amplitude_db(spark, d):
    return _r(W.framed_rms(waves(spark, d), 16, 4).withColumn("db", W.amplitude_to_db(F.col("rms"))), "db")


_LOUD = f"""with {WAVES}, o as (select series_id, n, sum(n) over (order by series_id) - n o from n), t as (select sum(n) n from n),
g as (select series_id, idx, o + idx g, case when (o + idx) // 300 % 3 = 1 then 0 else v end v from x join o using (series_id)),
f as (select unnest(range(0, cast((select n from t) as bigint) // 8 + 1)) k),
b as (select g // 8 b, sum(v * v) e from g group by 1),
w as (select k, sum(e) / 32 p from f join b on b >= k - 2 and b < k + 2 group by 1),
d as (select k, 10 * log10(greatest(p, 1e-10)) db from w),
l as (select k from d where db - (select max(db) from d) > -20),
i as (select k, k - row_number() over (order by k) r from l),
j as (select min(k) * 8 s, least((max(k) + 1) * 8, (select n from t)) z from i group by r having min(k) * 8 < (select n from t))"""


def _gapped(spark, d):
    x = waves(spark, d)
    o = silence.offsets(x)
    quiet = F.floor((F.col("offset") + F.col("idx")) / F.lit(300)) % 3 == 1
    return x.join(o, "series_id").select("series_id", "idx", F.when(quiet, 0.0).otherwise(F.col("v")).alias("v"))


@query("e15_offsets", f"with {WAVES} select series_id, n, cast(sum(n) over (order by series_id) - n as bigint) as \"offset\" from n")
def e15_offsets(spark, d):
    return silence.offsets(waves(spark, d))


@query("f10_loud_intervals", _LOUD + ' select cast(s as bigint) as "start", cast(z as bigint) as "end" from j')
def f10_loud_intervals(spark, d):
    return silence.loud_intervals(_gapped(spark, d), 20, 32, 8)


@query("h6_silence", _LOUD + " select series_id, idx, g // 8 not in (select k from l) silent from g")
def h6_silence(spark, d):
    return silence.extract_silence(_gapped(spark, d), 20, 32, 8)


@query("h7_split_corpus", _LOUD + """,
q as (select s, z, case when s - lag(z) over (order by s) <= 45 then 0 else 1 end new from j),
c as (select min(s) s, max(z) z from (select *, sum(new) over (order by s) c from q) group by c),
p as (select greatest(s - 30, 0) s, least(z + 30, (select n from t) - 1) z from c),
e as (select s, z, unnest(list_concat([s], coalesce(list_sort(list(b)), []))) a from p left join (select o + n b from o) on b > s + 60 and b < z - 60 group by s, z),
m as (select a, coalesce(lead(a) over (partition by s, z order by a), z) b from e),
r as (select row_number() over (order by a, b) - 1 number, a, b from m)
select number, 'clip' || number || '.wav' as name, cast(a as bigint) as "start", cast(b as bigint) as "end" from r""")
def h7_split_corpus(spark, d):
    return silence.split_corpus(_gapped(spark, d), 100, 20, 0.45, 0.3, "clip", 32, 8, block=4096)
