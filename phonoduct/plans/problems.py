"""Queries of the general data-cleaning operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoduct.operators.anomalies import TAIL_DOWN, TAIL_UP, Limits, bad_rates, esd_frames, flag_frames
from phonoduct.operators.intervals import label_ticks, periods_and_gaps
from phonoduct.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous labelled periods of each utterance and the gaps between them."""
    return periods_and_gaps(label_ticks(table(spark, d, "phoneme_labels")), "utt_id", "s", "e")


#: Frames of a season: at the usual 200 frames a second, a tenth of one.
PERIOD = 20


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Bad frames of each pitch series, and idx -1 for series with a bad rate."""
    frames = flag_frames(table(spark, d, "f0_frames"), limits=Limits(alpha=0.05, period=PERIOD)).select("series_id", "idx")
    return frames.unionByName(bad_rates(table(spark, d, "series_meta")).select("series_id", F.lit(-1).cast("bigint").alias("idx")))


def p2_esd(spark: SparkSession, d: str) -> DataFrame:
    """Bad frames by the verdict of seasonal-trend decomposition and generalised ESD."""
    return esd_frames(table(spark, d, "f0_frames"), limits=Limits(alpha=0.05, period=PERIOD))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_esd": p2_esd}

_USABLE = """
with f as (select distinct series_id, idx, lf0 x from f0_frames where lf0 is not null),
a as (select *, (isnan(x) or isinf(x) or (x <> 0 and (x < ln(20) or x > ln(2000)))) imp from f),
fine as (select *, idx - row_number() over (partition by series_id order by idx) g from a where not imp and x <> 0),
w as (select *, count(*) over h c, max(x) over h - min(x) over h d from fine
  window h as (partition by series_id, g order by idx rows between current row and 19 following)),
s as (select *, max(case when c = 20 and d <= 0.00015 then 1 else 0 end) over (partition by series_id, g order by idx rows between 19 preceding and current row) st from w),"""

_Z = f"(t - ({TAIL_UP[0]}::double + t * ({TAIL_UP[1]}::double + t * {TAIL_UP[2]}::double)) / (1 + t * ({TAIL_DOWN[0]}::double + t * ({TAIL_DOWN[1]}::double + t * {TAIL_DOWN[2]}::double))))"

SQL = {
    "p1_found": """
with l as (
  select utt_id, cast(round_even(start_s * 10000, 0) as bigint) s, cast(round_even(end_s * 10000, 0) as bigint) e
  from phoneme_labels where utt_id is not null and trim(phoneme) <> '' and start_s is not null and end_s is not null),
v as (select distinct * from l where s < e),
m as (select *, max(e) over (partition by utt_id order by s, e rows between unbounded preceding and 1 preceding) r from v),
g as (select *, sum(case when r is null or s > r then 1 else 0 end) over (partition by utt_id order by s, e rows unbounded preceding) id from m),
p as (select utt_id, id, min(s) s, max(e) e from g group by 1, 2),
n as (select *, lead(s) over (partition by utt_id order by s) n from p)
select utt_id, 'period' as kind, s as start_t, e as end_t from n
union all select utt_id, 'gap', e, n from n where n is not null""",
    "p2_esd": _USABLE
    + f"""
u as (select series_id, idx, x, row_number() over (partition by series_id order by idx) r, count(*) over (partition by series_id) n from s where st = 0),
l as (select series_id, list(x order by idx) l from u group by 1),
b as (select series_id, idx, x - list_aggregate(l[greatest(least(r - 3, n - 6), 1) : greatest(least(r - 3, n - 6), 1) + 6], 'median') x from u join l using (series_id)),
p as (select series_id, idx % {PERIOD} h, median(x) m from b group by 1, 2),
c as (select b.series_id, idx, x - m x from b join p on b.series_id = p.series_id and idx % {PERIOD} = h),
m as (select series_id, median(x) m from c group by 1),
z as (select series_id, idx, x - m x, abs(x - m) d from c join m using (series_id)),
k as (select series_id, idx, x, count(*) over (partition by series_id) n, row_number() over o c, sum(x) over o s, sum(x * x) over o q from z
  window o as (partition by series_id order by d, idx rows unbounded preceding)),
e as (select *, n - c + 1 i, abs(x - s / c) v, sqrt(greatest(q - s * s / c, 0) / greatest(c - 1, 1)) sd, greatest(c - 2, 1)::double nu, sqrt(-2 * ln(least(0.05::double / (2 * c), 0.5))) t from k where c > n / 2),
g as (select *, {_Z} y from e),
j as (select *, y + (y ** 3 + y) / (4 * nu) + (5 * y ** 5 + 16 * y ** 3 + 3 * y) / (96 * nu * nu) tt from g),
h as (select series_id, max(i) many from j where v > (c - 1) * tt / sqrt((nu + tt * tt) * c) * sd and i <= greatest(n // 2, 1) and c > 2 group by 1)
select series_id, idx, 'fixed' as kind from a where imp union select series_id, idx, 'fixed' from s where st = 1
union select series_id, idx, 'spike' from j join h using (series_id) where i <= many""",
    "p2_found": _USABLE
    + """
u as (select series_id, idx, x, idx - row_number() over (partition by series_id order by idx) g from s where st = 0),
v as (select *, lag(x) over k p1, lead(x) over k n1, lead(x, 2) over k n2, lead(x, 3) over k n3 from u window k as (partition by series_id, g order by idx)),
m as (select series_id, median(abs(x - p1)) m from v where p1 is not null group by 1),
h as (
  select series_id, idx, greatest(x - greatest(p1, n1), least(p1, n1) - x) h from v where p1 is not null and n1 is not null
  union all
  select series_id, unnest([idx, idx + 1]), greatest(least(x, n1) - greatest(p1, n2), least(p1, n2) - greatest(x, n1))
  from v where p1 is not null and n1 is not null and n2 is not null
  union all
  select series_id, unnest([idx, idx + 1, idx + 2]), greatest(least(x, n1, n2) - greatest(p1, n3), least(p1, n3) - greatest(x, n1, n2))
  from v where p1 is not null and n1 is not null and n2 is not null and n3 is not null),
r as (select distinct series_id, tracker, rate from series_meta where feature = 'f0'),
c as (select tracker, rate, count(*) n from r where rate > 0 and not isnan(rate) and not isinf(rate) group by 1, 2),
o as (select tracker, arg_max(rate, n * 1e6 - rate) norm from c group by 1)
select series_id, idx from a where imp
union select series_id, idx from s where st = 1
union select series_id, idx from h join m using (series_id) where h > 13 * m and h > 0
union select series_id, cast(-1 as bigint) from r join o using (tracker) where isnan(rate) or abs(rate - norm) > 0.05 * norm""",
}
