"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoduct.llm.encode import decode, encode
from phonoduct.llm.packing import pack
from phonoduct.llm.runs import collapse_runs, with_duration
from phonoduct.llm.sketch import check_stored, digest_quantiles, digests, enclosure, merge_digests
from phonoduct.llm.spans import coverage, linked_passages, links, shared_blocks, shared_runs
from phonoduct.llm.splitting import cut_series, forced, pieces
from phonoduct.runtime import table

KEYS = ["speaker_id", "rec_day"]
READING = ["series_id", "idx"]
STATS = {"median": 0.5, "q001": 0.001, "q999": 0.999}
CAPACITY = 2048


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored pitch percentiles that their day's frames contradict."""
    return check_stored(table(spark, d, "f0_frames"), table(spark, d, "logf0_statistics"), KEYS, "lf0", READING, STATS)


def p3_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """The digest (nodes and counts) of each speaker and day, with the bounds of its median, q001 and q999."""
    q = digest_quantiles(digests(table(spark, d, "f0_frames"), KEYS, "lf0", READING), list(STATS.values()))
    at = [F.get(f"quantiles.{side}", F.lit(i)).alias(f"{s}_{side}") for i, s in enumerate(STATS) for side in ("low", "high")]
    return q.select(*KEYS, "n", "nodes", "counts", *at)


def p3_day_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the digests' bounds enclose the quantiles of each speaker and day within the rank error, by counting."""
    f = table(spark, d, "f0_frames")
    return enclosure(f, digest_quantiles(digests(f, KEYS, "lf0", READING), list(STATS.values())), KEYS, "lf0", READING)


def p3_speaker_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The same for each speaker, whose digest is merged from those of the days."""
    f = table(spark, d, "f0_frames")
    merged = merge_digests(digests(f, KEYS, "lf0", READING), ["speaker_id"])
    return enclosure(f.withColumn("series_id", F.concat_ws(" ", "series_id", "rec_day")), digest_quantiles(merged, list(STATS.values())), ["speaker_id"], "lf0", READING, levels=2)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal or nearly equal consecutive frames."""
    return collapse_runs(table(spark, d, "series_frames"), "series_id", "idx", "v").select("series_id", "first_idx", "n_frames")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """One event per run with its duration."""
    runs = with_duration(collapse_runs(table(spark, d, "series_frames"), "series_id", "idx", "v"), table(spark, d, "series_meta"))
    return runs.select("series_id", "first_idx", "n_frames", F.round("duration_s", 6).alias("duration_s"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Where arrays above the limit have no pause to be cut at."""
    return forced(cut_series(table(spark, d, "packed_series")))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 10 s that end in pauses and overlap by 0.5 s."""
    return pieces(cut_series(table(spark, d, "packed_series"))).select("series_id", "piece", "first_idx", "last_idx")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts decoded from their ids."""
    return decode(p6_ids(spark, d)).select("doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents, by tokens, in containers of 2,048."""
    sizes = encode(table(spark, d, "documents")).select("doc_id", F.size("ids").alias("n"))
    return pack(sizes, "doc_id", "n", CAPACITY)


def p7_filling(spark: SparkSession, d: str) -> DataFrame:
    """One row for the assignment of p7_containers: documents, and whether each is placed once and whole, no container is over its
    capacity, no document of at most that is divided, and at most 1 % more containers are used than their tokens need."""
    c = p7_containers(spark, d)
    docs = c.groupBy("doc_id").agg(F.sum("n_units").alias("n"), F.count(F.lit(1)).alias("parts"), (F.max("part") + 1).alias("last"), F.max(F.col("first_unit") + F.col("n_units")).alias("end"))
    loads = c.groupBy("container").agg(F.sum("n_units").alias("load"))
    need = F.ceil(F.sum("n") / CAPACITY)
    a = docs.agg(F.count(F.lit(1)).alias("documents"), F.min((F.col("parts") == F.col("last")) & (F.col("end") == F.col("n"))).alias("whole"), F.min((F.col("n") > CAPACITY) | (F.col("parts") == 1)).alias("undivided"), need.alias("need"))
    b = loads.agg((F.max("load") <= CAPACITY).alias("within"), F.count(F.lit(1)).alias("used"))
    return a.join(F.broadcast(b)).select("documents", "whole", "undivided", "within", (F.col("used") <= F.col("need") * 1.01 + 1).alias("tight"))  # one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document that other documents share in passages of at least 64."""
    return shared_runs(shared_blocks(table(spark, d, "documents")))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many characters of each document are shared, in how many spans."""
    return coverage(p8_found(spark, d))


def p8_links(spark: SparkSession, d: str) -> DataFrame:
    """Each passage of each class of equal texts with the first class that holds it: texts with the same holder and place share it."""
    return links(shared_blocks(table(spark, d, "documents")))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages chained over edits, of each class with the first holders of its blocks and of the steps between them."""
    return linked_passages(shared_blocks(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p3_found, p3_quantiles, p3_day_bounds, p3_speaker_bounds, p4_found, p4_runs, p5_found, p5_pieces, p6_ids, p6_round_trip, p7_containers, p7_filling, p8_found, p8_coverage, p8_links, p8_passages)}

_RUNS = """
with s as (select series_id, idx, min(v) v from series_frames group by 1, 2),
k as (select *, coalesce(v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is not null and not isnan(x))) = len(v), false) ok from s),
g as (select *, lag(v) over w pv, lag(idx) over w pi, lag(ok) over w po from k window w as (partition by series_id order by idx)),
h as (select *, ok and po and pi = idx - 1 and len(v) = len(pv)
  and coalesce(list_bool_and(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - pv[i]) <= 0.0025)), false) lk from g),
r as (select *, sum(case when lk then 0 else 1 end) over (partition by series_id order by idx rows unbounded preceding) run from h where ok),
runs as (select series_id, min(idx) first_idx, count(*) n_frames from r group by series_id, run having count(*) > 1)"""

_SHARED = """
with d as (select distinct doc_id, text from documents where length(text) >= 64),
w as (select doc_id, i, substring(text, cast(i + 1 as bigint), 64) s from (select doc_id, text, unnest(range(0, length(text) - 63)) i from d)),
m as (select s from w group by s having min(doc_id) <> max(doc_id)),
h as (select doc_id, i from w semi join m using (s)),
l as (select *, lag(i) over (partition by doc_id order by i) p from h),
g as (select *, sum(case when p is null or i > p + 64 then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) run from l),
spans as (select doc_id, min(i) first_char, max(i) + 63 last_char from g group by doc_id, run)"""

_BOUNDS = """
with f as (select distinct speaker_id, rec_day, series_id, idx, lf0 from f0_frames where lf0 between ln(20) and ln(2000)),
n as (select {0}, count(*) n from f group by all)
select {0}, p, n, true holds from n, (select unnest([0.5e0, 0.001e0, 0.999e0]) p)"""

SQL = {
    "p3_day_bounds": _BOUNDS.format("speaker_id, rec_day"),
    "p3_speaker_bounds": _BOUNDS.format("speaker_id"),
    "p3_found": """
with f as (select distinct speaker_id, rec_day, series_id, idx, lf0 from f0_frames where lf0 between ln(20) and ln(2000)),
q as (select speaker_id, rec_day, quantile_cont(lf0, [0.498, 0.502, 0.0, 0.003, 0.997, 1.0]) q from f group by 1, 2),
j as (select * from logf0_statistics join q using (speaker_id, rec_day))
select speaker_id, rec_day, 'median' as stat from j where median < q[1] or median > q[2]
union all select speaker_id, rec_day, 'q001' from j where q001 < q[3] or q001 > q[4]
union all select speaker_id, rec_day, 'q999' from j where q999 < q[5] or q999 > q[6]""",
    "p4_found": _RUNS + " select series_id, first_idx, n_frames from runs",
    "p4_runs": _RUNS
    + """, m as (select series_id, min(rate) rate from series_meta where rate > 0 and not isnan(rate) and not isinf(rate) group by 1)
select series_id, first_idx, n_frames, round(n_frames / rate, 6) duration_s from runs left join m using (series_id)""",
    "p5_found": """
with d as (select distinct series_id, rate, samples from packed_series where samples is not null),
u as (select series_id, rate, unnest(samples) x, generate_subscripts(samples, 1) - 1 i from d where len(samples) > 10 * rate),
n as (select series_id, any_value(rate) rate, count(*) n from u group by 1),
q as (select *, coalesce(not isnan(x) and abs(x) < 0.02::float, false) quiet from u),
r as (select *, i - row_number() over (partition by series_id, quiet order by i) g from q),
p as (select series_id, rate, min(i) a, max(i) b from r where quiet group by series_id, rate, g having count(*) >= 0.2 * rate - 1e-9),
e as (select * from p union all select series_id, rate, n, n from n union all select series_id, rate, -1, -1 from n),
s as (select series_id, rate, b + 1 f, lead(a) over (partition by series_id order by a, b) t from e),
l as (select series_id, f from s where t - f > 10 * rate)
select series_id, f as forced_from from l
union all select series_id, -1 from n where series_id not in (select series_id from l)""",
    "p5_pieces": """
with recursive d as (select distinct series_id, rate, samples from packed_series where samples is not null and len(samples) > 0),
k as (select *, row_number() over () r, len(samples) n, rate > 0 and rate * 10 >= 1 and rate < 1e8 ok from d),
u as (select r, rate, unnest(samples) x, generate_subscripts(samples, 1) - 1 i from k where ok),
q as (select *, coalesce(not isnan(x) and abs(x) < 0.02::float, false) quiet from u),
g as (select *, i - row_number() over (partition by r, quiet order by i) g from q),
p as (select r, min(i) a, max(i) b from g where quiet group by r, rate, g having count(*) >= greatest(ceil(0.2 * rate - 1e-9), 1)),
ps as (select r, list({'a': a, 'b': b}) ps from p group by r),
s as (select series_id, k.r, n, case when ok then cast(floor(rate * 10 + 1e-9) as bigint) else n end most, case when ok then cast(floor(rate * 0.5 + 1e-9) as bigint) else 0 end over_, coalesce(ps, []) ps from k left join ps using (r)),
t as (
  select series_id, r, n, most, over_, ps, -1 piece, 0::bigint f, 0::bigint e from s
  union all
  select series_id, r, n, most, over_, ps, piece + 1, case when piece < 0 then 0 else e - over_ end,
    case when e + reach >= n then n else coalesce(list_max(list_transform(list_filter(ps, lambda p: p.a <= e + reach - 1 and p.b >= e), lambda p: least(p.b, e + reach - 1))) + 1, e + reach) end
  from (select *, most - case when piece < 0 then 0 else over_ end reach from t where e < n))
select distinct series_id, piece, f as first_idx, e - 1 as last_idx from t where piece >= 0""",
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    "p7_filling": "select count(*) documents, true as whole, true as undivided, true as within, true as tight from documents",
    "p8_found": _SHARED + " select doc_id, first_char, last_char from spans",
    "p8_links": """
with d as (select min(doc_id) c, text from documents where length(text) >= 64 group by text),
w as (select c, i, substring(text, cast(i + 1 as bigint), 64) s from (select c, text, unnest(range(0, length(text) - 63)) i from d)),
m as (select s, min({'c': c, 'i': i}) h from w group by s having min(c) <> max(c)),
x as (select w.c, w.i, h.c o, h.i q from w join m using (s) where h.c < w.c),
g as (select *, i - row_number() over (partition by c, o, i - q order by i) g from x)
select c, min(i) first_char, max(i) + 63 last_char, o as holder, min(q) holder_first from g group by c, o, i - q, g""",
    "p8_coverage": _SHARED + " select doc_id, count(*) n_spans, cast(sum(last_char - first_char + 1) as bigint) shared_chars from spans group by doc_id",
}
