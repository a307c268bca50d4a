"""Queries of labels and their frame features, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phonoduct.functions.vocabularies import OPENJTALK, vocabulary_table
from phonoduct.operators import labels as L
from phonoduct.plans.inputs import _LIST, LABELS, labels
from phonoduct.runtime import table

QUERIES, SQL = {}, {}
N = len(OPENJTALK)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _spelled(spark, d):
    """Labels whose first and last phonemes, and some others, are spelled as silence."""
    x = labels(spark, d)
    last = x.groupBy("utt_id").agg(F.max("pos").alias("z"))
    name = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("z")), "silB").when(F.col("phoneme") == "a", "sil").when(F.col("phoneme") == "e", "br").otherwise(F.col("phoneme"))
    return x.join(last, "utt_id").withColumn("phoneme", name).drop("z")


_SPELLED = LABELS + """,
s as (select utt_id, pos, case when pos = 0 or pos = max(pos) over (partition by utt_id) then 'silB' when phoneme = 'a' then 'sil' when phoneme = 'e' then 'br' else phoneme end phoneme, start_s, end_s from l)"""


@query("a6_parse", "with " + LABELS + " select utt_id, pos, phoneme, start_s, end_s from l")
def a6_parse(spark, d):
    line = F.concat(F.lit("  "), F.format_string("%.2f", "start_s"), F.lit("\t"), F.format_string("%.2f", "end_s"), F.lit("  "), F.col("phoneme"))
    return L.parse(labels(spark, d).select("utt_id", "pos", line.alias("value")))


@query("a8_as_text", "with " + LABELS + " select utt_id, string_agg(printf('%.4f', start_s) || chr(9) || printf('%.4f', end_s) || chr(9) || phoneme, chr(10) order by pos) as text from l group by 1")
def a8_as_text(spark, d):
    return L.as_text(labels(spark, d))


@query("a11_violations", """with r as (select distinct utt_id, pos, phoneme, start_s, end_s from phoneme_labels),
c as (select *, lag(end_s) over w p, row_number() over w = 1 f, count(pos) over (partition by utt_id, pos) k from r
  window w as (partition by utt_id order by pos nulls last, start_s nulls last, end_s nulls last, phoneme nulls last)),
v as (select utt_id, pos, case when f and start_s <> 0 then 'the first label does not start at 0'
  when not coalesce(start_s < end_s, false) then 'the label does not end after its start'
  when not coalesce(phoneme in (""" + _LIST[1:-1] + """), false) then 'the phoneme is not in the vocabulary'
  when not f and not coalesce(p = start_s, false) then 'the label does not start where the one before ends' end problem from c
  union all select utt_id, pos, case when pos is null then 'the pos is null' when k > 1 then 'the pos is repeated' end from c)
select * from v where problem is not null""")
def a11_violations(spark, d):
    """Violations in all utterances, those with repeated or null pos too."""
    return L.violations(table(spark, d, "phoneme_labels").select("utt_id", "pos", "phoneme", "start_s", "end_s").distinct(), "openjtalk")


@query("a12_convert_edges", "with " + _SPELLED + " select utt_id, pos, case when phoneme = 'silB' then 'pau' else phoneme end phoneme from s")
def a12_convert_edges(spark, d):
    return L.convert(_spelled(spark, d), "openjtalk").select("utt_id", "pos", "phoneme")


@query("a13_convert_kiritan", "with " + _SPELLED + " select utt_id, pos, case when phoneme = 'br' then 'pau' else phoneme end phoneme from s")
def a13_convert_kiritan(spark, d):
    return L.convert(_spelled(spark, d), "kiritan").select("utt_id", "pos", "phoneme")


@query("a14_convert_song", "with " + _SPELLED + " select utt_id, pos, case when phoneme like 'sil%' then 'pau' else phoneme end phoneme from s")
def a14_convert_song(spark, d):
    return L.convert(_spelled(spark, d), "song").select("utt_id", "pos", "phoneme")


@query("a18_same_label", """with r as (select *, row_number() over (partition by utt_id, pos order by loaded_at desc nulls last, start_s nulls last, end_s nulls last, phoneme nulls last) k, count(*) over (partition by utt_id, pos) n from phoneme_labels where utt_id is not null and pos is not null),
a as (select * from r where k = 1), b as (select * from r where k = n)
select utt_id, a.pos, a.phoneme is not distinct from b.phoneme and round_even(a.start_s, 4) is not distinct from round_even(b.start_s, 4) and round_even(a.end_s, 4) is not distinct from round_even(b.end_s, 4) same
from a join b using (utt_id, pos)""")
def a18_same_label(spark, d):
    """The latest row of each label against the earliest that was loaded for it."""
    x = table(spark, d, "phoneme_labels").where("utt_id is not null and pos is not null")
    w = Window.partitionBy("utt_id", "pos")
    late = w.orderBy(F.desc_nulls_last("loaded_at"), *[F.asc_nulls_last(c) for c in ("start_s", "end_s", "phoneme")])
    x = x.withColumns({"k": F.row_number().over(late), "n": F.count(F.lit(1)).over(w)})
    b = x.where("k = n").select("utt_id", "pos", *[F.col(c).alias(f"b_{c}") for c in ("phoneme", "start_s", "end_s")])
    return x.where("k = 1").join(b, ["utt_id", "pos"]).select("utt_id", "pos", L.same_label("", "b_").alias("same"))


@query("h3b_vocabulary", f"with v as (select unnest({_LIST}) phoneme, unnest(range(0, {N})) id) select phoneme, cast(id as integer) phoneme_id, phoneme = 'pau' is_space from v")
def h3b_vocabulary(spark, d):
    return vocabulary_table(spark).where("phoneme_type = 'openjtalk'").select("phoneme", "phoneme_id", "is_space")


_CONTEXT = "with " + LABELS + f""", c as (select *, list_position({_LIST}, phoneme) - 1 id, end_s - start_s dur from l),
x as (select *, coalesce(lag(id) over w, 0) pre_id, coalesce(lead(id) over w, 0) post_id, coalesce(lag(dur) over w, 0) pre_dur, coalesce(lead(dur) over w, 0) post_dur from c window w as (partition by utt_id order by pos))"""


@query("f8_context", _CONTEXT + " select utt_id, pos, cast(id as integer) id, cast(pre_id as integer) pre_id, cast(post_id as integer) post_id, round(dur, 6) dur, round(pre_dur, 6) pre_dur, round(post_dur, 6) post_dur from x")
def f8_context(spark, d):
    c = L.with_context(labels(spark, d), "openjtalk")
    return c.select("utt_id", "pos", "id", "pre_id", "post_id", *[F.round(n, 6).alias(n) for n in ("dur", "pre_dur", "post_dur")])


_FRAMES = _CONTEXT + """,
y as (select *, cast(round_even(start_s * 20, 0) as bigint) a, cast(round_even(end_s * 20, 0) as bigint) z from x),
f as (select utt_id, pos, unnest(range(a, z + 1)) idx from y),
o as (select utt_id, idx, max(pos) pos from f group by 1, 2),
w as (select o.idx, y.* from o join y using (utt_id, pos))"""


@query("h3_frames", _FRAMES + " select utt_id, idx, cast(id as double) id, cast(pre_id as double) pre_id, round(dur, 4) dur, round(pre_dur, 4) pre_dur, round(post_dur, 4) post_dur, cast(pos % 2 as double) acc_a, cast(pos % 3 // 2 as double) acc_z, round(idx / 20e0 - start_s, 4) p_a, round(dur - (idx / 20e0 - start_s), 4) p_z from w")
def h3_frames(spark, d):
    x = labels(spark, d)
    a = x.select("utt_id", "pos", (F.col("pos") % 2 == 1).alias("start_accent"))
    z = x.select("utt_id", "pos", (F.col("pos") % 3 == 2).alias("end_accent"))
    f = L.frames(L.join_accents(x, a, z), [L.POSITION, L.PHONEME_ID, L.PRE_PHONEME, L.DURATION, L.PRE_DURATION, L.POST_DURATION, L.ACCENT], "openjtalk", 20)
    at = lambda i, n: F.round(F.get("v", F.lit(i)).cast("double") + 0.0, 4).alias(n)
    pre = (F.array_position(F.slice("v", 2, N), F.lit(1.0).cast("float")) - 1).cast("double").alias("pre_id")
    return f.select("utt_id", "idx", at(0, "id"), pre, *[at(N + 1 + i, n) for i, n in enumerate(["dur", "pre_dur", "post_dur", "acc_a", "acc_z", "p_a", "p_z"])])


@query("h3a_one_hot", _FRAMES + f" select utt_id, idx, cast({3 * N} as integer) width, cast(id as integer) hot, cast(pre_id + {N} as integer) hot_pre, cast(post_id + {2 * N} as integer) hot_post from w")
def h3a_one_hot(spark, d):
    f, _ = L.extract_phoneme(labels(spark, d), "openjtalk", 20, with_pre_post=True)
    hot = F.filter(F.transform("v", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return f.select("utt_id", "idx", F.size("v").alias("width"), *[F.get(hot, F.lit(i)).alias(n) for i, n in enumerate(["hot", "hot_pre", "hot_post"])])


@query("h3i_frame_counts", "with " + LABELS + " select utt_id, cast(round_even(max(end_s) * 20, 0) as bigint) + 1 n from l group by 1")
def h3i_frame_counts(spark, d):
    return L.frame_counts(labels(spark, d), 20)


_MASK = "with " + LABELS + """,
s as (select utt_id, cast(round_even(start_s * 10, 0) as bigint) a, cast(round_even(end_s * 10, 0) as bigint) z from l where phoneme <> 'pau' and pos % 5 <> 0),
m as (select utt_id, unnest(range(0, max(cast(round_even(end_s * 10, 0) as bigint)))) idx from l group by 1),
k as (select m.utt_id, m.idx, not exists (select 1 from s where s.utt_id = m.utt_id and m.idx between s.a and s.z) silent from m)"""


def _mask(spark, d):
    x = labels(spark, d)
    n = x.groupBy("utt_id").agg(L.to_index(F.max("end_s"), 10).alias("n"))
    spelled = x.withColumn("phoneme", F.when(F.col("pos") % 5 == 0, "pau").otherwise(F.col("phoneme")))
    return L.silence_from_phonemes(spelled, n, "openjtalk", 10)


@query("h5_silence_from_phonemes", _MASK + " select utt_id, idx, silent from k")
def h5_silence_from_phonemes(spark, d):
    return _mask(spark, d)


@query("f9_silence_runs", _MASK + ", i as (select *, idx - row_number() over (partition by utt_id order by idx) g from k where silent) select utt_id, min(idx) / 1e1 start_s, max(idx) / 1e1 end_s from i group by utt_id, g")
def f9_silence_runs(spark, d):
    return L.silence_runs(_mask(spark, d), 10)


@query("h4_expand_silence", _MASK.replace("with ", "with recursive ", 1) + """,
i as (select *, idx - row_number() over (partition by utt_id order by idx) g from k where silent),
r as (select utt_id, min(idx) / 1e1 s, max(idx) / 1e1 z from i group by utt_id, g),
y as (select utt_id, pos, case when pos % 5 = 0 then 'pau' else phoneme end phoneme, start_s, end_s from l),
p as (select utt_id, pos + 1 i, s, z, row_number() over (partition by utt_id order by s, pos) step from r join y using (utt_id) where phoneme = 'pau'),
f as (
  select utt_id, 0::bigint step, list(start_s order by pos) a, list(end_s order by pos) b, -1::double k, 0::double s, 0::double z from y group by 1
  union all
  select utt_id, step, case when right_in and i < len(b2) then a2[:i] || [z2] || a2[i + 2:] else a2 end, case when right_in then b2[:i - 1] || [z2] || b2[i + 1:] else b2 end, k, s2, z2
  from (select *, case when right_in and i < len(b2) then least(z1, b2[i + 1] - 0.03::double) else z1 end z2
    from (select *, s2 <= b2[i] and b2[i] < z1 right_in
      from (select *, case when left_in then a1[:i - 1] || [s2] || a1[i + 1:] else a1 end a2, case when left_in and i > 1 then b1[:i - 2] || [s2] || b1[i:] else b1 end b2
        from (select *, case when left_in and i > 1 then greatest(s1, a1[i - 1] + 0.03::double) else s1 end s2
          from (select *, s1 < a1[i] and a1[i] <= z1 left_in
            from (select f.utt_id, p.step, p.i, p.s k, f.a a1, f.b b1, case when f.k = p.s then f.s else p.s end s1, case when f.k = p.s then f.z else p.z end z1
              from f join p on p.utt_id = f.utt_id and p.step = f.step + 1))))))),
o as (select utt_id, arg_max(a, step) a, arg_max(b, step) b from f group by 1)
select utt_id, pos, phoneme, round_even(a[pos + 1], 4) start_s, round_even(b[pos + 1], 4) end_s from y join o using (utt_id)""")
def h4_expand_silence(spark, d):
    x = labels(spark, d).withColumn("phoneme", F.when(F.col("pos") % 5 == 0, "pau").otherwise(F.col("phoneme")))
    return L.expand_silence(x, L.silence_runs(_mask(spark, d), 10), "openjtalk")
