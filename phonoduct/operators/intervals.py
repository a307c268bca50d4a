"""Continuous periods and gaps of overlapping intervals.

Each interval becomes a session of its own length (``session_window`` with a gap per row), so Spark
merges what overlaps. Sessions are made per key and time bucket, which splits a hot key; the
few rows that remain are joined across buckets with bucket summaries, so that no window ever
holds all intervals of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.runtime import cut_lineage

#: Ticks of a bucket; with 0.0001 s a tick, ten minutes.
BUCKET = 6_000_000


def label_ticks(labels: DataFrame, tick: float = 0.0001) -> DataFrame:
    """Labels that count, as integer ticks (utt_id, s, e).

    A label counts if start and end are finite, its rounded start is less than its rounded end and its
    phoneme is neither null nor blank. Labels without utt_id belong to no utterance and are dropped.
    """
    s, e = F.rint(F.col("start_s") / tick), F.rint(F.col("end_s") / tick)
    limit = 9e15
    return (
        labels.where(F.col("utt_id").isNotNull() & F.col("phoneme").rlike(r"(?U)\S"))
        .where((F.abs(s) < limit) & (F.abs(e) < limit))
        .select("utt_id", s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))
        .where("s < e")
    )


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """Merge the intervals of each key; return (key, kind, start_t, end_t) with kind ``period`` or ``gap``.

    ``start`` and ``end`` are bigint ticks. Touching intervals join. Repeated and tied rows change
    nothing; rows with a null key or bound, or with start >= end, don't count; an empty input gives an
    empty result. Other columns, also ones named like internal ones, are ignored.
    """
    i = df.select(F.col(key).alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    i = i.where("k is not null and s < e").withColumn("b", _bucket(F.col("s"), bucket))
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((e - s) as decimal(18, 0)) / 1000000)")
    merged = (
        i.groupBy("k", "b", F.session_window(F.expr("timestamp_micros(s)"), length).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("k", "b", F.unix_micros("w.start").alias("s"), F.unix_micros("w.end").alias("e"))
    )

    merged = cut_lineage(merged)  # few rows, read four times below

    # latest end of all buckets before this one
    by_bucket = Window.partitionBy("k").orderBy("b")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    reach = merged.groupBy("k", "b").agg(F.max("e").alias("top")).select("k", "b", F.max("top").over(before).alias("reach"))
    inside = Window.partitionBy("k", "b").orderBy("s", "e")
    reached = F.greatest(F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("reach"))
    opened = merged.join(reach, ["k", "b"]).withColumn("opens", F.when(reached.isNull() | (F.col("s") > reached), F.col("s")))
    opened = opened.withColumn("p", F.max("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    # rows before the first opening of a bucket go on with the last period opened in an earlier one
    last = opened.groupBy("k", "b").agg(F.max("opens").alias("o")).select("k", "b", F.max("o").over(before).alias("open"))
    periods = (
        opened.join(last, ["k", "b"])
        .groupBy("k", F.coalesce("p", "open").alias("s"))
        .agg(F.max("e").alias("e"))
        .withColumn("b", _bucket(F.col("s"), bucket))
    )
    nexts = periods.groupBy("k", "b").agg(F.min("s").alias("f")).select("k", "b", F.lead("f").over(by_bucket).alias("f"))
    follow = F.coalesce(F.lead("s").over(Window.partitionBy("k", "b").orderBy("s")), F.col("f"))
    return (
        periods.join(nexts, ["k", "b"])
        .withColumn("n", follow)
        .select(
            F.col("k").alias(key),
            F.inline(
                F.when(F.col("n").isNull(), F.array(_part("period", "s", "e"))).otherwise(
                    F.array(_part("period", "s", "e"), _part("gap", "e", "n"))
                )
            ),
        )
    )


def _bucket(s: Column, bucket: int) -> Column:
    return F.floor(s / F.lit(bucket)).cast("bigint")


def _part(kind: str, s: str, e: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col(s).alias("start_t"), F.col(e).alias("end_t"))
