"""The tables read as series, pitch tracks, waves and labels, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoduct.functions.vocabularies import OPENJTALK
from phonoduct.operators import f0
from phonoduct.runtime import table


def events(spark: SparkSession, d: str) -> DataFrame:
    """One series per user: (series_id, idx, v, event_id, event_type), in order of time."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("series_id"), at.cast("bigint").alias("idx"), F.col("value").alias("v"), "event_id", "event_type")


EVENTS = """e as (select cast(user_id as varchar) series_id, row_number() over (partition by user_id order by ts, event_id) - 1 idx, value v, event_id, event_type from events),
n as (select series_id, count(*) n from e group by 1)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("series_id", "idx", "v")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of several components: (series_id, idx, v array<double>)."""
    return table(spark, d, "series_frames").select("series_id", "idx", "v")


def dense_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames that arrived, repeated ones once, numbered anew in order of idx."""
    f = frames(spark, d).groupBy("series_id", "idx").agg(F.min("v").alias("v"))
    return f.withColumn("idx", (F.row_number().over(Window.partitionBy("series_id").orderBy("idx")) - 1).cast("bigint"))


def rates(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, rate) as recorded; repeated, null and wrong ones too."""
    return table(spark, d, "series_meta").select("series_id", "rate")


FRAMES = """e as (select series_id, row_number() over (partition by series_id order by idx) - 1 idx, v from (select series_id, idx, min(v) v from series_frames group by 1, 2)),
n as (select series_id, count(*) n, coalesce(max(len(v)), 0) w from e group by 1)"""


def source(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The events of one type as a series per user."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("series_id"), at.cast("bigint").alias("idx"), F.col("value").alias("v"))


def _source_sql(name: str, kind: str) -> str:
    return f"{name} as (select cast(user_id as varchar) series_id, row_number() over (partition by user_id order by ts, event_id) - 1 idx, value v from events where event_type = '{kind}')"


SOURCES = _source_sql("a", "view") + ",\n" + _source_sql("b", "click")


def pitch(spark: SparkSession, d: str) -> DataFrame:
    """Values above 20 as Hz, others unvoiced."""
    return f0.from_frequency(series(spark, d).withColumn("hz", F.when(F.col("v") > 20, F.col("v")).otherwise(0.0)))


PITCH = EVENTS + ",\np as (select series_id, idx, case when v > 20 then ln(v) end lf0, v > 20 voiced from e)"


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """(hz, volume) of voiced frames; the volume depends on the event's number."""
    e = events(spark, d).where("v > 20")
    return e.select(F.col("v").alias("hz"), ((F.col("event_id") * 37 % 101) * 0.7 - 70).alias("volume"))


WEIGHTED = "w as (select value hz, (event_id * 37 % 101) * cast(0.7 as double) - 70 volume from events where value > 20)"


def waves(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as short waves."""
    e = table(spark, d, "embeddings").select(F.format_string("%08d", "vec_id").alias("series_id"), F.posexplode("embedding").alias("idx", "v"))
    return e.select("series_id", F.col("idx").cast("bigint").alias("idx"), F.col("v").cast("double").alias("v"))


WAVES = "x as (select printf('%08d', vec_id) series_id, unnest(range(0, len(embedding))) idx, cast(unnest(embedding) as double) v from embeddings),\nn as (select series_id, count(*) n from x group by 1)"


def labels(spark: SparkSession, d: str) -> DataFrame:
    """One utterance per user: each event a label whose phoneme and length come from its number."""
    size = F.col("event_id") % 20 + 1
    w = Window.partitionBy("series_id").orderBy("idx")
    e = events(spark, d).withColumn("d", size).withColumn("z", F.sum("d").over(w))
    phoneme = F.get(F.array(*[F.lit(p) for p in OPENJTALK]), (F.col("event_id") * 7 % len(OPENJTALK)).cast("int"))
    return e.select(F.col("series_id").alias("utt_id"), F.col("idx").cast("int").alias("pos"), phoneme.alias("phoneme"), ((F.col("z") - F.col("d")) / 100).alias("start_s"), (F.col("z") / 100).alias("end_s"))


_LIST = "[" + ", ".join(f"'{p}'" for p in OPENJTALK) + "]"
LABELS = EVENTS + f""",
g as (select *, event_id % 20 + 1 d, sum(event_id % 20 + 1) over (partition by series_id order by idx) z from e),
l as (select series_id utt_id, cast(idx as integer) pos, {_LIST}[event_id * 7 % {len(OPENJTALK)} + 1] phoneme, cast(z - d as double) / 100 start_s, cast(z as double) / 100 end_s from g)"""
