"""Silence judged over a whole corpus, as if all waves were one, and the cutting of the corpus at silences.

Samples add up to energies of hops first, a table smaller by the hop; levels, runs and intervals are made on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoduct.operators.intervals import periods_and_gaps
from phonoduct.operators.ranks import numbered
from phonoduct.operators.series import KEY, lengths


def offsets(df: DataFrame) -> DataFrame:
    """(series_id, n, offset): where each series begins in the corpus in order of series_id.

    Ranges of ids are summed each for itself, so that no task sees all series.
    """
    return numbered(lengths(df), [KEY], "n", "offset")[0].select(KEY, "n", "offset")


def loud_frames(df: DataFrame, top_db: float = 60, frame_length: int = 2048, hop: int = 512, per_series: bool = False) -> DataFrame:
    """(series_id, k): frames of the corpus whose centred RMS lies less than ``top_db`` below its loudest frame.

    Series_id is "" unless ``per_series``, which judges each series by itself.
    """
    if (frame_length // 2) % hop:
        raise ValueError("half a frame must be a multiple of the hop")
    if per_series:
        d, total = df.select(KEY, F.col("idx").alias("g"), "v"), lengths(df)
    else:
        o = offsets(df)
        d = df.join(o, KEY).select(F.lit("").alias(KEY), (F.col("offset") + F.col("idx")).alias("g"), "v")
        total = o.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("").alias(KEY), "n")
    energy = d.groupBy(KEY, F.floor(F.col("g") / F.lit(hop)).alias("b")).agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    half, many = frame_length // 2 // hop, frame_length // hop
    frames = energy.join(total, KEY).select(KEY, "n", F.explode(F.sequence(F.col("b") + half - many + 1, F.col("b") + half)).alias("k"), "e")
    frames = frames.where((F.col("k") >= 0) & (F.col("k") <= F.floor((F.col("n") + 2 * (frame_length // 2) - frame_length) / F.lit(hop))))
    power = frames.groupBy(KEY, "k").agg((F.sum("e") / frame_length).alias("p"))
    top = power.groupBy(KEY).agg(F.max("p").alias("top"))
    db = lambda c: 10 * F.log10(F.greatest(F.col(c), F.lit(1e-10)))
    return power.join(top, KEY).where(db("p") - db("top") > -top_db).select(KEY, "k")


def loud_intervals(df: DataFrame, top_db: float = 60, frame_length: int = 2048, hop: int = 512) -> DataFrame:
    """(start, end): intervals of the corpus that are not silent, in samples, end excluded."""
    runs = periods_and_gaps(loud_frames(df, top_db, frame_length, hop).select(KEY, (F.col("k") * hop).alias("s"), ((F.col("k") + 1) * hop).alias("e")), KEY, "s", "e", bucket=1 << 26)
    total = lengths(df).agg(F.sum("n").alias("n"))
    return runs.where("kind = 'period'").crossJoin(F.broadcast(total)).select(F.col("start_t").alias("start"), F.least("end_t", "n").alias("end")).where("start < end")  # one row


def extract_silence(df: DataFrame, top_db: float = 60, frame_length: int = 2048, hop: int = 512) -> DataFrame:
    """(series_id, idx, silent) for each sample: whether the hop it lies in is loud is all that counts."""
    loud = loud_frames(df, top_db, frame_length, hop).select(F.col("k").alias("b"), F.lit(False).alias("silent"))
    d = df.join(offsets(df), KEY).select(KEY, "idx", F.floor((F.col("offset") + F.col("idx")) / F.lit(hop)).alias("b"))
    return d.join(loud, "b", "left").select(KEY, "idx", F.coalesce("silent", F.lit(True)).alias("silent"))


def split_corpus(df: DataFrame, sampling_rate: int, top_db: float = 60, min_silence: float = 0.45, pad: float = 0.3, prefix: str = "", frame_length: int = 2048, hop: int = 512, block: int = 1 << 26) -> DataFrame:
    """(number, name, start, end) of clips of the corpus: loud intervals no more than ``min_silence`` apart join, get ``pad``
    on both sides, and are cut where a series ends well inside (farther than twice the pad from both ends).

    Ends stop one sample before the corpus does; neighbouring clips may overlap.
    """
    gap, side = int(min_silence * sampling_rate), int(pad * sampling_rate)
    loud = loud_intervals(df, top_db, frame_length, hop).select(F.lit(0).alias("c"), "start", (F.col("end") + gap).alias("end"))
    o = offsets(df)
    total = o.agg(F.sum("n").alias("total"))
    clips = periods_and_gaps(loud, "c", "start", "end", bucket=block).where("kind = 'period'").crossJoin(F.broadcast(total))  # one row
    clips = clips.select(F.greatest(F.col("start_t") - side, F.lit(0)).alias("start"), F.least(F.col("end_t") - gap + side, F.col("total") - 1).alias("end"))
    ends = o.select((F.col("offset") + F.col("n")).alias("c")).withColumn("b", F.floor(F.col("c") / F.lit(block)))
    spread = clips.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / F.lit(block)), F.floor(F.col("end") / F.lit(block)))))
    cut = spread.join(ends, "b").where((F.col("c") > F.col("start") + 2 * side) & (F.col("c") < F.col("end") - 2 * side)).groupBy("start", "end").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    d = clips.join(cut, ["start", "end"], "left").withColumn("cs", F.coalesce("cs", F.expr("cast(array() as array<bigint>)")))
    d = d.select(F.explode(F.zip_with(F.concat(F.array("start"), "cs"), F.concat("cs", F.array("end")), lambda a, z: F.struct(a.alias("start"), z.alias("end")))).alias("s")).select("s.start", "s.end")
    return numbered(d, ["start", "end"], name="number")[0].select("number", F.concat(F.lit(prefix), F.col("number").cast("string"), F.lit(".wav")).alias("name"), "start", "end")
