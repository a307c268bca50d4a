"""Label files: one "start end phoneme" line per label; and flag files of 0/1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoduct.operators import labels as L
from phonoduct.operators.series import stem
from phonoduct.sources.files import write_files


def _texts(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.text(glob, wholetext=True).select(stem(F.input_file_name()).alias(L.UTT), "value")


def read_labels(spark: SparkSession, glob: str, phoneme_type: str | None = None, verify: bool = True) -> DataFrame:
    """(utt_id, pos, phoneme, start_s, end_s); with a type, converted and (unless told otherwise) verified."""
    lines = _texts(spark, glob).select(L.UTT, F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    d = L.parse(lines)
    if phoneme_type:
        d = L.convert(d, phoneme_type)
        if verify:
            L.verify(d, phoneme_type)
    return d


def read_flags(spark: SparkSession, glob: str, name: str) -> DataFrame:
    """(utt_id, pos, <name> boolean)."""
    return L.parse_flags(_texts(spark, glob), name=name)


def write_labels(df: DataFrame, folder: str, phoneme_type: str | None = None) -> None:
    """Write each utterance as <utt_id>.lab; with a type, verified first."""
    if phoneme_type:
        L.verify(df, phoneme_type)
    write_files(L.as_text(df).select(F.concat(F.col(L.UTT), F.lit(".lab")).alias("name"), F.col("text").alias("content")), folder)
