"""Cut oversized arrays at natural boundaries, with overlap, by bounded-quantifier regular expressions.

Each array becomes a string of one symbol per item; the regex consumes at most the limit, its alternatives
ordered by the strength of the boundary they end at, with plain characters as the fallback. Everything is
a projection of one row: no shuffle but the one that drops repeated rows, and that holds pieces only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c < float("inf"))


def cut_series(df: DataFrame, key: str = "series_id", samples: str = "samples", rate: str = "rate", max_seconds: float = 10.0, overlap_seconds: float = 0.5, pause_level: float = 0.02, pause_seconds: float = 0.2) -> DataFrame:
    """One row per distinct array: key, n, limit, pieces, stretches.

    * ``limit`` is floor(max_seconds * rate) items. Without a finite rate that makes it at least 1 there is no
      limit (null) and the array comes out as one piece.
    * ``pieces``: array of (piece, first_idx, last_idx, in_pause). Each piece has at most ``limit`` items, begins
      floor(overlap_seconds * rate) items before the end of the one before, and ends in a pause where one
      lies in reach, else after ``limit`` items.
    * ``stretches``: array of (first_idx, n_items) between pauses and the array's ends; empty ones left out.

    A pause is a longest run of items with absolute value below ``pause_level`` (NaN and null are not) of at least
    pause_seconds * rate items. Null and empty arrays have no pieces and no stretches. Repeated rows come out
    once; rows with a null key are kept. Other columns are ignored.
    """
    r, x = F.col("r"), F.col("x")
    d = df.select(F.col(key).alias("k"), F.col(rate).cast("double").alias("r"), F.col(samples).alias("x"))
    # the tolerance keeps products like 0.2 * 15 = 3.0000000000000004 from asking for an item more
    count = lambda sec: F.floor(r * sec + 1e-9).cast("int")
    ok = _usable(r) & (r * max_seconds >= 1) & (r * max_seconds < 1e9)
    quiet = F.transform(x, lambda v: F.when(F.abs(v) < F.lit(pause_level).cast("float"), "q").otherwise("x"))
    d = d.select(
        "k",
        F.coalesce(F.size(x), F.lit(0)).alias("n"),
        F.when(ok, count(max_seconds)).alias("limit"),
        F.when(ok, count(overlap_seconds)).otherwise(0).alias("over"),
        F.when(ok, F.greatest(F.ceil(r * pause_seconds - 1e-9).cast("int"), F.lit(1))).alias("pause"),
        F.coalesce(F.array_join(quiet, ""), F.lit("")).alias("s"),
    ).withColumn("n", F.greatest("n", F.lit(0)))
    run = F.concat(F.lit("(q{"), F.col("pause"), F.lit(",})"))
    d = d.withColumn("gaps", F.when(F.col("pause").isNull(), F.array("s")).otherwise(F.split("s", run, -1)))
    d = d.withColumn("pauses", F.when(F.col("pause").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.regexp_extract_all("s", run, F.lit(1))))
    marked = F.zip_with("gaps", "pauses", lambda g, p: F.concat(g, F.repeat(F.lit("P"), F.coalesce(F.length(p), F.lit(0)))))
    d = d.withColumn("s", F.array_join(marked, ""))

    first, later = F.col("limit").cast("string"), (F.col("limit") - F.col("over")).cast("string")
    first1, later1 = (F.col("limit") - 1).cast("string"), (F.col("limit") - F.col("over") - 1).cast("string")
    # strongest first: the end of the array, a pause in reach, any item; the first piece reaches further, as it overlaps none
    pieces = F.concat(
        F.lit(r"(\A.{1,"), first, F.lit(r"}\z|.{1,"), later, F.lit(r"}\z|\A.{0,"), first1, F.lit("}P|.{0,"), later1,
        F.lit(r"}P|\A.{"), first, F.lit("}|.{"), later, F.lit("})"),
    )
    taken = F.when(F.col("limit").isNull(), F.filter(F.array("s"), lambda v: v != "")).otherwise(F.regexp_extract_all("s", pieces, F.lit(1)))
    ends = lambda c: F.aggregate(  # noqa: E731  running sums of lengths
        F.transform(c, F.length), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))
    )
    d = d.withColumn("taken", taken).withColumn("at", ends(F.col("taken")))
    d = d.withColumn(
        "pieces",
        F.transform(F.col("taken"), lambda t, i: F.struct(
            i.alias("piece"),
            F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("at"), i) - F.col("over")).cast("bigint").alias("first_idx"),
            (F.get(F.col("at"), i + 1) - 1).cast("bigint").alias("last_idx"),
            t.endswith("P").alias("in_pause"),
        )),
    )
    both = F.zip_with("gaps", "pauses", lambda g, p: F.struct(F.length(g).alias("g"), (F.length(g) + F.coalesce(F.length(p), F.lit(0))).alias("n")))
    d = d.withColumn("both", both).withColumn("from", F.aggregate("both", F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["n"]))))
    stretches = F.filter(F.transform("both", lambda b, i: F.struct(F.get(F.col("from"), i).cast("bigint").alias("first_idx"), b["g"].cast("bigint").alias("n_items"))), lambda v: v["n_items"] > 0)
    return d.select(F.col("k").alias(key), "n", "limit", "pieces", stretches.alias("stretches")).distinct()


def pieces(cut: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, piece, first_idx, last_idx, in_pause) of the rows of :func:`cut_series`."""
    return cut.select(key, F.inline("pieces"))


def forced(cut: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, forced_from): for each array above its limit, where stretches above the limit begin, or -1 if there are none."""
    long = F.transform(F.filter("stretches", lambda s: s["n_items"] > F.col("limit")), lambda s: s["first_idx"])
    return cut.where(F.col("n") > F.col("limit")).select(key, F.explode(F.when(F.size(long) > 0, long).otherwise(F.array(F.lit(-1).cast("bigint")))).alias("forced_from"))
