"""Ranks, running sums and exact percentiles of whole tables or groups, without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.runtime import cut_lineage


def numbered(df: DataFrame, order: Sequence[str], weight: str | None = None, name: str = "before") -> tuple[DataFrame, int]:
    """(df with ``name``, total): how many rows (or how much of ``weight``) come before each row in the order of columns, and in all.

    Rows are cut into ranges, each summed for itself; only the ranges' sums, one row per partition, come to the driver. Rows
    that are equal in ``order`` are numbered in any order, so it should be a key.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    d = cut_lineage(df.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    sums = dict(d.groupBy("_part").agg(F.sum(w).alias("s")).collect())  # one row per partition
    bases, total = [], 0
    for part in sorted(sums):
        bases.append((part, total))
        total += sums[part] or 0
    base = F.broadcast(df.sparkSession.createDataFrame(bases, "_part int, _base bigint"))  # one row per partition
    so_far = F.coalesce(F.sum(w).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_before", so_far).join(base, "_part").withColumn(name, (F.col("_base") + F.col("_before")).cast("bigint")).drop("_part", "_before", "_base"), int(total)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, q array<double>): percentiles of the values that are not null or NaN, linear between neighbours, in the order of ``probs``.

    Values are first counted by cells of their sign and logarithm, which keep the order; only the cells that hold a wanted
    rank are then counted by value. So a group's values are never in one task, but counts of its cells are (4,096 an octave).
    Null keys form a group of their own; groups without values have no row.
    """
    v = F.col("v")
    cell = F.signum(v) * (F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-300))) * 4096) + 5_000_000)
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k0"))  # structs of nulls are equal
    d = df.select(key.alias("k"), (F.col(value) + 0.0).alias("v")).where("v is not null and not isnan(v)").withColumn("c", cell.cast("bigint"))
    cells = d.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("k", "c", "n", F.sum("n").over(Window.partitionBy("k").orderBy("c")).alias("to"), F.sum("n").over(Window.partitionBy("k")).alias("all"))
    at = (F.col("all") - 1) * F.col("p")
    wanted = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    ranks = cells.select("*", wanted).withColumn("r", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).where("r < to and r >= to - n")
    ranks = ranks.select("k", "c", "i", (F.col("r") - F.col("to") + F.col("n")).alias("into"), F.abs(at - F.col("r")).alias("off"))
    counted = d.join(ranks.select("k", "c").distinct(), ["k", "c"], "left_semi").groupBy("k", "c", "v").agg(F.count(F.lit(1)).alias("m"))
    counted = counted.withColumn("upto", F.sum("m").over(Window.partitionBy("k", "c").orderBy("v")))
    found = counted.join(ranks, ["k", "c"]).where("into < upto and into >= upto - m")
    # the neighbours of a rank weigh one minus their distance from it
    q = found.groupBy("k", "i").agg(F.sum(v * (1 - F.col("off"))).alias("q")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("s"))  # one per probability
    return q.select(*[F.col(f"k.k{i}").alias(k) for i, k in enumerate(keys)], F.col("s.q").alias("q"))
