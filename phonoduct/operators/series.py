"""Regularly sampled series in long form (series_id, idx, v) and packed form (series_id, rate, array).

Time is implied: frame idx of a series of rate r lies at idx / r seconds. v is a double unless said; framed,
resample_linear and collect also take arrays, a component at a time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.operators.ranks import numbered

KEY = "series_id"


class AlignmentError(ValueError):
    """Sources that should cover the same series don't, or differ too much in length."""


# ---------------------------------------------------------------- forms

def unpack(df: DataFrame, array: str = "samples", key: str = KEY) -> DataFrame:
    """Packed to long; null and empty arrays give no rows."""
    return df.select(F.col(key).alias(KEY), F.posexplode(array).alias("idx", "v")).withColumn("idx", F.col("idx").cast("bigint"))


def pack(df: DataFrame, value: str = "v") -> DataFrame:
    """Long to packed (series_id, samples), in order of idx. A packed series has to fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", value)))
    return df.groupBy(KEY).agg(ordered.alias("s")).select(KEY, F.col(f"s.{value}").alias("samples"))


def lengths(df: DataFrame) -> DataFrame:
    """(series_id, n): frames up to the last index."""
    return df.groupBy(KEY).agg((F.max("idx") + 1).alias("n"))


def has_parts(df: DataFrame) -> bool:
    """Whether frames are arrays of components."""
    return dict(df.dtypes)["v"].startswith("array")


def widths(df: DataFrame) -> DataFrame:
    """(series_id, width): most components of a frame."""
    return df.groupBy(KEY).agg(F.coalesce(F.max(F.when(F.col("v").isNotNull(), F.size("v"))), F.lit(0)).alias("width"))


def stem(path: Column) -> Column:
    """File name without folder and suffix, the identity of a series read from a file."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def wrap_arrays(df: DataFrame, array: str, rate: float | None = None, frame_second: float | None = None, time_axis: int = 0) -> DataFrame:
    """Give raw two-dimensional arrays a rate, with time moved to the first axis: (series_id, rate, array).

    Exactly one of ``rate`` and ``frame_second`` is needed.
    """
    if (rate is None) == (frame_second is None):
        raise ValueError("exactly one of rate and frame_second is needed")
    r = rate if rate is not None else 1 / frame_second
    a = F.col(array)
    if time_axis == 1:
        a = F.transform(F.sequence(F.lit(0), F.size(F.get(a, F.lit(0))) - 1), lambda j: F.transform(F.col(array), lambda row: F.get(row, j)))
    elif time_axis != 0:
        raise ValueError("time_axis is 0 or 1")
    return df.select(KEY, F.lit(float(r)).alias("rate"), a.alias("array"))


# ---------------------------------------------------------------- rates

Rate = float | DataFrame
"""Frames a second: one for all, or (series_id, rate) where series differ. Series without a finite positive rate have no time and give no frames."""


def with_rate(df: DataFrame, rate: Rate, name: str = "_rate") -> tuple[DataFrame, Column]:
    """(df, the rate of its rows as an expression)."""
    if not isinstance(rate, DataFrame):
        return df, F.lit(float(rate))
    r = F.col("rate").cast("double")
    sound = rate.where((r > 0) & (r < float("inf"))).groupBy(KEY).agg(F.min(r).alias(name))  # of several sound rates the smallest counts
    return df.join(sound, KEY), F.col(name)


def scaled(rate: Rate, change) -> Rate:
    """``change`` of a rate or of the rates of all series."""
    return rate.select(KEY, change(F.col("rate")).alias("rate")) if isinstance(rate, DataFrame) else change(rate)


# ---------------------------------------------------------------- resampling

def resample_nearest(df: DataFrame, source: Rate, target: float, index: int = 0, length: int | Column | None = None, phase: float = 0.0) -> DataFrame:
    """Frame k of the result is frame int((phase + index + k) * source / target); int(n / source * target) frames by default.

    Each source frame produces the result frames that show it, so no join with the result is needed. ``phase`` in [0, 1) is fixed
    for all series, which keeps results reproducible. ``length`` may be a column made of n and, where rates differ, _rate.
    """
    n, source = with_rate(lengths(df), source)
    shift = phase + index
    n = n.select(KEY, source.alias("_source"), F.lit(length).cast("bigint").alias("m") if length is not None else (F.col("n") / source * target).cast("bigint").alias("m"))
    source, step = F.col("_source"), F.col("_source") / F.lit(float(target))
    first = F.ceil(F.col("idx") / step - shift) - 1
    last = F.ceil((F.col("idx") + 1) / step - shift) + 1
    shown = F.filter(
        F.sequence(first.cast("bigint"), last.cast("bigint")),
        lambda k: (k >= 0) & (k < F.col("m")) & (((k + F.lit(shift)) * source / F.lit(target)).cast("bigint") == F.col("idx")),
    )
    return df.join(n, KEY).select(KEY, F.explode(shown).alias("k"), "v").withColumnRenamed("k", "idx")


def resample_linear(df: DataFrame, source: Rate, target: float, index: int = 0, length: int | None = None) -> DataFrame:
    """Values at (index + k) * source / target by linear interpolation, extrapolated beyond the last frame.

    A series of one frame stays constant. Components of an array are interpolated each for itself.
    """
    n, source = with_rate(lengths(df), source)
    n = n.select(KEY, "n", source.alias("_source"), F.lit(length).cast("bigint").alias("m") if length is not None else (F.col("n") / source * target).cast("bigint").alias("m"))
    source, step = F.col("_source"), F.col("_source") / F.lit(float(target))
    d = with_neighbours(df).withColumnRenamed("next", "w").drop("prev").join(n, KEY)
    d = d.where((F.col("idx") <= F.col("n") - 2) | (F.col("n") == 1))
    final = F.col("idx") >= F.col("n") - 2
    first = F.greatest(F.ceil(F.col("idx") / step - index).cast("bigint") - 1, F.lit(0))
    last = F.when(final, F.col("m") - 1).otherwise(F.least(F.ceil((F.col("idx") + 1) / step - index).cast("bigint") + 1, F.col("m") - 1))
    at = lambda k: (k + F.lit(index)) * source / F.lit(float(target))
    own = F.filter(F.when(last >= first, F.sequence(first, last)), lambda k: F.when(final, at(k) >= F.col("idx")).otherwise(F.floor(at(k)) == F.col("idx")))
    d = d.select(KEY, "idx", "v", "w", "_source", F.explode(own).alias("k"))
    between = lambda a, b: a + (at(F.col("k")) - F.col("idx")) * F.coalesce(b - a, F.lit(0.0))
    v = F.zip_with("v", F.coalesce("w", "v"), between) if has_parts(df) else between(F.col("v"), F.col("w"))
    return d.select(KEY, "k", v.alias("v")).withColumnRenamed("k", "idx")  # an alias idx would be meant within the lambda


# ---------------------------------------------------------------- splitting and padding

def split_points(keypoints: Sequence[float], rate: float) -> list[int]:
    return [int(s * rate) for s in keypoints]


def _edges(keypoints: Sequence[float], rate: Column) -> list[tuple[Column, Column | None]]:
    b = [(F.lit(float(s)) * rate).cast("bigint") for s in keypoints]
    return list(zip([F.lit(0).cast("bigint"), *b], [*b, None]))


def split(df: DataFrame, keypoints: Sequence[float], rate: Rate) -> DataFrame:
    """(series_id, segment, idx, v): frames between keypoints (seconds, truncated to frames); idx starts anew in each segment.

    Keypoints out of order give empty or overlapping segments, as slicing would.
    """
    d, r = with_rate(df, rate)
    inside = [F.when((F.col("idx") >= a) & (F.col("idx") < z if z is not None else F.lit(True)), F.struct(F.lit(i).alias("segment"), (F.col("idx") - a).alias("idx"))) for i, (a, z) in enumerate(_edges(keypoints, r))]
    return d.select(KEY, F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("s"), "v").select(KEY, "s.segment", "s.idx", "v")


def segment_lengths(df: DataFrame, keypoints: Sequence[float], rate: Rate) -> DataFrame:
    """(series_id, segment, n) of all segments, empty ones included."""
    d, r = with_rate(lengths(df), rate)
    n = F.col("n")
    sizes = [F.greatest(F.least(z, n) - F.least(a, n), F.lit(0)) if z is not None else F.greatest(n - a, F.lit(0)) for a, z in _edges(keypoints, r)]
    return d.select(KEY, F.posexplode(F.array(*[s.cast("bigint") for s in sizes])).alias("segment", "n"))


def all_same(df: DataFrame, by: Sequence[str] = (KEY,)) -> DataFrame:
    """(keys, same): whether all frames of a series, or of a segment, are equal."""
    return df.groupBy(*by).agg((F.min("v").eqNullSafe(F.max("v")) & (F.count("v") == F.count(F.lit(1)))).alias("same"))


def drop_constant(segments: DataFrame) -> DataFrame:
    """Segments without those whose frames are all equal; segment numbers stay."""
    keys = [KEY, "segment"]
    return segments.join(all_same(segments, keys).where("not same").select(*keys), keys, "left_semi")


def edge_value(df: DataFrame, frames: int = 5) -> DataFrame:
    """(series_id, padding, problem): the value that the first and last ``frames`` frames of a series share.

    Where they differ padding is null and problem says so.
    """
    edge = df.join(lengths(df), KEY).where((F.col("idx") < frames) | (F.col("idx") >= F.col("n") - frames))
    a = edge.groupBy(KEY).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return a.select(KEY, F.when(F.col("a") == F.col("b"), F.col("a")).alias("padding"), F.when(F.col("a") != F.col("b"), F.lit("the edges differ")).alias("problem"))


def pad_tail(df: DataFrame, padding: float | DataFrame, group: Sequence[str] = (), by: Sequence[str] = (KEY,)) -> DataFrame:
    """Frames with each series (``by``) padded at its end to the longest of its ``group``.

    ``padding`` is a value (for each component of array frames, as many as the series has), or a DataFrame (series_id, padding).
    """
    by, group = list(by), list(group)
    n = df.groupBy(*by).agg((F.max("idx") + 1).alias("n"))
    longest = n.groupBy(*group).agg(F.max("n").alias("top"))
    n = n.join(longest, group) if group else n.crossJoin(F.broadcast(longest))  # one row
    n = n.where("n < top")
    if isinstance(padding, DataFrame):
        n = n.join(padding.select(KEY, "padding"), KEY)
    elif has_parts(df):
        n = n.join(widths(df), KEY).withColumn("padding", F.array_repeat(F.lit(float(padding)), F.col("width")).cast(dict(df.dtypes)["v"]))
    else:
        n = n.withColumn("padding", F.lit(float(padding)))
    tail = n.select(*by, F.explode(F.sequence(F.col("n"), F.col("top") - 1)).alias("idx"), F.col("padding").alias("v"))
    return df.select(*by, "idx", "v").unionByName(tail)


def split_local(df: DataFrame, keypoints: Sequence[float], rate: Rate, padding: bool = False, remove_all_same: bool = False, name: str = "{stem}-{i}") -> DataFrame:
    """Split, drop constant segments, pad the rest to their series' longest with the value of the unsplit edges; adds the segment's name.

    ``name`` is made of {stem}, the series, and {i}, the segment; {suffix} is empty, as series have none.
    """
    s = split(df, keypoints, rate)
    if remove_all_same:
        s = drop_constant(s)
    if padding:
        s = pad_tail(s, edge_value(df), [KEY], [KEY, "segment"])
    return s.select(KEY, "segment", "idx", "v", segment_name(name).alias("name"))


def segment_name(name: str) -> Column:
    """The name of a row's segment by a format of {stem}, {i} and {suffix}."""
    pieces = re.split(r"(\{stem\}|\{i\}|\{suffix\})", name)
    if any("{" in x or "}" in x for x in pieces[::2]):
        raise ValueError("names are made of {stem}, {i} and {suffix}")
    return F.concat(*[{"{stem}": F.col(KEY), "{i}": F.col("segment").cast("string"), "{suffix}": F.lit("")}.get(x, F.lit(x)) for x in pieces])


# ---------------------------------------------------------------- framing

PADDING_MODES = ("constant", "edge", "reflect", "symmetric", "wrap")


def mirrored(t: Column, n: Column, mode: str) -> Column:
    """The frame of a series of n that stands at place t, also before 0 and from n on."""
    if mode == "edge":
        return F.least(F.greatest(t, F.lit(0)), n - 1)
    if mode == "wrap":
        return F.pmod(t, n)
    there_and_back = F.greatest(2 * (n - 1), F.lit(1)) if mode == "reflect" else 2 * n
    u = F.pmod(t, there_and_back)
    return F.when(u < n, u).otherwise(there_and_back - u - (0 if mode == "reflect" else 1))


def framed(df: DataFrame, frame_length: int, hop: int, centering: bool = False, padding_value: float | None = None, kinds: Sequence[str] = ("mean",), padding_mode: str = "constant") -> DataFrame:
    """(series_id, idx, one column per kind): min, max, mean or median of frames of ``frame_length`` every ``hop``.

    With ``centering`` both ends are padded by frame_length // 2 values first: ``padding_value`` or, by ``padding_mode``, the
    outermost frame (edge), frames mirrored at it (reflect) or before it (symmetric), or those of the other end (wrap). Incomplete frames at the end are
    dropped; a series shorter than a frame has none. Each value goes to the frames that hold it; partial
    aggregation adds them up before the shuffle. Of arrays each component is taken for itself and the columns are arrays.
    """
    if padding_mode not in PADDING_MODES:
        raise ValueError(f"padding_mode is one of {PADDING_MODES}")
    if centering and padding_value is None and padding_mode == "constant":
        raise ValueError("centering needs a padding value")
    pad = frame_length // 2 if centering else 0
    n = lengths(df)
    parts = has_parts(df)
    by = [KEY, "part"] if parts else [KEY]
    d = df.select(KEY, (F.col("idx") + pad).alias("j"), "v")
    if parts:
        w = widths(df)
        full = F.zip_with(F.coalesce("v", F.array().cast("array<double>")), F.array_repeat(F.lit(0), F.col("width")), lambda x, _: x.cast("double"))  # null where a component is missing
        d = d.join(w, KEY).select(KEY, "j", F.posexplode(full).alias("part", "v"))
        n = n.join(w.where("width > 0"), KEY).select(KEY, "n", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("part"))
    if pad:
        ends = F.concat(F.sequence(F.lit(0), F.lit(pad - 1)).cast("array<bigint>"), F.sequence(F.col("n") + pad, F.col("n") + 2 * pad - 1))
        ends = n.select(*by, "n", F.explode(ends).alias("j"))
        if padding_mode == "constant":
            ends = ends.withColumn("v", F.lit(float(padding_value)))
        else:
            ends = ends.withColumn("s", mirrored(F.col("j") - pad, F.col("n"), padding_mode) + pad).join(d.withColumnRenamed("j", "s"), [*by, "s"])
        d = d.unionByName(ends.select(*by, "j", "v"))
    count = F.floor((F.col("n") + 2 * pad - frame_length) / hop) + 1
    d = d.join(n.select(*by, count.cast("bigint").alias("count")), by)
    first = F.greatest(F.ceil((F.col("j") - frame_length + 1) / F.lit(hop)), F.lit(0)).cast("bigint")
    last = F.least(F.floor(F.col("j") / F.lit(hop)), F.col("count") - 1).cast("bigint")
    d = d.where(first <= last).select(*by, F.explode(F.sequence(first, last)).alias("idx"), "v")
    kind = {"min": F.min, "max": F.max, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5)}
    out = d.groupBy(*by, "idx").agg(*[kind[k]("v").alias(k) for k in kinds])
    if parts:
        out = out.groupBy(KEY, "idx").agg(F.array_sort(F.collect_list(F.struct("part", *kinds))).alias("s")).select(KEY, "idx", *[F.col(f"s.{k}").alias(k) for k in kinds])
    return out


# ---------------------------------------------------------------- alignment of sources

def check_same_keys(sources: Sequence[DataFrame], key: str = KEY) -> None:
    """Raise unless all sources hold the same series."""
    keys = [s.select(key).distinct() for s in sources]
    for i, k in enumerate(keys[1:], 1):
        odd = keys[0].join(k.withColumn("_in", F.lit(1)), key, "full_outer").join(keys[0].withColumn("_first", F.lit(1)), key, "left").where("_in is null or _first is null")
        names = [r[0] for r in odd.select(key).limit(5).collect()]  # for the message
        if names:
            raise AlignmentError(f"source {i} and source 0 differ in {key}: {names}")


def length_spread(sources: Sequence[DataFrame], rate: float, tolerance: float) -> DataFrame:
    """(series_id, shortest, longest, seconds) of series whose sources differ by more than ``tolerance`` seconds."""
    n = reduce(DataFrame.unionByName, [lengths(s) for s in sources])
    spread = n.groupBy(KEY).agg(F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return spread.withColumn("seconds", (F.col("longest") - F.col("shortest")) / F.lit(float(rate))).where(F.col("seconds") > tolerance)


def length_errors(sources: Sequence[tuple[DataFrame, Rate]], rate: float, tolerance: float) -> DataFrame:
    """Dead letters (series_id, error) of series whose sources, once resampled, differ in length by more than ``tolerance`` seconds."""
    n = []
    for d, r in sources:
        d, r = with_rate(lengths(d), r)
        n.append(d.select(KEY, (F.col("n") * rate / r).cast("bigint").alias("n")))
    common = reduce(lambda a, b: a.join(b, KEY, "left_semi"), n).select(KEY)
    spread = reduce(DataFrame.unionByName, n).groupBy(KEY).agg(((F.max("n") - F.min("n")) / F.lit(float(rate))).alias("s")).where(F.col("s") > tolerance)
    return spread.join(common, KEY, "left_semi").select(KEY, F.format_string(f"lengths differ by %.4f s, more than {tolerance}", "s").alias("error"))


def collect(sources: Sequence[tuple[DataFrame, Rate]], rate: float, mode: str = "min", error_time_length: float | None = None, keys: str = "inner", skip: DataFrame | None = None) -> DataFrame:
    """(series_id, idx, v array<float>): sources (frames, rate) resampled to one rate (nearest) and set side by side, all their components.

    ``mode`` is a policy of length: ``min`` ends with the shortest source, ``max`` pads with zeros to the longest, ``first``
    pads or cuts to the first. ``keys``: ``inner`` takes the series all sources hold, ``strict`` raises if they differ.
    With ``error_time_length`` it raises where lengths differ by more seconds. ``skip`` (series_id) leaves series out, as those of
    :func:`length_errors`.
    """
    if keys == "strict":
        check_same_keys([s for s, _ in sources])
    if skip is not None:
        sources = [(s.join(skip, KEY, "left_anti"), r) for s, r in sources]
    own = lambda r: F.col("_rate") if isinstance(r, DataFrame) else F.lit(float(r))
    parts = [resample_nearest(s, r, rate, length=F.col("n") * rate / own(r)) for s, r in sources]  # not n / r * rate, which loses the last of 29 frames at 100
    common = reduce(lambda a, b: a.join(b, KEY, "left_semi"), [p.select(KEY).distinct() for p in parts])
    if error_time_length is not None:
        odd = length_errors(sources, rate, error_time_length).limit(5).collect()
        if odd:
            raise AlignmentError(f"lengths differ by more than {error_time_length} s: {[r[0] for r in odd]}")
    how = {"min": "inner", "max": "full_outer", "first": "left"}[mode]
    out = parts[0].withColumnRenamed("v", "v0")
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumnRenamed("v", f"v{i}"), [KEY, "idx"], how)
    out = out.join(common, KEY, "left_semi")
    sides = []
    for i, p in enumerate(parts):
        if has_parts(p):
            out = out.join(widths(p).withColumnRenamed("width", f"w{i}"), KEY)
            sides.append(F.zip_with(F.coalesce(f"v{i}", F.array().cast(dict(p.dtypes)["v"])), F.array_repeat(F.lit(0.0), F.col(f"w{i}")), lambda x, zero: F.coalesce(x.cast("float"), zero.cast("float"))))
        else:
            sides.append(F.array(F.coalesce(F.col(f"v{i}").cast("float"), F.lit(0.0).cast("float"))))
    return out.select(KEY, "idx", F.concat(*sides).alias("v"))


def zip_by_position(left: DataFrame, right: DataFrame, left_key: str, right_key: str, strict: bool = True) -> DataFrame:
    """Pair the k-th smallest keys of two sources: (pos, left key, right key).

    A stand-in for file lists that are paired by order; joining by key is the better way. The lists hold one row per
    series, and ``strict`` raises where they differ in length.
    """
    (a, m), (b, n) = (numbered(d.select(F.col(k).alias(name)).distinct(), [name], name="pos") for d, k, name in ((left, left_key, "left_key"), (right, right_key, "right_key")))
    if strict and m != n:
        raise AlignmentError("the sources differ in number")
    return a.join(b, "pos").select("pos", "left_key", "right_key")


def evenly_spaced(keys: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` keys, evenly spaced in their order: those at int(linspace(0, n - 1, most))."""
    ranked, n = numbered(keys.select(key).distinct(), [key], name="pos")
    if n <= most:
        return ranked.select(key)
    step = (n - 1) / max(most - 1, 1)
    k = F.rint(F.col("pos") / F.lit(step))  # pos is int(k * step) only for this k or the next
    wanted = lambda k: (k <= most - 1) & (F.floor(k * F.lit(step)) == F.col("pos"))
    return ranked.where((wanted(k) | wanted(k + 1)) if most > 1 else F.col("pos") == 0).select(key)


# ---------------------------------------------------------------- neighbours of a frame, also in a very long series

BLOCK = 65_536


def _in_blocks(df: DataFrame, block: int) -> DataFrame:
    """Frames with block and own, plus one frame of each neighbouring block (own false)."""
    b = F.floor(F.col("idx") / F.lit(block)).cast("bigint")
    spots = F.array(F.struct(b.alias("block"), F.lit(True).alias("own")), F.when(F.pmod("idx", F.lit(block)) == block - 1, F.struct((b + 1).alias("block"), F.lit(False).alias("own"))), F.when((F.pmod("idx", F.lit(block)) == 0) & (F.col("idx") > 0), F.struct((b - 1).alias("block"), F.lit(False).alias("own"))))
    return df.select(*df.columns, F.explode(F.filter(spots, lambda s: s.isNotNull())).alias("_s")).select(*df.columns, "_s.block", "_s.own")


def with_neighbours(df: DataFrame, value: str = "v", block: int = BLOCK) -> DataFrame:
    """Add prev and next, the values of the adjacent frames (idx - 1 and idx + 1), null where there is none.

    Blocks of a series carry one frame of their neighbours, so a long series is spread over tasks.
    """
    w = Window.partitionBy(KEY, "block").orderBy("idx")
    d = _in_blocks(df, block).withColumns({
        "prev": F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag(value).over(w)),
        "next": F.when(F.lead("idx").over(w) == F.col("idx") + 1, F.lead(value).over(w)),
    })
    return d.where("own").drop("block", "own")


def with_nearest(df: DataFrame, known: Column, value: str, block: int = BLOCK) -> DataFrame:
    """Add before and after, structs (idx, v) of the nearest frames at or before, and at or after, each frame where ``known`` holds.

    Blocks pass their first and last known frame on through one row each.
    """
    here = F.when(known, F.struct("idx", F.col(value).alias("v")))
    d = df.withColumn("block", F.floor(F.col("idx") / F.lit(block)).cast("bigint")).withColumn("_h", here)
    ends = d.groupBy(KEY, "block").agg(F.max("_h").alias("z"), F.min("_h").alias("a"))
    w = Window.partitionBy(KEY).orderBy("block")
    ends = ends.select(KEY, "block", F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("z"), F.min("a").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("a"))
    v = Window.partitionBy(KEY, "block").orderBy("idx")
    d = d.join(ends, [KEY, "block"])
    before = F.coalesce(F.last("_h", True).over(v.rowsBetween(Window.unboundedPreceding, 0)), F.col("z"))
    after = F.coalesce(F.first("_h", True).over(v.rowsBetween(0, Window.unboundedFollowing)), F.col("a"))
    return d.withColumns({"before": before, "after": after}).drop("block", "_h", "z", "a")
