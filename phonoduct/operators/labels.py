"""Interval labels (utt_id, pos, phoneme, start_s, end_s) and the frame features made of them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from phonoduct.functions.vocabularies import SPACE, TYPES, one_hot, phoneme_id, vocabulary

UTT = "utt_id"


def _in_order() -> WindowSpec:
    return Window.partitionBy(UTT).orderBy("pos")


def _in_total_order() -> WindowSpec:
    """By pos, then time and phoneme, nulls last, so that labels of one pos have an order too."""
    return Window.partitionBy(UTT).orderBy(*[F.asc_nulls_last(c) for c in ("pos", "start_s", "end_s", "phoneme")])


class LabelError(ValueError):
    """Labels break a rule of their list."""


# ---------------------------------------------------------------- text form

def rounded(seconds: Column) -> Column:
    """Seconds to 4 decimals, half to even."""
    return F.bround(seconds, 4)


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """(utt_id, pos, phoneme, start_s, end_s) of lines (utt_id, pos, value) "start end phoneme", parted by white space; blank lines are skipped."""
    part = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    d = lines.where(F.col(line).rlike(r"\S"))
    return d.select(
        UTT, (F.row_number().over(_in_order()) - 1).alias("pos"), F.get(part, F.lit(2)).alias("phoneme"),
        rounded(F.get(part, F.lit(0)).cast("double")).alias("start_s"), rounded(F.get(part, F.lit(1)).cast("double")).alias("end_s"),
    )


def as_text(labels: DataFrame) -> DataFrame:
    """(utt_id, text): one line per label, start, end and phoneme parted by tabs, 4 decimals, no newline at the end."""
    line = F.format_string("%.4f\t%.4f\t%s", "start_s", "end_s", "phoneme")
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return labels.groupBy(UTT).agg(lines.alias("l")).select(UTT, F.array_join("l.line", "\n").alias("text"))


def convert(labels: DataFrame, phoneme_type: str) -> DataFrame:
    """Spell silence as the vocabulary does.

    Most types turn a first or last phoneme that contains "sil" into the space phoneme; kiritan turns each "br", song each
    that starts with "sil", into "pau"; dummy changes nothing.
    """
    if phoneme_type not in TYPES:
        raise ValueError(f"phoneme_type is one of {TYPES}")
    p = F.col("phoneme")
    if phoneme_type == "dummy":
        return labels
    if phoneme_type == "kiritan":
        return labels.withColumn("phoneme", F.when(p == "br", "pau").otherwise(p))
    if phoneme_type == "song":
        return labels.withColumn("phoneme", F.when(p.startswith("sil"), "pau").otherwise(p))
    ends = labels.groupBy(UTT).agg(F.min("pos").alias("_a"), F.max("pos").alias("_z"))
    edge = ((F.col("pos") == F.col("_a")) | (F.col("pos") == F.col("_z"))) & p.contains("sil")
    return labels.join(ends, UTT).withColumn("phoneme", F.when(edge, SPACE[phoneme_type]).otherwise(p)).drop("_a", "_z")


def violations(labels: DataFrame, phoneme_type: str) -> DataFrame:
    """(utt_id, pos, problem) of labels that break the rules: first start 0, start < end, known phoneme, end = next start.

    A label has one row with the first of these rules that it breaks. A pos that is null, or that other labels of the
    utterance have too, is a row of its own, so it hides no other problem. Labels follow each other by pos, start, end
    and phoneme, nulls last. Repeated rows count as repeated pos.
    """
    p = F.col("phoneme")
    known = F.lit(True) if phoneme_type == "dummy" else p.isin(vocabulary(phoneme_type))
    alone = F.lit(phoneme_type == "dummy")
    w = _in_total_order()
    last = F.lag("end_s").over(w)
    first = F.row_number().over(w) == 1
    problem = (
        F.when(first & (F.col("start_s") != 0), "the first label does not start at 0")
        .when(~alone & ~F.coalesce(F.col("start_s") < F.col("end_s"), F.lit(False)), "the label does not end after its start")
        .when(~alone & ~F.coalesce(known, F.lit(False)), "the phoneme is not in the vocabulary")
        .when(~first & ~F.coalesce(last == F.col("start_s"), F.lit(False)), "the label does not start where the one before ends")
    )
    place = F.when(F.col("pos").isNull(), "the pos is null").when((F.lag("pos").over(w) == F.col("pos")) | (F.lead("pos").over(w) == F.col("pos")), "the pos is repeated")
    return labels.select(UTT, "pos", F.array_compact(F.array(place, problem)).alias("p")).select(UTT, "pos", F.explode("p").alias("problem"))


def verify(labels: DataFrame, phoneme_type: str) -> DataFrame:
    """The labels, if none breaks a rule; else raises with the first."""
    odd = violations(labels, phoneme_type).orderBy(UTT, "pos").limit(5).collect()
    if odd:
        raise LabelError("; ".join(f"{r[0]} label {r[1]}: {r[2]}" for r in odd))
    return labels


def split_valid(labels: DataFrame, phoneme_type: str) -> tuple[DataFrame, DataFrame]:
    """(labels of sound utterances, dead letters (utt_id, error)), for runs that go on over errors."""
    dead = violations(labels, phoneme_type).groupBy(UTT).agg(F.min_by("problem", F.struct(F.col("pos").isNull(), "pos", "problem")).alias("error"))
    return labels.join(dead, UTT, "left_anti"), dead


def same_label(a: str, b: str) -> Column:
    """Whether labels with column prefixes ``a`` and ``b`` are equal after rounding; nulls are equal."""
    eq = F.col(f"{a}phoneme").eqNullSafe(F.col(f"{b}phoneme"))
    return eq & rounded(F.col(f"{a}start_s")).eqNullSafe(rounded(F.col(f"{b}start_s"))) & rounded(F.col(f"{a}end_s")).eqNullSafe(rounded(F.col(f"{b}end_s")))


def parse_flags(lines: DataFrame, text: str = "value", name: str = "accent") -> DataFrame:
    """(utt_id, pos, flag) of whitespace-parted 0/1 texts, one per utterance."""
    return lines.select(UTT, F.posexplode(F.filter(F.split(text, r"\s+"), lambda x: x != "")).alias("pos", "x")).select(UTT, "pos", (F.col("x").cast("int") != 0).alias(name))


# ---------------------------------------------------------------- frame features

PHONEME, PRE_PHONEME, POST_PHONEME = "PHONEME", "PRE_PHONEME", "POST_PHONEME"
PHONEME_ID, DURATION, PRE_DURATION, POST_DURATION = "PHONEME_ID", "PHONEME_DURATION", "PRE_PHONEME_DURATION", "POST_PHONEME_DURATION"
ACCENT, POSITION = "ACCENT", "POS_IN_PHONEME"
FEATURES = (PHONEME, PRE_PHONEME, POST_PHONEME, PHONEME_ID, DURATION, PRE_DURATION, POST_DURATION, ACCENT, POSITION)


def of_phoneme(feature: str) -> bool:
    """Whether a feature is constant within a label; all are but the position."""
    return feature != POSITION


def width(feature: str, phoneme_type: str) -> int:
    if feature in (PHONEME, PRE_PHONEME, POST_PHONEME):
        return len(vocabulary(phoneme_type))
    return 2 if feature in (ACCENT, POSITION) else 1


def total_width(features: Sequence[str], phoneme_type: str) -> int:
    return sum(width(f, phoneme_type) for f in features)


def to_index(seconds: Column, rate: float) -> Column:
    """Frame of a time, half to even."""
    return F.rint(seconds * F.lit(float(rate))).cast("bigint")


def to_time(index: Column, rate: float) -> Column:
    return index / F.lit(float(rate))


def frame_counts(labels: DataFrame, rate: float) -> DataFrame:
    """(utt_id, n): index of the last end, plus 1."""
    return labels.groupBy(UTT).agg((to_index(F.max_by("end_s", "pos"), rate) + 1).alias("n"))


def with_context(labels: DataFrame, phoneme_type: str) -> DataFrame:
    """Add ids and durations of each label and of those around it; beyond the edges stands a space of no length."""
    space = vocabulary(phoneme_type).index(SPACE[phoneme_type])
    d = labels.withColumns({"id": phoneme_id(F.col("phoneme"), phoneme_type), "dur": F.col("end_s") - F.col("start_s")})
    return d.withColumns({
        "pre_id": F.lag("id", 1, space).over(_in_order()), "post_id": F.lead("id", 1, space).over(_in_order()),
        "pre_dur": F.lag("dur", 1, 0.0).over(_in_order()), "post_dur": F.lead("dur", 1, 0.0).over(_in_order()),
    })


def join_accents(labels: DataFrame, start_accents: DataFrame, end_accents: DataFrame) -> DataFrame:
    """Labels with start_accent and end_accent; raises where an utterance's flags and labels differ in number."""
    j = labels.join(start_accents, [UTT, "pos"], "full_outer").join(end_accents, [UTT, "pos"], "full_outer")
    odd = j.where("phoneme is null or start_accent is null or end_accent is null").select(UTT).distinct().limit(5).collect()
    if odd:
        raise LabelError(f"accents and labels differ in number in {[r[0] for r in odd]}")
    return j


def frames(labels: DataFrame, features: Sequence[str], phoneme_type: str, rate: float) -> DataFrame:
    """(utt_id, idx, v array<float>): one row of features per frame.

    A label fills the frames from its start to its end, both included, and a later label takes the frame they share; as
    labels follow each other without gaps (:func:`verify`), each ends one frame before the next begins, and frames come
    from a sequence per label without another shuffle. Position columns always come last.
    """
    n = len(vocabulary(phoneme_type))
    c = {
        PHONEME: one_hot(F.col("id"), n), PRE_PHONEME: one_hot(F.col("pre_id"), n), POST_PHONEME: one_hot(F.col("post_id"), n),
        PHONEME_ID: F.array(F.col("id").cast("float")), DURATION: F.array(F.col("dur").cast("float")),
        PRE_DURATION: F.array(F.col("pre_dur").cast("float")), POST_DURATION: F.array(F.col("post_dur").cast("float")),
    }
    if ACCENT in features:
        c[ACCENT] = F.array(F.col("start_accent").cast("float"), F.col("end_accent").cast("float"))
    d = with_context(labels, phoneme_type)
    fixed = F.concat(*[c[f] for f in features if of_phoneme(f)]) if any(map(of_phoneme, features)) else F.expr("cast(array() as array<float>)")
    a, z = to_index(F.col("start_s"), rate), to_index(F.col("end_s"), rate)
    stop = F.coalesce(F.lead("_a").over(_in_order()) - 1, F.col("_z"))
    d = d.withColumns({"_a": a, "_z": z}).withColumns({"_stop": stop, "_v": fixed}).where(F.col("_stop") >= F.col("_a"))
    d = d.select(UTT, "start_s", "dur", "_v", F.explode(F.sequence("_a", "_stop")).alias("idx"))
    if POSITION in features:
        into = to_time(F.col("idx"), rate) - F.col("start_s")
        d = d.withColumn("_v", F.concat("_v", F.array(into.cast("float"), (F.col("dur") - into).cast("float"))))
    return d.select(UTT, "idx", F.col("_v").alias("v"))


def feature_types(with_phoneme_id: bool = False, with_pre_post: bool = False, with_duration: bool = False, with_relative_pos: bool = False, with_accent: bool = False) -> list[str]:
    out = [PHONEME_ID if with_phoneme_id else PHONEME]
    out += [PRE_PHONEME, POST_PHONEME] * with_pre_post + [DURATION] * with_duration
    out += [PRE_DURATION, POST_DURATION] * (with_duration and with_pre_post) + [POSITION] * with_relative_pos + [ACCENT] * with_accent
    return out


def extract_phoneme(labels: DataFrame, phoneme_type: str = "seg_kit", rate: float = 100, start_accents: DataFrame | None = None, end_accents: DataFrame | None = None, ignore_error: bool = False, **flags: bool) -> tuple[DataFrame, DataFrame | None]:
    """Convert, verify and expand labels to frames; with ``ignore_error`` also returns the dead letters (utt_id, error)."""
    d, dead = convert(labels, phoneme_type), None
    if ignore_error:
        d, dead = split_valid(d, phoneme_type)
    else:
        verify(d, phoneme_type)
    if (start_accents is None) != (end_accents is None):
        raise ValueError("give both start and end accents, or neither")
    if start_accents is not None:
        d = join_accents(d, start_accents, end_accents)
    return frames(d, feature_types(with_accent=start_accents is not None, **flags), phoneme_type, rate), dead


# ---------------------------------------------------------------- silence

def silence_from_phonemes(labels: DataFrame, lengths: DataFrame, phoneme_type: str, sampling_rate: float | None = None) -> DataFrame:
    """(utt_id, idx, silent): False from round(start * rate) to round(end * rate), both included, of labels that are no space.

    ``lengths`` (utt_id, n) has the samples of each wave, and where no one rate is given its rate. Labels mark samples once, then
    an anti-join leaves the silent ones.
    """
    sound = labels.where(F.col("phoneme") != SPACE[phoneme_type])
    if sampling_rate is None:
        sound = sound.join(lengths.select(UTT, "rate"), UTT)
    r = F.col("rate") if sampling_rate is None else F.lit(float(sampling_rate))
    a, z = (F.rint(F.col(x) * r).cast("bigint") for x in ("start_s", "end_s"))
    loud = sound.where(z >= a).select(UTT, F.explode(F.sequence(a, z)).alias("idx")).distinct().withColumn("silent", F.lit(False))
    every = lengths.where("n > 0").select(UTT, F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"))).alias("idx"))
    return every.join(loud, [UTT, "idx"], "left").select(UTT, "idx", F.coalesce("silent", F.lit(True)).alias("silent"))


def silence_runs(mask: DataFrame, rate: float | DataFrame, key: str = UTT) -> DataFrame:
    """(key, start_s, end_s): runs of silent frames; end is the time of the last silent frame. ``rate`` is one, or (key, rate)."""
    d = mask.where("silent").select(key, "idx")
    island = F.col("idx") - F.row_number().over(Window.partitionBy(key, F.floor(F.col("idx") / 65_536)).orderBy("idx"))
    part = d.withColumn("g", island).groupBy(key, F.floor(F.col("idx") / 65_536).alias("b"), "g").agg(F.min("idx").alias("a"), F.max("idx").alias("z"))
    w = Window.partitionBy(key).orderBy("a")  # one row per run and block
    part = part.withColumn("new", F.when(F.lag("z").over(w) == F.col("a") - 1, 0).otherwise(1))
    part = part.withColumn("run", F.sum("new").over(w))
    runs = part.groupBy(key, "run").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    runs = runs.join(rate.select(key, "rate"), key) if isinstance(rate, DataFrame) else runs.withColumn("rate", F.lit(float(rate)))
    return runs.select(key, (F.col("a") / F.col("rate")).alias("start_s"), (F.col("z") / F.col("rate")).alias("end_s"))


def move_sides(sides: list[float], spaces: Iterable[int], silences: Iterable[tuple[float, float]], minimum: float) -> list[float]:
    """The sides of labels (label i lies from side i to side i + 1), those of ``spaces`` moved out to the silences they lie in.

    A left side moves back to its silence's start, but stays ``minimum`` after the side before it; a right side moves on
    to its silence's end, but stays ``minimum`` before the side after it. Where a side had to stay, the silence ends
    there for the spaces after it. Spaces and silences, which lie apart, are in order of time, so one walk meets each silence
    next to the few sides it can hold.
    """
    at, quiet, passed = list(sides), [list(q) for q in silences], 0
    for i in spaces:
        while passed < len(quiet) and quiet[passed][1] < at[i]:
            passed += 1
        j = passed
        while j < len(quiet) and quiet[j][0] <= max(at[i], at[i + 1]):
            q = quiet[j]
            if q[0] < at[i] <= q[1]:
                at[i] = q[0] = q[0] if i == 0 else max(q[0], at[i - 1] + minimum)
            if q[0] <= at[i + 1] < q[1]:
                at[i + 1] = q[1] = q[1] if i + 2 == len(at) else min(q[1], at[i + 2] - minimum)
            j += 1
    return at


def stretch(labels: list[tuple[str, float, float]], silences: list[tuple[float, float]], space: str, minimum: float) -> list[tuple[str, float, float]]:
    """:func:`move_sides` for one list of labels (phoneme, start, end) that follow each other without gaps."""
    if not labels:
        return []
    at = move_sides([labels[0][1], *(x[2] for x in labels)], [i for i, x in enumerate(labels) if x[0] == space], silences, minimum)
    return [(x[0], a, z) for x, a, z in zip(labels, at, at[1:])]


def expand_silence(labels: DataFrame, silences: DataFrame, phoneme_type: str = "seg_kit", minimum: float = 0.03) -> DataFrame:
    """Labels with their spaces moved to the silences (utt_id, start_s, end_s) of :func:`silence_runs`, converted before.

    Labels follow each other without gaps, as :func:`verify` makes sure. The order of the moves matters, so each utterance
    is walked as one list of sides; all else are expressions.
    """
    d = convert(labels, phoneme_type).groupBy(UTT).agg(F.array_sort(F.collect_list(F.struct("pos", "phoneme", "start_s", "end_s"))).alias("l"))
    s = silences.groupBy(UTT).agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("s"))
    spaces = F.filter(F.transform("l.phoneme", lambda p, i: F.when(p == SPACE[phoneme_type], i)), lambda i: i.isNotNull())
    d = d.join(s, UTT, "left").select(UTT, "l", F.concat(F.slice("l.start_s", 1, 1), "l.end_s").alias("sides"), spaces.alias("spaces"), F.col("s.start_s").alias("a"), F.col("s.end_s").alias("z"))

    @F.pandas_udf("array<double>")
    def moved(sides: pd.Series, spaces: pd.Series, a: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([move_sides(x, p, () if b is None else zip(b, e), minimum) for x, p, b, e in zip(sides, spaces, a, z)], dtype=object)

    at = F.when(F.size("spaces") == 0, F.col("sides")).otherwise(moved("sides", "spaces", "a", "z"))
    d = d.select(UTT, "l", F.transform(at, rounded).alias("at"))
    label = F.transform("l", lambda x, i: F.struct(x["pos"].alias("pos"), x["phoneme"].alias("phoneme"), F.get(F.col("at"), i).alias("start_s"), F.get(F.col("at"), i + 1).alias("end_s")))
    return d.select(UTT, F.inline(label))
