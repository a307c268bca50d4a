import numpy as np
import pytest

from phonoduct.functions.vocabularies import SPACE, VOCABULARIES
from phonoduct.operators import labels as L
from phonoduct.operators.labels import LabelError

SCHEMA = "utt_id string, pos int, phoneme string, start_s double, end_s double"
WORD = [("u", 0, "silB", 0.0, 0.25), ("u", 1, "k", 0.25, 0.5), ("u", 2, "o", 0.5, 0.9), ("u", 3, "silE", 0.9, 1.0)]


def word(spark, data=WORD):
    return spark.createDataFrame(data, SCHEMA)


def test_vocabularies():
    assert {k: len(v) for k, v in VOCABULARIES.items()} == {"seg_kit": 41, "jvs": 39, "openjtalk": 45, "rohan": 46, "kiritan": 35, "song": 49}
    assert all(len(set(v)) == len(v) and SPACE[k] in v for k, v in VOCABULARIES.items())


@pytest.mark.parametrize(("kind", "want"), [("openjtalk", ["pau", "k", "o", "pau"]), ("seg_kit", ["sp", "k", "o", "sp"]), ("song", ["pau", "k", "o", "pau"]), ("kiritan", ["silB", "k", "o", "silE"]), ("dummy", ["silB", "k", "o", "silE"])])
def test_conversion(spark, kind, want):
    assert [r.phoneme for r in L.convert(word(spark), kind).orderBy("pos").collect()] == want


def test_rules(spark):
    bad = [("a", 0, "k", 0.1, 0.2), ("b", 0, "k", 0.0, 0.0), ("c", 0, "?", 0.0, 0.1), ("d", 0, "k", 0.0, 0.1), ("d", 1, "k", 0.2, 0.3)]
    got = {(r.utt_id, r.pos): r.problem for r in L.violations(word(spark, bad), "openjtalk").collect()}
    assert set(got) == {("a", 0), ("b", 0), ("c", 0), ("d", 1)}
    with pytest.raises(LabelError):
        L.verify(word(spark, bad), "openjtalk")
    sound, dead = L.split_valid(word(spark, bad + [("e", 0, "k", 0.0, 1.0)]), "openjtalk")
    assert [r.utt_id for r in sound.collect()] == ["e"] and dead.count() == 4
    assert L.violations(word(spark, [("d", 0, "?", 0.0, 0.1)]), "dummy").count() == 0


def test_rules_hold_for_repeated_and_null_pos(spark, rows):
    bad = [("a", 0, "k", 0.0, 0.2), ("a", 1, "?", 0.2, 0.3), ("a", 1, "o", 0.3, 0.3), ("a", 2, "o", 0.3, 0.4), ("a", None, "k", 0.5, 0.6), ("b", None, "k", 0.0, 0.1), ("c", 0, "k", 0.0, 0.1)]
    repeated, null = "the pos is repeated", "the pos is null"
    want = [("a", 1, repeated), ("a", 1, repeated), ("a", 1, "the phoneme is not in the vocabulary"), ("a", 1, "the label does not end after its start"), ("a", None, null), ("a", None, "the label does not start where the one before ends"), ("b", None, null)]
    assert rows(L.violations(word(spark, bad), "openjtalk")) == sorted(want, key=repr)
    sound, dead = L.split_valid(word(spark, bad), "openjtalk")
    assert [r.utt_id for r in sound.collect()] == ["c"] and {r.utt_id: r.error for r in dead.collect()} == {"a": "the label does not end after its start", "b": null}


def numpy_frames(data, rate, vocabulary):
    n = int(round(data[-1][4] * rate)) + 1
    out = np.zeros(n)
    for _, _, p, s, e in data:
        out[int(np.rint(s * rate)) : int(np.rint(e * rate)) + 1] = vocabulary.index(p)
    return list(out)


def test_later_labels_take_shared_frames(spark):
    d = L.convert(word(spark), "openjtalk")
    f, _ = L.extract_phoneme(word(spark), "openjtalk", 10, with_phoneme_id=True)
    got = [r.v[0] for r in f.orderBy("idx").collect()]
    assert got == numpy_frames([tuple(r) for r in d.select("utt_id", "pos", "phoneme", "start_s", "end_s").orderBy("pos").collect()], 10, VOCABULARIES["openjtalk"])


@pytest.mark.parametrize("bits", range(16))
def test_feature_grid_has_the_announced_width(spark, bits):
    flags = dict(zip(("with_phoneme_id", "with_pre_post", "with_duration", "with_relative_pos"), [bool(bits >> i & 1) for i in range(4)]))
    types = L.feature_types(**flags)
    if bits in (0, 6, 15):
        f, _ = L.extract_phoneme(word(spark), "openjtalk", 10, **flags)
        assert {len(r.v) for r in f.collect()} == {L.total_width(types, "openjtalk")}
        if flags["with_relative_pos"]:
            r = f.where("idx = 3").collect()[0].v
            assert r[-2:] == pytest.approx([0.3 - 0.25, 0.25 - 0.05])
    assert L.total_width(types, "openjtalk") == sum(L.width(t, "openjtalk") for t in types)


def test_accents_must_fit(spark):
    a = spark.createDataFrame([("u", i, True) for i in range(3)], "utt_id string, pos int, start_accent boolean")
    z = spark.createDataFrame([("u", i, True) for i in range(4)], "utt_id string, pos int, end_accent boolean")
    with pytest.raises(LabelError):
        L.join_accents(word(spark), a, z)


def test_silence(spark, rows):
    d = L.convert(word(spark), "openjtalk")
    n = spark.createDataFrame([("u", 12)], "utt_id string, n bigint")
    mask = L.silence_from_phonemes(d, n, "openjtalk", 10)
    assert [r.silent for r in mask.orderBy("idx").collect()] == [True, True] + [False] * 8 + [True, True]
    assert rows(L.silence_runs(mask, 10)) == [("u", 0.0, 0.1), ("u", 1.0, 1.1)]


def test_space_moves_to_the_silence(spark, rows):
    data = [("u", 0, "sil", 0.0, 0.4), ("u", 1, "k", 0.4, 1.4), ("u", 2, "pau", 1.4, 1.6), ("u", 3, "o", 1.6, 1.9), ("u", 4, "sil", 1.9, 2.4)]
    s = spark.createDataFrame([("u", 1.3, 1.7), ("u", 1.5, 1.95)], "utt_id string, start_s double, end_s double")
    got = [(r.phoneme, r.start_s, r.end_s) for r in L.expand_silence(word(spark, data), s, "openjtalk").orderBy("pos").collect()]
    # the first silence takes the space to 1.3 and 1.7, the second its end on to 0.03 before the end of the label after it
    assert got == [("pau", 0.0, 0.4), ("k", 0.4, 1.3), ("pau", 1.3, 1.87), ("o", 1.87, 1.9), ("pau", 1.9, 2.4)]
    assert L.violations(word(spark, [("u", i, *g) for i, g in enumerate(got)]), "openjtalk").count() == 0


def test_stretch_leaves_a_minimum():
    new = L.stretch([("k", 0.0, 0.5), ("pau", 0.5, 0.6), ("o", 0.6, 0.7)], [(0.1, 0.69)], "pau", 0.03)
    assert new == [("k", 0.0, 0.1), ("pau", 0.1, pytest.approx(0.67)), ("o", pytest.approx(0.67), 0.7)]
    new = L.stretch([("k", 0.3, 0.5), ("pau", 0.5, 0.6)], [(0.1, 0.55)], "pau", 0.03)
    assert new == [("k", 0.3, pytest.approx(0.33)), ("pau", pytest.approx(0.33), 0.6)]


def in_any_order_of_lists(names, sides, silences, space, minimum):
    """The rule as stated: each silence in turn meets each space."""
    start, end = sides[:-1], sides[1:]
    for s, z in silences:
        for i in range(len(names)):
            if names[i] == space and s < start[i] <= z:
                s = max(s, start[i - 1] + minimum) if i else s
                start[i] = s
                end[i - 1 : i] = [s] * (i > 0)
            if names[i] == space and s <= end[i] < z:
                z = min(z, end[i + 1] - minimum) if i + 1 < len(names) else z
                start[i + 1 : i + 2] = [z] * (i + 1 < len(names))
                end[i] = z
    return [*start, end[-1]]


@pytest.mark.parametrize("seed", range(40))
def test_one_walk_moves_sides_as_the_rule_says(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 30))
    names = [str(x) for x in r.choice(["a", "pau"], n)]
    sides = np.round(np.cumsum(np.append(0, 0.03 + r.random(n) * r.choice([0.02, 0.3]))), 3).tolist()
    cuts = np.unique(np.round(r.random(2 * int(r.integers(0, 12))) * sides[-1], 3)).tolist()  # runs of silence never touch
    silences = [(a, z) for a, z in zip(cuts[::2], cuts[1::2])]
    got = L.move_sides(sides, [i for i, x in enumerate(names) if x == "pau"], silences, 0.03)
    assert got == in_any_order_of_lists(names, list(sides), silences, "pau", 0.03)


def test_text_round_trip(spark, rows):
    text = L.as_text(word(spark)).collect()[0].text
    assert text.split("\n")[0] == "0.0000\t0.2500\tsilB" and not text.endswith("\n")
    lines = spark.createDataFrame([("u", i, x) for i, x in enumerate(("\n" + text + "\n\n").split("\n"))], "utt_id string, pos int, value string")
    assert rows(L.parse(lines)) == sorted(WORD, key=repr)
