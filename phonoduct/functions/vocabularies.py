"""Phoneme vocabularies: a phoneme's id is its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The established vocabularies, in id order.
SEG_KIT = "a i u e o a: i: u: e: o: N w y j my ky dy by gy ny hy ry py p t k ts ch b d g z m n s sh h f r q sp".split()
JVS = "pau I N U a b by ch cl d dy e f g gy h hy i j k ky m my n ny o p py r ry s sh t ts u v w y z".split()
OPENJTALK = "pau A E I N O U a b by ch cl d dy e f g gw gy h hy i j k kw ky m my n ny o p py r ry s sh t ts ty u v w y z".split()
ROHAN = [*OPENJTALK, "fy"]
KIRITAN = "pau a b ch cl d e f g gy h hy i j k ky m my n N ny o p py r ry s sh t ts u v w y z".split()
SONG = [*ROHAN, "br", "Edge", "GlottalStop"]
SPACE = {"seg_kit": "sp", "jvs": "pau", "openjtalk": "pau", "rohan": "pau", "kiritan": "pau", "song": "pau"}

VOCABULARIES: dict[str, list[str]] = {"seg_kit": SEG_KIT, "jvs": JVS, "openjtalk": OPENJTALK, "rohan": ROHAN, "kiritan": KIRITAN, "song": SONG}
TYPES = [*VOCABULARIES, "dummy"]


def vocabulary(phoneme_type: str) -> list[str]:
    """The list of a type. ``dummy`` accepts any phoneme and has none."""
    if phoneme_type not in VOCABULARIES:
        raise ValueError(f"{phoneme_type!r} has no vocabulary")
    return VOCABULARIES[phoneme_type]


def phoneme_id(phoneme: Column, phoneme_type: str) -> Column:
    """Place in the vocabulary; null for a phoneme that isn't in it."""
    at = F.array_position(F.array(*[F.lit(p) for p in vocabulary(phoneme_type)]), phoneme)
    return F.when(at > 0, (at - 1).cast("int"))


def one_hot(identity: Column, size: int) -> Column:
    """array<float> with 1 at the id; all 0 for null."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(i == identity, F.lit(False)).cast("float"))


def vocabulary_table(spark: SparkSession) -> DataFrame:
    """(phoneme_type, phoneme, phoneme_id, is_space) of all types."""
    rows = [(t, p, i, p == SPACE[t]) for t, v in VOCABULARIES.items() for i, p in enumerate(v)]
    return spark.createDataFrame(rows, "phoneme_type string, phoneme string, phoneme_id int, is_space boolean")
