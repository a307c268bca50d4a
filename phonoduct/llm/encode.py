"""Encode texts with a public byte-level BPE.

Texts up to a chunk are encoded where they lie. Longer ones become overlapping chunks that are pre-tokenised
in parallel. The pattern looks ahead but never back, so from a place where the pre-token boundaries of two
neighbouring chunks coincide both go on alike; there the chunks are stitched, and the pieces between
stitches are encoded in parallel. A coincidence counts if the earlier chunk is known to run true there: it was
stitched itself, or white space follows other characters, where a pre-token ends whatever came before. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.runtime import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pre-tokenisation pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters before a chunk's end in which a boundary may still depend on what follows.
GUARD = 16


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(chunk: str, last: bool) -> np.ndarray:
    """Positions where pre-tokens of a chunk begin, as far as they can't depend on the text after it."""
    starts = np.array([m.start() for m in _pattern().finditer(chunk)], np.int32)
    return starts if last else starts[starts <= len(chunk) - GUARD]


def encode_text(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Ids of one text; strings that look like special tokens are ordinary text."""
    return np.asarray(encoder(path).encode_ordinary(text), np.int32)


def _encode_batches(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path).encode_ordinary
        for b in batches:
            if not b.num_rows:
                continue
            at = b.schema.get_field_index(column)
            lists = [code(t) if t else [] for t in b.column(at).to_pylist()]
            offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at] + [ids], [n for n in b.schema.names if n != column] + ["ids"])

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, chunk: int = 16_384, overlap: int = 1_024) -> DataFrame:
    """(key, ids array<int>) of each row, without special tokens. Null and empty texts give the empty list.

    Repeated rows come out as often as they come in; keys need not be unique and may be null. Texts of any length
    are encoded whole. Other columns are ignored. ``overlap`` only decides how soon neighbours can be stitched: where no
    boundary coincides in it, the two chunks stay one piece.
    """
    kind = dict(df.dtypes)[key]
    d = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    short = d.where(F.col("t").isNull() | (F.length("t") <= chunk))
    schema = f"k {kind}, ids array<int>"
    done = short.mapInArrow(_encode_batches(path, "t"), schema)

    long = d.where(F.length("t") > chunk).withColumn("h", F.sha2("t", 256)).groupBy("k", "h").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("times"))
    long = cut_lineage(long)  # read for its chunks and for its pieces
    chunks = long.select("k", "h", F.length("t").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.length("t") - 1, F.lit(chunk)), lambda a: F.substring("t", a + 1, F.lit(chunk + overlap)))).alias("i", "c"))
    chunks = chunks.repartition("k", "h", "i")

    @F.pandas_udf("struct<head: array<int>, tail: array<int>, sure: int>")
    def edges(c: pd.Series, rest: pd.Series) -> pd.DataFrame:
        found = [boundaries(t, r <= len(t)) for t, r in zip(c, rest)]
        # not after white space, whose pre-tokens depend on what follows it
        head = [np.array([p for p in x[x < overlap] if p and not t[p - 1].isspace()], np.int32) for t, x in zip(c, found)]
        sure = [next((int(p) for p in x if t[p].isspace()), None) for t, x in zip(c, head)]
        return pd.DataFrame({"head": head, "tail": [x[x >= chunk] - chunk for x in found], "sure": pd.array(sure, "Int32")})

    by_text = Window.partitionBy("k", "h").orderBy("i")
    met, sure = F.array_min(F.array_intersect("e.tail", F.lead("e.head").over(by_text))), F.lead("e.sure").over(by_text)
    so_far = by_text.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("i"))).over(so_far), F.lit(-1))
    cuts = (
        chunks.select("k", "h", "i", edges("c", F.col("n") - F.col("i") * chunk).alias("e"))
        .select("k", "h", "i", sure.alias("sure"), ((F.col("i") + 1) * chunk + F.coalesce(sure, met)).alias("cut"))
        .withColumn("known", last(F.col("sure").isNotNull()) >= last(F.col("cut").isNull()))
        .where("cut is not null and known").groupBy("k", "h").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    )
    same = long.alias("a").join(cuts.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.h") == F.col("b.h")), "left")
    froms = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.expr("cast(array() as array<int>)")))
    stop = lambda i: F.coalesce(F.get(F.col("f"), i + 1), F.length("t"))
    pieces = (
        same.select("a.k", "a.h", "a.t", "a.times", froms.alias("f"))
        .select("k", "h", "times", F.posexplode(F.transform("f", lambda a, i: F.substring("t", a + 1, stop(i) - a))).alias("i", "t"))
        .repartition("k", "h", "i")
        .mapInArrow(_encode_batches(path, "t"), f"k {kind}, h string, times bigint, i int, ids array<int>")
    )
    joined = pieces.groupBy("k", "h", "times").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p"))
    joined = joined.select("k", F.flatten("p.ids").alias("ids"), F.explode(F.sequence(F.lit(1), F.col("times")))).select("k", "ids")
    return done.unionByName(joined).withColumnRenamed("k", key)


def decode(df: DataFrame, ids: str = "ids", path: str = VOCABULARY, out: str = "text") -> DataFrame:
    """``df`` with the text of each id list: the ids' raw bytes, concatenated. Bytes that are no UTF-8 become U+FFFD; a null list gives null."""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        raw = {i: b for b, i in ranks(path).items()}
        return pd.Series([None if x is None else b"".join(raw[i] for i in x).decode("utf-8", "replace") for x in lists], dtype=object)

    return df.withColumn(out, text(ids))
