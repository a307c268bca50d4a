"""Long exact spans that records share, by seeds, collinear chains and alignment.

1. Equal texts become one class (its smallest key stands for it).
2. Seeds: minimizers, chosen by content alone, so that every window of ``least`` characters has one and equal
   windows have the same. Consecutive windows of one seed are a stretch. Only stretches whose seed occurs in two classes are kept.
3. Anchors: stretches of equal text (seed and 64-bit fingerprint) are one, and each is matched with its first and last holder.
   Where a seed has several texts around it, one copy of each is taken apart into windows, which are matched in the same way.
   So a window is matched with the first class that holds it (the first with the last) - linear in the number of windows however
   often one occurs, and two texts that share a window have the same first holder and place for it.
4. Anchors on one diagonal merge into blocks; the blocks of a record and partner are chained with gap costs
   through a Fenwick tree, so that passages may go on over small edits.
5. :func:`shared_runs` unites the exact blocks; :func:`links` lists who shares what with whom; :func:`linked_passages` chains
   each text with the first holders of its blocks, and of the steps from one block to the next, and aligns what lies between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoduct.runtime import cut_lineage, per_groups

LEAST = 64
#: Characters hashed at once: few enough for the arrays to stay in a core's cache.
SEGMENT = 1 << 16
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Hashes of all windows of k characters: sums of mixed characters times powers of an odd base, mod 2**64."""

    def __init__(self, base: int, salt: int):
        self.base, self.salt = _U(base | 1), _U(salt)
        self.inverse = _U(pow(base | 1, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _sums(self, chars: np.ndarray) -> np.ndarray:
        n = len(chars)
        if len(self.up) < n:
            self.up = np.cumprod(np.append(_U(1), np.full(n - 1, self.base)), dtype=np.uint64)
            self.down = np.cumprod(np.append(_U(1), np.full(n - 1, self.inverse)), dtype=np.uint64)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(chars.astype(np.uint64) + self.salt) * self.up[:n], out=s[1:])
        return s

    def __call__(self, chars: np.ndarray, k: int) -> np.ndarray:
        s = self._sums(chars)
        return _mix((s[k:] - s[:-k]) * self.down[: max(len(chars) - k + 1, 0)])

    def spans(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of stretches of any length."""
        s = self._sums(chars)
        return _mix((s[end] - s[start]) * self.down[start] + (end - start).astype(np.uint64))


_SEED = Rolling(0x9E3779B97F4A7C15, 0x243F6A8885A308D3)
_PRINT = Rolling(0xD1342543DE82EF95, 0x13198A2E03707344)


def _slide(a: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each w consecutive values."""
    have = 1
    while have < w:
        step = min(have, w - have)
        a, have = best(a[: len(a) - step], a[step:]), have + step
    return a


def _segments(texts: list[str | None], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chars, row, position) of texts joined to segments; longer texts go on in the next with least - 1 characters repeated."""
    chars, rows, begins, size = [], [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in chars])
        at = np.arange(n.sum(), dtype=np.int32) + np.repeat(np.array(begins) - np.cumsum(n) + n, n).astype(np.int32)
        return np.concatenate(chars), np.repeat(np.array(rows, np.int32), n), at

    for r, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        for a in range(0, max(len(c) - least + 1, 0), SEGMENT):
            part = c[a : a + SEGMENT + least - 1]
            chars.append(part)
            rows.append(r)
            begins.append(a)
            size += len(part)
            if size >= SEGMENT:
                yield joined()
                chars, rows, begins, size = [], [], [], 0
    if size:
        yield joined()


#: Low bits of a seed's order that hold its place in a segment, so that the leftmost of equal seeds comes first.
_PLACE = 22


def stretches(chars: np.ndarray, whole: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of the seed) of stretches of joined texts; ``whole`` marks where a window lies within one text."""
    k = least // 2 + 1
    h = _SEED(chars, k)
    order = (h >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    seed = (_slide(order, least - k + 1, np.minimum) & _U((1 << _PLACE) - 1)).astype(np.int64)
    i = np.flatnonzero(whole)
    first = np.flatnonzero(np.append(True, (np.diff(seed[i]) != 0) | (np.diff(i) != 1))) if len(i) else i
    return i[first], np.diff(np.append(first, len(i))), h[seed[i[first]]].view(np.int64)


def _whole(rows: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    n = len(rows) - least + 1
    return (rows[:n] == rows[least - 1 :]) & (at[least - 1 :] - at[:n] == least - 1)


def _seeds(least: int, places: bool = False):
    """(h, c) of each stretch; with ``places`` also its first window p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for chars, rows, at in _segments(b.column(1).to_pylist(), least):
                i, _, h = stretches(chars, _whole(rows, at, least), least)
                out = [pa.array(h), pa.array(ids[rows[i]])] + [pa.array(at[i])] * places
                yield pa.RecordBatch.from_arrays(out, ["h", "c", "p"][: len(out)])

    return run


def _kept(least: int, common):
    """(h, f, c, p, n, ws): stretches with a kept seed, the fingerprint of their text and of each window.

    ``common`` has the kept seeds, sorted; without it a third column lists the windows with which a text's kept stretches begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for chars, rows, at in _segments(b.column(1).to_pylist(), least):
                i, n, h = stretches(chars, _whole(rows, at, least), least)
                if common is not None:
                    keep = common.value[np.minimum(np.searchsorted(common.value, h), len(common.value) - 1)] == h
                else:
                    lists = b.column(2)
                    starts = (np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) << 32) | lists.flatten().to_numpy()
                    keep = np.isin((rows[i].astype(np.int64) << 32) | at[i], starts)
                i, n, h = i[keep], n[keep], h[keep]
                f = _PRINT.spans(chars, i, i + n + least - 1).view(np.int64)
                into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at_w = np.repeat(i, n) + into
                ws = _PRINT.spans(chars, at_w, at_w + least).view(np.int64)
                ws = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ws))
                out = pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), pa.array(ids[rows[i]]), pa.array(at[i]), pa.array(n.astype(np.int32)), ws], ["h", "f", "c", "p", "n", "ws"])
                yield from (out.slice(k, 10_000) for k in range(0, out.num_rows, 10_000))

    return run


_RUN = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("c0", pa.int64()), ("q0", pa.int32()), ("c1", pa.int64()), ("q1", pa.int32())])


def _together(t: pa.Table, at: np.ndarray) -> pa.Table:
    """Consecutive windows of a stretch whose first and last holders go on alike, as one."""
    off, c0, q0, c1, q1 = (t.column(x).to_numpy() for x in ("off", "c0", "q0", "c1", "q1"))
    new = np.zeros(len(off), bool)
    new[at] = True
    new[1:] |= (np.diff(off) != 1) | (np.diff(c0) != 0) | (np.diff(c1) != 0) | (np.diff(q0) != 1) | (np.diff(q1) != 1)
    s = np.flatnonzero(new)
    d = {x: t.column(x).take(pa.array(s)) for x in _RUN.names if x != "n"} | {"n": pa.array(np.diff(np.append(s, len(off))).astype(np.int32))}
    return pa.table([d[x] for x in _RUN.names], schema=_RUN)


_BLOCK = pa.schema([("c", pa.int64()), ("partner", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("n", pa.int32()), ("chain", pa.int32())])
_BLOCK_DDL = "c bigint, partner bigint, p int, q int, n int, chain int"


class Fenwick:
    """Prefix maxima of (score, item)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, i: int, score: float, item: int) -> None:
        i += 1
        while i < len(self.best):
            if score > self.best[i][0] or self.best[i][1] < 0:
                self.best[i] = (score, item)
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Best among positions below i."""
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i][1] >= 0 and self.best[i][0] > out[0]:
                out = self.best[i]
            i &= i - 1
        return out


def chain(p: np.ndarray, q: np.ndarray, size: np.ndarray, gap_cost: float) -> np.ndarray:
    """Chain number of each block (start p in the record, q in the partner, size characters).

    A chain's score is its characters less ``gap_cost`` for each character skipped in either text. Best chains
    are taken first; every block is in exactly one.
    """
    n = len(p)
    if n == 1:
        return np.zeros(1, np.int32)
    pe, qe = p + size, q + size
    spots = np.unique(qe)
    order, ends = np.lexsort((q, p)), np.argsort(pe, kind="stable")
    tree, score, prev, done = Fenwick(len(spots)), [0.0] * n, [-1] * n, 0
    for j in order:
        while done < n and pe[ends[done]] <= p[j]:
            i = int(ends[done])
            tree.put(int(np.searchsorted(spots, qe[i])), score[i] + gap_cost * float(pe[i] + qe[i]), i)
            done += 1
        best, i = tree.top(int(np.searchsorted(spots, q[j], "right")))
        gain = best - gap_cost * float(p[j] + q[j])
        score[j], prev[j] = float(size[j]) + max(gain, 0.0), i if gain > 0 else -1
    out, chains = np.full(n, -1, np.int32), 0
    for j in sorted(range(n), key=lambda j: -score[j]):
        if out[j] >= 0:
            continue
        while j >= 0 and out[j] < 0:
            out[j] = chains
            j = prev[j]
        chains += 1
    return out


def _blocks(least: int, gap_cost: float):
    """Anchors on one diagonal that touch or overlap become one block; blocks are chained within (c, partner)."""

    def run(t: pa.Table, at: np.ndarray) -> pa.Table:
        c, partner, p, q, n = (t.column(x).to_numpy() for x in ("c", "partner", "p", "q", "n"))
        order = np.lexsort((p, q - p, partner, c))
        c, partner, p, q, n = c[order], partner[order], p[order], q[order], n[order]
        line = np.append(True, (np.diff(c) != 0) | (np.diff(partner) != 0) | (np.diff(q - p) != 0))
        far = np.cumsum(line) << 32
        reach = np.maximum.accumulate(far + p + n) - far
        s = np.flatnonzero(line | np.append(True, p[1:] > reach[:-1]))
        n = reach[np.append(s[1:], len(p)) - 1] - p[s]
        c, partner, p, q = c[s], partner[s], p[s], q[s]
        pair = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (partner[1:] != partner[:-1])))
        number = np.zeros(len(c), np.int32)
        for a, z in zip(pair, np.append(pair[1:], len(c))):
            if z - a > 1:
                number[a:z] = chain(p[a:z], q[a:z], n[a:z] + least - 1, gap_cost)
        return pa.table([c, partner, p, q, n.astype(np.int32), number], schema=_BLOCK)

    return run


#: Most kept seeds (8 bytes each) that are sent to all executors; more are joined by shuffles.
SENT_SEEDS = 1_000_000


def _kept_stretches(classes: DataFrame, least: int, sent: int) -> DataFrame:
    texts = classes.select("c", "t")
    common = cut_lineage(texts.mapInArrow(_seeds(least), "h bigint, c bigint").groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("h"))
    schema = "h bigint, f bigint, c bigint, p int, n int, ws array<bigint>"
    few = [r[0] for r in common.limit(sent + 1).collect()]  # bounded by `sent`
    if not few:
        return texts.limit(0).mapInArrow(_kept(least, None), schema)
    if len(few) <= sent:
        return texts.mapInArrow(_kept(least, _broadcast(classes, few)), schema)
    starts = texts.mapInArrow(_seeds(least, True), "h bigint, c bigint, p int").join(common, "h", "left_semi").groupBy("c").agg(F.collect_list("p").alias("ps"))  # at most a text's length
    return texts.join(starts, "c").select("c", "t", "ps").mapInArrow(_kept(least, None), schema)


def _broadcast(df: DataFrame, values: list[int]):
    return df.sparkSession.sparkContext.broadcast(np.sort(np.array(values, np.int64)))


class _Places:
    """A class and a character of it as one number, in order of both, so that least and greatest places are plain sums of a hash aggregate.

    Numbers are bigint where all keys and lengths fit, else decimal.
    """

    def __init__(self, classes: DataFrame):
        r = classes.agg(F.min("c").alias("a"), F.max("c").alias("b"), F.max(F.length("t")).alias("n")).collect()[0]  # one row
        small = r.a is None or (-(1 << 38) <= r.a and r.b < 1 << 38 and r.n < 1 << 24)
        self.kind, self.span = ("bigint", 1 << 24) if small else ("decimal(38,0)", 1 << 31)

    def of(self, c: Column, p: Column) -> Column:
        return (c.cast(self.kind) * F.lit(self.span).cast(self.kind) + p).cast(self.kind)

    def split(self, x: str) -> tuple[Column, Column]:
        p = F.expr(f"pmod({x}, cast({self.span} as {self.kind}))")
        return F.expr(f"cast(({x} - pmod({x}, cast({self.span} as {self.kind}))) div {self.span} as bigint)"), p.cast("int")


def _anchors(kept: DataFrame, places: _Places) -> DataFrame:
    """(c, partner, p, q, n): n consecutive windows with the first class that holds them; those of the first class itself with the last.

    ``kept`` has (h, f, x, n, ws), x a place.
    """
    key, kind = ["h", "f"], places.kind
    equal = kept.groupBy(*key).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.max("n").alias("n"))
    several = equal.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    equal = equal.join(several, "h", "left")
    (a, qa), (b, qb) = places.split("a"), places.split("b")
    ends = [a.alias("c0"), qa.alias("q0"), b.alias("c1"), qb.alias("q1")]
    alone = equal.where(F.col("texts").isNull() & (a < b)).select(*key, F.lit(0).alias("off"), "n", *ends)

    copies = kept.select(*key, "x", "ws").join(equal.where("texts is not null").select(*key, "a", "b"), key).where("x = a")
    windows = copies.select(*key, F.posexplode("ws").alias("off", "w"), "a", "b")
    shared = windows.groupBy("h", "w").agg(F.min((F.col("a") + F.col("off")).cast(kind)).alias("a"), F.max((F.col("b") + F.col("off")).cast(kind)).alias("b")).where(a < b)
    hits = windows.select(*key, "off", "w").join(shared, ["h", "w"]).select(*key, "off", *ends)
    runs = hits.repartition(*key).sortWithinPartitions(*key, "off").mapInArrow(per_groups(_together, key, _RUN), "h bigint, f bigint, off int, n int, c0 bigint, q0 int, c1 bigint, q1 int")

    c, p = places.split("x")
    d = kept.select(*key, c.alias("c"), p.alias("p")).join(alone.unionByName(runs), key)
    own = F.col("c") == F.col("c0")
    return d.select("c", F.when(own, F.col("c1")).otherwise(F.col("c0")).alias("partner"), (F.col("p") + F.col("off")).alias("p"), F.when(own, F.col("q1")).otherwise(F.col("q0")).alias("q"), "n")


def shared_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gap_cost: float = 0.5, sent_seeds: int = SENT_SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, blocks), the operator's result.

    * members (key, h): the rows' class.
    * classes (c, h, t, copies): per distinct text of at least ``least`` characters its smallest key, digest, text and
      whether another key has the same text.
    * blocks (c, partner, p, q, n, chain): n consecutive windows of ``least`` characters from character p of class c that
      occur from character q of class ``partner``, numbered by chain within (c, partner). The partner is the first class that
      holds them, at its first place; for windows that c itself holds first it is the last class.

    Keys are bigint and unique apart from repeated rows, which count once. Null keys, null and empty texts and texts
    shorter than ``least`` share nothing. Texts of any length are taken whole; other columns are ignored. Up to ``sent_seeds``
    seeds that several classes hold are sent to the tasks; more are joined by shuffles, with the same result.
    """
    d = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.length("t") >= least))
    d = d.withColumn("h", F.sha2("t", 256))
    classes = d.groupBy("h").agg(F.min("k").alias("c"), F.first("t").alias("t"), (F.min("k") < F.max("k")).alias("copies"))
    classes = cut_lineage(classes.select("c", "h", "t", "copies"))
    places = _Places(classes)
    kept = cut_lineage(_kept_stretches(classes, least, sent_seeds).select("h", "f", places.of(F.col("c"), F.col("p")).alias("x"), "n", "ws"))
    anchors = _anchors(kept, places)
    blocks = anchors.repartition("c").sortWithinPartitions("c").mapInArrow(per_groups(_blocks(least, gap_cost), ["c"], _BLOCK), _BLOCK_DDL)
    return d.select(F.col("k").alias(key), "h").distinct(), classes, cut_lineage(blocks)


def shared_runs(result: tuple[DataFrame, DataFrame, DataFrame], key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(key, first_char, last_char): each longest run of characters that lie in shared windows, from :func:`shared_blocks`."""
    members, classes, blocks = result
    whole = classes.where("copies").select("h", F.lit(0).alias("first_char"), (F.length("t") - 1).alias("last_char"))
    schema = pa.schema([("c", pa.int64()), ("first_char", pa.int32()), ("last_char", pa.int32())])

    def unite(t: pa.Table, at: np.ndarray) -> pa.Table:
        c, p, e = t.column("c").to_numpy(), t.column("p").to_numpy(), t.column("p").to_numpy() + t.column("n").to_numpy() + least - 2
        group = np.zeros(len(c), np.int64)
        group[at] = 1
        group = np.cumsum(group)
        reach = np.maximum.accumulate(group * (1 << 33) + e) - group * (1 << 33)
        new = np.append(True, (group[1:] != group[:-1]) | (p[1:] > reach[:-1] + 1))
        s = np.flatnonzero(new)
        return pa.table([c[s], p[s], reach[np.append(s[1:], len(c)) - 1].astype(np.int32)], schema=schema)

    lone = classes.where("not copies").select("c", "h")
    runs = blocks.join(lone.select("c"), "c", "left_semi").repartition("c").sortWithinPartitions("c", "p").mapInArrow(per_groups(unite, ["c"], schema), "c bigint, first_char int, last_char int")
    longs = lambda d: d.select(key, F.col("first_char").cast("bigint").alias("first_char"), F.col("last_char").cast("bigint").alias("last_char"))
    return longs(members.join(whole, "h")).unionByName(longs(runs.withColumnRenamed("c", key)))


def coverage(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_spans, shared_chars) of :func:`shared_runs`."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("last_char") - F.col("first_char") + 1).alias("shared_chars"))


def links(result: tuple[DataFrame, DataFrame, DataFrame], least: int = LEAST) -> DataFrame:
    """(c, first_char, last_char, holder, holder_first): each longest passage of class c with the first class that holds its windows.

    Two texts share a window just if both have the same holder and place for it, or one is the holder; so no link between
    different texts is lost, though the rows are as many as the passages, not the pairs.
    """
    b = result[2].where("partner < c")
    return b.select("c", F.col("p").cast("bigint").alias("first_char"), (F.col("p") + F.col("n") + least - 2).cast("bigint").alias("last_char"), F.col("partner").alias("holder"), F.col("q").cast("bigint").alias("holder_first"))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance within a band around the diagonal, which is doubled until the distance fits in it."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in sorted((a, b), key=len))
    same = np.flatnonzero(np.append(x != y[: len(x)], True))[0]
    x, y = x[same:], y[same:]
    band = max(len(y) - len(x), 8)
    while True:
        d = _banded(x, y, band)
        if d <= band:
            return d
        band = min(2 * band, max(len(x), len(y)))


def _banded(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """The cheapest path that leaves the diagonal by at most ``band``: the distance, if that is at most ``band``."""
    far = len(x) + len(y) + 1
    shift = np.arange(-band, band + 1)
    padded = np.concatenate([np.zeros(band, np.uint32), y, np.zeros(band + len(x) + 1, np.uint32)])
    row = np.where(shift >= 0, shift, far)
    for i, ch in enumerate(x):
        at = shift + i + 1  # characters of y taken, on each diagonal
        new = np.minimum(row + (padded[i : i + len(shift)] != ch), np.append(row[1:], far) + 1)
        new = np.where((at >= 0) & (at <= len(y)), np.where(at == 0, i + 1, new), far)
        row = np.minimum(np.minimum.accumulate(new - shift) + shift, far)
    end = len(y) - len(x) + band
    return int(row[end]) if end < len(row) else far


def passages(result: tuple[DataFrame, DataFrame, DataFrame], least: int = LEAST) -> DataFrame:
    """(c, partner, first_char, last_char, partner_first, partner_last, exact_chars, edits): one row per chain.

    ``edits`` is the edit distance of the texts between the chain's blocks, by aligning each gap. Chains link classes
    of equal texts, each with the partners of its blocks.
    """
    _, classes, blocks = result
    size = F.col("n") + least - 1
    chains = blocks.groupBy("c", "partner", "chain").agg(
        F.min("p").alias("first_char"), F.max(F.col("p") + size - 1).alias("last_char"), F.min("q").alias("partner_first"), F.max(F.col("q") + size - 1).alias("partner_last"),
        F.sum(size).alias("exact_chars"),
    )
    texts = classes.select("c", "t")
    pair = lambda c, a, b: F.substring(c, a + 1, F.greatest(b - a, F.lit(0)))
    w = Window.partitionBy("c", "partner", "chain").orderBy("p", "q")
    gaps = blocks.select("c", "partner", "chain", (F.col("p") + size).alias("pa"), F.lead("p").over(w).alias("pb"), (F.col("q") + size).alias("qa"), F.lead("q").over(w).alias("qb")).where("pb is not null")
    gaps = gaps.join(texts, "c").withColumn("s", pair(F.col("t"), F.col("pa"), F.col("pb"))).drop("t")
    gaps = gaps.join(texts.select(F.col("c").alias("partner"), "t"), "partner").withColumn("o", pair(F.col("t"), F.col("qa"), F.col("qb"))).drop("t")

    @F.pandas_udf("bigint")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x, y) for x, y in zip(a, b)])

    edits = gaps.withColumn("e", distance("s", "o")).groupBy("c", "partner", "chain").agg(F.sum("e").alias("edits"))
    return chains.join(edits, ["c", "partner", "chain"], "left").fillna(0, ["edits"]).drop("chain")


_STEP_DDL = "c bigint, p int, n int, p2 int, n2 int, o bigint, oe int, o2 bigint, oq2 int"
_STEP = pa.schema([(f, pa.int64() if k == "bigint" else pa.int32()) for f, k in (x.split() for x in _STEP_DDL.split(", "))])


def _following(least: int, reach: int):
    """Each block of a text with each later one that begins at most ``reach`` characters after its end; o is the first holder, oe and oq2 places there."""

    def run(t: pa.Table, at: np.ndarray) -> pa.Table:
        c, p, n, o, oq = (t.column(x).to_numpy() for x in ("c", "p", "n", "o", "oq"))
        group = np.zeros(len(c), np.int64)
        group[at] = 1
        place = (np.cumsum(group) << 33) + p
        first, last = np.arange(1, len(c) + 1), np.searchsorted(place, place + n + (least - 1 + reach), "right")
        many = np.maximum(last - first, 0)
        i = np.repeat(np.arange(len(c)), many)
        j = np.repeat(first, many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        return pa.table([c[i], p[i], n[i], p[j], n[j], o[i], (oq + n)[i], o[j], oq[j]], schema=_STEP)

    return run


def _steps(blocks: DataFrame, least: int, reach: int) -> DataFrame:
    """(c, partner, p, q, n): both blocks of each step from a block to a later one that an earlier class takes too.

    A step leads from one place of a first holder to one of another (or farther on), over at most ``reach`` characters and
    over the blocks that lie between. The first class with a step stands for all that take it, so the rows are as many as the steps.
    """
    first = F.col("partner") < F.col("c")
    at = blocks.select("c", "p", "n", F.when(first, F.col("partner")).otherwise(F.col("c")).alias("o"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("oq"))
    step = at.repartition("c").sortWithinPartitions("c", "p").mapInArrow(per_groups(_following(least, reach), ["c"], _STEP), _STEP_DDL)
    key = ["o", "oe", "o2", "oq2"]
    rep = step.groupBy(*key).agg(F.min(F.struct("c", "p", "n", "p2", "n2")).alias("r"), F.max("c").alias("z")).where("r.c < z")
    j = step.join(rep, key).where("c > r.c")
    left, right = F.least(F.col("n"), F.col("r.n")), F.least(F.col("n2"), F.col("r.n2"))
    both = F.array(
        F.struct((F.col("p") + F.col("n") - left).alias("p"), (F.col("r.p") + F.col("r.n") - left).alias("q"), left.alias("n")),
        F.struct(F.col("p2").alias("p"), F.col("r.p2").alias("q"), right.alias("n")),
    )
    return j.select("c", F.col("r.c").alias("partner"), F.inline(both))


def linked_passages(result: tuple[DataFrame, DataFrame, DataFrame], least: int = LEAST, gap_cost: float = 0.5, reach: int = 256) -> DataFrame:
    """:func:`passages` of each class with the first holders of its blocks, and with the first class that takes the same steps between blocks.

    A step leads from one block to a later one over at most ``reach`` characters. So a passage that several texts hold with an edit in
    it is chained between each of them and the first of them, also where each half was held earlier by others. Rows grow with the
    number of blocks; which texts share a block at all is told by :func:`links`.
    """
    members, classes, blocks = result
    anchors = blocks.where("partner < c").select("c", "partner", "p", "q", "n").unionByName(_steps(blocks, least, reach))
    chained = anchors.repartition("c", "partner").sortWithinPartitions("c", "partner").mapInArrow(per_groups(_blocks(least, gap_cost), ["c", "partner"], _BLOCK), _BLOCK_DDL)
    return passages((members, classes, cut_lineage(chained)), least)
