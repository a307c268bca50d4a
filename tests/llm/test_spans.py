import random

import numpy as np
import pytest

from phonoduct.llm import spans
from phonoduct.llm.spans import Fenwick, chain, coverage, edit_distance, linked_passages, links, passages, shared_blocks, shared_runs

SCHEMA = "doc_id bigint, text string, h string, c int"


def brute(texts, least=64):
    where = {}
    for k, t in texts.items():
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(k)
    out = set()
    for k, t in texts.items():
        hit = np.zeros(len(t or "") + 2, bool)
        for i in range(len(t or "") - least + 1):
            if len(where[t[i : i + least]]) > 1:
                hit[i + 1 : i + 1 + least] = True
        d = np.flatnonzero(np.diff(hit.astype(int)))
        out |= {(k, int(a), int(b) - 1) for a, b in zip(d[::2], d[1::2])}
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh жиこ😀") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    quotes = [text(r.randrange(8, 60)) for _ in range(12)] + [text(400)]
    out = {}
    for k in range(80):
        t = text(r.randrange(0, 40))
        for _ in range(r.choice([0, 1, 1, 2])):
            q = r.choice(quotes)
            a = r.randrange(0, max(1, len(q) - 70))
            q = q[a : a + r.randrange(50, 400)]
            if r.random() < 0.3:
                i = r.randrange(len(q))
                q = q[:i] + "#" + q[i + 1 :]
            t += q + text(r.randrange(0, 10))
        out[k] = t
    out |= {100: out[3], 101: out[3], 102: quotes[-1], 103: quotes[-1] * 2, 104: "z" * 300, 105: "z" * 90, 106: "ab" * 60, 107: "", 108: None, 109: "short"}
    return out


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in texts.items()], SCHEMA)


@pytest.mark.parametrize(("segment", "sent"), [(1_000_000, 1_000_000), (1_000_000, 5), (150, 1_000_000), (150, 5)])
def test_against_brute_force(spark, monkeypatch, segment, sent):
    monkeypatch.setattr(spans, "SEGMENT", segment)
    texts = corpus(segment)
    df = frame(spark, texts)
    result = shared_blocks(df.unionByName(df.limit(20)), sent_seeds=sent)
    got = shared_runs(result).collect()
    assert {tuple(r) for r in got} == brute(texts) and len(got) == len(brute(texts))
    per = {}
    for k, a, b in brute(texts):
        n, c = per.get(k, (0, 0))
        per[k] = n + 1, c + b - a + 1
    assert {r.doc_id: (r.n_spans, r.shared_chars) for r in coverage(shared_runs(result)).collect()} == per


def test_nothing_shared(spark):
    df = frame(spark, {1: None, 2: "", 3: "x" * 63, 4: "y" * 200})
    assert shared_runs(shared_blocks(df)).count() == 0
    assert shared_runs(shared_blocks(df.limit(0))).count() == 0
    assert passages(shared_blocks(df)).count() == 0 and linked_passages(shared_blocks(df)).count() == 0 and links(shared_blocks(df)).count() == 0


def test_passages_go_on_over_small_edits(spark):
    r = random.Random(2)
    base = "".join(r.choice("abcdefghijklmnop ") for _ in range(400))
    other = "Q" * 30 + base[:200] + "##" + base[203:]
    row = passages(shared_blocks(frame(spark, {1: base, 2: other}))).where("c = 1").collect()
    assert len(row) == 1
    x = row[0]
    assert (x.first_char, x.last_char, x.partner_first, x.partner_last, x.edits) == (0, 399, 30, 428, 3) and x.exact_chars == 397


def first_holders(texts, least=64):
    """{(class, window): (first class that holds it, its first place there)} of windows that several classes hold."""
    first, where = {}, {}
    for k, t in sorted(texts.items()):
        first.setdefault(t, k)
    for t, k in first.items():
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], []).append((k, i))
    return {(k, i): min(w) for w in where.values() if len({k for k, _ in w}) > 1 for k, i in w}


@pytest.mark.parametrize("segment", [1_000_000, 150])
def test_texts_share_a_window_just_if_their_links_say_so(spark, monkeypatch, segment):
    monkeypatch.setattr(spans, "SEGMENT", segment)
    texts = corpus(segment)
    got = [(r.c, r.first_char + i, r.holder, r.holder_first + i) for r in links(shared_blocks(frame(spark, texts))).collect() for i in range(r.last_char - r.first_char - 62)]
    want = {(c, i, k, q) for (c, i), (k, q) in first_holders(texts).items() if k < c}
    assert len(got) == len(set(got)) and set(got) == want


def test_keys_of_any_size_give_the_same_links(spark):
    texts = corpus(3)
    far = [-(1 << 62), 1 << 61, 5]
    move = lambda k: far[k % 3] + k
    order = lambda k: sorted(map(move, texts)).index(move(k))
    small = {order(k): t for k, t in texts.items()}
    back = {order(k): move(k) for k in texts}
    get = lambda t: {tuple(r) for r in links(shared_blocks(frame(spark, t))).collect()}
    assert get({move(k): t for k, t in texts.items()}) == {(back[c], a, z, back[o], q) for c, a, z, o, q in get(small)}


def linked(spark, texts, **options):
    return {(x.c, x.partner): x for x in linked_passages(shared_blocks(frame(spark, texts)), **options).collect()}


def test_halves_held_by_others_still_make_one_passage(spark):
    r = random.Random(7)
    one, two = ("".join(r.choice("abcdefghijklmnop ") for _ in range(200)) for _ in range(2))
    got = linked(spark, {0: one, 5: one + "kitten" + two, 7: one + "sitting" + two})
    assert set(got) == {(5, 0), (7, 0), (7, 5)}
    x = got[7, 5]
    assert (x.first_char, x.last_char, x.partner_first, x.partner_last, x.exact_chars, x.edits) == (0, 406, 0, 405, 400, 3)


def test_versions_are_chained_with_the_first(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghijklmnop ") for _ in range(300))
    got = linked(spark, {1: base, 2: base[:100] + "##" + base[100:], 3: base[:200] + "#" + base[201:]})
    assert {k: x.edits for k, x in got.items()} == {(2, 1): 2, (3, 1): 1}


def test_nearly_all_edited_passages_are_chained_whole(spark):
    """Originals spread over posts, quoted with edits and in pieces that others quote too; each edited quote comes out as one passage."""
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    pieces = [text(r.randrange(100, 300)) for _ in range(30)]
    texts, k = {i: text(50) + x + text(50) for i, x in enumerate(pieces)}, 100
    planted = []
    for _ in range(60):
        a, b = r.sample(range(30), 2)
        edit = lambda: "".join(r.choice("xyz") for _ in range(r.randrange(1, 20)))
        for _ in range(2):  # two posts join the same two pieces, each in its own way
            texts[k] = text(20) + pieces[a] + edit() + pieces[b] + text(20)
            k += 1
        planted.append((k - 1, k - 2, len(pieces[a]) + len(pieces[b])))
    got = linked(spark, texts)
    hit = [got[c, q].exact_chars >= n and got[c, q].edits > 0 for c, q, n in planted if (c, q) in got]
    assert sum(hit) >= 0.9 * len(planted)


def test_chains_are_best_and_cover_all_blocks():
    p, q, n = np.array([0, 100, 210, 50]), np.array([0, 105, 215, 500]), np.array([80, 90, 80, 70])
    assert chain(p, q, n, 0.5).tolist()[:3] == [0, 0, 0] and chain(p, q, n, 0.5)[3] != 0
    assert sorted(set(chain(p, q, n, 100.0).tolist())) == [0, 1, 2, 3]


def test_fenwick_prefix_maxima():
    r = random.Random(0)
    t, best = Fenwick(50), {}
    for k in range(200):
        i, s = r.randrange(50), r.random()
        t.put(i, s, k)
        best[i] = max(best.get(i, -1), s)
        j = r.randrange(51)
        want = max((v for x, v in best.items() if x < j), default=float("-inf"))
        assert t.top(j)[0] == want


def test_edit_distance_of_long_gaps():
    r = random.Random(3)
    a = "".join(r.choice("abc") for _ in range(700))
    b = list(a)
    for i in sorted(r.sample(range(700), 40), reverse=True):
        b[i : i + 1] = r.choice([[], ["x"], ["a", "y"]])
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    assert edit_distance(a, "".join(b)) == row[-1] and edit_distance(a, "") == 700


def test_edit_distance():
    assert [edit_distance(a, b) for a, b in (("", ""), ("", "abc"), ("kitten", "sitting"), ("жук", "жар"), ("same", "same"))] == [0, 3, 3, 2, 0]
