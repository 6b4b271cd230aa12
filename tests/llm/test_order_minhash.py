import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import order_minhash as O
from paperloom.llm.components import components


def labelled(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return O.shingles(data, np.array([0, len(data)]))[0]


def brute_labelled(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    seen = {}
    out = []
    for g in grams:
        seen[g] = seen.get(g, -1) + 1
        out.append((g, seen[g]))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def words_of(text):
    return "".join(c.lower() if c.isascii() else c for c in text).split()


def brute_linked(x, y, jaccard=0.0):
    """At least four fifths of the longer text's words are aligned; and so many labelled shingles are shared."""
    a, b, s, t = words_of(x), words_of(y), set(brute_labelled(x)), set(brute_labelled(y))
    return bool(a and b) and len(s & t) >= jaccard * len(s | t) and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * lcs(a, b) >= 4 * max(len(a), len(b))


def brute_classes(texts, jaccard):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        x, y = texts[i] or "", texts[j] or ""
        if find(i) != find(j) and (x == y or brute_linked(x, y, jaccard)):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " \n", "one two", "One  two", "a b c d e", "a b c d e f", "x " * 300, "x " * 290]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 20, 40, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 9])):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(copy) // 60), max(1, len(copy) // 40)])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [line + " " + " ".join(word() for _ in range(4)) for _ in range(20)]  # share most words, are no copies
    texts += [texts[12]] * 6
    return texts


def test_shingles_and_chain_equal_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["A a\tb  a\nb a"]
    names = {}
    for t in texts:
        got, want = labelled(t), brute_labelled(t)
        assert len(got) == len(want)
        for g, w in zip(got.tolist(), want):
            assert names.setdefault(g, w) == w


def test_alignment_equals_brute_force():
    rng = random.Random(2)
    assert all(O.common(a, b) == lcs(a, b) for a, b in (([rng.randrange(4) for _ in range(rng.randrange(90))], [rng.randrange(4) for _ in range(rng.randrange(90))]) for _ in range(60)))
    texts, found = O.Texts(), []
    for k in range(120):
        own = [str(rng.randrange(60)) for _ in range(rng.choice([6, 30, 120]))]
        other = [w for w in own if rng.random() > 0.08]
        for _ in range(rng.randrange(0, 5)):
            other.insert(rng.randrange(len(other) + 1), rng.choice(["new", "7"]))
        if k % 10 == 0:
            other = other[len(other) // 2 :] + other[: len(other) // 2]  # the same words in another order
        x, y = " ".join(own), " ".join(other)
        got, n = O.aligned(*texts.of(x.encode(), pa.scalar(x.encode())), *texts.of(y.encode(), pa.scalar(y.encode())))
        assert not got or brute_linked(x, y)  # anchors can only cost words
        assert n <= lcs(own, other)
        found.append(got == brute_linked(x, y))
    assert sum(found) >= 0.97 * len(found)


def test_words_that_share_a_hash_do_not_align():
    words = [f"w{i:02d}" for i in range(60)]
    a, b = (np.array(x) for x in (range(60), range(100, 160)))
    shingles = labelled(" ".join(words))
    assert O.aligned(a, shingles, a, shingles) == (True, 60) and O.aligned(a, shingles, b, shingles) == (False, 0)


def test_near_copies_are_found(spark):
    """One word in twenty replaced, as planted copies have: nine of ten and more are linked, and nothing else is."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    rows = []
    for i in range(150):
        own = [word() for _ in range(rng.choice([60, 150, 400]))]
        rows += [(i, " ".join(own)), (1000 + i, " ".join(word() if rng.random() < 0.05 else w for w in own)), (2000 + i, " ".join(word() for _ in own))]
    got = {r.doc_id: r.class_id for r in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i] == i for i in range(150)) >= 140
    assert all(got[i] == i and got[2000 + i] == 2000 + i for i in range(150))


def test_sketches_meet():
    rng = np.random.default_rng(3)
    for n, extra in ((4, 1), (9, 1), (40, 5), (300, 37)):
        missed = 0
        for _ in range(200):
            own = rng.integers(0, 2**63, n + 2 * extra, dtype=np.int64).view(np.uint64)
            a, b = own[: n + extra], np.concatenate([own[:n], own[n + extra :]])
            missed += not set(O.sketch(a).tolist()) & set(O.sketch(b).tolist())
        assert missed <= 1, (n, missed)


@pytest.mark.parametrize(("seed", "block", "rows_"), [(4, 512, 4096), (5, 3, 10)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, block, rows_):
    monkeypatch.setattr(O, "BLOCK", block)
    monkeypatch.setattr(O, "GROUP_ROWS", rows_)
    texts = corpus(seed)
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, texts[12], "k"), (10, texts[10], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(3)
    got = O.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want, widest = brute_classes(texts, 0.6), brute_classes(texts, 0)
    own = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert all(own[i] == own[want[i]] and widest[own[i]] == widest[i] for i in range(len(texts)))
    for r in got:
        assert r.class_id == own[r.doc_id if r.doc_id is not None else 12]
        assert r.stays == (r.doc_id is not None and r.doc_id == r.class_id)
    kept = O.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(own.values()))


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for u, v in links:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    nodes = {x for u, v in links if u is not None and u != v for x in (u, v)}
    assert got == {x: find(x) for x in nodes}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert O.near_duplicates(docs).collect() == [] == O.deduplicated(docs).collect()
