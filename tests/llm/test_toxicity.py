import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import registry, toxicity

TWINS = ["".join("ab"[i.bit_count() % 2 ^ k] for i in range(1024)) for k in (0, 1)]


def brute_terms(text):
    """Words, and beginnings with a star after them."""
    out = Counter()
    for w in re.findall(r"[a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
        out[w] += 1
        for n in (4, 6):
            if len(w) >= n:
                out[w[:n] + "*"] += 1
    return out


def names_of(terms):
    return [w.decode() for w in terms.words.words] + [w.decode() + "*" for w in terms.stems.words]


def test_terms():
    texts = ["Hello, wörlds! Hello12 ab", "", "hell ÜBERALL überall 한국어텍스트", *TWINS, "hello " + TWINS[0]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    known = ["hello", "hellenic", "über", "한국어텍", "ab", TWINS[0]]
    terms = toxicity.Terms([w.encode() for w in known])
    names = names_of(terms)
    assert set(names) == {t for w in known for t in brute_terms(w)}
    want = {(d, t): n for d, text in enumerate(texts) for t, n in brute_terms(text).items() if t in set(names)}
    docs, found, counts = terms.of_texts(data, offs)
    assert {(d, names[t]): n for d, t, n in zip(docs.tolist(), found.tolist(), counts.tolist())} == want and len(want) == len(docs)


def packed(rows):
    return np.cumsum([0, *(len(t) for t, _ in rows)]), np.concatenate([t for t, _ in rows]), np.concatenate([c for _, c in rows])


@pytest.mark.parametrize("common", [0, 7, 1024])
def test_nearest_is_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = np.random.default_rng(4)
    n, m = 900, 40
    row = lambda most: (np.sort(rng.choice(m, rng.integers(1, most), replace=False)), rng.integers(1, 4, m).astype(float))
    rows = sorted(((t, c[: len(t)]) for t, c in (row(6) for _ in range(n))), key=lambda r: (r[0].tolist(), r[1].tolist()))
    made = toxicity.Examples(list(range(n)), rng.random(n) < 0.4, 1 + rng.random(m), *packed(rows), 0.1)
    dense = np.zeros((n, m))
    dense[np.repeat(np.arange(n), np.diff(made.bounds)), made.terms] = made.values
    asked = [(t, c[: len(t)]) for t, c in (row(8) for _ in range(300))]
    bounds, terms, counts = packed(asked)
    weights = toxicity.unit(made.weights(terms, counts), bounds)
    for i, got in enumerate(made.nearest(bounds, terms, weights)):
        q = np.zeros(m)
        q[terms[bounds[i] : bounds[i + 1]]] = weights[bounds[i] : bounds[i + 1]]
        cosine = np.round(dense @ q, 9)
        want = sorted(((c, j) for j, c in enumerate(cosine.tolist()) if c > 0), key=lambda x: (-x[0], x[1]))[:15]
        assert len(got) == len(want) and np.allclose([s for s, _ in got], [s for s, _ in want], atol=2e-9)
        assert all(abs(cosine[j] - s) < 2e-9 for s, j in got)
        assert [x for x in got if x[0] > got[-1][0] + 1e-8] == [x for x in want if x[0] > got[-1][0] + 1e-8] or not np.array_equal([s for s, _ in got], [s for s, _ in want])
    own = made.nearest(made.bounds, made.terms, made.values, without=np.arange(n))
    assert all(i not in [e for _, e in x] for i, x in enumerate(own))


def test_documents_equal_brute_force(spark):
    """Fitting and scoring over real documents against dictionaries: terms, frequencies, weights, cosines and evidence."""
    d = "/root/testdata/sf0.001"
    docs, labels = registry.table(spark, d, "documents"), registry.table(spark, d, "labels")
    fitted = toxicity.fitted(docs, labels)
    model = fitted.examples
    texts = {r.doc_id: brute_terms(r.text) for r in docs.collect()}
    marks = {e: bool(t) for e, t in zip(model.names, model.toxic)}
    df = Counter(t for own in texts.values() for t in own)
    n1, n = sum(marks.values()), len(marks)
    pos, both = Counter(t for e in marks if marks[e] for t in texts[e]), Counter(t for e in marks for t in texts[e])
    part = lambda o, e: o * math.log(o / e) if o else 0.0

    def factor(t):
        m, p = both[t], pos[t]
        g = 2 * (part(p, m * n1 / n) + part(m - p, m * (n - n1) / n) + part(n1 - p, (n - m) * n1 / n) + part(n - n1 - m + p, (n - m) * (n - n1) / n))
        return (math.log((1 + len(texts)) / (1 + df[t])) + 1) * max(g, 0) / (max(g, 0) + toxicity.HALF)

    factors = {t: factor(t) for t in both}
    assert sorted(names_of(model.vocabulary)) == sorted(both)

    def vector(own):
        w = {t: (1 + math.log(c)) * factors[t] for t, c in own.items() if t in factors}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()} if length else {}

    sides = {e: vector(texts[e]) for e in marks}
    for r in toxicity.scored(docs.select("doc_id", "text"), fitted).collect():
        own = vector(texts[r.row.doc_id])
        cosines = {e: sum(x * v.get(t, 0) for t, x in own.items()) for e, v in sides.items()}
        want = sorted((c for c in cosines.values() if c > 1e-9), reverse=True)[:15]
        assert np.allclose([x.cosine for x in r.evidence], want, atol=1e-8)
        assert all(abs(cosines[x.doc_id] - x.cosine) < 1e-8 and marks[x.doc_id] == x.toxic for x in r.evidence)


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.0, 1.0, 2.0, 3.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0, 1.0, 3.0]))
    assert np.interp([0, 1, 1.5, 2, 3], x, y).tolist() == [0, 0.5, 0.5, 0.5, 1]


def test_nulls_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, 3), (None, "", 3)], "doc_id long, text string, score int")
    model = toxicity.fitted(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.scored(docs, model).collect()] == [0.0] * 3
    assert toxicity.scored(docs.limit(0), model).collect() == []


def test_repeated_ids_labels_and_rows(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows = [(i, f"{'xyz' if i % 2 else 'uvw'} " + " ".join(word(10_000 * i + k) for k in range(8))) for i in range(200)]
    rows += [(None, "xyz xyz x")] * 70 + [(1000, None), (1001, "q"), (1002, "xyz ä " * 200_000)] + [(2, "other text of two"), rows[3]]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2 + [(5, 0), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    fitted = toxicity.fitted(docs, labels)
    made = fitted.examples
    assert len(made.names) == len(set(made.names)) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))
    names = names_of(made.vocabulary)
    n = len(rows)
    g = made.factor / toxicity.dependence(*(np.array([sum((w.strip("*") in (rows[e][1] if e != 2 else "")) and toxic == mark for e, toxic in zip(made.names, made.toxic)) for w in ("xyz", "uvw")], float) for mark in (True, False)), int(made.toxic.sum()), int((~made.toxic).sum()))[0]
    assert g[names.index("xyz")] == pytest.approx(math.log((1 + n) / (1 + 100 + 1 + 70 + 1)) + 1)
    got = toxicity.scored(docs, fitted).collect()
    assert len(got) == n
    by = {}
    for r in got:
        assert by.setdefault(r.row.text or "", (r.score, r.evidence)) == (r.score, r.evidence)
    assert by["q"][1] == [] == by[""][1] and by["xyz xyz x"][0] > 0.7


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in registry.op10_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in registry.table(spark, d, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for k, r in got.items())
    n = Counter((labels[k], r.predicted) for k, r in got.items() if k in labels and r.held_out)
    scores = [(r.score, labels[k]) for k, r in got.items() if k in labels and r.held_out]
    pos, neg = np.array([s for s, y in scores if y]), np.array([s for s, y in scores if not y])
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    print(n, "AUC", auc, "mean score of held-out", np.mean([s for s, _ in scores]), "share", np.mean([y for _, y in scores]))
    assert auc > 0.95 and n[0, 1] <= 0.01 * n[0, 0] and n[1, 1] >= 0.82 * (n[1, 0] + n[1, 1])
