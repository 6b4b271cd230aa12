import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import decision_lists as L
from paperloom.llm import registry

CASES = ["", None, " \n\t ", "one", "a a a a a", "a b c a b c", "x y\nx y\n\nx y \nz", "é#*$%&|<>é ü", "a\x0bb\x0cc d", "b c d\nb c d\n" * 40, "word " * 10_000, "😀 😀😀 ok? NO!"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, cover = Counter(wins), set()
    for i, w in enumerate(wins):
        if often[w] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n)


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(CASES)] + [(None, "a b", 9), (1, None, 9)], "doc_id long, text string, n_words int")
    got = L.judged(docs, []).select("row.doc_id", "row.text", *L.STATS[:5], "base_failed", "kept").collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        assert tuple(r)[2:8] == brute(r.text) and r.kept is not r.base_failed
    assert L.judged(docs.limit(0), []).collect() == []


def test_rules_find_thresholds():
    rng = np.random.default_rng(0)
    rows = rng.random((3000, 3))
    bad = (rows[:, 0] > 0.8) & (rows[:, 1] <= 0.5) | (rows[:, 2] > 0.95)
    rules = L.learned(rows, bad, ["words", "upper_share", "digit_share"])
    said = np.zeros(len(rows), bool)
    for r in rules:
        said |= r.matches(rows, ["words", "upper_share", "digit_share"])
    assert (said == bad).mean() > 0.98 and 2 <= len(rules) <= 5


def slow_grown(rows, bad, names):
    """Conditions by trying every threshold between two values that occur."""
    inside, out = np.ones(len(rows), bool), []
    while len(out) < L.MOST_CONDITIONS and 0 < bad[inside].sum() < inside.sum():
        p0, n0 = int(bad[inside].sum()), int(inside.sum())
        best = None
        for k, name in enumerate(names):
            values = sorted(set(rows[inside, k]))
            for side in ("<=", ">"):
                for low, high in zip(values, values[1:]):
                    limit = (low + high) / 2
                    said = inside & ((rows[:, k] <= limit) if side == "<=" else (rows[:, k] > limit))
                    p, n = int(bad[said].sum()), int(said.sum())
                    gain = p * (np.log2(p / n) - np.log2(p0 / n0)) if p else -1
                    if gain > (best[0] if best else 0) + 1e-9:
                        best = gain, (name, side, limit), said
        if best is None:
            break
        out.append(best[1])
        inside = best[2]
    return out


def test_growing_equals_trying_every_threshold():
    rng = np.random.default_rng(3)
    names = list(L.FEATURES)[:4]
    for _ in range(20):
        rows = rng.integers(0, 12, (90, 4)).astype(float)
        bad = (rows[:, rng.integers(4)] > rng.integers(3, 9)) ^ (rng.random(90) < 0.1)
        assert L._grown(rows, bad, names) == slow_grown(rows, bad, names)


def test_verdicts_of_the_query_by_brute_force(spark):
    """Every document of the query: its statistics, the base rule and the first rule that matches, worked out in Python."""
    d = "/root/testdata/sf0.01"
    docs = registry.table(spark, d, "documents").select("doc_id", "text")
    rules = L.fitted(docs, registry.table(spark, d, "labels"))
    features = {r.doc_id: np.array(list(r)[1:], float) for r in L.statistics(docs).selectExpr("row.doc_id", *[f"cast({e} as double) AS f{k}" for k, e in enumerate(L.FEATURES.values())]).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = registry.op9_decision_lists(spark, d).collect()
    assert len(got) == len(texts) and rules
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        rejected = any(x.matches(features[r.doc_id][None, :], list(L.FEATURES))[0] for x in rules)
        assert r.kept == (not want[5] and not rejected)


def test_repeated_labels_ids_and_long_texts(spark):
    """Of several labels of one doc_id the lowest counts, of several texts the one of least hash; a long text is judged whole."""
    good, bad = "plain words stand here in a row and say a thing " * 8, "## $$ %% && ** <> || # $ % & * " * 20
    rows = [(i, good + str(i)) for i in range(40)] + [(100 + i, bad + str(i)) for i in range(40)]
    labels = [(i, 1) for i in range(40)] + [(100 + i, q) for i in range(40) for q in (0, 1)] + [(100, 0)] * 3
    docs = spark.createDataFrame(rows + rows[:5] + [(None, good), (7, "another text of seven")], "doc_id long, text string")
    made = lambda own: [str(r) for r in L.fitted(own, spark.createDataFrame(labels, "doc_id long, quality int"))]
    rules = L.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and made(docs) == made(docs.repartition(5)) == [str(r) for r in rules]
    long = spark.createDataFrame([(1, "word and other things " * 100_000), (2, bad * 3000)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.judged(long, []).select("row.doc_id", "row.text", *L.STATS[:5], "base_failed").collect()}
    assert all(tuple(r)[2:] == brute(r.text) for r in got.values())


def test_columns_equal_rules(spark):
    rules = [L.Rule((("symbols_per_word", ">", 0.5),), 1, 1), L.Rule((("words", "<=", 3.0), ("upper_share", ">", 0.1)), 1, 1)]
    docs = spark.createDataFrame([(1, "a## b"), (2, "A b"), (3, "a b c d")], "doc_id long, text string")
    got = {r.doc_id: r.v for r in L.statistics(docs).select("row.doc_id", L.verdict(rules).alias("v")).collect()}
    assert got == {1: False, 2: False, 3: True}
    assert "symbols_per_word > 0.5" in str(rules[0])


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert L.fitted(docs, spark.createDataFrame([(None, 0), (1, None)], "doc_id long, quality int")) == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = registry.table(spark, d, "documents"), registry.table(spark, d, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    rules = L.fitted(docs, labels.where(~held))
    got = L.judged(docs.select("doc_id", "text"), rules).select("row.doc_id", "base_failed", "kept").join(labels.where(held), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    print(n, *rules, sep="\n")
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]
