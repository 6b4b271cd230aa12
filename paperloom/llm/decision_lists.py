"""Quality rules as learned decision lists.

Statistics of whole texts are taken in one pass over the documents. Sequential covering then learns from labelled statistics: a
rule grows, threshold by threshold, on two thirds of the rows that are left, as long as its gain of information about rejects
rises; it is pruned, last condition first, on the other third; the rows it covers go, and the next rule begins. The rules become
one ordered conditional expression of Spark's, which is what decides about every document.

Words and lines count as equal by their bytes. Null or empty texts have zeros everywhere (and fail the base rule); equal rows each
get a row; of several texts with a labelled doc_id that with the least hash teaches, of several labels the lowest counts; of equal
gains the earlier feature and the lower threshold win; without labelled rows of both kinds no rule is learned and all that meet the
base rule are kept; a very long text is worked on as one block, of several times its size; an empty table gives none; all columns
of the documents are passed on inside `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import _bytes as B
from paperloom.llm._shared import bounded_batches

#: Labelled rows that rules are learned from, at most: those with the smallest hashes of doc_id.
FIT_ROWS = 20_000
#: A rule is kept if so many of the rows that it covers in the third it is pruned on are rejects.
PRECISION = 0.95
MOST_RULES, MOST_CONDITIONS, THRESHOLDS = 12, 4, 40
SPACE = B.table(lambda b: b == 0x20 or 0x09 <= b < 0x0E)
SYMBOL = B.table(lambda b: chr(b) in "#*$%&|<>")
UPPER = B.table(lambda b: 0x41 <= b < 0x5B)
LETTER = B.table(lambda b: 0x41 <= b < 0x5B or 0x61 <= b < 0x7B or b >= 0xC0)
DIGIT = B.table(lambda b: 0x30 <= b < 0x3A)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct_words")
#: What rules may ask about: name, as an expression of the statistics.
FEATURES = {
    "words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "distinct_word_power": "ln(greatest(n_distinct_words, 1)) / ln(greatest(n_words, 2))",  # hardly moves with length
}


def _per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _pairs_seen(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, key), in order of appearance: how many equal ones are in the document, and whether it is the first."""
    order = np.lexsort((keys, docs))
    same = (docs[order][1:] == docs[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else order
    count, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
    count[order] = np.bincount(group, minlength=1)[group] if len(order) else 0
    first[order] = np.concatenate([[True], ~same]) if len(order) else True
    return count, first


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers that are equal if and only if all three are."""
    base = int(max(a.max(initial=0), b.max(initial=0), c.max(initial=0))) + 1
    if base >= 1 << 21:  # a very long text: pairs are numbered first
        a, base = np.unique(a * base + b, return_inverse=True)[1], max(base, len(a) + 1)
        return a * base + c
    return (a * base + b) * base + c


def statistics_of(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of the texts in buf. Words: runs without ASCII white space; word_chars in code points."""
    n = len(offs) - 1
    point = (buf & 0xC0) != 0x80
    starts, ends, first = B.word_spans(buf, offs, ~SPACE)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n), n_words)
    words = B.distinct(buf, starts, ends)[1]  # equal numbers are equal words
    # windows of three words that are in the text at least twice cover their words
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    twice = at[_pairs_seen(owner[at], _triples(words[at], words[at + 1], words[at + 2]))[0] > 1]
    covered = np.zeros(len(owner), bool)
    for k in range(3):
        covered[twice + k] = True
    # lines: those with a word, equal to an earlier one
    line_starts, line_ends, line_first = B.word_spans(buf, offs, B.table(lambda b: b != 0x0A))
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))[with_word]
    later = ~_pairs_seen(line_owner, B.distinct(buf, line_starts[with_word], line_ends[with_word])[1])[1]
    distinct = _pairs_seen(owner, words)[1]
    last = buf[ends - 1] if len(ends) else buf[:0]
    return {
        "n_words": n_words,
        "word_chars": _per_document(point & ~SPACE[buf], offs),
        "n_symbols": _per_document(SYMBOL[buf], offs),
        "n_dup_lines": np.bincount(line_owner[later], minlength=n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n),
        "n_lines": np.bincount(line_owner, minlength=n),
        "n_upper": _per_document(UPPER[buf], offs),
        "n_letters": _per_document(LETTER[buf], offs),
        "n_digits": _per_document(DIGIT[buf], offs),
        "n_marks": np.bincount(owner[(last == 0x21) | (last == 0x3F)], minlength=n),
        "n_distinct_words": np.bincount(owner[distinct], minlength=n),
    }


def _statistics(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    unrowed = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(text)], names=["row", "text"]) for b in batches)
    for batch, buf, offs in B.blocks(unrowed):
        found = statistics_of(buf, offs)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k].astype(np.int64)) for k in STATS)], names=["row", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """row (all columns of docs) and STATS."""
    rows = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(k, T.LongType()) for k in STATS)])
    return rows.mapInArrow(partial(_statistics, text=docs.columns.index("text")), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions (feature, ">" or "<=", threshold). covered and rejects: in the rows it was pruned on."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    rejects: int

    def matches(self, rows: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for name, side, limit in self.conditions:
            value = rows[:, names.index(name)]
            out &= value > limit if side == ">" else value <= limit
        return out

    def column(self) -> Column:
        return F.expr(" AND ".join(f"({FEATURES[name]}) {side} {limit!r}D" for name, side, limit in self.conditions))

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{name} {side} {limit:.6g}" for name, side, limit in self.conditions) + f"  [{self.rejects}/{self.covered}]"


def _grown(rows: np.ndarray, bad: np.ndarray, names: list[str]) -> list[tuple[str, str, float]]:
    inside, conditions = np.ones(len(rows), bool), []
    while len(conditions) < MOST_CONDITIONS and (p0 := int(bad[inside].sum())) and p0 < (n0 := int(inside.sum())):
        best = (1e-9, None)
        for k, name in enumerate(names):
            values, y = rows[inside, k], bad[inside]
            order = np.argsort(values, kind="stable")
            values, up = values[order], np.cumsum(y[order])
            cuts = np.flatnonzero(values[1:] > values[:-1]) + 1
            if len(cuts) > THRESHOLDS:  # spread over the rejects, and over all rows
                ranks = np.linspace(0, len(cuts) - 1, THRESHOLDS).astype(int)
                wanted = np.searchsorted(up, np.linspace(1, p0, THRESHOLDS).astype(int))
                cuts = np.unique(np.concatenate([cuts[ranks], cuts[np.minimum(np.searchsorted(cuts, wanted), len(cuts) - 1)], cuts[np.maximum(np.searchsorted(cuts, wanted) - 1, 0)]]))
            for side in ("<=", ">"):
                p = up[cuts - 1] if side == "<=" else p0 - up[cuts - 1]
                n = cuts if side == "<=" else n0 - cuts
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - np.log2(p0 / n0)), -1)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (name, side, float((values[cuts[i] - 1] + values[cuts[i]]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],), 0, 0).matches(rows, names)
    return conditions


def learned(rows: np.ndarray, bad: np.ndarray, names: list[str], precision: float = PRECISION, seed: int = 7) -> list[Rule]:
    """Ordered rules for the rows where bad is true."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.arange(len(rows))
    while len(rules) < MOST_RULES and bad[left].sum() >= 5 and not bad[left].all():
        third = rng.permutation(len(left)) % 3 == 0
        grow, prune = left[~third], left[third]
        conditions = _grown(rows[grow], bad[grow], names)
        options = []
        for k in range(len(conditions), 0, -1):
            inside = Rule(tuple(conditions[:k]), 0, 0).matches(rows[prune], names)
            p, n = int(bad[prune][inside].sum()), int(inside.sum())
            options.append(((2 * p - n) / max(n, 1), p, -k, Rule(tuple(conditions[:k]), n, p)))
        good = [o for o in options if o[3].covered and o[3].rejects >= precision * o[3].covered]
        if not good:
            break
        rule = max(good, key=lambda o: o[:3])[3]
        rules.append(rule)
        left = left[~rule.matches(rows[left], names)]
    return rules


def fitted(docs: DataFrame, labels: DataFrame, most_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from documents with a label (doc_id, quality 0 or 1; 0 is a reject), at most most_rows labels. Labels without a
    doc_id or a quality do not count; of several for one doc_id the lowest does."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(sample), "doc_id")  # at most most_rows rows of 9 bytes
    found = statistics(labelled.groupBy("doc_id", "bad").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("doc_id", "bad", "m.text"))
    table = found.select("row.doc_id", F.col("row.bad").alias("bad"), *[F.expr(f"cast({e} as double)").alias(k) for k, e in FEATURES.items()])
    rows = sorted(map(tuple, table.collect()))
    if not rows:
        return []
    names = list(FEATURES)
    return learned(np.array([r[2:] for r in rows], float), np.array([r[1] for r in rows], bool), names)


def verdict(rules: list[Rule]) -> Column:
    """Whether a row of statistics is kept: the first rule that matches rejects it."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """row, STATS, base_failed, kept."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))
