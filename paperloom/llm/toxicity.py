"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled documents, 3,000 of either label at most, without near copies of each other (which would
make any rare word of theirs look telling). Terms are lower-cased words and their beginnings of four and of six characters: all that
the examples have, none is left out. A text is the vector of (1 + ln tf) * idf * d of its terms, at length one: idf with the
document frequencies of all documents; d = g / (g + 20), g being the G-squared of the term and the labels in the examples, weighs
down what the labels do not depend on (plain TF-IDF finds only half of the toxic documents, see the README).

The 15 nearest examples by cosine are found exactly. The few terms that very many examples have are columns of a matrix; for all
others blocks of 256 examples keep the greatest weight of each term and its postings. An example's cosine is at least its sum over
the matrix; a block's bound is the greatest of these in it plus the sum of its greatest weights, and a block with a bound below
the fifteenth least value is left out. Votes are weighted by 1 / (1.05 - cosine); isotonic regression over the examples' own votes
(each left out of its neighbours), weighted to the labels' shares, makes them probabilities. All neighbours are the evidence.

Null and empty texts, and those without any of the terms, have no neighbour and get the share of toxic ones among such examples; of
equal cosines the earlier example is nearer; equal texts get equal scores; of several texts with a labelled doc_id that with the
least hash is the example, of several labels the highest counts; without examples of both labels every score is the share of toxic
labels, or 0; a very long text is worked on as one block; an empty table gives none; all columns are passed on inside `row`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import _bytes as B
from paperloom.llm._shared import bounded_batches, kept
from paperloom.llm.order_minhash import SEEDS, shingles

#: Examples of each label, at most.
EXAMPLES = 3_000
NEIGHBOURS, BLOCK = 15, 256
#: G-squared of a term that counts by half.
HALF = 20.0
#: Terms that are columns of the matrix, at most, and the share of examples they have at least; texts that are scored at once.
COMMON, COMMON_SHARE, TEXTS = 1024, 0.01, 128
THRESHOLD = 0.7
STEMS = (4, 6)
IS_WORD = B.table(lambda b: 0x41 <= b < 0x5B or 0x61 <= b < 0x7B or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b < 0x5B else b for b in range(256)], np.uint8)


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lower-cased bytes: (text, word, count) of the distinct words of each text, and a start and an end of each word."""
    starts, ends, first = B.word_spans(buf, offs, IS_WORD)
    index, inverse = B.distinct(buf, starts, ends)
    key, count = np.unique(np.repeat(np.arange(len(offs) - 1), np.diff(first)) * max(len(index), 1) + inverse, return_counts=True)
    return key // max(len(index), 1), key % max(len(index), 1), count, starts[index], ends[index]


class Terms:
    """Numbers of words and of beginnings of words."""

    def __init__(self, words: list[bytes]):
        """words: distinct ones, of which the terms are taken."""
        self.words = B.Vocabulary(sorted(words))
        self.stems = B.Vocabulary(sorted({s[:n].encode() for w in words for s in (w.decode(),) for n in STEMS if len(s) >= n}))

    def __len__(self) -> int:
        return len(self.words) + len(self.stems)

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each word, a column for it and for each length of its beginnings; -1 where there is none or it is not known."""
        out = np.full((len(starts), 1 + len(STEMS)), -1, np.int64)
        out[:, 0] = self.words.numbers(buf, starts, ends)
        begins = (buf & 0xC0) != 0x80
        points, at = np.concatenate([[0], np.cumsum(begins)]), np.append(np.flatnonzero(begins), len(buf))
        for k, n in enumerate(STEMS, 1):
            to = at[np.minimum(points[starts] + n, len(at) - 1)]
            long = np.flatnonzero(to <= ends)
            long = long[points[ends[long]] - points[starts[long]] >= n]
            found = self.stems.numbers(buf, starts[long], to[long])
            out[long, k] = np.where(found >= 0, found + len(self.words), -1)
        return out

    def counts(self, owner: np.ndarray, word: np.ndarray, count: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), in order, of (text, word, count); numbers: of the words' terms."""
        terms = numbers[word]
        known = terms >= 0
        key = (owner[:, None] * len(self) + terms)[known]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], np.broadcast_to(count[:, None], terms.shape)[known][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[first] // max(len(self), 1), key[first] % max(len(self), 1), np.add.reduceat(weight, first) if len(first) else first

    def of_texts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = LOWER[buf]
        owner, word, count, starts, ends = words_of(low, offs)
        return self.counts(owner, word, count, self.numbers(low, starts, ends))


def unit(weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """weights of texts, from bound to bound, at length one."""
    if not len(weights):
        return weights
    total = np.concatenate([[0], np.cumsum(weights * weights)])
    length = np.repeat(np.sqrt(np.maximum(np.diff(total[bounds]), 0)), np.diff(bounds))
    return np.divide(weights, length, out=np.zeros_like(weights), where=length > 0)


class Examples:
    """An inverted index of examples with the greatest weight of each term in each block of BLOCK of them."""

    def __init__(self, names: list, toxic: np.ndarray, factor: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, prior: float):
        """bounds: of each example in terms and counts, one more at the end; factor: of each term."""
        self.names, self.toxic, self.factor, self.bounds, self.terms, self.prior = names, toxic, factor, bounds, terms, prior
        self.values = unit(self.weights(terms, counts), bounds)
        self.vocabulary: Terms | None = None

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.factor[terms]

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("names", "toxic", "factor", "bounds", "terms", "prior", "values", "vocabulary")}

    def built(self) -> Examples:
        """With the index, which does not travel."""
        n, m = len(self.names), len(self.factor)
        self.blocks = max(1, -(-n // BLOCK))
        owner = np.repeat(np.arange(n), np.diff(self.bounds))
        often = np.bincount(self.terms, minlength=m)
        top = np.argsort(-often, kind="stable")[:COMMON]
        top = top[often[top] >= COMMON_SHARE * n]
        self.column = np.full(m, -1)
        self.column[top] = np.arange(len(top))
        common = self.column[self.terms] >= 0
        self.matrix = np.zeros((len(top), self.blocks * BLOCK))
        self.matrix[self.column[self.terms[common]], owner[common]] = self.values[common]
        terms, owner, values = self.terms[~common].astype(np.int64), owner[~common], self.values[~common]
        order = np.lexsort((owner, terms))
        self.place, self.value = owner[order], values[order]
        cell = terms[order] * self.blocks + self.place // BLOCK
        self.begin = np.zeros(m * self.blocks + 1, np.int32)  # of a term's postings in a block: a term's blocks side by side
        np.cumsum(np.bincount(cell, minlength=m * self.blocks), out=self.begin[1:])
        most = np.zeros(m * self.blocks, np.float32)
        first = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0])) if len(order) else np.zeros(0, np.int64)
        if len(first):  # rounded up
            most[cell[first]] = np.nextafter(np.maximum.reduceat(self.value, first).astype(np.float32), np.float32(2))
        self.most = most.reshape(m, self.blocks)
        return self

    def nearest(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """For each text, from bound to bound in terms and weights, (cosine, example) of the k nearest that share a term, exactly.
        without: the example that each text is, which does not count."""
        if not hasattr(self, "blocks"):
            self.built()
        out: list[list[tuple[float, int]]] = []
        column = self.column[terms]
        for low in range(0, len(bounds) - 1, TEXTS):
            own = bounds[low : low + TEXTS + 1]
            part = slice(own[0], own[-1])
            text = np.repeat(np.arange(len(own) - 1), np.diff(own))
            queries = np.zeros((len(own) - 1, len(self.matrix)))
            common = column[part] >= 0
            queries[text[common], column[part][common]] = weights[part][common]
            sums = queries @ self.matrix
            tops = sums.reshape(len(own) - 1, self.blocks, -1).max(axis=2, initial=0)
            for i in range(len(own) - 1):
                mine = slice(own[i], own[i + 1])
                rare = column[mine] < 0
                out.append(self._best(sums[i], tops[i], terms[mine][rare], weights[mine][rare], k, -1 if without is None else int(without[low + i])))
        return out

    def _best(self, sums: np.ndarray, tops: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        """sums over the matrix, which are least values of the cosines; tops: their greatest by block."""
        bound = tops + weights.astype(np.float32) @ self.most[terms]
        have = np.delete(sums, without) if without >= 0 else sums
        least = float(np.partition(have, len(have) - k)[len(have) - k]) if len(have) >= k else 0.0
        open_ = np.flatnonzero((bound > 0) & (bound >= least - 1e-4))
        if not len(open_):
            return []
        cells = (terms[:, None] * self.blocks + open_).ravel()
        first = self.begin[cells]
        size = self.begin[cells + 1] - first
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        total = sums.copy()
        if len(at):
            total += np.bincount(self.place[at], np.repeat(np.repeat(weights, len(open_)), size) * self.value[at], len(total))
        if without >= 0:
            total[without] = 0
        total = np.round(total, 9)
        least = max(np.partition(total, len(total) - k)[len(total) - k], 1e-9) if len(total) >= k else 1e-9
        found = np.flatnonzero(total >= least)
        order = np.lexsort((found, -total[found]))[:k]
        return list(zip(total[found[order]].tolist(), found[order].tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = np.array([1 / (1.05 - min(s, 1.0)) for s, _ in near])
        return float((w * self.toxic[[i for _, i in near]]).sum() / w.sum())


@dataclass
class Model:
    """Examples as they are sent to tasks, and what makes votes probabilities: knots of isotonic regression, the score of texts without neighbours."""

    examples: Examples
    sent: Broadcast
    scale: tuple[np.ndarray, np.ndarray]
    lone: float

    def score(self, near: list[tuple[float, int]], examples: Examples) -> float:
        if not near:
            return self.lone
        x, y = self.scale
        return float(np.interp(examples.vote(near), x, y)) if len(x) else examples.prior

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "examples"}  # tasks take them from what was sent


def _votes(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of examples, each left out of its neighbours; null without any."""
    examples: Examples = sent.value
    for batch in batches:
        own = batch.column(0).to_numpy()
        at = np.concatenate([np.arange(examples.bounds[i], examples.bounds[i + 1]) for i in own])
        bounds = np.concatenate([[0], np.cumsum(examples.bounds[own + 1] - examples.bounds[own])])
        near = examples.nearest(bounds, examples.terms[at], examples.values[at], without=own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([examples.vote(x) if x else None for x in near], pa.float64())], names=["id", "vote"])


def calibrated(spark: SparkSession, examples: Examples, share: float) -> Model:
    """share: of toxic labels among all that examples were drawn from."""
    sent, toxic = spark.sparkContext.broadcast(examples), examples.toxic  # bounded by EXAMPLES
    n1, n = int(toxic.sum()), len(toxic)
    model = Model(examples, sent, (np.zeros(0), np.zeros(0)), examples.prior)
    if not 0 < n1 < n:
        return model
    weight = np.where(toxic, share / n1, (1 - share) / (n - n1))
    found = sorted(spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(partial(_votes, sent=sent), "id long, vote double").collect())
    lone = np.array([r.vote is None for r in found])
    if lone.any():
        model.lone = float((weight * toxic)[lone].sum() / weight[lone].sum())
    model.scale = isotonic(np.array([r.vote for r in found if r.vote is not None]), toxic[~lone].astype(float), weight[~lone])
    return model


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing fit of y by x, by pooling adjacent violators."""
    if not len(x):
        return np.zeros(0), np.zeros(0)
    values, at = np.unique(x, return_inverse=True)
    weight, total = np.bincount(at, w), np.bincount(at, w * y)
    pools: list[list[float]] = []
    for i in range(len(values)):
        pools.append([total[i], weight[i], values[i], values[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, v, _, high = pools.pop()
            pools[-1][0] += t
            pools[-1][1] += v
            pools[-1][3] = high
    return np.array([e for p in pools for e in p[2:]]), np.array([p[0] / p[1] for p in pools for _ in range(2)])


def training_row(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from; the others are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) != 1, F.lit(True))


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, joined by line feeds, and their counts."""
    for batch, buf, offs in B.blocks(batches):
        low = LOWER[buf]
        owner, word, count, starts, ends = words_of(low, offs)
        data, bounds = low.tobytes(), np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
        names = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        joined = [b"\n".join(names[i] for i in word[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
        counts = [count[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "toxic", "words", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Texts with each term; term -1 counts all."""
    terms: Terms = vocabulary.value
    n = np.zeros(len(terms) + 1, np.int64)
    for batch, buf, offs in B.blocks(batches):
        n[0] += batch.num_rows
        n[1:] += np.bincount(terms.of_texts(buf, offs)[1], minlength=len(terms))
    some = np.flatnonzero(n)
    for low in range(0, len(some), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array((some[low : low + (1 << 16)] - 1).astype(np.int32)), pa.array(n[some[low : low + (1 << 16)]])], names=["term", "n"])


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offs in B.blocks(batches):
        labelled, bounds = shingles(buf, offs)
        own = [labelled[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        least = [[int((x * seed).min().view(np.int64)) for seed in SEEDS[:3]] if len(x) else [] for x in own]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "least"])


def _apart(rows: list) -> list[int]:
    """doc_ids, ascending, of which none has a least shingle of an earlier one."""
    seen: set = set()
    out = []
    for doc_id, least in sorted((r.doc_id, r.least) for r in rows):
        keys = set(enumerate(least)) or {()}
        if not keys & seen:
            out.append(doc_id)
        seen |= keys
    return out


def dependence(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G-squared of terms that pos of n1 and neg of n0 examples have, as g / (g + HALF)."""
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-12)), 0)
    n, m = n1 + n0, pos + neg
    g = 2 * (part(pos, m * n1 / n) + part(neg, m * n0 / n) + part(n1 - pos, (n - m) * n1 / n) + part(n0 - neg, (n - m) * n0 / n))
    return np.maximum(g, 0) / (np.maximum(g, 0) + HALF)


def _terms_of(rows: list) -> tuple[Terms, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of examples, and (example, term, count), in order."""
    words = sorted({w for r in rows if r.words for w in r.words.split(b"\n")})
    places, terms = {w: i for i, w in enumerate(words)}, Terms(words)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    numbers = terms.numbers(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros((0, 1 + len(STEMS)), np.int64)
    found: list[tuple] = [(np.zeros(0, np.int32),) * 3]
    for low in range(0, len(rows), 256):  # few at a time, as the driver's memory is small
        own = [r.words.split(b"\n") if r.words else [] for r in rows[low : low + 256]]
        owner = np.repeat(np.arange(low, low + len(own)), [len(x) for x in own])
        word = np.fromiter((places[w] for x in own for w in x), np.int64, len(owner))
        count = np.frombuffer(b"".join(r.counts for r in rows[low : low + 256]), "<i4")
        found.append(tuple(x.astype(np.int32) for x in terms.counts(owner, word, count, numbers)))
    return terms, *(np.concatenate(x) for x in zip(*found, strict=True))


def fitted(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model:
    """The examples of labels (doc_id, toxic 0 or 1) in training rows. Labels without a doc_id or a mark do not count."""
    context = docs.sparkSession.sparkContext
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(training_row())
    known = kept(known.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")), "labels")
    m0, m1 = known.agg(F.count_if(~F.col("toxic")), F.count_if("toxic")).first()
    share = m1 / max(m0 + m1, 1)
    drawn = [known.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for mark in (False, True)]
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")  # at most 2 * most rows of 9 bytes
    sample = kept(found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("doc_id", "toxic", "m.text"), "examples")
    apart = _apart(sample.select("doc_id", "text").mapInArrow(_least_shingles, "doc_id long, least array<long>").collect())  # of the bounded sample
    sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in apart], "doc_id long")), "doc_id")
    rows = sorted(sample.select("doc_id", "toxic", "text").mapInArrow(_example_words, "doc_id long, toxic boolean, words binary, counts binary").collect())
    toxic = np.array([r.toxic for r in rows], bool)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    terms, owner, own_terms, counts = _terms_of(rows)
    pos, neg = (np.bincount(own_terms[toxic[owner] == mark], minlength=len(terms)).astype(float) for mark in (True, False))
    weight = dependence(pos, neg, n1, n0) if n1 and n0 else np.zeros(len(terms))
    df = np.zeros(len(terms) + 1)  # of all documents
    if n1 and n0:
        spread = texts.select("text").coalesce(max(1, 4 * context.defaultParallelism))  # each task gives a row for each term
        for r in spread.mapInArrow(partial(_frequencies, vocabulary=context.broadcast(terms)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_batches():
            df[r.column(0).to_numpy() + 1] = r.column(1).to_numpy()
    factor = (np.log((1 + df[0]) / (1 + df[1:])) + 1) * weight
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
    # alike ones share blocks: by the frequent term that a text has most of (such as an article of its language), and what weighs most
    often = np.bincount(own_terms, minlength=len(terms))
    frequent = np.where(often >= 0.1 * len(rows), np.log((1 + len(rows)) / (1 + often)), 0.0)
    heavy = [tuple(int(t[x.argmax()]) for x in (c * frequent[t], factor[t])) if len(t) else () for t, c in ((own_terms[a:b], counts[a:b]) for a, b in zip(bounds, bounds[1:], strict=False))]
    order = sorted(range(len(rows)), key=lambda i: (heavy[i], rows[i].doc_id))
    at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in order]).astype(np.int64) if order else np.zeros(0, np.int64)
    made = Examples([rows[i].doc_id for i in order], toxic[order], factor, np.concatenate([[0], np.cumsum([bounds[i + 1] - bounds[i] for i in order], dtype=np.int64)]).astype(np.int64), own_terms[at], counts[at], share)
    made.vocabulary = terms
    return calibrated(docs.sparkSession, made, share)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[pa.RecordBatch]:
    examples: Examples = model.sent.value
    seen: dict[bytes, tuple[float, list]] = {}
    unrowed = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(text)], names=["row", "text"]) for b in batches)
    for batch, buf, offs in B.blocks(unrowed):
        docs, terms, counts = examples.vocabulary.of_texts(buf, offs)
        bounds = np.searchsorted(docs, np.arange(batch.num_rows + 1))
        keys = [blake2b(terms[a:b].tobytes() + counts[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        if len(seen) > 5_000:
            seen.clear()
        new = list({key: i for i, key in enumerate(keys) if key not in seen}.values())
        if new:
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in new])
            own = np.concatenate([[0], np.cumsum(bounds[np.array(new) + 1] - bounds[new])])
            for i, near in zip(new, examples.nearest(own, terms[at], unit(examples.weights(terms[at], counts[at]), own)), strict=True):
                seen[keys[i]] = min(1.0, max(0.0, model.score(near, examples))), [{"doc_id": examples.names[e], "cosine": s, "toxic": bool(examples.toxic[e])} for s, e in near]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([seen[x][0] for x in keys], pa.float64()), pa.array([seen[x][1] for x in keys], EVIDENCE_ARROW)], names=["row", "score", "evidence"])


EVIDENCE_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.bool_())]))
EVIDENCE_TYPE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.BooleanType())]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row, score (0 to 1), evidence (the nearest examples, nearest first)."""
    rows = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("evidence", EVIDENCE_TYPE)])
    return rows.mapInArrow(partial(_scored, model=model, text=docs.columns.index("text")), schema)
