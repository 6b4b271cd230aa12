"""Audit of sources: how far the words of the sources of a language are from each other, and which words set one apart.

A language keeps the terms that enough of its documents have. Every source of it, and the language as a whole, gives each kept term
a share in billionths, smoothed by two; two shares p and q are (p - q)^2 / (p + q) apart. All of it is whole numbers.

The pairs of sources are a cube: its axes are blocks of sources, blocks of sources again, and blocks of terms. A task owns a cell, gets
the two slices (a block of sources, a block of terms) that it compares, and gives its part of each pair's sum; slices are repeated for
every block that they meet, and the parts are summed along the axis of terms. A pair that lacks a term still has two shares of it: what
neither slice names is counted, not stored.

Null text, language and source count as empty. Sources without a kept term, and languages with none, have pairs too (of value 0 if
nothing is kept). Repeated rows are documents of their own; ties are broken by the item's bytes. A very long text is worked on as
one block, of several times its size. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import _bytes as B
from paperloom.llm._shared import bounded_batches, kept

#: Documents of a language that must have a term; terms of a source that are reported.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Sources and terms of a block, about: both are dealt by hash.
SOURCES, TERMS = 8, 1024
#: Distinct terms of sources that a task counts before it hands them on.
ENTRIES = 1 << 20
#: Rows of languages or sources that are broadcast, at most.
FEW = 100_000
SHARE = 1_000_000_000
LETTER = B.table(lambda b: 0x41 <= b < 0x5B or 0x61 <= b < 0x7B or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b < 0x5B else b for b in range(256)], np.uint8)


class Counts:
    """How often terms occur in sources, and in how many of their documents."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.key, self.n, self.docs = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, groups: list[tuple[str, str]], buf: np.ndarray, offs: np.ndarray) -> None:
        text = LOWER[buf]
        starts, ends, first = B.word_spans(text, offs, LETTER)
        of = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        index, inverse = B.distinct(text, starts, ends)
        data = text.tobytes()
        number = np.array([self.terms.setdefault(data[a:b], len(self.terms)) for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)], np.int64)
        owner = np.repeat(np.arange(len(groups)), np.diff(first))
        pairs, n = np.unique(owner << 32 | number[inverse] if len(owner) else owner, return_counts=True)
        self.waiting.append((of[pairs >> 32] << 32 | pairs & 0xFFFFFFFF, n))
        self.held += len(n)
        if self.held > ENTRIES:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.key, *(k for k, _ in self.waiting)])
        n = np.concatenate([self.n, *(n for _, n in self.waiting)])
        docs = np.concatenate([self.docs, *(np.ones(len(n), np.int64) for _, n in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        edge = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
        self.key = keys[edge]
        self.n, self.docs = (np.add.reduceat(x[order], edge) if len(edge) else x for x in (n, docs))
        self.waiting, self.held = [], 0

    def full(self) -> bool:
        return len(self.key) > ENTRIES or len(self.terms) > ENTRIES

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The groups themselves have a null term."""
        self.merge()
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        none = pa.array(np.zeros(len(langs), np.int64))
        names = ["lang", "source", "term", "n", "docs"]
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(langs), pa.string()), none, none], names=names)
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        for at in range(0, len(self.key), 1 << 16):
            key = self.key[at : at + (1 << 16)]
            group, term = pa.array(key >> 32), pa.array(key & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), pa.array(self.n[at : at + len(key)]), pa.array(self.docs[at : at + len(key)])], names=names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch, buf, offs in B.blocks(batches):
        counts.add(list(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)), buf, offs)
        if counts.full():
            yield from counts.rows()
            counts = Counts()
    yield from counts.rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); each group has a row of null term besides."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = bounded_batches(docs).select(empty("lang"), empty("source"), F.col("text").cast("string").alias("text")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, whole: Column) -> Column:
    """1 + floor(SHARE * (n + 2) / whole); beyond what a long holds in between."""
    return F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(SHARE).cast("decimal(10,0)"), whole.cast("decimal(19,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def small(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table, which is broadcast where it has few rows, so that a language or source with most terms is no large partition."""
    table = kept(rows, name)
    return F.broadcast(table) if table.count() <= FEW else table


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _cell(table: pa.Table) -> pa.Table:
    """Parts of the sums of all pairs of a cell: a row of null term for each source names it, its share of terms that it lacks, and the
    terms of the block; the others are shares."""
    lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    heads = table.filter(pc.is_null(table.column("term"))).sort_by("source")
    own = table.filter(pc.is_valid(table.column("term")))
    sources, block = heads.column("source").to_pylist(), heads.column("block").to_numpy()
    lacks, n_terms = heads.column("p").to_numpy(), int(heads.column("n_terms")[0].as_py())
    coded = own.column("term").combine_chunks().dictionary_encode()
    place = {s: k for k, s in enumerate(sources)}
    shares = np.repeat(lacks[:, None], len(coded.dictionary), axis=1)
    shares[np.array([place[s] for s in own.column("source").to_pylist()], np.int64), coded.indices.to_numpy(zero_copy_only=False)] = own.column("p").to_numpy()
    unnamed = n_terms - shares.shape[1]
    ones, others, values = [], [], []
    for i in range(len(sources)):
        to = np.flatnonzero(block == b) if block[i] == a else np.zeros(0, np.int64)
        to = to[to > i] if a == b else to
        if len(to):
            ones += [sources[i]] * len(to)
            others += [sources[j] for j in to]
            values.append(_apart(shares[i], shares[to]).sum(axis=1) + _apart(lacks[i], lacks[to]) * unnamed)
    value = np.concatenate([*values, np.zeros(0, np.int64)])
    return pa.table({"lang": pa.array([lang] * len(ones), pa.string()), "one": pa.array(ones, pa.string()), "other": pa.array(others, pa.string()), "value": value})


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: item is another source of the language and value how far it is, summed over
    terms; part term: item is a term that is more frequent in the source than in its language, the top_terms farthest."""
    counts = kept(term_counts(docs), "counts")
    named = counts.where("term IS NOT NULL")
    known = named.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs).select("lang", "term", "total")
    entries = kept(named.join(known, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "entries")
    groups = counts.where("term IS NULL").select("lang", "source")

    of_source = entries.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    of_lang = known.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / sources).cast("int").alias("n_blocks"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    langs = small(blocks.join(of_lang, "lang", "left").select("lang", "n_blocks", count("v").alias("v"), (count("all") + 2 * count("v")).alias("lang_whole"), F.greatest(F.ceil(count("v") / terms), F.lit(1)).cast("int").alias("n_slices")), "langs")
    sized = groups.join(of_source, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", (count("own") + 2 * F.col("v")).alias("whole"), "lang_whole", "n_blocks", "n_slices", F.pmod(F.xxhash64("source"), "n_blocks").cast("int").alias("block"))
    sized = small(sized, "sources")

    shares = entries.join(sized, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("whole")))
    to_lang = shares.withColumn("q", share(F.col("total"), F.col("lang_whole"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = to_lang.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    slice_of = F.pmod(F.xxhash64("term"), "n_slices").cast("int")
    in_slice = known.join(langs.select("lang", "n_slices"), "lang").groupBy("lang", slice_of.alias("slice")).agg(F.count("*").alias("n_terms"))
    lacks = F.when(F.col("whole") > 0, share(F.lit(0), F.greatest("whole", F.lit(1)))).otherwise(0)
    heads = sized.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1))).join(in_slice, ["lang", "slice"], "left")
    columns = ("lang", "source", "block", "n_blocks", "slice", "term", "p", "n_terms")
    rows = shares.withColumns({"slice": slice_of, "n_terms": F.lit(None).cast("long")}).select(*columns).unionByName(heads.withColumns({"term": F.lit(None).cast("string"), "p": lacks, "n_terms": count("n_terms")}).select(*columns))
    meets = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    cells = meets.select("lang", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "slice", "source", "block", "term", "p", "n_terms")
    parts = cells.groupBy("lang", "a", "b", "slice").applyInArrow(_cell, "lang string, one string, other string, value long")
    sums = parts.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(top)
