"""Benchmark decontamination by an FM-index of each shard of the documents.

Documents become sequences of word numbers over the benchmark's vocabulary. A word outside of it can be in no occurrence, so it
only separates: the index of a shard is over the runs between such words, each closed by a separator. Windows of the benchmark
are searched backward, all at once, through ranks in a wavelet matrix of the Burrows-Wheeler transform; occurrences are located
by walking to the next sampled suffix; the words they cover are merged to spans. Documents are dealt as they are read and never
split, so nothing is shuffled. The benchmark is read in blocks of bounded size, each a file in the shared folder.

A word of a document is found in the vocabulary by a hash and its bytes. A window with a word that the shard has not is not
searched for. A very long text is a shard of its own, with an index as long as its words. Null or empty texts have no words and no hits; items without a
word have no window; item_ids that are null are searched but not named; repeated rows each get their row; an empty benchmark
finds nothing, and an empty table of documents gives none; equal windows of several items are found for each of them. All columns of the documents are passed on inside `row`, so their names cannot clash.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import _bytes as B
from paperloom.llm._shared import Ranges, bounded_batches, new_folder, write_whole

WINDOW = 13
#: Characters of benchmark texts that are searched for at once.
BLOCK_CHARS = 8 << 20
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
SAMPLE = 8
IS_WORD = B.table(lambda b: 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b < 0x5B else b for b in range(256)], np.uint8)
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Bits:
    """Ones before a place: a count for each 64-bit word and the bits of one word."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        data = np.packbits(bits, bitorder="little")
        self.words.view("u1")[: len(data)] = data
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, most: int):
        self.shifts = range(max(1, int(most).bit_length()) - 1, -1, -1)
        self.levels = []
        for s in self.shifts:
            bits = (values >> s) & 1 == 1
            self.levels.append(Bits(bits))
            values = np.concatenate([values[~bits], values[bits]])
        every = np.arange(most + 1)
        self.first = self._down(every, np.zeros_like(every))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for s, level in zip(self.shifts, self.levels, strict=True):
            ones = level.ones(i)
            i = np.where((symbols >> s) & 1 == 1, level.zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is before place i."""
        return self._down(symbols, i) - self.first[symbols]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i and how often it is before."""
        symbol = np.zeros_like(i)
        for level in self.levels:
            bit, ones = level.at(i).astype(bool), level.ones(i)
            symbol = symbol * 2 + bit
            i = np.where(bit, level.zeros + ones, i - ones)
        return symbol, i - self.first[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by doubling the length that is compared; each 0 is a separator of its own, below all symbols."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, int(zero.sum()) + text.astype(np.int64))
    step = 0
    while True:
        key = rank
        if step:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step = max(1, 2 * step)
        if step >= n:
            return order


class FMIndex:
    """Over a sequence of symbols from 1 to most, with 0 as a separator and at its end."""

    def __init__(self, text: np.ndarray, most: int, sample: int = SAMPLE):
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletMatrix(text[order - 1].astype(np.int64), most)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))[:-1]])
        sampled = (order % sample == 0) | (text[order - 1] == 0)
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of suffixes that begin with each pattern, from and to."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        active = np.flatnonzero(lengths > 0)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            active = active[(lengths[active] >= step) & (low[active] < high[active])]
            if not len(active):
                break
            symbols = patterns[active, lengths[active] - step]
            low[active], high[active] = (self.below[symbols] + self.tree.rank(symbols, x[active]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        places, walked, open_ = np.empty_like(rows), 0, np.arange(len(rows))
        while len(open_):
            done = self.sampled.at(rows).astype(bool)
            places[open_[done]] = self.samples[self.sampled.ones(rows[done])] + walked
            open_, rows, walked = open_[~done], rows[~done], walked + 1
            symbols, ranks = self.tree.symbol_and_rank(rows)
            rows = self.below[symbols] + ranks
        return places


@dataclass
class Phrases:
    """What tasks need of some items: the vocabulary, the distinct windows as symbols (a word's number and one, 0 after the end), and the ids of each window's items."""

    vocabulary: B.Vocabulary
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    def packed(self) -> bytes:
        out = io.BytesIO()
        sizes = np.array([len(w) for w in self.vocabulary.words], np.int64)
        np.savez(out, words=np.frombuffer(b"".join(self.vocabulary.words), np.uint8), sizes=sizes, patterns=self.patterns, lengths=self.lengths, items=np.frombuffer(json.dumps(self.items).encode(), np.uint8))
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Phrases:
        with np.load(io.BytesIO(data), allow_pickle=False) as x:
            flat, ends = x["words"].tobytes(), np.cumsum(x["sizes"]).tolist()
            words = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            return cls(B.Vocabulary(words), x["patterns"], x["lengths"], json.loads(x["items"].tobytes()))


def phrases(items: list[tuple], window: int = WINDOW) -> Phrases:
    """Of items (id, text)."""
    words: dict[bytes, int] = {}
    found: dict[tuple, set] = {}
    for name, text in items:
        own = [words.setdefault(w, len(words) + 1) for w in WORDS.findall((text or "").encode().translate(LOWER.tobytes()))]
        for i in range(max(1, len(own) - window + 1)) if own else ():
            found.setdefault(tuple(own[i : i + window]), set()).update([] if name is None else [str(name)])
    patterns = np.zeros((len(found), window), np.int32)
    for i, k in enumerate(found):
        patterns[i, : len(k)] = k
    return Phrases(B.Vocabulary(list(words)), patterns, np.array([len(k) for k in found], np.int64), [sorted(v) for v in found.values()])


@lru_cache(maxsize=1)
def _loaded(path: str) -> Phrases:
    source = Ranges(path)
    try:
        return Phrases.unpacked(source.read(0, source.size))
    finally:
        source.close()


def occurrences(symbols: np.ndarray, docs: np.ndarray, what: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols of a shard's words (0: not in the vocabulary), docs: number of the first word of each document, one more at the end. Arrays of first word, window, length."""
    none = np.zeros(0, np.int64)
    there = np.zeros(len(what.vocabulary) + 1, bool)
    there[symbols] = there[0] = True
    wanted = np.flatnonzero(there[what.patterns].all(axis=1))
    if not len(symbols) or not len(wanted):
        return none, none, none
    first = np.zeros(len(symbols) + 1, bool)
    first[docs] = True
    known = symbols > 0
    begin = np.flatnonzero(known & (first[:-1] | ~np.concatenate([[False], known[:-1]])))
    end = np.flatnonzero(known & (first[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = end - begin >= what.lengths[wanted].min()
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none, none
    sizes = end - begin + 1  # with the separator
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(begin - starts, sizes) + np.arange(int(sizes.sum()))
    text = symbols[np.minimum(word, len(symbols) - 1)]
    text[starts + sizes - 1] = 0
    index = FMIndex(text, len(what.vocabulary))
    low, high = index.ranges(what.patterns[wanted], what.lengths[wanted])
    count = np.maximum(high - low, 0)
    window = np.repeat(wanted, count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return word[index.locate(rows)], window, what.lengths[window]


def _hits(batches: Iterator[pa.RecordBatch], paths: list[str], text: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    unrowed = ((pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(text)], names=["row", "text"])) for b in batches)
    for batch, buf, offs in B.blocks(unrowed, limit=SHARD_BYTES):
        buf = LOWER[buf]
        starts, ends, docs = B.word_spans(buf, offs, IS_WORD)
        cover, items = np.zeros(len(starts) + 1, np.int64), [set() for _ in range(batch.num_rows)]
        for path in paths:
            what = _loaded(path)
            at, window, length = occurrences(what.vocabulary.numbers(buf, starts, ends) + 1, docs, what)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            pairs = np.unique((np.searchsorted(docs, at, "right") - 1) * len(what.lengths) + window)
            for pair in pairs.tolist():
                items[pair // len(what.lengths)].update(what.items[pair % len(what.lengths)])
        hit = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[docs[1:]] - total[docs[:-1]]
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        if hit.any():
            points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            inner = np.zeros(len(hit) + 1, bool)
            inner[docs] = True
            a = np.flatnonzero(hit & (inner[:-1] | ~np.concatenate([[False], hit[:-1]])))
            b = np.flatnonzero(hit & (inner[1:] | ~np.concatenate([hit[1:], [False]])))
            owner = np.searchsorted(docs, a, "right") - 1
            for k, s, e in zip(owner.tolist(), points[starts[a]] - points[offs[owner]], points[ends[b]] - points[offs[owner]], strict=True):
                spans[k].append({"start": int(s), "end": int(e)})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(docs), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, schema.field("spans").type)], schema=pa.schema([pa.field("row", batch.column(0).type), *list(schema)]))


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document: row (all its columns), n_words, n_hit (words inside an occurrence), items (ids, sorted as strings,
    of which a window occurs) and spans (merged, in code points of text). benchmark: item_id, text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    asked = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n, folder, paths = max(1, -(-chars // block_chars)), new_folder(spark, "phrases"), []
    for k in range(n):
        block = asked.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else asked
        items = [tuple(r) for r in block.toLocalIterator()]
        if (what := phrases(items, window)).items:
            write_whole(f"{folder}/{k:06d}.npz", [what.packed()], 0)
            paths.append(f"{folder}/{k:06d}.npz")
    rows = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], *FOUND.fields])
    return rows.mapInArrow(partial(_hits, paths=paths, text=docs.columns.index("text"), schema=to_arrow_schema(FOUND)), schema)


def contaminated(share: int = 20):
    """The rule: at least one word in share is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def without_spans(text: str = "text", spans: str = "spans"):
    """The text without its spans, as an expression."""
    length = F.length(text)
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), F.array(length))
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substring(F.col(text), (F.get(edges, 2 * i) + 1).cast("int"), (F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)).cast("int")))
    return F.array_join(pieces, "")
