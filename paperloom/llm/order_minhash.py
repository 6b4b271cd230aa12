"""Near duplicates by Order MinHash.

Texts of equal bytes are one node, so a group of copies is one row from the start. A node's shingles (five words) are labelled by
their occurrence; each of 32 sketches takes the four labelled shingles with the least hashes and keeps them in the order of the
text. Nodes with an equal sketch are candidates. A candidate pair is verified by banded alignment of its words: the longest chain
of equal labelled shingles in the order of both texts, no match further off the diagonal than a pair of the wanted similarity can
have, anchors the alignment; the words between two anchors, however many, are aligned by their longest common subsequence. Similarity
is the share of the longer text's words that are aligned, 0.8 or more; words are compared themselves, not by hash.

Nodes of a bucket are not paired off as rows. First each is compared with a central node (the one that shares most sketches with
others) of one of its buckets, that with which it shares most; links so found are joined to classes. Only buckets that still hold
several classes go on. They are dealt in blocks of at most 512 nodes, fewer of long texts, each pair of blocks to a task that
compares nodes of different classes there, a pair in the first bucket that it shares, until they are linked: no similar pair that
shares a sketch is left out, and what leaves a task are links that join classes. Texts of up to 64 shingles, where few can be
sampled, have twelve sketches of two more.

Null texts are empty; texts without a word are only grouped with equal ones; texts of fewer than five words have one shingle, of
all; a null doc_id is allowed, and is never the one that stays if a copy has an id; equal rows fall in one class, and so do rows of
one doc_id only if their texts are similar; a very long text is sketched as one block, in several times its size, and columns
other than doc_id and text may have any name; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import _bytes as B
from paperloom.llm._shared import bounded_batches, kept
from paperloom.llm.components import components

SHINGLE, SIMILARITY = 5, (4, 5)
SKETCHES, SAMPLED = 32, 4
SHORT, SHORT_SKETCHES, SHORT_SAMPLED = 64, 12, 2
#: Nodes of a bucket that are compared with as many others at once, and shingles of these; rows and shingles that go to one call.
BLOCK, BLOCK_SHINGLES, GROUP_ROWS, GROUP_SHINGLES = 512, 1 << 20, 4096, 1 << 23
#: Words of texts that a task remembers.
CACHED = 1 << 22
NO_ID = -(1 << 63)
IS_WORD = B.table(lambda b: not (b == 0x20 or 0x09 <= b < 0x0E))
LOWER = np.array([b + 32 if 0x41 <= b < 0x5B else b for b in range(256)], np.uint8)
SEEDS = B.mixed(np.arange(1, SKETCHES + SHORT_SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
ODD = np.uint64(0xD6E8FEB86659FD93)


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles of all texts in order, and where each text's begin."""
    buf = LOWER[buf]
    starts, ends, first = B.word_spans(buf, offs, IS_WORD)
    words = B.span_hashes(buf, starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(first[:-1], n)
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            inside = at + k < first[owner + 1]
            word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else value
            value = np.where(inside, B.mixed(value * ODD + word), value)
        order = np.lexsort((value, owner))
        new = np.ones(len(order), bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
        occurrence = np.empty(len(order), np.uint64)
        occurrence[order] = (np.arange(len(order)) - begin).astype(np.uint64)
        return B.mixed(value + occurrence * ODD), bounds


def sketch(labelled: np.ndarray) -> np.ndarray:
    """The sketches of one text: numbers that texts share where the sampled shingles and their order are the same."""
    out = []
    plans = [(0, SKETCHES, SAMPLED)] + [(SKETCHES, SKETCHES + SHORT_SKETCHES, SHORT_SAMPLED)] * (len(labelled) <= SHORT)
    some = max(1, (1 << 18) // max(len(labelled), 1))  # sketches at once, fewer of a long text
    with np.errstate(over="ignore"):
        for low, high, sampled in ((x, min(x + some, high), sampled) for low, high, sampled in plans for x in range(low, high, some)):
            seeds = SEEDS[low:high, None]
            if len(labelled) > sampled:
                taken = np.argpartition(labelled[None, :] * seeds, sampled - 1, axis=1)[:, :sampled]
                values = labelled[np.sort(taken, axis=1)]
            else:
                values = np.broadcast_to(labelled, (high - low, len(labelled)))
            key = seeds[:, 0].copy()
            for column in values.T:
                key = B.mixed(key * ODD + column)
            out.append(key)
    return np.concatenate(out)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offs in B.blocks(batches):
        labelled, bounds = shingles(buf, offs)
        done: dict[bytes, np.ndarray] = {}
        out = []
        for k, key in enumerate(batch.column(0).to_pylist()):
            if key not in done:
                own = labelled[bounds[k] : bounds[k + 1]]
                done[key] = sketch(own).view(np.int64) if len(own) else np.zeros(0, np.int64)
            out.append(done[key])
        counts = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(counts, np.concatenate(out) if out else np.zeros(0, np.int64))], names=["k", "doc_id", "n", "sketches"])


def chain(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the longest chain of equal labelled shingles (unique in each text) in the order of both, within the band."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if (np.diff(j) > 0).all():
        return i, j
    tails: list[int] = []
    last: list[int] = []
    came = np.full(len(j), -1)
    for at, x in enumerate(j.tolist()):
        k = bisect_left(tails, x)
        came[at] = last[k - 1] if k else -1
        tails[k : k + 1], last[k : k + 1] = [x], [at]
    at, own = last[-1], []
    while at >= 0:
        own.append(at)
        at = int(came[at])
    return i[own[::-1]], j[own[::-1]]


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence: a bit for each word of a, one step for each of b."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = open_ = (1 << len(a)) - 1
    for x in b:
        if at := places.get(x):
            hit = open_ & at
            open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(a) - open_.bit_count()


class Texts:
    """Words of texts as numbers, equal if and only if the words are, and labelled shingles; those of recent texts are remembered."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def of(self, key: bytes, text) -> tuple[np.ndarray, np.ndarray]:
        """text: a scalar of Arrow."""
        if key not in self.known:
            data = text.as_buffer().to_pybytes()
            words = data.translate(LOWER.tobytes()).split()
            put = self.numbers.setdefault
            own = np.array([put(w, len(self.numbers)) for w in words], np.int64)
            self.known[key] = own, shingles(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
            self.size += len(own)
        return self.known[key]

    def similar(self, x: tuple[bytes, object], y: tuple[bytes, object], share: tuple[int, int] = SIMILARITY) -> bool:
        if self.size > CACHED:
            self.clear()
        return aligned(*self.of(*x), *self.of(*y), share)[0]


def aligned(words_a: np.ndarray, shingles_a: np.ndarray, words_b: np.ndarray, shingles_b: np.ndarray, share: tuple[int, int] = SIMILARITY) -> tuple[bool, int]:
    """Whether the share of the longer text's words that are aligned is reached, and how many are (0 where it can't be)."""
    p, q = share
    longer, shorter = max(len(words_a), len(words_b)), min(len(words_a), len(words_b))
    if not shorter or q * shorter < p * longer:
        return False, 0
    i, j = chain(shingles_a, shingles_b, longer * (q - p) // q)
    size = min(SHINGLE, shorter)
    equal = np.ones(len(i), bool)
    for k in range(size):
        equal &= words_a[np.minimum(i + k, len(words_a) - 1)] == words_b[np.minimum(j + k, len(words_b) - 1)]
    i, j = i[equal], j[equal]
    runs = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1), [True]])) if len(i) else np.zeros(1, np.int64)
    at_a = at_b = total = 0
    gaps = []
    for low, high in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        first_a, first_b, n = int(i[low]), int(j[low]), high - low - 1 + size
        over = max(at_a - first_a, at_b - first_b, 0)
        if over < n:
            gaps.append((at_a, first_a + over, at_b, first_b + over))
            total += n - over
            at_a, at_b = first_a + n, first_b + n
    gaps.append((at_a, len(words_a), at_b, len(words_b)))
    gaps = [g for g in gaps if g[1] > g[0] and g[3] > g[2]]
    if q * (total + sum(min(g[1] - g[0], g[3] - g[2]) for g in gaps)) < p * longer:
        return False, 0
    total += sum(common(words_a[g[0] : g[1]].tolist(), words_b[g[2] : g[3]].tolist()) for g in gaps)
    return q * total >= p * longer, total


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = Texts()
    for batch in batches:
        found = [texts.similar((a, x), (b, y)) for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], names=["a", "b", "linked"])


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    sides = pairs.join(texts.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a")
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a binary, b binary, linked boolean")


def _joined(table: pa.Table) -> pa.Table:
    """Links between classes in pairs of blocks (s, i, j): of the nodes with an equal sketch s those of block i with those of block j."""
    s, i, j, block, n = (table.column(x).to_numpy() for x in ("s", "i", "j", "block", "n"))
    keys, classes = table.column("k").to_pylist(), table.column("c").to_pylist()
    numbers = {c: x for x, c in enumerate(dict.fromkeys(classes))}
    own_class = np.array([numbers[c] for c in classes])
    root = list(range(len(numbers)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sketches = np.zeros((len(keys), SKETCHES + SHORT_SKETCHES), np.int64)
    low = 0
    for lists in table.column("sketches").chunks:
        count = np.diff(np.asarray(lists.offsets))
        column = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        sketches[low + np.repeat(np.arange(len(lists)), count), column] = lists.flatten().to_numpy()
        low += len(lists)
    data = [x for chunk in table.column("text").chunks for x in chunk]  # scalars: the bytes stay where they are
    texts = Texts()
    p, q = SIMILARITY
    links = []
    order = np.lexsort((j, i, s))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(s[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)]))
    for rows in np.split(order, new[1:]):
        left, right = (rows[block[rows] == x[rows[0]]] for x in (i, j))
        found = []
        for at, x in enumerate(left.tolist()):
            others = right[at + 1 :] if i[x] == j[x] else right
            others = others[(own_class[others] != own_class[x]) & (q * (np.minimum(n[others], n[x]) + SHINGLE - 1) >= p * (np.maximum(n[others], n[x]) + SHINGLE - 1))]
            same = (sketches[others] == sketches[x]) & (sketches[x] != 0)
            here = same.any(axis=1) & (sketches[x][same.argmax(axis=1)] == s[x])
            found += [(-int(m), x, y) for m, y in zip(same[here].sum(axis=1), others[here].tolist(), strict=True)]
        for _, x, y in sorted(found):
            u, v = find(int(own_class[x])), find(int(own_class[y]))
            if u != v and texts.similar((keys[x], data[x]), (keys[y], data[y])):
                root[u] = v
                links.append((keys[x], keys[y]))
    return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})


def text_classes(docs: DataFrame) -> DataFrame:
    """k (key of a text), rep (least doc_id of its copies), n (shingles), c (key of its class) for each distinct text of docs (doc_id, text)."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("k", text_key(F.col("text")))
    sketched = rows.select("k", "doc_id", "text").mapInArrow(_sketches, "k binary, doc_id long, n int, sketches array<long>")
    nodes = kept(sketched.groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketches").alias("sketches")), "nodes")

    spread = nodes.select("k", "n", F.explode("sketches").alias("s"))
    members = kept(spread.join(spread.groupBy("s").agg(F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1"), "s"), "members")
    needed = nodes.join(members.select("k").distinct(), "k", "left_semi").select("k", F.coalesce("rep", F.lit(NO_ID)).alias("d"))
    texts = kept(rows.withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))).join(needed, ["k", "d"]).dropDuplicates(["k", "d"]).select("k", F.encode("text", "UTF-8").alias("text")), "texts")

    central = members.join(members.groupBy("k").agg(F.sum("m").alias("shares")), "k")
    hubs = central.groupBy("s").agg(F.max_by("k", F.struct("shares", "k")).alias("hub"))
    counted = members.join(hubs, "s").where("k <> hub").groupBy("k", "hub").agg(F.count("*").alias("m"))
    best = counted.groupBy("k").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub"))
    links = kept(_verify(best.select(F.least("k", "hub").alias("a"), F.greatest("k", "hub").alias("b")).distinct(), texts).where("linked").select("a", "b"), "links")
    classes = kept(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "classes")

    sorted_out = members.join(classes.select(F.col("node").alias("k"), "root"), "k", "left").select("s", "k", "n", "m", "size", F.coalesce("root", "k").alias("c"))
    several = sorted_out.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s")
    blocked = sorted_out.join(several, "s", "left_semi").withColumn("blocks", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SHINGLES))).withColumn("block", F.pmod(F.xxhash64("k", "s"), "blocks"))
    spread = kept(blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("s", "k", "n", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "blocks")
    rows, size = spread.agg(F.count("*"), F.sum("n")).first()
    groups = max(1, rows // GROUP_ROWS, (size or 0) // GROUP_SHINGLES)
    full = spread.join(nodes.select("k", "sketches").join(texts, "k"), "k").withColumn("g", F.pmod(F.xxhash64("s", "i", "j"), F.lit(groups)))
    more = kept(full.groupBy("g").applyInArrow(_joined, "a binary, b binary"), "links")
    if not more.isEmpty():
        classes = components(links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return nodes.select("k", "rep", "n").join(classes.select(F.col("node").alias("k"), "root"), "k", "left").select("k", "rep", "n", F.coalesce("root", "k").alias("c"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id of its class), stays (true for the row or equal rows that stand for the class)."""
    nodes = kept(text_classes(docs), "text-classes")
    first = nodes.groupBy("c").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "k")).alias("m")).select("c", F.col("m.rep").alias("class_id"), F.col("m.k").alias("class_k"))
    found = nodes.join(first, "c").select("k", "class_id", (F.col("k") == F.col("class_k")).alias("own"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("k"))
    return rows.join(found, "k").select("doc_id", "class_id", (F.col("own") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each class."""
    nodes = text_classes(docs)
    first = nodes.groupBy("c").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "k")).alias("m"))
    stay = first.select(F.col("m.k").alias("_k"), F.coalesce("m.rep", F.lit(NO_ID)).alias("_d"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", text_key(F.col("row.text")).alias("_k"), F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("_d"))
    return rows.join(stay, ["_k", "_d"]).dropDuplicates(["_k", "_d"]).select("row.*")
