"""Words and units of UTF-8 text as numpy arrays: spans, hashes, exact numbers of spans, and ids of units from a bounded cache.

A hash only groups: where spans count as equal inside a task (distinct, Vocabulary) their bytes are compared as well, and what
leaves a task to be grouped with others is a cryptographic digest of 128 bits (digests). Plain hashes (span_hashes) are for
sketches and cuts, which decide nothing by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Spans above so many bytes are hashed and compared one by one.
LONG = 256
#: Spans that are hashed at once.
SLICE = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)
LANES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser with good avalanche (the constants are those of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lanes:
    """Eight bytes from any place of buf as one number."""

    def __init__(self, buf: np.ndarray):
        self.padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.view = np.ndarray((len(buf) + 1,), "<u8", buffer=self.padded, strides=(1,))

    def at(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first bytes from starts, eight or what sizes leaves."""
        return self.view[starts] & LANES[np.minimum(sizes, 8)]

    def bytes(self, start: int, end: int) -> bytes:
        return self.padded[start:end].tobytes()


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, by eight bytes at a time. Spans with equal hashes need not be equal."""
    out, lanes = np.empty(len(starts), np.uint64), Lanes(buf)
    with np.errstate(over="ignore"):
        for low in range(0, len(starts), SLICE):
            s, size = starts[low : low + SLICE], ends[low : low + SLICE] - starts[low : low + SLICE]
            value = mixed(lanes.at(s, size) + size.astype(np.uint64) * ODD)
            open_, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
            while len(open_):
                value[open_] = mixed(value[open_] ^ lanes.at(s[open_] + k, size[open_] - k)) * ODD
                k += 8
                open_ = open_[size[open_] > k]
            for i in np.flatnonzero(size > LONG).tolist():
                value[i] = int.from_bytes(blake2b(lanes.bytes(s[i], s[i] + size[i]), digest_size=8).digest(), "little")
            out[low : low + SLICE] = value
    return out


def same_bytes(a: Lanes, starts_a: np.ndarray, ends_a: np.ndarray, b: Lanes, starts_b: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Whether spans with equal hashes have equal bytes. The hash of up to eight bytes can be undone if their number is known, so
    only longer spans are read again."""
    size = ends_a - starts_a
    out = size == ends_b - starts_b
    open_, k = np.flatnonzero(out & (size > 8) & (size <= LONG)), 0
    for i in np.flatnonzero(out & (size > LONG)).tolist():
        out[i] = a.bytes(starts_a[i], ends_a[i]) == b.bytes(starts_b[i], ends_b[i])
    while len(open_):
        equal = a.at(starts_a[open_] + k, size[open_] - k) == b.at(starts_b[open_] + k, size[open_] - k)
        out[open_[~equal]] = False
        k += 8
        open_ = open_[equal & (size[open_] > k)]
    return out


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each distinct text, and for each span which of these it equals: grouped by hash, then byte by byte."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = span_hashes(buf, starts, ends)
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    index, inverse = order[new], np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    lanes, other = Lanes(buf), order[~new]
    first = index[inverse[other]]
    odd = other[~same_bytes(lanes, starts[other], ends[other], lanes, starts[first], ends[first])]
    if len(odd):  # texts that only share a hash
        names: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            inverse[i] = names.setdefault(lanes.bytes(starts[i], ends[i]), len(index) + len(names))
            if len(names) > len(more):
                more.append(i)
        index = np.concatenate([index, np.array(more, np.int64)])
    return index, inverse


class Vocabulary:
    """Numbers of known words, by their order: found by hash, then byte by byte."""

    def __init__(self, words: list[bytes]):
        self.lanes = Lanes(np.frombuffer(b"".join(words), np.uint8))
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if words else ends
        hashes = span_hashes(self.lanes.padded[:-8], starts, ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.ends = hashes[self.order], starts[self.order], ends[self.order]
        self.places: dict[bytes, int] | None = None

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def words(self) -> list[bytes]:
        data, back = self.lanes.padded.tobytes(), np.argsort(self.order)
        return [data[a:b] for a, b in zip(self.starts[back].tolist(), self.ends[back].tolist(), strict=True)]

    def __getstate__(self) -> dict:
        return {"data": self.lanes.padded[:-8], **{k: getattr(self, k) for k in ("order", "hashes", "starts", "ends")}}

    def __setstate__(self, state: dict) -> None:
        self.lanes, self.places = Lanes(state.pop("data")), None
        self.__dict__ |= state

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span, -1 of unknown ones."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self) or not len(starts):
            return out
        hashes = span_hashes(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        lanes, at = Lanes(buf), at[hit]
        equal = same_bytes(lanes, starts[hit], ends[hit], self.lanes, self.starts[at], self.ends[at])
        out[hit[equal]] = self.order[at[equal]]
        for i in hit[~equal].tolist():  # of another word with the same hash
            if self.places is None:
                self.places = {w: k for k, w in enumerate(self.words)}
            out[i] = self.places.get(lanes.bytes(starts[i], ends[i]), -1)
        return out


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of spans as two columns of 64-bit integers."""
    parts = [blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    both = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def seen_before(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether the same owner has the same keys earlier."""
    order = np.lexsort((*keys, owner))  # stable
    again = np.zeros(len(owner), bool)
    same = owner[order][1:] == owner[order][:-1]
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    again[order[1:]] = same
    return again


def table(pattern: Callable[[int], bool]) -> np.ndarray:
    return np.array([pattern(b) for b in range(256)])


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes, none over a document's end: starts, ends, and for each document the number of the first word (one more at the end)."""
    flags = np.zeros(len(buf) + 1, dtype=bool)
    flags[:-1] = is_word[buf]
    prev = np.empty_like(flags)
    prev[0], prev[1:] = False, flags[:-1]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offs] = True
    starts = np.flatnonzero(flags & (~prev | cut))
    ends = np.flatnonzero(prev & (~flags | cut))
    return starts, ends, np.searchsorted(starts, offs)


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in slices of about limit bytes of the column name: (slice, bytes, offsets)."""
    for batch in batches:
        buf, offs = text_of(batch.column(batch.schema.get_field_index(name)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n - len(x), len(x)), x.dtype)])


class UnitIds:
    """Ids of texts that are joined of units which encode independently of each other. encode and places get lists of distinct units. When the cache holds over most units, or 8 ids for each, those that only one block has had leave it, and all if those that stay are over half."""

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.count, self.seen = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def trim(self) -> None:
        stay = np.flatnonzero(self.seen[: len(self.place)] > 1)
        if len(stay) > self.most // 2 or self.count[stay].sum() > 4 * self.most:
            return self.clear()
        names = list(self.place)
        count = self.count[stay]
        first = np.cumsum(count) - count
        flat = self.flat[np.repeat(self.first[stay] - first, count) + np.arange(int(count.sum()))]
        self.place = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.flat, self.used, self.first, self.count, self.seen = flat, len(flat), first, count, np.ones(len(stay), np.int32)

    def places(self, units: list[bytes]) -> np.ndarray:
        if len(self.place) > self.most or self.used > 8 * self.most:
            self.trim()
        missing = [u for u in units if u not in self.place]
        for i in range(0, len(missing), 4096):
            some = missing[i : i + 4096]
            found = self.encode(some)
            count = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
            k = len(self.place)
            self.flat = grown(self.flat, self.used + len(flat))
            self.first, self.count, self.seen = (grown(x, k + len(some)) for x in (self.first, self.count, self.seen))
            self.seen[k : k + len(some)] = 0
            self.flat[self.used : self.used + len(flat)] = flat
            self.first[k : k + len(some)] = self.used + np.cumsum(count) - count
            self.count[k : k + len(some)] = count
            self.place.update(zip(some, range(k, k + len(some)), strict=True))
            self.used += len(flat)
        places = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        self.seen[places] += 1
        return places

    def ids(self, buf: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """starts: of units that cover buf; a document's start is one of them. The ids of all, and len(offs) offsets of documents in them."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(buf))
        index, inverse = distinct(buf, starts, ends)
        data = buf.tobytes()
        places = self.places([data[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])[inverse]
        count = self.count[places]
        until = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.first[places] - until[:-1], count) + np.arange(until[-1])]
        return ids, until[np.searchsorted(starts, offs)]
