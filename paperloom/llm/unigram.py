"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and scores are read from a .model file. A text gets a space in front, spaces become the marker U+2581, and the path of
pieces with the greatest sum of scores wins; of equal sums the one whose last piece is longer, from the left. A character that no
piece covers costs ten less than the worst score and becomes its bytes' pieces. Texts are cut between characters whose bytes no
piece has side by side, such as before a space; no piece can lie over a cut, so units encode on their own: a task runs Viterbi once
for each distinct unit, over many of them in step as arrays.

The public model is trained for another way of joining pieces; its scores serve as log scores here, so ids are not those of that
way but the best path over its pieces, which the tests compare with brute force and the library's own unigram search.

Null and empty texts have no pieces; decoding gives the text back, but a marker that was in it becomes a space, as in the library;
units count as equal by their bytes; equal rows get equal results; a very long text is a block of its own, and a run of over 2,048
bytes that nothing cuts is searched by itself, a few microseconds a byte and in memory of some twenty times its size; an empty table gives
none; other columns are passed on inside `row`, whatever their names.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import _bytes as B
from paperloom.llm._shared import bounded_batches

MARKER = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNKNOWN_PENALTY = 10.0
#: Units times bytes that are searched at once, and bytes of a unit that is searched by itself.
CELLS, LONG = 1 << 18, 2048


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


def read_pieces(path: str) -> list[tuple[bytes, float, int]]:
    """(piece, score, kind) of each id."""
    out = []
    with open(path, "rb") as f:
        for field, value in _fields(f.read()):
            if field == 1:
                own = dict(_fields(value))
                out.append((own.get(1, b""), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie over bytes: node s goes by byte b to base[s] + b + 1 if check there is s. value is a key's number, or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0
        used, free_from = np.zeros(size, bool), 1
        used[0] = True
        work = [(0, 0, len(order), 0)]
        for node, low, high, depth in work:
            children: list[tuple[int, int, int]] = []
            i = low
            while i < high:
                key = keys[order[i]]
                if len(key) == depth:
                    self.value[node] = order[i]
                    i += 1
                    continue
                j = i
                while j < high and keys[order[j]][depth] == key[depth]:
                    j += 1
                children.append((key[depth], i, j))
                i = j
            if not children:
                continue
            bytes_ = np.array([c[0] for c in children]) + 1
            place, low_free = -1, free_from
            while place < 0:
                while low_free + 2048 + 260 >= len(used):
                    self.base, self.value = np.concatenate([self.base, np.zeros_like(self.base)]), np.concatenate([self.value, np.full_like(self.value, -1)])
                    self.check, used = np.concatenate([self.check, np.full_like(self.check, -1)]), np.concatenate([used, np.zeros_like(used)])
                free = np.flatnonzero(~used[low_free : low_free + 2048]) + low_free - int(bytes_[0])
                free = free[free >= 0]
                fits = free[~used[free[:, None] + bytes_].any(axis=1)]
                if len(fits):
                    place = int(fits[0])
                elif len(free) < 64 and low_free == free_from:
                    free_from += 2048  # hardly a place left here
                low_free += 2048
            self.base[node] = place
            used[place + bytes_] = True
            self.check[place + bytes_] = node
            work += [(place + c + 1, i, j, depth + 1) for c, i, j in children]

    def step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The next nodes, or -1."""
        to = self.base[nodes] + bytes_ + 1
        return np.where(self.check[to] == nodes, to, -1)


class Unigram:
    def __init__(self, path: str):
        self.pieces = read_pieces(path)
        known = [i for i, (_, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)]
        self.ids = np.array(known)
        self.as_lists = None
        self.trie = DoubleArray([self.pieces[i][0] for i in known])
        self.scores = np.array([self.pieces[i][1] for i in known], np.float64)
        worst = min((self.pieces[i][1] for i in known if self.pieces[i][2] == NORMAL), default=0.0)
        self.unknown = worst - UNKNOWN_PENALTY
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown_id = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.text = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARKER, b" ") for p, _, kind in self.pieces]

        #: Bytes that follow each other in a piece, the marker as a space.
        self.adjoin = np.zeros(1 << 16, bool)
        for i in known:
            own = np.frombuffer(self.pieces[i][0].replace(MARKER, b" "), np.uint8).astype(np.int64)
            self.adjoin[own[:-1] * 256 + own[1:]] = True

    def units(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of units: at texts, and at each character that no piece has after the byte before it."""
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf) > 1:
            cut[1:-1] = ~self.adjoin[buf[:-1].astype(np.int32) * 256 + buf[1:]] & ((buf[1:] & 0xC0) != 0x80)
        cut[offs] = True
        return np.flatnonzero(cut[:-1])

    def encode_units(self, units: list[bytes]) -> list[list[int]]:
        """Units with spaces; lengths alike go together, so that short ones don't wait for long ones."""
        out: list[list[int]] = [[]] * len(units)
        marked = [u.replace(b" ", MARKER) for u in units]
        order = sorted(range(len(units)), key=lambda i: len(marked[i]))
        at = 0
        while at < len(order) and len(marked[order[at]]) <= LONG:
            longest = max(16, 2 * len(marked[order[at]]))
            to = at + 1
            while to < len(order) and (to - at) * longest < CELLS and len(marked[order[to]]) <= min(longest, LONG):
                to += 1
            for i, ids in zip(order[at:to], self._best([marked[i] for i in order[at:to]]), strict=True):
                out[i] = ids
            at = to
        for i in order[at:]:
            out[i] = self._best_of_long(marked[i])
        return out

    def _best_of_long(self, unit: bytes) -> list[int]:
        """As _best, of one unit, byte by byte: a few microseconds each, and 16 bytes of memory."""
        n, (base, check, value, scores) = len(unit), self.lists()
        best, came, piece = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for start in range(n):
            own = best[start]
            if own == -np.inf:
                continue
            lead = unit[start]
            whole = start + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            node, k, single = 0, start, False
            while k < n:
                to = base[node] + unit[k] + 1
                if check[to] != node:
                    break
                node, k = to, k + 1
                if (v := value[node]) >= 0:
                    if own + scores[v] > best[k]:
                        best[k], came[k], piece[k] = own + scores[v], start, v
                    single |= k == whole
            if not single and own + self.unknown > best[end := min(whole, n)]:
                best[end], came[end], piece[end] = own + self.unknown, start, -1
        return self._back(unit, came, piece)

    def lists(self) -> tuple[list, ...]:
        if self.as_lists is None:
            self.as_lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        return self.as_lists

    def _best(self, units: list[bytes]) -> list[list[int]]:
        n, width = len(units), max(map(len, units), default=0)
        if not width:
            return [[] for _ in units]
        text = np.zeros((width + 1, n), np.int64)
        lengths = np.array([len(u) for u in units])
        flat = np.frombuffer(b"".join(units), np.uint8)
        column = np.repeat(np.arange(n), lengths)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), column] = flat
        size = np.where(text >= 0xF0, 4, np.where(text >= 0xE0, 3, np.where(text >= 0xC0, 2, 1)))
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        came, piece = np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int64)
        for start in range(width):
            at = np.flatnonzero((lengths > start) & (best[start] > -np.inf))
            if not len(at):
                continue
            whole, nodes, k = size[start, at], np.zeros(len(at), np.int64), start
            single = np.zeros(n, bool)
            walking = at
            while len(walking):
                nodes = self.trie.step(nodes, text[k, walking])
                alive = nodes >= 0
                walking, nodes = walking[alive], nodes[alive]
                k += 1
                values = self.trie.value[nodes]
                ends = values >= 0
                self._better(best, came, piece, start, k, walking[ends], best[start, walking[ends]] + self.scores[values[ends]], values[ends])
                single[walking[ends & (size[start, walking] == k - start)]] = True
                alive = lengths[walking] > k
                walking, nodes = walking[alive], nodes[alive]
            lone = ~single[at]
            for step in np.unique(whole[lone]):
                some = at[lone & (whole == step)]
                end = np.minimum(start + step, lengths[some])
                for e in np.unique(end):
                    these = some[end == e]
                    self._better(best, came, piece, start, int(e), these, best[start, these] + self.unknown, np.full(len(these), -1))
        out = []
        came_, piece_ = came.T.tolist(), piece.T.tolist()
        for i, unit in enumerate(units):
            out.append(self._back(unit, came_[i], piece_[i]))
        return out

    def _back(self, unit: bytes, came, piece) -> list[int]:
        """The ids of the best path, from its end."""
        end, ids = len(unit), []
        while end:
            start = came[end]
            if (value := piece[end]) >= 0:
                ids.append(int(self.ids[value]))
            else:
                ids += [self.bytes.get(b, self.unknown_id) for b in reversed(unit[start:end])]
            end = start
        return ids[::-1]

    @staticmethod
    def _better(best, came, piece, start: int, end: int, at: np.ndarray, scores: np.ndarray, values: np.ndarray) -> None:
        won = scores > best[end, at]
        at = at[won]
        best[end, at], came[end, at], piece[end, at] = scores[won], start, values[won]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.text.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Unigram, B.UnitIds]:
    model = Unigram(path)
    return model, B.UnitIds(model.encode_units, most=200_000)


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and offsets of texts in them. Markers in a text count as spaces, and a space is put in front of each that isn't empty."""
    import pyarrow.compute as pc

    texts = texts.cast(pa.large_string()).fill_null("")
    marked = pc.replace_substring(texts, MARKER.decode(), " ")
    fronted = pc.if_else(pc.equal(marked, ""), marked, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), marked, pa.scalar("", pa.large_string())))
    buf, offs = B.text_of(fronted)
    model, cache = codec(path)
    return cache.ids(buf, offs, model.units(buf, offs))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, text: int, back: bool) -> Iterator[pa.RecordBatch]:
    unrowed = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(text)], names=["row", "text"]) for b in batches)
    for batch, _, _ in B.blocks(unrowed):
        ids, offs = encoded(batch.column(1), path)
        columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))]
        if back:
            model, flat, o = codec(path)[0], ids.tolist(), offs.tolist()
            columns.append(pa.array([model.decode(flat[a:b]) for a, b in zip(o, o[1:], strict=False)]))
        yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "decoded"][: len(columns)])


def pieces(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """row, ids (of the pieces) and, if asked for, decoded (the text from the ids) for each document."""
    rows = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    fields = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode
    return rows.mapInArrow(partial(_pieces, path=path, text=docs.columns.index("text"), back=decode), T.StructType(fields))


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows (as row) and the text of each one's ids."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)[0]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(0).field(place).to_pylist()], pa.string())], names=["row", "decoded"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("decoded", T.StringType())]))
