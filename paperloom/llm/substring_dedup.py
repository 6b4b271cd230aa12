"""Substring dedup by digests of lines, paragraphs or sentences.

A unit is a line, a paragraph (lines up to one without a word), or a sentence (lines cut on after a full stop, exclamation or
question mark before white space). Units are compared by their normalised words: ASCII lower case, marks and white space left out.
Digests of 128 bits are grouped globally; the occurrence of least rank stays, and there the first, the rest is removed, with the
spans in the original text kept. By default whatever repeats goes, however short; least_words bounds it: of adjoining repeated
units those go that have so many words together.

Null texts stay null, texts without words have no unit. Rows without a rank come last. Each row is a document of its own: of rows with
one rank, or without one, that which is read first comes first, so of equal rows one keeps its units. A very long text is worked on as
one block, of several times its size. An empty table gives none. All columns are passed on inside `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import _bytes as B
from paperloom.llm._shared import kept
from paperloom.llm.repeats import gathered, later, ranked

UNITS = ("line", "paragraph", "sentence")
IS_WORD = B.table(lambda b: 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80)
IS_END = B.table(lambda b: chr(b) in ".!?")
IS_SPACE = B.table(lambda b: b == 0x20 or 0x09 <= b < 0x0E)
LOWER = np.array([b + 32 if 0x41 <= b < 0x5B else b for b in range(256)], np.uint8)


def units_of(buf: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Starts and ends of words, each text's first word, and the first word of each unit (both with one more at the end)."""
    starts, ends, first = B.word_spans(LOWER[buf], offs, IS_WORD)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros(1, np.int64)
    feeds = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    between = feeds[starts[1:]] - feeds[ends[:-1]]
    cut = np.zeros(n + 1, bool)
    cut[first] = cut[n] = True
    cut[1:-1] |= between >= (2 if unit == "paragraph" else 1)
    if unit == "sentence":
        closed = np.zeros(len(buf) + 1, np.int64)
        closed[2:] = np.cumsum(IS_END[buf[:-1]] & IS_SPACE[buf[1:]])
        cut[1:-1] |= closed[starts[1:]] > closed[ends[:-1]]
    return starts, ends, first, np.flatnonzero(cut)


def normalised(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words in lower case, a space after each, and where in this each unit begins and ends."""
    size = ends - starts + 1
    until = np.concatenate([[0], np.cumsum(size)])
    out = np.append(LOWER[buf], np.uint8(0))[np.repeat(starts - until[:-1], size) + np.arange(until[-1])]
    out[until[1:] - 1] = 0x20
    return out.tobytes(), until[begin[:-1]], until[begin[1:]]


def _units(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    """at: the unit's first word in its text."""
    for batch, buf, offs in B.blocks(batches):
        starts, ends, first, begin = units_of(buf, offs, unit)
        h, g = B.digests(*normalised(buf, starts, ends, begin))
        owner = np.searchsorted(first, begin[:-1], "right") - 1
        again = B.seen_before(owner, h, g)
        d, u = (batch.column(i).take(pa.array(owner)) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), d, u, pa.array((begin[:-1] - first[owner]).astype(np.int32)), pa.array(again)], names=["h", "g", "d", "u", "at", "again"])


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)


def _cut(batches: Iterator[pa.RecordBatch], unit: str, least: int, text: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    named = (pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(0).field(text)], names=["row", "later", "text"]) for b in batches)
    for batch, buf, offs in B.blocks(named):
        starts, ends, first, begin = units_of(buf, offs, unit)
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        own_units = np.searchsorted(begin[:-1], first)
        texts, spans, removed = batch.column(2).cast(pa.string()).to_pylist(), [], []
        for k, places in enumerate(batch.column(1).to_pylist()):
            own: list[dict] = []
            words = 0
            if places:
                begins = begin[own_units[k] : own_units[k + 1] + 1]
                for a, b in _runs(np.isin(begins[:-1] - first[k], places)):
                    if (n := int(begins[b] - begins[a])) >= least:
                        words += n
                        own.append({"start": int(points[starts[begins[a]]] - points[offs[k]]), "end": int(points[ends[begins[b] - 1]] - points[offs[k]])})
            if own:
                edges = [0, *(x for s in own for x in (s["start"], s["end"])), len(texts[k])]
                texts[k] = "".join(texts[k][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            spans.append(own)
            removed.append(words)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, schema.field("kept_text").type), pa.array(np.diff(own_units), pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, schema.field("removed").type)], schema=pa.schema([pa.field("row", batch.column(0).type), *list(schema)[1:]]))


def deduplicated(docs: DataFrame, unit: str = "line", rank: str = "doc_id", least_words: int = 1) -> DataFrame:
    """row, kept_text, n_units, n_words, n_removed_words, removed (spans in code points of text). unit: line, paragraph or sentence.
    least_words: of a run of adjoining repeated units."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if unit not in UNITS:
        raise ValueError(unit)
    rows = ranked(docs, rank)
    units = kept(rows.select("d", "u", F.col("row.text").cast("string").alias("text")).mapInArrow(partial(_units, unit=unit), "h long, g long, d long, u long, at int, again boolean"), "units")
    joined = rows.join(gathered(later(units, ["h", "g"])).hint("shuffle_hash"), "u", "left").select("row", "later")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["row"], T.StructField("kept_text", T.StringType()), *(T.StructField(k, T.LongType()) for k in ("n_units", "n_words", "n_removed_words")), T.StructField("removed", T.ArrayType(span))])
    return joined.mapInArrow(partial(_cut, unit=unit, least=least_words, text=docs.columns.index("text"), schema=to_arrow_schema(schema)), schema)
