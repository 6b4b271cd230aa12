"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed (a digest of 128 bits); windows are grouped globally, the occurrence in the
document with the least doc_id, and there the first, stays; all lines that another occurrence covers are removed, overlapping
windows merged. A line that is removed is in an earlier place, so nothing is lost from the whole.

Lines end at line feeds; windows without a character other than white space do not count; texts of under three lines have none.
Null texts stay null. Rows without a doc_id come last. Each row is a document of its own: of rows with one doc_id, or without one, that
which is read first comes first, so of equal rows one keeps its lines. A very long text is worked on as one block, of several times its
size. An empty table gives none. All columns are passed on inside `row`, whatever their names.
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

WINDOW = 3
BLANK = B.table(lambda b: b == 0x20 or 0x09 <= b < 0x0E)


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, at least one: starts, ends, and the number of each text's first line, one more at the end."""
    feeds = np.flatnonzero(buf == 0x0A)
    per = np.searchsorted(feeds, offs)
    first = per + np.arange(len(offs))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    starts[is_first], starts[~is_first] = offs[:-1], feeds + 1
    ends[is_last], ends[~is_last] = offs[1:], feeds
    return starts, ends, first


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch, buf, offs in B.blocks(batches):
        starts, ends, first = line_spans(buf, offs)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
        words = np.concatenate([[0], np.cumsum(~BLANK[buf])])
        at = np.flatnonzero(owner[size - 1 :] == owner[: len(owner) - size + 1]) if len(owner) >= size else np.zeros(0, np.int64)
        at = at[words[ends[at + size - 1]] > words[starts[at]]]
        h, g = B.digests(buf.tobytes(), starts[at], ends[at + size - 1])  # three lines with their feeds
        again = B.seen_before(owner[at], h, g)
        d, u = (batch.column(i).take(pa.array(owner[at])) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), d, u, pa.array((at - first[owner[at]]).astype(np.int32)), pa.array(again)], names=["h", "g", "d", "u", "at", "again"])


def _without(batches: Iterator[pa.RecordBatch], size: int, text: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, total, gone = [], [], []
        for own, starts in zip(batch.column(0).field(text).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = own.split("\n") if own is not None else []
            removed = {i for at in starts or () for i in range(at, at + size)}
            out.append(own if not removed else "\n".join(x for i, x in enumerate(lines) if i not in removed))
            total.append(len(lines))
            gone.append(sorted(removed))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, schema.field("kept_text").type), pa.array(total, pa.int64()), pa.array(gone, schema.field("removed").type)], schema=pa.schema([pa.field("row", batch.column(0).type), *list(schema)[1:]]))


def deduplicated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """row, kept_text, n_lines (0 for null), removed (numbers of removed lines, from 0) for each document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = ranked(docs)
    units = kept(rows.select("d", "u", F.col("row.text").cast("string").alias("text")).mapInArrow(partial(_windows, size=size), "h long, g long, d long, u long, at int, again boolean"), "windows")
    places = gathered(later(units, ["h", "g"]))
    joined = rows.join(places.hint("shuffle_hash"), "u", "left").select("row", "later")
    schema = T.StructType([rows.schema["row"], T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])
    return joined.mapInArrow(partial(_without, size=size, text=docs.columns.index("text"), schema=to_arrow_schema(schema)), schema)
