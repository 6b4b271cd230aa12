"""Token counts by a scan for separators in flat token files.

A file is ids of fixed width, document after document, each closed by an end-of-document id; there is no index. Files are read in
byte ranges; a vectorised search finds the separators of each block. A document that begins in one block and ends in a later one
is stitched by prefix scans: the last separator before a block, and how many there were. A block is one row of four numbers there;
1,024 blocks of a file are scanned together, and their sums over the file, so that a file of any size is no single task. Its
separators stay an array until the lengths are known.

Tokens after a file's last separator are a document that is not closed. A file without tokens has no row. Writing: strings of
special tokens in a text are ordinary text, so that none of its ids is the separator; a null text is empty, a null doc_id stays
null, equal rows each have a document; in ascending order a null doc_id comes first, and rows of equal doc_id are ordered by a hash
of the text and the text; a very long text is encoded as one block; an empty table gives no file and no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import token_files
from paperloom.llm._shared import Ranges, bounded_batches, kept, new_folder, write_whole

DTYPE, BLOCK_TOKENS, FILE_TOKENS = "<u2", 1 << 20, 1 << 23
#: Blocks that are scanned in one task; groups of them are scanned as rows.
GROUP_BLOCKS = 1024


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, dtype: str, most: int) -> Iterator[pa.RecordBatch]:
    part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
    names: list = []
    data: list[bytes] = []
    files = size = 0

    def close() -> pa.RecordBatch:
        write_whole(name := f"{folder}/{part:08d}-{files:06d}.tokens", data, attempt)
        n = len(names)
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(names, pa.int64())], names=["file", "number", "doc_id"])

    for doc_ids, ids, offs in token_files.tokenized(batches, path, added=False):
        if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
            raise ValueError(f"an id does not fit {dtype}")
        names += doc_ids
        data.append(token_files.with_end(ids, offs, end_id)[0].astype(dtype).tobytes())
        size += len(data[-1])
        if size >= most * np.dtype(dtype).itemsize:
            yield close()
            names, data, size, files = [], [], 0, files + 1
    if names:
        yield close()


def write_flat_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, dtype: str = DTYPE, file_tokens: int = FILE_TOKENS, ordered: bool = False) -> str:
    """Ids of docs (doc_id, text), end_id after each: as the documents are read, without a shuffle, or in ascending doc_id order. Beside the *.tokens the folder gets _documents: which doc_id is which document of which file."""
    folder = folder or new_folder(docs.sparkSession, "flat")
    rows = token_files.in_order(docs) if ordered else bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(partial(_write, folder=folder, path=tokenizer, end_id=end_id, dtype=dtype, most=file_tokens), "file string, number long, doc_id long")
    made.write.parquet(f"{folder}/_documents")
    return folder


def _scan(batches: Iterator[pa.RecordBatch], end_id: int, dtype: str) -> Iterator[pa.RecordBatch]:
    width = np.dtype(dtype).itemsize
    for batch in batches:
        for file, block, start, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            source = Ranges(file)
            ids = np.frombuffer(source.read(start * width, n * width), dtype)
            source.close()
            ends = np.flatnonzero(ids == end_id) + start
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([start + n], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "until", "found", "last", "ends"])


def counts(spark: SparkSession, files: DataFrame, end_id: int, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, number (of the document in its file, from 0), start (its first token), n_tokens (without the end id), closed. files: path, length in bytes."""
    width = np.dtype(dtype).itemsize
    sized = files.select("path", F.floor(F.col("length") / width).alias("n")).where("n > 0")
    ranges = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block_tokens))))
    asked = ranges.select("path", "block", (F.col("block") * block_tokens).alias("start"), F.least(F.lit(block_tokens), F.col("n") - F.col("block") * block_tokens).alias("n"))
    dealt = asked.repartition(max(1, 4 * spark.sparkContext.defaultParallelism))
    found = kept(dealt.mapInArrow(partial(_scan, end_id=end_id, dtype=dtype), "file string, block long, until long, found long, last long, ends array<long>"), "separators")
    heads = found.select("file", "block", "until", "found", "last", F.floor(F.col("block") / GROUP_BLOCKS).alias("group"))
    groups = heads.groupBy("file", "group").agg(F.sum("found").alias("found"), F.max("last").alias("last"), F.max("block").alias("top"))
    over = lambda w: (F.coalesce(F.sum("found").over(w), F.lit(0)), F.coalesce(F.max("last").over(w), F.lit(-1)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    outer, inner = over(before(Window.partitionBy("file").orderBy("group"))), over(before(Window.partitionBy("file", "group").orderBy("block")))
    starts = groups.select("file", "group", outer[0].alias("n"), outer[1].alias("l"), F.max("top").over(Window.partitionBy("file")).alias("top"))
    scanned = heads.select("file", "group", "block", "until", "last", inner[0].alias("number0"), inner[1].alias("last0")).join(starts, ["file", "group"])
    scanned = scanned.select("file", "block", "until", "last", (F.col("n") + F.col("number0")).alias("number0"), F.greatest("l", "last0").alias("last0"), (F.col("block") == F.col("top")).alias("is_end"))
    scanned = scanned.join(found.select("file", "block", "ends"), ["file", "block"])
    # the rest of the file after its last separator ends where the file does
    rest = F.col("is_end") & (F.greatest("last0", F.coalesce("last", F.lit(-1))) < F.col("until") - 1)
    stops = scanned.select("file", "number0", "last0", F.col("ends"), F.when(rest, F.concat("ends", F.array("until"))).otherwise(F.col("ends")).alias("stops"))
    rows = stops.select("file", "number0", "last0", "ends", "stops", F.posexplode("stops").alias("i", "stop"))
    previous = F.when(F.col("i") == 0, F.col("last0")).otherwise(F.get("stops", F.col("i") - 1))
    return rows.select("file", (F.col("number0") + F.col("i")).alias("number"), (previous + 1).alias("start"), (F.col("stop") - previous - 1).alias("n_tokens"), (F.col("i") < F.size("ends")).alias("closed"))


def flat_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the token files of a folder; the files themselves are not read."""
    listed = spark.read.parquet(f"{folder}/_documents").select(F.col("file").alias("path")).distinct()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                source = Ranges(path)
                out.append(source.size)
                source.close()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["path", "length"])

    return listed.mapInArrow(sizes, "path string, length long")


def document_counts(spark: SparkSession, folder: str, end_id: int, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens for each document of a folder that write_flat_files has written."""
    found = counts(spark, flat_files(spark, folder), end_id, dtype, block_tokens)
    # small as a file, as its columns repeat or count up, but a row for each document: not to be broadcast
    return spark.read.parquet(f"{folder}/_documents").hint("merge").join(found, ["file", "number"], "left").select("doc_id", "n_tokens")
