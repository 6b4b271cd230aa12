"""Overlapping windows of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import stripped

CHUNK_SIZE, OVERLAP = 512, 64


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each stripped, non-blank window of each text: the other columns, chunk_index (from 0, of those that stay),
    total_chunks, page (index + 1, as a string) and the window as text. Windows begin every size - overlap code points; the first
    that reaches the end is the last. Null and blank texts have none; rows are numbered by what they hold, so key need not be unique.

    The windows of a text are an array until they are numbered: nothing is shuffled."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step, c = size - overlap, F.col(text)
    last = F.greatest(F.ceil((F.length(c) - size) / step), F.lit(0)).cast("int")
    windows = F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: stripped(F.substring(c, i * step + 1, F.lit(size)))))
    kept = F.filter(windows, lambda w: w != "")
    others = [x for x in docs.columns if x != text]
    rows = docs.select(*others, kept.alias("_windows")).where(F.size("_windows") > 0)
    rows = rows.select(*others, F.size("_windows").alias("total_chunks"), F.posexplode("_windows").alias("chunk_index", text))
    return rows.withColumn("page", (F.col("chunk_index") + 1).cast("string"))


def upsert_batches(chunks: DataFrame, batch: int = 100) -> DataFrame:
    """batch_no of each chunk of a file, as files are written by so many points at a time."""
    return chunks.withColumn("batch_no", F.floor(F.col("chunk_index") / batch))
