"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from paperloom.functions.chunking import CHUNK_SIZE, OVERLAP
from paperloom.functions.text import WHITE_SPACE

ADDED = [T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("page", T.StringType()), T.StructField("text", T.StringType())]


class ChunkText:
    """chunk_text(TABLE(docs) PARTITION BY (...), size, overlap): the other columns of docs, and the windows of its column text, as
    functions.chunking.chunks gives them. Any partitioning will do, as a text's windows are its own."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not docs.isTable:
            raise ValueError("chunk_text: the first argument is a table")
        if "text" not in docs.dataType.fieldNames():
            raise ValueError("chunk_text: the table has a column text")
        own = [CHUNK_SIZE if size is None else size.value, OVERLAP if overlap is None else overlap.value]
        if any(x is None for x in own) or not 0 <= own[1] < own[0]:
            raise ValueError("chunk_text: size and overlap are constants, overlap less than size")
        return AnalyzeResult(schema=T.StructType([*[f for f in docs.dataType.fields if f.name not in {a.name for a in ADDED}], *ADDED]))

    def eval(self, docs: Row, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        text, step = docs["text"] or "", size - overlap
        starts = range(0, max(len(text) - size + step - 1, 0) // step * step + 1, step) if text else ()
        windows = [w for i in starts if (w := text[i : i + size].strip(WHITE_SPACE))]
        added = {a.name for a in ADDED}
        others = [docs[c] for c in docs.__fields__ if c not in added]
        for i, w in enumerate(windows):
            yield (*others, i, len(windows), str(i + 1), w)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL in this session."""
    spark.udtf.register("chunk_text", udtf(ChunkText))
