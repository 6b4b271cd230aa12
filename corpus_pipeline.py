"""The corpus pipeline: documents through quality rules, line dedup, near dedup, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents.

In every stage: a null text counts as empty; equal rows are each judged alike; a doc_id may be null or repeated; an empty table gives
an empty table; extra columns are passed on, whatever their names (the last stage returns its own columns only); a very long text is
worked on in one task, in several times its size. What decides ties is said with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decision_lists, fm_index, line_dedup, order_minhash, unigram
from paperloom.llm._shared import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
PIECES = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned rules reject go; null, empty and very short texts fail the base rule."""
    rules = decision_lists.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decision_lists.judged(docs, rules).where("kept").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut from the texts; a document of which nothing is left goes. n_chars follows the text.
    Of equal windows that in the document of least doc_id stays, of one doc_id, or none, that in the row that is read first; null texts stay."""
    found = line_dedup.deduplicated(docs).where("size(removed) = 0 OR kept_text <> ''")
    row = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("kept_text")}
    if "n_chars" in row:
        row["n_chars"] = F.when(F.size("removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return found.select(*[column.alias(c) for c, column in row.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least doc_id; one without a doc_id only if all are. Of equal
    rows one stays; null and empty texts are one class."""
    return order_minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in 20 lies in a benchmark passage go; the others stay as they are, null and
    empty texts among them; no tie can arise."""
    found = fm_index.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.coalesce(fm_index.contaminated(), F.lit(False))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the pieces, and the text that they decode to; of null and empty texts no ids and an empty text. Of equal sums of
    scores the path with the longer last piece wins."""
    return unigram.pieces(docs, public_tokenizers.path(PIECES), decode=True).select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", without_repeated_lines),
    ("order_minhash", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Learned rules, sketches and Viterbi are not expressed in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := new_folder(spark, f"stage-{name}"))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
