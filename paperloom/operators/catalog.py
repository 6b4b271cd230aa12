"""Catalog of collections, documents and users: lists, counts, and changes as new tables.

Changes return the table as it is afterwards; keep them as versions with sources.sinks.append_versions and read the current ones
with sources.sinks.current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import collection_name, stripped


def by_id(table: DataFrame, value: int, key: str = "id") -> DataFrame:
    return table.where(F.col(key) == value)


def require(rows: DataFrame) -> DataFrame:
    """rows, or LookupError if there is none."""
    if rows.isEmpty():
        raise LookupError("not found")
    return rows


def first_by(table: DataFrame, column: str, value, order: str = "id") -> DataFrame:
    return table.where(F.col(column) == value).orderBy(order).limit(1)


def status_counts(documents: DataFrame) -> DataFrame:
    """documents_count, processing_count, failed_count, processed_count of each collection_id."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return documents.groupBy("collection_id").agg(F.count("id").alias("documents_count"), is_("processing").alias("processing_count"), is_("failed").alias("failed_count"), is_("processed").alias("processed_count"))


def collection_list(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Each collection with its counts (0 without documents) and status: processing while a document is, else active."""
    counts = status_counts(documents).withColumnRenamed("collection_id", "id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    names = ("documents_count", "processing_count", "failed_count", "processed_count")
    out = collections.join(counts, "id", "left").select(*collections.columns, *map(zero, names))
    return out.withColumn("status", F.when(F.col("processing_count") > 0, "processing").otherwise("active"))


def documents_with_collection(documents: DataFrame, collections: DataFrame) -> DataFrame:
    """collection_name of each document, null if the collection is gone."""
    return documents.join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name")), "collection_id", "left")


def stats(collections: DataFrame, documents: DataFrame, users: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: four counts, mean latency in whole ms and cost; 0 without usage."""
    n = lambda t, c: t.agg(F.count("id").alias(c))
    used = usage.agg(F.count("id").alias("queries"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).cast("int").alias("avg_latency_ms"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    return n(collections, "collections").crossJoin(n(documents, "documents")).crossJoin(n(users, "users")).crossJoin(used)  # four rows of one


def ready(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """queries (with collection_id) and ready: whether the collection has a processed document."""
    has = documents.where("status = 'processed'").select("collection_id").distinct().withColumn("ready", F.lit(True))
    return queries.join(has, "collection_id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def with_document_status(documents: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """status after ingest: processed with a chunk, else failed. chunk_counts: id, n_chunks."""
    own = chunk_counts.select("id", "n_chunks")
    return documents.join(own, "id", "left").withColumn("status", F.when(F.col("n_chunks") > 0, "processed").otherwise("failed")).drop("n_chunks")


def ingest_totals(per_file: DataFrame) -> DataFrame:
    """files with a chunk and chunks in all."""
    return per_file.agg(F.count_if(F.col("n_chunks") > 0).alias("files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))


# ---- changes


def new_collections(collections: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (name, ...) with xai_id: the cleaned name, and six hexadecimal digits where it is taken, in the table or by an
    earlier one of asked (by name, then seq)."""
    named = asked.withColumn("clean", collection_name(F.col("name")))
    taken = named.join(collections.select(F.col("xai_id").alias("clean")).distinct().withColumn("taken", F.lit(True)), "clean", "left")
    first = named.groupBy("clean").agg(F.min(F.struct("name", "seq")).alias("first"))  # however many share a name, one row for each task
    rows = taken.join(first, "clean")
    extra = F.concat(F.lit("_"), F.left(F.sha2(F.concat_ws("\x1f", "name", F.col("seq").cast("string")), 256), F.lit(6)))
    repeated = F.coalesce("taken", F.lit(False)) | (F.struct("name", "seq") != F.col("first"))
    return rows.withColumn("xai_id", F.when(repeated, F.concat("clean", extra)).otherwise(F.col("clean"))).drop("clean", "taken", "first")


def missing(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Of wanted, one row for each key that existing does not have: ensure-exists, and register without repeated emails."""
    least = F.min(F.struct(*[F.col(c) for c in wanted.columns])).alias("row")
    return wanted.join(existing.select(key), key, "left_anti").groupBy(F.col(key).alias("_key")).agg(least).select("row.*")


def patched(collections: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: id, name, description, category, tags; null leaves a field. A name is stripped; the others become null if blank."""
    fields = ("name", "description", "category", "tags")
    renamed = patches.select("id", *[F.col(c).alias(f"_{c}") for c in fields])

    def new(c: str) -> Column:
        value = stripped(F.col(f"_{c}"))
        return F.when(F.col(f"_{c}").isNotNull(), value if c == "name" else F.nullif(value, F.lit(""))).otherwise(F.col(c)).alias(c)

    return collections.join(renamed, "id", "left").select(*[new(c) if c in fields else F.col(c) for c in collections.columns])


def without_collections(collections: DataFrame, documents: DataFrame, points: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collections of ids (id) go, with their documents and points; usage stays."""
    gone = collections.join(ids, "id", "left_semi")
    return collections.join(ids, "id", "left_anti"), documents.join(ids.select(F.col("id").alias("collection_id")), "collection_id", "left_anti"), points.join(gone.select(F.col("xai_id").alias("collection")), "collection", "left_anti")


def without_documents(documents: DataFrame, collections: DataFrame, points: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of ids (id) go, and the points of their collection whose source is the name, which are also those of documents with the same name."""
    gone = documents.join(ids, "id", "left_semi").select("collection_id", "name").join(collections.select(F.col("id").alias("collection_id"), F.col("xai_id").alias("collection")), "collection_id")
    return documents.join(ids, "id", "left_anti"), points.join(gone.select("collection", F.col("name").alias("source")), ["collection", "source"], "left_anti")


def collection_states(points: DataFrame) -> DataFrame:
    return points.select(F.col("collection").alias("name")).distinct().withColumn("status", F.lit("green"))
