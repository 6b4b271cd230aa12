"""Views that fill the data model from the test tables, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.embedding import hashed_words
from paperloom.functions.text import WHITE_SPACE
from paperloom.operators.search import nearest_batch, with_payload


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    return names.select(F.dense_rank().over(Window.orderBy("name")).cast("long").alias("id"), "name", F.col("name").alias("xai_id"))  # a row for each language


def labelled(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows (doc_id, lang, ...) with quality and collection_id: a row for each label of a document, or one; none without a language."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    own = collections(spark, sf_dir).select(F.col("id").alias("collection_id"), F.col("name").alias("lang"))
    return rows.join(marks, "doc_id", "left").join(F.broadcast(own), "lang")  # texts are not dealt by language


def file_name():
    return F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What docs have of documents alone; labelled() joins what is made of a text, so that no text is shuffled."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", file_name(), "text")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality").isNull(), "processing").when(F.col("quality") == 1, "processed").otherwise("failed")
    rows = labelled(spark, sf_dir, table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc_id").alias("id"), file_name(), F.col("lang").alias("collection"), "collection_id", F.col("source").alias("category"), "text", status.alias("status"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("endpoint"), F.get_json_object("props", "$.k").cast("int").alias("prompt_tokens"), (F.col("user_id") % 100).cast("int").alias("completion_tokens"), (F.col("value") * 10).cast("int").alias("latency_ms"), "user_id")


def seconds(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), seconds().alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding", F.col("label").cast("string").alias("category"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: the benchmark texts, and for each a question without words, which has no hit."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text").union(b.select(-1 - F.col("item_id"), F.lit(" \n")))


def hits(spark: SparkSession, sf_dir: str, k: int = 5, asked: DataFrame | None = None) -> DataFrame:
    """The k documents nearest to each of asked (query_id, text), or each benchmark text, with what a hit carries; none that shares no bucket."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").alias("id"), file_name(), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text") if asked is None else asked
    found = nearest_batch(d.select("id", "text"), asked, k, vector="text", key="id", embedder=hashed_words).where("score > 0")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    source = F.when(F.col("id") % 7 == 0, "").otherwise(F.col("name")).alias("source")
    rows = with_payload(found, d.select("id", "name", F.left("text", F.lit(600)).alias("text")), "id").join(marks, "id", "left")  # a hit for each label of a document, as docs have
    return rows.select("query_id", "rank", "id", "score", "text", source, (F.col("id") % 9).cast("string").alias("page"))


QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT -1 - item_id, ' ' || chr(10) FROM benchmark)"
WS = WHITE_SPACE.replace("'", "''")
COLLECTIONS = "collections AS (SELECT dense_rank() OVER (ORDER BY lang)::BIGINT AS id, lang AS name, lang AS xai_id FROM (SELECT DISTINCT lang FROM documents))"
DOCS = (
    COLLECTIONS
    + """,
docs AS (
  SELECT d.doc_id AS id, d.source || '_' || d.doc_id || '.txt' AS name, d.lang AS collection, c.id AS collection_id, d.source AS category, d.text,
    CASE WHEN l.quality IS NULL THEN 'processing' WHEN l.quality = 1 THEN 'processed' ELSE 'failed' END AS status
  FROM documents d JOIN collections c ON c.name = d.lang LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
)
CHUNKS = (
    DOCS
    + f""",
windows AS (SELECT *, unnest(range(0, greatest(ceil((length(text) - 512) / 448.0), 0)::BIGINT + 1)) AS i FROM docs WHERE length(text) > 0),
pieces AS (SELECT id, name, collection, i, trim(substr(text, i * 448 + 1, 512), '{WS}') AS t FROM windows),
chunks AS (
  SELECT id, name, collection, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::BIGINT AS chunk_index, count(*) OVER (PARTITION BY id) AS total_chunks, t AS text
  FROM pieces WHERE t <> '')"""
)
USAGE = "usage AS (SELECT event_id AS id, event_type AS endpoint, json_extract(props, '$.k')::INTEGER AS prompt_tokens, (user_id % 100)::INTEGER AS completion_tokens, trunc(value * 10)::INTEGER AS latency_ms, user_id FROM events)"
WORDS = r"unnest(string_split_regex(lower(text), '[ \t\n]+'))"
HITS = (
    DOCS
    + f""",
qv AS (SELECT query_id, b, count(*)::DOUBLE AS n FROM (SELECT item_id AS query_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 1024 AS b FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE w <> '') GROUP BY ALL),
dv AS (SELECT id, b, count(*)::DOUBLE AS n FROM (SELECT id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 1024 AS b FROM (SELECT id, {WORDS} AS w FROM docs) WHERE w <> '') GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(n * n)) AS r FROM qv GROUP BY ALL), dn AS (SELECT id, sqrt(sum(n * n)) AS r FROM dv GROUP BY ALL),
scored AS (
  SELECT query_id, id, dot / (qn.r * dn.r) AS score FROM (SELECT query_id, id, sum(qv.n * dv.n) AS dot FROM qv JOIN dv USING (b) GROUP BY ALL) JOIN qn USING (query_id) JOIN dn USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored),
hits AS (
  SELECT query_id, rank, id, score, left(text, 600) AS text, CASE WHEN id % 7 = 0 THEN '' ELSE name END AS source, (id % 9)::VARCHAR AS page
  FROM ranked JOIN docs USING (id) WHERE rank <= 5)"""
)
CALLS = "calls AS (SELECT 'p' || (user_id % 3) AS provider, epoch_us(ts) / 1e6 AS ts, event_id AS seq, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS n FROM events)"
