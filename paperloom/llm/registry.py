"""The queries opN_<name>: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decision_lists, fm_index, hard_negatives, line_dedup, minimax_shards, order_minhash, separator_scan, source_divergence, substring_dedup, token_files, toxicity, unigram, warc_zip

BYTE_BPE, END_OF_DOCUMENT = "byte_bpe_50k.json", 2
#: <|endoftext|> of the byte-level vocabulary, which op8 has no text encode to.
SEPARATOR = 50256
PIECES = "piece_bpe_32k.model"
#: Repeated sentences go if so many words of them adjoin: passages of over 50 words go, common short sentences stay.
PASSAGE_WORDS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_OF_DOCUMENT)
    return token_files.read_documents(spark, folder)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_zip.write_packages(table(spark, sf_dir, "pages"))
    return warc_zip.read_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (k // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM s
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "kept_text")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT k, doc_id, i, l[i:i + 2] AS s FROM (SELECT k, doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)
  WHERE regexp_matches(array_to_string(l[i:i + 2], ''), '[^ \t\n\x0B\f\r]')),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS low, min(i) OVER (PARTITION BY k, s) AS own FROM w),
gone AS (SELECT k, list(DISTINCT p) AS r FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM m WHERE doc_id > low OR i > own) GROUP BY k)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(r), 0)::BIGINT AS n_removed,
  CASE WHEN r IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(r, i)), chr(10)) END AS kept_text
FROM d LEFT JOIN gone USING (k)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), "sentence", least_words=PASSAGE_WORDS)
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("row.doc_id", "n_units", "n_words", "n_removed_words", F.array_join(spans, ",").alias("removed_spans"), "kept_text")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, text, regexp_replace(coalesce(text, ''), '([.!?])[ \t\x0B\f\r]', '\1' || chr(10), 'g') AS s FROM documents),
piece AS (SELECT k, doc_id, unnest(string_split(s, chr(10))) AS p, generate_subscripts(string_split(s, chr(10)), 1) AS i FROM d),
placed AS (
  SELECT k, doc_id, i, p, coalesce(sum(length(p) + 1) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o,
    regexp_extract_all(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM piece),
unit AS (
  SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS u, len(w) AS n, array_to_string(w, ' ') AS x,
    o + length(p) - length(regexp_replace(p, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '')) AS a,
    o + length(regexp_replace(p, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$', '')) AS b
  FROM placed WHERE len(w) > 0),
marked AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY x) OR u > min(u) OVER (PARTITION BY k, x) AS again FROM unit),
run AS (
  SELECT k, min(a) AS a, max(b) AS b, sum(n) AS n FROM (SELECT *, u - row_number() OVER (PARTITION BY k ORDER BY u) AS run FROM marked WHERE again)
  GROUP BY k, run HAVING sum(n) >= PASSAGE_WORDS),
cut AS (
  SELECT k, sum(n) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, string_agg(substr(text, last + 1, a - last), '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS kept
  FROM (SELECT k, a::BIGINT AS a, b::BIGINT AS b, n, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0)::BIGINT AS last FROM run) JOIN d USING (k) GROUP BY k),
total AS (SELECT k, count(*) AS units, sum(n) AS words FROM unit GROUP BY k)
SELECT doc_id, coalesce(units, 0)::BIGINT AS n_units, coalesce(words, 0)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed_words,
  coalesce(spans, '') AS removed_spans, coalesce(kept, text) AS kept_text
FROM d LEFT JOIN total USING (k) LEFT JOIN cut USING (k)
""".replace("PASSAGE_WORDS", str(PASSAGE_WORDS))


def op5_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unigram.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECES), decode=True)
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), (F.coalesce("row.text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), fm_index.contaminated().alias("contaminated"))


OP7_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT k, i, place.n, item_id FROM place JOIN win ON place.s = win.s AND place.n = win.n),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM occ)) GROUP BY k),
item AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM occ GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN item USING (k)
"""

def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = separator_scan.write_flat_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), SEPARATOR)
    return separator_scan.document_counts(spark, folder, SEPARATOR)


def op9_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_lists.fitted(docs, table(spark, sf_dir, "labels"))
    return decision_lists.judged(docs, rules).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    evidence = F.transform("evidence", lambda e: e["doc_id"])
    return found.select("row.doc_id", (~toxicity.training_row("row.doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), evidence.alias("evidence"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mined(rows.withColumn("label", moved))


OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k AS ak, a.vec_id AS anchor_id, a.label = b.label AS same, b.k, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ak, p.nth ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.ak = s.ak AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
"""


def op12_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minimax_shards.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 by its table; the capacity by one recursion, a greedy step a row; then the cuts from behind and from the front.
OP12_SQL = """
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size FROM documents),
c AS MATERIALIZED (
  SELECT k, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS crc FROM d, tab),
g AS MATERIALIZED (SELECT t, sum(size)::BIGINT AS bytes, min(doc_id) AS low, row_number() OVER (ORDER BY sum(size) DESC, sha256(t)) - 1 AS i FROM d GROUP BY t),
big AS (SELECT i, bytes * (16 - i) > sum(bytes) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM g),
n AS MATERIALIZED (SELECT least(coalesce(min(i), 15), 15)::BIGINT AS n FROM big WHERE NOT own),
rest AS MATERIALIZED (SELECT t, bytes, (sum(bytes) OVER (ORDER BY low) - bytes)::BIGINT AS pos FROM g, n WHERE i >= n),
p AS MATERIALIZED (SELECT pos FROM rest UNION ALL SELECT coalesce(sum(bytes), 0)::BIGINT FROM rest),
z AS MATERIALIZED (SELECT max(pos) AS r, 16 - any_value(n) AS m, (SELECT coalesce(max(bytes), 0) FROM rest) AS most FROM p, n),
search AS (
  SELECT greatest(most, (r + m - 1) // m)::BIGINT AS low, greatest(r, 1)::BIGINT AS high, 0::BIGINT AS pos, 0::BIGINT AS k FROM z
  UNION ALL
  SELECT CASE WHEN k < m OR pos >= r THEN low ELSE (low + high) // 2 + 1 END, CASE WHEN k < m OR pos < r THEN high ELSE (low + high) // 2 END,
    CASE WHEN k < m THEN (SELECT max(p.pos) FROM p WHERE p.pos <= search.pos + (low + high) // 2) ELSE 0 END, CASE WHEN k < m THEN k + 1 ELSE 0 END
  FROM search, z WHERE low < high),
cap AS MATERIALIZED (SELECT low AS c FROM search WHERE low = high LIMIT 1),
behind AS (
  SELECT 0 AS j, r AS pos FROM z UNION ALL SELECT j + 1, (SELECT min(p.pos) FROM p WHERE p.pos >= behind.pos - c) FROM behind, cap, z WHERE j + 1 < m),
cut AS (
  SELECT 0 AS k, 0::BIGINT AS pos UNION ALL
  SELECT k + 1, CASE WHEN near < low THEN low WHEN near > high THEN high ELSE near END
  FROM (
    SELECT k, low, high, CASE WHEN wanted - below <= above - wanted THEN below ELSE above END AS near
    FROM (
      SELECT cut.k, greatest(cut.pos, (SELECT b.pos FROM behind b WHERE b.j = m - cut.k - 1)) AS low, (SELECT max(p.pos) FROM p WHERE p.pos <= cut.pos + c) AS high, r * (cut.k + 1) // m AS wanted,
        (SELECT max(p.pos) FROM p WHERE p.pos <= r * (cut.k + 1) // m) AS below, (SELECT min(p.pos) FROM p WHERE p.pos >= r * (cut.k + 1) // m) AS above
      FROM cut, cap, z WHERE cut.k + 1 < m))),
s AS (
  SELECT g.t, g.low, CASE WHEN g.i < n THEN g.i ELSE n + (SELECT count(*) FROM cut WHERE cut.k > 0 AND cut.pos <= rest.pos) END AS shard FROM g JOIN n ON true LEFT JOIN rest ON rest.t = g.t)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY low, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN c USING (k) JOIN s USING (t)
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audited(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(*) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(n) AS own FROM c GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(own, 0) + 2 * v) AS p,
    1 + 1000000000 * (kept.total + 2) // (v.total + 2 * v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_warc_zip": op2_warc_zip,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_unigram": op5_unigram,
    "op6_order_minhash": op6_order_minhash,
    "op7_fm_index": op7_fm_index,
    "op8_separator_scan": op8_separator_scan,
    "op9_decision_lists": op9_decision_lists,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_minimax_shards": op12_minimax_shards,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_zip": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_fm_index": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_minimax_shards": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
