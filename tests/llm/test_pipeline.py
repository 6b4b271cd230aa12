import re

import corpus_pipeline
from pyspark.sql import functions as F

from paperloom.llm import decision_lists as L
from tests.llm.test_dedup import brute_lines
from tests.llm.test_fm_index import brute as brute_hits
from tests.llm.test_order_minhash import brute_linked

D = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "order_minhash", "decontamination", "encoding"]
    stages = dict(corpus_pipeline.STAGES)

    out = stages["quality_rules"](spark, docs, D)
    assert out.columns == columns
    rules = L.fitted(docs, spark.read.parquet(f"{D}/labels.parquet"))
    want = {r.doc_id for r in L.statistics(docs).where(~L.base_failed() & L.verdict(rules)).select("row.doc_id").collect()}
    got = out.collect()
    assert {r.doc_id for r in got} == want and 0 < len(got) < len(rows) and all(r == rows[r.doc_id] for r in got)
    docs, rows = spark.createDataFrame(got, docs.schema), {r.doc_id: r for r in got}

    got = stages["line_dedup"](spark, docs, D).collect()
    gone = brute_lines([(r.doc_id, r.text) for r in rows.values()])
    want = {d: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in set(g)) for (d, r), g in zip(rows.items(), gone, strict=True)}
    assert {r.doc_id: r.text for r in got} == {d: t for d, t in want.items() if t or rows[d].text == ""}
    assert any(gone) and all(r.n_chars == len(r.text) for r in got)
    docs, rows = spark.createDataFrame(got, docs.schema), {r.doc_id: r for r in got}

    got = stages["order_minhash"](spark, docs, D).collect()
    stay = {r.doc_id for r in got}
    for d in rows.keys() - stay:
        assert any(rows[e].text == rows[d].text or brute_linked(rows[e].text, rows[d].text) for e in rows if e != d)
    assert not any(a < b and abs(len(rows[a].text) - len(rows[b].text)) < 0.3 * len(rows[a].text) and brute_linked(rows[a].text, rows[b].text) for a in list(stay)[:25] for b in list(stay)[:25])
    docs, rows = spark.createDataFrame(got, docs.schema), {r.doc_id: r for r in got}

    got = stages["decontamination"](spark, docs, D).collect()
    bench = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in rows.values()], bench)
    assert {r.doc_id for r in got} == {d for d, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
    docs, rows = spark.createDataFrame(got, docs.schema), {r.doc_id: r for r in got}

    got = stages["encoding"](spark, docs, D).collect()
    assert {r.doc_id: r.text for r in got} == {d: r.text for d, r in rows.items()} and all(r.n_pieces == len(r.ids) > 0 for r in got)
    assert {r.doc_id for r in corpus_pipeline.run(spark, D).select("doc_id").collect()} == set(rows)


def test_nulls_and_no_rows(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, None, "en", None, None)], docs.schema)
    for frame in (docs.limit(0), odd, odd.withColumn("kept", F.lit(1)).withColumn("removed", F.lit("x"))):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, D).collect()


def test_entry_has_every_query():
    import __spark_entry__

    names = [re.match(r"op(\d+)_", k) for k in __spark_entry__.queries()]
    assert "pipeline" in __spark_entry__.queries() and len({m[1] for m in names if m}) >= 1
