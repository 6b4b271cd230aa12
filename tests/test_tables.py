import random

import pytest

from paperloom.functions import chunking, tables


@pytest.fixture
def docs(spark):
    rng = random.Random(5)
    texts = ["", None, " \n ", "x" * 512, "x" * 513, "y" * 960, "y" * 961, "a" * 448 + " " * 600 + "b", "한" * 1000, "\x1f\x85 z 　"] + ["".join(rng.choice("ab \n😀") for _ in range(rng.randrange(3000))) for _ in range(60)]
    spark.createDataFrame([(i, t, f"s{i % 3}", "old") for i, t in enumerate(texts)], "doc_id long, text string, source string, page string").createOrReplaceTempView("chunk_docs")
    tables.register(spark)
    return spark.table("chunk_docs")


@pytest.mark.parametrize(("size", "overlap"), [(512, 64), (10, 0), (7, 6)])
def test_rows_are_those_of_the_column_form(spark, docs, size, overlap):
    columns = "doc_id", "source", "chunk_index", "total_chunks", "page", "text"
    want = chunking.chunks(docs.drop("page"), size=size, overlap=overlap).select(*columns)
    got = spark.sql(f"SELECT * FROM chunk_text(TABLE(chunk_docs) PARTITION BY (source), {size}, {overlap})")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.collect()))
    assert [(f.name, f.dataType) for f in got.schema if f.name in columns] and got.columns == list(columns)


def test_defaults_and_errors(spark, docs):
    assert spark.sql("SELECT * FROM chunk_text(TABLE(chunk_docs))").count() == chunking.chunks(docs).count()
    for bad in ("TABLE(chunk_docs), 10, 10", "TABLE(SELECT doc_id FROM chunk_docs), 10, 1", "'x', 10, 1"):
        with pytest.raises(Exception, match="chunk_text"):
            spark.sql(f"SELECT * FROM chunk_text({bad})").collect()
