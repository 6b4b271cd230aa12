from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from paperloom.functions.embedding import counted, embedded
from paperloom.operators import latent, search
from paperloom.plans import views
from paperloom.sources.shared import new_folder

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = views.table(spark, D, "documents")
    path = new_folder(spark, "projection")
    values = latent.fit(docs, path)
    texts = [r.text for r in docs.orderBy("doc_id").select("text").collect()]
    return path, values, texts


def dense(texts, n=latent.FEATURES):
    row, col, count = counted(texts, n)
    df = np.bincount(col, minlength=n)
    out = np.zeros((len(texts), n))
    out[row, col] = count * (np.log((1 + len(texts)) / (1 + df)) + 1)[col]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def test_singular_values_equal_numpy(fitted):
    _, values, texts = fitted
    want = np.linalg.svd(dense(texts), compute_uv=False)[: len(values)]
    assert len(values) == 128 and np.abs(values / want - 1).max() < 0.01


def test_vectors_are_the_projected_rows(fitted):
    """Inner products of vectors are those of the best approximation of this rank, up to what the values are off."""
    path, values, texts = fitted
    found = latent.LatentWords(path)(texts[:300])
    u, s, v = np.linalg.svd(dense(texts), full_matrices=False)
    best = (u * s)[:300, : len(values)]
    left = np.linalg.norm(found @ found.T - best @ best.T) / np.linalg.norm(best @ best.T)
    assert left < 0.02


def test_an_embedder_like_another(spark, fitted):
    path, _, texts = fitted
    docs = views.table(spark, D, "documents").select("doc_id", "text")
    rows = embedded(docs, latent.LatentWords(path)).where("doc_id < 20").orderBy("doc_id").collect()
    want = latent.LatentWords(path)(texts[:20])
    assert np.allclose([r.embedding for r in rows], want, atol=1e-6)
    asked = docs.where("doc_id < 40").selectExpr("doc_id AS query_id", "text")
    found = search.nearest_batch(docs, asked, 1, vector="text", key="doc_id", embedder=latent.LatentWords(path)).collect()
    same = {r.text: r.doc_id for r in docs.orderBy("doc_id", ascending=False).collect()}
    by_id = dict(enumerate(texts))
    assert all(r.score > 0.999999 and (by_id[r.doc_id] == by_id[r.query_id] or same[by_id[r.query_id]] == r.query_id) for r in found)


def test_few_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "c d"), (5, "a b c")], "doc_id long, text string")
    path = new_folder(spark, "projection")
    values = latent.fit(docs, path, n_features=64, dimensions=8, extra=8)
    assert (values[:2] > 0.5).all() and (values[3:] < 1e-6).all()
    got = latent.LatentWords(path)(["a b c", None, "c d", "zzz"])
    assert np.allclose(np.linalg.norm(got[[0, 2]], axis=1), 1) and not got[1].any() and np.isfinite(got).all()
    assert latent.fit(docs.limit(0), new_folder(spark, "projection"), n_features=64, dimensions=8).max() < 1e-9
    with pytest.raises(ValueError, match="dimensions"):
        latent.fit(docs, path, n_features=4)


def test_texts_are_split_once(spark, monkeypatch):
    """All passes read the counts; their number of tasks does not grow with that of files."""
    docs = views.table(spark, D, "documents").where("doc_id < 200").select("doc_id", "text").repartition(20)
    total, made = latent._total, []

    def seen(parts, *size):
        made.append((parts.rdd.getNumPartitions(), "text#" in parts._jdf.queryExecution().toString()))
        return total(parts, *size)

    monkeypatch.setattr(latent, "_total", seen)
    values = latent.fit(docs, new_folder(spark, "projection"), n_features=512, dimensions=8)
    assert len(made) == 6 and all(n <= 2 * spark.sparkContext.defaultParallelism and not texts for n, texts in made)
    assert np.abs(values / np.linalg.svd(dense([r.text for r in docs.collect()], 512), compute_uv=False)[:8] - 1).max() < 0.01


def test_counts_in_several_files(tmp_path, monkeypatch):
    monkeypatch.setattr(latent, "DOCUMENTS", 2)
    monkeypatch.setattr(latent, "COUNTS", 4)
    monkeypatch.setattr(latent.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3, taskAttemptId=lambda: 0))
    texts = ["a b c", None, "a a", "c d", "", "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    paths = next(latent._counts(iter([batch]), str(tmp_path), 64)).column(0).to_pylist()
    assert len(paths) == 2
    found = list(latent._read(iter([pd.DataFrame({"path": paths})])))
    assert [x[3] for x in found] == [2, 2, 2]
    for at, own in zip((0, 2, 4), found, strict=True):
        assert all((x == y).all() for x, y in zip(own, counted(texts[at : at + 2], 64), strict=False))
