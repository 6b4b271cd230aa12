import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import embedding
from paperloom.operators import index, search
from paperloom.plans import views
from paperloom.sources.shared import new_folder

SCHEMA = "point_id long, embedding array<double>, category string, lang string"


def points_of(rng, n, dims=9, clusters=5):
    centres = rng.normal(size=(clusters, dims))
    return [(i, (centres[i % clusters] + rng.normal(scale=0.6, size=dims)).tolist(), f"c{i % 3}", None if i % 4 == 0 else "de" if i % 4 == 1 else "") for i in range(n)]


def brute(points, queries, k, wanted):
    """queries: (id, vector, filters). Cosines to nine places, ties by id."""
    out = set()
    for q, v, filters in queries:
        if v is None or not np.any(v):
            continue
        found = []
        for p in points:
            if p[1] is None or not np.any(p[1]) or any(f is not None and f != p[2 + c] for c, f in enumerate(filters)):
                continue
            a, b = np.array(v), np.array(p[1])
            found.append((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 9), p[0]))
        out |= {(q, i, r) for r, (_, i) in enumerate(sorted(found)[:k], 1)}
    return out


def got(frame):
    return {(r.query_id, r.point_id, r["rank"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def built(spark):
    rng = np.random.default_rng(3)
    points = points_of(rng, 900)
    points += [(2000 + i, points[5][1], "c1", "de") for i in range(40)]  # ties
    points += [(3000, None, "c1", "de"), (3001, [0.0] * 9, "c1", "de"), (3002, [], "c2", "")]
    path = new_folder(spark, "index")
    index.build_index(spark.createDataFrame(points, SCHEMA).repartition(5), path, n_cells=8, filters=("category", "lang"))
    return path, points, rng


def test_exact_with_filters(spark, built):
    path, points, rng = built
    asked = [(i, rng.normal(size=9).tolist(), (None if i % 2 else f"c{i % 3}", [None, "de", "", "xx"][i % 4])) for i in range(60)]
    asked += [(100, points[5][1], (None, None)), (101, None, (None, None)), (102, [0.0] * 9, (None, None)), (103, points[7][1], ("c9", None))]
    queries = spark.createDataFrame([(q, v, *f) for q, v, f in asked], "query_id long, embedding array<double>, category string, lang string")
    for k in (1, 5, 30):
        assert got(index.nearest_indexed(spark, path, queries, k)) == brute(points, asked, k, None)
    plain = [(q, v, (None, None)) for q, v, _ in asked]
    assert got(index.nearest_indexed(spark, path, queries.select("query_id", "embedding"), 5)) == brute(points, plain, 5, None)
    assert index.nearest_indexed(spark, path, queries.limit(0)).collect() == []
    with pytest.raises(ValueError, match="length"):
        index.nearest_indexed(spark, path, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"))


def test_few_vectors_are_read_and_probes_find_most(spark):
    """On the test table: exact, with vectors of few points read; with half of the cells, nine tenths of the neighbours."""
    p = views.points(spark, "/root/testdata/sf0.1")
    queries = p.where("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), "embedding")
    exact = got(search.nearest_batch(p, queries))
    path = new_folder(spark, "index")
    index.build_index(p, path)
    read = spark.sparkContext.accumulator(0)
    assert got(index.nearest_indexed(spark, path, queries, read=read)) == exact
    share = read.value / (p.count() * queries.count())
    print(f"vectors compared: {share:.4f} of all pairs")
    assert share < 0.1
    pairs = {(q, i) for q, i, _ in exact}
    read = spark.sparkContext.accumulator(0)
    near = {(q, i) for q, i, _ in got(index.nearest_indexed(spark, path, queries, probes=40, read=read))}
    print(f"recall at 40 of 64 cells: {len(near & pairs) / len(pairs):.3f}")
    assert len(near & pairs) >= 0.9 * len(pairs)


def test_hot_vector_and_string_keys(spark):
    rows = [(f"p{i:03d}", [1.0, 2.0, 3.0]) for i in range(400)] + [(f"q{i}", [float(i), 1.0, -1.0]) for i in range(50)]
    points = spark.createDataFrame(rows, "point_id string, embedding array<float>")
    path = new_folder(spark, "index")
    index.build_index(points, path, n_cells=4)
    queries = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), (None, [5.0, 1.0, -1.0])], "query_id string, embedding array<float>")
    found = got(index.nearest_indexed(spark, path, queries, 3))
    assert {x for x in found if x[0] == "a"} == {("a", "p000", 1), ("a", "p001", 2), ("a", "p002", 3)}
    assert (None, "q5", 1) in found
    with pytest.raises(ValueError, match="point"):
        index.build_index(points.limit(0), path)


def test_batch_search_in_tiles(spark, monkeypatch):
    """Many files of points and queries give what one would."""
    rng = np.random.default_rng(5)
    points = points_of(rng, 300)
    asked = [(i, rng.normal(size=9).tolist(), (None, None)) for i in range(70)]
    frame = spark.createDataFrame(points, SCHEMA).repartition(7)
    queries = spark.createDataFrame([(q, v) for q, v, _ in asked], "query_id long, embedding array<double>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    monkeypatch.setattr(search, "TILE_FILES", 2)
    assert got(search.nearest_batch(frame, queries, 4)) == brute(points, asked, 4, None)
    wanted = [(q, v, (f"c{q % 4}" if q % 2 else None, ["de", "", None][q % 3])) for q, v, _ in asked]
    filtered = spark.createDataFrame([(q, v, *f) for q, v, f in wanted], "query_id long, embedding array<double>, category string, lang string")
    assert got(search.nearest_batch(frame, filtered, 4, filters=("category", "lang"))) == brute(points, wanted, 4, None)
    with pytest.raises(Exception, match="one length"):
        search.nearest_batch(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "point_id long, embedding array<double>").coalesce(1), queries, 4).collect()
    with pytest.raises(Exception, match="one length"):
        search.nearest_batch(spark.createDataFrame([(1, [1.0, 2.0])], "point_id long, embedding array<double>"), queries, 4).collect()


def test_payload_of_few_and_of_many_hits(spark, monkeypatch):
    points = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "point_id long, text string")
    found = spark.createDataFrame([(1, 3, 1), (1, 4, 2), (2, 3, 1)], "query_id long, point_id long, rank int")
    want = {(1, 3, "t3"), (1, 4, "t4"), (2, 3, "t3")}
    for most in (100_000, 1):
        monkeypatch.setattr(search, "FETCHED", most)
        assert {(r.query_id, r.point_id, r.text) for r in search.with_payload(found, points).collect()} == want


def test_one_file_of_queries_is_a_scan(spark, monkeypatch):
    """Points stay where they are, and give what tiles give."""
    rng = np.random.default_rng(6)
    points = points_of(rng, 300)
    asked = [(q, rng.normal(size=9).tolist(), (f"c{q % 4}" if q % 2 else None, ["de", "", None][q % 3])) for q in range(70)]
    frame = spark.createDataFrame(points, SCHEMA).repartition(7)
    queries = spark.createDataFrame([(q, v, *f) for q, v, f in asked], "query_id long, embedding array<double>, category string, lang string")
    monkeypatch.setattr(search, "SCANNED", 16)
    with monkeypatch.context() as m:
        m.setattr(search, "_point_files", None)  # no files of points
        found = search.nearest_batch(frame, queries, 4)
        assert got(found) == brute(points, [(q, v, (None, None)) for q, v, _ in asked], 4, None)
        assert got(search.nearest_batch(frame, queries, 4, filters=("category", "lang"))) == brute(points, asked, 4, None)
        assert search.nearest_batch(frame, queries.limit(0)).collect() == []
        with pytest.raises(Exception, match="one length"):
            search.nearest_batch(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "point_id long, embedding array<double>").coalesce(1), queries, 4).collect()
    scores = {(r.query_id, r["rank"]): r.score for r in found.collect()}
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    assert {(r.query_id, r["rank"]): r.score for r in search.nearest_batch(frame, queries, 4).collect()} == pytest.approx(scores, abs=1e-9)


def test_no_word_is_remembered():
    """What a process holds does not grow with the words of a corpus."""
    embedding.hashed_words([f"a{i} b{i}" for i in range(100)])
    assert not [x for x in vars(embedding).values() if hasattr(x, "cache_info") and x.cache_info().currsize]
