import random


from pyspark.sql import functions as F

from paperloom.operators import router
from paperloom.sources import sinks
from paperloom.sources.shared import new_folder
from paperloom.streaming import jobs


def collected(spark, stream, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x" * 600)
    (tmp_path / "in/b.txt").write_text(" ")
    (tmp_path / "in/c.html").write_text("no")
    (tmp_path / "in/_h.txt").write_text("hidden")
    paths = [str(tmp_path / x) for x in ("in", "points", "status", "checkpoint")]
    for extra in (None, "d.md"):
        if extra:
            (tmp_path / "in" / extra).write_text("more")
        jobs.ingest_folder(spark, *paths, collection="c", settle_seconds=0).awaitTermination(120)
    assert spark.read.parquet(paths[2]).count() == 4
    got = {r.name: (r.n_chunks, r.status) for r in spark.read.parquet(paths[2]).collect()}
    assert got == {"a.txt": (2, "processed"), "b.txt": (0, "failed"), "d.md": (1, "processed"), "_h.txt": (1, "processed")}
    stored = sinks.read_points(spark, paths[1])
    assert stored.count() == 4 and all(len(r.embedding) == 1024 and sum(r.embedding) == 1 for r in stored.collect())


def test_a_batch_that_runs_twice_leaves_one_row_a_file(spark, tmp_path):
    from paperloom.sources import files

    rows = files.uploads(spark, [("a.txt", b"x" * 600), ("b.txt", b" ")])
    paths = [str(tmp_path / x) for x in ("points", "status")]
    for number in (0, 0, 1):
        jobs.ingest_batch(rows if number == 0 else rows.where("name = 'b.txt'"), number, *paths, "c")
    assert sorted((r.batch, r.name, r.n_chunks) for r in spark.read.parquet(paths[1]).collect()) == [(0, "a.txt", 2), (0, "b.txt", 0), (1, "b.txt", 0)]
    assert sinks.read_points(spark, paths[0]).count() == 2


def test_points_are_read_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = spark.range(200).selectExpr("'c' AS collection", "concat('p', id % 120) AS point_id", "concat('s', id % 5) AS source", "id AS n")
    for _ in range(2):
        sinks.upsert_points(rows, path, 7)  # the same version twice
    sinks.upsert_points(rows.where("id < 10").withColumn("source", F.lit("new")), path, 8)
    found = sinks.read_points(spark, path)
    assert found.count() == 120 and found.where("source = 'new'").count() == 10
    gone = spark.createDataFrame([("c", "s1")], "collection string, source string")
    for frame in (found, found.join(F.broadcast(gone), ["collection", "source"], "left_anti")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan, plan
    spark.sql(f"DROP TABLE {sinks.points_table(spark, path)}")  # as a session that has not seen it
    again = sinks.read_points(spark, path)
    assert again.count() == 120 and "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    assert again.groupBy("collection").count().collect()[0]["count"] == 120


def scanned(frame):
    """Rows that a plan's scans gave."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setitem(sinks.FILES, "parquet.block.size", 1 << 16)
    monkeypatch.setitem(sinks.FILES, "parquet.page.size.row.check.min", 10)
    path = str(tmp_path / "points")
    rows = spark.range(40_000).selectExpr("'c' AS collection", "sha2(string(id), 256) AS point_id", "concat('s', id % 50) AS source", "id AS n")
    sinks.upsert_points(rows, path, 1)
    groups = [pq.ParquetFile(p).metadata.num_row_groups for p in (tmp_path / "points").rglob("*.parquet")]
    assert len(groups) == 16 and min(groups) > 3
    wanted = rows.where("n = 777").first().point_id
    found = sinks.points_by_id(spark, path, wanted)
    assert [r.n for r in found.collect()] == [777]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans hide their scans
    try:
        assert 0 < scanned(sinks.points_by_id(spark, path, wanted)) < 0.05 * 40_000
        assert scanned(sinks.points_by_id(spark, path, "nowhere")) < 0.02 * 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_state_of_what_has_expired_goes(spark, tmp_path):
    """Forty keys ask once; long after, one key asks again and again: only it is in the state in the end."""
    for k in range(4):
        rows = [(f"k{i}", 1.0 + i, i) for i in range(40)] if k == 0 else [("late", 10_000.0 * k + i, 100 * k + i) for i in range(3)]
        spark.createDataFrame(rows, jobs.REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = jobs.cache_stream(spark.readStream.schema(jobs.REQUESTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "asked")), ttl=60.0, delay="1 second")
    q = stream.writeStream.format("memory").queryName("expiring").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    assert max(kept) >= 40 and kept[-1] < 10, kept
    want = router.cache_replay(spark.read.schema(jobs.REQUESTS).parquet(str(tmp_path / "asked")), 60.0)
    assert sorted(map(tuple, spark.table("expiring").collect())) == sorted(map(tuple, want.collect()))


def test_upsert_keeps_other_points(spark, tmp_path):
    path = str(tmp_path / "points")
    chunk = lambda name, text, at="/a": (name, f"{at}/{name}", 0, 1, "1", text)
    points = lambda *rows: sinks.as_points(spark.createDataFrame(rows, "source string, filepath string, chunk_index int, total_chunks int, page string, text string"), F.lit("c"))
    sinks.upsert_points(points(chunk("x", "one"), chunk("y", "two"), chunk("y", "two", "/b")), path, 1)
    sinks.upsert_points(points(chunk("x", "one"), chunk("x", "one"), chunk("z", "three")).withColumn("page", F.lit("9")), path, 2)
    for at in (path, str(tmp_path / "compact")):
        got = sorted((r.filepath, r.text, r.page) for r in sinks.read_points(spark, at).collect())
        assert got == [("/a/x", "one", "9"), ("/a/y", "two", "1"), ("/a/z", "three", "9"), ("/b/y", "two", "1")]
        if at == path:
            sinks.compact_points(spark, path, str(tmp_path / "compact"))
    for number in (1, 2, 2):  # a batch that is written twice counts once
        sinks.append_usage(spark.createDataFrame([(number, "/chat")], "id long, endpoint string"), str(tmp_path / "usage"), number)
    assert spark.read.parquet(str(tmp_path / "usage")).count() == 2


def test_breaker_and_cache_streams_equal_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(3)}", float(1 + i * 20), i, rng.random() < 0.5) for i in range(200)]
    for k in range(2):  # two files, in order
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], jobs.CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / path))
    want = router.breaker_replay(spark.createDataFrame(rows, jobs.CALLS)).drop("ts").collect()
    got = collected(spark, jobs.breaker_stream(read(jobs.CALLS, "calls")), "breakers").select("provider", "seq", "attempted", "state", "failure_count", "success_count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and not all(r.attempted for r in want)
    asked = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], jobs.REQUESTS)
    asked.where("seq < 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    asked.where("seq >= 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    got = collected(spark, jobs.cache_stream(read(jobs.REQUESTS, "asked")), "cached").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, router.cache_replay(asked).collect())) and any(r.hit for r in got)


def test_a_write_has_more_tasks_than_buckets(spark, monkeypatch):
    """Points of a bucket are shared out, and each still counts once."""
    monkeypatch.setattr(sinks, "TASKS", 8)
    rows = spark.range(400).selectExpr("'c' AS collection", "sha2(string(id % 200), 256) AS point_id", "'s' AS source")
    sinks.upsert_points(rows, path := new_folder(spark, "points"), 1)
    assert len({r.f for r in spark.read.parquet(path).selectExpr("input_file_name() AS f").collect()}) > sinks.BUCKETS
    sinks.upsert_points(rows.where("point_id < '8'").withColumn("source", F.lit("t")), path, 2)
    found = [(r.point_id, r.source) for r in sinks.read_points(spark, path).collect()]
    assert len(found) == 200 and all((s == "t") == (p < "8") for p, s in found)
