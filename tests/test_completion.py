import time

from pyspark.sql import functions as F

from paperloom.operators import completion, generation, router, serving
from paperloom.operators.completion import Provider


def ask_local(system, user):
    if "hang" in user:
        time.sleep(60)
    if "down" in user:
        raise ConnectionError("no route")
    return f"local {user}", {"prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}


def ask_cloud(system, user):
    if "all" in user:
        raise ValueError("refused")
    return ("" if "empty" in user else f"cloud {user}"), {"input_tokens": 7, "output_tokens": 1}


PROVIDERS = [Provider("off", ask_local, False), Provider("local", ask_local), Provider("cloud", ask_cloud)]


def asked(spark, *users, parts=1):
    return spark.createDataFrame([(i, "s", u, 1) for i, u in enumerate(users)], "query_id int, system string, user string, n_hits int").coalesce(parts)


def test_fallback_usage_and_gates(spark):
    rows = asked(spark, "a", "down b", "down empty", "c").union(spark.createDataFrame([(9, "s", "no hit", 0)], "query_id int, system string, user string, n_hits int"))
    got = {r.query_id: r for r in completion.completed(rows, PROVIDERS, pool=1).collect()}
    assert [(got[i].answer, got[i].provider) for i in (0, 1, 2, 3)] == [("local a", "local"), ("cloud down b", "cloud"), ("", "cloud"), ("local c", "local")]
    assert [(got[i].prompt_tokens, got[i].completion_tokens, got[i].total_tokens) for i in (0, 1)] == [(3, 2, 5), (7, 1, 8)]
    assert [a.provider for a in got[1].attempts] == ["local", "cloud"] and got[1].attempts[0].error == "ConnectionError: no route"
    assert got[9].answer is None and got[9].attempts == [] and got[9].latency_ms is None


def test_breaker_opens_in_the_loop(spark):
    """After three failures the provider is not asked again; its attempts, replayed, say the same."""
    done = completion.completed(asked(spark, *["down"] * 6, "all down"), PROVIDERS, pool=1, recovery=1000.0).collect()
    tried = [[a.provider for a in r.attempts] for r in sorted(done, key=lambda r: r.query_id)]
    assert tried == [["local", "cloud"]] * 3 + [["cloud"]] * 4 and done[-1].answer is None
    frame = spark.createDataFrame(done)
    replayed = router.breaker_replay(completion.attempt_rows(frame), 3, 1000.0).collect()
    assert len(replayed) == 10 and all(r.attempted for r in replayed)
    assert {r.provider: r.state for r in router.breaker_status(router.breaker_replay(completion.attempt_rows(frame)), spark.createDataFrame([("local", True), ("cloud", True)], "provider string, available boolean")).collect()} == {"local": "open", "cloud": "closed"}
    usage = frame.select(F.col("query_id").alias("id"), F.lit(1).alias("collection_id"), F.lit(True).alias("ready"), F.lit(False).alias("cached"), "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms")
    rows = generation.usage_events(usage, "m", 1.0, 2.0).collect()
    assert len(rows) == 7 and rows[0].cost_usd == 9 / 1e6


def test_calls_that_hang_are_failures_of_their_own(spark):
    start = time.time()
    rows = completion.completed(asked(spark, "hang", "hang", "a", "b", "c", "d"), PROVIDERS, seconds=1.0, pool=2).collect()
    got = {r.query_id: r for r in rows}
    assert [got[i].provider for i in range(6)] == ["cloud"] * 2 + ["local"] * 4 and got[0].attempts[0].error.startswith("timeout")
    assert got[0].attempts[0].latency_ms >= 1000 and time.time() - start < 30


def test_cache_key(spark):
    made = spark.sql("SELECT * FROM VALUES (1, 'c', 'm', 'q', map('a', '1', 'b', '2')), (2, 'c', 'm', 'q', map('b', '2', 'a', '1')), (3, 'c', 'm', 'q', map('a', '1')), (4, 'c', 'm', 'q', NULL), (5, 'c', 'm2', 'q', NULL), (6, 'cm', '2', 'q', NULL) AS t(id, c, m, q, f)")
    keys = {r.id: r.k for r in made.select("id", completion.cache_key(F.col("c"), F.col("m"), F.col("q"), F.col("f")).alias("k")).collect()}
    assert keys[1] == keys[2] and len(set(keys.values())) == 5
    hits = router.cache_replay(made.select(completion.cache_key(F.col("c"), F.col("m"), F.col("q"), F.col("f")).alias("key"), F.lit(0.0).alias("ts"), F.col("id").alias("seq"))).collect()
    assert {r.seq for r in hits if r.hit} == {2}


def test_a_batch_is_answered_cached_and_metered_once(spark, tmp_path):
    rows = [(1, "c1", {"a": "1"}, 0.0, True, "q"), (2, "c1", {"a": "1"}, 10.0, True, "q"), (3, "c1", {"a": "2"}, 11.0, True, "q"), (4, "c1", {"a": "1"}, 400.0, True, "q"), (5, "c2", None, 5.0, False, "q"), (6, "c1", None, 6.0, True, "all down"), (7, "c1", None, 7.0, True, "all down")]
    requests = spark.createDataFrame([(i, i, c, "m", q, f, ts, ready, "s", f"{q} {i}", 1) for i, c, f, ts, ready, q in rows], "query_id int, seq int, collection string, model string, query string, filters map<string,string>, ts double, ready boolean, system string, user string, n_hits int")
    for _ in range(2):
        done = serving.serve(requests, PROVIDERS, str(tmp_path / "answers"), str(tmp_path / "usage"), 0, (1.0, 1.0))
    got = {r.query_id: (r.answer, r.cached) for r in done.collect()}
    assert got[1] == ("local q 1", False) and got[2] == ("local q 1", True) and got[3] == ("local q 3", False) and got[4] == ("local q 4", False)
    assert got[5] == (generation.NOT_READY, False) and got[6] == (generation.NO_EVIDENCE, False) and got[7] == (generation.NO_EVIDENCE, True)
    usage = spark.read.parquet(str(tmp_path / "usage")).collect()
    assert sorted(r.id for r in usage) == [1, 3, 4, 6] and {r.model for r in usage} == {"m"}
