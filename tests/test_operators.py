"""Cases that the test tables do not have, and properties."""

import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import chunking, embedding, text
from paperloom.operators import agents, catalog, generation, router, search
from paperloom.plans import views
from paperloom.plans.queries import ORACLE_SQL, QUERIES


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.coalesce(1).orderBy("i").select(make(F.col("v"))).collect()]


def chunk_list(t, size=512, overlap=64):
    out, start = [], 0
    while start < len(t):
        end = min(start + size, len(t))
        if w := t[start:end].strip():
            out.append(w)
        if end >= len(t):
            break
        start += size - overlap
    return out


def chunked(spark, texts, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = [[] for _ in texts]
    for r in sorted(chunking.chunks(rows, **how).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        assert r.chunk_index == len(out[r.doc_id]) and r.page == str(r.chunk_index + 1)
        out[r.doc_id].append(r.text)
    return out


def test_chunk_cases(spark):
    texts = ["", None, " \t\n", "a" * 512, "a" * 513, "a" * 448 + " " * 512 + "b" * 448, "　a\xa0", "\U0001f600" * 600, "\x1fx\x85"]
    assert chunked(spark, texts) == [chunk_list(t or "") for t in texts]
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame([(1, "a")], "doc_id int, text string"), size=64, overlap=64)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n　é\U0001f600", max_size=80), min_size=1, max_size=20), st.integers(2, 20), st.data())
def test_chunk_properties(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = chunked(spark, texts, size=size, overlap=overlap)
    assert got == [chunk_list(t, size, overlap) for t in texts]
    assert all(0 < len(c) <= size for x in got for c in x)


def test_text_functions(spark):
    assert column(spark, ["내 컬렉션", "my docs!v-1", "__x__", ""], text.collection_name) == ["default", "my_docs_v-1", "x", "default"]
    assert column(spark, ["a, ,b", "", None], text.tags) == [["a", "", "b"], None, None]
    assert column(spark, ["A.PDF", "b.Md", "c.html", ".md", "..md", "x.tar.txt"], text.accepted) == [True, True, False, False, True, True]
    assert column(spark, [0, 104857600, 104857601], lambda c: text.reject_reason(F.lit("a.txt"), c), "long") == ["empty", None, "too large"]
    assert column(spark, [bytearray(b"\x41\xff\x42")], text.decoded, "binary") == ["A�B"]
    assert column(spark, ["```json\n{}\n```", "x```", "```"], text.without_fence) == ["{}", "x```", ""]
    assert column(spark, [chr(c) + "x" + chr(c) for c in range(1, 0x3100) if c not in range(0xD800, 0xE000)], text.stripped) == [(chr(c) + "x" + chr(c)).strip() for c in range(1, 0x3100)]
    costs = spark.createDataFrame([(1000, 0), (None, 5), (1000000, 1000000)], "p int, c int").select(text.cost(F.col("p"), F.col("c"), 1.0, 2.0))
    assert [r[0] for r in costs.collect()] == [0.0, 0.0, 3.0]


def test_json_answers(spark):
    rows = spark.createDataFrame([(0, '```json\n{"category":"x"}\n```'), (1, "not json"), (2, '{"tags":["a"],"summary":null,"consulting":3}'), (3, None)], "i int, answer string")
    got = {r.i: (r.category, r.tags, r.summary, r.consulting) for r in generation.json_fields(rows).collect()}
    assert got == {0: ("x", "[]", "", ""), 1: ("", "[]", "", "not json"), 2: ("", '["a"]', None, "3"), 3: ("", "[]", "", "")}
    with pytest.raises(Exception, match="no object"):
        generation.json_fields(spark.createDataFrame([("[1]",)], "answer string")).collect()
    assert generation.json_fields(spark.createDataFrame([("[1]",)], "answer string"), strict=False).first().tags == "[]"


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y"], {"v": "1"}), (2, "b", None, None)], "id int, category string, tags array<string>, extra map<string,string>")
    ids = lambda f, mode="strict": [r.id for r in rows.where(search.payload_filter(rows, f, mode)).orderBy("id").collect()]
    assert ids(None) == ids({}) == ids({"category": None}) == [1, 2]
    assert ids({"category": "a"}) == ids({"tags": "y"}) == ids({"v": "1"}) == ids({"tags": ["q", "x"]}, "extended") == [1]
    assert ids({"date_from": "2024"}) == []
    with pytest.raises(ValueError):
        ids({"tags": ["x"]})


def test_batch_search_is_exact_and_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8))
    vectors[5], vectors[7] = 0, vectors[6]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)], "point_id long, embedding array<double>").repartition(5)
    queries = points.where("point_id % 30 = 0").withColumnRenamed("point_id", "query_id")
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    got = {(r.query_id, r["rank"]): r.point_id for r in search.nearest_batch(points, queries, k=4).collect()}
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for q in range(0, 300, 30):
        order = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in range(300) if i != 5)[:4]
        assert [got[q, r] for r in (1, 2, 3, 4)] == [i for _, i in order]
    single = [r.point_id for r in search.nearest(points, vectors[30].tolist(), 4).collect()]
    assert single == [got[30, r] for r in (1, 2, 3, 4)]
    assert search.nearest_batch(points, queries.limit(0)).collect() == []


@pytest.mark.parametrize(("n_cells", "probes"), [(8, 6), (16, 12)])
def test_cells_recall(spark, n_cells, probes):
    points = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("point_id"), "embedding")
    celled, centres = search.cells(points, n_cells)
    found = 0
    celled = celled.cache()
    queries = points.where("point_id % 100 = 0").collect()
    for q in queries:
        exact = {r.point_id for r in search.nearest(points, q.embedding).collect()}
        found += len(exact & {r.point_id for r in search.nearest_in_cells(celled, centres, q.embedding, probes=probes).collect()})
    assert found >= 0.9 * 5 * len(queries)


def test_hash_vectors_agree(spark):
    rows = spark.createDataFrame([(1, "The the\tcat\n한국 é  "), (2, "")], "id int, text string")
    for r in rows.collect():
        sparse = {x.bucket: x.n for x in embedding.sparse_vectors(rows.where(F.col("id") == r.id), "id").collect()}
        dense = embedding.dense_vector(r.text)
        assert sparse == {int(i): int(dense[i]) for i in np.flatnonzero(dense)}


def test_prompts_and_contexts(spark):
    hits = spark.createDataFrame([(1, 2, "", "", "b"), (1, 1, "s", "3", "a")], "query_id int, rank int, source string, page string, text string")
    found = generation.contexts(hits)
    assert found.first().context == "[s] p.3\na\n\n---\n\n[문서 2]\nb"
    asked = spark.createDataFrame([(1, "q?", "\n필터 조건: k=v"), (2, "none", "")], "query_id int, question string, note string")
    calls = []

    def model(pairs):
        calls.extend(pairs)
        return [" "] * len(pairs)

    got = {r.query_id: r for r in generation.answered(generation.chat_prompts(asked, found), generation.first_sentence).collect()}
    assert got[1].answer == "a" and got[2].answer == text.NO_EVIDENCE and got[1].system.endswith("k=v") and got[1].user.endswith("\n\n질문: q?")
    assert {r.answer for r in generation.answered(generation.chat_prompts(asked, found), model).collect()} == {text.NO_EVIDENCE}


def test_client():
    import time

    tried = []

    def ask(system, user):
        tried.append(user)
        if user == "slow":
            time.sleep(1.5)
        if user == "bad" or user == "once" and tried.count("once") == 1:
            raise ValueError(user)
        return system + user

    client = generation.Client(ask, pool=4, seconds=0.4, attempts=2, failed="?")
    assert client([("s", "a"), ("s", "bad"), ("s", "once"), ("s", "slow")]) == ["sa", "?", "sonce", "?"]
    assert tried.count("bad") == 2 and tried.count("a") == 1


def test_hung_calls_fail_alone():
    """Two calls that hang fill the pool; the six behind them are answered."""
    import time

    client = generation.Client(lambda s, u: time.sleep(60) if u == "hang" else u, pool=2, seconds=0.3, attempts=2, failed="FAILED")
    start = time.time()
    assert client([("s", "hang")] * 2 + [("s", str(i)) for i in range(6)]) == ["FAILED"] * 2 + list("012345")
    assert time.time() - start < 3


def test_tool_answers_and_defaults(spark):
    def ask(system, user):
        if "bad" in user:
            raise ValueError('no "way"')
        if "slow" in user:
            import time

            time.sleep(30)
        return "  fine \n"

    rows = spark.createDataFrame([(1, "ok", 5), (2, "bad", 6), (3, "slow", 7), (4, None, 8)], "id int, text string, answer int")
    got = {r.row.id: r.answer for r in generation.analyzed_by_tool(rows, ask, seconds=0.5).collect()}
    assert got[1] == got[4] == "fine"
    assert got[2] == '{"category": "", "tags": [], "summary": "", "consulting": "분석 실패: no \\"way\\""}'
    assert got[3].startswith('{"category": ""') and "0.5 s" in got[3]


def test_bounded_lists(spark):
    rows = spark.createDataFrame([(c, i, f"d{i}", "processed") for c in (1, 2) for i in range(c * 4)], "collection_id int, id int, name string, status string")
    whole = {r.id: (r.lines.split("\n"), r.n) for r in generation.document_lists(rows).collect()}
    first = {r.id: (r.lines.split("\n"), r.n) for r in generation.document_lists(rows, 3).collect()}
    assert first == {c: (lines[:3], n) for c, (lines, n) in whole.items()} and whole[2][1] == 8


def test_messages(spark):
    rows = spark.createDataFrame([(1, 0, "system", "one"), (1, 1, "user", "hi"), (1, 2, "system", "two"), (1, 3, "assistant", "yo"), (2, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: (r.system, [tuple(m) for m in r.messages]) for r in generation.provider_messages(rows).collect()}
    assert got == {1: ("two", [("user", "hi"), ("assistant", "yo")]), 2: ("", [("user", "x")])}


CALL = "provider string, ts double, seq long, ok boolean, event string"


def test_breaker_cases(spark):
    fail = [("p", float(i), i, False, "call") for i in range(3)]
    rows = [*fail, ("p", 61.0, 4, True, "call"), ("p", 62.0, 5, True, "call")]
    got = [tuple(r)[2:5] for r in router.breaker_replay(spark.createDataFrame(rows, CALL)).orderBy("seq").collect()]
    assert got == [(True, "closed", 1), (True, "closed", 2), (True, "open", 3), (False, "open", 3), (True, "closed", 0)]
    rows = [*fail, ("p", 62.0, 4, False, "call"), ("p", 63.0, 5, False, "reset"), ("p", 64.0, 6, False, "call")]
    got = [tuple(r)[2:5] for r in router.breaker_replay(spark.createDataFrame(rows, CALL)).orderBy("seq").collect()]
    assert got[3:] == [(True, "open", 4), (False, "closed", 0), (True, "closed", 1)]
    known = spark.createDataFrame([("p", True), ("q", False)], "provider string, available boolean")
    status = {r.provider: (r.state, r.failure_count) for r in router.breaker_status(router.breaker_replay(spark.createDataFrame(fail, CALL)), known).collect()}
    assert status == {"p": ("open", 3), "q": ("closed", 0)}


def test_routes_equal_brute_force(spark):
    rng = random.Random(3)
    order = ["a", "b", "c"]
    rows = [(r, float(i * 7), i, {n: rng.random() < 0.4 for n in order if rng.random() < 0.9}) for i in range(200) for r in (0, 1)]
    want = {}
    for r in (0, 1):
        state = {n: [0, None] for n in order}  # failures in a row, opened at
        for _, ts, i, outcomes in sorted((x for x in rows if x[0] == r), key=lambda x: x[1:3]):
            tried, won = [], None
            for n in order:
                if n not in outcomes or state[n][1] is not None and ts - state[n][1] < 60:
                    continue
                tried.append(n)
                if outcomes[n]:
                    state[n], won = [0, None], n
                    break
                state[n][0] += 1
                if state[n][0] >= 3 or state[n][1] is not None:
                    state[n][1] = ts
            want[r, i] = (won, ",".join(tried))
    got = router.routed(spark.createDataFrame(rows, "router int, ts double, seq long, outcomes map<string,boolean>"), order).collect()
    assert {(r.router, r.seq): (r.provider, r.tried) for r in got} == want and any(w is None for w, _ in want.values())


def test_agents(spark):
    assert column(spark, ["single", "rag_crew", "research_crew", "x", None], agents.given_mode) == ["single_agent", "rag_crew_2agent", "research_crew_3agent", "rag_crew_2agent", "rag_crew_2agent"]
    runs = spark.createDataFrame([(1, "q", "c")], "run_id int, query string, collection string")
    got = agents.run_mode(runs, "rag_crew", lambda role, rows: rows.withColumn("output", F.concat(F.lit(role + "<"), "context", F.lit(">"))))
    assert [(r.task, r.output) for r in got.orderBy("task_no").collect()] == [("research", "researcher<>"), ("analysis", "analyst<researcher<>>")]


def test_catalog(spark):
    none = spark.createDataFrame([], "id long, latency_ms int, cost_usd double")
    assert tuple(catalog.stats(none, none, none, none).first()) == (0, 0, 0, 0, 0, 0.0)
    with pytest.raises(LookupError):
        catalog.require(catalog.by_id(none, 1))


def test_documents_are_not_dealt_by_language(spark):
    """A language with most texts would be one task's."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.docs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [lang" not in plan and "BroadcastHashJoin [lang" in plan


@pytest.mark.parametrize("name", ["ag8_tool_analysis", "ag8_tool_prompt", "g10_analysis", "g10_analyze_prompt"])
def test_analysis_shuffles_no_text(spark, tmp_path, name):
    """Labels too many to be broadcast meet what is made of a text. A document with two labels, with none, or twice there counts as in
    SQL, one without a language does not."""
    d = str(tmp_path)
    texts = [(1, "a b", "en", "s"), (1, "a b c", "fr", "s"), (2, "no language", None, "s"), (3, "é " * 5000, "fr", "t"), (4, "", "en", "t")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = QUERIES[name](spark, d)
        plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "formatted")
        got = sorted(map(tuple, made.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert "SortMergeJoin" in plan and len(shuffled) > 2
    assert not any(re.search(r"\b(text|row)#", x) for x in shuffled)
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        want = db.sql(ORACLE_SQL[name])
        assert want.columns == made.columns and len(got) == 6 and got == sorted(want.fetchall())


def test_rounded_as_in_sql(spark):
    """Halves, what is next to them, and no number; numpy's round goes to the even one, F.round by the digits that are shown."""
    x = np.array([y for k in range(2000) for h in [(2 * k + 1) / 2000] for y in (h, np.nextafter(h, 0), np.nextafter(h, 9))] + [k / 1024 for k in range(1025)] + [0.0, np.nan])
    x = np.concatenate([x, -x])
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(len(x), None)], "i int, x double").coalesce(1)
    for places in (3, 6, 9):
        with duckdb.connect() as db:
            want = [v[0] for v in db.execute("SELECT round(x, ?) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [places, x.tolist()]).fetchall()]
        np.testing.assert_array_equal(embedding.rounded_values(x, places), want)
        got = [r[0] for r in frame.orderBy("i").select(embedding.rounded(F.col("x"), places)).collect()]
        assert got.pop() is None
        np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("block", [512, 2])
@pytest.mark.parametrize("name", ["ag7_sources_footer", "p9_citations", "p10_previews", "g2_text_topk"])
def test_hits_are_those_of_sql(spark, tmp_path, monkeypatch, name, block):
    """Cosines that are a half in the fourth place but for the last bit; letters whose lower case is two or goes by their place; a document
    with two labels is found once and listed twice."""
    d, seen = str(tmp_path), set()
    w = [x for x in (f"w{i}" for i in range(400)) if embedding.bucket(x) not in seen and not seen.add(embedding.bucket(x))]
    texts = [" ".join([w[0]] * n + w[2 : 2 + 128 - n * n]) for n in (11, 9, 7)]  # 128 as the square of their length
    texts += ["ΟΔΟΣ ΟΔΟΣ İx a", "οδοσ ix b", "", None, "οδος i̇x"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts, 1)] + [(20, w[0], None, "s"), (None, w[0], "en", "s")]
    asked = [(1, f"{w[0]} {w[1]}"), (2, "ΟΔΟΣ İX"), (3, " \n"), (4, None), (5, w[0])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    made = QUERIES[name](spark, d)
    with duckdb.connect() as db:
        for t in ("documents", "labels", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        assert db.sql(f"WITH {views.HITS} SELECT count_if(round(round(score, 9), 3) <> round(score, 3)) FROM hits").fetchall()[0][0] >= 3
        want = db.sql(ORACLE_SQL[name])
        assert sorted(map(tuple, made.select(*want.columns).collect())) == sorted(want.fetchall())
