import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import fm_index as M
from paperloom.llm import registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(docs, bench, window=13):
    wins = {}
    for name, text in bench:
        w = WORD.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = {}
    for name, text in docs:
        w, hit, items = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    items |= wins[k]
        items = sorted(str(i) for i in items if i is not None)
        out[name] = (len(w), len(hit), items)
    return out


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(2)
    for _ in range(30):
        text = np.append(rng.integers(0, 4, rng.integers(1, 200)), 0)
        index = M.FMIndex(text, 3)
        for n in (1, 2, 3, 5):
            pattern = rng.integers(1, 4, n)
            low, high = index.ranges(pattern[None, :], np.array([n]))
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()]
            assert sorted(index.locate(np.arange(low[0], max(low[0], high[0])))) == want


@pytest.mark.parametrize("block", [M.BLOCK_CHARS, 40])
def test_against_brute_force(spark, block):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "cé", "d1", "éa", "x"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 5, 13, 14, 30])))) for i in range(12)] + [(3, "A b! cé"), (99, None), (None, "d1 d1 d1 d1 d1")]
    docs = [(i, ", ".join(word() for _ in range(rng.choice([0, 1, 10, 60])))) for i in range(80)] + [(500, None), (501, ""), (502, "zz " + (bench[4][1] or "q") + " yy")]
    got = M.contamination(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(bench, "item_id long, text string"), block_chars=block)
    want = brute(docs, bench)
    rows = got.withColumn("doc_id", F.col("row.doc_id")).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id]
        assert sum(len(WORD.findall(texts[r.doc_id][s.start : s.end].translate(LOW))) for s in r.spans) == r.n_hit


def test_spans_are_cut(spark):
    got = spark.createDataFrame([("héllo wörld again", [(1, 3), (6, 11)]), ("abc", [])], "text string, spans array<struct<start:long,end:long>>")
    assert [r[0] for r in got.select(M.without_spans()).collect()] == ["hlo  again", "abc"]


def test_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:] for r in M.contamination(docs, none).collect()] == [(2, 0, [], [])]
    assert M.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_query_equals_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    got = registry.op7_fm_index(spark, d).toPandas().sort_values("doc_id", ignore_index=True)
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
        want = c.sql(registry.ORACLE_SQL["op7_fm_index"]).df().sort_values("doc_id", ignore_index=True)
    assert got.to_dict("list") == want[got.columns].to_dict("list") and got.contaminated.any()
