import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from paperloom.llm import registry, source_divergence

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def sql_rows(spark, name):
    """Rows of a query and of its SQL, by column name."""
    with duckdb.connect() as c:
        for t in ("documents", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        want = c.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, D).toPandas()
    plain = lambda f: sorted(tuple(None if pd.isna(x) else x for x in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    return plain(got), plain(want)


def brute(rows, least=10, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in TERM.findall(text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang, _ in groups}
    share = lambda n, whole: 1 + 10**9 * (n + 2) // whole
    f = lambda p, q: (p - q) ** 2 // (p + q)
    p, q = {}, {}
    for lang, terms in kept.items():
        of = [g for g in groups if g[0] == lang]
        for g in of:
            whole = sum(count[g][t] for t in terms) + 2 * len(terms)
            p[g] = [share(count[g][t], whole) for t in terms]
        every = [sum(count[g][t] for g in of) for t in terms]
        q[lang] = [share(n, sum(every) + 2 * len(terms)) for n in every]
    out = []
    for g in groups:
        pairs = [(-sum(map(f, p[g], p[h])), h[1]) for h in groups if h[0] == g[0] and h != g]
        terms = [(-f(a, b), t) for t, a, b in zip(kept[g[0]], p[g], q[g[0]], strict=True) if count[g][t] and a > b]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(*g, part, item, -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, **sizes):
    return sorted(tuple(r) for r in source_divergence.audited(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes).select("lang", "source", "part", "item", "value", "rank").collect())


WORDS = ["a", "The", "the", "été", "ü", "x1y", "日本", "A", "z" * 300, "𐀀", "￮"]


def documents(rng, n):
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "ß"])) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"sources": 2, "terms": 3}, {"sources": 1, "terms": 1}])
def test_equals_brute_force(spark, sizes):
    rows = documents(random.Random(1), 200)
    got = found(spark, rows, **sizes)
    assert got == brute(rows) and len(got) > 60


def test_edges(spark):
    rng = random.Random(2)
    rows = documents(rng, 60)
    rows += [rows[0]] * 12  # repeated rows are documents
    rows += [(100, None, "en", "empty"), (101, "", "en", "none"), (102, "only rare words here", "xx", "a"), (103, None, "xx", "b"), (104, None, "yy", "alone"), (None, "the " * 300_000, "en", "long")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert [r for r in got if r[0] == "xx"] == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]
    assert not [r for r in got if r[0] == "yy"]
    assert found(spark, rows[:0]) == []


def test_columns_of_other_names_are_not_read(spark):
    rows = documents(random.Random(3), 80)
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", n long, value int, term string")
    assert sorted(tuple(r) for r in source_divergence.audited(frame).select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows)


def test_tasks_that_hand_on_early(monkeypatch):
    """What a task counts is the same, however often it hands its counts on."""
    import pyarrow as pa

    rows = documents(random.Random(4), 120)
    batch = pa.table({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [r[1] for r in rows]})
    counted = []
    for most in (1 << 20, 5):
        monkeypatch.setattr(source_divergence, "ENTRIES", most)
        total = defaultdict(lambda: [0, 0])
        for b in source_divergence._counted(iter(batch.to_batches(10))):
            for x in b.to_pylist():
                own = total[x["lang"], x["source"], x["term"]]
                own[0] += x["n"]
                own[1] += x["docs"]
        counted.append(dict(total))
    assert counted[0] == counted[1]


def test_query_equals_sql(spark):
    got, want = sql_rows(spark, "op13_source_divergence")
    assert got == want and len(got) > 100
