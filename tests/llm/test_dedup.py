import random
import re
from collections import defaultdict

import pytest

from paperloom.llm import line_dedup, registry, substring_dedup

#: Two words of which a polynomial modulo 2^64 has the same value, whatever its base.
TWINS = ["".join("ab"[i.bit_count() % 2 ^ k] for i in range(1024)) for k in (0, 1)]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hash_twins():
    """Two texts of one line each that Spark's xxhash64 does not tell apart, whatever follows: the second stripe makes up for the first."""
    odd, factor, most = 14029467366897019727, 11400714785074694791, (1 << 64) - 1
    begin, rng = (42 + factor + odd) & most, random.Random(11)
    mixed = lambda v, x: (((v + x * odd & most) << 31 | (v + x * odd & most) >> 33) & most) * factor & most
    lane = lambda: bytes(rng.randrange(97, 123) for _ in range(8))
    number = lambda x: int.from_bytes(x, "little")
    while True:
        a, b, c = lane(), lane(), lane()
        d = (number(c) + (mixed(begin, number(a)) - mixed(begin, number(b))) * pow(odd, -1, 1 << 64) & most).to_bytes(8, "little")
        if all(0x21 <= x < 0x7F for x in d):
            return tuple((x + b"-" * 24 + y + b"-" * 24).decode() for x, y in ((a, c), (b, d)))


def brute_lines(rows):
    """Numbers of the lines that go, for each row."""
    seen, gone = defaultdict(list), defaultdict(set)
    for k, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        for i in range(len(lines) - 2):
            if re.search(r"[^\x20\x09-\x0D]", "".join(lines[i : i + 3])):
                seen[tuple(lines[i : i + 3])].append((d if d is not None else 10**9, k, i))
    for places in seen.values():
        for _, k, i in sorted(places)[1:]:
            gone[k].update(range(i, i + 3))
    return [sorted(gone[k]) for k in range(len(rows))]


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "bé", "c c", "", " "]) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "x\n" * 50), (None, rows[5][1]), (None, "p\nq\nr"), (73, "p\nq\nr"), (74, "p\nq\nr\ns"), (74, "p\nq\nr\ns"), (75, f"{TWINS[0]}\n1\n2"), (76, f"{TWINS[1]}\n1\n2")]
    rows += [(7, "u\nv\nw\nx")] * 3 + [(None, "k\nl\nm")] * 3 + [(None, f"{x}\n3\n4\n5") for x in hash_twins()] + [(90, "own\n3\n4\n5")]
    docs = spark.createDataFrame([(*r, k, 1) for k, r in enumerate(rows)], "doc_id long, text string, n int, removed int")
    got, want = line_dedup.deduplicated(docs).collect(), brute_lines(rows)
    assert sorted(r.row.n for r in got) == list(range(len(rows)))
    for r in got:
        gone = want[r.row.n]
        assert r.removed == gone, (r, gone)
        assert r.kept_text == (r.row.text if not gone else "\n".join(x for i, x in enumerate(r.row.text.split("\n")) if i not in gone))
    assert line_dedup.deduplicated(docs.limit(0)).collect() == []


def test_texts_of_one_hash_keep_what_is_theirs(spark):
    a, b = hash_twins()
    for d in (None, 7):
        docs = spark.createDataFrame([(d, f"{a}\n3\n4\n5"), (d, f"{b}\n3\n4\n5")], "doc_id long, text string")
        assert docs.selectExpr("xxhash64(text) AS h").distinct().count() == 1
        assert sorted(r.kept_text for r in line_dedup.deduplicated(docs).collect()) == sorted([f"{a}\n3\n4\n5", b])
        kept = sorted(r.kept_text for r in substring_dedup.deduplicated(docs).collect())
        assert any(a in x for x in kept) and any(b in x for x in kept) and sum("5" in x.split("\n") for x in kept) == 1


def test_one_of_equal_rows_stays(spark):
    """Copies of one doc_id, or of none: one keeps its text, the others lose all of it."""
    text = "p q\nr s\nt u\nv w"
    for d in (None, 7):
        docs = spark.createDataFrame([(d, text)] * 5, "doc_id long, text string").repartition(3)
        assert sorted(r.kept_text for r in line_dedup.deduplicated(docs).collect()) == [""] * 4 + [text]
        assert sorted(r.n_removed_words for r in substring_dedup.deduplicated(docs).collect()) == [0] + [8] * 4


def brute_units(rows, unit, least):
    """Spans that are removed, for each row."""
    own = []
    for _, t in rows:
        units = []
        for m in WORD.finditer("".join(c.lower() if c.isascii() else c for c in t or "")):
            gap = (t or "")[units[-1][2] : m.start()] if units else "\n\n"
            if gap.count("\n") >= (2 if unit == "paragraph" else 1) or unit == "sentence" and re.search(r"[.!?][ \t\x0B\f\r]", gap):
                units.append([[], m.start(), m.end()])
            units[-1][0].append(m.group())
            units[-1][2] = m.end()
        own.append(units)
    rank = [(d if d is not None else 10**9, k) for k, (d, _) in enumerate(rows)]
    low = {}
    for k, units in enumerate(own):
        for w, _, _ in units:
            low[tuple(w)] = min(low.get(tuple(w), rank[k]), rank[k])
    out = []
    for k, units in enumerate(own):
        seen, runs, last = set(), [], False
        for w, a, b in units:
            again = tuple(w) in seen or rank[k] > low[tuple(w)]
            seen.add(tuple(w))
            if again and last:
                runs[-1][1], runs[-1][2] = b, runs[-1][2] + len(w)
            elif again:
                runs.append([a, b, len(w)])
            last = again
        out.append([(a, b) for a, b, n in runs if n >= least])
    return out


@pytest.mark.parametrize(("unit", "least"), [("line", 1), ("paragraph", 1), ("sentence", 1), ("sentence", 4)])
def test_units_equal_brute_force(spark, unit, least):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["A", "b,", "çç", "d.", "?! e", "f.) g"]) for _ in range(rng.choice([0, 1, 2, 5])))
    rows = [(i, rng.choice(["\n", "\n\n", ".\t"]).join(line() for _ in range(rng.randrange(0, 9)))) for i in range(80)] + [(90, None), (91, ""), (92, "A b\n\na, B!"), (93, TWINS[0]), (94, TWINS[1]), (95, TWINS[1])]
    rows += [(7, "A b,\ng d.\nown")] * 3 + [(None, "çç g\nk l")] * 3
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, n int, later string")
    got, want = substring_dedup.deduplicated(docs, unit, least_words=least).collect(), brute_units(rows, unit, least)
    assert sorted(r.row.n for r in got) == list(range(len(rows))) and any(want)
    for r in got:
        assert [(s.start, s.end) for s in r.removed] == want[r.row.n]
        edges = [0, *(x for s in r.removed for x in (s.start, s.end)), len(r.row.text or "")]
        assert (r.kept_text or "") == "".join((r.row.text or "")[a:b] for a, b in zip(edges[::2], edges[1::2]))
    assert substring_dedup.deduplicated(docs.limit(0), unit).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.deduplicated(docs, "word")


def test_passages_of_sentences(spark):
    """The query's setting: passages of over 50 words inside lines go, common sentences and lines stay."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n))
    sentences = lambda n: " ".join(text(rng.randint(4, 14)).capitalize() + "." for _ in range(n))
    passages = [f"{sentences(7)} {text(20)}." for _ in range(60)]
    rows = [(i, f"{sentences(4)} {passages[i % 60]} {sentences(3)}\nAll rights reserved.") for i in range(180)] + [(1000 + i, f"{sentences(9)}\nAll rights reserved.") for i in range(50)]
    got = {r.row.doc_id: r for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), "sentence", least_words=registry.PASSAGE_WORDS).collect()}
    assert all(not got[i].removed for i in range(60)) and all(not got[1000 + i].removed for i in range(50))
    for i in range(60, 180):
        assert got[i].n_removed_words == len(passages[i % 60].split()) and passages[i % 60][:-1] not in got[i].kept_text


def test_rows_without_or_of_one_doc_id(spark):
    a, b = "p q\nr s\nt u", "v w\np q\nr s\nt u"
    for d in (None, 5):
        docs = spark.createDataFrame([(d, a), (d, b), (d, None)], "doc_id long, text string")
        lines = sum(r.n_lines - len(r.removed) for r in line_dedup.deduplicated(docs).collect())
        words = sum(r.n_words - r.n_removed_words for r in substring_dedup.deduplicated(docs).collect())
        assert lines == 4 and words == 8


def test_long_texts(spark):
    """Above one block of 1 MiB."""
    long = "\n".join(f"line {i} of a long text" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + "\nlast"), (3, "line 7 of a long text\nline 8 of a long text\nline 9 of a long text")], "doc_id long, text string")
    got = {r.row.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert [len(got[i].removed) for i in (1, 2, 3)] == [0, 60_000, 3] and got[2].kept_text == "last"
    got = {r.row.doc_id: r for r in substring_dedup.deduplicated(docs).collect()}
    assert [got[i].n_words - got[i].n_removed_words for i in (1, 2, 3)] == [360_000, 1, 0]


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_substring_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    got = registry.QUERIES[name](spark, d).toPandas().sort_values("doc_id", ignore_index=True)
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{d}/documents.parquet'")
        want = c.sql(registry.ORACLE_SQL[name]).df().sort_values("doc_id", ignore_index=True)
    assert got.to_dict("list") == want[got.columns].to_dict("list") and (got.get("n_removed", got.get("n_removed_words")) > 0).any()
