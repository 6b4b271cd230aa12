import random
import zlib
from collections import defaultdict

import pytest

from paperloom.llm import minimax_shards
from tests.llm.test_source_divergence import sql_rows

SCHEMA = "doc_id long, text string"
D = "/root/testdata/sf0.001"


def size(text):
    return len((text or "").encode()) + 1


def groups_in_order(rows, shards):
    """Sizes of groups in their order, those with shards of their own first, and how many these are."""
    own = {}
    for d, t in rows:
        g = own.setdefault(t or "", [1 << 63, 0])
        g[0], g[1] = min(g[0], (1 << 62) if d is None else d), g[1] + size(t)
    by_size, total, n = sorted((g[1] for g in own.values()), reverse=True), sum(g[1] for g in own.values()), 0
    while n < min(len(by_size), shards - 1) and by_size[n] * (shards - n) > total:
        total -= by_size[n]
        n += 1
    rest = sorted(own.values(), key=lambda g: g[0])
    for big in by_size[:n]:
        rest.remove(next(g for g in rest if g[1] == big))
    return by_size[:n], [g[1] for g in rest]


def best_capacity(sizes, shards):
    """The smallest greatest shard of contiguous runs, by dynamic programming."""
    until = [0]
    for s in sizes:
        until.append(until[-1] + s)
    worst = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        worst = [min(max(worst[i], until[j] - until[i]) for i in range(j + 1)) for j in range(len(sizes) + 1)]
    return worst[-1]


def checked(rows, got, shards):
    """Rows whole, groups whole, slots gapless, and no shard over the smallest capacity. Sizes of shards."""
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == sorted((d if d is not None else -1, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots, total = defaultdict(list), [0] * shards
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    giants, rest = groups_in_order(rows, shards)
    assert total[: len(giants)] == giants
    assert max(total[len(giants) :]) == best_capacity(rest, shards - len(giants))
    return total


def sharded(spark, rows, shards, part_rows=20):
    return minimax_shards.sharded(spark.createDataFrame(rows, SCHEMA).repartition(3), shards, part_rows).collect()


def whole_groups(rows, got):
    where = defaultdict(set)
    text = {d: t or "" for d, t in rows}
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    return all(len(x) == 1 for x in where.values())


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_smallest_capacity(spark, monkeypatch, shards):
    monkeypatch.setattr(minimax_shards, "PAGE", 4)
    rng = random.Random(shards)
    texts = ["é" * rng.randrange(0, 40) + str(rng.randrange(60)) for _ in range(150)]
    rows = [(i, rng.choice(texts) if i % 3 else f"{i}" * rng.randrange(1, 8)) for i in range(260)]
    got = sharded(spark, rows, shards)
    total = checked(rows, got, shards)
    assert whole_groups(rows, got)
    assert shards == 16 or max(total) - min(total) < 400


def test_groups_larger_than_a_share(spark):
    rows = [(i, "x" * 50) for i in range(100)] + [(200 + i, "y" * 300) for i in range(20)] + [(300 + i, f"{i:03d}" * (1 + i % 4)) for i in range(200)]
    got = sharded(spark, rows, 8)
    total = checked(rows, got, 8)
    assert whole_groups(rows, got)
    assert total[:2] == [6020, 5100] and max(total[2:]) - min(total[2:]) < 30
    assert {r.shard for r in got if r.doc_id < 100} == {1} and {r.shard for r in got if 200 <= r.doc_id < 220} == {0}


def test_nulls_repeated_rows_few_groups_and_none(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a"), (None, "a"), (7, "long " * 300_000)]
    got = sharded(spark, rows, 4)
    checked(rows, got, 4)
    assert len({r.shard for r in got if r.size == 1}) == 1 and len({r.shard for r in got if r.size == 2}) == 1
    assert sharded(spark, [], 4) == []
    with pytest.raises(ValueError, match="shards"):
        sharded(spark, rows, 0)


def test_columns_of_other_names(spark):
    rows = [(i, "t" * (i % 5), i, "x") for i in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA + ", row int, part string")
    checked([r[:2] for r in rows], minimax_shards.sharded(frame, 3, 10).collect(), 3)


def test_query_equals_sql(spark):
    got, want = sql_rows(spark, "op12_minimax_shards")
    assert got == want and len(got) == 200


def test_query(spark):
    from paperloom.llm import registry

    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op12_minimax_shards(spark, D).collect()
    assert got[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    checked(rows, got, 16)
    assert whole_groups(rows, got) and {r.law for r in got} == {"bytes"}
