import random

import numpy as np
import pytest

from paperloom.llm import hard_negatives
from tests.llm.test_source_divergence import sql_rows

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, negatives=10):
    used = [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, y, v) in enumerate(used):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for n, (j, z, w) in enumerate(used) if n != k)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out)


def vectors(rng, n, dims=6, labels=3):
    return [(i, rng.randrange(labels), [rng.uniform(-1, 1) + (i % 4) for _ in range(dims)]) for i in range(n)]


def mined(spark, rows, **sizes):
    return sorted(tuple(r) for r in hard_negatives.mined(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes).collect())


def test_equals_brute_force(spark):
    rows = vectors(random.Random(1), 700)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50
    assert mined(spark, rows, positives=2, negatives=3, block_rows=20) == brute(rows, 2, 3)


def test_ties_repeated_ids_nulls_and_lengths(spark):
    rng = random.Random(2)
    rows = vectors(rng, 150)
    same = [(200 + k, k % 2, [1.0] * 6) for k in range(300)]  # one vector, two labels
    odd = [(300, 1, None), (400, None, [1.0] * 6), (None, 1, [1.0] * 6), (500, 1, [1.0, None]), (600, 1, [float("nan")]), (700, 1, [float("inf")]), (800, 1, [2.0, 1.0]), (900, 2, []), (1000, 77, [1.0] * 6)]
    rows = rows + same + odd + [rows[100], rows[100], rows[3]] + [(1100, 0, [2.0] * 6), (1100, 1, [2.0] * 6)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50
    assert mined(spark, [r for r in rows if r[0] is None or r[0] % 100]) == []
    assert hard_negatives.mined(spark.createDataFrame([], SCHEMA)).collect() == []


def test_columns_of_other_names_are_not_read(spark):
    rows = vectors(random.Random(3), 200)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", row int, part string")
    assert sorted(tuple(r) for r in hard_negatives.mined(frame).collect()) == brute(rows)


def test_scores_beyond_doubles():
    a, b = np.array([[float(1 << 40), 3.0]]), np.array([[float(1 << 20), 1.0], [1e30, 0.0], [-1e30, 0.0]])
    assert hard_negatives.products(a, b).tolist() == [[(1 << 60) + 3, (1 << 63) - 1, -(1 << 63)]]


def test_hilbert_curve_is_one_path():
    """Neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = hard_negatives.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_intervals_hold_and_leave_blocks_unread():
    rng = np.random.default_rng(4)
    clusters = [rng.normal(0, 1, (64, 8)).round() + 40 * c for c in range(8)]
    low, high = (np.array([f(c, axis=0) for c in clusters]) for f in (np.min, np.max))
    anchors = rng.normal(0, 20, (30, 8)).round()
    least, most = hard_negatives.intervals(anchors, low, high)
    for k, c in enumerate(clusters):
        scores = anchors @ c.T
        assert (scores.min(axis=1) >= least[:, k]).all() and (scores.max(axis=1) <= most[:, k]).all()
    for i in range(len(anchors)):  # a window of one row's score reads few blocks, its own among them
        s = anchors[i] @ clusters[3][0]
        meets = (least[i] <= s) & (most[i] >= s)
        assert meets[3] and meets.sum() < 8


def test_blocks_of_clusters_are_not_read(spark, monkeypatch):
    """Anchors of one cluster have windows that other clusters cannot reach: their blocks stay unread."""
    rng = random.Random(5)
    rows = [(i, (i // 8) % 2, [(rng.uniform(-0.05, 0.05) + (3.0 if d == i % 8 else 0.0)) for d in range(8)]) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    folders = []
    made = hard_negatives.new_folder
    monkeypatch.setattr(hard_negatives, "new_folder", lambda *a: folders.append(made(*a)) or folders[-1])
    got = sorted(tuple(r) for r in hard_negatives.mined(frame, block_rows=64).collect())
    assert got == brute(rows)
    b = hard_negatives.Blocks(f"{folders[0]}/blocks-000000")
    a = hard_negatives._arrays(f"{folders[0]}/anchors-000000")
    need = (a["label"][:, None] == b.label) & (hard_negatives.intervals(a["v"], b.low, b.high)[1] >= a["floor"][:, None])
    assert len(b.label) > 40 and need.mean() < 0.25


def test_query_equals_sql(spark):
    got, want = sql_rows(spark, "op11_hard_negatives")
    assert got == want and len(got) > 10


@pytest.mark.parametrize("size", [1, 5])
def test_fewer_rows_than_asked_for(spark, size):
    rows = [(100 * k, k % 2, [float(k), 1.0]) for k in range(size)]
    assert mined(spark, rows) == brute(rows)
