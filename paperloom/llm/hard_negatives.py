"""Hard negatives of anchors: rows of other labels that score within a window below each of an anchor's positives.

Vectors are taken in whole numbers and lie in Parquet files as blocks (row groups) of one label, in the order of a Hilbert curve through
the dimensions that vary most; each component is a column, so that the footer's statistics are a zone map: the least and the greatest
value of each dimension. From an anchor and a zone map interval arithmetic gives the least and the greatest inner product that a block
can hold. An anchor first reads the blocks of its own label that can beat what its own block has; that gives its positives and,
from their scores, its windows; then it reads the blocks of other labels whose interval meets a window. Blocks that cannot are never
read, and nothing is approximate.

Anchors, a stated part of all rows, are files of a few hundred. A task has a tile: a file of anchors and a file of blocks. It keeps
what is best for each anchor, or each window, and only that leaves it.

Rows with a null label, vector, id or component, or a component that is not finite, take no part. A shorter vector counts as padded
with zeros. Equal ids are rows of their own; of equal scores that of the smaller id comes first. A group of equal vectors, however large,
is many blocks. Scores are exact, whatever their size; those that a long cannot hold become the nearest that it can. Tables without
anchors, positives or negatives give no rows; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._shared import bounded_batches, file_system, kept, new_folder, write_whole

SCALE, ANCHOR_EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
WINDOW = (30, 90)
#: Rows of a block, rows of a file, anchors of a file; anchors that are compared at once.
BLOCK_ROWS, FILE_ROWS, ANCHORS, SLICE = 1024, 1 << 12, 256, 64
#: Files of a tile, at least; tiles that a file of anchors has at most, so that what tasks hand on of an anchor is bounded.
TILE_FILES, MOST_TILES = 8, 64
#: Files of blocks, and tasks of a search, at most; files of more rows are written then.
MOST_FILES, MOST_TASKS = 50_000, 20_000
#: The curve's dimensions, and bits for each.
CURVE, BITS = 16, 4
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
ROWS = "vec_id long, label long, v array<double>"


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, components as whole numbers, of rows without nulls; those with components that are not finite are left out."""
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.flatten()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        x = np.floor(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * SCALE)
        bad = np.zeros(len(sizes), bool)
        bad[owner[~np.isfinite(x)]] = True
        keep = ~bad
        offsets = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[keep[owner]]))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), out], names=["vec_id", "label", "v"])


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((0, 3))
    for rows in batches:
        for part in (rows.iloc[at : at + 4096] for at in range(0, len(rows), 4096)):
            v = _matrix(part["v"])
            own = np.stack([np.full(v.shape[1], float(len(v))), v.sum(axis=0), (v * v).sum(axis=0)], axis=1)
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros((len(own) - len(total), 3))])
            total[: len(own)] += own
    yield pd.DataFrame({"dim": np.arange(len(total)), "n": total[:, 0], "s": total[:, 1], "q": total[:, 2]})


def _matrix(vectors, width: int = 0) -> np.ndarray:
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (whole numbers of so many bits in each of d dimensions, d * bits up to 64): the axes are turned
    and swapped from the highest bit down, as each quadrant's own curve is, then Gray codes are undone and bits interleaved."""
    x = points.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for k in range(bits - 1, 0, -1):
        bit = one << np.uint64(k)
        below = bit - one
        for d in range(len(x)):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for k in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(k)) & one, (one << np.uint64(k)) - one, np.uint64(0))
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for k in range(bits - 1, -1, -1):
        for d in range(len(x)):
            out = out << one | (x[d] >> np.uint64(k)) & one
    return out


def _keyed(batches: Iterator[pd.DataFrame], dims: list[int], low: list[float], step: list[float]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if not len(rows):
            continue
        v = _matrix(rows["v"], max(dims, default=0) + 1)[:, dims]
        cell = np.clip(np.floor((v - low) / step), 0, (1 << BITS) - 1) if dims else np.zeros((len(v), 1))
        key = hilbert(cell, BITS) ^ np.uint64(1 << 63)
        yield pd.DataFrame({"vec_id": rows["vec_id"], "label": rows["label"], "v": rows["v"], "key": key.view(np.int64)})


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exactly."""
    if np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -LONG - 1, LONG).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, of equal ones those of smaller ids, in order."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product of each anchor with any point of each block. Sums that doubles don't hold exactly bound nothing."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    if np.abs(anchors).sum(axis=1).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) >= EXACT:
        return np.full((len(anchors), len(low)), -np.inf), np.full((len(anchors), len(low)), np.inf)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _stored(columns: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **columns)
    return out.getvalue()


def _write(batches: Iterator[pd.DataFrame], folder: str, width: int, positives: int, block_rows: int) -> Iterator[pd.DataFrame]:
    """A partition, in order, as a file of blocks; gives its anchors, each with the score that its own block promises."""
    context, own, label = TaskContext.get(), [], None
    sink, writer = pa.BufferOutputStream(), None
    names = [f"c{d}" for d in range(width)]
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), *((n, pa.float64()) for n in names)])
    part = context.partitionId()

    def block() -> pd.DataFrame:
        nonlocal writer
        v = _matrix([r.v for r in own], width)
        rows, ids = (np.array([getattr(r, c) for r in own], np.int64) for c in ("row", "vec_id"))
        writer = writer or pq.ParquetWriter(sink, schema, compression="zstd")
        writer.write_table(pa.table([rows, ids, np.full(len(own), label), *v.T], schema=schema), row_group_size=block_rows)
        at = np.flatnonzero(ids % ANCHOR_EVERY == 0)
        floor = np.full(len(at), -LONG - 1)
        if len(own) > positives:
            for low in range(0, len(at), SLICE):
                found = products(v[at[low : low + SLICE]], v)
                found[np.arange(len(found)), at[low : low + SLICE]] = -LONG - 1
                floor[low : low + SLICE] = np.partition(found, len(own) - positives, axis=1)[:, len(own) - positives]
        return pd.DataFrame({"part": part, "row": rows[at], "vec_id": ids[at], "label": label, "v": pd.Series([v[i] for i in at], dtype=object), "floor": floor})

    for rows in batches:
        for r in rows.itertuples(index=False):
            if own and (r.label != label or len(own) == block_rows):
                if len(anchors := block()):
                    yield anchors
                own = []
            label = r.label
            own.append(r)
    if own:
        if len(anchors := block()):
            yield anchors
        writer.close()
        write_whole(f"{folder}/blocks-{part:06d}", [sink.getvalue()], context.taskAttemptId())
        yield pd.DataFrame({"part": [part], "row": pd.array([None], "Int64"), "vec_id": pd.array([None], "Int64"), "label": pd.array([None], "Int64"), "v": [None], "floor": pd.array([None], "Int64")})


def _to_files(batches: Iterator[pd.DataFrame], folder: str, kind: str) -> Iterator[pd.DataFrame]:
    """Sorted rows of (file, ...) as a file for each number."""
    waiting: list[pd.DataFrame] = []

    def put() -> int:
        rows = pd.concat(waiting)
        columns = {c: np.stack(rows[c]) if c == "v" else rows[c].to_numpy() for c in rows.columns if c != "file"}
        write_whole(f"{folder}/{kind}-{(number := int(rows['file'].iloc[0])):06d}", [_stored(columns)], TaskContext.get().taskAttemptId())
        return number

    for batch in batches:
        for number, rows in batch.groupby("file", sort=True):
            if waiting and waiting[0]["file"].iloc[0] != number:
                yield pd.DataFrame({"file": [put()]})
                waiting = []
            waiting.append(rows)
    if waiting:
        yield pd.DataFrame({"file": [put()]})


@lru_cache(maxsize=2)
def _arrays(path: str) -> dict[str, np.ndarray]:
    store, name = file_system(path)
    with store.open_input_file(name) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as x:
        return {k: x[k] for k in x.files}


class Blocks:
    """A file of blocks: zone maps from its footer, and blocks as they are asked for."""

    def __init__(self, path: str):
        store, name = file_system(path)
        self.file = pq.ParquetFile(store.open_input_file(name))
        groups = [self.file.metadata.row_group(g) for g in range(self.file.metadata.num_row_groups)]
        zones = [[g.column(c).statistics for c in range(2, g.num_columns)] for g in groups]
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.label = np.array([z[0].min for z in zones], np.int64)
        self.low, self.high = (np.array([[getattr(s, k) for s in z[1:]] for z in zones], float) for k in ("min", "max"))

    def read(self, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if g not in self.held:
            table = self.file.read_row_group(g)
            self.held[g] = table.column(0).to_numpy(), table.column(1).to_numpy(), np.stack([table.column(c).to_numpy() for c in range(3, table.num_columns)], axis=1)
        return self.held[g]


def _compared(a: dict[str, np.ndarray], b: Blocks, need: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor that needs a block (anchors by blocks): its number, and scores, ids, labels and rows of what was read for it and its neighbours."""
    wanted = np.flatnonzero(need.any(axis=1))
    for low in range(0, len(wanted), SLICE):
        some = wanted[low : low + SLICE]
        groups = np.flatnonzero(need[some].any(axis=0))
        rows, ids, v = (np.concatenate(x) for x in zip(*(b.read(g) for g in groups), strict=True))
        labels = np.repeat(b.label[groups], [len(b.read(g)[0]) for g in groups])
        for i, scores in zip(some, products(a["v"][some], v), strict=True):
            yield i, scores, ids, labels, rows


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[int]]]:
    """Sorted rows (file, tile, part): each file of anchors with the files of blocks of a tile."""
    at, parts = None, []
    for batch in batches:
        for number, tile, part in zip(batch["file"], batch["tile"], batch["part"], strict=True):
            if parts and at != (number, tile):
                yield at[0], parts
                parts = []
            at = number, tile
            parts.append(part)
    if parts:
        yield at[0], parts


class Best:
    """The k best of each of n, merged as they come."""

    def __init__(self, n: int, k: int):
        self.k, none = k, np.zeros(0, np.int64)
        self.held = [(none, none)] * n

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        at = best(scores, ids, self.k)
        scores, ids = np.concatenate([self.held[i][0], scores[at]]), np.concatenate([self.held[i][1], ids[at]])
        at = best(scores, ids, self.k)
        self.held[i] = scores[at], ids[at]

    def frame(self, columns: dict[str, np.ndarray]) -> pd.DataFrame:
        n = [len(s) for s, _ in self.held]
        scores, ids = (np.concatenate([x[c] for x in self.held]) for c in (0, 1))
        return pd.DataFrame({c: np.repeat(x, n) for c, x in columns.items()} | {"score": scores, "id": ids})


def _positives(batches: Iterator[pd.DataFrame], folder: str, k: int) -> Iterator[pd.DataFrame]:
    for number, parts in _tiles(batches):
        a = _arrays(f"{folder}/anchors-{number:06d}")
        found = Best(len(a["row"]), k)
        for part in parts:
            b = Blocks(f"{folder}/blocks-{part:06d}")
            need = (a["label"][:, None] == b.label) & (intervals(a["v"], b.low, b.high)[1] >= a["floor"][:, None])
            for i, scores, ids, labels, rows in _compared(a, b, need):
                own = np.flatnonzero((labels == a["label"][i]) & (rows != a["row"][i]))
                found.add(i, scores[own], ids[own])
        yield found.frame({"file": np.full(len(a["row"]), number), "row": a["row"], "anchor_id": a["vec_id"]})


def _negatives(batches: Iterator[pd.DataFrame], folder: str, k: int) -> Iterator[pd.DataFrame]:
    for number, parts in _tiles(batches):
        a, w = _arrays(f"{folder}/anchors-{number:06d}"), _arrays(f"{folder}/windows-{number:06d}")
        order = np.argsort(a["row"])
        of = order[np.searchsorted(a["row"], w["row"], sorter=order)]  # the anchor of each window
        first, end = (np.searchsorted(w["row"], a["row"], side) for side in ("left", "right"))
        found = Best(len(of), k)
        for part in parts:
            b = Blocks(f"{folder}/blocks-{part:06d}")
            low, high = intervals(a["v"], b.low, b.high)
            meets = (low[of] <= w["most"][:, None]) & (high[of] >= w["least"][:, None]) & (a["label"][of][:, None] != b.label)
            need = np.zeros(low.shape, bool)
            np.logical_or.at(need, of, meets)
            for i, scores, ids, labels, _ in _compared(a, b, need):
                other = labels != a["label"][i]
                for x in range(first[i], end[i]):
                    own = np.flatnonzero(other & (scores >= w["least"][x]) & (scores <= w["most"][x]))
                    if len(own):
                        found.add(x, scores[own], ids[own])
        yield found.frame({c: w[c] for c in ("row", "anchor_id", "positive_id", "nth", "positive_score")})


def limits(score: Column) -> list[Column]:
    """The least and the greatest whole number within WINDOW of a score."""
    wide = lambda n: F.lit(n).cast("decimal(3,0)") * score.cast("decimal(20,0)")
    return [F.ceil(wide(WINDOW[0]) / 100).cast("decimal(20,0)").alias("least"), F.floor(wide(WINDOW[1]) / 100).cast("decimal(20,0)").alias("most")]


def mined(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows: vec_id, label, embedding. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "blocks")
    used = bounded_batches(rows).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v")).dropna()
    whole = kept(used.mapInArrow(quantised, ROWS), "whole")
    dims = whole.mapInPandas(_moments, "dim int, n double, s double, q double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in "nsq")).orderBy("dim").collect()  # a row a dimension
    n_rows = whole.count()
    mean = np.array([r.s / r.n for r in dims])
    spread = np.sqrt(np.maximum([r.q / r.n for r in dims] - mean**2, 0)) if dims else np.zeros(0)
    widest = sorted(np.argsort(-spread, kind="stable")[:CURVE].tolist())
    step = np.maximum(spread[widest] * 4 / (1 << BITS), 1e-9)
    keyed = whole.mapInPandas(partial(_keyed, dims=widest, low=(mean[widest] - 2 * spread[widest]).tolist(), step=step.tolist()), ROWS + ", key long")
    keyed = kept(keyed.withColumn("row", F.monotonically_increasing_id()), "keyed")

    ordered = keyed.repartitionByRange(max(1, min(MOST_FILES, -(-n_rows // FILE_ROWS))), "label", "key", "vec_id", "row").sortWithinPartitions("label", "key", "vec_id", "row")
    made = kept(ordered.mapInPandas(partial(_write, folder=folder, width=len(dims), positives=positives, block_rows=block_rows), "part int, row long, vec_id long, label long, v array<double>, floor long"), "anchors")
    parts, anchors = made.where("row IS NULL").select("part"), made.where("row IS NOT NULL")
    sizes = made.agg(F.count("row").alias("n"), (F.max("part") + 1).alias("parts")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes.n:
        return spark.createDataFrame([], result)
    filed = anchors.withColumn("file", F.pmod(F.xxhash64("row"), F.lit(-(-sizes.n // ANCHORS))).cast("int"))
    files = kept(filed.select("file", "row", "vec_id", "label", "v", "floor").repartition("file").sortWithinPartitions("file", "row").mapInPandas(partial(_to_files, folder=folder, kind="anchors"), "file int"), "files")

    def tiles(of: DataFrame) -> DataFrame:
        """Each file of anchors with each file of blocks: the numbers of the files, no rows."""
        per_tile = max(TILE_FILES, -(-sizes.parts // MOST_TILES))
        n = of.count() * -(-sizes.parts // per_tile)
        each = of.select("file", F.explode(F.sequence(F.lit(0), F.lit(sizes.parts - 1))).alias("part")).join(parts, "part").withColumn("tile", F.floor(F.col("part") / per_tile).cast("int"))
        return each.select("file", "tile", "part").repartition(min(max(n, 1), MOST_TASKS), "file", "tile").sortWithinPartitions("file", "tile", "part")

    near = tiles(files).mapInPandas(partial(_positives, folder=folder, k=positives), "file int, row long, anchor_id long, score long, id long")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    first = near.withColumn("nth", nth).where(F.col("nth") <= positives)
    least, most = limits(F.col("score"))
    windows = kept(first.select("file", "row", "anchor_id", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), least, most), "windows")
    windows = windows.where("least <= most").select("file", "row", "anchor_id", "nth", "positive_id", "positive_score", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"))
    asked = kept(windows.repartition("file").sortWithinPartitions("file", "row", "nth").mapInPandas(partial(_to_files, folder=folder, kind="windows"), "file int"), "asked")
    far = tiles(asked).mapInPandas(partial(_negatives, folder=folder, k=negatives), "row long, anchor_id long, positive_id long, nth int, positive_score long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("row", "nth").orderBy(F.desc("score"), "id"))
    ranked = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
