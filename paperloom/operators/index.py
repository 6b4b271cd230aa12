"""An index of points for batches of filtered queries: inverted lists by cell, product-quantised residuals, exact re-ranking.

A point lies in the cell of the nearest of some centres; what is left of its unit vector is cut into parts of two dimensions, and each
part is one byte, the number of the nearest of up to 256 code vectors. The list of a cell is row groups of Parquet files: keys, codes,
how far the code is from the point at most, filter columns, and the vector, which is a column of its own.

A search reads codes first. From a query's inner products with the centre and the code vectors, and a point's distance from its code,
it knows between what limits the cosine lies. The k-th greatest lower limit, over all points that pass the query's filter, bounds the
answer; vectors are read of those row groups only that have a point whose upper limit reaches it, and only such points are compared.
So the result is that of a full scan. With `probes` a query looks at the cells nearest to it only, and is approximate.

Centres and code vectors are fitted on a bounded sample; every point is indexed. Queries are files of a few hundred; a task has a tile,
one such file and a group of index files, and hands on k rows a query. Neither points nor queries are broadcast or joined with each
other. A task's inner products of queries with code vectors are one matrix product with the decoded points, as that costs less
than looking up and adding a table's entries for each part of each of hundreds of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.embedding import rounded, rounded_values
from paperloom.operators.search import PLACES, TOP_K, fitted_centres, unit
from paperloom.operators.tiles import arrays, packed, to_files, values
from paperloom.sources.shared import file_system, kept, new_folder, write_whole

#: Points that centres and codes are fitted on, at most, and rounds of it; dimensions of a part; code vectors of a part, at most.
SAMPLE, ROUNDS, PART, CODES = 4096, 8, 2, 256
#: Rows of a row group, rows of a file, queries of a file, and queries that are compared at once.
GROUP_ROWS, FILE_ROWS, QUERIES, SLICE = 1024, 1 << 13, 256, 64
#: Files of a tile, at least; tiles that a file of queries has, tasks, and files of an index, at most.
TILE_FILES, MOST_TILES, MOST_TASKS, MOST_FILES = 8, 64, 20_000, 50_000
#: Limits are widened by this, more than sums of doubles are off.
SLACK = 1e-7


def cut(v: np.ndarray) -> np.ndarray:
    """Rows as parts (rows, parts, PART), filled up with zeros."""
    return np.pad(v, ((0, 0), (0, -v.shape[1] % PART))).reshape(len(v), -1, PART)


def _fitted_codes(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Lloyd's rounds for each part of the sample's residuals."""
    for rows in batches:
        for part, data in zip(rows["part"], rows["data"], strict=True):
            x = np.frombuffer(data).reshape(-1, PART)
            distinct = np.unique(x, axis=0)
            codes = distinct[np.random.default_rng([seed, part]).permutation(len(distinct))[:CODES]]
            for _ in range(ROUNDS):
                own = nearest_code(x, codes)
                n = np.bincount(own, minlength=len(codes))
                sums = np.stack([np.bincount(own, x[:, d], len(codes)) for d in range(PART)], axis=1)
                codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codes)
            yield pd.DataFrame({"part": [part], "codes": [codes.tobytes()]})


def nearest_code(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([((codes * codes).sum(axis=1) - 2 * x[at : at + 4096] @ codes.T).argmin(axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _encoded(batches: Iterator[pd.DataFrame], model: str, vector: str, width: int) -> Iterator[pd.DataFrame]:
    m = arrays(model)
    for batch in batches:
        for rows in (batch.iloc[at : at + GROUP_ROWS] for at in range(0, len(batch), GROUP_ROWS)):
            if any(len(x) != width for x in rows[vector]):
                raise ValueError(f"{vector}: all vectors of an index have one length")
            v = np.stack(rows[vector]).astype(float)
            long = np.isfinite(u := unit(v)).all(axis=1)
            rows, v, u = rows[long], v[long], u[long]
            if len(v):
                cell = (u @ m["centres"].T).argmax(axis=1)
                left = cut(u - m["centres"][cell])
                code = np.stack([nearest_code(left[:, p], m["codes"][p, : m["sizes"][p]]) for p in range(left.shape[1])], axis=1).astype(np.uint8)
                off = np.linalg.norm((left - decoded(m, code)).reshape(len(v), -1), axis=1)
                rows = rows.drop(columns=[vector]).assign(cell=cell.astype("int32"), code=[x.tobytes() for x in code], off=off, vector=[x.tobytes() for x in v])
                yield rows


def decoded(m: dict[str, np.ndarray], code: np.ndarray) -> np.ndarray:
    return m["codes"][np.arange(code.shape[1]), code]


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A sorted partition as a file; each row group is of one cell."""
    context, sink, writer, waiting = TaskContext.get(), pa.BufferOutputStream(), None, None
    number, rows = context.partitionId(), 0

    def put(table: pa.Table) -> None:
        nonlocal writer, rows
        writer = writer or pq.ParquetWriter(sink, table.schema, compression="zstd")
        writer.write_table(table, row_group_size=GROUP_ROWS)
        rows += len(table)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        while waiting is not None and len(waiting):
            cells = waiting.column("cell").to_numpy()
            n = min(int(np.searchsorted(cells, cells[0], "right")), GROUP_ROWS)
            if n == len(waiting) < GROUP_ROWS:
                break  # more of the cell may come
            put(waiting.slice(0, n))
            waiting = waiting.slice(n)
    if waiting is not None and len(waiting):
        put(waiting)
    if writer:
        writer.close()
        write_whole(f"{folder}/{number:06d}.parquet", [sink.getvalue()], context.taskAttemptId())
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([rows], pa.int64())], names=["file", "n_points"])


def build_index(points: DataFrame, path: str, n_cells: int = 64, key: str = "point_id", vector: str = "embedding", filters: tuple[str, ...] = (), sample: int = SAMPLE, seed: int = 7) -> None:
    """Writes an index of points to path. filters: columns that queries can ask to equal. Points without a vector, or with one of no
    length, are in no list; vectors of another length than the others are an error."""
    spark = points.sparkSession
    used = points.select(F.col(key).alias("key"), *[F.col(c).cast("string").alias(f"f_{c}") for c in filters], F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    drawn, centres = fitted_centres(used, n_cells, "v", sample, seed)
    if not len(drawn):
        raise ValueError("an index needs a point")
    parts = cut(drawn - centres[(drawn @ centres.T).argmax(axis=1)])
    asked = spark.createDataFrame([(p, parts[:, p].tobytes()) for p in range(parts.shape[1])], "part int, data binary")  # bounded by sample
    found = asked.repartition(min(len(parts[0]), 64)).mapInPandas(partial(_fitted_codes, seed=seed), "part int, codes binary").collect()
    codes = [np.frombuffer(r.codes).reshape(-1, PART) for r in sorted(found, key=lambda r: r.part)]
    padded = np.stack([np.pad(c, ((0, CODES - len(c)), (0, 0)), mode="edge") for c in codes])
    write_whole(f"{path}/model", [packed(centres=centres, codes=padded, sizes=np.array([len(c) for c in codes]), width=np.array(drawn.shape[1]), filters=np.array(filters, "U"), key_type=np.array(used.schema["key"].dataType.simpleString()))], 0)

    schema = T.StructType([*[f for f in used.schema if f.name != "v"], T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("off", T.DoubleType()), T.StructField("vector", T.BinaryType())])
    encoded = kept(used.mapInPandas(partial(_encoded, model=f"{path}/model", vector="v", width=drawn.shape[1]), schema), "encoded")
    n_files = max(1, min(MOST_FILES, -(-encoded.count() // FILE_ROWS)))
    ordered = encoded.repartitionByRange(n_files, "cell", "key").sortWithinPartitions("cell", "key")
    ordered.mapInArrow(partial(_write, folder=path), "file int, n_points long").write.parquet(f"{path}/files")


class Lists:
    """A file of an index: cells of its row groups; what a search reads of them, as it asks."""

    def __init__(self, path: str, m: dict[str, np.ndarray]):
        store, name = file_system(path)
        self.file, self.m = pq.ParquetFile(store.open_input_file(name)), m
        place = self.file.schema_arrow.names.index("cell")
        groups = [self.file.metadata.row_group(g) for g in range(self.file.metadata.num_row_groups)]
        self.cell = np.array([g.column(place).statistics.min for g in groups], np.int64)
        self.size = np.array([g.num_rows for g in groups], np.int64)
        self.filters = [f"f_{c}" for c in m["filters"]]

    def codes(self, g: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Points as their codes say, how far off these are, filter values (empty: none)."""
        table = self.file.read_row_group(g, ["code", "off", *self.filters])
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(table), -1)
        near = self.m["centres"][self.cell[g]] + decoded(self.m, code).reshape(len(table), -1)[:, : int(self.m["width"])]
        return near, table.column("off").to_numpy(), {c: values(np.array(table.column(c).to_pylist(), object)) for c in self.filters}

    def points(self, g: int) -> tuple[pa.ChunkedArray, np.ndarray]:
        table = self.file.read_row_group(g, ["key", "vector"])
        return table.column("key"), np.frombuffer(b"".join(table.column("vector").to_pylist())).reshape(len(table), -1)


def numbered(key: str, n: int) -> Column:
    """The file of each of n queries."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // QUERIES)))).cast("int").alias("file")


def _limits(files: list[str], a: dict[str, np.ndarray], m: dict[str, np.ndarray], probes: int | None) -> Iterator[tuple[Lists, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row group that a query looks at, and some of the queries: their numbers, and estimates (minus infinity where a filter
    or the cell says no) and how far these are off."""
    u = unit(a["v"])
    usable = np.flatnonzero(np.isfinite(u).all(axis=1))
    near = u @ m["centres"].T
    looks = np.zeros(near.shape, bool)
    if probes is None or probes >= near.shape[1]:
        looks[usable] = True
    else:
        looks[usable[:, None], np.argpartition(-near[usable], probes - 1, axis=1)[:, :probes]] = True
    for path in files:
        lists = Lists(path, m)
        for g in range(len(lists.cell)):
            queries = np.flatnonzero(looks[:, lists.cell[g]])
            if not len(queries):
                continue
            points, off, have = lists.codes(g)
            for some in (queries[at : at + SLICE] for at in range(0, len(queries), SLICE)):
                estimate = u[some] @ points.T
                for c, values in have.items():
                    wanted = a[c][some][:, None]
                    estimate[(wanted != "") & (wanted != values)] = -np.inf
                yield lists, g, some, estimate, off


def _thresholds(batches: Iterator[pd.DataFrame], path: str, folder: str, files: int, per_tile: int, probes: int | None, k: int) -> Iterator[pd.DataFrame]:
    """The k greatest lower limits of each query in a tile."""
    m = arrays(f"{path}/model")
    for batch in batches:
        for number, tile in zip(batch["file"], batch["tile"], strict=True):
            a = arrays(f"{folder}/queries-{number:06d}")
            best = np.full((len(a["q"]), k), -np.inf)
            for _, _, some, estimate, off in _limits(_files(path, tile, files, per_tile), a, m, probes):
                low = np.concatenate([best[some], estimate - off - SLACK], axis=1)
                best[some] = -np.partition(-low, k - 1, axis=1)[:, :k]
            at = np.flatnonzero((best > -np.inf).ravel())
            yield pd.DataFrame({"file": number, "q": a["q"][at // k], "low": best.ravel()[at]})


def _reranked(batches: Iterator[pd.DataFrame], path: str, folder: str, files: int, per_tile: int, probes: int | None, k: int, read: Accumulator | None) -> Iterator[pd.DataFrame]:
    m = arrays(f"{path}/model")
    for batch in batches:
        for number, tile in zip(batch["file"], batch["tile"], strict=True):
            a = arrays(f"{folder}/queries-{number:06d}")
            bound = arrays(f"{folder}/bounds-{number:06d}")
            order = np.argsort(bound["q"])
            at = order[np.minimum(np.searchsorted(bound["q"], a["q"], sorter=order), len(order) - 1)]
            least = np.where(bound["q"][at] == a["q"], bound["low"][at], -np.inf)
            norms = np.linalg.norm(a["v"], axis=1)
            last: tuple = (None, None)
            for lists, g, some, estimate, off in _limits(_files(path, tile, files, per_tile), a, m, probes):
                can = (estimate + off + SLACK >= least[some][:, None]) & (estimate > -np.inf)
                if not can.any():
                    continue
                if last[0] is not lists or last[1] != g:
                    last, held = (lists, g), lists.points(g)
                keys, v = held
                own = np.linalg.norm(v, axis=1)
                for row, x in zip(can, some, strict=True):
                    if len(p := np.flatnonzero(row)):
                        whole = v[p] @ a["v"][x] / (own[p] * norms[x])
                        scores = rounded_values(whole, PLACES)
                        if read is not None:
                            read.add(len(p))
                        if len(p) > k:
                            top = np.flatnonzero(scores >= np.partition(scores, len(p) - k)[len(p) - k])
                            p, whole = p[top], whole[top]
                        yield pd.DataFrame({"q": a["q"][x], "key": keys.take(pa.array(p)).to_pandas(), "score": whole})


def _files(path: str, tile: int, files: int, per_tile: int) -> list[str]:
    """Those of a tile that are there: a partition without rows has left no file."""
    names = [f"{path}/{x:06d}.parquet" for x in range(tile * per_tile, min((tile + 1) * per_tile, files))]
    store = file_system(path)[0]
    return [n for n, info in zip(names, store.get_file_info([file_system(n)[1] for n in names]), strict=True) if info.is_file]


def nearest_indexed(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K, vector: str = "embedding", probes: int | None = None, read: Accumulator | None = None) -> DataFrame:
    """query_id, point_id, score, rank: the k points with the greatest cosine to each query (query_id, vector, and any of the index's
    filter columns: a point has to equal those that are not null). Equal cosines, to nine places, go by key. Without probes the result
    is exact; with them each query looks at so many cells. read: is increased by the points whose vectors were compared. Queries
    without a vector, or with one of no length, have no neighbours."""
    folder, m = new_folder(spark, "queries"), arrays(f"{path}/model")
    lists = spark.read.parquet(f"{path}/files")
    files = lists.agg(F.max("file")).first()[0] + 1
    per_tile = max(TILE_FILES, -(-files // MOST_TILES))
    filters = tuple(c for c in m["filters"].tolist())
    wanted = [F.col(c).cast("string").alias(f"f_{c}") if c in queries.columns else F.lit(None).cast("string").alias(f"f_{c}") for c in filters]
    asked = queries.select("query_id", F.col(vector).cast("array<double>").alias("v"), *wanted).where("v IS NOT NULL AND size(v) > 0")
    asked = kept(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    if asked.where(F.size("v") != int(m["width"])).limit(1).count():
        raise ValueError("queries have vectors of the index's length")
    stored = kept(to_files(asked.select(numbered("q", asked.count()), "q", "v", *[f"f_{c}" for c in filters]), folder, "queries"), "query-files")

    def tiles(of: DataFrame) -> DataFrame:
        """Numbers of files only: each file of queries with each group of index files."""
        n_tiles = -(-files // per_tile)
        return of.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))).repartition(min(max(1, of.count() * n_tiles), MOST_TASKS), "file", "tile")

    low = tiles(stored).mapInPandas(partial(_thresholds, path=path, folder=folder, files=files, per_tile=per_tile, probes=probes, k=k), "file int, q long, low double")
    nth = F.row_number().over(Window.partitionBy("file", "q").orderBy(F.desc("low")))
    least = low.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("file", "q").agg(F.min("low").alias("low"), F.count("*").alias("n"))
    least = least.select("file", "q", F.when(F.col("n") == k, F.col("low")).otherwise(F.lit(float("-inf"))).alias("low"))  # fewer: all that pass
    bounded = kept(to_files(least, folder, "bounds"), "bounds")
    schema = f"q long, key {m['key_type']}, score double"
    found = tiles(bounded).mapInPandas(partial(_reranked, path=path, folder=folder, files=files, per_tile=per_tile, probes=probes, k=k, read=read), schema)
    order = Window.partitionBy("q").orderBy(rounded(F.col("score"), PLACES).desc(), "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "query_id"), "q").select("query_id", F.col("key").alias("point_id"), "score", "rank")
