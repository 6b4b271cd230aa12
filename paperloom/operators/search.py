"""Filters on payloads and exact nearest points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.embedding import Embedder, cosine, embedded, rounded, rounded_values
from paperloom.operators.tiles import arrays, packed, to_files, values
from paperloom.sources.shared import kept, new_folder, write_whole

TOP_K = 5
#: Places to which cosines count when they are ranked.
PLACES = 9
#: Queries of a file, those compared at once, points that a scan holds at once, and bytes of vectors in a file of points (in double).
QUERY_BLOCK, SLICE, SCANNED, POINT_BYTES = 512, 64, 256, 16 << 20
#: Files of a tile, at least; tiles that a file of queries has, and tasks, at most.
TILE_FILES, MOST_TILES, MOST_TASKS = 4, 64, 20_000
#: Hits that are broadcast to fetch what they carry, at most.
FETCHED = 100_000


def payload_filter(points: DataFrame, filters: dict | None, mode: str = "strict") -> Column:
    """The AND of equalities with those values that aren't None; an array column matches by any element; an unknown key is looked up in `extra`.

    strict: date_from and date_to are keys like any other (which no point has), and a list as a value is an error. extended:
    they bound extra's `date`, and a list matches an array column that shares an element."""

    def match(key: str, value) -> Column:
        if mode == "extended" and key in ("date_from", "date_to"):
            return F.col("extra")["date"] >= value if key == "date_from" else F.col("extra")["date"] <= value
        kind = points.schema[key].dataType if key in points.columns else None
        if isinstance(value, (list, tuple)):
            if mode != "extended":
                raise ValueError(f"{key}: a filter takes one value")
            return F.arrays_overlap(F.col(key), F.array(*map(F.lit, value))) if isinstance(kind, T.ArrayType) else F.col(key).isin(*value)
        if kind is None:
            return F.col("extra")[key] == value if "extra" in points.columns else F.lit(False)
        return F.array_contains(key, value) if isinstance(kind, T.ArrayType) else F.col(key) == value

    if mode not in ("strict", "extended"):
        raise ValueError(mode)
    wanted = [match(k, v) for k, v in (filters or {}).items() if v is not None]
    return reduce(lambda a, b: a & b, wanted) if wanted else F.lit(True)


def nearest(points: DataFrame, query: list[float], k: int = TOP_K, vector: str = "embedding", key: str = "point_id", filters: dict | None = None, mode: str = "strict") -> DataFrame:
    """The k points with the greatest cosine to one query, best first, then by key. Filters reach the scan; no shuffle but of k rows a task."""
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return points.where(payload_filter(points, filters, mode)).withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; those without a length are not a number."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _nearer(best: list[list[tuple]], vectors: np.ndarray, own: np.ndarray, keys: list, k: int, filters: list[tuple[np.ndarray, np.ndarray]] = ()) -> None:
    """Puts those of own that are among the k nearest of each of vectors into best: by the cosine to nine places, as in the end, so that
    equal points tie wherever they stand; the whole cosine is the third of each. filters: what vectors ask for (empty: anything) and what own has."""
    lengths = np.linalg.norm(own, axis=1)
    for low in range(0, len(vectors), SLICE):
        some = vectors[low : low + SLICE]
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = some @ own.T / (np.linalg.norm(some, axis=1)[:, None] * lengths)
        for asked, has in filters:
            wanted = asked[low : low + SLICE, None]
            scores[(wanted != "") & (wanted != has)] = np.nan
        least = np.array([-b[k - 1][0] if len(b) == k else -np.inf for b in best[low : low + SLICE]])
        reach = scores >= least[:, None] - 10.0**-PLACES
        for i in np.flatnonzero(reach.any(axis=1)):
            q, row, usable = low + i, rounded_values(scores[i], PLACES), np.flatnonzero(reach[i])
            if len(usable) > k:
                usable = usable[row[usable] >= np.partition(row[usable], len(usable) - k)[len(usable) - k]]
            best[q] = sorted(best[q] + [(-row[j], keys[j], scores[i, j]) for j in usable])[:k]


def _scanned(batches: Iterator[pa.RecordBatch], path: str, k: int, embedder: Embedder | None, filters: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (q, key, score): the k nearest of the task's points (key, vector or text, filters) of each query of a file. Only SCANNED points
    at once are taken out of a batch."""
    best: list[list[tuple]] = []
    schema = None
    for batch in batches:
        if schema is None:
            a, schema = arrays(path), pa.schema([("q", pa.int64()), batch.schema.field(0).with_nullable(True), ("score", pa.float64())])
            best = [[] for _ in a["q"]]
        for at in range(0, batch.num_rows, SCANNED):
            rows = batch.slice(at, SCANNED)
            if embedder:
                own = np.asarray(embedder(rows.column(1).to_pylist()), float)
            else:
                rows = rows.filter(pc.fill_null(pc.greater(pc.list_value_length(rows.column(1)), 0), False))
                if not rows.num_rows:
                    continue
                if pc.count_distinct(pc.list_value_length(rows.column(1))).as_py() > 1:
                    raise ValueError("vectors of one table have one length")
                own = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)
            if own.shape[1] != a["v"].shape[1]:
                raise ValueError("queries and points have vectors of one length")
            has = [values(pd.Series(rows.column(2 + i).to_pylist(), dtype=object)) for i in range(len(filters))]
            _nearer(best, a["v"], own, rows.column(0).to_pylist(), k, [(a[c], x) for c, x in zip(filters, has, strict=True)])
    if schema:
        found = [(q, x, s) for q, own in zip(a["q"].tolist(), best, strict=True) for _, x, s in own]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [[]] * 3, schema, strict=True)], schema=schema)


def _point_files(batches: Iterator[pd.DataFrame], folder: str, embedder: Embedder | None, filters: list[str]) -> Iterator[pd.DataFrame]:
    """Points (key, vector or text, filters) as files of POINT_BYTES of vectors; where they are."""
    context, made, held = TaskContext.get(), [], []
    size = 0

    def put() -> None:
        path = f"{folder}/points-{context.partitionId():06d}-{len(made):06d}"
        vectors = np.concatenate([v for _, v, _ in held])
        has = pd.concat([f for _, _, f in held])
        narrow = vectors.astype(np.float32)
        vectors = narrow if np.array_equal(narrow, vectors, equal_nan=True) else vectors
        write_whole(path, [packed(keys=values(np.concatenate([x for x, _, _ in held])), vectors=vectors, **{c: values(has[c]) for c in filters})], context.taskAttemptId())
        made.append(path)

    for batch in batches:
        for rows in (batch.iloc[at : at + 1024] for at in range(0, len(batch), 1024)):
            found = embedder(rows.iloc[:, 1].tolist()) if embedder else rows.iloc[:, 1].tolist()
            keep = [i for i, x in enumerate(found) if x is not None and len(x)]
            if not keep:
                continue
            if len({len(found[i]) for i in keep}) > 1 or held and held[0][1].shape[1] != len(found[keep[0]]):
                raise ValueError("vectors of one table have one length")
            held.append((rows.iloc[:, 0].to_numpy()[keep], np.array([found[i] for i in keep], float), rows.iloc[keep, 2:]))
            size += held[-1][1].nbytes
            if size >= POINT_BYTES:
                put()
                held, size = [], 0
    if held:
        put()
    yield pd.DataFrame({"path": made}, dtype=object)


def _tiles(batches: Iterator[pd.DataFrame], folder: str, k: int, key: str, filters: list[str]) -> Iterator[pd.DataFrame]:
    """Rows (file, tile, path), sorted: the k nearest points of each query of a file among those of a tile."""
    best: list[list[tuple]] = []
    a: dict[str, np.ndarray] = {}
    at = None

    def found() -> pd.DataFrame:
        out = [(q, x, s) for q, own in zip(a["q"], best, strict=True) for _, x, s in own]
        return pd.DataFrame(out, columns=["q", key, "score"])

    for batch in batches:
        for number, tile, path in zip(batch["file"], batch["tile"], batch["path"], strict=True):
            if at != (number, tile):
                if at:
                    yield found()
                a, at = arrays(f"{folder}/queries-{number:06d}"), (number, tile)
                best = [[] for _ in a["q"]]
            points = arrays(path)
            if points["vectors"].shape[1] != a["v"].shape[1]:
                raise ValueError("queries and points have vectors of one length")
            keys = points["keys"]
            _nearer(best, a["v"], points["vectors"].astype(float), [x[1:] for x in keys.tolist()] if keys.dtype.kind == "U" else keys.tolist(), k, [(a[c], points[c]) for c in filters])
    if at:
        yield found()


def nearest_batch(points: DataFrame, queries: DataFrame, k: int = TOP_K, vector: str = "embedding", key: str = "point_id", embedder: Embedder | None = None, filters: tuple[str, ...] = ()) -> DataFrame:
    """query_id, key, score, rank: the k nearest points of each query (query_id, vector). With an embedder the columns hold texts. filters:
    columns of both; a point has to equal those of a query that are not null.

    Queries are written to files in the shared folder. Those of one file are compared where the points are: a task goes through its points
    once and hands on k rows a query. For more queries the points' vectors are written to files too: a task has a tile, a file of
    queries and some tens of files of points, so that neither its memory nor what is ranked in the end grows with the number of tasks
    times that of queries. Points or queries without length or vector have no neighbours; equal cosines (to nine places) go by key;
    vectors of different lengths are an error."""
    spark = points.sparkSession
    folder = new_folder(spark, "search")
    named = [f"f_{c}" for c in filters]
    has = [F.col(c).cast("string").alias(f"f_{c}") for c in filters]
    owned = points.select(key, vector, *has)
    asked = kept(queries.select("query_id", F.col(vector).alias("v"), *has).withColumn("q", F.monotonically_increasing_id()), "asked")
    n_queries = asked.count()
    as_vectors = embedded(asked, embedder, "v", "v") if embedder else asked.where("v IS NOT NULL AND size(v) > 0").withColumn("v", F.col("v").cast("array<double>"))
    number = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-n_queries // QUERY_BLOCK)))).cast("int")
    files = kept(to_files(as_vectors.select(number.alias("file"), "q", F.col("v").cast("array<double>").alias("v"), *named), folder, "queries"), "query-files")
    schema = T.StructType([T.StructField("q", T.LongType()), points.schema[key], T.StructField("score", T.DoubleType())])
    if n_queries <= QUERY_BLOCK:
        some = owned if files.count() else owned.limit(0)
        near = some.mapInArrow(partial(_scanned, path=f"{folder}/queries-000000", k=k, embedder=embedder, filters=named), schema)
    else:
        stored = kept(owned.mapInPandas(partial(_point_files, folder=folder, embedder=embedder, filters=named), "path string"), "point-files")
        n_tiles = min(MOST_TILES, max(1, -(-stored.count() // TILE_FILES)))
        tiles = files.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))).join(stored.withColumn("tile", F.pmod(F.xxhash64("path"), F.lit(n_tiles)).cast("int")), "tile")
        near = tiles.select("file", "tile", "path").repartition(min(max(1, files.count() * n_tiles), MOST_TASKS), "file", "tile").sortWithinPartitions("file", "tile", "path").mapInPandas(partial(_tiles, folder=folder, k=k, key=key, filters=named), schema)
    order = Window.partitionBy("q").orderBy(rounded(F.col("score"), PLACES).desc(), key)
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "query_id"), "q").select("query_id", key, "score", "rank")


def with_payload(found: DataFrame, points: DataFrame, key: str = "point_id") -> DataFrame:
    """Hits with what points carry besides. Up to FETCHED hits are broadcast, and points stay where they are; more are joined by key."""
    hits = kept(found, "hits")
    return points.join(F.broadcast(hits) if hits.count() <= FETCHED else hits, key)


def fitted_centres(points: DataFrame, n_cells: int, vector: str, sample: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of at most `sample` points, and centres of spherical k-means over them."""
    rows = [r[0] for r in points.select(vector).orderBy(F.xxhash64(vector)).limit(sample).collect()]
    drawn = unit(np.array(rows, float)) if rows else np.zeros((0, 0))
    drawn = drawn[np.isfinite(drawn).all(axis=1)]
    centres = drawn[np.random.default_rng(seed).choice(len(drawn), min(n_cells, len(drawn)), replace=False)] if len(drawn) else drawn
    for _ in range(10):
        own = (drawn @ centres.T).argmax(axis=1) if len(drawn) else []
        centres = np.array([drawn[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]).reshape(centres.shape)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return drawn, centres


def cells(points: DataFrame, n_cells: int, vector: str = "embedding", sample: int = 10_000, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """points with `cell`, and the centres, fitted on at most `sample` points; every point is assigned."""
    centres = fitted_centres(points, n_cells, vector, sample, seed)[1]

    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series((np.stack(x.to_numpy()).astype(float) @ centres.T).argmax(axis=1).astype("int32"))

    return points.withColumn("cell", F.pandas_udf(assign, "int")(vector)), centres


def nearest_in_cells(points: DataFrame, centres: np.ndarray, query: list[float], probes: int, k: int = TOP_K, vector: str = "embedding", key: str = "point_id") -> DataFrame:
    """Approximate: the exact nearest among points of the `probes` cells whose centres are nearest. Above indexing_threshold points a caller may prefer this."""
    order = np.argsort(-(centres @ np.array(query, float)))[:probes].tolist()
    return nearest(points.where(F.col("cell").isin(order)), query, k, vector, key)


def hit_rows(hits: DataFrame) -> DataFrame:
    """Payload projection: text, source and page default to empty; metadata is the payload without the text."""
    extra = F.to_json(F.struct(*[c for c in hits.columns if c not in ("text", "embedding", "score", "query_id", "rank")]))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return hits.select(*[c for c in ("query_id", "rank") if c in hits.columns], empty("text"), empty("source"), empty("page"), "score", extra.alias("metadata"))


def citations(hits: DataFrame) -> DataFrame:
    """Of hits with a source: it as text, page, score to three places, rounded once from the whole cosine. Repeated ones stay."""
    keep = [c for c in ("query_id", "rank") if c in hits.columns]
    return hits.where(F.coalesce("source", F.lit("")) != "").select(*keep, F.col("source").alias("text"), "page", rounded(F.col("score"), 3).alias("score"))


def previews(hits: DataFrame) -> DataFrame:
    keep = [c for c in ("query_id", "rank") if c in hits.columns]
    return hits.select(*keep, "source", "page", rounded(F.col("score"), 3).alias("score"), F.left("text", F.lit(500)).alias("text"))
