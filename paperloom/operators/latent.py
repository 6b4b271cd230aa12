"""An embedding that is fitted on the corpus: a randomised singular value decomposition of its TF-IDF.

Words are hashed to a fixed number of features, so that what is fitted doesn't grow with the corpus. A document's row is its counts times
ln((1 + documents) / (1 + documents with the feature)) + 1, made one long. The decomposition is a range finder: from random columns, each
round multiplies by the matrix and its transpose in one pass over the documents, and the small result (features by columns) is made
orthonormal, to the earlier rounds' columns too, by QR on the driver. The columns of all rounds together (a block Krylov space: the
spectrum of texts is flat, the last round's alone leave the 128th value three hundredths too small) are the basis. Products with the
columns of all rounds but the last are what the next round was made of, so a last pass multiplies by its columns only; the eigenvectors
of the inner products turn the basis into the right singular vectors. The projection is a table of a row a feature; an `Embedder` reads it.

Texts are split and hashed once: their counts are written to files in the shared folder, and the passes read these, one at a time. A pass has
two tasks for each core, so that what is summed does not grow with the corpus.

A task adds up what its documents give and hands that on in blocks of features; blocks are summed in two levels, so no sum is one task.
Documents themselves do not move."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.embedding import counted
from paperloom.operators.tiles import arrays, packed
from paperloom.sources.shared import file_system, kept, new_folder, write_whole

#: Features that words are hashed to; dimensions of a vector; columns of the range finder besides them; rounds of it.
FEATURES, DIMENSIONS, EXTRA, ROUNDS = 1 << 14, 128, 32, 4
#: Documents that are multiplied at once; counts of a file, about; features of a block of a sum; tasks that share a block of it.
DOCUMENTS, COUNTS, BLOCK, SHARES = 256, 1 << 20, 256, 16


def rows_of(row: np.ndarray, col: np.ndarray, n: np.ndarray, documents: int, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Rows of TF-IDF, of counts that are not zero; out: zeros to put them into."""
    out = np.zeros((documents, len(idf))) if out is None else out
    weight = n * idf[col]
    length = np.sqrt(np.bincount(row, weight * weight, documents))
    out[row, col] = weight / np.maximum(length, 1e-12)[row]
    return out


def _counts(batches: Iterator[pa.RecordBatch], folder: str, n: int) -> Iterator[pa.RecordBatch]:
    """Counts of texts as files of COUNTS of them: by DOCUMENTS texts their number and that of the counts, then texts, features and counts; where they are."""
    context, made, held, size = TaskContext.get(), [], [], 0

    def put() -> None:
        made.append(f"{folder}/counts-{context.partitionId():06d}-{len(made):06d}")
        of, row, col, count = zip(*held, strict=True)
        own = {"documents": np.array(of), "sizes": np.array([len(x) for x in row]), "place": np.concatenate(row).astype(np.int32), "feature": np.concatenate(col).astype(np.int32), "n": np.concatenate(count).astype(np.int32)}
        write_whole(made[-1], [packed(**own)], context.taskAttemptId())

    for batch in batches:
        for at in range(0, batch.num_rows, DOCUMENTS):
            texts = batch.column(0).slice(at, DOCUMENTS).to_pylist()
            held.append((len(texts), *counted(texts, n)))
            size += len(held[-1][1])
            if size >= COUNTS:
                put()
                held, size = [], 0
    if held:
        put()
    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    for rows in batches:
        for path in rows["path"]:
            a, at = arrays(path), 0
            for documents, size in zip(a["documents"].tolist(), a["sizes"].tolist(), strict=True):
                yield *(a[c][at : at + size] for c in ("place", "feature", "n")), documents
                at += size


def _blocks(total: np.ndarray) -> Iterator[pd.DataFrame]:
    for at in range(0, len(total), BLOCK):
        if total[at : at + BLOCK].any():
            yield pd.DataFrame({"block": [at // BLOCK], "data": [total[at : at + BLOCK].tobytes()]})


def _frequencies(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Documents with each feature, and in a last place all documents."""
    total = np.zeros((n + 1, 1))
    for _, col, _, documents in _read(batches):
        total[:n, 0] += np.bincount(col, minlength=n)
        total[n] += documents
    yield from _blocks(total)


def _round(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    """Transposed matrix times matrix times q."""
    a = arrays(path)
    total, product, space = np.zeros(a["q"].shape), np.zeros(a["q"].shape), np.zeros((0, len(a["q"])))  # memory is taken once
    for row, col, n, documents in _read(batches):
        space = space if len(space) >= documents else np.zeros((documents, len(a["q"])))
        rows = rows_of(row, col, n, documents, a["idf"], space[:documents])
        total += np.matmul(rows.T, rows @ a["q"], out=product)
        rows[row, col] = 0
    yield from _blocks(total)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for rows in batches:
        for block, data in zip(rows["block"], rows["data"], strict=True):
            own = np.frombuffer(data)
            total[block] = total[block] + own if block in total else own
    yield pd.DataFrame({"block": list(total), "data": [x.tobytes() for x in total.values()]}, dtype=object).astype({"block": "int32"})


def _total(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of all parts' blocks, which is of a fixed size."""
    shared = parts.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES))).repartition("block", "share").select("block", "data").mapInPandas(_summed, "block int, data binary")
    out = np.zeros((rows, columns))
    for r in shared.repartition("block").mapInPandas(_summed, "block int, data binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.data).reshape(-1, columns)
    return out


def fit(docs: DataFrame, path: str, text: str = "text", n_features: int = FEATURES, dimensions: int = DIMENSIONS, extra: int = EXTRA, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Writes the projection of docs' texts to path/projection.parquet and gives its singular values, greatest first. Null texts count as
    empty. With fewer documents than dimensions the last ones are zero."""
    if dimensions < 1 or dimensions > n_features:
        raise ValueError("dimensions: from one to n_features")
    spark = docs.sparkSession
    folder = new_folder(spark, "latent")
    texts = docs.select(F.col(text).cast("string").alias("text"))
    counts = kept(texts.mapInArrow(partial(_counts, folder=folder, n=n_features), "path string"), "counts")
    counts = counts.repartition(max(1, min(counts.count(), 2 * spark.sparkContext.defaultParallelism)))
    made = "block int, data binary"
    found = _total(counts.mapInPandas(partial(_frequencies, n=n_features), made), n_features + 1, 1)[:, 0]
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    width = min(dimensions + extra, n_features)

    def times(q: np.ndarray, name: str) -> np.ndarray:
        write_whole(f"{folder}/{name}", [packed(q=q, idf=idf)], 0)
        return _total(counts.mapInPandas(partial(_round, path=f"{folder}/{name}"), made), *q.shape)

    q = basis = np.linalg.qr(times(np.random.default_rng(seed).normal(size=(n_features, width)), "q-0"))[0]
    products = []
    for k in range(1, rounds):
        products.append(times(q, f"q-{k}"))
        q = np.linalg.qr(np.concatenate([basis, products[-1]], axis=1))[0][:, basis.shape[1] :]
        basis = np.concatenate([basis, q], axis=1)
        if not q.shape[1]:
            break
    else:
        products.append(times(q, f"q-{rounds}"))
    inner = basis.T @ np.concatenate(products, axis=1)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:dimensions]
    values = np.sqrt(np.maximum(values[order], 0))
    projection = (basis @ vectors[:, order]) * (values > 1e-9 * max(values[0], 1e-9))
    table = pa.table({"feature": np.arange(n_features, dtype=np.int32), "idf": idf, "vector": pa.FixedSizeListArray.from_arrays(pa.array(projection.ravel()), dimensions)})
    sink = io.BytesIO()
    pq.write_table(table, sink)
    write_whole(f"{path}/projection.parquet", [sink.getvalue()], 0)
    return values


@lru_cache(maxsize=2)
def _projection(path: str) -> tuple[np.ndarray, np.ndarray]:
    store, name = file_system(f"{path}/projection.parquet")
    with store.open_input_file(name) as f:
        table = pq.read_table(f)
    return table.column("idf").to_numpy(), table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(table), -1)


@dataclass(frozen=True)
class LatentWords:
    """An Embedder by the projection of a path. Texts without a known word have a vector of zeros."""

    path: str

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        idf, projection = _projection(self.path)
        out = np.zeros((len(texts), projection.shape[1]))
        for at in range(0, len(texts), DOCUMENTS):
            some = texts[at : at + DOCUMENTS]
            out[at : at + DOCUMENTS] = rows_of(*counted(some, len(idf)), len(some), idf) @ projection
        return out
