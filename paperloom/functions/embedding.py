"""A deterministic stand-in for an embedding model: counts of hashed words. It is no semantic model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024


#: Characters of texts whose words are held at once, if there are several.
CHARACTERS = 1 << 20


def words(text: str | None) -> list[str]:
    """Lower-cased letter by letter, as in SQL; they end at spaces, tabs and line feeds."""
    text = text or ""
    if not text.isascii():
        text = text.replace("İ", "i").replace("Σ", "σ")  # lower() makes two letters of one, and goes by its place
    return [w for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w]


def bucket(word: str, n: int = DIMENSIONS) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % n


def buckets(texts: list[str | None], n: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Of all words: numbers of texts, buckets. A word is hashed once for some texts, and none is remembered: a corpus has ever more of them."""
    places, found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHARACTERS):
            size, end = size + len(texts[end] or ""), end + 1
        own = [words(t) for t in texts[at:end]]
        code, distinct = pd.factorize(np.array([w for x in own for w in x], object))
        places.append(np.repeat(np.arange(at, end), [len(x) for x in own]))
        found.append(np.fromiter((bucket(w, n) for w in distinct), np.int64, len(distinct))[code])
        at = end
    return np.concatenate(places), np.concatenate(found)


def dense_vector(text: str | None) -> np.ndarray:
    """Counts of hashed words."""
    return hashed_words([text])[0]


def counted(texts: list[str | None], n: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts that are not zero: numbers of texts, buckets, counts."""
    place, own = buckets(texts, n)
    both, count = np.unique(place * n + own, return_counts=True)
    return both // n, both % n, count


def sparse_vectors(docs: DataFrame, key: str, text: str = "text", n: int = DIMENSIONS, batch: int = 256) -> DataFrame:
    """key, bucket, n: the counts of each text that are not zero, in one pass over its words; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for some in (rows.iloc[at : at + batch] for at in range(0, len(rows), batch)):
                place, own, count = counted(some.iloc[:, 1].tolist(), n)
                yield pd.DataFrame({key: some.iloc[:, 0].to_numpy()[place], "bucket": own, "n": count})

    schema = T.StructType([docs.schema[key], T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    return docs.select(key, text).mapInPandas(run, schema)


class Embedder(Protocol):
    """A model: one vector of a fixed length for each text, null counting as empty."""

    def __call__(self, texts: list[str | None]) -> np.ndarray: ...


def hashed_words(texts: list[str | None]) -> np.ndarray:
    """The stand-in as an Embedder."""
    place, own = buckets(texts)
    return np.bincount(place * DIMENSIONS + own, minlength=len(texts) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(float)


def embedded(rows: DataFrame, embedder: Embedder = hashed_words, text: str = "text", vector: str = "embedding", batch: int = 256) -> DataFrame:
    """rows with vectors of their texts, by so many texts at a time."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            made = [np.asarray(x, np.float32) for at in range(0, len(some), batch) for x in embedder(some.iloc[at : at + batch].tolist())]
            yield pd.Series(made, index=some.index, dtype=object)

    return rows.withColumn(vector, F.pandas_udf(run, "array<float>")(text))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double; null if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def rounded(x: Column, places: int) -> Column:
    """As SQL's round of a double: its product with a power of ten, half away from zero. F.round goes by the digits that are shown."""
    y = F.abs(x) * 10.0**places
    whole = F.floor(y)
    return F.signum(x) * (whole + F.when(y - whole >= 0.5, 1).otherwise(0)) / 10.0**places


def rounded_values(x: np.ndarray, places: int) -> np.ndarray:
    """rounded() of an array."""
    y = np.abs(x) * 10.0**places
    whole = np.floor(y)
    return np.copysign(whole + (y - whole >= 0.5), x) / 10.0**places


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
