"""Rows as numbered files of arrays in a shared folder, which tasks read as they need them."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from paperloom.sources.shared import file_system, write_whole


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


@lru_cache(maxsize=4)
def arrays(path: str) -> dict[str, np.ndarray]:
    store, name = file_system(path)
    with store.open_input_file(name) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as x:
        return {k: x[k] for k in x.files}


def values(column) -> np.ndarray:
    """Numbers as they are; vectors as rows, of one length; strings after a mark, so that null differs from empty."""
    column = pd.Series(column)
    if column.dtype != object:
        return column.to_numpy()
    if len(column) and isinstance(column.iloc[0], np.ndarray):
        if len({len(x) for x in column}) > 1:
            raise ValueError("vectors of one table have one length")
        return np.stack(column)
    return np.array(["" if x is None else f"={x}" for x in column], "U")


def _to_files(batches: Iterator[pd.DataFrame], folder: str, kind: str) -> Iterator[pd.DataFrame]:
    waiting: list[pd.DataFrame] = []

    def put() -> pd.DataFrame:
        rows = pd.concat(waiting)
        number = int(rows["file"].iloc[0])
        write_whole(f"{folder}/{kind}-{number:06d}", [packed(**{c: values(rows[c]) for c in rows.columns if c != "file"})], TaskContext.get().taskAttemptId())
        return pd.DataFrame({"file": [number]})

    for batch in batches:
        for number, rows in batch.groupby("file", sort=True):
            if waiting and waiting[0]["file"].iloc[0] != number:
                yield put()
                waiting = []
            waiting.append(rows)
    if waiting:
        yield put()


def to_files(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """rows (file, a column to sort by, others) as a file of arrays for each number that occurs; these numbers."""
    return rows.repartition("file").sortWithinPartitions("file", rows.columns[1]).mapInPandas(partial(_to_files, folder=folder, kind=kind), "file int")
