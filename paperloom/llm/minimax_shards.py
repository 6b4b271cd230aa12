"""Shards of nearly equal bytes: a minimax partition of groups in order.

Documents of equal text are a group, which stays whole; groups are ordered by their least doc_id. The smallest capacity of a shard that
holds all groups in so many contiguous runs is found by binary search; each try is a greedy check that takes, from every cut, the
farthest start of a group that the capacity allows. Cuts are then set as near to equal shares as that capacity allows: what must be
left to the shards behind bounds a cut from below, what fits bounds it from above. A group larger than an equal share of what is left
is a shard of its own, before the others, as it would set everybody's capacity; there are fewer of these than shards.

Sizes are summed in two levels, so that no task sees all rows: documents are sorted by group, a task writes the places where its groups
start as a file of numbers, and the search reads a few pages of those files for each try. A document's shard and slot follow from
its place in the whole order. Texts do not move: a digest of 256 bits stands for them.

A null text is of no bytes and one group with empty texts. Rows without a doc_id come last; equal rows are all kept, in an order of
their own. Very long texts are only hashed. More shards than groups leave some empty. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import Ranges, kept, new_folder, write_whole

SHARDS = 16
#: Documents of a partition, about, as long as there are not more partitions than this; starts of a page.
PART_ROWS, MOST_PARTS, PAGE = 1 << 16, 20_000, 1 << 13
LAST = (1 << 63) - 1


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, size, text_crc32, digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")).withColumn("row", F.monotonically_increasing_id())


def own_shards(largest: list[int], total: int, shards: int) -> int:
    """How many of the largest groups are larger than an equal share of what the others leave."""
    n = 0
    while n < min(len(largest), shards - 1) and largest[n] * (shards - n) > total:
        total -= largest[n]
        n += 1
    return n


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Passes rows on with their places in the partition; leaves the starts of groups, as (bytes, rows) before each, in a file."""
    part, size, rows, starts = TaskContext.get().partitionId(), 0, 0, []
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("size")).to_numpy()
        before = size + np.cumsum(sizes) - sizes
        at = rows + np.arange(len(sizes))
        first = np.flatnonzero(batch.column(batch.schema.get_field_index("is_first")).to_numpy(zero_copy_only=False))
        starts.append(np.stack([before[first], at[first]], axis=1))
        size, rows = size + int(sizes.sum()), rows + len(sizes)
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "size", "text_crc32")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), part, np.int32)), pa.array(at), pa.array(before)], names=["doc_id", "size", "text_crc32", "part", "at", "before"])
    if rows:
        write_whole(f"{folder}/{part:06d}", [np.concatenate(starts).astype("<i8").tobytes()], TaskContext.get().taskAttemptId())


class Starts:
    """The starts of all groups and the end, as (bytes, rows) before each, read a page at a time. parts: (number, rows, bytes), in order."""

    def __init__(self, folder: str, parts: list[tuple[int, int, int]]):
        self.folder, self.parts = folder, [p for p, _, _ in parts]
        self.rows = np.concatenate([[0], np.cumsum([n for _, n, _ in parts], dtype=np.int64)]).tolist()
        self.bytes = np.concatenate([[0], np.cumsum([n for _, _, n in parts], dtype=np.int64)]).tolist()
        self.page = lru_cache(maxsize=256)(self._page)
        self.count = lru_cache(maxsize=4096)(self._count)

    def _count(self, k: int) -> int:
        source = Ranges(f"{self.folder}/{self.parts[k]:06d}")
        n = source.size // 16
        source.close()
        return n

    def _page(self, k: int, page: int) -> np.ndarray:
        source = Ranges(f"{self.folder}/{self.parts[k]:06d}")
        found = np.frombuffer(source.read(page * PAGE * 16, min(PAGE, self.count(k) - page * PAGE) * 16), "<i8").reshape(-1, 2)
        source.close()
        return found

    def _lower(self, k: int, x: int) -> int:
        """Starts of part k with fewer bytes before them than x, which counts within the part."""
        low, high = 0, -(-self.count(k) // PAGE)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.page(k, mid)[0, 0] < x else (low, mid)
        return (low - 1) * PAGE + int(np.searchsorted(self.page(k, low - 1)[:, 0], x)) if low else 0

    def _start(self, k: int, i: int) -> tuple[int, int]:
        size, rows = self.page(k, i // PAGE)[i % PAGE].tolist()
        return self.bytes[k] + size, self.rows[k] + rows

    def from_(self, x: int) -> tuple[int, int]:
        """The first start at x or after it; the end if there is none."""
        for k in range(max(0, bisect_right(self.bytes, x) - 1), len(self.parts)):
            if (i := self._lower(k, x - self.bytes[k])) < self.count(k):
                return self._start(k, i)
        return self.bytes[-1], self.rows[-1]

    def until(self, x: int) -> tuple[int, int]:
        """The last start at x or before it; the end if x is there."""
        if x >= self.bytes[-1]:
            return self.bytes[-1], self.rows[-1]
        for k in range(bisect_right(self.bytes, x) - 1, -1, -1):
            if i := self._lower(k, x - self.bytes[k] + 1):
                return self._start(k, i - 1)
        return 0, 0


def smallest_capacity(starts: Starts, begin: int, end: int, shards: int, largest: int) -> int:
    """By binary search; a capacity holds if shards that are filled greedily reach the end."""

    def holds(capacity: int) -> bool:
        at = begin
        for _ in range(shards):
            at = starts.until(at + capacity)[0]
        return at >= end

    low, high = max(largest, -(-(end - begin) // shards)), max(end - begin, 1)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


def cuts(starts: Starts, giants: list[int], shards: int, largest: int) -> list[tuple[int, int]]:
    """Where each shard but the first begins, as (bytes, rows). giants: sizes of the groups at the beginning that are shards of their own; largest: of the others."""
    out, begin, end = [], 0, starts.bytes[-1]
    for size in giants:
        begin += size
        out.append(starts.from_(begin))
    left = shards - len(giants)
    capacity = smallest_capacity(starts, begin, end, left, largest)
    least = [end]  # from behind: a cut must not be before these
    for _ in range(left - 1):
        least.append(max(begin, starts.from_(least[-1] - capacity)[0]))
    at = begin
    for k in range(1, left):
        wanted = begin + (end - begin) * k // left
        low, high = max(least[left - k], at), starts.until(at + capacity)[0]
        below, above = starts.until(wanted), starts.from_(wanted)
        near = below if wanted - below[0] <= above[0] - wanted else above
        near = starts.from_(low) if near[0] < low else starts.until(high) if near[0] > high else near
        out.append(near)
        at = near[0]
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and one), text_crc32, shard (from 0), slot (place in its shard, from 0)."""
    if shards < 1:
        raise ValueError("shards: one at least")
    spark = docs.sparkSession
    rows = kept(sized(docs), "sizes")
    rank = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "row")
    groups = kept(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(rank).alias("low")), "groups")
    top = groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()  # no more than there are shards
    whole = groups.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    n_rows, total = whole.n or 0, whole.bytes or 0
    n = own_shards([r.bytes for r in top], total, shards)

    giant = F.lit(n)
    for k in range(n):
        giant = F.when(F.col("digest") == F.lit(bytes(top[k].digest)), k).otherwise(giant)
    shared = groups.where("n > 1").select("digest", "low")
    placed = rows.join(shared, "digest", "left").select("doc_id", "size", "text_crc32", "row", giant.alias("giant"), F.coalesce("low", rank).alias("low"))
    placed = kept(placed.select("*", (F.col("row") == F.col("low.row")).alias("is_first")).withColumn("d", rank["d"]), "placed")
    order = ("giant", "low.d", "low.row", "d", "row")
    folder = new_folder(spark, "starts")
    in_order = placed.repartitionByRange(max(1, min(MOST_PARTS, -(-n_rows // part_rows))), *order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "is_first")
    numbered = kept(in_order.mapInArrow(partial(_write, folder=folder), "doc_id long, size long, text_crc32 long, part int, at long, before long"), "ordered")

    parts = [tuple(r) for r in numbered.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("part").collect()]  # a row a partition
    starts = Starts(folder, parts)
    found = cuts(starts, [r.bytes for r in top[:n]], shards, top[n].bytes if n < len(top) else 0) if parts else []
    bases = spark.createDataFrame([(p, starts.rows[k], starts.bytes[k]) for k, (p, _, _) in enumerate(parts)], "part int, base_rows long, base_bytes long")
    row, at = F.col("base_rows") + F.col("at"), F.col("base_bytes") + F.col("before")
    shard = sum((F.when(at >= b, 1).otherwise(0) for b, _ in found), F.lit(0))
    begin: Column = F.lit(0)
    for b, r in found:
        begin = F.when(at >= b, r).otherwise(begin)
    return numbered.join(bases, "part").select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (row - begin).cast("long").alias("slot"))
