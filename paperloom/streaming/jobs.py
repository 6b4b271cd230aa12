"""Ingest of a folder as files arrive, and breakers and a cache whose state outlives the job."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paperloom.functions.chunking import chunks
from paperloom.functions.embedding import Embedder, hashed_words
from paperloom.functions.text import EXTENSIONS, accepted
from paperloom.operators.router import CACHE_TTL_S, FAILURES, RECOVERY_S, Breaker
from paperloom.sources.files import extracted
from paperloom.sources.folders import FolderSource
from paperloom.sources.shared import kept
from paperloom.sources.sinks import as_points, upsert_points

CALLS = "provider string, ts double, seq long, ok boolean"
REQUESTS = "key string, ts double, seq long"


def ingest_folder(spark: SparkSession, incoming: str, points: str, status: str, checkpoint: str, collection: str, embedder: Embedder | None = hashed_words, settle_seconds: float = 1.0) -> StreamingQuery:
    """Takes in what is new in a folder, then ends. points gets the chunks of each file with their vectors, status one row for it: processed with a
    chunk, else failed. Files that cannot be taken in are failed, the batch goes on. A batch that is run again replaces its status rows, and
    ids keep its points single. Files younger than settle_seconds wait for the next run."""
    spark.dataSource.register(FolderSource)
    found = spark.readStream.format(FolderSource.name()).option("suffixes", ",".join(EXTENSIONS)).option("settle_seconds", settle_seconds).load(incoming)
    files = found.select("path", "name", "length", "content").where(accepted(F.col("name")))

    def store(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, number, points, status, collection, embedder)

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batch(files: DataFrame, number: int, points: str, status: str, collection: str, embedder: Embedder | None = hashed_words) -> None:
    """One batch of files (path, name, length, content). Their texts are written once and read from there."""
    texts = kept(extracted(files).withColumnsRenamed({"name": "source", "path": "filepath"}), "texts")
    made = kept(chunks(texts, key="filepath"), "chunks")
    upsert_points(as_points(made, F.lit(collection), embedder=embedder), points)
    counts = made.groupBy("filepath").agg(F.count("*").alias("n_chunks"))
    rows = texts.select("filepath", "source").join(counts, "filepath", "left")
    rows.select("filepath", F.col("source").alias("name"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.col("n_chunks") > 0, "processed").otherwise("failed").alias("status")).write.mode("overwrite").parquet(f"{status}/batch={number}")


class BreakerState(StatefulProcessor):
    """One breaker for each provider. Rows of a batch are ordered by (ts, seq); batches come as they arrive,
    and a key's rows of one batch are held at once: maxFilesPerTrigger bounds them."""

    failures, recovery = FAILURES, RECOVERY_S

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("breaker", "state string, failed int, succeeded int, opened_at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        b = Breaker(self.failures, self.recovery)
        if self.kept.exists():
            b.state, b.failed, b.succeeded, b.opened_at = self.kept.get()
        calls = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out = []
        for row in calls.itertuples(index=False):
            if attempted := b.allows(row.ts):
                b.record(bool(row.ok), row.ts)
            out.append((key[0], row.seq, attempted, b.state, b.failed, b.succeeded))
        self.kept.update((b.state, b.failed, b.succeeded, b.opened_at))
        yield pd.DataFrame(out, columns=["provider", "seq", "attempted", "state", "failure_count", "success_count"])

    def close(self) -> None:
        pass


def breaker_stream(calls: DataFrame, failures: int = FAILURES, recovery: float = RECOVERY_S) -> DataFrame:
    """The stream form of operators.router.breaker_replay; calls: CALLS. Needs the RocksDB state store."""
    processor = type("Breakers", (BreakerState,), {"failures": failures, "recovery": recovery})()
    schema = "provider string, seq long, attempted boolean, state string, failure_count int, success_count int"
    return calls.groupBy("provider").transformWithStateInPandas(processor, schema, "Append", "None")


class CacheState(StatefulProcessor):
    """When the answer of each key was stored. Rows of a batch as in BreakerState. An entry is dropped when the watermark passes its end."""

    ttl = CACHE_TTL_S

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("entry", "since double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = since = self.kept.get()[0] if self.kept.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            hit = since is not None and row.ts - since < self.ttl
            since = since if hit else row.ts
            out.append((key[0], row.seq, hit))
        if since != first:
            if first is not None:
                self.handle.deleteTimer(self.end(first))
            self.kept.update((since,))
            self.handle.registerTimer(self.end(since))
        yield pd.DataFrame(out, columns=["key", "seq", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.kept.clear()
        return iter(())

    def end(self, since: float) -> int:
        """In milliseconds, rounded up."""
        return math.ceil((since + self.ttl) * 1000)

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, ttl: float = CACHE_TTL_S, delay: str = "10 minutes") -> DataFrame:
    """The stream form of operators.router.cache_replay; requests: REQUESTS, of times after 1970. A request has to be less than delay older than
    the newest before its batch; others are dropped. The state of a key goes when its answer's time and the delay are over, so it is as large
    as what is alive."""
    processor = type("Cache", (CacheState,), {"ttl": ttl})()
    timed = requests.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(processor, "key string, seq long, hit boolean", "Append", "EventTime")
