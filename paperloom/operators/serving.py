"""Questions answered as the service does: the gate, the cache, the model for what neither answers, and the meter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import or_message
from paperloom.operators.completion import Provider, cache_key, completed
from paperloom.operators.generation import NOT_READY, usage_events
from paperloom.operators.router import CACHE_TTL_S, cache_lookups
from paperloom.sources.shared import kept
from paperloom.sources.sinks import append_usage

#: What a request has besides what completed takes.
KEYS = ("collection", "model", "query", "filters")


def served(requests: DataFrame, providers: list[Provider], ttl: float = CACHE_TTL_S, **limits) -> DataFrame:
    """requests (query_id, collection, model, query, filters (a map), ts, seq, ready, system, user, n_hits) with answer, cached, provider,
    token counts, latency_ms and attempts. What is not ready is told so and asks no cache. Of the others those with an answer to the
    same collection, model, query and filters that is less than ttl seconds old get it; the rest are asked, each once, and written before
    they are used again, as a model that is asked twice need not say the same. A call that fails has the fixed message, and is
    stored as well, as an answer without evidence is."""
    keyed = kept(requests.withColumn("key", cache_key(*[F.col(c) for c in KEYS])), "requests")
    known = kept(cache_lookups(keyed.where("ready").select("key", "ts", "seq"), ttl), "lookups")
    looked = keyed.join(known.select(F.col("key").alias("_k"), F.col("seq").alias("_s"), "hit", "stored"), (F.col("key") == F.col("_k")) & (F.col("seq") == F.col("_s")), "left").drop("_k", "_s")
    made = kept(completed(looked.where("NOT ready OR NOT hit").drop("hit", "stored"), providers, **limits), "completions")
    asked = made.withColumn("answer", F.when(~F.col("ready"), F.lit(NOT_READY)).otherwise(or_message(F.col("answer")))).withColumn("cached", F.lit(False))
    stored = asked.where("ready").select(F.col("key").alias("_k"), F.col("seq").alias("_s"), "answer")
    none = {c: F.lit(None).cast(asked.schema[c].dataType) for c in ("provider", "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms", "attempts")}
    again = looked.where("hit").join(stored, (F.col("key") == F.col("_k")) & (F.col("stored") == F.col("_s"))).withColumns(none | {"cached": F.lit(True)})
    return asked.unionByName(again.select(*asked.columns)).drop("key")


def serve(requests: DataFrame, providers: list[Provider], answers: str, usage: str, batch: str | int, prices: tuple[float, float] = (0.0, 0.0), ttl: float = CACHE_TTL_S, **limits) -> DataFrame:
    """Writes the answers of a batch of requests (served) and its usage events, and gives the answers. A batch that is run again replaces both."""
    spark = requests.sparkSession
    served(requests, providers, ttl, **limits).write.mode("overwrite").parquet(path := f"{answers}/batch={batch}")
    done = spark.read.parquet(path)
    first = requests.agg(F.min("model")).first()[0]
    append_usage(usage_events(done.withColumns({"id": F.col("query_id"), "collection_id": F.col("collection")}), first or "", *prices), usage, batch)
    return done
