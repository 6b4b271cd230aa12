"""Circuit breakers, routes over providers and a cache with a life time, replayed over logs.

A breaker's log is replayed in segments (operators.segments). State of the others depends on all that was before, so a key's events are
one ordered stream: they are dealt by key and sorted by Spark, and read as a stream of batches of which only the state is kept, however
long a key's log is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import segments
from paperloom.operators.breaker import CLOSED, FAILURES, HALF_OPEN, OPEN, RECOVERY_S, Breaker, folded

__all__ = ["CACHE_TTL_S", "CLOSED", "FAILURES", "HALF_OPEN", "OPEN", "RECOVERY_S", "TIMEOUT_MS", "Breaker", "available", "breaker_replay", "breaker_status", "cache_lookups", "cache_replay", "call_ok", "failure_runs", "folded", "routed"]

TIMEOUT_MS, CACHE_TTL_S = 30_000, 300.0


def call_ok(error: str = "error", latency: str = "latency_ms", timeout_ms: int = TIMEOUT_MS):
    """A call that took longer than the limit has failed."""
    return ~F.coalesce(F.col(error), F.lit(False)) & (F.coalesce(F.col(latency), F.lit(0)) <= timeout_ms)


def breaker_replay(calls: DataFrame, failures: int = FAILURES, recovery: float = RECOVERY_S) -> DataFrame:
    """calls: provider, ts (seconds), seq, ok and, if there is one, event ('call' or 'reset'). For each: whether it was attempted, and state, failures and successes after it, and ts."""
    reset = F.coalesce(F.col("event") == "reset", F.lit(False)) if "event" in calls.columns else F.lit(False)
    return segments.replayed(calls.select("provider", F.col("ts").cast("double").alias("ts"), "seq", F.coalesce("ok", F.lit(False)).alias("ok"), reset.alias("reset")), failures, recovery)


def failure_runs(calls: DataFrame) -> DataFrame:
    """calls: provider, ts, seq, ok. provider, seq, run: how many calls have failed in a row, up to each."""
    return segments.failure_runs(calls.select("provider", F.col("ts").cast("double").alias("ts"), "seq", F.coalesce("ok", F.lit(False)).alias("ok")))


def breaker_status(replayed: DataFrame, providers: DataFrame) -> DataFrame:
    """provider, state, failure_count, success_count, available: the last state of each of providers (provider, available); closed if it never had a call. Reading the status moves nothing."""
    last = replayed.groupBy("provider").agg(F.max_by(F.struct("state", "failure_count", "success_count"), F.struct("ts", "seq")).alias("s"))
    return providers.join(last, "provider", "left").select("provider", F.coalesce("s.state", F.lit(CLOSED)).alias("state"), F.coalesce("s.failure_count", F.lit(0)).alias("failure_count"), F.coalesce("s.success_count", F.lit(0)).alias("success_count"), "available")


def available(providers: DataFrame) -> DataFrame:
    """Of providers (provider, base_url, api_key, needs): whether what it needs is there."""
    return providers.withColumn("available", F.when(F.col("needs") == "base_url", F.coalesce("base_url", F.lit("")) != "").otherwise(F.coalesce("api_key", F.lit("")) != ""))


@dataclass
class Route:
    order: list[str]
    breakers: dict[str, Breaker] = field(default_factory=dict)


def routed(requests: DataFrame, order: list[str], failures: int = FAILURES, recovery: float = RECOVERY_S) -> DataFrame:
    """requests: router, ts, seq and outcomes (a map from provider to whether a call would succeed). Providers are tried in order,
    but those whose breaker is open; the first success answers. For each request: provider (null if all failed), tried. An empty
    answer is a success. A router is one stream: its providers' breakers hang together."""

    def step(r: Route, row) -> tuple:
        tried, answered, outcomes = [], None, dict(row.outcomes or {})
        for name in r.order:
            if name not in outcomes:
                continue
            breaker = r.breakers.setdefault(name, Breaker(failures, recovery))
            if not breaker.allows(row.ts):
                continue
            tried.append(name)
            breaker.record(bool(outcomes[name]), row.ts)
            if outcomes[name]:
                answered = name
                break
        return row.router, row.seq, answered, ",".join(tried)

    schema = T.StructType([requests.schema["router"], requests.schema["seq"], T.StructField("provider", T.StringType()), T.StructField("tried", T.StringType())])
    return folded(requests, "router", ["ts", "seq"], schema, lambda: Route(list(order)), step)


@dataclass
class Entry:
    since: float | None = None
    seq: int | None = None


def cache_lookups(requests: DataFrame, ttl: float = CACHE_TTL_S) -> DataFrame:
    """requests: key, ts (seconds), seq. hit: whether an answer that was stored less than ttl before is there; a miss stores one. stored: the
    seq of the request whose answer it is. Eviction at a number of entries couples all keys and is left out."""

    def step(e: Entry, row) -> tuple:
        hit = e.since is not None and row.ts - e.since < ttl
        if not hit:
            e.since, e.seq = row.ts, row.seq
        return row.key, row.seq, hit, e.seq

    schema = T.StructType([requests.schema["key"], requests.schema["seq"], T.StructField("hit", T.BooleanType()), T.StructField("stored", requests.schema["seq"].dataType)])
    return folded(requests, "key", ["ts", "seq"], schema, Entry, step)


def cache_replay(requests: DataFrame, ttl: float = CACHE_TTL_S) -> DataFrame:
    """key, seq, hit of cache_lookups."""
    return cache_lookups(requests, ttl).drop("stored")
