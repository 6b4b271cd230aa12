"""Live completions: providers in order, a breaker for each in the loop, a deadline for each call, and attempts as rows.

A call runs in a thread of its own and its time counts from its own start; one that hangs is left behind and takes neither a place among
the calls in flight nor the worker's end. Breakers live as long as a task: Spark may run a task again, so what must not be asked twice
is written first."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.breaker import FAILURES, RECOVERY_S, Breaker

SECONDS, POOL = 30.0, 8
ATTEMPTS = "array<struct<provider: string, ts: double, latency_ms: long, ok: boolean, error: string>>"


def timed(ask: Callable, args: tuple, seconds: float):
    """What ask gives, or raises; TimeoutError if that takes longer."""
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((ask(*args), None))
        except BaseException as e:  # noqa: BLE001  handed to the caller, whatever it is
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        found, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer in {seconds:g} s") from None
    if error is not None:
        raise error
    return found


@dataclass(frozen=True)
class Provider:
    """ask(system, user) gives a text, or a text and its usage (token counts by either naming)."""

    name: str
    ask: Callable[[str, str], str | tuple[str, dict]]
    available: bool = True


@dataclass
class Completion:
    answer: str | None = None
    provider: str | None = None
    usage: dict = field(default_factory=dict)
    attempts: list[tuple] = field(default_factory=list)


class Router:
    """Providers are tried in order, but those that are not available or whose breaker is open; the first that answers wins, an empty
    answer too. If none does the answer is None."""

    def __init__(self, providers: list[Provider], seconds: float = SECONDS, failures: int = FAILURES, recovery: float = RECOVERY_S, clock: Callable[[], float] = time.time):
        self.providers, self.seconds, self.clock, self.lock = providers, seconds, clock, threading.Lock()
        self.breakers = {p.name: Breaker(failures, recovery) for p in providers}

    def complete(self, system: str, user: str) -> Completion:
        out = Completion()
        for p in self.providers:
            with self.lock:
                if not (p.available and self.breakers[p.name].allows(self.clock())):
                    continue
            start, error = self.clock(), None
            try:
                found = timed(p.ask, (system, user), self.seconds)
            except TimeoutError as e:
                error = f"timeout: {e}"
            except Exception as e:  # noqa: BLE001  whatever a provider raises
                error = f"{type(e).__name__}: {e}"
            end = self.clock()
            with self.lock:
                self.breakers[p.name].record(error is None, end)
            out.attempts.append((p.name, start, int((end - start) * 1000), error is None, error))
            if error is None:
                out.answer, out.usage = found if isinstance(found, tuple) else (found, {})
                out.answer, out.provider = out.answer or "", p.name
                break
        return out


def tokens(usage: dict, *names: str) -> int | None:
    return next((int(usage[n]) for n in names if usage.get(n) is not None), None)


def completed(prompts: DataFrame, providers: list[Provider], seconds: float = SECONDS, pool: int = POOL, failures: int = FAILURES, recovery: float = RECOVERY_S) -> DataFrame:
    """prompts (system, user, and n_hits and ready, if they are there: what has no hit or is not ready is not asked) with answer (null
    if all have failed), provider, prompt_tokens, completion_tokens, total_tokens, latency_ms and attempts. At most pool calls of a task are in flight."""
    schema = T.StructType([*prompts.schema.fields, *T.StructType.fromDDL(f"answer string, provider string, prompt_tokens long, completion_tokens long, total_tokens long, latency_ms long, attempts {ATTEMPTS}").fields])
    names = schema.fieldNames()[-7:]

    def row(x: Completion) -> tuple:
        asked, given = tokens(x.usage, "prompt_tokens", "input_tokens"), tokens(x.usage, "completion_tokens", "output_tokens")
        total = tokens(x.usage, "total_tokens")
        total = (asked or 0) + (given or 0) if total is None and x.usage else total
        return x.answer, x.provider, asked, given, total, sum(a[2] for a in x.attempts) if x.attempts else None, [dict(zip(("provider", "ts", "latency_ms", "ok", "error"), a, strict=True)) for a in x.attempts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router = Router(providers, seconds, failures, recovery)
        with ThreadPoolExecutor(pool) as calls:
            for rows in batches:
                ask = (rows["n_hits"] > 0).to_numpy() if "n_hits" in rows else pd.Series(True, rows.index).to_numpy()
                if "ready" in rows:
                    ask = ask & rows["ready"].fillna(True).to_numpy(bool)
                waiting = [calls.submit(router.complete, s, u) if a else None for s, u, a in zip(rows["system"], rows["user"], ask, strict=True)]
                made = pd.DataFrame([row(w.result() if w else Completion()) for w in waiting], columns=names, index=rows.index, dtype=object)
                yield pd.concat([rows, made], axis=1)

    return prompts.mapInPandas(run, schema)


def attempt_rows(done: DataFrame, key: str = "query_id") -> DataFrame:
    """provider, ts, seq, ok, latency_ms, error, key: a row for each call, as breakers are replayed over them."""
    each = done.select(key, F.posexplode("attempts").alias("n", "a"))
    return each.select("a.provider", "a.ts", F.xxhash64(key, "n").alias("seq"), "a.ok", "a.latency_ms", "a.error", key)


def cache_key(collection: Column, model: Column, query: Column, filters: Column) -> Column:
    """One key for each collection, model, query and set of filters (a map; its order doesn't count)."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (collection, model, query)]
    told = F.array_sort(F.transform(F.map_entries(filters), lambda e: F.to_json(F.array(e["key"], e["value"]))))
    return F.sha2(F.to_json(F.array(*parts, F.coalesce(F.to_json(told), F.lit("[]")))), 256)
