"""A circuit breaker, and keyed state that is folded over ordered events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FAILURES, RECOVERY_S = 3, 60.0
CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


@dataclass
class Breaker:
    """Opens at the third failure in a row; after the recovery time one call tries it; its outcome closes or opens it again."""

    failures: int = FAILURES
    recovery: float = RECOVERY_S
    state: str = CLOSED
    failed: int = 0
    succeeded: int = 0
    opened_at: float | None = None

    def allows(self, now: float) -> bool:
        if self.state == OPEN:
            if now - (self.opened_at or 0.0) < self.recovery:
                return False
            self.state = HALF_OPEN
        return True

    def record(self, ok: bool, now: float) -> None:
        if ok:
            self.state, self.failed, self.succeeded = CLOSED, 0, self.succeeded + 1
            return
        self.failed += 1
        if self.failed >= self.failures or self.state == HALF_OPEN:
            self.state, self.opened_at = OPEN, now

    def reset(self) -> None:
        self.state, self.failed = CLOSED, 0


def folded(events: DataFrame, key: str, order: list[str], schema: str | T.StructType, start: Callable[[], object], step: Callable) -> DataFrame:
    """step(state, row) -> output row, over each key's events in order. Keys are dealt by hash; one key is one stream."""
    columns = events.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = None, object()
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                if (k := getattr(row, key)) != current:
                    state, current = start(), k
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    made = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = made.fieldNames()
    return events.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, made)
