"""A breaker's calls replayed in segments, so that a provider with very many calls is many tasks.

What a segment does to a breaker is a table: from each number of failures of a closed breaker, and from an open one by the time at which
it opened, to the state in which it ends. A breaker that opened at t0 does nothing until the first call that is recovery seconds later;
which call that is changes with t0 in steps, and steps with the same end are one. The table is made in one pass from the segment's end to
its start, as each event's end follows from the ends of later ones. The tables of a provider, few rows, are gone through in
order; that gives the state before each segment, from which all are replayed at once. Counts of successes and failures do not
decide anything, so they are counted from a segment's start and the sums before it are added in the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.breaker import OPEN, Breaker, folded
from paperloom.sources.shared import kept

#: Events of a segment, at most: 2 to this power.
SEGMENT_BITS = 15
#: Ends in a table: a number of failures of a closed breaker, or one of these.
OPENED, UNCHANGED = -1, -2
NAMES = ("closed_f", "closed_at", "open_ts", "open_f", "open_at", "else_f", "else_at")
TABLE = "closed_f array<int>, closed_at array<double>, open_ts array<double>, open_f array<int>, open_at array<double>, else_f int, else_at double"


def table(ts: list[float], ok: list[bool], reset: list[bool], failures: int, recovery: float) -> tuple:
    """A row of TABLE. Ends are numbers on the way: below failures those of a closed breaker, then failures and the event that opened it."""
    n = len(ts)
    calls = [i for i in range(n) if not reset[i]]
    later, k = [n] * n, len(calls)  # the first call after each event that an open breaker lets through, if the event opened it
    for i in range(n - 1, -1, -1):
        while k and calls[k - 1] > i and not ts[calls[k - 1]] - ts[i] < recovery:
            k -= 1
        later[i] = calls[k] if k < len(calls) else n
    trial, zero = [0] * n, [0] * (n + 1)  # ends of a breaker that each event tries, and of a closed one without failures before it
    closed, next_reset = list(range(failures)), n
    for i in range(n - 1, -1, -1):
        j = later[i]
        opened = zero[next_reset + 1] if next_reset < j else trial[j] if j < n else failures + i
        trial[i] = closed[0] if ok[i] else opened
        if reset[i]:
            next_reset = i
        if reset[i] or ok[i]:
            closed = [closed[0]] * failures
        else:
            closed = [*closed[1:], opened]
        zero[i] = closed[0]
    end = lambda x: (x, None) if x < failures else (OPENED, ts[x - failures])
    steps: list[tuple[float, int]] = []
    for i in calls:
        if i > next_reset:
            break
        if steps and steps[-1][1] == trial[i]:
            steps.pop()
        steps.append((ts[i], trial[i]))
    ends = [end(x) for x in closed]
    stepped = [end(x) for _, x in steps]
    rest = end(zero[next_reset + 1]) if next_reset < n else (UNCHANGED, None)
    return [f for f, _ in ends], [t for _, t in ends], [t for t, _ in steps], [f for f, _ in stepped], [t for _, t in stepped], *rest


@dataclass
class State:
    """Before a segment: a closed breaker's failures, or OPENED and when."""

    f: int = 0
    at: float | None = None

    def step(self, row) -> tuple:
        """The state before the row's segment; this one becomes that after it."""
        before = row.provider, row.segment, self.f, self.at
        if self.f >= 0:
            f, at = row.closed_f[self.f], row.closed_at[self.f]
        else:
            k = first_after(row.open_ts, lambda t: not t - self.at < row.recovery)
            f, at = (row.open_f[k], row.open_at[k]) if k < len(row.open_ts) else (row.else_f, row.else_at)
        if f != UNCHANGED:
            self.f, self.at = int(f), None if f >= 0 else float(at)
        return before


def first_after(times, holds: Callable[[float], bool]) -> int:
    low, high = 0, len(times)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(times[mid]) else (mid + 1, high)
    return low


def _tables(key: tuple, rows: pd.DataFrame, failures: int, recovery: float) -> pd.DataFrame:
    rows = rows.sort_values("at")
    made = table(rows["ts"].tolist(), rows["ok"].tolist(), rows["reset"].tolist(), failures, recovery)
    return pd.DataFrame([(*key, *made, recovery)], columns=["provider", "segment", *NAMES, "recovery"], dtype=object)


def _replayed(key: tuple, rows: pd.DataFrame, failures: int, recovery: float) -> pd.DataFrame:
    """Events with attempted, state, failures (from the segment's start on while `carried`) and successes from its start."""
    rows = rows.sort_values("at")
    b, f, at = Breaker(failures, recovery), int(rows["f"].iloc[0]), rows["opened_at"].iloc[0]
    carried = f < 0
    if carried:
        b.state, b.opened_at = OPEN, float(at)
    else:
        b.failed = f
    out = []
    for seq, ts, ok, reset in zip(rows["seq"], rows["ts"], rows["ok"], rows["reset"], strict=True):
        attempted = False
        if reset:
            b.reset()
        elif attempted := b.allows(ts):
            b.record(bool(ok), ts)
        carried = carried and not (reset or attempted and ok)
        out.append((attempted, b.state, b.failed, b.succeeded, carried))
    made = pd.DataFrame(out, columns=["attempted", "state", "failed", "succeeded", "carried"], index=rows.index)
    return pd.concat([rows[["provider", "segment", "seq", "ts", "at"]], made], axis=1)


def segmented(calls: DataFrame) -> DataFrame:
    """calls in the order of provider, ts and seq, with their places (at) and the numbers of their segments, which may hold several providers."""
    order = ("provider", "ts", "seq")
    placed = calls.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return kept(placed.withColumn("segment", F.shiftright("at", SEGMENT_BITS)), "segments")


def failure_runs(calls: DataFrame) -> DataFrame:
    """provider, seq, run: how many calls of a provider have failed in a row, up to each. Runs are counted within segments; what the segments
    before hand on is added to those that no success of their own has begun, so that a run over many segments is no single task."""
    within = Window.partitionBy("provider", "segment").orderBy("at")
    counted = segmented(calls).withColumn("wins", F.count_if("ok").over(within))
    counted = counted.withColumn("run", F.count_if(~F.col("ok")).over(Window.partitionBy("provider", "segment", "wins").orderBy("at")))
    own = counted.groupBy("provider", "segment").agg(F.max("wins").alias("won"), F.max_by("run", "at").alias("last"))
    in_order = Window.partitionBy("provider").orderBy("segment")
    since = own.withColumn("since", F.count_if(F.col("won") > 0).over(in_order))
    ends = since.withColumn("end", F.sum("last").over(Window.partitionBy("provider", "since").orderBy("segment")))
    before = ends.select("provider", "segment", F.coalesce(F.lag("end").over(in_order), F.lit(0)).alias("before"))
    return joined(counted, before).select("provider", "seq", (F.col("run") + F.when(F.col("wins") == 0, F.col("before")).otherwise(0)).alias("run"))


def joined(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """rows with what is known of their segments; a provider may be null."""
    known = segments.withColumnsRenamed({"provider": "_provider", "segment": "_segment"})
    return rows.join(known, F.col("provider").eqNullSafe(F.col("_provider")) & (F.col("segment") == F.col("_segment"))).drop("_provider", "_segment")


def replayed(calls: DataFrame, failures: int, recovery: float) -> DataFrame:
    """calls: provider, seq, ts (not null), ok, reset. For each: attempted, state, failure_count and success_count after it."""
    if failures < 1:
        raise ValueError("failures: one at least")

    def tabled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _tables(key, rows, failures, recovery)

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _replayed(key, rows, failures, recovery)

    placed = segmented(calls)
    kinds = f"provider {calls.schema['provider'].dataType.simpleString()}, segment long"
    tables = placed.groupBy("provider", "segment").applyInPandas(tabled, f"{kinds}, {TABLE}, recovery double")
    before = kept(folded(tables, "provider", ["segment"], f"{kinds}, f int, opened_at double", State, State.step), "states")
    kinds += f", seq {calls.schema['seq'].dataType.simpleString()}, ts double, at long, attempted boolean, state string, failed int, succeeded int, carried boolean"
    done = kept(joined(placed, before).groupBy("provider", "segment").applyInPandas(again, kinds), "replayed")

    own = done.groupBy("provider", "segment").agg(F.max("succeeded").alias("won"), F.max_by(F.struct("failed", "carried"), "at").alias("last"))
    in_order = Window.partitionBy("provider").orderBy("segment")
    since = own.withColumn("run", F.count_if(~F.col("last.carried")).over(in_order))
    ends = since.withColumn("end", F.sum("last.failed").over(Window.partitionBy("provider", "run").orderBy("segment")))
    sums = ends.select("provider", "segment", F.coalesce(F.sum("won").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("won"), F.coalesce(F.lag("end").over(in_order), F.lit(0)).alias("lost"))
    counts = F.when(F.col("carried"), F.col("lost") + F.col("failed")).otherwise(F.col("failed")).cast("int"), (F.col("won") + F.col("succeeded")).cast("int")
    return joined(done, sums).select("provider", "seq", "attempted", "state", counts[0].alias("failure_count"), counts[1].alias("success_count"), "ts")
