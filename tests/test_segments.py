import random

import pytest

from paperloom.operators import router, segments
from paperloom.operators.breaker import Breaker


def log(rng, n, ok=0.5, resets=0.02):
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.5, 1.0, 7.0, 40.0])
        out.append((t, i, rng.random() < ok, rng.random() < resets))
    return out


def replay(events, failures, recovery):
    b, out = Breaker(failures, recovery), {}
    for ts, seq, ok, reset in sorted(events):
        attempted = False
        if reset:
            b.reset()
        elif attempted := b.allows(ts):
            b.record(ok, ts)
        out[seq] = (attempted, b.state, b.failed, b.succeeded)
    return out


def brute_end(events, f, at, failures, recovery):
    b = Breaker(failures, recovery)
    b.failed = max(f, 0)
    if f < 0:
        b.state, b.opened_at = "open", at
    for ts, _, ok, reset in events:
        if reset:
            b.reset()
        elif b.allows(ts):
            b.record(ok, ts)
    return (b.failed, None) if b.state == "closed" else (-1, b.opened_at)


@pytest.mark.parametrize(("failures", "recovery"), [(3, 60.0), (1, 5.0), (2, 0.0), (3, 1e9)])
def test_tables_give_every_end(failures, recovery):
    rng = random.Random(failures)
    names = ["closed_f", "closed_at", "open_ts", "open_f", "open_at", "else_f", "else_at"]
    for _ in range(150):
        events = log(rng, rng.randrange(0, 25), ok=rng.choice([0.1, 0.5, 0.9]), resets=rng.choice([0, 0.1]))
        made = segments.table([e[0] for e in events], [e[2] for e in events], [e[3] for e in events], failures, recovery)
        row = type("Row", (), dict(zip(names, made, strict=True)) | {"provider": "p", "segment": 0, "recovery": recovery})
        starts = [(f, None) for f in range(failures)] + [(-1, -t) for t in (0.0, 0.5, 1.0, 30.0, 59.5, 60.0, 1e6)]
        for f, at in starts:
            state = segments.State(f, at)
            assert state.step(row)[2:] == (f, at)
            assert (state.f, state.at) == brute_end(events, f, at, failures, recovery), (events, f, at)


@pytest.mark.parametrize("bits", [1, 3, 15])
def test_replay_equals_one_stream(spark, monkeypatch, bits):
    monkeypatch.setattr(segments, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    logs = {"hot": log(rng, 600, ok=0.4), "bad": log(rng, 90, ok=0.0, resets=0.01), "good": log(rng, 50, ok=1.0), None: log(rng, 60)}
    rows = [(p, ts, seq, ok, "reset" if reset else "call") for p, own in logs.items() for ts, seq, ok, reset in own]
    rng.shuffle(rows)
    calls = spark.createDataFrame(rows, "provider string, ts double, seq long, ok boolean, event string").repartition(4)
    got = router.breaker_replay(calls, 3, 60.0).collect()
    assert len(got) == len(rows)
    for p, own in logs.items():
        assert {r.seq: (r.attempted, r.state, r.failure_count, r.success_count) for r in got if r.provider == p} == replay(own, 3, 60.0)
    assert router.breaker_replay(calls.limit(0)).collect() == []
    with pytest.raises(ValueError, match="failures"):
        router.breaker_replay(calls, 0)


def test_a_hot_provider_is_many_tasks(spark, monkeypatch):
    """No group of a replay has more than one segment's events."""
    monkeypatch.setattr(segments, "SEGMENT_BITS", 6)
    calls = spark.range(5000).selectExpr("'hot' AS provider", "id * 1.0D AS ts", "id AS seq", "id % 3 > 0 AS ok", "false AS reset")
    groups = []
    made = segments.kept
    monkeypatch.setattr(segments, "kept", lambda df, name: groups.append((name, made(df, name))) or groups[-1][1])
    assert segments.replayed(calls, 3, 60.0).count() == 5000
    placed = dict(groups)["segments"]
    assert placed.groupBy("provider", "segment").count().agg({"count": "max"}).first()[0] <= 64
    assert dict(groups)["states"].count() >= 79


@pytest.mark.parametrize("bits", [1, 4, 15])
def test_failure_runs_over_segments(spark, monkeypatch, bits):
    monkeypatch.setattr(segments, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    logs = {"never": [(float(i), i, False) for i in range(200)], "mixed": [(float(i // 2), i, rng.random() < 0.2) for i in range(200)], None: [(1.0, i, i == 5) for i in range(40)]}
    calls = spark.createDataFrame([(p, *x) for p, own in logs.items() for x in own], "provider string, ts double, seq long, ok boolean").repartition(3)
    got = {(r.provider, r.seq): r.run for r in router.failure_runs(calls).collect()}
    for p, own in logs.items():
        run = 0
        for _, seq, ok in sorted(own):
            run = 0 if ok else run + 1
            assert got[p, seq] == run
    assert len(got) == 440
