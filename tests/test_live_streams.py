"""Live streams: restart from the checkpoint, late rows, order of arrival, forgotten runs."""

import datetime
import random

from candela.streaming import live, steps

SCHEMA = "run long, step long, ts timestamp, value double, identical boolean, fallback boolean, text_same boolean"
BEGIN = datetime.datetime(2024, 1, 1)


def rows(minutes, run=1):
    return [(run, i, BEGIN + datetime.timedelta(minutes=m), float(i % 7), i % 5 > 0, i % 2 == 0, None) for i, m in enumerate(minutes)]


def expected(some, last, forget=10 ** 9):
    """Reports of rows in order of time, up to the minute ``last``."""
    out, place, streak, at, kept = [], 0, 0, None, []
    for run, step, ts, value, *flags in sorted(some, key=lambda r: (r[2], r[1])):
        m = (ts - BEGIN).total_seconds() / 60
        if m > last:
            break
        if at is not None and m - at > forget:
            place, streak, kept = 0, 0, []
        at, place, streak = m, place + 1, streak + 1 if flags[0] else 0
        kept = [*kept, (value, *[bool(f) for f in flags])][-10:]
        if place % 10 == 0:
            out.append((run, step, *live.report_row(place, streak, kept, 1, ["identical", "fallback", "text_same"])))
    return out


def run(parts, **how):
    plan = lambda s: live.trailing_reports(s, "run", "step", "ts", ["value"], ["identical", "fallback", "text_same"], "identical", **how)
    return sorted(tuple(r) for r in live.replayed(parts, plan, "test").collect())


def test_reports_follow_event_time_over_restarts(spark):
    some = rows(range(45))
    shuffled = random.Random(1).sample(some[:30], 30) + some[30:]
    late = (1, 99, BEGIN + datetime.timedelta(minutes=1), 1000.0, True, True, True)
    parts = [shuffled[:12], shuffled[12:32], [*shuffled[32:], late]]
    # within a part steps come in any order; the first part must not run ahead of the second's oldest
    parts = [sorted(shuffled[:32], key=lambda r: r[2])[:12][::-1], sorted(shuffled[:32], key=lambda r: r[2])[12:][::-1], parts[2]]
    got = run([spark.createDataFrame(p, SCHEMA).coalesce(1) for p in parts])
    assert got == expected(some, 44 - 10) and [r[1] for r in got] == [9, 19, 29]
    assert got[0][5:8] == (8, 5, 0) and got[0][-1] == ["IDENTICAL"]


def test_runs_are_forgotten(spark):
    some = rows([*range(15), *range(100, 125), 200, 300])
    parts = [some[:15], some[15:40], some[40:]]
    got = run([spark.createDataFrame(p, SCHEMA).coalesce(1) for p in parts], forget_ms=30 * 60_000)
    assert got == expected(some, 290, 30) and [r[1] for r in got] == [9, 24, 34]


def test_windows_leave_late_rows_out(spark):
    events = [(i, BEGIN + datetime.timedelta(minutes=i), "a", 1.0) for i in range(90)]
    late = [(100 + i, BEGIN + datetime.timedelta(minutes=i), "a", 50.0) for i in range(5)]
    df = lambda part: spark.createDataFrame(part, "id long, ts timestamp, kind string, value double").coalesce(1)
    parts = [df(events[:40]), df(events[40:80]), df(events[80:] + late)]
    out = live.replayed(parts, lambda s: steps.sliding(s, "ts", "20 minutes", "10 minutes", "kind", "value"), "test")
    got = sorted((r.start, r.n, r.total) for r in out.collect())
    assert got == [(BEGIN + datetime.timedelta(minutes=m), 10 if m < 0 else 20, 10.0 if m < 0 else 20.0) for m in range(-10, 60, 10)]


def test_arrivals_hold_every_row_once(spark):
    df = spark.createDataFrame([(i, BEGIN + datetime.timedelta(minutes=i * i)) for i in range(50)], "id long, ts timestamp")
    parts = [sorted(r.id for r in p.collect()) for p in live.arrivals(df, "ts", df.id == 3)]
    assert sorted(sum(parts, [])) == list(range(50)) and 3 in parts[2] and all(parts)
    assert [p.count() for p in live.arrivals(df.limit(0), "ts", df.id == 3)] == [0]
