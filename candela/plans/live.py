"""Queries over step logs as live streams, with late rows planted; their SQL says what the watermark admits."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import telemetry
from candela.plans.catalog import query, rounded
from candela.plans.tables import table
from candela.streaming import live, steps

#: Rows that come late: every 17th of the first half of the time.
_LATE = "event_id % 17 = 5 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"
#: What was in time, and how far the watermark goes in the end.
_LIVE = f"live AS (SELECT * FROM events WHERE NOT ({_LATE})), mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 minute AS wm FROM events)"


def _arrivals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first, last = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    late = (F.col("event_id") % 17 == 5) & (2 * (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first)) < F.lit((last or 0) - (first or 0)))
    return live.arrivals(e, "ts", late)


def _stamp(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(f"""WITH {_LIVE}, w AS (SELECT time_bucket(INTERVAL 20 minute, ts) - unnest([0, 1, 2]) * INTERVAL 20 minute AS start, event_type, value FROM live)
SELECT start, start + INTERVAL 1 hour AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total FROM w, mark GROUP BY start, event_type, wm HAVING start + INTERVAL 1 hour <= wm""")
def stream_sliding(spark, sf_dir):
    out = live.replayed(_arrivals(spark, sf_dir), lambda e: steps.sliding(e, "ts", "1 hour", "20 minutes", "event_type", "value"), "sliding")
    return _stamp(rounded(out, 2), "start", "end")


@query(f"""WITH {_LIVE}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM live),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minute AS "end", count(*) AS n, round(sum(value), 2) AS total FROM s, mark GROUP BY user_id, k, wm HAVING max(ts) + INTERVAL 30 minute <= wm""")
def stream_sessions(spark, sf_dir):
    out = live.replayed(_arrivals(spark, sf_dir), lambda e: steps.sessions(e, "ts", "30 minutes", "user_id", "value"), "sessions")
    return _stamp(rounded(out, 2), "start", "end")


_MARKS = {"identical": "value > 15", "fallback": "event_type = 'error'", "text_same": "event_type IN ('view', 'click')", "flat": "value < 60"}
_WARN = """list_filter([CASE WHEN n_identical >= 0.8 * n THEN 'IDENTICAL' END, CASE WHEN n_fallback > 0.5 * n THEN 'VAR_FALLBACK' END, CASE WHEN n_text_same > 0.5 * n THEN 'TEXT_REPEAT' END, CASE WHEN streak >= 10 THEN 'ZERO_GRAD' END], lambda x: x IS NOT NULL)"""


def _report_sql(source: str, order: str) -> str:
    counts = ", ".join(f"CAST(count(*) FILTER ({_MARKS[f]}) OVER t AS BIGINT) AS n_{f}" for f in ("identical", "fallback", "text_same"))
    return f"""i AS (SELECT *, sum(CASE WHEN {_MARKS["flat"]} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY {order}) AS island FROM {source}),
k AS (SELECT *, CAST(sum(CASE WHEN {_MARKS["flat"]} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY {order}) AS BIGINT) AS streak FROM i),
w AS (SELECT user_id AS run, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS place, count(*) OVER t AS n, avg(value) OVER t AS m, {counts}, streak, ts FROM k WINDOW t AS (PARTITION BY user_id ORDER BY {order} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT run, step, place, n, round(m, 4) AS trailing_value, n_identical, n_fallback, n_text_same, streak, {_WARN} AS warnings FROM w"""


def _marked(events):
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "ts", "value", *[F.expr(c).alias(f) for f, c in _MARKS.items()])


@query(f"WITH {_LIVE}, {_report_sql('live', 'ts, event_id')}, mark WHERE place % 10 = 0 AND date_trunc('milliseconds', ts) <= wm")
def stream_trailing(spark, sf_dir):
    out = live.replayed(_arrivals(spark, sf_dir), lambda e: live.trailing_reports(_marked(e), "run", "step", "ts", ["value"], ["identical", "fallback", "text_same"], "flat"), "trailing")
    return rounded(out, 4)


@query(f"WITH {_report_sql('events', 'event_id')} WHERE place % 10 = 0")
def trailing_reports(spark, sf_dir):
    return rounded(telemetry.trailing_report(_marked(table(spark, sf_dir, "events")), "run", "step", ["value"], ["identical", "fallback", "text_same"], "flat"), 4)
