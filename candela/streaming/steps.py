"""Step logs as streams: file source and sink, running counters, streaks with a stop rule, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_steps(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def write_steps(steps: DataFrame, folder: str, checkpoint: str, every: int = 1, step: str = "step"):
    """Append every ``every``-th step as lines of JSON; exactly once, by the checkpoint."""
    kept = steps.where(F.col(step) % every == 0) if every > 1 else steps
    return kept.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").start(folder)


def running_counts(steps: DataFrame, run: str, flag: str) -> DataFrame:
    """Per run: steps so far, steps with the flag, and their share (complete or update mode)."""
    on = F.coalesce(F.col(flag), F.lit(False)).cast("int")
    return steps.groupBy(run).agg(F.count("*").alias("n"), F.sum(on).alias("n_on"), F.avg(on).alias("rate"))


def streaks(steps: DataFrame, run: str, step: str, flag: str, stop_at: int) -> DataFrame:
    """(run, step, streak, stop) of every step: state is one number a run. Steps of a run in one batch are taken in order."""
    kind = steps.schema[run].dataType.simpleString()

    def follow(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(step, kind="stable")
        out = []
        for s, on in zip(rows[step], rows[flag].fillna(False)):
            n = n + 1 if on else 0
            out.append((key[0], int(s), n, n >= stop_at))
        state.update((n,))
        yield pd.DataFrame(out, columns=[run, step, "streak", "stop"])

    return steps.groupBy(run).applyInPandasWithState(follow, f"{run} {kind}, {step} long, streak long, stop boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, ts: str, size: str, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    return sliding(events, ts, size, size, by, value, late)


def sliding(events: DataFrame, ts: str, size: str, step: str, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(F.window("_ts", size, step), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(F.session_window("_ts", gap), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n", "total")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a stream gives for the input there is now, as a table in memory (tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
