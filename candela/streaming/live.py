"""Step logs as live streams: a trailing report of each run by its own state, and runs over all files there are.

``TrailingReport`` takes the steps of a run in the order of their event time, whatever the order in which they come: a step waits in the
run's state until the watermark has passed it, then a timer takes all that is due. State is what waits, the last ``size`` steps and
three numbers; a run without steps for ``forget_ms`` is forgotten, and a later step of it begins anew.

Defined results: steps that come after the watermark has passed them are left out, by Spark; steps of equal time go by their number; a null flag is off, a null measure zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from candela.operators.telemetry import TRAILING_RULES, ZERO_GRADIENT
from candela.sources.shared import fresh_folder

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def report_row(place: int, streak: int, last: list[tuple], means: int, flags: list[str]) -> tuple:
    """(place, n, means, counts of flags, streak, warnings) of the last steps, each (measures..., flags...)."""
    n = len(last)
    counts = {f: sum(bool(x[means + i]) for x in last) for i, f in enumerate(flags)}
    warnings = [name for name, flag, share, at_least in TRAILING_RULES if flag in counts and (counts[flag] >= share * n if at_least else counts[flag] > share * n)]
    warnings += ["ZERO_GRAD"] if streak >= ZERO_GRADIENT else []
    return (place, n, *[sum(x[i] for x in last) / n for i in range(means)], *counts.values(), streak, warnings)


class TrailingReport(StatefulProcessor):
    """Reports of each run at every ``every``-th step; ``streak`` names the flag whose steps in a row are counted."""

    def __init__(self, step: str, ts: str, means: list[str], flags: list[str], streak: str, size: int = 10, every: int = 10, forget_ms: int = 7 * 86_400_000):
        self.step, self.ts, self.means, self.flags, self.streak = step, ts, means, flags, streak
        self.size, self.every, self.forget_ms = size, every, forget_ms

    def init(self, handle) -> None:
        values = ", ".join([*[f"m{i} double" for i in range(len(self.means))], *[f"f{i} boolean" for i in range(len(self.flags))]])
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, step long, on boolean, {values}")
        self.last = handle.getListState("last", values)
        self.numbers = handle.getValueState("numbers", "place long, streak long, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            us = part[self.ts].astype("datetime64[us]").astype("int64").tolist()
            columns = [part[m].fillna(0.0).astype(float).tolist() for m in self.means] + [part[f].fillna(False).astype(bool).tolist() for f in self.flags]
            self.waiting.appendList(list(zip(us, part[self.step].astype("int64").tolist(), part[self.streak].fillna(False).astype(bool).tolist(), *columns)))
            first = min([*us, *([] if first is None else [first])])
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted(r for r in rows if r[0] // 1000 <= now), [r for r in rows if r[0] // 1000 > now]
        place, streak, at = self.numbers.get() if self.numbers.exists() else (0, 0, None)
        last = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        out = []
        for us, step, on, *values in due:
            if at is not None and us - at > self.forget_ms * 1000:
                place, streak, last = 0, 0, []
            place, streak, at, last = place + 1, streak + 1 if on else 0, us, [*last, tuple(values)][-self.size:]
            if place % self.every == 0:
                out.append((key[0], step, *report_row(place, streak, last, len(self.means), self.flags)))
        if due:
            self.numbers.update((place, streak, at))
            self.last.put(last)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(later)[0] // 1000)
        else:
            self.waiting.clear()
            if at is not None and at // 1000 + self.forget_ms < now:
                self.numbers.clear()
                self.last.clear()
            elif at is not None:
                self.handle.registerTimer(at // 1000 + self.forget_ms + 1)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def trailing_reports(steps: DataFrame, run: str, step: str, ts: str, means: list[str], flags: list[str], streak: str, late: str = "10 minutes", **how) -> DataFrame:
    """(run, step, place, n, trailing means, counts of flags, streak, warnings) at every tenth step of each run of a stream."""
    kind = steps.schema[run].dataType.simpleString()
    rows = steps.select(run, step, F.col(ts).cast("timestamp").alias("event_time"), *dict.fromkeys([*means, *flags, streak])).withWatermark("event_time", late)
    schema = ", ".join([f"{run} {kind}, {step} long, place long, n long", *[f"trailing_{m} double" for m in means], *[f"n_{f} long" for f in flags], "streak long, warnings array<string>"])
    return rows.groupBy(run).transformWithStateInPandas(TrailingReport(step, "event_time", means, flags, streak, **how), schema, "append", "eventTime", eventTimeColumnName="")


def arrivals(events: DataFrame, ts: str, late, slices: int = 3) -> list[DataFrame]:
    """Rows as they come: slices of equal spans of event time; rows of ``late`` come with the last one, whatever their time."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    first, last = events.agg(F.min(us), F.max(us)).first()
    if first is None:
        return [events]
    place = F.least(F.floor((us - first) * slices / F.lit(max(1, last - first))), F.lit(slices - 1))
    place = F.when(late, slices - 1).otherwise(place)
    return [events.where(place == i) for i in range(slices)]


def replayed(parts: Iterable[DataFrame], plan: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream gives in append mode while the parts come one after the other; each part is taken by a run of its own, from the checkpoint of the one before.

    Input, output and checkpoint lie in the shared folder; the runs use the state store that keeps its state on disk.
    """
    folder, schema, spark = None, None, None
    for part in parts:
        spark = part.sparkSession
        folder = folder or fresh_folder(spark, name)
        part.write.mode("append").parquet(f"{folder}/in")
        out = plan(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        schema = out.schema
        before = spark.conf.get(_STORE, None)
        spark.conf.set(_STORE, _ROCKS)
        try:
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return spark.read.schema(schema).parquet(f"{folder}/out")
