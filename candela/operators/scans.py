"""Running figures of long runs in blocks: no run is sorted or scanned in one task, however long.

Steps are cut into ranges of their number that hold about as many rows each.  A (run, range) is a block: its rows, steps with a flag,
and the flag's steps in a row at its end are one summary; summaries of the blocks before are put together in a window over a run's
blocks, of which there are few, and what comes out is carried into each block's own window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.operators.ranges import ranged


def scanned(steps: DataFrame, run: str, step: str, flag: Column | None = None, blocks: int | None = None) -> DataFrame:
    """Rows with ``_place``, the number of the step in its run from 1, ``_n``, the run's steps, and of the flag: ``_on``, ``_count`` (steps with it so far) and ``_streak`` (in a row up to this one).

    Rows of one run have different steps.
    """
    on = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    rows, _ = ranged(steps, step, blocks)
    rows = rows.withColumn("_on", on)
    block = Window.partitionBy(run, "_block").orderBy(step)
    until = block.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_nth": F.row_number().over(block), "_inner": F.sum(F.col("_on").cast("long")).over(until)})
    # steps since the last one without the flag
    rows = rows.withColumn("_off", F.max(F.when(~F.col("_on"), F.col("_nth"))).over(until))
    sums = rows.groupBy(run, "_block").agg(F.count("*").alias("_rows"), F.max("_inner").alias("_flagged"), F.max("_off").alias("_last_off"))
    ahead = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
    carried = sums.select(F.col(run).alias("_run"), F.col("_block").alias("_at"), "_before", F.coalesce(F.sum("_flagged").over(ahead), F.lit(0)).alias("_counted"),
                          # where in the run its last step without the flag was, 0 if there was none
                          F.coalesce(F.max(F.col("_before") + F.col("_last_off")).over(ahead), F.lit(0)).alias("_off_before"), F.sum("_rows").over(Window.partitionBy(run)).alias("_n"))
    out = rows.join(carried, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_block") == F.col("_at")))
    place = F.col("_before") + F.col("_nth")
    last_off = F.coalesce(F.col("_before") + F.col("_off"), F.col("_off_before"))
    return out.select(*steps.columns, place.alias("_place"), "_n", "_on", (F.col("_counted") + F.col("_inner")).alias("_count"), F.when(F.col("_on"), place - last_off).otherwise(F.lit(0)).alias("_streak"))


def trailing_rows(placed: DataFrame, run: str, columns: dict[str, Column], rows: int, chunk: int = 1 << 16) -> DataFrame:
    """``placed`` (rows of ``scanned``) with aggregates of the last ``rows`` steps up to each.

    Chunks of places take the last rows of the chunk before along, so each chunk is a window of its own.
    """
    at = F.floor((F.col("_place") - 1) / chunk)
    next_too = (F.col("_place") - 1) % chunk >= chunk - rows + 1
    both = placed.withColumn("_chunk", F.explode(F.when(next_too, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_chunk") == at)
    w = Window.partitionBy(run, "_chunk").orderBy("_place").rowsBetween(1 - rows, 0)
    return both.withColumns({name: c.over(w) for name, c in columns.items()}).where("_own").drop("_chunk", "_own")
