"""Rows in the order of a number without a sort in one task: ranges of about equal size, numbers of rows, and arithmetic permutations.

Splitters come from quantiles of the column, so ranges hold about as many rows each however the values cluster; the counts
of the ranges, at most MOST of them, tell where each one's numbers begin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; ranges at most.
ROWS = 1_000_000
MOST = 4096


def ranged(df: DataFrame, order: str, blocks: int | None = None, name: str = "_block") -> tuple[DataFrame, int]:
    """``df`` with ``name``, the range of each row by the numeric column ``order``, and the number of ranges.

    A range has its share of the rows to within a tenth, but equal values are never parted; nulls are in the last range.
    """
    blocks = blocks or min(MOST, -(-df.count() // ROWS))
    splits = sorted(set(df.approxQuantile(order, [i / blocks for i in range(1, blocks)], 0.05 / blocks))) if blocks > 1 else []
    if not splits:
        return df.withColumn(name, F.lit(0)), 1
    put = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="_number", outputCol="_bucket", handleInvalid="keep")
    out = put.transform(df.withColumn("_number", F.col(order).cast("double")))
    return out.withColumn(name, F.coalesce(F.col("_bucket").cast("int"), F.lit(len(splits) + 1))).drop("_number", "_bucket"), len(splits) + 2


def ordinals(df: DataFrame, order: str, name: str = "ordinal", blocks: int | None = None) -> DataFrame:
    """``name``: the place of each row, from 0, by ``order``, a numeric column, whatever its gaps and clusters; nulls come last."""
    wanted = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, n = ranged(df, order, max(wanted, min(MOST, -(-df.count() // ROWS))))
    ahead, at = [], 0
    for r in sorted(rows.groupBy("_block").count().collect()):  # n rows at most
        ahead.append((r[0], at))
        at += r[1]
    begin = F.broadcast(df.sparkSession.createDataFrame(ahead, "_at int, _ahead long"))
    placed = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_block").orderBy(F.col(order).asc_nulls_last())))
    return placed.join(begin, F.col("_block") == F.col("_at")).withColumn(name, F.col("_ahead") + F.col("_nth") - 1).drop("_block", "_nth", "_at", "_ahead")


def numbered(df: DataFrame, group: str, key: str, name: str, rows: int = ROWS) -> DataFrame:
    """``name``: the number of each row in its group, from 0, without gaps; a group's rows are numbered in blocks of about ``rows`` by hash of the key, by key within a block."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
    many = sizes.where(F.col("_size") > rows).select(F.col(group).alias("_group"), F.ceil(F.col("_size") / rows).alias("_blocks"))  # fewer than input rows / rows
    dealt = df.join(F.broadcast(many), F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_block", F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("string")), F.col("_blocks")), F.lit(0))).drop("_group", "_blocks")
    counts = dealt.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    ahead = counts.select(F.col(group).alias("_group"), F.col("_block").alias("_at"), (F.sum("_n").over(Window.partitionBy(group).orderBy("_block")) - F.col("_n")).alias("_ahead")).where("_ahead > 0")
    at = F.row_number().over(Window.partitionBy(group, "_block").orderBy(key))
    placed = dealt.withColumn("_nth", at).join(F.broadcast(ahead), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_at")), "left")
    return placed.withColumn(name, F.coalesce("_ahead", F.lit(0)) + F.col("_nth") - 1).drop("_block", "_nth", "_group", "_at", "_ahead")


# -- permutations by arithmetic --------------------------------------------------------------

# A prime below 2^31, so that squares stay below 2^62; shift of the square; rounds of the permutation.
PRIME, SHIFT, SWAPS = 2147483647, 1234567, 24


def mixed(*numbers: Column | int) -> Column:
    """A number from 0 to PRIME - 1 that depends on all the (non-negative) numbers: squares and sums modulo PRIME."""
    out = F.lit(SHIFT).cast("bigint")
    for x in numbers:
        x = (F.lit(x) if isinstance(x, int) else x).cast("bigint")
        y = (out + x % PRIME + F.lit(7919) * (((x - x % PRIME) / F.lit(PRIME)).cast("bigint") % PRIME)) % PRIME
        out = (y * y + SHIFT) % PRIME
    return out


def permuted(place: Column, size: Column, own: Column) -> Column:
    """Where ``place`` goes in the permutation of 0 to size - 1 that ``own``, a number below PRIME in a column, picks.

    Each round pairs x with k - x modulo the size, and a bit that both of a pair have in common says whether they change places;
    so every round, and all of them, are one to one at any size, and no row is read to find where one goes.
    """
    def swap(x: Column, i: Column) -> Column:
        k = (own * (2 * i + 3) % PRIME * 48271 + i * 7919) % PRIME
        mirror = F.pmod(k % size - x, size)
        high = F.greatest(x, mirror)
        factor = F.lit(1) + (own * (2 * i + 5) + (i + 1) * 104729) % (PRIME - 1)
        hashed = (factor * (high % PRIME) + k) % PRIME
        return F.when(F.floor(hashed / F.lit(64)) % 2 == 1, mirror).otherwise(x)
    return F.reduce(F.sequence(F.lit(0), F.lit(SWAPS - 1)), place.cast("bigint"), lambda x, i: swap(x, i.cast("bigint")))


def permuted_in_batches(place: Column, size: Column, own: Column) -> Column:
    """``permuted`` of columns without nulls, a round for a whole batch at a time; the fold is interpreted row by row."""
    def rounds(x: pd.Series, n: pd.Series, o: pd.Series) -> pd.Series:
        x, n, o = (np.asarray(c, dtype=np.int64) for c in (x, n, o))
        for i in range(SWAPS):
            k = (o * (2 * i + 3) % PRIME * 48271 + i * 7919) % PRIME
            mirror = (k % n - x) % n
            factor = 1 + (o * (2 * i + 5) + (i + 1) * 104729) % (PRIME - 1)
            hashed = (factor * (np.maximum(x, mirror) % PRIME) + k) % PRIME
            x = np.where(hashed // 64 % 2 == 1, mirror, x)
        return pd.Series(x)
    return F.pandas_udf(rounds, "bigint")(place, size, own)


def permuted_sql(place: str, size: str, own: str) -> str:
    """``permuted`` in SQL."""
    k = f"(({own} * (2 * i + 3) % {PRIME} * 48271 + i * 7919) % {PRIME})"
    mirror = f"((({k} % {size} - x) % {size} + {size}) % {size})"
    hashed = f"(((1 + ({own} * (2 * i + 5) + (i + 1) * 104729) % ({PRIME} - 1)) * (greatest(x, {mirror}) % {PRIME}) + {k}) % {PRIME})"
    return f"list_reduce(range({SWAPS}), lambda x, i: CASE WHEN {hashed} // 64 % 2 = 1 THEN {mirror} ELSE x END, CAST({place} AS BIGINT))"


def mixed_sql(*numbers: str | int) -> str:
    """``mixed`` in SQL."""
    out = f"CAST({SHIFT} AS BIGINT)"
    for x in numbers:
        y = f"(({out} + CAST({x} AS BIGINT) % {PRIME} + 7919 * (CAST({x} AS BIGINT) // {PRIME} % {PRIME})) % {PRIME})"
        out = f"(({y} * {y} + {SHIFT}) % {PRIME})"
    return out
