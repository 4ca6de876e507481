"""Joins of intervals and of boxes: bins of the axis turn an overlap into an equality, and each pair is kept in one bin alone.

The width of the bins is a quantile of the intervals' lengths, so most lie in one or two; a long interval has a row in each of its bins.
Ends are exclusive; an interval that is empty or has a null end overlaps nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bin_width(*sides: tuple[DataFrame, str, str], share: float = 0.9) -> float:
    """The longer one of the sides' quantiles of lengths; at least a millionth."""
    found = [df.select((F.col(end) - F.col(start)).cast("double").alias("n")).where("n > 0").approxQuantile("n", [share], 0.01) for df, start, end in sides]
    return max([q[0] for q in found if q] + [1e-6])


def _binned(df: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    """A row for each bin of the interval; an end on a border is outside the bin that begins there."""
    valid = df.where(F.col(start) < F.col(end))
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    last = F.when(last * width >= F.col(end), last - 1).otherwise(last)
    return valid.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: float | None = None) -> DataFrame:
    """Pairs of rows with equal keys whose intervals overlap: keys, left, right (structs of the other columns) and the overlap's start and end."""
    width = width or bin_width((left, start, end), (right, start, end))

    def side(df: DataFrame, name: str) -> DataFrame:
        return _binned(df, start, end, width, "_bin").select(*keys, "_bin", F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    both = side(left, "left").join(side(right, "right"), [*keys, "_bin"])
    lo, hi = F.greatest(F.col(f"left.{start}"), F.col(f"right.{start}")), F.least(F.col(f"left.{end}"), F.col(f"right.{end}"))
    # a pair meets in each bin that both have, and is kept where its overlap begins
    return both.where((lo < hi) & (F.floor(lo / width) == F.col("_bin"))).select(*keys, "left", "right", lo.alias("start"), hi.alias("end"))


def box_overlaps(left: DataFrame, right: DataFrame, keys: list[str], box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), widths: tuple[float, float] | None = None) -> DataFrame:
    """Pairs of rows with equal keys whose boxes overlap: keys, left, right and ``area`` of the overlap; bins on both axes."""
    x1, y1, x2, y2 = box
    wx, wy = widths or (bin_width((left, x1, x2), (right, x1, x2)), bin_width((left, y1, y2), (right, y1, y2)))

    def side(df: DataFrame, name: str) -> DataFrame:
        both = _binned(_binned(df, x1, x2, wx, "_bx"), y1, y2, wy, "_by")
        return both.select(*keys, "_bx", "_by", F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    met = side(left, "left").join(side(right, "right"), [*keys, "_bx", "_by"])
    lo = {a: F.greatest(F.col(f"left.{a}"), F.col(f"right.{a}")) for a in (x1, y1)}
    hi = {a: F.least(F.col(f"left.{a}"), F.col(f"right.{a}")) for a in (x2, y2)}
    here = (F.floor(lo[x1] / wx) == F.col("_bx")) & (F.floor(lo[y1] / wy) == F.col("_by"))
    return met.where((lo[x1] < hi[x2]) & (lo[y1] < hi[y2]) & here).select(*keys, "left", "right", ((hi[x2] - lo[x1]) * (hi[y2] - lo[y1])).alias("area"))


def word_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, start, end) of the parts between single spaces, in characters; empty parts are left out, and places count them."""
    parts = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, " ")).alias("place", "_w")).withColumn("_n", F.length("_w").cast("bigint"))
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_n") + 1).over(w), F.lit(0))
    return parts.select(key, "place", start.alias("start"), "_n").select(key, "place", "start", (F.col("start") + F.col("_n")).alias("end")).where("start < end")
