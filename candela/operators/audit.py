"""Audits of scores: correlation with length, label gaps, spread by dimension, lift of the upper quartile, style buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.stats import mean, pearson, rate, sample_std
from candela.operators.evaluate import unpivoted


def length_correlation(df: DataFrame, scores: list[str], length: str) -> DataFrame:
    """(reward, n, correlation) with the length."""
    long = unpivoted(df, [length], scores)
    return long.groupBy("reward").agg(F.count("value").alias("n"), pearson(F.col("value"), F.col(length)).alias("correlation"))


def label_gap(df: DataFrame, scores: list[str], label: Column) -> DataFrame:
    """(reward, mean_yes, n_yes, mean_no, n_no, gap) between rows labelled yes and no."""
    long = unpivoted(df.withColumn("_label", label), ["_label"], scores)
    yes, no = F.when(F.col("_label") == "yes", F.col("value")), F.when(F.col("_label") == "no", F.col("value"))
    return long.groupBy("reward").agg(F.avg(yes).alias("mean_yes"), F.count(yes).alias("n_yes"), F.avg(no).alias("mean_no"), F.count(no).alias("n_no"), (F.avg(yes) - F.avg(no)).alias("gap"))


def by_dimension(df: DataFrame, scores: list[str], dim: str) -> DataFrame:
    long = unpivoted(df, [dim], scores)
    return long.groupBy("reward", dim).agg(mean(F.col("value")).alias("mean"), sample_std(F.col("value")).alias("std"), F.count("value").alias("n"))


def quartile_lift(df: DataFrame, scores: list[str], correct: str, order: str, least: int = 10) -> DataFrame:
    """(reward, n, top_accuracy, bottom_accuracy, lift): the first and last n div 4 rows by descending score, ties in order.

    The places are those of a sort over all rows of a reward: ranks come from a range partitioning, in two levels:
    rows are numbered within ``buckets`` of the score, and moved by the rows of the buckets above.
    """
    long = unpivoted(df.withColumn("_right", F.coalesce(F.col(correct), F.lit(False)).cast("int")), ["_right", order], scores).where("value is not null")
    bounds = long.groupBy("reward").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least)
    width = F.greatest((F.col("hi") - F.col("lo")) / 256, F.lit(1e-300))
    dealt = long.join(F.broadcast(bounds), "reward").withColumn("b", F.least(F.floor((F.col("hi") - F.col("value")) / width), F.lit(255)).cast("int"))
    per = dealt.groupBy("reward", "b").agg(F.count("*").alias("rows"), F.sum("_right").alias("right"))
    ahead = per.withColumn("ahead", F.sum("rows").over(Window.partitionBy("reward").orderBy("b")) - F.col("rows"))  # 256 rows a reward
    quarter = F.expr("n div 4")
    known = dealt.join(F.broadcast(ahead.select("reward", "b", "ahead", "rows")), ["reward", "b"])
    # only the buckets that a border cuts need the places of their rows
    cut = ((F.col("ahead") < quarter) & (F.col("ahead") + F.col("rows") > quarter)) | ((F.col("ahead") < F.col("n") - quarter) & (F.col("ahead") + F.col("rows") > F.col("n") - quarter))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("reward", "b").orderBy(F.col("value").desc(), order))
    inside = known.where(cut).withColumn("place", place)
    whole = known.where(~cut).withColumn("place", F.when(F.col("ahead") < quarter, 1).when(F.col("ahead") >= F.col("n") - quarter, F.col("n")).otherwise(quarter + 1))
    rows = inside.unionByName(whole)
    top, bottom = F.col("place") <= quarter, F.col("place") > F.col("n") - quarter
    out = rows.groupBy("reward").agg(F.max("n").alias("n"), F.avg(F.when(top, F.col("_right"))).alias("top_accuracy"), F.avg(F.when(bottom, F.col("_right"))).alias("bottom_accuracy"))
    return out.withColumn("lift", F.col("top_accuracy") - F.col("bottom_accuracy"))


def lift_warnings(lifts: DataFrame) -> DataFrame:
    """One row: names of rewards whose lift is negative, and below -0.05."""
    def names(c: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(c, F.col("reward"))))
    return lifts.agg(names(F.col("lift") < 0).alias("negative"), names(F.col("lift") <= -0.05).alias("strong"))


def style_buckets(df: DataFrame, scores: list[str], flags: list[str], correct: str) -> DataFrame:
    """(reward, flag, n and mean and share right of rows with and without the flag)."""
    base = df.select(*scores, F.coalesce(F.col(correct), F.lit(False)).cast("int").alias("_right"), F.map_from_entries(F.array(*[F.struct(F.lit(f), F.coalesce(F.col(f), F.lit(False))) for f in flags])).alias("_flags"))
    long = unpivoted(base.select("*", F.explode("_flags").alias("flag", "on")), ["_right", "flag", "on"], scores)
    on, off = F.col("on"), ~F.col("on")
    return long.groupBy("reward", "flag").agg(
        F.count_if(on).alias("n_on"), F.count_if(off).alias("n_off"), F.avg(F.when(on, F.col("value"))).alias("mean_on"), F.avg(F.when(off, F.col("value"))).alias("mean_off"),
        F.avg(F.when(on, F.col("_right"))).alias("right_on"), F.avg(F.when(off, F.col("_right"))).alias("right_off"))


def family_telemetry(df: DataFrame, family: str, length: str, **flags: Column) -> DataFrame:
    return df.groupBy(family).agg(F.count("*").alias("n"), F.avg(F.col(length).cast("double")).alias("avg_length"), *[rate(c).alias(f"{n}_rate") for n, c in flags.items()])


def field_coverage(df: DataFrame, fields: list[str], status: str | None = None) -> DataFrame:
    """(field, present, finite, finite_rate, active) of every field: active fields have a finite value somewhere."""
    long = df.select(F.expr("stack(%d, %s) as (field, raw)" % (len(fields), ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields))))
    d = F.col("raw").try_cast("double")
    fine = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return long.groupBy("field").agg(F.count("raw").alias("present"), F.count_if(fine).alias("finite"), rate(fine).alias("finite_rate"), F.coalesce(F.max(fine), F.lit(False)).alias("active"))


def record_status(fields: list[str], backend_known: Column) -> Column:
    """error is told elsewhere; here: unknown_backend, not_computed, finite_ok, partial_finite, all_nan."""
    present = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    fine = sum((F.coalesce(~F.isnan(F.col(f)) & (F.abs(F.col(f)) != float("inf")), F.lit(False)).cast("int") for f in fields), F.lit(0))
    return F.when(~backend_known, "unknown_backend").when(present == 0, "not_computed").when(fine == len(fields), "finite_ok").when(fine > 0, "partial_finite").otherwise("all_nan")
