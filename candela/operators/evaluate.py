"""Strategies that pick a candidate per group, compared with baselines over subsets of groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.stats import number
from candela.operators.groups import best_rows


def strategy_eval(df: DataFrame, group: str, score: Column, order: str, correct: str, task: str) -> DataFrame:
    """(dim, key, total, correct, accuracy) of the best rows, overall and by task; groups without a valid score don't count."""
    best = best_rows(df, group, score, order)
    out = best.rollup(task).agg(F.grouping(task).alias("_all"), F.count("*").alias("total"), F.count_if(F.coalesce(F.col(correct), F.lit(False))).alias("correct"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise("task").alias("dim"), F.when(F.col("_all") == 0, F.col(task)).alias("key"), "total", "correct", (F.col("correct") / F.col("total")).alias("accuracy"))


def baselines(df: DataFrame, group: str, order: str, correct: str, task: str) -> DataFrame:
    """(dim, key, total, random, top1, oracle): expected, first and possible right answers per dimension.

    ``random`` is the exact expectation of a random pick, the sum of the groups' shares of right candidates.
    """
    right = F.coalesce(F.col(correct), F.lit(False))
    per = df.groupBy(group).agg(F.min_by(task, order).alias("task"), F.avg(right.cast("int")).alias("random"), F.max(right).cast("int").alias("oracle"),
                                F.min_by(right, F.struct(F.when(F.col("candidate_id") == 0, 0).otherwise(1), F.col(order))).cast("int").alias("top1"))
    out = per.rollup("task").agg(F.grouping("task").alias("_all"), F.count("*").alias("total"), F.sum("random").alias("random"), F.sum("top1").alias("top1"), F.sum("oracle").alias("oracle"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise("task").alias("dim"), F.when(F.col("_all") == 0, F.col("task")).alias("key"), "total", "random", "top1", "oracle")


def win_loss(a: DataFrame, b: DataFrame, group: str, correct: str, subset: DataFrame | None = None) -> DataFrame:
    """One row: wins, losses and ties of a against b over the groups that both have, within ``subset``."""
    left = a.select(group, F.coalesce(F.col(correct), F.lit(False)).alias("_a"))
    both = left.join(b.select(group, F.coalesce(F.col(correct), F.lit(False)).alias("_b")), group)
    if subset is not None:
        both = both.join(subset.select(group), group, "left_semi")
    return both.agg(F.count_if(F.col("_a") & ~F.col("_b")).alias("n_win"), F.count_if(~F.col("_a") & F.col("_b")).alias("n_loss"), F.count_if(F.col("_a") == F.col("_b")).alias("n_tie"))


def unpivoted(df: DataFrame, keep: list[str], scores: list[str]) -> DataFrame:
    """One row per row and score: keep, reward (its name), value (double, null for NaN)."""
    pairs = ", ".join(f"'{s}', `{s}`" for s in scores)
    doubles = df.select(*keep, *[number(F.col(s)).alias(s) for s in scores])
    return doubles.select(*keep, F.expr(f"stack({len(scores)}, {pairs}) as (reward, value)"))


def degeneracy(df: DataFrame, group: str, order: str, scores: list[str], candidate: str = "candidate_id") -> DataFrame:
    """Per reward: how often it varies in a group, and picks another than candidate 0 or the first row; groups of two valid scores count."""
    keep = df.select(group, candidate, order, F.min(order).over(Window.partitionBy(group)).alias("_first"), *scores)
    long = unpivoted(keep, [group, candidate, order, "_first"], scores).where("value is not null")
    best = F.max_by(F.struct(F.col(candidate).alias("c"), (F.col(order) == F.col("_first")).alias("first")), F.struct("value", -F.col(order)))
    per = long.groupBy("reward", group).agg(F.count("*").alias("n"), (F.max("value") - F.min("value") > 1e-9).alias("varies"), best.alias("best")).where("n >= 2")
    out = per.groupBy("reward").agg(F.avg(F.col("varies").cast("int")).alias("nonconstant_rate"), F.avg(F.coalesce(F.col("best.c") != 0, F.lit(False)).cast("int")).alias("winner_not_candidate0_rate"),
                                    F.avg((~F.col("best.first")).cast("int")).alias("winner_not_first_record_rate"), F.count("*").alias("n_groups"))
    return out.withColumn("is_degenerate", (F.col("nonconstant_rate") < 0.3) & (F.col("winner_not_candidate0_rate") < 0.1))


def all_degenerate(per_reward: DataFrame) -> DataFrame:
    """One row: rewards, how many are degenerate, and whether all are (false of none)."""
    return per_reward.agg(F.count("*").alias("rewards"), F.count_if("is_degenerate").alias("degenerate"), F.coalesce(F.bool_and("is_degenerate"), F.lit(False)).alias("all_degenerate"))


def inconsistencies(scored: DataFrame, candidates: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """Scored rows without a candidate, or that differ from it in a field: keys, missing, differs (field names). Of repeated candidates the last counts."""
    right = candidates.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_c"))
    left = scored.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).select(*keys, F.struct(*fields).alias("_s"))
    both = left.join(right, keys, "left")
    differs = F.array_compact(F.array(*[F.when(~F.col("_s")[f].eqNullSafe(F.col("_c")[f]), f) for f in fields]))
    return both.select(*keys, F.col("_c").isNull().alias("missing"), F.when(F.col("_c").isNotNull(), differs).otherwise(F.array().cast("array<string>")).alias("differs")).where(F.col("missing") | (F.size("differs") > 0))


def recount(selected: DataFrame, results: DataFrame, strategy: str = "strategy", tolerance: float = 1e-4) -> DataFrame:
    """Strategies whose accuracy, counted again from the selected rows, is not that of the results."""
    again = selected.groupBy(strategy).agg(F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("int")).alias("again"))
    return again.join(results.select(strategy, "accuracy"), strategy).where(F.abs(F.col("again") - F.col("accuracy")) > tolerance)


def mode_comparison(results: DataFrame, base: str, *modes: str) -> DataFrame:
    """One row: accuracy of each mode, gains over ``base``, and whether no gain is positive."""
    wide = results.where(F.col("strategy").isin(base, *modes)).groupBy().agg(*[F.max(F.when(F.col("strategy") == m, F.col("accuracy"))).alias(m) for m in (base, *modes)])
    gains = [(F.col(m) - F.col(base)).alias(f"gain_{m}") for m in modes]
    return wide.select("*", *gains, (F.greatest(*[F.col(m) - F.col(base) for m in modes], F.lit(-1.0)) <= 0).alias("no_advantage"))


def candidates_per_group(df: DataFrame, group: str) -> DataFrame:
    """One row: smallest, largest, mean and upper median number of candidates.

    The upper median is read from the counts of counts, which are few whatever the number of groups.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))
    all_ = F.array_sort(F.collect_list(F.struct("n", "groups")))
    at = F.floor(F.sum("groups") / 2)
    ends = F.transform(all_, lambda _, i: F.aggregate(F.slice(all_, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["groups"]))
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.sum(F.col("n") * F.col("groups")) / F.sum("groups")).alias("mean"), all_.alias("a"), at.alias("at"), ends.alias("e")).select(
        "least", "most", "mean", F.get(F.filter(F.zip_with("a", "e", lambda a, e: F.when(e > F.col("at"), a["n"])), lambda v: v.isNotNull()), F.lit(0)).alias("upper_median"))
