"""Sanity checks over tables of rewards: distributions, comparison of boxes, wording and response probes, preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions import geometry
from candela.functions.stats import pearson, rate


def distribution_check(df: DataFrame, reward: str, tokens: str, area: str) -> DataFrame:
    """One row: moments of the reward, and its correlation with tokens and area (0 with ten rows or fewer)."""
    def corr(c: str, only: Column) -> Column:
        x, y = F.when(only, F.col(reward)), F.when(only, F.col(c).cast("double"))
        return F.when(F.count_if(only) > 10, F.coalesce(pearson(x, y), F.lit(0.0))).otherwise(0.0)
    return df.agg(F.count(reward).alias("n"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.min(reward).alias("least"), F.max(reward).alias("most"), rate(F.col(reward) > 0).alias("positive_rate"),
                  corr(area, F.col(reward).isNotNull()).alias("area_correlation"), corr(tokens, F.col(tokens) > 0).alias("token_correlation"))


def normalised(reward: Column, n: Column) -> tuple[Column, Column, Column]:
    """The reward as it is, over the root of the tokens, and over the log of one more; null without tokens."""
    return reward, F.when(n > 0, reward / F.sqrt(n)), F.when(n > 0, reward / F.log1p(n))


def box_check(df: DataFrame, correct: str, others: list[str], tokens: str) -> DataFrame:
    """(other, form, n, win_rate): how often the reward of the right box beats another's."""
    pairs = ", ".join(f"'{o}', cast(`{o}` as double), cast(`{o}_tokens` as double)" for o in others)
    long = df.select(F.col(correct).cast("double").alias("c"), F.col(tokens).cast("double").alias("ct"), F.expr(f"stack({len(others)}, {pairs}) as (other, o, ot)")).where("o is not null and c is not null")
    c, o = normalised(F.col("c"), F.col("ct")), normalised(F.col("o"), F.col("ot"))
    forms = F.explode(F.array(*[F.struct(F.lit(n).alias("form"), x.alias("c"), y.alias("o")) for n, x, y in zip(("raw", "sqrt", "log"), c, o)]))
    flat = long.select("other", forms.alias("f")).where("f.c is not null and f.o is not null")
    return flat.groupBy("other", F.col("f.form").alias("form")).agg(F.count("*").alias("n"), rate(F.col("f.c") > F.col("f.o")).alias("win_rate"))


def failures(df: DataFrame, correct: str, other: str, key: str, n: int) -> DataFrame:
    """The n rows that the other box beats by most."""
    return df.withColumn("gap", F.col(other) - F.col(correct)).where("gap > 0").orderBy(F.col("gap").desc(), key).limit(n)


def wording_check(real: DataFrame, probes: DataFrame, key: str, reward: str) -> DataFrame:
    """One row: how often the real question's reward beats all probes of its sample."""
    most = probes.groupBy(key).agg(F.max(reward).alias("_most"))
    return real.join(most, key).agg(F.count("*").alias("n"), rate(F.col(reward) > F.col("_most")).alias("beats_all_rate"))


def with_probes(samples: DataFrame, probes: list[tuple[str, str]]) -> DataFrame:
    """Every sample with every probe (group, text): as many rows a sample as there are probes, which are fixed."""
    listed = F.array(*[F.struct(F.lit(g).alias("probe_group"), F.lit(t).alias("probe")) for g, t in probes])
    return samples.withColumn("_probe", F.explode(listed)).select("*", "_probe.*").drop("_probe")


def response_check(df: DataFrame, key: str, group: str, reward: str, good: str, bad: list[str]) -> DataFrame:
    """One row: how often the best good response beats the best of each bad group, and the means of the groups' best."""
    per = df.groupBy(key).agg(F.max(F.when(F.col(group) == good, F.col(reward))).alias(good), *[F.max(F.when(F.col(group) == b, F.col(reward))).alias(b) for b in bad])
    return per.agg(F.count("*").alias("n"), F.avg(good).alias(f"mean_{good}"), *[F.avg(b).alias(f"mean_{b}") for b in bad],
                   *[rate(F.col(good) > F.col(b)).alias(f"beats_{b}_rate") for b in bad])


def preflight(df: DataFrame, group: str, reward: str, answer: str) -> DataFrame:
    """One row: rates over groups, and the reasons not to start (fewer than 0.2 vary, over 0.8 answer alike, mean deviation below 1e-6)."""
    per = df.groupBy(group).agg((F.max(reward) - F.min(reward) > 1e-6).alias("varies"), (F.count_distinct(answer) <= 1).alias("alike"), F.stddev_pop(reward).alias("std"))
    out = per.agg(F.count("*").alias("groups"), rate(F.col("varies")).alias("nonconstant_rate"), rate(F.col("alike")).alias("identical_answer_rate"), F.avg("std").alias("mean_std"))
    reasons = F.array_compact(F.array(F.when(F.col("nonconstant_rate") < 0.2, "reward_constant"), F.when(F.col("identical_answer_rate") > 0.8, "answers_collapsed"), F.when(F.col("mean_std") < 1e-6, "no_spread")))
    return out.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def other_in_group(df: DataFrame, group: str, category: str, key: str, usable: Column) -> DataFrame:
    """(key, other): for each row the first usable row (by hash of its key) of the same group and another category.

    The first of each category, and of these the first two of a group, are all that is needed: no pairs are made.
    """
    rank = F.struct(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"))
    firsts = df.where(F.coalesce(usable, F.lit(False))).groupBy(group, category).agg(F.min(rank).alias("r"))
    two = firsts.groupBy(group).agg(F.min(F.struct("r", category)).alias("a"))
    second = firsts.join(two.select(F.col(group).alias("_g"), F.col("a")), F.col(group) == F.col("_g")).where(F.col(category) != F.col(f"a.{category}")).groupBy(group).agg(F.min(F.struct("r", category)).alias("b"))
    both = two.select(group, "a").join(second, group, "left")
    return df.join(both, group).select(key, F.when(F.col(category) != F.col(f"a.{category}"), F.col("a.r.k")).otherwise(F.col("b.r.k")).alias("other")).where("other is not null")


def proposals(samples: DataFrame, key: str, bbox: str, width: str, height: str, k: int) -> DataFrame:
    """One row per region of a sample: kind pos with its box (or the centre), and up to k of kind neg, drawn by the key; with area shares."""
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    first = samples.withColumn("_p", geometry.primary_box(w, h, ("target_bbox", F.col(bbox))))
    boxes = [F.struct(F.lit("pos").alias("kind"), F.lit(0).alias("idx"), F.col("_p.bbox").alias("box"))]
    boxes += [F.struct(F.lit("neg").alias("kind"), F.lit(i).alias("idx"), geometry.negative_box(F.col("_p.bbox"), w, h, F.concat_ws("#", F.col(key).cast("string"), F.lit(i))).alias("box")) for i in range(k)]
    out = first.withColumn("_r", F.explode(F.array(*boxes))).where("_r.box is not null")
    return out.select(key, "_r.kind", "_r.idx", F.col("_r.box").alias("box"), F.col("_p.source").alias("source"), F.col("_p.fallback").alias("fallback"), (F.col("_r.box")[2] * F.col("_r.box")[3] / F.greatest(F.lit(1.0), w * h)).alias("area_fraction"))
