"""Groups of candidates: the best of each, subsets of groups, advantages, selection and filling.

A candidate table has one row per candidate; ``group`` names the column that all
candidates of a sample share and ``order`` the one that says which came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.stats import number
from candela.functions.text import norm


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows without an error of any kind; columns that are missing count as null."""
    def col(c: str) -> Column:
        return F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return df.where(col("error").isNull() & col("reward_error").isNull() & (F.coalesce(col("action_logprob_ate_error"), F.lit("")) == "") & ~(F.coalesce(col("reward_record_status"), F.lit("")) == "error"))


def with_group_key(df: DataFrame, key: str = "sample_id", other: str = "index") -> DataFrame:
    """Rows with a key, taken from ``other`` where it is null; rows without either go."""
    return df.withColumn(key, F.coalesce(key, other)).where(F.col(key).isNotNull())


def best_rows(df: DataFrame, group: str, score: Column, order: str) -> DataFrame:
    """The row of the highest score of each group: NaN and null never win, ties go to the first.

    One aggregate per group, combined before the shuffle; no sort of the groups.
    """
    row = F.struct(*df.columns)
    scored = df.select(group, row.alias("_row"), number(score).alias("_score"), F.col(order).alias("_ord")).where("_score is not null")
    return scored.groupBy(group).agg(F.max_by("_row", F.struct("_score", -F.col("_ord"))).alias("_row")).select("_row.*")


def first_rows(df: DataFrame, group: str, order: str, candidate: str = "candidate_id") -> DataFrame:
    """Candidate 0 of each group, else its first row."""
    rank = F.struct(F.when(F.col(candidate) == 0, 0).otherwise(1), F.col(order))
    return df.groupBy(group).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")


def prefer_unduplicated(df: DataFrame, group: str, duplicate: str = "is_duplicate_candidate") -> DataFrame:
    """Rows that are no duplicates; all rows of a group that has only duplicates."""
    dup = F.coalesce(F.col(duplicate), F.lit(False))
    return df.withColumn("_own", F.sum((~dup).cast("int")).over(Window.partitionBy(group))).where((F.col("_own") == 0) | ~dup).drop("_own")


def group_facts(df: DataFrame, group: str, order: str, raw_text: str, correct: str, duplicate: str | None = None) -> DataFrame:
    """One row per group: informative, strong, top1, oracle, top1_wrong_oracle_right.

    Informative: two different texts at least among the preferred rows; strong: also both right and wrong ones.
    """
    dup = F.coalesce(F.col(duplicate), F.lit(False)) if duplicate else F.lit(False)
    right = F.coalesce(F.col(correct), F.lit(False))
    w = Window.partitionBy(group)
    rows = df.withColumn("_use", ~dup | (F.sum((~dup).cast("int")).over(w) == 0))
    text = F.when(F.col("_use"), F.nullif(norm(F.col(raw_text)), F.lit("")))
    first = F.min_by(right, F.struct(F.when(F.col("candidate_id") == 0, 0).otherwise(1), F.col(order)))
    out = rows.groupBy(group).agg(F.count_distinct(text).alias("_texts"), F.max(F.col("_use") & right).alias("oracle"), F.min(~F.col("_use") | right).alias("_all"), first.alias("top1"))
    informative = F.col("_texts") >= 2
    return out.select(group, informative.alias("informative"), (informative & F.col("oracle") & ~F.col("_all")).alias("strong"), "top1", "oracle", (~F.col("top1") & F.col("oracle")).alias("top1_wrong_oracle_right"))


def min_unique_gate(df: DataFrame, group: str, flag: str = "min_unique_satisfied") -> DataFrame:
    """Rows of the groups whose flags are all true; raises if a group has no flag."""
    per = df.groupBy(group).agg(F.bool_and(flag).alias("ok"))
    bare = per.agg(F.count_if(F.col("ok").isNull())).first()[0]
    if bare:
        raise ValueError(f"{bare} groups lack {flag}")
    return df.join(per.where("ok").select(group), group, "left_semi")


def advantages(df: DataFrame, group: str, reward: str, flat: float = 1e-4) -> DataFrame:
    """``advantage``: distance from the group's mean in population deviations; only the distance where these are below ``flat``."""
    w = Window.partitionBy(group)
    away, std = F.col(reward) - F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", F.when(std < flat, away).otherwise(away / std))


def step_metrics(df: DataFrame, group: str, reward: str, answer: str, correct: str, near: float = 1e-9) -> DataFrame:
    """One row per group: size, mean, deviation, spread flags, distinct answers, counts of advantage signs; a reward within ``near`` of the mean, which is rounded, has none."""
    rows = df.withColumn("_away", F.col(reward) - F.avg(reward).over(Window.partitionBy(group)))
    spread = F.max(reward) - F.min(reward)
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(reward).alias("mean_reward"), F.stddev_pop(reward).alias("std_reward"), ((spread < 1e-8) | (F.count("*") < 2)).alias("reward_identical"),
        F.count_distinct(answer).alias("n_answers"), (F.count_distinct(F.col(correct).cast("string")) <= 1).alias("correctness_identical"),
        F.count_if(F.col("_away") > near).alias("n_positive"), F.count_if(F.col("_away") < -near).alias("n_negative"), (F.stddev_pop(reward) < 1e-4).alias("zero_variance_fallback"))


COLLAPSE_LAYERS = ("text/raw_response", "final_answer", "parse", "raw_delta", "score_base", "pre_kl", "final")


def collapse_layer(*flags: Column) -> Column:
    """Name of the first layer whose flag holds, in the order of COLLAPSE_LAYERS; null if none does."""
    return F.coalesce(*[F.when(f, name) for name, f in zip(COLLAPSE_LAYERS, flags)])


def same_answer_spread(df: DataFrame, group: str, answer: Column, reward: str, atol: float = 1e-8) -> DataFrame:
    """Per group: pairs of equal answers, those of answers whose rewards differ, their share, and the largest spread."""
    per = (df.select(group, answer.alias("_a"), reward).where("_a is not null and _a <> ''").groupBy(group, "_a")
           .agg(F.count("*").alias("n"), (F.max(reward) - F.min(reward)).alias("spread")).withColumn("pairs", F.expr("n * (n - 1) div 2")))
    out = per.groupBy(group).agg(F.sum("pairs").alias("pairs"), F.sum(F.when(F.col("spread") > atol, F.col("pairs")).otherwise(0)).alias("different"), F.max(F.when(F.col("n") > 1, F.col("spread")).otherwise(0.0)).alias("max_spread"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("different").cast("double"), F.col("pairs")), F.lit(0.0)))


# -- candidates of a group -----------------------------------------------------------------

def first_occurrences(df: DataFrame, group: str, key: Column, order: str, k: int) -> DataFrame:
    """The first k rows with different keys, in order, numbered from 0; empty keys are one key of their own."""
    named = df.withColumn("_key", F.coalesce(F.nullif(key, F.lit("")), F.lit("__empty__")))
    first = named.groupBy(group, "_key").agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_row"))
    first = first.select([F.col(group) if c == group else F.col("_row")[c].alias(c) for c in df.columns])  # the group's own column, so that its partitions serve the window
    return first.withColumn("candidate_id", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).where(F.col("candidate_id") < k)


def filled(df: DataFrame, group: str, k: int) -> DataFrame:
    """Each group with ``candidate_id`` 0..k-1: missing ones repeat those there are, from the first on, and are flagged."""
    n = F.count("*").over(Window.partitionBy(group))
    slots = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("candidate_id")) | ((i >= F.col("_n")) & (F.pmod(i - F.col("_n"), F.col("_n")) == F.col("candidate_id"))))
    return (df.withColumn("_n", n).withColumn("_slot", F.explode(slots)).withColumn("is_duplicate_candidate", F.col("_slot") >= F.col("_n"))
            .withColumn("source_candidate_id", F.col("candidate_id")).withColumn("candidate_id", F.col("_slot")).drop("_slot").withColumnRenamed("_n", "n_unique_candidates_before_fill"))


def diversity(df: DataFrame, group: str, task: str, key: Column, length: str, is_yesno: Column, duplicate: Column) -> DataFrame:
    """Per group: distinct texts and most frequent text as shares of all rows, and flags of low diversity."""
    base = df.select(group, F.col(task).alias("task"), F.nullif(key, F.lit("")).alias("_k"), F.col(length).alias("_len"), F.coalesce(is_yesno, F.lit(False)).alias("_yn"), F.coalesce(duplicate, F.lit(False)).alias("_dup"))
    texts = base.groupBy(group, "_k").agg(F.count("*").alias("n"), F.min("task").alias("task"), F.sum("_len").alias("len"), F.sum(F.col("_yn").cast("int")).alias("yn"), F.sum(F.col("_dup").cast("int")).alias("dup"))
    known = F.col("_k").isNotNull()
    out = texts.groupBy(group).agg(F.min("task").alias("task"), F.sum("n").alias("n_candidates"), F.count_if(known).alias("n_unique"), F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("mode_count"),
                                   F.sum("len").alias("len"), F.sum("yn").alias("yn"), F.sum("dup").alias("dup"))
    n = F.col("n_candidates")
    return out.select(group, "task", "n_candidates", "n_unique", (F.col("n_unique") / n).alias("unique_ratio"), (F.col("mode_count") / n).alias("mode_fraction"), (F.col("yn") / n).alias("yesno_ratio"),
                      (F.col("len") / n).alias("mean_length"), (F.col("dup") / n).alias("duplicate_rate"), (F.col("n_unique") == 1).alias("all_same"), (F.col("n_unique") / n < 0.5).alias("low_unique_ratio"), (F.col("mode_count") / n > 0.8).alias("high_mode_fraction"))


def diversity_summary(per_group: DataFrame) -> DataFrame:
    """Means, medians and shares of flags by task and in all (task null)."""
    flag = {c: F.avg(F.col(c).cast("int")).alias(f"pct_{c}") for c in ("all_same", "low_unique_ratio", "high_mode_fraction")}
    return per_group.rollup("task").agg(F.count("*").alias("n_groups"), F.avg("unique_ratio").alias("mean_unique_ratio"), F.median("unique_ratio").alias("median_unique_ratio"), *flag.values())


def select_group(df: DataFrame, group: str, order: str, raw: str, final: str, n: int, min_unique: int) -> DataFrame:
    """(group, slot, source): n candidates of each pool, greedily: enough different answers, then new texts,
    new answers, any, and from the start again; ``order`` is different within a pool.

    The choice depends on what was taken before: a fold over the pool, four times in order. What can be taken are
    the first rows of a pool and the first ones with a text or an answer, 2n of each at most; only these are brought together, however large the pool.
    """
    rows = df.select(F.col(group).alias("g"), F.col(order).cast("bigint").alias("at"), F.coalesce(F.col(raw), F.lit("")).alias("raw"), F.coalesce(F.col(final), F.lit("")).alias("final"))
    kinds = [rows] + [rows.where(F.col(c) != "").groupBy("g", c).agg(F.min(F.struct("at", "raw", "final")).alias("r")).select("g", "r.*") for c in ("raw", "final")]
    first = [k.withColumn("_rank", F.row_number().over(Window.partitionBy("g").orderBy("at"))).where(F.col("_rank") <= 2 * n).select("g", F.struct("at", "raw", "final").alias("r")) for k in kinds]
    pools = first[0].unionByName(first[1]).unionByName(first[2]).groupBy("g").agg(F.array_sort(F.collect_set("r")).alias("pool"))

    def step(state: Column, s: Column) -> Column:
        i, p, x = s["i"], s["p"], s["x"]
        taken, raws, finals = state["taken"], state["raws"], state["finals"]
        new_final = (x["final"] != "") & ~F.array_contains(finals, x["final"])
        new_raw = (x["raw"] != "") & ~F.array_contains(raws, x["raw"])
        wanted = F.when(p == 1, new_raw).when(p == 3, F.lit(True)).otherwise(new_final)
        full = (F.size(taken) >= n) | ((p == 0) & (F.size(finals) >= min_unique))
        more = F.struct(F.concat(taken, F.array(i)).alias("taken"), F.when(new_raw, F.concat(raws, F.array(x["raw"]))).otherwise(raws).alias("raws"), F.when(new_final, F.concat(finals, F.array(x["final"]))).otherwise(finals).alias("finals"))
        return F.when(~full & ~F.array_contains(taken, i) & wanted, more).otherwise(state)

    passes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.transform("pool", lambda x, i: F.struct(p.alias("p"), i.alias("i"), x.alias("x")))))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("raws"), F.array().cast("array<string>").alias("finals"))
    chosen = pools.select("g", "pool", F.reduce(passes, start, step)["taken"].alias("taken"))
    slots = chosen.select("g", "pool", "taken", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    at = F.when(F.col("slot") < F.size("taken"), F.get("taken", F.col("slot"))).otherwise(F.col("slot") % F.size("pool"))
    return slots.select(F.col("g").alias(group), "slot", F.get("pool", at)["at"].alias("source"))
