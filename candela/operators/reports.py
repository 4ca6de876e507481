"""Whole reports of a run: strategies and baselines over subsets, tasks, families and behaviours, pairs of strategies, and step diagnostics.

The candidates are shuffled once, by group: one aggregate gives a group's facts and its winner under every score. All tables are sums over
these rows, a few to a group, and combine before their own small shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.stats import number
from candela.functions.text import norm

# Behaviours that a strategy's table counts; subsets of the groups.
BEHAVIORS = ("correct_positive", "correct_negative", "miss", "hallucination")
SUBSETS = {"": None, "informative_": "informative", "strong_informative_": "strong", "top1_wrong_but_oracle_right_": "top1_wrong_oracle_right"}


def outcomes(df: DataFrame, group: str, order: str, strategies: dict[str, tuple[str, str]], base: str | None = None, raw_text: str = "raw_text", candidate: str = "candidate_id") -> DataFrame:
    """A row for each group and strategy that has a winner there, and for the baselines random, top1 and oracle.

    ``strategies``: name to (score, pool).  Candidates have correct, and may have behavior, task, family, answer_length and is_yesno.  ``value``: whether the winner is
    right (for random, the share of right candidates); task and family of a baseline are those of the group's first row; ``first_right`` and ``base_right``: whether top1 and the winner of ``base`` are.
    """
    lacking = {"behavior": "string", "task": "string", "family": "string", "answer_length": "bigint", "is_yesno": "boolean"}
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in lacking.items() if c not in df.columns})
    right = F.coalesce(F.col("correct"), F.lit(False))
    winner = F.struct(right.alias("right"), "behavior", "task", "family", "answer_length", F.coalesce(F.col("is_yesno"), F.lit(False)).alias("is_yesno"))
    text = F.nullif(norm(F.col(raw_text)), F.lit(""))

    def best(score: str) -> Column:
        value = number(F.col(score))
        return F.max_by(winner, F.when(value.isNotNull(), F.struct(value, -F.col(order))))

    first = F.struct(F.when(F.col(candidate) == 0, 0).otherwise(1), F.col(order))
    per = df.groupBy(group).agg(
        *[best(score).alias(f"w_{i}") for i, (score, _) in enumerate(strategies.values())], F.min_by(F.struct("task", "family"), order).alias("of"),
        F.avg(right.cast("int")).alias("share"), F.min_by(right, first).alias("first_right"), F.max(right).alias("some"), F.min(right).alias("every"), (F.min(text) < F.max(text)).alias("varied"))
    informative = F.coalesce(F.col("varied"), F.lit(False))
    per = per.withColumns({"informative": informative, "strong": informative & F.col("some") & ~F.col("every"), "top1_wrong_oracle_right": ~F.col("first_right") & F.col("some")})
    base_at = list(strategies).index(base) if base else None
    base_right = F.lit(None).cast("boolean") if base_at is None else F.col(f"w_{base_at}.right")

    def row(name: str, pool: str, value: Column, behavior: Column, task: Column, family: Column, length: Column, yesno: Column) -> Column:
        return F.struct(F.lit(name).alias("strategy"), F.lit(pool).alias("pool"), value.cast("double").alias("value"), behavior.cast("string").alias("behavior"), task.alias("task"), family.alias("family"), length.cast("bigint").alias("answer_length"), yesno.cast("boolean").alias("is_yesno"))

    none, of = F.lit(None), F.col("of")
    rows = [row(n, "baseline", v, none, of["task"], of["family"], none, none) for n, v in (("random", F.col("share")), ("top1", F.col("first_right").cast("int")), ("oracle", F.col("some").cast("int")))]
    for i, (name, (_, pool)) in enumerate(strategies.items()):
        w = F.col(f"w_{i}")
        rows.append(F.when(w.isNotNull(), row(name, pool, w["right"].cast("int"), w["behavior"], w["task"], w["family"], w["answer_length"], w["is_yesno"])))
    long = per.select(group, "informative", "strong", "top1_wrong_oracle_right", "first_right", base_right.alias("base_right"), F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return long.select(group, "informative", "strong", "top1_wrong_oracle_right", "first_right", "base_right", "r.*")


def strategy_table(long: DataFrame) -> DataFrame:
    """The 20 columns of a run's table: accuracy, right and all groups over each subset, mean length, share of yes/no answers, behaviours; the last six null for baselines."""
    figures = []
    for prefix, subset in SUBSETS.items():
        value = F.col("value") if subset is None else F.when(F.col(subset), F.col("value"))
        figures += [F.avg(value).alias(f"{prefix}accuracy"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{prefix}correct"), F.count(value).alias(f"{prefix}total")]
    own = F.first("pool") != "baseline"
    figures += [F.avg("answer_length").alias("avg_answer_length"), F.avg(F.col("is_yesno").cast("int")).alias("yesno_ratio"), *[F.when(own, F.count_if(F.col("behavior") == b)).alias(b) for b in BEHAVIORS]]
    return long.groupBy("strategy", "pool").agg(*figures)


def breakdown(long: DataFrame) -> DataFrame:
    """(strategy, pool, dim, key, accuracy, correct, total) by task, family and behaviour, and in all; behaviours of strategies alone."""
    dims = ("task", "family", "behavior")
    sums = long.groupingSets([["strategy", "pool"], *[["strategy", "pool", d] for d in dims]], "strategy", "pool", *dims).agg(
        *[F.grouping(d).alias(f"_{d}") for d in dims], F.avg("value").alias("accuracy"), F.sum("value").alias("correct"), F.count("*").alias("total"))
    dim, key = F.lit("all"), F.lit(None).cast("string")
    for d in dims:
        dim, key = F.when(F.col(f"_{d}") == 0, d).otherwise(dim), F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(key)
    out = sums.select("strategy", "pool", dim.alias("dim"), key.alias("key"), "accuracy", "correct", "total")
    return out.where("not (dim = 'behavior' and pool = 'baseline')")


def taskwise_table(long: DataFrame, pool: str = "verifier") -> DataFrame:
    """(strategy, task, accuracy, correct, total) of the baselines and of one pool."""
    return breakdown(long.where(F.col("pool").isin("baseline", pool))).where("dim = 'task'").select("strategy", F.col("key").alias("task"), "accuracy", "correct", "total")


def mode_table(table: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Rows of a strategy table for reward modes: name of the mode to its strategy."""
    named = F.create_map(*[F.lit(x) for mode, s in modes.items() for x in (s, mode)])
    columns = [f"{p}{c}" for p in ("", "informative_") for c in ("accuracy", "correct", "total")]
    return table.where(F.col("strategy").isin(*modes.values())).select(F.try_element_at(named, F.col("strategy")).alias("reward_mode"), "strategy", *columns, "strong_informative_accuracy")


def pairwise(long: DataFrame, base: str, pool: str = "verifier") -> DataFrame:
    """(strategy, subset, against, n_win, n_loss, n_tie) of the pool's strategies against top1 and the base, over all groups and the informative ones that both have."""
    mine = long.where(F.col("pool") == pool)
    other = F.array(F.struct(F.lit("top1").alias("against"), F.col("first_right").alias("theirs")), F.when(F.col("strategy") != base, F.struct(F.lit(base).alias("against"), F.col("base_right").alias("theirs"))))
    subset = F.when(F.col("informative"), F.array(F.lit("overall"), F.lit("informative"))).otherwise(F.array(F.lit("overall")))
    rows = mine.select("strategy", (F.col("value") > 0).alias("own"), F.explode(subset).alias("subset"), other.alias("o")).select("strategy", "own", "subset", F.explode(F.array_compact("o")).alias("o")).where("o.theirs is not null")
    theirs = F.col("o.theirs")
    return rows.groupBy("strategy", "subset", F.col("o.against").alias("against")).agg(F.count_if(F.col("own") & ~theirs).alias("n_win"), F.count_if(~F.col("own") & theirs).alias("n_loss"), F.count_if(F.col("own") == theirs).alias("n_tie"))


# -- step diagnostics ------------------------------------------------------------------------------

# Figures of a step log and the metric each is made of: rates of flags, and means, where a metric that is absent is 0.
RATES = {
    "exact_match_group_rate": "exact_match_all", "final_answer_identical_group_rate": "final_answer_identical", "parse_identical_group_rate": "parse_identical",
    "correctness_identical_group_rate": "correctness_identical", "raw_delta_identical_group_rate": "raw_delta_identical", "score_base_identical_group_rate": "score_base_identical",
    "pre_kl_reward_identical_group_rate": "pre_kl_reward_identical", "final_reward_identical_group_rate": "final_reward_identical",
    "same_final_answer_diff_raw_reward_group_rate": "same_final_answer_diff_raw_reward", "same_final_answer_diff_final_reward_group_rate": "same_final_answer_diff_final_reward",
    "used_zero_variance_fallback_rate": "used_zero_variance_fallback", "raw_reward_identical_group_rate": "raw_reward_identical", "reward_contract_ok_rate": "reward_contract_ok",
}
MEANS = {
    "mean_unique_responses_per_group": "n_unique_responses", "mean_unique_final_answers_per_group": "n_unique_final_answers",
    "mean_same_final_answer_diff_raw_reward_pair_rate": "same_final_answer_diff_raw_reward_pair_rate", "mean_same_final_answer_diff_final_reward_pair_rate": "same_final_answer_diff_final_reward_pair_rate",
    "mean_same_final_answer_raw_reward_max_spread": "same_final_answer_raw_reward_max_spread", "mean_same_final_answer_final_reward_max_spread": "same_final_answer_final_reward_max_spread",
    "mean_invalid_final_answer_rate": "invalid_final_answer_rate", "mean_reward_std_within_group": "reward_std_within_group", "mean_raw_reward_std_within_group": "raw_reward_std_within_group",
    "mean_task_aware_correct_rate": "task_aware_correct_rate_within_group", "mean_label_correct_rate": "label_correct_rate_within_group", "mean_negation_rate": "negation_rate",
    "mean_abstention_rate": "abstention_rate", "mean_template_rate": "template_rate", "mean_numeric_short_rate": "numeric_short_rate", "mean_style_penalty": "mean_style_penalty",
    "mean_answer_anchor_reward": "mean_answer_anchor_reward", "mean_hard_template_veto_rate": "hard_template_veto_rate", "mean_raw_reward_length_corr": "raw_reward_length_corr",
    "mean_debiased_reward_length_corr": "debiased_reward_length_corr",
}


def step_diagnostics(steps: DataFrame, by: list[str] = (), error: str = "error") -> DataFrame:
    """All figures of the steps without an error, by the columns ``by``: RATES, MEANS, counts of groups, and the layers at which groups collapse as a map."""
    have = set(steps.columns)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in have else F.lit(False)

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)

    rows = steps.where(F.col(error).isNull()) if error in have else steps
    std = F.col("final_rewards") if "final_rewards" in have else F.array().cast("array<double>")
    own_mean = F.aggregate(std, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(std)
    spread = F.sqrt(F.aggregate(F.transform(std, lambda x: x.cast("double") - own_mean), F.lit(0.0), lambda s, x: s + x * x) / F.size(std))
    layer = F.coalesce(F.col("collapse_layer").cast("string"), F.lit("none")) if "collapse_layer" in have else F.lit("none")
    rows = rows.select(*by, layer.alias("_layer"), F.when(F.coalesce(F.size(std), F.lit(0)) > 0, spread).alias("_spread"), flag("prompt_side_reward_blocked").alias("_blocked"),
                       *[flag(m).alias(f"_f_{m}") for m in dict.fromkeys(RATES.values())], *[value(m).alias(f"_v_{m}") for m in dict.fromkeys(MEANS.values())])
    same_text, same_parse, same_reward, same_raw = (F.col(f"_f_{m}") for m in ("exact_match_all", "parse_identical", "final_reward_identical", "raw_reward_identical"))
    figures = [F.count("*").alias("n_steps"), *[F.avg(F.col(f"_f_{m}").cast("int")).alias(n) for n, m in RATES.items()], *[F.avg(f"_v_{m}").alias(n) for n, m in MEANS.items()],
               F.avg((~same_raw).cast("int")).alias("raw_reward_nonconstant_group_rate"), F.count_if(same_raw).alias("n_groups_raw_reward_identical"), F.bool_or("_blocked").alias("prompt_side_reward_blocked"),
               F.coalesce(F.avg("_spread"), F.lit(0.0)).alias("mean_final_reward_std_within_group"), F.count_if(same_text).alias("n_groups_with_all_same_text"), F.count_if(same_parse & ~same_text).alias("n_groups_with_same_parse_but_diff_text"),
               F.count_if(~same_text & same_reward).alias("n_groups_with_diff_text_but_same_final_reward")]
    layers = rows.groupBy(*by, "_layer").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_layer", "_n")))).alias("collapse_layer_distribution"))  # a row for each layer
    main = rows.groupBy(*by).agg(*figures)
    if not by:
        return main.where("n_steps > 0").join(F.broadcast(layers))
    keys = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    named = layers.select(*[F.col(b).alias(f"_by_{b}") for b in by], "collapse_layer_distribution")
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return main.join(named, on).drop(*[f"_by_{b}" for b in by])


def examples(df: DataFrame, by: list[str], order: list[Column], columns: list[str], n: int = 20) -> DataFrame:
    """The first n rows by ``order`` of each group as ``examples``, an array of structs in order; limits of each group are taken before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_rank", *columns))).alias("_e"))  # n rows a group
    return listed.select(*by, F.transform("_e", lambda e: F.struct(*[e[c].alias(c) for c in columns])).alias("examples"))
