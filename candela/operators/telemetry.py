"""Step logs: rates over runs, trailing windows, streaks, halves, verdicts. A run of any length is scanned in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.stats import pearson, rate
from candela.functions.text import norm
from candela.operators.scans import scanned, trailing_rows


def diagnostics(steps: DataFrame, by: list[str], flags: list[str], means: list[str]) -> DataFrame:
    """Per ``by``: number of steps, a rate for each flag (null: no), a mean for each number (null: 0, NaN stays)."""
    return steps.groupBy(*by).agg(F.count("*").alias("n_steps"), *[rate(F.col(f)).alias(f"{f}_rate") for f in flags], *[F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(f"mean_{m}") for m in means])


def histogram(steps: DataFrame, column: str) -> DataFrame:
    return steps.groupBy(column).agg(F.count("*").alias("n"))


def top_answers(steps: DataFrame, answers: str, order: str, n: int = 20) -> DataFrame:
    """The n most frequent non-empty answers of the arrays ``answers``; ties to the one seen first."""
    one = steps.select(F.col(order).alias("_o"), F.posexplode(F.col(answers)).alias("_p", "_a")).select("_o", "_p", norm(F.col("_a")).alias("answer")).where("answer <> ''")
    per = one.groupBy("answer").agg(F.count("*").alias("n"), F.min(F.struct("_o", "_p")).alias("_first"))
    return per.orderBy(F.col("n").desc(), "_first").limit(n).select("answer", "n")


def yes_rates(steps: DataFrame, parsed: str) -> DataFrame:
    one = steps.select(F.explode(parsed).alias("p"))
    yes, no = F.count_if(F.col("p") == "yes"), F.count_if(F.col("p") == "no")
    return one.agg((yes / F.greatest(yes + no, F.lit(1))).alias("yes_rate"), (no / F.greatest(yes + no, F.lit(1))).alias("no_rate"))


def area_correlation(details: DataFrame, area: str, reward: str) -> DataFrame:
    return details.agg(pearson(F.col(area), F.col(reward)).alias("correlation"))


def trailing(steps: DataFrame, run: str, step: str, columns: list[str], rows: int = 10, every: int = 10, also: list[str] = (), blocks: int | None = None) -> DataFrame:
    """Means over the last ``rows`` steps, at every ``every``-th step of a run; with ``also``, these columns and ``place``, the number of the step in its run."""
    last = trailing_rows(scanned(steps, run, step, blocks=blocks), run, {"n": F.count("*"), **{f"trailing_{c}": F.avg(F.col(c).cast("double")) for c in columns}}, rows)
    out = last.where(F.col("_place") % every == 0).withColumnRenamed("_place", "place")
    return out.select(run, step, *also, *(["place"] if also else []), "n", *[f"trailing_{c}" for c in columns])


# Warnings of the trailing report: flag, share of the last steps, whether the share itself warns; steps in a row without gradient.
TRAILING_RULES = (("IDENTICAL", "identical", 0.8, True), ("VAR_FALLBACK", "fallback", 0.5, False), ("TEXT_REPEAT", "text_same", 0.5, False))
ZERO_GRADIENT = 10


def trailing_report(steps: DataFrame, run: str, step: str, means: list[str], flags: list[str], streak: str, rows: int = 10, every: int = 10) -> DataFrame:
    """``trailing`` with counts of flags, the steps in a row at which the flag ``streak`` holds, and warnings by TRAILING_RULES and ZERO_GRADIENT."""
    marked = streaks(steps, run, step, F.col(streak))
    columns = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in means] + [F.coalesce(F.col(f), F.lit(False)).cast("int").alias(f) for f in flags]
    last = trailing(marked.select(run, step, F.col("streak").alias("_in_a_row"), *columns), run, step, [*means, *flags], rows, every, also=["_in_a_row"])
    counts = {f: F.round(F.col(f"trailing_{f}") * F.col("n")).cast("long") for f in flags}
    n = F.col("n")
    found = [F.when(counts[flag] >= share * n if at_least else counts[flag] > share * n, name) for name, flag, share, at_least in TRAILING_RULES if flag in counts]
    warnings = F.array_compact(F.array(*found, F.when(F.col("_in_a_row") >= ZERO_GRADIENT, "ZERO_GRAD"), F.lit(None).cast("string")))
    return last.select(run, step, "place", "n", *[f"trailing_{m}" for m in means], *[c.alias(f"n_{f}") for f, c in counts.items()], F.col("_in_a_row").alias("streak"), warnings.alias("warnings"))


def streaks(steps: DataFrame, run: str, step: str, flag: Column, blocks: int | None = None) -> DataFrame:
    """``streak``: number of steps in a row, up to this one, at which the flag holds."""
    return scanned(steps, run, step, flag, blocks).select(*steps.columns, F.col("_streak").alias("streak"))


def longest_streaks(steps: DataFrame, run: str, step: str, flag: Column, stop_at: int, blocks: int | None = None) -> DataFrame:
    """Per run: longest streak, and the first step at which it reached ``stop_at``."""
    s = streaks(steps, run, step, flag, blocks)
    return s.groupBy(run).agg(F.max("streak").alias("longest"), F.min(F.when(F.col("streak") >= stop_at, F.col(step))).alias("stop_step"))


def running_rate(steps: DataFrame, run: str, step: str, flag: Column, blocks: int | None = None) -> DataFrame:
    return scanned(steps, run, step, flag, blocks).select(*steps.columns, (F.col("_count") / F.col("_place")).alias("running_rate"))


def halves(steps: DataFrame, run: str, step: str, value: str, least: int = 20, blocks: int | None = None) -> DataFrame:
    """Per run of ``least`` steps: mean of the first n div 2 steps and of the others, and whether the latter doubled."""
    ranked = scanned(steps.select(run, step, value), run, step, blocks=blocks).where(F.col("_n") >= least)
    early = F.col("_place") <= F.expr("_n div 2")

    def exact_mean(of: Column) -> Column:
        # a decimal sum doesn't depend on the order of the rows
        return F.sum(F.when(of, F.col(value).cast("decimal(18,6)"))).cast("double") / F.count_if(of)
    out = ranked.groupBy(run).agg(F.max("_n").alias("n"), exact_mean(early).alias("first_half"), exact_mean(~early).alias("second_half"))
    return out.withColumn("surge", F.col("second_half") > 2 * F.col("first_half"))


# Thresholds of the verdict.
ISSUES = (("final_reward_identical", "final_reward_identical_rate", ">", 0.5), ("no_negative_advantage", "mean_n_negative_advantage", "<", 0.01), ("same_answer_diff_reward", "same_answer_diff_reward_rate", ">", 0.10),
          ("invalid_scope", "mean_invalid_final_answer_rate", ">", 0.05), ("raw_length_correlation", "abs_raw_length_corr", ">", 0.30), ("debiased_length_correlation", "abs_debiased_length_corr", ">", 0.20))


def verdict(facts: DataFrame) -> DataFrame:
    """``issues``: names of the thresholds that a row of facts passes; facts that are absent raise none. ``ok``: no issue."""
    found = [F.when((F.col(c) > limit) if op == ">" else (F.col(c) < limit), name) for name, c, op, limit in ISSUES if c in facts.columns]
    both = [F.when((F.col(c) > 0.40) & (F.col("mean_correct_rate") < 0.10), name) for name, c in (("template_rate", "mean_template_rate"), ("abstention_rate", "mean_abstention_rate")) if c in facts.columns and "mean_correct_rate" in facts.columns]
    extra = [F.when(F.abs(F.col("mean_kl")) < 1e-8, "kl_zero")] if "mean_kl" in facts.columns else []
    extra += [F.when(F.col("surge"), "reward_surge")] if "surge" in facts.columns else []
    issues = F.array_compact(F.array(*found, *both, *extra, F.lit(None).cast("string")))
    return facts.withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)
