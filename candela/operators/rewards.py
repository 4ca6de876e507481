"""Reward arithmetic: margins, gates, the three main rewards, shaping, penalties, loss; and the registry of rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.text import allows_evidence, answer_score, strip, text


def evidence_margin(interventions: DataFrame, keys: list[str]) -> DataFrame:
    """``s_pos`` and ``margin`` per candidate from one row per forward pass (kind orig, pos or neg; mean_logprob).

    margin = tanh((s_pos - mean of s_neg) / (population deviation of s_neg + 1e-6)); without negatives tanh(s_pos).
    """
    lp = F.col("mean_logprob")
    per = interventions.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "orig", lp)).alias("o"), F.max(F.when(F.col("kind") == "pos", lp)).alias("p"), F.avg(F.when(F.col("kind") == "neg", lp)).alias("m"),
        F.stddev_pop(F.when(F.col("kind") == "neg", lp)).alias("d"), F.count_if(F.col("kind") == "neg").alias("n_negatives"))
    s_pos = F.col("o") - F.col("p")
    # rounding noise counts as zero: over 1e-6 it would be as large as a margin
    away = s_pos - (F.col("o") - F.col("m"))
    away, spread = F.when(F.abs(away) < 1e-12, 0.0).otherwise(away), F.when(F.col("d") < 1e-12, 0.0).otherwise(F.col("d"))
    margin = F.when(F.col("n_negatives") > 0, F.tanh(away / (spread + 1e-6))).otherwise(F.tanh(s_pos))
    return per.select(*keys, "n_negatives", s_pos.alias("s_pos"), margin.alias("margin"))


def evidence_gate(margin: Column, tau: float) -> Column:
    return F.when(margin > 0, 1.0).otherwise(0.0) if tau <= 0 else 0.5 * (1.0 + F.tanh(margin / tau))


def correctness(answer: Column, gold: Column, present: Column, family: Column) -> Column:
    """struct(score, reward, known, correct): 1 for right, -0.25 for wrong, 0 without a gold answer."""
    g = strip(gold)
    g = F.when((g == "") & (family == "existence") & present.isNotNull(), F.when(present, "yes").otherwise("no")).otherwise(g)
    known = g != ""
    score = F.when(known, answer_score(answer, g, family)).otherwise(0.0)
    return F.struct(score.alias("score"), F.when(~known, 0.0).when(score >= 1, 1.0).otherwise(-0.25).alias("reward"), known.alias("known"), F.when(known, score >= 1).alias("correct"))


def main_rewards(reward: Column, margin: Column, family: Column, tau: float, eps: float, mode: str = "routed_gated_evidence") -> Column:
    """struct of the three rewards, the gate, and the one that ``mode`` makes active."""
    on, gate = allows_evidence(family), evidence_gate(margin, tau)
    additive = F.when(on, reward + eps * margin).otherwise(reward)
    routed = F.when(on, reward * gate + eps * margin).otherwise(reward)
    values = {"correctness_only": reward, "additive_evidence": additive, "routed_gated_evidence": routed}
    return F.struct(reward.alias("correctness_only"), additive.alias("additive_evidence"), routed.alias("routed_gated_evidence"), gate.alias("gate"), on.alias("evidence_allowed"),
                    F.when(on | F.lit(mode == "correctness_only"), mode).otherwise("correctness_only").alias("effective_mode"), values.get(mode, routed).alias("active"))


def score_base(margin: Column, answer_margin: Column, tau_resp: float, tau_ans: float, alpha_resp: float, alpha_ans: float) -> Column:
    def squashed(x: Column, tau: float) -> Column:
        return F.tanh(x / tau) if tau > 0 else F.lit(0.0)
    return alpha_resp * squashed(margin, tau_resp) + alpha_ans * squashed(answer_margin, tau_ans)


def soft_shaping(base: Column, correct: Column, parsed: Column, low: float = -2.0, high: float = 2.0) -> Column:
    """struct(reward, bias, scale): a bias by class and a share of the continuous score, clipped."""
    bias = F.when(correct, 0.25).when(~correct & (parsed == "other"), -1.0).when(~correct, -0.6).otherwise(0.0)
    scale = F.when(correct, 0.75).when(~correct & (parsed == "other"), 0.1).when(~correct, 0.2).otherwise(0.25)
    value = bias + scale * F.when(correct, F.greatest(F.lit(0.0), base)).otherwise(base)
    return F.struct(F.least(F.greatest(value, F.lit(low)), F.lit(high)).alias("reward"), bias.alias("bias"), scale.alias("scale"))


def hard_gate(delta: Column, correct: Column, parsed: Column, cap: float, wrong: float, unparseable: float) -> Column:
    kept = F.greatest(F.lit(0.0), F.least(delta, F.lit(cap)))
    return F.when(correct, kept).when(~correct & (parsed == "other"), unparseable).when(~correct, wrong).otherwise(kept * 0.5)


def raw_delta(delta: Column) -> Column:
    return F.when(delta.isNull() | F.isnan(delta), 0.0).otherwise(F.least(F.greatest(delta, F.lit(-10.0)), F.lit(10.0)))


def anchor_gate(v: Column) -> Column:
    """0 up to -0.10, 1 from 0.25, straight between; 0 for what is not finite."""
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.least(F.greatest((v + 0.10) / 0.35, F.lit(0.0)), F.lit(1.0)))


def mixed_reward(family: Column, answer: Column, visual: Column, coefs: dict[str, tuple[float, float]]) -> Column:
    a, v = F.lit(1.0), F.lit(0.0)
    for name, (x, y) in coefs.items():
        a, v = F.when(family == name, x).otherwise(a), F.when(family == name, y).otherwise(v)
    return a * answer + v * visual


def ced_rewards(js: Column, cos: Column, l24: Column, alpha: float, beta: float) -> Column:
    """struct(mix_js, mix_cos): null where either side is null."""
    return F.struct((alpha * js + beta * l24).alias("mix_js"), (alpha * cos + beta * l24).alias("mix_cos"))


def invalid_scope(reward: Column, valid: Column) -> Column:
    return F.when(valid, reward).otherwise(F.least(reward, F.lit(-0.75)))


def hard_veto(reward: Column, veto: Column) -> Column:
    return F.when(veto, F.least(reward - 0.25, F.lit(-0.50))).otherwise(reward)


def final_reward(reward: Column, veto: Column, penalty: Column, lp_policy: Column, lp_ref: Column, kl: float) -> Column:
    """Veto first, then the style penalty, then the divergence from the reference."""
    return hard_veto(reward, veto) - penalty - kl * (lp_policy - lp_ref)


def policy_loss(advantage: Column, logprob: Column, valid: Column) -> Column:
    """Aggregate: mean of -advantage x log-probability of the valid responses; the sum is a decimal one, which no order of the rows changes."""
    return F.sum(F.when(valid, (-advantage * logprob).cast("decimal(38,15)"))).cast("double") / F.count_if(valid)


def effective_backend(family: Column, present: Column, gold: Column) -> Column:
    known = present.isNotNull() | (strip(text(gold)) != "")
    return F.when((family == "existence") & known, "supervised").otherwise("nolabel")


def sampling_settings(family: Column, slot: Column, attempt: Column, temperature: float, top_p: float) -> Column:
    """struct(temperature, top_p) of a candidate slot: hotter for short answers, moved by the slot, clipped."""
    # Moves by slot.
    heat, mass = [0.00, 0.12, -0.06, 0.20, -0.12, 0.28, -0.18, 0.34], [0.00, 0.01, -0.01, 0.02, -0.02, 0.03, -0.03, 0.04]
    short = family.isin("existence", "counting")
    at = F.pmod(slot, F.lit(len(heat)))
    t = F.when(short, max(temperature, 1.10)).otherwise(temperature) + F.get(F.array(*map(F.lit, heat)), at) + 0.10 * attempt
    p = F.when(short, max(top_p, 0.97)).otherwise(top_p) + F.get(F.array(*map(F.lit, mass)), at) + 0.01 * attempt
    return F.struct(F.least(F.greatest(t, F.lit(0.85)), F.lit(1.65)).alias("temperature"), F.least(F.greatest(p, F.lit(0.90)), F.lit(0.995)).alias("top_p"))


# What is known of each reward.
# name: (scope, source, family, whether strategies select by it, its flags, why it is left out of the default pool)
REGISTRY = {
    "reward_logits_js": ("candidate", "ced", "counterfactual", True, {"rerank_eligible", "verifier_eligible", "verifier_only"}, None),
    "reward_logits_cosine_dist": ("candidate", "ced", "counterfactual", True, {"rerank_eligible", "verifier_eligible", "verifier_only"}, None),
    "reward_layer24_prompt_last_cosine": ("sample_probe", "ced", "probe", False, {"diagnostic_only"}, "sample_level_probe"),
    "reward_mix_js_promptlast": ("sample_probe", "derived", "mix", False, {"diagnostic_only"}, "fake_mix_rank_equivalent_when_probe_constant"),
    "reward_mix_cosine_promptlast": ("sample_probe", "derived", "mix", False, {"diagnostic_only"}, "fake_mix_rank_equivalent_when_probe_constant"),
    "reward_action_logprob_ate": ("candidate", "response_conditioned", "action", False, {"uses_ground_truth", "training_only", "response_conditioned", "diagnostic_only"}, "ambiguous_alias_not_for_default_training"),
    "reward_action_logprob_ate_supervised": ("candidate", "response_conditioned", "action", True, {"grpo_eligible", "uses_ground_truth", "training_only", "response_conditioned"}, "label_conditioned_training_reward"),
    "reward_action_logprob_ate_nolabel": ("candidate", "response_conditioned", "action", True, {"grpo_eligible", "training_only", "response_conditioned", "default_training_reward"}, "training_reward_not_verifier"),
    "reward_main_correctness_only": ("candidate", "main_experiment", "task_routed", True, {"rerank_eligible", "verifier_eligible", "grpo_eligible", "uses_ground_truth"}, None),
    "reward_main_additive_evidence": ("candidate", "main_experiment", "task_routed", True, {"rerank_eligible", "verifier_eligible", "grpo_eligible", "uses_ground_truth", "response_conditioned"}, None),
    "reward_main_routed_gated_evidence": ("candidate", "main_experiment", "task_routed", True, {"rerank_eligible", "verifier_eligible", "grpo_eligible", "uses_ground_truth", "response_conditioned", "default_training_reward"}, None),
}
_FLAGS = ("rerank_eligible", "verifier_eligible", "grpo_eligible", "uses_ground_truth", "verifier_only", "training_only", "response_conditioned", "default_training_reward", "diagnostic_only")


def registry(spark: SparkSession, more: dict[str, tuple] | None = None) -> DataFrame:
    """A row per reward; ``more`` registers further ones in the same form."""
    rows = [(n, r[0], r[1], r[2], f"select_by_{n}" if r[3] else None, *[f in r[4] for f in _FLAGS], r[5]) for n, r in {**REGISTRY, **(more or {})}.items()]
    kinds = ", ".join(f"{f} boolean" for f in _FLAGS)
    return spark.createDataFrame(rows, f"name string, scope string, source string, family string, strategy string, {kinds}, exclude_reason string")


def eligible(rewards: DataFrame, flag: str) -> DataFrame:
    """Names and strategies of the rewards with a flag."""
    return rewards.where(F.col(flag)).select("name", "strategy")


def registry_summary(rewards: DataFrame) -> DataFrame:
    """(flag, names): sorted names of the rewards with each flag, and those left out with their reasons."""
    flags = rewards.select(F.expr("stack(%d, %s) as (flag, on, value)" % (len(_FLAGS) + 1, ", ".join([*(f"'{f}', {f}, name" for f in _FLAGS), "'excluded', exclude_reason is not null, concat(name, ': ', exclude_reason)"]))))
    return flags.where("on").groupBy("flag").agg(F.array_sort(F.collect_list("value")).alias("names"))
