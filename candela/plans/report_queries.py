"""Queries of whole reports: strategies over subsets, tasks, families and behaviours, pairs, modes, step diagnostics and examples of failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import reports
from candela.plans.catalog import query, rounded
from candela.plans.tables import CAND, candidates

STRATEGIES = {"select_by_ties": ("score_ties", "verifier"), "select_by_nan": ("score_nan", "verifier"), "select_by_tax": ("score_tax", "verifier"), "diagnostic_by_unique": ("score_unique", "training_reward_diagnostic")}
BASE = "select_by_tax"
_BEHAVIOR = "CASE WHEN correct THEN CASE WHEN answer_length > 25 THEN 'correct_positive' ELSE 'correct_negative' END WHEN score_tax < 0.04 THEN 'miss' ELSE 'hallucination' END"
_FAMILY = "CASE WHEN task IN ('counting', 'attribute') THEN 'fine' WHEN task = 'other' THEN NULL ELSE 'broad' END"


def _outcomes(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumns({"behavior": F.expr(_BEHAVIOR), "family": F.expr(_FAMILY), "is_yesno": F.col("task") == "existence"})
    return reports.outcomes(c, "sample_id", "candidate_id", STRATEGIES, BASE)


def _winners_sql() -> str:
    parts = [f"""SELECT '{name}' AS strategy, '{pool}' AS pool, sample_id, CAST(correct AS DOUBLE) AS value, behavior, task, family, answer_length, CAST(task = 'existence' AS INT) AS yesno
FROM c WHERE {score} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY {score} DESC, candidate_id) = 1""" for name, (score, pool) in STRATEGIES.items()]
    base = "SELECT '{n}', 'baseline', sample_id, CAST({v} AS DOUBLE), NULL, task, family, NULL, NULL FROM g"
    parts += [base.format(n=n, v=v) for n, v in (("random", "share"), ("top1", "first_right"), ("oracle", "oracle"))]
    return " UNION ALL ".join(f"({p})" for p in parts)


_LONG = f"""{CAND}, c AS (SELECT *, {_BEHAVIOR} AS behavior, {_FAMILY} AS family FROM cand),
g AS (SELECT sample_id, min_by(task, candidate_id) AS task, any_value(family) FILTER (candidate_id = 0) AS family, avg(CAST(correct AS INT)) AS share, min_by(correct, candidate_id) AS first_right, bool_or(correct) AS oracle,
  count(DISTINCT nullif(trim(lower(raw_text)), '')) >= 2 AS informative, count(DISTINCT nullif(trim(lower(raw_text)), '')) >= 2 AND bool_or(correct) AND NOT bool_and(correct) AS strong FROM c GROUP BY 1),
w AS ({_winners_sql()}), l AS (SELECT w.*, informative, strong, NOT first_right AND oracle AS twbor, first_right FROM w JOIN g USING (sample_id))"""


def _figures(prefix: str, subset: str) -> str:
    return f"round(avg(value) FILTER ({subset}), 6) AS {prefix}accuracy, round(coalesce(sum(value) FILTER ({subset}), 0), 4) AS {prefix}correct, count(*) FILTER ({subset}) AS {prefix}total"


_TABLE = f"""{_LONG}, t AS (SELECT strategy, pool, {_figures('', 'true')}, {_figures('informative_', 'informative')}, {_figures('strong_informative_', 'strong')}, {_figures('top1_wrong_but_oracle_right_', 'twbor')},
round(avg(answer_length), 6) AS avg_answer_length, round(avg(yesno), 6) AS yesno_ratio, {', '.join(f"CASE WHEN pool <> 'baseline' THEN count(*) FILTER (behavior = '{b}') END AS {b}" for b in reports.BEHAVIORS)} FROM l GROUP BY strategy, pool)"""


@query(f"WITH {_TABLE} SELECT * FROM t")
def report_strategies(spark, sf_dir):
    t = rounded(reports.strategy_table(_outcomes(spark, sf_dir)))
    return t.withColumns({f"{p}correct": F.round(f"{p}correct", 4) for p in reports.SUBSETS})


@query(f"WITH {_TABLE} SELECT CASE strategy WHEN 'select_by_tax' THEN 'main' ELSE 'other' END AS reward_mode, strategy, accuracy, correct, total, informative_accuracy, informative_correct, informative_total, strong_informative_accuracy FROM t WHERE strategy IN ('select_by_tax', 'select_by_ties')")
def report_modes(spark, sf_dir):
    t = rounded(reports.strategy_table(_outcomes(spark, sf_dir)))
    return reports.mode_table(t.withColumns({f"{p}correct": F.round(f"{p}correct", 4) for p in ("", "informative_")}), {"main": "select_by_tax", "other": "select_by_ties"})


@query(f"""WITH {_LONG}, d AS (SELECT strategy, pool, unnest(['all', 'task', 'family', 'behavior']) AS dim, unnest([NULL, task, family, behavior]) AS key, value FROM l)
SELECT strategy, pool, dim, key, round(avg(value), 6) AS accuracy, round(sum(value), 4) AS correct, count(*) AS total FROM d WHERE NOT (dim = 'behavior' AND pool = 'baseline') GROUP BY ALL""")
def report_breakdown(spark, sf_dir):
    return rounded(reports.breakdown(_outcomes(spark, sf_dir))).withColumn("correct", F.round("correct", 4))


@query(f"WITH {_LONG} SELECT strategy, task, round(avg(value), 6) AS accuracy, round(sum(value), 4) AS correct, count(*) AS total FROM l WHERE pool IN ('baseline', 'verifier') GROUP BY ALL")
def report_tasks(spark, sf_dir):
    return rounded(reports.taskwise_table(_outcomes(spark, sf_dir))).withColumn("correct", F.round("correct", 4))


@query(f"""WITH {_LONG}, b AS (SELECT sample_id, value > 0 AS base FROM l WHERE strategy = '{BASE}'), o AS (SELECT l.strategy, l.value > 0 AS own, l.informative, l.first_right, b.base FROM l LEFT JOIN b USING (sample_id) WHERE pool = 'verifier'),
a AS (SELECT strategy, own, informative, 'top1' AS against, first_right AS theirs FROM o UNION ALL SELECT strategy, own, informative, '{BASE}', base FROM o WHERE strategy <> '{BASE}' AND base IS NOT NULL),
s AS (SELECT *, 'overall' AS subset FROM a UNION ALL SELECT *, 'informative' FROM a WHERE informative)
SELECT strategy, subset, against, count(*) FILTER (own AND NOT theirs) AS n_win, count(*) FILTER (NOT own AND theirs) AS n_loss, count(*) FILTER (own = theirs) AS n_tie FROM s GROUP BY 1, 2, 3""")
def report_pairs(spark, sf_dir):
    return reports.pairwise(_outcomes(spark, sf_dir), BASE)


_STEPS = {"exact_match_all": "min(lower(raw_text)) = max(lower(raw_text))", "parse_identical": "min(answer_length) = max(answer_length)", "final_reward_identical": "max(score_ties) - min(score_ties) < 0.03", "raw_reward_identical": "max(score_tax) = min(score_tax)",
          "n_unique_responses": "count(DISTINCT raw_text)", "reward_std_within_group": "stddev_pop(score_unique)", "label_correct_rate_within_group": "avg(CAST(correct AS INT))", "prompt_side_reward_blocked": "min(score_tax) > 0.06",
          "error": "CASE WHEN min(candidate_id) = max(candidate_id) THEN 'alone' END", "collapse_layer": "CASE WHEN max(score_tax) = min(score_tax) THEN 'raw' WHEN min(answer_length) = max(answer_length) THEN 'parse' END"}


@query(f"""WITH {CAND}, s AS (SELECT sample_id, min_by(task, candidate_id) AS task, {', '.join(f'{e} AS {n}' for n, e in _STEPS.items())}, CASE WHEN max(score_tax) > 0.04 THEN stddev_pop(score_ties) END AS sd FROM cand GROUP BY 1),
v AS (SELECT * FROM s WHERE error IS NULL), k AS (SELECT task, coalesce(collapse_layer, 'none') AS layer, count(*) AS n FROM v GROUP BY 1, 2), h AS (SELECT task, string_agg(layer || '=' || n, ',' ORDER BY layer) AS layers FROM k GROUP BY 1)
SELECT task, count(*) AS n_steps, round(avg(CAST(exact_match_all AS INT)), 6) AS exact_match_group_rate, round(avg(CAST(parse_identical AS INT)), 6) AS parse_identical_group_rate, round(avg(CAST(final_reward_identical AS INT)), 6) AS final_reward_identical_group_rate,
  round(avg(n_unique_responses), 6) AS mean_unique_responses_per_group, round(avg(label_correct_rate_within_group), 6) AS mean_label_correct_rate, round(avg(reward_std_within_group), 3) AS mean_reward_std_within_group, 0.0::DOUBLE AS mean_template_rate, 0.0::DOUBLE AS used_zero_variance_fallback_rate,
  round(avg(CAST(NOT raw_reward_identical AS INT)), 6) AS raw_reward_nonconstant_group_rate, count(*) FILTER (raw_reward_identical) AS n_groups_raw_reward_identical, bool_or(prompt_side_reward_blocked) AS prompt_side_reward_blocked, round(avg(sd), 6) AS mean_final_reward_std_within_group,
  count(*) FILTER (parse_identical AND NOT exact_match_all) AS n_groups_with_same_parse_but_diff_text, count(*) FILTER (NOT exact_match_all AND final_reward_identical) AS n_groups_with_diff_text_but_same_final_reward, any_value(layers) AS layers FROM v JOIN h USING (task) GROUP BY task""")
def report_steps(spark, sf_dir):
    c = candidates(spark, sf_dir)
    s = c.groupBy("sample_id").agg(F.min_by("task", "candidate_id").alias("task"), *[F.expr(e).alias(n) for n, e in _STEPS.items()], F.when(F.max("score_tax") > 0.04, F.collect_list("score_ties")).alias("final_rewards"))
    d = reports.step_diagnostics(s, ["task"])
    layers = F.array_join(F.transform(F.map_entries("collapse_layer_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    kept = ["task", "n_steps", "exact_match_group_rate", "parse_identical_group_rate", "final_reward_identical_group_rate", "mean_unique_responses_per_group", "mean_label_correct_rate", "mean_reward_std_within_group", "mean_template_rate", "used_zero_variance_fallback_rate",
            "raw_reward_nonconstant_group_rate", "n_groups_raw_reward_identical", "prompt_side_reward_blocked", "mean_final_reward_std_within_group", "n_groups_with_same_parse_but_diff_text", "n_groups_with_diff_text_but_same_final_reward"]
    return rounded(d.select(*kept, layers.alias("layers"))).withColumn("mean_reward_std_within_group", F.round("mean_reward_std_within_group", 3))


@query(f"""WITH {CAND}, f AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY abs(score_ties - score_tax) DESC, sample_id, candidate_id) AS place FROM cand WHERE NOT correct)
SELECT task, place, sample_id, candidate_id, round(abs(score_ties - score_tax), 6) AS gap FROM f WHERE place <= 20""")
def report_failures(spark, sf_dir):
    c = candidates(spark, sf_dir).where(~F.col("correct")).withColumn("gap", F.abs(F.col("score_ties") - F.col("score_tax")))
    e = reports.examples(c, ["task"], [F.desc("gap"), F.col("sample_id"), F.col("candidate_id")], ["sample_id", "candidate_id", "gap"], 20)
    return rounded(e.select("task", F.posexplode("examples").alias("p", "e")).select("task", (F.col("p") + 1).cast("long").alias("place"), "e.sample_id", "e.candidate_id", "e.gap"))
