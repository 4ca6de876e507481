"""Every registered query of the engine: name to plan, and name to the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions import arrays, geometry, text
from candela.operators import audit, checks, dataset, evaluate, groups, reports, rewards, telemetry
from candela.operators.ranges import mixed_sql, permuted_sql
from candela.plans.tables import AUDIT, CAND, STEPS, audit as audit_table, candidates, steps as step_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SCORES = ["score_unique", "score_ties", "score_nan", "score_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- groups and strategies ---------------------------------------------------------------

_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {score} DESC, candidate_id) AS rn FROM cand WHERE {score} IS NOT NULL) WHERE rn = 1)"


def _strategy_sql(score: str) -> str:
    return f"""WITH {CAND}, {_BEST.format(score=score)}
SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE 'task' END AS dim, task AS key, count(*) AS total, CAST(count(*) FILTER (correct) AS BIGINT) AS correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy
FROM best GROUP BY GROUPING SETS ((), (task))"""


@query(_strategy_sql("score_unique"))
def strategy_eval(spark, sf_dir):
    return rounded(evaluate.strategy_eval(candidates(spark, sf_dir), "sample_id", F.col("score_unique"), "candidate_id", "correct", "task"))


@query(_strategy_sql("score_ties"))
def strategy_eval_ties(spark, sf_dir):
    return rounded(evaluate.strategy_eval(candidates(spark, sf_dir), "sample_id", F.col("score_ties"), "candidate_id", "correct", "task"))


@query(_strategy_sql("score_nan"))
def strategy_eval_nan(spark, sf_dir):
    return rounded(evaluate.strategy_eval(candidates(spark, sf_dir), "sample_id", F.col("score_nan"), "candidate_id", "correct", "task"))


@query(f"WITH {CAND}, {_BEST.format(score='score_nan')} SELECT sample_id, candidate_id, score_nan AS score, correct FROM best")
def best_rows(spark, sf_dir):
    return groups.best_rows(candidates(spark, sf_dir), "sample_id", F.col("score_nan"), "candidate_id").select("sample_id", "candidate_id", F.col("score_nan").alias("score"), "correct")


@query(f"WITH {CAND} SELECT sample_id, candidate_id, raw_text, correct FROM cand WHERE candidate_id = 0")
def top1_rows(spark, sf_dir):
    return groups.first_rows(candidates(spark, sf_dir), "sample_id", "candidate_id").select("sample_id", "candidate_id", "raw_text", "correct")


@query(f"""WITH {CAND}, per AS (SELECT sample_id, min_by(task, candidate_id) AS task, avg(CAST(correct AS INT)) AS random, CAST(bool_or(correct) AS INT) AS oracle, CAST(min_by(correct, candidate_id) AS INT) AS top1 FROM cand GROUP BY 1)
SELECT CASE WHEN grouping(task) = 1 THEN 'all' ELSE 'task' END AS dim, task AS key, count(*) AS total, round(sum(random), 4) AS random, CAST(sum(top1) AS BIGINT) AS top1, CAST(sum(oracle) AS BIGINT) AS oracle FROM per GROUP BY GROUPING SETS ((), (task))""")
def baselines(spark, sf_dir):
    return rounded(evaluate.baselines(candidates(spark, sf_dir), "sample_id", "candidate_id", "correct", "task"), 4)


@query(f"""WITH {CAND}, f AS (SELECT sample_id, count(DISTINCT nullif(trim(lower(raw_text)), '')) AS t, bool_or(correct) AS o, bool_and(correct) AS a, min_by(correct, candidate_id) AS top1 FROM cand GROUP BY 1)
SELECT sample_id, t >= 2 AS informative, t >= 2 AND o AND NOT a AS strong, top1, o AS oracle, NOT top1 AND o AS top1_wrong_oracle_right FROM f""")
def group_subsets(spark, sf_dir):
    return groups.group_facts(candidates(spark, sf_dir), "sample_id", "candidate_id", "raw_text", "correct")


@query(f"""WITH {CAND}, d AS (SELECT *, score_ties = 0.0 AS dup FROM cand), k AS (SELECT *, count(*) FILTER (NOT dup) OVER (PARTITION BY sample_id) AS own FROM d)
SELECT sample_id, candidate_id FROM k WHERE own = 0 OR NOT dup""")
def prefer_unduplicated(spark, sf_dir):
    d = candidates(spark, sf_dir).withColumn("dup", F.col("score_ties") == 0.0)
    return groups.prefer_unduplicated(d, "sample_id", "dup").select("sample_id", "candidate_id")


@query(f"""WITH {CAND}, {_BEST.format(score='score_unique')}, t AS (SELECT * FROM cand WHERE candidate_id = 0), i AS (SELECT sample_id FROM cand GROUP BY 1 HAVING count(DISTINCT raw_text) >= 2)
SELECT count(*) FILTER (b.correct AND NOT t.correct) AS n_win, count(*) FILTER (NOT b.correct AND t.correct) AS n_loss, count(*) FILTER (b.correct = t.correct) AS n_tie
FROM best b JOIN t USING (sample_id) WHERE sample_id IN (SELECT sample_id FROM i)""")
def win_loss_informative(spark, sf_dir):
    long = reports.outcomes(candidates(spark, sf_dir).select("sample_id", "candidate_id", "score_unique", "correct", "raw_text"), "sample_id", "candidate_id", {"best": ("score_unique", "verifier")})
    one = reports.pairwise(long, "best").where("subset = 'informative' and against = 'top1'")
    return one.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_win", "n_loss", "n_tie")])


def _degeneracy_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{s}' AS reward, sample_id, candidate_id, {s} AS v FROM cand WHERE {s} IS NOT NULL" for s in SCORES)
    return f"""WITH {CAND}, long AS ({long}),
per AS (SELECT reward, sample_id, count(*) AS n, max(v) - min(v) > 1e-9 AS varies, arg_max(candidate_id, struct_pack(v := v, c := -candidate_id)) AS best FROM long GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT reward, round(avg(CAST(varies AS INT)), 6) AS nonconstant_rate, round(avg(CAST(best <> 0 AS INT)), 6) AS winner_not_candidate0_rate, round(avg(CAST(best <> 0 AS INT)), 6) AS winner_not_first_record_rate, count(*) AS n_groups,
  avg(CAST(varies AS INT)) < 0.3 AND avg(CAST(best <> 0 AS INT)) < 0.1 AS is_degenerate FROM per GROUP BY 1"""


@query(_degeneracy_sql())
def degeneracy(spark, sf_dir):
    return rounded(evaluate.degeneracy(candidates(spark, sf_dir), "sample_id", "candidate_id", SCORES))


@query(f"""WITH {CAND}, s AS (SELECT sample_id, candidate_id, raw_text, correct FROM cand WHERE candidate_id < 3),
c AS (SELECT sample_id, candidate_id, CASE WHEN candidate_id = 1 THEN upper(raw_text) ELSE raw_text END AS raw_text, correct FROM cand WHERE candidate_id <> 2)
SELECT s.sample_id, s.candidate_id, c.sample_id IS NULL AS missing, CAST(CASE WHEN c.sample_id IS NULL THEN 0 ELSE 1 END AS INT) AS n_differs FROM s LEFT JOIN c USING (sample_id, candidate_id) WHERE c.sample_id IS NULL OR s.raw_text <> c.raw_text""")
def consistency(spark, sf_dir):
    c = candidates(spark, sf_dir).select("sample_id", "candidate_id", "raw_text", "correct")
    other = c.where("candidate_id <> 2").withColumn("raw_text", F.when(F.col("candidate_id") == 1, F.upper("raw_text")).otherwise(F.col("raw_text"))).withColumn("ord", F.lit(1))
    found = evaluate.inconsistencies(c.where("candidate_id < 3"), other, ["sample_id", "candidate_id"], ["raw_text", "correct"], "ord")
    return found.select("sample_id", "candidate_id", "missing", F.size("differs").alias("n_differs"))


@query(f"WITH {CAND}, n AS (SELECT count(*) AS n FROM cand GROUP BY sample_id) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM n")
def candidates_per_group(spark, sf_dir):
    return rounded(evaluate.candidates_per_group(candidates(spark, sf_dir), "sample_id"))


@query(f"""WITH {CAND}, a AS (SELECT *, score_unique - avg(score_unique) OVER w AS away, stddev_pop(score_unique) OVER w AS sd FROM cand WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, candidate_id, round(CASE WHEN sd < 1e-4 THEN away ELSE away / sd END, 6) AS advantage FROM a""")
def advantages(spark, sf_dir):
    return rounded(groups.advantages(candidates(spark, sf_dir), "sample_id", "score_unique").select("sample_id", "candidate_id", "advantage"))


@query(f"""WITH {CAND}, a AS (SELECT *, CASE WHEN stddev_pop(score_ties) OVER w < 1e-4 THEN score_ties - avg(score_ties) OVER w ELSE (score_ties - avg(score_ties) OVER w) / stddev_pop(score_ties) OVER w END AS adv FROM cand WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, count(*) AS n, round(avg(score_ties), 6) AS mean_reward, round(stddev_pop(score_ties), 6) AS std_reward, max(score_ties) - min(score_ties) < 1e-8 OR count(*) < 2 AS reward_identical,
  count(DISTINCT raw_text) AS n_answers, count(DISTINCT correct) <= 1 AS correctness_identical, stddev_pop(score_ties) < 1e-4 AS zero_variance_fallback FROM a GROUP BY 1""")
def step_metrics(spark, sf_dir):
    return rounded(groups.step_metrics(candidates(spark, sf_dir), "sample_id", "score_ties", "raw_text", "correct").drop("n_positive", "n_negative"))


@query(f"""WITH {CAND}, p AS (SELECT sample_id, raw_text, count(*) AS n, max(score_ties) - min(score_ties) AS spread FROM cand GROUP BY 1, 2),
g AS (SELECT sample_id, sum(n * (n - 1) // 2) AS pairs, sum(CASE WHEN spread > 1e-8 THEN n * (n - 1) // 2 ELSE 0 END) AS different, max(CASE WHEN n > 1 THEN spread ELSE 0 END) AS m FROM p GROUP BY 1)
SELECT sample_id, CAST(pairs AS BIGINT) AS pairs, CAST(different AS BIGINT) AS different, round(m, 6) AS max_spread, round(CASE WHEN pairs = 0 THEN 0 ELSE different / pairs END, 6) AS rate FROM g""")
def same_answer_spread(spark, sf_dir):
    return rounded(groups.same_answer_spread(candidates(spark, sf_dir), "sample_id", F.col("raw_text"), "score_ties"))


@query(f"""WITH {CAND}, f AS (SELECT sample_id, raw_text, min(candidate_id) AS c FROM cand GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY c) - 1 AS k FROM f)
SELECT sample_id, CAST(k AS INT) AS candidate_id, raw_text FROM r WHERE k < 3""")
def first_occurrences(spark, sf_dir):
    return groups.first_occurrences(candidates(spark, sf_dir), "sample_id", text.norm(F.col("raw_text")), "candidate_id", 3).select("sample_id", "candidate_id", "raw_text")


@query(f"""WITH {CAND}, n AS (SELECT sample_id, count(*) AS n FROM cand WHERE candidate_id < 4 GROUP BY 1)
SELECT sample_id, CAST(i AS INT) AS candidate_id, CAST(CASE WHEN i < n THEN i ELSE (i - n) % n END AS INT) AS source_candidate_id, i >= n AS is_duplicate_candidate FROM n, range(4) t(i)""")
def filled_groups(spark, sf_dir):
    c = candidates(spark, sf_dir).where("candidate_id < 4")
    return groups.filled(c, "sample_id", 4).select("sample_id", "candidate_id", "source_candidate_id", "is_duplicate_candidate")


_DIV = f"""{CAND}, t AS (SELECT sample_id, task, raw_text, count(*) AS n, sum(answer_length) AS len FROM cand GROUP BY 1, 2, 3),
d AS (SELECT sample_id, min(task) AS task, sum(n) AS total, count(*) AS uniq, max(n) AS mode, sum(len) AS len FROM t GROUP BY 1)"""


@query(f"WITH {_DIV} SELECT sample_id, task, CAST(total AS BIGINT) AS n_candidates, uniq AS n_unique, round(uniq / total, 6) AS unique_ratio, round(mode / total, 6) AS mode_fraction, round(len / total, 6) AS mean_length, uniq = 1 AS all_same, uniq / total < 0.5 AS low_unique_ratio, mode / total > 0.8 AS high_mode_fraction FROM d")
def diversity(spark, sf_dir):
    return rounded(_diversity(spark, sf_dir).drop("yesno_ratio", "duplicate_rate"))


def _diversity(spark, sf_dir):
    return groups.diversity(candidates(spark, sf_dir), "sample_id", "task", text.norm(F.col("raw_text")), "answer_length", F.lit(False), F.lit(False))


@query(f"""WITH {_DIV} SELECT task, count(*) AS n_groups, round(avg(uniq / total), 6) AS mean_unique_ratio, round(median(uniq / total), 6) AS median_unique_ratio, round(avg(CAST(uniq = 1 AS INT)), 6) AS pct_all_same,
round(avg(CAST(uniq / total < 0.5 AS INT)), 6) AS pct_low_unique_ratio, round(avg(CAST(mode / total > 0.8 AS INT)), 6) AS pct_high_mode_fraction FROM d GROUP BY GROUPING SETS ((), (task))""")
def diversity_summary(spark, sf_dir):
    return rounded(groups.diversity_summary(_diversity(spark, sf_dir)))


@query(f"""WITH RECURSIVE {CAND}, c AS (SELECT sample_id, candidate_id, lower(trim(raw_text)) AS raw, string_split(raw_text, ' ')[1] AS final FROM cand),
p AS MATERIALIZED (SELECT sample_id, list({{'at': candidate_id, 'raw': raw, 'final': final}} ORDER BY candidate_id) AS pool FROM c GROUP BY 1),
r(sample_id, k, pool, taken, raws, finals) AS (
  SELECT sample_id, 0, pool, CAST([] AS INT[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM p
  UNION ALL
  SELECT sample_id, k + 1, pool, CASE WHEN take THEN list_append(taken, i) ELSE taken END, CASE WHEN take THEN list_append(raws, pool[i + 1].raw) ELSE raws END, CASE WHEN take THEN list_append(finals, pool[i + 1].final) ELSE finals END
  FROM (SELECT *, len(taken) < 3 AND NOT (pass = 0 AND len(list_distinct(finals)) >= 2) AND NOT list_contains(taken, i) AND CASE pass WHEN 1 THEN NOT list_contains(raws, pool[i + 1].raw) WHEN 3 THEN true ELSE NOT list_contains(finals, pool[i + 1].final) END AS take
    FROM (SELECT *, CAST(k // len(pool) AS INT) AS pass, CAST(k % len(pool) AS INT) AS i FROM r WHERE k < 4 * len(pool)))),
d AS (SELECT sample_id, pool, taken, unnest(range(3)) AS slot FROM r WHERE k = 4 * len(pool))
SELECT sample_id, CAST(slot AS INT) AS slot, CAST(pool[CASE WHEN slot < len(taken) THEN taken[slot + 1] ELSE slot % len(pool) END + 1].at AS BIGINT) AS source FROM d""")
def greedy_selection(spark, sf_dir):
    c = candidates(spark, sf_dir).select("sample_id", "candidate_id", text.norm(F.col("raw_text")).alias("raw"), F.split("raw_text", " ")[0].alias("final"))
    return groups.select_group(c, "sample_id", "candidate_id", "raw", "final", 3, 2)


@query(f"""WITH {CAND}, g AS (SELECT sample_id FROM cand GROUP BY 1 HAVING bool_and(score_tax < 0.08)) SELECT count(*) AS n, count(DISTINCT sample_id) AS n_groups FROM cand WHERE sample_id IN (SELECT sample_id FROM g)""")
def min_unique_gate(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("ok", F.col("score_tax") < 0.08)
    return groups.min_unique_gate(c, "sample_id", "ok").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("n_groups"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_tax <> 0.0 AND l_discount <> 0.1")
def valid_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_tax") == 0.0, "x").alias("error"), F.when(F.col("l_discount") == 0.1, "error").otherwise("finite_ok").alias("reward_record_status"))
    return groups.valid_rows(li).agg(F.count("*").alias("n"))


# -- audits ---------------------------------------------------------------------------------

@query(f"WITH {CAND}, l AS (" + " UNION ALL ".join(f"SELECT '{s}' AS reward, {s} AS v, answer_length AS a FROM cand WHERE {s} IS NOT NULL" for s in SCORES) + ") SELECT reward, count(*) AS n, round(corr(v, a), 6) AS correlation FROM l GROUP BY 1")
def length_correlation(spark, sf_dir):
    return rounded(audit.length_correlation(candidates(spark, sf_dir), SCORES, "answer_length"))


@query(f"WITH {AUDIT} SELECT 'reward' AS reward, round(avg(reward) FILTER (flag), 6) AS mean_yes, count(*) FILTER (flag) AS n_yes, round(avg(reward) FILTER (NOT flag), 6) AS mean_no, count(*) FILTER (NOT flag) AS n_no, round(avg(reward) FILTER (flag) - avg(reward) FILTER (NOT flag), 6) AS gap FROM audit")
def label_gap(spark, sf_dir):
    return rounded(audit.label_gap(audit_table(spark, sf_dir), ["reward"], F.when(F.col("flag"), "yes").otherwise("no")))


@query(f"WITH {AUDIT} SELECT 'reward' AS reward, lang, round(avg(reward), 6) AS mean, round(stddev_samp(reward), 6) AS std, count(*) AS n FROM audit GROUP BY lang")
def reward_by_dimension(spark, sf_dir):
    return rounded(audit.by_dimension(audit_table(spark, sf_dir), ["reward"], "lang"))


@query(f"""WITH {AUDIT}, r AS (SELECT *, row_number() OVER (ORDER BY reward DESC, doc_id) AS rn, count(*) OVER () AS n FROM audit)
SELECT 'reward' AS reward, max(n) AS n, round(avg(CAST(correct AS INT)) FILTER (rn <= n // 4), 6) AS top_accuracy, round(avg(CAST(correct AS INT)) FILTER (rn > n - n // 4), 6) AS bottom_accuracy,
round(avg(CAST(correct AS INT)) FILTER (rn <= n // 4) - avg(CAST(correct AS INT)) FILTER (rn > n - n // 4), 6) AS lift FROM r HAVING max(n) >= 10""")
def quartile_lift(spark, sf_dir):
    return rounded(audit.quartile_lift(audit_table(spark, sf_dir), ["reward"], "correct", "doc_id"))


@query(f"""WITH {CAND}, k AS (SELECT *, sample_id * 100 + candidate_id AS ord FROM cand), l AS (SELECT 'score_ties' AS reward, score_ties AS v, correct, ord FROM k UNION ALL SELECT 'score_tax', score_tax, correct, ord FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY reward ORDER BY v DESC, ord) AS rn, count(*) OVER (PARTITION BY reward) AS n FROM l)
SELECT reward, max(n) AS n, round(avg(CAST(correct AS INT)) FILTER (rn <= n // 4), 6) AS top_accuracy, round(avg(CAST(correct AS INT)) FILTER (rn > n - n // 4), 6) AS bottom_accuracy,
round(avg(CAST(correct AS INT)) FILTER (rn <= n // 4) - avg(CAST(correct AS INT)) FILTER (rn > n - n // 4), 6) AS lift FROM r GROUP BY 1""")
def quartile_lift_ties(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("ord", F.col("sample_id") * 100 + F.col("candidate_id"))
    return rounded(audit.quartile_lift(c, ["score_ties", "score_tax"], "correct", "ord"))


@query(f"""WITH {AUDIT}, l AS (SELECT 'toxic' AS flag, flag AS f, reward, correct FROM audit UNION ALL SELECT 'english', lang = 'en', reward, correct FROM audit)
SELECT 'reward' AS reward, flag, count(*) FILTER (f) AS n_on, count(*) FILTER (NOT f) AS n_off, round(avg(reward) FILTER (f), 6) AS mean_on, round(avg(reward) FILTER (NOT f), 6) AS mean_off,
round(avg(CAST(correct AS INT)) FILTER (f), 6) AS right_on, round(avg(CAST(correct AS INT)) FILTER (NOT f), 6) AS right_off FROM l GROUP BY flag""")
def style_buckets(spark, sf_dir):
    a = audit_table(spark, sf_dir).withColumns({"toxic": F.col("flag"), "english": F.col("lang") == "en"})
    return rounded(audit.style_buckets(a, ["reward"], ["toxic", "english"], "correct"))


@query(f"WITH {CAND} SELECT task, count(*) AS n, round(avg(answer_length), 6) AS avg_length, round(avg(CAST(score_ties = 0 AS INT)), 6) AS zero_rate FROM cand GROUP BY task")
def family_telemetry(spark, sf_dir):
    return rounded(audit.family_telemetry(candidates(spark, sf_dir), "task", "answer_length", zero=F.col("score_ties") == 0))


@query(f"WITH {CAND} SELECT 'score_nan' AS field, (SELECT count(*) FROM lineitem WHERE l_discount = 0.05 OR l_tax <> 0.08) AS present, count(score_nan) AS finite, round(count(score_nan) / count(*), 6) AS finite_rate, count(score_nan) > 0 AS active FROM cand UNION ALL SELECT 'score_tax', count(*), count(*), 1.0, true FROM cand")
def field_coverage(spark, sf_dir):
    return rounded(audit.field_coverage(candidates(spark, sf_dir), ["score_nan", "score_tax"]))


# -- data sets -----------------------------------------------------------------------------------

_U = "('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0"


@query(f"SELECT CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.9 THEN 'val' ELSE 'probe' END AS data_split, count(*) AS n FROM orders GROUP BY 1")
def data_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(geometry.data_split(F.col("o_orderkey")).alias("data_split")).groupBy("data_split").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderkey % 5 <> 2) WHERE place % 7 = 3")
def modulo_shard(spark, sf_dir):
    # keys with gaps: shards go by place
    return dataset.modulo_shard(table(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey % 5 <> 2"), 7, 3, "o_orderkey")


@query("WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, CAST(ceil(count(*) OVER () / 4) AS BIGINT) AS size FROM customer WHERE c_custkey % 3 <> 1) SELECT c_custkey FROM c WHERE place >= size AND place < 2 * size")
def range_shard(spark, sf_dir):
    return dataset.range_shard(table(spark, sf_dir, "customer").select("c_custkey").where("c_custkey % 3 <> 1"), 4, 1, "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 50")
def hash_sample(spark, sf_dir):
    return dataset.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 50, "o_orderkey")


@query("SELECT coalesce(nullif(c_mktsegment, ''), 'unknown') AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def distribution(spark, sf_dir):
    return dataset.distribution(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT size, count(*) AS pairs FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) GROUP BY 1")
def pair_summary(spark, sf_dir):
    return dataset.pair_summary(table(spark, sf_dir, "orders"), "o_custkey")


@query("WITH f AS (SELECT * FROM part ORDER BY p_partkey LIMIT 100) SELECT count(*) AS checked, count(*) FILTER (p_size > 10) AS ok, count(*) FILTER (NOT p_size > 10) AS missing, round(avg(CAST(p_size > 10 AS INT)), 6) AS rate FROM f")
def integrity(spark, sf_dir):
    return rounded(dataset.integrity(table(spark, sf_dir, "part"), F.col("p_size") > 10, "p_partkey", 100))


@query("WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT count(*) AS families, min(n) AS min_family_size, count(*) * min(n) AS balanced_epoch_size, CAST(ceil(1.5 * count(*) * min(n)) AS BIGINT) AS effective_steps, round(ceil(1.5 * count(*) * min(n)) / sum(n), 6) AS coverage FROM s")
def train_budget(spark, sf_dir):
    return rounded(dataset.train_budget(table(spark, sf_dir, "customer"), "c_mktsegment", 1.5))


FAMILIES = """r AS (SELECT c_mktsegment AS family, c_custkey AS key, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS row FROM customer),
s AS (SELECT family, count(*) AS size, row_number() OVER (ORDER BY family) - 1 AS turn FROM r GROUP BY family), m AS (SELECT min(size) AS least, count(*) AS families FROM s)"""


@query(f"""WITH {FAMILIES}, d AS (SELECT step, family, size, turn, step // families // size AS cycle, step // families % size AS place FROM (SELECT unnest(range(least * families * 3)) AS step, families FROM m) JOIN s ON turn = step % families),
o AS (SELECT *, {mixed_sql(42, "turn", "cycle")} AS own FROM d), p AS (SELECT step, family, {permuted_sql("place", "size", "own")} AS row FROM o)
SELECT step, family, key FROM p JOIN r USING (family, row)""")
def balanced_draws(spark, sf_dir):
    return dataset.balanced_draws(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 3)


@query("WITH f AS (SELECT count(DISTINCT c_mktsegment) AS k FROM customer) SELECT c_mktsegment, CAST(23 // k + CASE WHEN row_number() OVER (ORDER BY c_mktsegment) <= 23 % k THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer), f")
def stratified_choice(spark, sf_dir):
    return dataset.stratified_choice(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 23).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


# -- step logs -----------------------------------------------------------------------------------------

@query(f"WITH {STEPS} SELECT family, count(*) AS n_steps, round(avg(CAST(reward > 100 AS INT)), 6) AS high_rate, round(avg(reward), 4) AS mean_reward FROM steps GROUP BY 1")
def group_diagnostics(spark, sf_dir):
    s = step_table(spark, sf_dir).withColumn("high", F.col("reward") > 100)
    return rounded(telemetry.diagnostics(s, ["family"], ["high"], ["reward"]), 6).withColumn("mean_reward", F.round("mean_reward", 4))


@query(f"WITH {STEPS} SELECT lower(family) AS answer, count(*) AS n FROM steps GROUP BY 1")
def top_answers(spark, sf_dir):
    s = step_table(spark, sf_dir).select("step", F.array(F.upper("family"), F.lit(" ")).alias("answers"))
    return telemetry.top_answers(s, "answers", "step")


@query(f"WITH {STEPS}, w AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) AS place, count(*) OVER t AS n, avg(reward) OVER t AS m FROM steps WINDOW t AS (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT run, step, n, round(m, 4) AS trailing_reward FROM w WHERE place % 10 = 0")
def trailing_means(spark, sf_dir):
    return rounded(telemetry.trailing(step_table(spark, sf_dir), "run", "step", ["reward"]), 4)


@query(f"""WITH {STEPS}, i AS (SELECT *, sum(CASE WHEN reward > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY step) AS island FROM steps),
k AS (SELECT run, step, sum(CASE WHEN reward > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY step) AS streak FROM i) SELECT run, CAST(max(streak) AS BIGINT) AS longest, min(step) FILTER (streak >= 3) AS stop_step FROM k GROUP BY 1""")
def longest_streaks(spark, sf_dir):
    return telemetry.longest_streaks(step_table(spark, sf_dir), "run", "step", F.col("reward") > 50, 3)


@query(f"WITH {STEPS} SELECT run, step, round(avg(CASE WHEN reward > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS running_rate FROM steps")
def running_rate(spark, sf_dir):
    return rounded(telemetry.running_rate(step_table(spark, sf_dir), "run", "step", F.col("reward") > 50).select("run", "step", "running_rate"))


_HALF = "CAST(sum(CAST(reward AS DECIMAL(18, 6))) FILTER (rn {op} n // 2) AS DOUBLE) / count(*) FILTER (rn {op} n // 2)"


@query(f"WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS rn, count(*) OVER (PARTITION BY run) AS n FROM steps) SELECT run, max(n) AS n, round({_HALF.format(op='<=')}, 9) AS first_half, round({_HALF.format(op='>')}, 9) AS second_half, {_HALF.format(op='>')} > 2 * ({_HALF.format(op='<=')}) AS surge FROM r WHERE n >= 20 GROUP BY run")
def run_halves(spark, sf_dir):
    return rounded(telemetry.halves(step_table(spark, sf_dir), "run", "step", "reward"), 9)


@query(f"WITH {STEPS} SELECT family, CASE WHEN avg(reward) > 0 THEN ['reward_surge'] ELSE [] END AS issues, NOT avg(reward) > 0 AS ok FROM steps GROUP BY 1")
def verdict(spark, sf_dir):
    f = step_table(spark, sf_dir).groupBy("family").agg((F.avg("reward") > 0).alias("surge"))
    return telemetry.verdict(f).drop("surge")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    from candela.streaming import steps
    e = table(spark, sf_dir, "events")
    return steps.tumbling(e, "ts", "1 hour", "event_type", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    from candela.streaming import steps
    return steps.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "user_id", "value").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 2).alias("total"))


# -- kernels over vectors -----------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x) / list_sum(list_transform(v, lambda y: exp(y)))) AS p, list_transform(list_reverse(v), lambda x: exp(x) / list_sum(list_transform(v, lambda y: exp(y)))) AS q FROM e)"


@query(f"""WITH {_E} SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy, round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2]))), 6) AS kl,
round(list_sum(list_transform(list_zip(p, q), lambda z: 0.5 * (z[1] * ln(2 * z[1] / (z[1] + z[2])) + z[2] * ln(2 * z[2] / (z[1] + z[2]))))), 6) AS js,
round(1 - list_cosine_similarity(v, list_reverse(v)), 6) AS cos, round(sqrt(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS l2, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) AS lse, round(list_sum(v) / len(v), 6) AS mean FROM p""")
def distribution_kernels(spark, sf_dir):
    v = arrays.doubles(F.col("embedding"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("p", arrays.softmax(F.col("v"))).withColumn("q", F.reverse("p")).withColumn("r", F.reverse("v"))
    p, q, v, r = (F.col(c) for c in "pqvr")
    return rounded(d.select("vec_id", arrays.entropy(p).alias("entropy"), arrays.kl(p, q).alias("kl"), arrays.js(p, q).alias("js"), arrays.cosine_distance(v, r).alias("cos"), arrays.l2_distance(v, r).alias("l2"), arrays.logsumexp(v).alias("lse"), arrays.average(v).alias("mean")))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn FROM e)
SELECT vec_id, CAST(i AS INT) AS i, CAST(rn AS INT) AS place FROM r WHERE rn <= 5""")
def vector_top_places(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.top_indices(F.col("embedding"), 5)).alias("place", "i"))
    return d.select("vec_id", "i", (F.col("place") + 1).alias("place"))


@query("SELECT vec_id, round(ln(exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)) - embedding[3]::DOUBLE, 6) AS margin, round((embedding[1]::DOUBLE + embedding[4]::DOUBLE) / 2, 6) AS mean_lp FROM embeddings")
def margins(spark, sf_dir):
    v = arrays.doubles(F.col("embedding"))
    idx = lambda *i: F.array(*[F.lit(k) for k in i])
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", arrays.margin(v, idx(0, 1), idx(2)).alias("margin"), arrays.mean_logprob(v, idx(0, 3)).alias("mean_lp")))


# -- rewards over rows -------------------------------------------------------------------------------------------

@query(f"""WITH {CAND}, k AS (SELECT *, CASE WHEN candidate_id = 0 THEN 'orig' WHEN candidate_id = 1 THEN 'pos' ELSE 'neg' END AS kind, -score_ties AS lp FROM cand),
a AS (SELECT sample_id, max(lp) FILTER (kind = 'orig') - max(lp) FILTER (kind = 'pos') AS s, max(lp) FILTER (kind = 'orig') - avg(lp) FILTER (kind = 'neg') AS m, stddev_pop(lp) FILTER (kind = 'neg') AS d, count(*) FILTER (kind = 'neg') AS n FROM k GROUP BY 1)
SELECT sample_id, n AS n_negatives, round(s, 6) + 0.0 AS s_pos, round(CASE WHEN n = 0 THEN tanh(s) WHEN abs(s - m) < 1e-12 THEN 0 ELSE tanh((s - m) / (CASE WHEN d < 1e-12 THEN 0 ELSE d END + 1e-6)) END, 5) + 0.0 AS margin FROM a""")
def evidence_margin(spark, sf_dir):
    kind = F.when(F.col("candidate_id") == 0, "orig").when(F.col("candidate_id") == 1, "pos").otherwise("neg")
    i = candidates(spark, sf_dir).select("sample_id", kind.alias("kind"), (-F.col("score_ties")).alias("mean_logprob"))
    return rewards.evidence_margin(i, ["sample_id"]).select("sample_id", "n_negatives", (F.round("s_pos", 6) + 0.0).alias("s_pos"), (F.round("margin", 5) + 0.0).alias("margin"))


@query(f"""WITH {CAND}, r AS (SELECT sample_id, candidate_id, task, CASE WHEN correct THEN 1.0 ELSE -0.25 END AS c, tanh(score_ties) AS m FROM cand)
SELECT sample_id, candidate_id, c AS correctness_only, round(CASE WHEN task IN ('counting', 'attribute', 'spatial') THEN c + 0.1 * m ELSE c END, 6) AS additive_evidence,
round(CASE WHEN task IN ('counting', 'attribute', 'spatial') THEN c * 0.5 * (1 + tanh(m / 0.5)) + 0.1 * m ELSE c END, 6) AS routed_gated_evidence, CASE WHEN task IN ('counting', 'attribute', 'spatial') THEN 'routed_gated_evidence' ELSE 'correctness_only' END AS effective_mode FROM r""")
def main_rewards(spark, sf_dir):
    c = candidates(spark, sf_dir)
    r = rewards.main_rewards(F.when(F.col("correct"), 1.0).otherwise(-0.25), F.tanh("score_ties"), F.col("task"), 0.5, 0.1)
    return rounded(c.select("sample_id", "candidate_id", r.alias("r")).select("sample_id", "candidate_id", "r.correctness_only", "r.additive_evidence", "r.routed_gated_evidence", "r.effective_mode"))


@query(f"""WITH {CAND} SELECT sample_id, candidate_id, round(CASE WHEN correct THEN 0.25 + 0.75 * greatest(0, score_ties - 0.05) WHEN task = 'other' THEN -1 + 0.1 * (score_ties - 0.05) ELSE -0.6 + 0.2 * (score_ties - 0.05) END, 6) AS soft,
round(least(greatest((score_ties - 0.05 + 0.1) / 0.35, 0), 1), 6) AS gate, round((CASE WHEN score_tax > 0.05 THEN least(score_ties - 0.25, -0.5) ELSE score_ties END) - 0.1 - 0.02 * score_tax, 6) AS final FROM cand""")
def shaped_rewards(spark, sf_dir):
    base = F.col("score_ties") - 0.05
    parsed = F.when(F.col("task") == "other", "other").otherwise("yes")
    return rounded(candidates(spark, sf_dir).select("sample_id", "candidate_id", rewards.soft_shaping(base, F.col("correct"), parsed)["reward"].alias("soft"), rewards.anchor_gate(base).alias("gate"),
                                                    rewards.final_reward(F.col("score_ties"), F.col("score_tax") > 0.05, F.lit(0.1), F.col("score_tax"), F.lit(0.0), 0.02).alias("final")))


# -- checks ----------------------------------------------------------------------------------------------------------

@query(f"WITH {CAND} SELECT count(*) AS n, round(avg(score_ties), 6) AS mean, round(stddev_pop(score_ties), 6) AS std, min(score_ties) AS least, max(score_ties) AS most, round(avg(CAST(score_ties > 0 AS INT)), 6) AS positive_rate, round(corr(score_ties, score_unique), 6) AS area_correlation, round(corr(score_ties, answer_length), 6) AS token_correlation FROM cand")
def distribution_check(spark, sf_dir):
    return rounded(checks.distribution_check(candidates(spark, sf_dir), "score_ties", "answer_length", "score_unique"))


@query(f"""WITH {CAND}, l AS (SELECT score_ties AS c, score_tax AS o, CAST(answer_length AS DOUBLE) AS ct, candidate_id + 1.0 AS ot FROM cand)
SELECT 'score_tax' AS other, form, count(*) AS n, round(avg(CAST(c > o AS INT)), 6) AS win_rate FROM (SELECT 'raw' AS form, c, o FROM l UNION ALL SELECT 'sqrt', c / sqrt(ct), o / sqrt(ot) FROM l UNION ALL SELECT 'log', c / ln(1 + ct), o / ln(1 + ot) FROM l) GROUP BY form""")
def box_check(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("score_tax_tokens", F.col("candidate_id") + 1)
    return rounded(checks.box_check(c, "score_ties", ["score_tax"], "answer_length"))


@query(f"WITH {CAND} SELECT count(*) AS groups, round(avg(CAST(v AS INT)), 6) AS nonconstant_rate, round(avg(CAST(a AS INT)), 6) AS identical_answer_rate, round(avg(s), 6) AS mean_std, [] AS reasons, true AS passed FROM (SELECT max(score_ties) - min(score_ties) > 1e-6 AS v, count(DISTINCT raw_text) <= 1 AS a, stddev_pop(score_ties) AS s FROM cand GROUP BY sample_id)")
def preflight(spark, sf_dir):
    return rounded(checks.preflight(candidates(spark, sf_dir), "sample_id", "score_ties", "raw_text"))


@query(f"WITH {CAND}, m AS (SELECT sample_id, max(score_unique) AS m FROM cand WHERE candidate_id > 0 GROUP BY 1) SELECT count(*) AS n, round(avg(CAST(score_unique > m AS INT)), 6) AS beats_all_rate FROM cand JOIN m USING (sample_id) WHERE candidate_id = 0")
def wording_check(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return rounded(checks.wording_check(c.where("candidate_id = 0"), c.where("candidate_id > 0"), "sample_id", "score_unique"))


@query("SELECT o_orderkey, o_orderstatus, EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus <> a.o_orderstatus) AS found FROM orders a")
def other_in_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    other = checks.other_in_group(o, "o_custkey", "o_orderstatus", "o_orderkey", F.lit(True))
    # the row that is found is of the same customer and another status
    there = o.select(F.col("o_orderkey").alias("other"), F.col("o_custkey").alias("c2"), F.col("o_orderstatus").alias("s2"))
    return (o.join(other, "o_orderkey", "left").join(there, "other", "left")
            .select("o_orderkey", "o_orderstatus", F.coalesce((F.col("c2") == F.col("o_custkey")) & (F.col("s2") != F.col("o_orderstatus")), F.lit(False)).alias("found")))
