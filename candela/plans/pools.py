"""Queries of data sets, reward records, pools, checks and kernels that the catalog leaves, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions import arrays
from candela.operators import audit, checks, contract, dataset, evaluate, groups, rewards, telemetry
from candela.operators.ranges import mixed_sql
from candela.plans.catalog import FAMILIES, SCORES, query, rounded
from candela.plans.tables import AUDIT, CAND, STEPS, audit as audit_table, candidates, steps as step_table, table
from candela.sources import files

# -- data sets ---------------------------------------------------------------------------------


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples made of orders: blank questions, broken boxes and missing ids among them."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    bbox = F.array(F.lit("1"), F.lit("2"), F.when(k % 9 == 0, "wide").otherwise("30"), F.lit("40.5"))
    return o.select(k.alias("ord"), F.when(k % 4 != 0, F.concat(F.lit("pair"), F.floor(k / 2))).alias("pair_id"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("uid"), k)).alias("sample_uid"), F.col("o_custkey").alias("image_id"),
                    F.when(k % 2 == 0, F.concat(F.lit("im/"), k)).alias("image_file"), F.concat(F.lit("old/"), k).alias("image_path"), F.lower("o_orderpriority").alias("task_type"),
                    F.when(k % 11 == 0, "  ").otherwise(" How many? ").alias("question"), F.col("o_orderstatus").alias("answer"), bbox.alias("bbox"), F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "0").alias("gt_present"))


_SPLIT = "('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0"
RAW = f"""raw AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 <> 0 THEN 'pair' || (o_orderkey // 2) ELSE 'vg_pair_' || o_orderkey END AS pair_id, o_orderkey % 6 = 0 AS bare, CAST(o_custkey AS VARCHAR) AS image_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'im/' || o_orderkey ELSE 'old/' || o_orderkey END AS image_file, lower(o_orderpriority) AS task_type, o_orderstatus AS answer, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS gt_present,
  CASE WHEN {_SPLIT} < 0.8 THEN 'train' WHEN {_SPLIT} < 0.9 THEN 'val' ELSE 'probe' END AS data_split, o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0 AS good FROM orders),
canon AS (SELECT *, CASE WHEN bare THEN pair_id || ':' || ord ELSE 'uid' || ord END AS sample_uid FROM raw WHERE good)"""
_CANON = ["pair_id", "sample_uid", "image_id", "image_file", "task_type", "question", "answer", "gt_present", "data_split"]


@query(f"WITH {RAW} SELECT pair_id, sample_uid, image_id, image_file, task_type, 'How many?' AS question, answer, gt_present, data_split, 40.5::DOUBLE AS h FROM canon")
def canonical_samples(spark, sf_dir):
    return dataset.canonical_samples(raw_samples(spark, sf_dir)).select(*_CANON, F.col("target_bbox")[3].alias("h"))


@query(f"WITH {RAW} SELECT sample_uid, task_type FROM canon WHERE task_type = '2-high' AND data_split = 'probe'")
def dataset_by_name(spark, sf_dir):
    return contract.dataset_rows(raw_samples(spark, sf_dir), "VG_brutal", "2-HIGH", "test").select("sample_uid", "task_type")


@query("SELECT o_orderkey AS ord FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '5-low')")
def dataset_allow_list(spark, sf_dir):
    return contract.dataset_rows(raw_samples(spark, sf_dir), None, "any", allow=[" 1-urgent", "5-LOW "]).select("ord")


@query("SELECT o_orderkey AS ord FROM orders WHERE lower(o_orderpriority) = '3-medium'")
def dataset_legacy(spark, sf_dir):
    return contract.legacy_rows(raw_samples(spark, sf_dir), "3-medium").select("ord")


@query(f"WITH {RAW} SELECT data_split, gt_present, count(*) AS n FROM canon WHERE gt_present AND data_split = 'val' AND task_type IN ('1-urgent', '2-high') GROUP BY 1, 2")
def dataset_filters(spark, sf_dir):
    c = dataset.canonical_samples(raw_samples(spark, sf_dir))
    d = dataset.positive_only(dataset.of_split(dataset.allowed(dataset.of_task(c, " ALL "), ["1-urgent", "2-high"]), "val"))
    return d.groupBy("data_split", "gt_present").agg(F.count("*").alias("n"))


@query(f"""WITH {RAW} SELECT pair_id, CASE WHEN ord % 5 = 0 THEN 'image_not_found' END AS error, CASE WHEN ord % 5 = 0 THEN image_id END AS image_id FROM canon""")
def image_errors(spark, sf_dir):
    c = dataset.canonical_samples(raw_samples(spark, sf_dir))
    there = F.when(F.regexp_extract("image_file", r"(\d+)$", 1).cast("long") % 5 != 0, F.col("image_file"))
    e = contract.image_error({n: F.col(n) for n in ("pair_id", "image_id", "image_file")}, there)
    return c.select("pair_id", e["error"].alias("error"), e["image_id"].alias("image_id"))


@query("""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'pics/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN '/abs/' || o_orderkey ELSE '' || o_orderkey END AS ref FROM orders)
SELECT k, CASE WHEN k % 3 = 0 THEN '/data/pics/' || k WHEN k % 3 = 1 THEN '/abs/' || k WHEN k % 2 = 0 THEN '/data/pics/' || k END AS path FROM f""")
def image_paths(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("pics/"), k)).when(k % 3 == 1, F.concat(F.lit("/abs/"), k)).otherwise(k.cast("string")).alias("ref"))
    there = s.select(F.when(F.col("k") % 3 == 0, F.concat(F.lit("/data/pics/"), "k")).when(F.col("k") % 3 == 1, F.concat(F.lit("/abs/"), "k")).when(F.col("k") % 2 == 0, F.concat(F.lit("/data/pics/"), "k")).alias("path")).where("path is not null")
    return files.resolved_paths(s, "k", ["ref"], there, "/data/pics/")


@query("SELECT c_custkey FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 7")
def collapse_dump(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("layer", F.when(F.col("c_custkey") >= 0, "parse")).withColumn("at", F.struct("c_mktsegment", "c_custkey"))
    return contract.collapsed(c, "layer", "at", 7).select("c_custkey")


@query("SELECT p_partkey, place, word, score FROM (SELECT p_partkey, unnest(generate_series(0, greatest(len(string_split(p_name, ' ')), 2) - 1)) AS place, string_split(p_name, ' ') AS w, [p_size, p_size + 1] AS s FROM part) t, LATERAL (SELECT w[place + 1] AS word, s[place + 1] AS score)")
def zipped_arrays(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("word"), F.array("p_size", F.col("p_size") + 1).alias("score"))
    return contract.zipped(p, ["p_partkey"], ["word", "score"]).select("p_partkey", F.col("place").cast("long").alias("place"), "word", "score")


@query(f"""WITH {FAMILIES}, d AS (SELECT o_orderkey AS draw, {mixed_sql(42, "o_orderkey", 1)} % families AS turn FROM orders, m)
SELECT draw, r.family, key FROM d JOIN s USING (turn) JOIN r ON r.family = s.family AND r.row = {mixed_sql(42, "draw", 2)} % size""")
def bucket_draws(spark, sf_dir):
    return contract.bucket_draws(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw")))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS place FROM orders ORDER BY 2 LIMIT 20")
def text_order(spark, sf_dir):
    return dataset.text_first(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id")), "o_orderkey", 20)


@query("SELECT p_partkey, p_size % 3 = 0 OR p_size % 3 = 1 AS infra FROM part")
def device_errors(spark, sf_dir):
    s = F.col("p_size") % 3
    m = F.when(s == 0, "RuntimeError: No CUDA GPUs are available").when(s == 1, "CUDA driver is not available here").when(F.col("p_size") % 2 == 0, "shape mismatch")
    return table(spark, sf_dir, "part").select("p_partkey", contract.no_device(m).alias("infra"))


# -- reward records --------------------------------------------------------------------------------

@query(f"WITH {CAND} SELECT sample_id, candidate_id, round(0.3 * score_nan + 0.7 * score_tax, 6) AS mix_js, round(0.3 * score_ties + 0.7 * score_tax, 6) AS mix_cos FROM cand")
def distance_rewards(spark, sf_dir):
    c = candidates(spark, sf_dir)
    nan = F.when(~F.isnan("score_nan"), F.col("score_nan"))
    return rounded(c.select("sample_id", "candidate_id", rewards.ced_rewards(nan, F.col("score_ties"), F.col("score_tax"), 0.3, 0.7).alias("r")).select("sample_id", "candidate_id", "r.mix_js", "r.mix_cos"))


@query(f"""WITH {CAND} SELECT sample_id, candidate_id, score_nan AS action_logprob_ate_score_base, score_ties AS action_logprob_ate_delta, raw_text AS action_logprob_ate_answer,
  CASE WHEN candidate_id = 1 THEN 'error' WHEN score_nan IS NULL THEN 'partial_finite' ELSE 'finite_ok' END AS status, CASE WHEN candidate_id = 1 THEN coalesce(score_nan, 0) ELSE score_nan END AS defaulted FROM cand""")
def record_fields(spark, sf_dir):
    c = candidates(spark, sf_dir)
    failed = F.col("candidate_id") == 1
    fixed = contract.with_error_defaults(c.withColumn("reward_logits_js", F.when(~F.isnan("score_nan"), F.col("score_nan"))), "legacy_ced", failed)
    status = F.when(failed, "error").otherwise(audit.record_status(["score_a", "score_ties"], F.lit(True)))
    fixed = fixed.withColumn("score_a", F.coalesce("score_nan", F.lit(float("nan"))))
    return fixed.select("sample_id", "candidate_id", *contract.prefixed({"score_base": F.col("score_nan"), "delta": F.col("score_ties"), "answer": F.col("raw_text")}, ("answer",)), status.alias("status"), F.col("reward_logits_js").alias("defaulted"))


@query(f"""WITH {CAND}, p AS (SELECT *, CASE WHEN candidate_id = 3 THEN NULL ELSE correct END AS c, CASE WHEN task = 'other' THEN 'other' ELSE 'yes' END AS parsed FROM cand)
SELECT sample_id, candidate_id, CASE WHEN c THEN 0.0::DOUBLE WHEN NOT c AND parsed = 'other' THEN -1.5 WHEN NOT c THEN -1.0 ELSE 0.0 END AS hard, CASE WHEN c THEN 0.25::DOUBLE WHEN NOT c AND parsed = 'other' THEN -1.0 WHEN NOT c THEN -0.6 ELSE 0.0 END AS soft, 0.0::DOUBLE AS raw,
  CASE WHEN c THEN least(greatest(score_ties, 0), 0.04) WHEN NOT c AND parsed = 'other' THEN -1.5 WHEN NOT c THEN -1.0 ELSE least(greatest(score_ties, 0), 0.04) * 0.5 END AS gated, coalesce(score_nan, 0) AS delta FROM p""")
def error_rewards(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("c", F.when(F.col("candidate_id") != 3, F.col("correct")))
    parsed = F.when(F.col("task") == "other", "other").otherwise("yes")
    return c.select("sample_id", "candidate_id", contract.error_reward("legacy_hard_gate", F.col("c"), parsed, -1.0, -1.5).alias("hard"), contract.error_reward("soft_shaping", F.col("c"), parsed, -1.0, -1.5).alias("soft"),
                    contract.error_reward("raw_delta", F.col("c"), parsed, -1.0, -1.5).alias("raw"), rewards.hard_gate(F.col("score_ties"), F.col("c"), parsed, 0.04, -1.0, -1.5).alias("gated"), rewards.raw_delta(F.col("score_nan")).alias("delta"))


@query(f"""WITH {CAND}, r AS (SELECT *, CASE WHEN correct THEN 1.0 ELSE -0.25 END AS c, score_ties AS m FROM cand) SELECT sample_id, candidate_id, 1.0::DOUBLE AS answer_coef, CASE WHEN task IN ('counting', 'attribute', 'spatial') THEN 1.0::DOUBLE ELSE 0.0 END AS visual_coef,
  c AS answer_reward, round(CASE WHEN task IN ('counting', 'attribute', 'spatial') THEN 0.2 * m ELSE 0 END, 6) AS visual_reward, round(CASE WHEN task IN ('counting', 'attribute', 'spatial') THEN c + 0.2 * m ELSE c END, 6) AS total, 'reward_main_additive_evidence' AS field,
  round(0.6 * tanh(m / 0.5) + 0.4 * tanh(score_tax / 0.2), 6) AS base, round(CASE WHEN task = 'counting' THEN 0.5 * c + 2.0 * m ELSE 1.0 * c END, 6) AS mixed FROM r""")
def reward_contract(spark, sf_dir):
    c = F.when(F.col("correct"), 1.0).otherwise(-0.25)
    main = rewards.main_rewards(c, F.col("score_ties"), F.col("task"), 0.5, 0.2)
    k = contract.main_contract("additive_evidence", {n: F.col(f"m.{n}") for n in ("correctness_only", "additive_evidence", "routed_gated_evidence")}, F.col("c"), F.col("m.evidence_allowed"))
    d = candidates(spark, sf_dir).withColumns({"c": c, "m": main})
    return rounded(d.select("sample_id", "candidate_id", k.alias("k"), rewards.score_base(F.col("score_ties"), F.col("score_tax"), 0.5, 0.2, 0.6, 0.4).alias("base"),
                            rewards.mixed_reward(F.col("task"), F.col("c"), F.col("score_ties"), {"counting": (0.5, 2.0)}).alias("mixed")).select("sample_id", "candidate_id", "k.*", "base", "mixed"))


@query(f"""WITH {CAND} SELECT sample_id, candidate_id, (CASE WHEN score_tax > 0.04 THEN score_ties ELSE least(score_ties, -0.75) END)::DOUBLE AS scoped,
  round(least(greatest(CASE WHEN task IN ('existence', 'counting') THEN 1.1 ELSE 0.9 END + ([0.0, 0.12, -0.06, 0.20, -0.12, 0.28, -0.18, 0.34])[candidate_id % 8 + 1] + 0.1, 0.85), 1.65), 6)::DOUBLE AS temperature,
  round(least(greatest(CASE WHEN task IN ('existence', 'counting') THEN 0.97 ELSE 0.92 END + ([0.0, 0.01, -0.01, 0.02, -0.02, 0.03, -0.03, 0.04])[candidate_id % 8 + 1] + 0.01, 0.90), 0.995), 6)::DOUBLE AS top_p FROM cand""")
def sampling_and_scope(spark, sf_dir):
    s = rewards.sampling_settings(F.col("task"), F.col("candidate_id"), F.lit(1), 0.9, 0.92)
    return rounded(candidates(spark, sf_dir).select("sample_id", "candidate_id", rewards.invalid_scope(F.col("score_ties"), F.col("score_tax") > 0.04).alias("scoped"), s["temperature"].alias("temperature"), s["top_p"].alias("top_p")))


@query(f"""WITH {CAND}, a AS (SELECT *, score_ties - avg(score_ties) OVER w AS away, stddev_pop(score_ties) OVER w AS sd FROM cand WINDOW w AS (PARTITION BY sample_id)) SELECT sample_id, round(CAST(sum(CAST(-CASE WHEN sd < 1e-4 THEN away ELSE away / sd END * -score_tax AS DECIMAL(38, 15))) FILTER (correct) AS DOUBLE) / count(*) FILTER (correct), 9) + 0.0 AS loss FROM a GROUP BY 1""")
def policy_losses(spark, sf_dir):
    a = groups.advantages(candidates(spark, sf_dir), "sample_id", "score_ties")
    per = a.groupBy("sample_id").agg(rewards.policy_loss(F.col("advantage"), -F.col("score_tax"), F.col("correct")).alias("loss"))
    return per.select("sample_id", (F.round("loss", 9) + 0.0).alias("loss"))


@query(f"WITH {CAND} SELECT 'score_nan' AS logprob_key, 'answer_length' AS length_key, bool_or(score_nan IS NOT NULL) AS finite FROM cand")
def chosen_keys(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumnRenamed("score_nan", "final_answer_mean_logprob")
    key, length = contract.logprob_key(c), contract.length_key(c)
    name = {"final_answer_mean_logprob": "score_nan"}.get(key, key)
    return c.agg(F.lit(name).alias("logprob_key"), F.lit(length).alias("length_key"), F.bool_or(F.col(key).isNotNull() & ~F.isnan(key)).alias("finite"))


# -- strategies and audits ---------------------------------------------------------------------------

_ACC = """acc AS (SELECT 'select_by_' || reward AS strategy, avg(CAST(correct AS INT)) AS accuracy, avg(answer_length) AS avg_answer_length, avg(CAST(task = 'existence' AS INT)) AS yesno_ratio FROM (SELECT *, row_number() OVER (PARTITION BY reward, sample_id ORDER BY v DESC, candidate_id) AS rn FROM ({long})) WHERE rn = 1 GROUP BY 1)"""
_LONG = " UNION ALL ".join(f"SELECT '{s}' AS reward, sample_id, candidate_id, {s} AS v, correct, answer_length, task FROM cand WHERE {s} IS NOT NULL" for s in SCORES)


def _selected(spark, sf_dir) -> DataFrame:
    """The best row of each sample under every score: one pass over the unpivoted scores."""
    c = candidates(spark, sf_dir)
    long = evaluate.unpivoted(c, ["sample_id", "candidate_id", "correct", "answer_length", "task"], SCORES).where("value is not null")
    best = long.groupBy("reward", "sample_id").agg(F.max_by(F.struct("correct", "answer_length", "task"), F.struct("value", -F.col("candidate_id"))).alias("b"))
    return best.select(F.concat(F.lit("select_by_"), "reward").alias("strategy"), "reward", "sample_id", "b.*")


def _accuracies(spark, sf_dir) -> DataFrame:
    return _selected(spark, sf_dir).groupBy("strategy").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("answer_length").alias("avg_answer_length"), F.avg((F.col("task") == "existence").cast("int")).alias("yesno_ratio"))


@query(f"WITH {CAND}, {_ACC.format(long=_LONG)} SELECT strategy, round(accuracy, 6) AS accuracy, round(avg_answer_length, 6) AS avg_answer_length, round(yesno_ratio, 6) AS yesno_ratio, avg_answer_length < 2 AS too_short, yesno_ratio > 0.85 AS too_alike, avg_answer_length < 2 OR yesno_ratio > 0.85 AS risk FROM acc")
def strategy_table(spark, sf_dir):
    acc = _accuracies(spark, sf_dir)
    return rounded(acc.join(contract.template_risk(acc), "strategy"))


@query(f"WITH {CAND}, {_ACC.format(long=_LONG)} SELECT strategy FROM acc WHERE strategy LIKE '%ties'")
def recounts(spark, sf_dir):
    told = _accuracies(spark, sf_dir).withColumn("accuracy", F.when(F.col("strategy").endswith("ties"), F.col("accuracy") + 0.01).otherwise(F.col("accuracy")))
    return evaluate.recount(_selected(spark, sf_dir), told).select("strategy")


@query(f"""WITH {CAND}, {_ACC.format(long=_LONG)}, w AS (SELECT max(accuracy) FILTER (strategy = 'select_by_score_unique') AS a, max(accuracy) FILTER (strategy = 'select_by_score_ties') AS b, max(accuracy) FILTER (strategy = 'select_by_score_tax') AS c FROM acc)
SELECT round(b - a, 6) AS gain_ties, round(c - a, 6) AS gain_tax, greatest(b - a, c - a) <= 0 AS no_advantage FROM w""")
def mode_gains(spark, sf_dir):
    m = evaluate.mode_comparison(_accuracies(spark, sf_dir), "select_by_score_unique", "select_by_score_ties", "select_by_score_tax")
    return rounded(m.select(F.col("gain_select_by_score_ties").alias("gain_ties"), F.col("gain_select_by_score_tax").alias("gain_tax"), "no_advantage"))


@query(f"""WITH {CAND}, long AS ({_LONG} UNION ALL SELECT 'flat', sample_id, candidate_id, 1.0, correct, answer_length, task FROM cand), v AS (SELECT reward, sample_id, max(v) - min(v) > 1e-9 AS varies FROM long GROUP BY 1, 2 HAVING count(*) >= 2) SELECT 'diagnostic_select_by_' || reward AS strategy, reward FROM v GROUP BY reward HAVING bool_or(varies)""")
def unblocked_rewards(spark, sf_dir):
    d = evaluate.degeneracy(candidates(spark, sf_dir).withColumn("flat", F.lit(1.0)), "sample_id", "candidate_id", [*SCORES, "flat"])
    return contract.diagnostic_strategies(contract.unblocked(d), "reward")


@query("SELECT * FROM (VALUES ('verifier', 'select_by_score_ties'), ('verifier', 'select_by_score_tax'), ('diagnostic', 'select_by_score_unique')) t(pool, strategy)")
def strategy_pools(spark, sf_dir):
    rows = _selected(spark, sf_dir).select("strategy").distinct()
    return files.split_pools(rows, ["select_by_score_ties", "select_by_score_tax"], ["select_by_score_tax", "select_by_score_unique"]).select("pool", "strategy")


@query(f"""WITH {AUDIT}, l AS (SELECT lang, reward, correct, doc_id FROM audit), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY reward DESC, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM l),
q AS (SELECT lang, avg(CAST(correct AS INT)) FILTER (rn <= n // 4) - avg(CAST(correct AS INT)) FILTER (rn > n - n // 4) AS lift FROM r GROUP BY lang HAVING max(n) >= 10)
SELECT array_to_string(list_sort(coalesce(list(lang) FILTER (lift < 0), [])), ',') AS negative, array_to_string(list_sort(coalesce(list(lang) FILTER (lift <= -0.05), [])), ',') AS strong FROM q""")
def lift_warnings(spark, sf_dir):
    a = audit_table(spark, sf_dir)
    langs = ["en", "de", "fr", "es"]
    wide = a.select("doc_id", "correct", *[F.when(F.col("lang") == x, F.col("reward")).alias(x) for x in langs])
    w = audit.lift_warnings(audit.quartile_lift(wide, langs, "correct", "doc_id"))
    return w.select(F.array_join("negative", ",").alias("negative"), F.array_join("strong", ",").alias("strong"))


@query(f"WITH {CAND}, i AS (SELECT sample_id FROM cand GROUP BY 1 HAVING count(DISTINCT raw_text) >= 2) SELECT 'score_ties' AS reward, task, round(avg(score_ties), 6) AS mean, round(stddev_samp(score_ties), 6) AS std, count(*) AS n FROM cand WHERE sample_id IN (SELECT sample_id FROM i) GROUP BY task")
def informative_by_task(spark, sf_dir):
    c = candidates(spark, sf_dir)
    ids = groups.group_facts(c, "sample_id", "candidate_id", "raw_text", "correct").where("informative").select("sample_id")
    return rounded(audit.by_dimension(c.join(ids, "sample_id", "left_semi"), ["score_ties"], "task"))


@query(f"""WITH {CAND}, g AS (SELECT sample_id, max(score_ties) FILTER (candidate_id = 0) AS good, max(score_ties) FILTER (candidate_id = 1) AS b1, max(score_ties) FILTER (candidate_id > 1) AS b2 FROM cand GROUP BY 1)
SELECT count(*) AS n, round(avg(good), 6) AS mean_good, round(avg(b1), 6) AS mean_one, round(avg(b2), 6) AS mean_more, round(avg(CAST(coalesce(good > b1, false) AS INT)), 6) AS beats_one_rate, round(avg(CAST(coalesce(good > b2, false) AS INT)), 6) AS beats_more_rate FROM g""")
def response_check(spark, sf_dir):
    kind = F.when(F.col("candidate_id") == 0, "good").when(F.col("candidate_id") == 1, "one").otherwise("more")
    return rounded(checks.response_check(candidates(spark, sf_dir).withColumn("kind", kind), "sample_id", "kind", "score_ties", "good", ["one", "more"]))


@query("SELECT o_orderkey, probe_group, probe FROM orders, (VALUES ('empty', ''), ('noise', 'asdf'), ('noise', 'banana')) p(probe_group, probe)")
def probes(spark, sf_dir):
    return checks.with_probes(table(spark, sf_dir, "orders").select("o_orderkey"), [("empty", ""), ("noise", "asdf"), ("noise", "banana")])


@query(f"WITH {CAND} SELECT sample_id, candidate_id, round(score_tax - score_ties, 6) AS gap FROM cand WHERE score_tax > score_ties ORDER BY score_tax - score_ties DESC, sample_id * 100 + candidate_id LIMIT 15")
def worst_rows(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("ord", F.col("sample_id") * 100 + F.col("candidate_id"))
    return rounded(checks.failures(c, "score_ties", "score_tax", "ord", 15).select("sample_id", "candidate_id", "gap"))


@query(f"""WITH {CAND} SELECT sample_id, CASE WHEN max(raw_text) = min(raw_text) THEN 'text/raw_response' WHEN count(DISTINCT correct) = 1 THEN 'parse' WHEN max(score_ties) - min(score_ties) < 1e-8 THEN 'final' END AS layer FROM cand GROUP BY 1""")
def collapse_layers(spark, sf_dir):
    no = F.lit(False)
    g = candidates(spark, sf_dir).groupBy("sample_id").agg((F.min("raw_text") == F.max("raw_text")).alias("a"), (F.count_distinct("correct") == 1).alias("b"), (F.max("score_ties") - F.min("score_ties") < 1e-8).alias("c"))
    return g.select("sample_id", groups.collapse_layer(F.col("a"), no, F.col("b"), no, no, no, F.col("c")).alias("layer"))


@query(f"""WITH {CAND}, t AS (SELECT sample_id, raw_text, count(*) AS n, count(*) FILTER (task = 'existence') AS yn, count(*) FILTER (score_ties = 0) AS dup FROM cand GROUP BY 1, 2) SELECT sample_id, round(sum(yn) / sum(n), 6) AS yesno_ratio, round(sum(dup) / sum(n), 6) AS duplicate_rate FROM t GROUP BY 1""")
def diversity_rates(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return rounded(groups.diversity(c, "sample_id", "task", F.col("raw_text"), "answer_length", F.col("task") == "existence", F.col("score_ties") == 0).select("sample_id", "yesno_ratio", "duplicate_rate"))


@query(f"""WITH {CAND}, a AS (SELECT sample_id, score_unique - avg(score_unique) OVER (PARTITION BY sample_id) AS away FROM cand) SELECT sample_id, count(*) FILTER (away > 1e-9) AS n_positive, count(*) FILTER (away < -1e-9) AS n_negative FROM a GROUP BY 1 HAVING count(*) > 1""")
def advantage_signs(spark, sf_dir):
    # a lone candidate's distance is a rounding of zero
    return groups.step_metrics(candidates(spark, sf_dir), "sample_id", "score_unique", "raw_text", "correct").where("n > 1").select("sample_id", "n_positive", "n_negative")


# -- step logs ---------------------------------------------------------------------------------------------

@query(f"""WITH {STEPS} SELECT family, count(*) AS n FROM steps GROUP BY 1""")
def step_histogram(spark, sf_dir):
    return telemetry.histogram(step_table(spark, sf_dir), "family")


@query(f"""WITH {STEPS} SELECT round(count(*) FILTER (reward > 100) / greatest(1, count(*) FILTER (reward > 100 OR reward < 50)), 6) AS yes_rate, round(count(*) FILTER (reward < 50) / greatest(1, count(*) FILTER (reward > 100 OR reward < 50)), 6) AS no_rate FROM steps""")
def yes_rates(spark, sf_dir):
    s = step_table(spark, sf_dir).withColumn("p", F.array(F.when(F.col("reward") > 100, "yes").when(F.col("reward") < 50, "no").otherwise("other")))
    return rounded(telemetry.yes_rates(s, "p"))


@query(f"WITH {STEPS} SELECT round(corr(CAST(json_extract(props, '$.k') AS DOUBLE), reward), 5) AS correlation FROM steps")
def area_correlation(spark, sf_dir):
    s = step_table(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return rounded(telemetry.area_correlation(s, "k", "reward"), 5)


_FACTS = """f AS (SELECT run, avg(CAST(reward > 60 AS INT)) AS a, avg(reward) / 10000 AS b, count(*) AS n, stddev_pop(reward) / 1000 AS c, min(reward) / 1000 AS d FROM steps GROUP BY 1)"""


@query(f"""WITH {STEPS}, {_FACTS}
SELECT run, array_to_string(list_filter([CASE WHEN a > 0.5 THEN 'final_reward_identical' END, CASE WHEN b < 0.01 THEN 'no_negative_advantage' END, CASE WHEN c > 0.10 THEN 'same_answer_diff_reward' END, CASE WHEN d > 0.05 THEN 'invalid_scope' END, CASE WHEN a > 0.30 THEN 'raw_length_correlation' END,
  CASE WHEN c > 0.20 THEN 'debiased_length_correlation' END, CASE WHEN a > 0.40 AND b < 0.10 THEN 'template_rate' END, CASE WHEN c > 0.40 AND b < 0.10 THEN 'abstention_rate' END, CASE WHEN run % 3 = 0 THEN 'kl_zero' END, CASE WHEN n % 2 = 0 THEN 'reward_surge' END], lambda x: x IS NOT NULL), ',') AS issues FROM f""")
def verdicts(spark, sf_dir):
    r = F.col("reward")
    f = step_table(spark, sf_dir).groupBy("run").agg(F.avg((r > 60).cast("int")).alias("a"), (F.avg(r) / 10000).alias("b"), F.count("*").alias("n"), (F.stddev_pop(r) / 1000).alias("c"), (F.min(r) / 1000).alias("d"))
    facts = f.select("run", F.col("a").alias("final_reward_identical_rate"), F.col("b").alias("mean_n_negative_advantage"), F.col("c").alias("same_answer_diff_reward_rate"), F.col("d").alias("mean_invalid_final_answer_rate"), F.col("a").alias("abs_raw_length_corr"),
                     F.col("c").alias("abs_debiased_length_corr"), F.col("a").alias("mean_template_rate"), F.col("c").alias("mean_abstention_rate"), F.col("b").alias("mean_correct_rate"), F.when(F.col("run") % 3 == 0, 0.0).otherwise(1.0).alias("mean_kl"), (F.col("n") % 2 == 0).alias("surge"))
    return telemetry.verdict(facts).select("run", F.array_join("issues", ",").alias("issues"))


# -- kernels -----------------------------------------------------------------------------------------------------

_V = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(f"""WITH {_V}, z AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: exp(x / 0.5))) AS s FROM e), r AS (SELECT vec_id, ln(exp(v[1]) + exp(v[2])) - ln(exp(v[3]) + exp(v[4])) AS a, ln(exp(-v[1]) + exp(-v[2])) - ln(exp(-v[3]) + exp(-v[4])) AS b, v, s FROM z)
SELECT vec_id, round(abs(a - b), 6) AS reward, round(a, 6) AS logodds_orig, round(b, 6) AS logodds_replaced, round((exp(v[1]) + exp(v[2])) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS prob_yes_orig, round(exp(v[1] / 0.5) / s, 6) AS warm,
  round(list_sum(list_transform(v, lambda x: abs(2 * x))) / len(v), 6) AS mean_delta, round(list_max(list_transform(v, lambda x: abs(2 * x))), 6) AS max_delta, round(0.2 + 0.5 * greatest(0, a), 6) AS mixed FROM r""")
def logit_effects(spark, sf_dir):
    v = arrays.doubles(F.col("embedding"))
    idx = lambda *i: F.array(*map(F.lit, i))
    d = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("n", F.transform("v", lambda x: -x))
    e, t = contract.logodds_effect(F.col("v"), F.col("n"), idx(0, 1), idx(2, 3)), arrays.abs_delta(F.col("v"), F.col("n"))
    d = d.select("vec_id", e.alias("e"), F.get(arrays.softmax(F.col("v"), 0.5), F.lit(0)).alias("warm"), t.alias("t"))
    return rounded(d.select("vec_id", "e.reward", "e.logodds_orig", "e.logodds_replaced", "e.prob_yes_orig", "warm", F.col("t.mean").alias("mean_delta"), F.col("t.max").alias("max_delta"), arrays.mixed(F.lit(0.2), F.col("e.logodds_orig"), 0.5).alias("mixed")))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: exp(CAST(x AS DOUBLE))) AS p FROM embeddings), i AS (SELECT vec_id, unnest(p) AS p, unnest(list_reverse(p)) AS q, generate_subscripts(p, 1) AS i FROM e),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rn FROM i) WHERE rn <= 5), n AS (SELECT vec_id, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM t WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, round(sum(0.5 * (p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q)))), 7) AS js FROM n GROUP BY 1""")
def top_divergence(spark, sf_dir):
    p = F.transform(F.slice("embedding", 1, 12), lambda x: F.exp(x.cast("double")))
    d = table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).withColumn("q", F.reverse("p"))
    return rounded(d.select("vec_id", arrays.top_js(F.col("p"), F.col("q"), 5).alias("js")), 7)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(v[1], 6) AS kept, round((v[3] + v[5]) / 2, 6) AS filled, 0.0::DOUBLE AS zeroed FROM e""")
def replaced_vectors(spark, sf_dir):
    v = arrays.doubles(F.col("embedding"))
    seq = F.transform(F.slice(v, 1, 6), lambda x: F.array(x, x * 2))
    idx = lambda *i: F.array(*map(F.lit, i))
    d = table(spark, sf_dir, "embeddings").select("vec_id", arrays.replaced(seq, idx(1, 3), "mean", idx(2, 4)).alias("m"), arrays.replaced(seq, idx(1), "zero").alias("z"))
    return rounded(d.select("vec_id", F.get(F.get("m", F.lit(0)), F.lit(0)).alias("kept"), F.get(F.get("m", F.lit(3)), F.lit(0)).alias("filled"), F.abs(F.get(F.get("z", F.lit(1)), F.lit(1))).alias("zeroed")))
