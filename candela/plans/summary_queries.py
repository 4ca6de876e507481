"""Queries of summaries: data sets, integrity with examples, rewards worked out from raw records, statuses and the registry of what is active."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import dataset, rewards, summaries
from candela.plans.catalog import query, rounded
from candela.plans.pools import RAW, raw_samples
from candela.plans.tables import CAND, candidates, table
from candela.sources import files
from candela.sources.shared import fresh_folder


def _listed(column: str):
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",").alias(column)


def _hist(column: str, name: str) -> str:
    return f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce(nullif(CAST({column} AS VARCHAR), ''), 'unknown') AS k, count(*) AS n FROM s GROUP BY 1)) AS {name}"


@query(f"""WITH {RAW}, s AS (SELECT * FROM canon), p AS (SELECT size, count(*) AS pairs FROM (SELECT pair_id, count(*) AS size FROM s GROUP BY 1) GROUP BY 1)
SELECT (SELECT count(*) FROM raw) AS raw_count, count(*) AS valid_count, (SELECT count(*) FROM raw) - count(*) AS dropped_count, (SELECT CAST(sum(pairs) AS BIGINT) FROM p) AS pair_id_unique, (SELECT string_agg(size || '=' || pairs, ',' ORDER BY size) FROM p) AS pair_id_size_distribution,
  round((SELECT coalesce(sum(pairs) FILTER (size = 2), 0) / sum(pairs) FROM p), 6) AS pair_id_exactly_two_ratio, {_hist('task_type', 'task_type_distribution')}, {_hist('data_split', 'split_distribution')}, {_hist("CASE WHEN gt_present IS NULL THEN 'NoneType' ELSE 'bool' END", 'gt_present_type_distribution')},
  count(*) FILTER (image_file LIKE 'im/%') AS image_path_resolve_ok_count, round(count(*) FILTER (image_file LIKE 'im/%') / count(*), 6) AS image_path_resolve_ok_rate FROM s""")
def dataset_report(spark, sf_dir):
    _, summary = summaries.loaded(raw_samples(spark, sf_dir), F.col("image_file").startswith("im/"))
    maps = ["pair_id_size_distribution", "task_type_distribution", "split_distribution", "gt_present_type_distribution"]
    return rounded(summary.select("raw_count", "valid_count", "dropped_count", "pair_id_unique", "pair_id_exactly_two_ratio", "image_path_resolve_ok_count", "image_path_resolve_ok_rate", *[_listed(m) for m in maps]))


@query(f"""WITH {RAW}, f AS (SELECT * FROM canon ORDER BY ord LIMIT 500), b AS (SELECT pair_id, image_file, row_number() OVER (ORDER BY ord) AS place FROM f WHERE NOT image_file LIKE 'im/%'),
c AS (SELECT count(*) AS checked, count(*) FILTER (image_file LIKE 'im/%') AS ok FROM f) SELECT checked, ok, checked - ok AS missing, round(ok / checked, 6) AS rate, place, pair_id, image_file FROM c, b WHERE place <= 20""")
def integrity_examples(spark, sf_dir):
    # the place in the file is the number in the image's name
    c = dataset.canonical_samples(raw_samples(spark, sf_dir)).withColumn("ord", F.element_at(F.split("image_file", "/"), -1).cast("long"))
    r = summaries.integrity_report(c, F.col("image_file").startswith("im/"), "ord", 500, ["pair_id", "image_file"])
    return rounded(r.select("checked", "ok", "missing", "rate", F.posexplode("bad_path_examples").alias("p", "e")).select("checked", "ok", "missing", "rate", (F.col("p") + 1).cast("long").alias("place"), "e.pair_id", "e.image_file"))


@query(f"""WITH {CAND} SELECT sample_id, candidate_id, score_nan AS reward_logits_js, score_ties AS reward_logits_cosine_dist, score_tax AS reward_layer24_prompt_last_cosine, round(0.3 * score_nan + 0.7 * score_tax, 6) AS reward_mix_js_promptlast, round(0.3 * score_ties + 0.7 * score_tax, 6) AS reward_mix_cosine_promptlast FROM cand""")
def rederived_rewards(spark, sf_dir):
    """Raw metrics written as lines of JSON, read again, and their rewards worked out."""
    path = fresh_folder(spark, "raw_metrics")
    c = candidates(spark, sf_dir).select("sample_id", "candidate_id", F.nanvl(F.col("score_nan"), F.lit(None)).alias("js"), F.col("score_ties").alias("cos"), F.col("score_tax").alias("l24"))
    files.write_jsonl(c, path)
    raw = files.read_jsonl(spark, path, "sample_id long, candidate_id int, js double, cos double, l24 double")
    return rounded(summaries.rederived(raw, "js", "cos", "l24", 0.3, 0.7).drop("js", "cos", "l24"))


_REWARDS = {"reward_logits_js": "score_nan", "reward_logits_cosine_dist": "score_ties", "reward_mix_js_promptlast": "CAST(NULL AS DOUBLE)", "reward_action_logprob_ate_nolabel": "CASE WHEN score_tax < 0.06 THEN -score_tax END",
            "reward_main_correctness_only": "CASE WHEN correct THEN 1.0D ELSE 0.0D END", "reward_main_additive_evidence": "score_unique"}


def _records(spark, sf_dir):
    return candidates(spark, sf_dir).select("sample_id", "candidate_id", "score_tax", "answer_length", *[F.expr(e).cast("double").alias(n) for n, e in _REWARDS.items()])


_ROWS = ", ".join(f"('{name}', {'NULL' if not row[3] else f'{chr(39)}select_by_{name}{chr(39)}'}, {list(sorted(row[4]))}, {'NULL' if row[5] is None else chr(39) + row[5] + chr(39)})" for name, row in rewards.REGISTRY.items() if name in _REWARDS)
_ACTIVE = f"""reg(name, strategy, flags, reason) AS (VALUES {_ROWS}), rec AS (SELECT {', '.join(f'{e.replace("1.0D", "1.0").replace("0.0D", "0.0")} AS {n}' for n, e in _REWARDS.items())} FROM cand),
cov AS ({' UNION ALL '.join(f"SELECT '{n}' AS name, count({n}) AS finite, count(*) AS rows FROM rec" for n in _REWARDS)})"""


@query(f"WITH {CAND}, {_ACTIVE} SELECT name, strategy, finite, round(finite / rows, 6) AS finite_rate, finite > 0 AS active FROM cov JOIN reg USING (name)")
def active_rewards(spark, sf_dir):
    return rounded(summaries.active_rewards(_records(spark, sf_dir), rewards.registry(spark)).select("name", "strategy", "finite", "finite_rate", "active"))


@query(f"""WITH {CAND}, {_ACTIVE}, a AS (SELECT reg.* FROM reg JOIN cov USING (name) WHERE finite > 0), f AS (SELECT unnest(flags) AS flag, name FROM a UNION ALL SELECT 'excluded', name || ': ' || reason FROM a WHERE reason IS NOT NULL)
SELECT flag, string_agg(name, ',' ORDER BY name) AS names FROM f GROUP BY flag""")
def reward_registry(spark, sf_dir):
    return summaries.schema_summary(_records(spark, sf_dir), rewards.registry(spark)).select("flag", F.array_join("names", ",").alias("names"))


@query(f"""WITH {CAND}, r AS (SELECT candidate_id, answer_length, score_tax AS tax, CASE WHEN answer_length % 5 = 1 THEN NULL WHEN score_nan IS NULL THEN 'nan' ELSE 'ok' END AS js, CASE WHEN answer_length % 5 IN (1, 2) THEN NULL WHEN score_tax < 0.02 THEN 'nan' ELSE 'ok' END AS ate FROM cand)
SELECT CASE WHEN candidate_id = 3 THEN 'error' WHEN tax = 0.07 THEN 'unknown_backend' WHEN js IS NULL AND ate IS NULL THEN 'not_computed' WHEN js = 'ok' AND ate = 'ok' THEN 'finite_ok' WHEN 'ok' IN (js, coalesce(ate, 'x')) THEN 'partial_finite' ELSE 'all_nan' END AS status, count(*) AS n FROM r GROUP BY 1""")
def status_histogram(spark, sf_dir):
    none = F.col("answer_length") % 5
    nan = F.lit(float("nan"))
    r = candidates(spark, sf_dir).select("candidate_id", "score_tax", F.when(none != 1, F.coalesce("score_nan", nan)).alias("js"), F.when(~none.isin(1, 2), F.when(F.col("score_tax") < 0.02, nan).otherwise(F.col("score_tax"))).alias("ate"))
    return summaries.statuses(r, ["js", "ate"], F.col("score_tax") != 0.07, F.col("candidate_id") == 3)


@query("""WITH g AS (SELECT o_custkey % 3 AS kind, o_custkey % 50 AS grp, CASE o_custkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN CAST(o_orderkey % 7 AS DOUBLE) ELSE CASE WHEN o_custkey % 50 = 2 THEN CAST(o_orderkey % 7 AS DOUBLE) ELSE 1.0 END END AS reward, CASE o_custkey % 3 WHEN 1 THEN o_orderstatus || (o_orderkey % 5) ELSE 'same' END AS answer FROM orders),
s AS (SELECT kind, grp, max(reward) - min(reward) > 1e-6 AS v, count(DISTINCT answer) <= 1 AS a, stddev_pop(reward) AS sd FROM g GROUP BY 1, 2), t AS (SELECT kind, count(*) AS groups, avg(CAST(v AS INT)) AS r, avg(CAST(a AS INT)) AS i, avg(sd) AS m FROM s GROUP BY 1)
SELECT CAST(kind AS INT) AS kind, groups, round(r, 6) AS nonconstant_rate, round(i, 6) AS identical_answer_rate, array_to_string(list_filter([CASE WHEN r < 0.2 THEN 'reward_constant' END, CASE WHEN i > 0.8 THEN 'answers_collapsed' END, CASE WHEN m < 1e-6 THEN 'no_spread' END], lambda x: x IS NOT NULL), ',') AS reasons, NOT (r < 0.2 OR i > 0.8 OR m < 1e-6) AS passed FROM t""")
def preflight_reasons(spark, sf_dir):
    """Three kinds of groups: of one reward and answer, of many, and of one answer with few that vary."""
    from candela.operators import checks
    o, kind = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3
    some = (F.col("o_orderkey") % 7).cast("double")
    g = o.select(kind.cast("int").alias("kind"), (F.col("o_custkey") % 50).alias("grp"), F.when(kind == 0, 0.5).when(kind == 1, some).otherwise(F.when(F.col("o_custkey") % 50 == 2, some).otherwise(1.0)).alias("reward"),
                 F.when(kind == 1, F.concat("o_orderstatus", (F.col("o_orderkey") % 5).cast("string"))).otherwise("same").alias("answer"))
    per = [checks.preflight(g.where(F.col("kind") == k), "grp", "reward", "answer").withColumn("kind", F.lit(k)) for k in range(3)]
    return rounded(per[0].unionByName(per[1]).unionByName(per[2]).select("kind", "groups", "nonconstant_rate", "identical_answer_rate", F.array_join("reasons", ",").alias("reasons"), "passed"))
