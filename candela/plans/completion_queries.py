"""Queries of completed groups, manifests, nested dumps, and of texts and keys made for samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candela.functions import geometry, text
from candela.operators import completion, contract, evaluate
from candela.plans.catalog import SCORES, _degeneracy_sql, query, rounded
from candela.plans.tables import CAND, candidates, table
from candela.sources import files
from candela.sources.shared import fresh_folder


@query(f"""WITH {CAND}, u AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY candidate_id) - 1 AS id, raw_text FROM cand WHERE score_ties < 0.05), n AS (SELECT s.sample_id, count(u.id) AS u FROM (SELECT DISTINCT sample_id FROM cand) s LEFT JOIN u USING (sample_id) GROUP BY 1),
s AS (SELECT sample_id, u, unnest(range(greatest(u, 4))) AS slot FROM n), f AS (SELECT *, CASE WHEN slot < u THEN slot WHEN u > 0 THEN (slot - u) % u END AS source FROM s)
SELECT f.sample_id, CAST(slot AS INT) AS candidate_id, raw_text, slot >= u AS is_duplicate_candidate, CAST(CASE WHEN slot >= u THEN source END AS INT) AS duplicate_of_candidate_id, CAST(u AS INT) AS n_unique_candidates_before_fill, u >= 2 AS min_unique_satisfied, u < 4 AS duplicate_fill_applied, CAST(greatest(u, 4) AS INT) AS n_candidates_post_fill
FROM f LEFT JOIN u ON u.sample_id = f.sample_id AND u.id = f.source""")
def completed_groups(spark, sf_dir):
    c = candidates(spark, sf_dir)
    w = Window.partitionBy("sample_id").orderBy("candidate_id")
    unique = c.where("score_ties < 0.05").select("sample_id", (F.row_number().over(w) - 1).alias("candidate_id"), "raw_text")
    out = completion.completed(c.select("sample_id"), unique, "sample_id", 4, least=2)
    return out.drop("n_sampling_rounds", "min_unique_candidates", "requested_num_candidates", "allow_duplicate_fill")


@query(f"""WITH {CAND}, k AS (SELECT sample_id, count(*) AS n FROM cand GROUP BY 1), p AS (SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, (list(n ORDER BY n))[count(*) // 2 + 1] AS upper_median FROM k)
SELECT name, rows, hashed, least, most, mean, upper_median FROM (SELECT 'candidates' AS name, count(*) AS rows, true AS hashed FROM cand UNION ALL SELECT 'right', count(*) FILTER (correct), true FROM cand UNION ALL SELECT 'missing', -1, false), p""")
def run_manifest(spark, sf_dir):
    c, folder = candidates(spark, sf_dir), fresh_folder(spark, "run")
    files.write_jsonl(c.select("sample_id", "candidate_id", "raw_text"), f"{folder}/candidates")
    files.write_jsonl(c.where("correct").select("sample_id", "candidate_id"), f"{folder}/right")
    m = completion.run_manifest(spark, {n: f"{folder}/{n}" for n in ("candidates", "right", "missing")}, c, "sample_id")
    return rounded(m.select("name", "rows", (F.length("md5") == 32).alias("hashed"), "least", "most", "mean", "upper_median"))


@query(f"WITH d AS ({_degeneracy_sql()}) SELECT count(*) AS rewards, count(*) FILTER (is_degenerate) AS degenerate, bool_and(is_degenerate) AS all_degenerate FROM d")
def degeneracy_verdict(spark, sf_dir):
    return evaluate.all_degenerate(evaluate.degeneracy(candidates(spark, sf_dir), "sample_id", "candidate_id", SCORES))


@query(f"""WITH {CAND}, f AS (SELECT DISTINCT sample_id FROM cand ORDER BY 1 LIMIT 50) SELECT sample_id, string_agg(candidate_id || ':' || raw_text || ':' || answer_length, '|' ORDER BY candidate_id) AS samples FROM cand WHERE sample_id IN (SELECT sample_id FROM f) GROUP BY 1""")
def nested_dump(spark, sf_dir):
    n = files.nested_groups(candidates(spark, sf_dir), "sample_id", "candidate_id", ["raw_text", "answer_length"], 50)
    return n.select("sample_id", F.array_join(F.transform("samples", lambda s: F.concat_ws(":", s["candidate_id"].cast("string"), s["raw_text"], s["answer_length"].cast("string"))), "|").alias("samples"))


def _number(x: str) -> str:
    return f"CASE WHEN abs({x} - round_even({x}, 0)) < 1e-6 THEN CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {x}) END"


_QUESTION = "CASE p_partkey % 3 WHEN 0 THEN 'What is in [bbox]?' WHEN 1 THEN p_name ELSE '[bbox] or [bbox]' END"


@query(f"""WITH p AS (SELECT p_partkey, p_size, p_retailprice, {_QUESTION} AS q, '[' || {_number("CAST(p_size AS DOUBLE)")} || ', ' || {_number("p_size + 0.25")} || ', ' || {_number("p_retailprice")} || ', ' || {_number("p_size / 4.0")} || ']' AS box FROM part)
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN q ELSE replace(q, '[bbox]', box) END AS question, CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE 'proposal_seed' END AS seed FROM p JOIN part USING (p_partkey, p_size)""")
def question_texts(spark, sf_dir):
    size = F.col("p_size").cast("double")
    box = F.when(F.col("p_size") % 5 != 0, F.array(size, size + 0.25, F.col("p_retailprice").cast("double"), size / 4))
    p = table(spark, sf_dir, "part")
    seed = geometry.seed_key(F.when(F.col("p_size") % 4 == 0, F.col("p_name")).when(F.col("p_size") % 4 == 1, "").otherwise(F.lit(None)), F.when(F.col("p_size") % 4 == 1, F.col("p_partkey")))
    return p.select("p_partkey", text.question_text(F.expr(_QUESTION), box).alias("question"), seed.alias("seed"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'object ' || p_partkey ELSE 'Final answer: object ' || p_partkey END AS graded FROM part""")
def graded_texts(spark, sf_dir):
    raw = F.concat(F.lit(" Final answer: object "), F.col("p_partkey").cast("string"), F.lit("\n"))
    p = table(spark, sf_dir, "part").withColumn("raw", raw).withColumn("found", text.final_answer(F.col("raw")))
    return p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, contract.answer_text(F.col("raw"), F.col("found"), "final_answer")).otherwise(contract.answer_text(F.col("raw"), F.col("found"), "raw_response")).alias("graded"))
