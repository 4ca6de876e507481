"""Queries of the text and grading functions over answers made of the table part, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions import style, text
from candela.operators import contract, dataset, rewards
from candela.plans.catalog import query, rounded
from candela.plans.tables import table

# -- the answers, in Spark and as SQL -----------------------------------------------------

#: {n}: p_name, {s}: p_size, {w}: the number word of p_size % 21
ANSWERS = ["Yes.", "No, it is {n}", "I am not sure, yes", "well, yes it is", "yes and no", "", None, "{w} items", "{s} dogs!", "-{s}", "00{s}.", "The {n}s", "n/a", "cannot determine {n}", "a Sofa and the bikes", "{n}", "  NO  ", "There are {w}"]
GOLDS = ["yes", "no", "{s}", "{n}", "{w}", "couch and bicycle", ""]
LABELS = ["existence", " YesNo ", "counting", "count_exclusion", "Spatial", "location", "attribute", "description", "occlusion", "multihop_cross", "attr_conjunction", "finegrained", "action_state", "cooccur_bait", "interaction", "relation", "zzz", "", None, "probe", "other", "recount", "colorful", "in_front"]
QUESTIONS = ["How many dogs?", "What number of cats?", "Is it red?", "can't you see?", "Where is it?", "what is behind it?", "Which object is it?", "What color is it?", "Describe it", "Name it", "", "  HAS it legs?", "Howmany?"]
PHRASES = text.UNCERTAIN


def _filled(template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    word = F.element_at(F.array(*map(F.lit, text.NUMBER_WORDS)), F.col("p_size") % 21 + 1)
    out = F.lit(template)
    for mark, value in (("{n}", F.col("p_name")), ("{s}", F.col("p_size").cast("string")), ("{w}", word)):
        if mark in template:
            out = F.replace(out, F.lit(mark), value)
    return out


def _case(templates: list[str | None], k: Column) -> Column:
    return F.get(F.array(*[_filled(t) for t in templates]), F.pmod(k, F.lit(len(templates))).cast("int"))


def _quoted(t: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if t is None else "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_WORD = "[" + ", ".join(f"'{w}'" for w in text.NUMBER_WORDS) + "]"


def _sql_case(templates: list[str | None], k: str) -> str:
    return (f"replace(replace(replace(([{', '.join(_quoted(t) for t in templates)}])[CAST({k} % {len(templates)} AS INT) + 1], '{{n}}', p_name), "
            f"'{{s}}', CAST(p_size AS VARCHAR)), '{{w}}', {_WORD}[p_size % 21 + 1])")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    present = F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False)
    return p.select("p_partkey", "p_name", "p_size", "p_retailprice", _case(ANSWERS, k).alias("answer"), _case(GOLDS, k).alias("gold"), _case(LABELS, k).alias("label"), _case(QUESTIONS, k).alias("question"), present.alias("present"))


ANS = f"""ans AS (SELECT p_partkey, p_name, p_size, p_retailprice, {_sql_case(ANSWERS, 'p_partkey')} AS answer, {_sql_case(GOLDS, 'p_partkey')} AS gold, {_sql_case(LABELS, 'p_partkey')} AS label, {_sql_case(QUESTIONS, 'p_partkey')} AS question,
  CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS present FROM part)"""


# -- SQL readings of the functions -----------------------------------------------------------

def low(x: str) -> str:
    return f"trim(lower(coalesce({x}, '')))"


def first_token(x: str) -> str:
    return f"""trim(regexp_extract({low(x)}, '^([^ ]+)', 1), '"''`([{{<)]}}>.,!?;:-_/\\')"""


_OPEN = "'\\b(" + "|".join(PHRASES).replace("'", "''") + ")\\b'"


def yesno(x: str, source: bool = False) -> str:
    f, t = first_token(x), low(x)
    both = [("other", "other"), ("yes", "first_token"), ("no", "first_token"), ("other", "uncertain"), ("yes", "boundary_regex"), ("no", "boundary_regex")]
    conditions = [f"{t} = ''", f"{f} = 'yes'", f"{f} = 'no'", f"regexp_matches({t}, {_OPEN})", f"regexp_matches({t}, '\\byes\\b') AND NOT regexp_matches({t}, '\\bno\\b')", f"regexp_matches({t}, '\\bno\\b') AND NOT regexp_matches({t}, '\\byes\\b')"]
    return "CASE " + " ".join(f"WHEN {c} THEN '{b[source]}'" for c, b in zip(conditions, both)) + " ELSE 'other' END"


def words(x: str, drop: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace({low(x)}, '{drop}', ' ', 'g'), '\\s+'), lambda t: t <> '')"


def exact(x: str) -> str:
    return (f"array_to_string(list_transform({words(x, '[^\\w\\s]')}, lambda t: CASE WHEN list_contains({_WORD}, t) THEN CAST(list_position({_WORD}, t) - 1 AS VARCHAR) "
            f"WHEN regexp_full_match(t, '[0-9]+') THEN CAST(CAST(t AS BIGINT) AS VARCHAR) ELSE t END), ' ')")


def count(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({exact(x)}, '([0-9]+)', 1), '') AS BIGINT)"


_SYN = ("CASE WHEN s IN ('bike', 'bikes', 'bicycle', 'bicycles') THEN 'bicycle' WHEN s IN ('tv', 'television') THEN 'television' WHEN s IN ('sofa', 'couch') THEN 'couch' "
        "WHEN s IN ('cellphone', 'smartphone', 'phone') THEN 'phone' WHEN s IN ('aeroplane', 'airplane', 'plane') THEN 'airplane' ELSE s END")


def label(x: str) -> str:
    kept = f"list_filter({words(x, '[^a-z0-9\\s]')}, lambda t: t NOT IN ('a', 'an', 'the'))"
    single = f"list_transform({kept}, lambda t: CASE WHEN t LIKE '%s' AND length(t) > 3 THEN left(t, length(t) - 1) ELSE t END)"
    return f"array_to_string(list_filter(list_transform({single}, lambda s: {_SYN}), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')"


def family_of_label(x: str) -> str:
    t = low(x)
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.FAMILY_ALIASES.items())
    parts = " ".join(f"WHEN regexp_matches({t}, '{'|'.join(ps)}') THEN '{f}'" for f, ps in text.FAMILY_PARTS)
    return f"coalesce(CASE {t} WHEN '' THEN '' {known} WHEN 'other' THEN 'other' END, CASE {parts} ELSE 'other' END)"


def family(x: str, q: str) -> str:
    opened = ("CASE WHEN regexp_matches(l, '^(how\\s+many|what\\s+number\\s+of)\\b') THEN 'counting' WHEN regexp_matches(l, '^(is|are|was|were|do|does|did|has|have|had|can|could|would|should|will|won''t|can''t)\\b') THEN 'existence' "
              "WHEN regexp_matches(l, '^(where|what is located|what is between|what is behind|what is in front of|what is occluding|which object is)\\b') THEN 'spatial' "
              "WHEN regexp_matches(l, '^(describe|what color|what kind|what material|what state|what condition|what does the)\\b') THEN 'attribute' ELSE 'other' END").replace("(l,", f"({low(q)},")
    return f"coalesce(nullif({family_of_label(x)}, ''), {opened})"


def score(p: str, g: str, fam: str) -> str:
    return (f"CASE {fam} WHEN 'existence' THEN CAST({yesno(p)} IN ('yes', 'no') AND {yesno(p)} = {yesno(g)} AS INT) WHEN 'counting' THEN CAST(coalesce({count(p)} = {count(g)}, false) AS INT) "
            f"ELSE CAST({exact(p)} <> '' AND {exact(p)} = {exact(g)} AS INT) END * 1.0::DOUBLE")


def near_label(p: str, g: str) -> str:
    a, b = f"string_split({label(p)}, ' ')", f"string_split({label(g)}, ' ')"
    return f"({label(p)} <> '' AND {label(g)} <> '' AND (list_has_all({a}, {b}) OR list_has_all({b}, {a})))"


def count_label(x: str) -> str:
    few = "[" + ", ".join(f"'{w}'" for w in text.COUNT_WORDS) + "]"
    return f"coalesce(TRY_CAST(nullif(regexp_extract({label(x)}, '([0-9]+)', 1), '') AS BIGINT), CAST(nullif(list_position({few}, split_part({label(x)}, ' ', 1)), 0) - 1 AS BIGINT))"


# -- queries ------------------------------------------------------------------------------------

@query(f"WITH {ANS} SELECT p_partkey, {first_token('answer')} AS first, regexp_matches({low('answer')}, {_OPEN}) AS open, {yesno('answer')} AS label, {yesno('answer', True)} AS source FROM ans")
def answers_yesno(spark, sf_dir):
    a = F.col("answer")
    both = text.yesno_with_source(a)
    return answers(spark, sf_dir).select("p_partkey", text.first_token(a).alias("first"), text.uncertain(a).alias("open"), both["label"].alias("label"), both["source"].alias("source"))


@query(f"WITH {ANS} SELECT p_partkey, {exact('answer')} AS form, {count('answer')} AS number, CAST({exact('answer')} <> '' AND {exact('answer')} = {exact('gold')} AS INT) * 1.0::DOUBLE AS same, {label('answer')} AS label, {count_label('answer')} AS label_number, {near_label('answer', 'gold')} AS near FROM ans")
def answers_exact(spark, sf_dir):
    a, g = F.col("answer"), F.col("gold")
    return answers(spark, sf_dir).select("p_partkey", text.exact_form(a).alias("form"), text.count_exact(a).cast("bigint").alias("number"), text.exact_match(a, g).alias("same"), text.label_form(a).alias("label"),
                                         text.count_label(a).cast("bigint").alias("label_number"), text.attribute_match(a, g).alias("near"))


@query(f"""WITH {ANS} SELECT p_partkey, {family_of_label('label')} AS named, {family('label', 'question')} AS family, {family("coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN 'Count ' ELSE ' ' END), ''), label)", 'question')} AS hinted,
  {family_of_label('label')} IN ('counting', 'attribute', 'spatial') AS evidence, {family_of_label('label')} = 'existence' AS probe FROM ans""")
def answers_families(spark, sf_dir):
    l, q = F.col("label"), F.col("question")
    hint = F.when(F.col("p_size") % 2 == 0, "Count ").otherwise(" ")
    return answers(spark, sf_dir).select("p_partkey", text.family_label(l).alias("named"), text.task_family(l, q).alias("family"), text.task_family(l, q, hint).alias("hinted"), text.allows_evidence(l).alias("evidence"), text.probe_only(l).alias("probe"))


@query(f"WITH {ANS}, f AS (SELECT *, {family('label', 'question')} AS fam FROM ans) SELECT p_partkey, fam AS family, {score('answer', 'gold', 'fam')} AS score FROM f")
def answers_scores(spark, sf_dir):
    fam = text.task_family(F.col("label"), F.col("question"))
    return answers(spark, sf_dir).select("p_partkey", fam.alias("family"), text.answer_score(F.col("answer"), F.col("gold"), fam).alias("score"))


def _open(p: str, g: str, fam: str) -> str:
    return f"CASE {fam} WHEN 'counting' THEN coalesce({count_label(p)} = {count_label(g)}, false) WHEN 'attribute' THEN {near_label(p, g)} ELSE {label(p)} = {label(g)} END"


@query(f"""WITH {ANS}, f AS (SELECT *, {family('label', "''")} AS fam, {yesno('answer')} AS yn, {yesno('gold')} AS gyn, {_open('answer', 'gold', family('label', "''"))} AS own, CASE WHEN label = 'attribute' THEN {near_label('answer', 'p_name')} ELSE {_open('answer', 'p_name', family('label', "''"))} END AS alias FROM ans),
b AS (SELECT p_partkey, coalesce(label = 'existence', false) OR gyn <> 'other' AS closed, CASE WHEN yn = 'other' THEN 'other' WHEN present THEN CASE WHEN yn = 'yes' THEN 'correct_positive' ELSE 'miss' END WHEN yn = 'no' THEN 'correct_negative' ELSE 'hallucination' END AS c, own, alias, coalesce(present, false) AS here FROM f)
SELECT p_partkey, CASE WHEN closed THEN c WHEN own THEN 'correct_positive' WHEN here THEN 'miss' ELSE 'hallucination' END AS behavior, CASE WHEN closed THEN c WHEN own OR alias THEN 'correct_positive' WHEN here THEN 'miss' ELSE 'hallucination' END AS with_alias,
  CASE WHEN closed THEN c WHEN own THEN 'correct_positive' WHEN here THEN 'miss' ELSE 'hallucination' END IN ('correct_positive', 'correct_negative') AS correct FROM b""")
def answers_behavior(spark, sf_dir):
    a, g, h, l = (F.col(c) for c in ("answer", "gold", "present", "label"))
    b = text.behavior(a, g, h, l)
    return answers(spark, sf_dir).select("p_partkey", b.alias("behavior"), text.behavior(a, g, h, l, F.array("p_name")).alias("with_alias"), text.behavior_is_correct(b).alias("correct"))


@query(f"""WITH {ANS}, f AS (SELECT *, {family('label', 'question')} AS fam, {yesno('gold')} IN ('yes', 'no') AS yn, {count('gold')} IS NOT NULL AS num FROM ans),
r AS (SELECT p_partkey, fam, CASE WHEN fam NOT IN ('counting', 'existence') THEN 'family_not_allowed' WHEN fam = 'counting' THEN CASE WHEN num THEN 'ok' ELSE 'counting_gt_not_integer' END WHEN yn THEN 'ok' ELSE 'existence_gt_not_yesno' END AS reason FROM f)
SELECT p_partkey, reason = 'ok' AS keep, fam AS family, reason FROM r""")
def answers_slices(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", text.slice_decision(F.col("question"), F.col("label"), F.col("gold")).alias("d")).select("p_partkey", "d.*")


@query(f"""WITH {ANS}, f AS (SELECT *, {family('label', 'question')} AS fam, {yesno('answer')} AS yn, regexp_replace({low('answer')}, '\\s+', ' ', 'g') AS s FROM ans)
SELECT p_partkey, CASE WHEN s = '' THEN '' WHEN fam = 'existence' AND yn <> 'other' THEN yn WHEN fam = 'counting' AND regexp_matches(s, '[0-9]') THEN regexp_extract(s, '(-?[0-9]+)', 1) ELSE s END AS key,
  CASE WHEN fam = 'existence' AND present IS NOT NULL THEN yn <> 'other' AND (yn = 'yes') = present END AS right_yesno,
  CASE fam WHEN 'existence' THEN yn WHEN 'counting' THEN coalesce(CAST({count('answer')} AS VARCHAR), 'other') ELSE coalesce(nullif({exact('answer')}, ''), 'other') END AS parsed FROM f""")
def answers_keys(spark, sf_dir):
    a, fam = F.col("answer"), text.task_family(F.col("label"), F.col("question"))
    return answers(spark, sf_dir).select("p_partkey", text.dedup_key(a, fam).alias("key"), text.yesno_correct(text.yesno(a), F.col("present"), fam).alias("right_yesno"), text.parse_label(a, fam).alias("parsed"))


@query(f"""WITH {ANS}, f AS (SELECT *, {family('label', 'question')} AS fam, nullif(trim(gold), '') AS g0 FROM ans), k AS (SELECT *, coalesce(g0, CASE WHEN fam = 'existence' THEN CASE present WHEN true THEN 'yes' WHEN false THEN 'no' END END) AS g FROM f),
s AS (SELECT p_partkey, g IS NOT NULL AS known, CASE WHEN g IS NULL THEN 0.0::DOUBLE ELSE {score('answer', 'g', 'fam')} END AS score FROM k)
SELECT p_partkey, known, score, CASE WHEN NOT known THEN 0.0::DOUBLE WHEN score >= 1 THEN 1.0 ELSE -0.25 END AS reward, CASE WHEN known THEN score >= 1 END AS correct FROM s""")
def answers_correctness(spark, sf_dir):
    fam = text.task_family(F.col("label"), F.col("question"))
    return answers(spark, sf_dir).select("p_partkey", rewards.correctness(F.col("answer"), F.col("gold"), F.col("present"), fam).alias("c")).select("p_partkey", "c.*")


@query(f"""WITH {ANS}, f AS (SELECT *, {family('label', 'question')} = 'existence' AND (present IS NOT NULL OR {yesno('gold')} IN ('yes', 'no')) AS sup FROM ans)
SELECT p_partkey, sup AS supervised, CASE WHEN sup THEN 'action_logprob_ate_supervised' ELSE 'action_logprob_ate_nolabel' END AS backend, CASE WHEN sup THEN p_retailprice ELSE p_size * 1.0 END AS reward, CASE WHEN sup THEN 'supervised_shaped_reward' ELSE 'score_base_no_label' END AS field,
  CASE WHEN sup THEN 'response_conditioned_supervised_ate' ELSE 'response_conditioned_final_answer_ate' END AS semantics, sup AS uses_gt FROM f""")
def reward_backends(spark, sf_dir):
    has = contract.supervised(F.col("label"), F.col("question"), F.col("present"), F.col("gold"))
    b = contract.backend_of("auto", has)
    used = contract.used_reward(b, F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(0.0))
    return answers(spark, sf_dir).select("p_partkey", has.alias("supervised"), b.alias("backend"), used.alias("u")).select("p_partkey", "supervised", "backend", "u.reward", "u.field", "u.semantics", "u.uses_gt")


@query(f"""WITH {ANS}, f AS (SELECT *, {family('label', 'question')} AS fam FROM ans), i AS (SELECT *, CASE fam WHEN 'existence' THEN 'For yes/no questions, the final answer must be exactly yes or no.' WHEN 'counting' THEN 'For counting questions, the final answer must be a single integer or number phrase.'
  WHEN 'spatial' THEN 'For spatial questions, the final answer must be a short noun phrase or location phrase.' WHEN 'attribute' THEN 'For attribute or description questions, the final answer must be a concise attribute phrase.' ELSE 'Keep the final answer short, specific, and directly grounded in the image.' END AS said FROM f)
SELECT p_partkey, question AS plain, CASE WHEN question = '' THEN '' ELSE {_quoted(contract.ANSWER_ONLY)} || said || chr(10) || chr(10) || 'Question: ' || question END AS answer_only, CASE WHEN question = '' THEN '' ELSE {_quoted(contract.WITH_EVIDENCE)} || said || chr(10) || chr(10) || 'Question: ' || question END AS with_evidence,
  trim(coalesce(answer, '')) AS as_is, rtrim('Evidence:' || chr(10) || 'Final answer: ' || trim(coalesce(answer, ''))) AS wrapped, CASE WHEN fam IN ('existence', 'counting') AND p_size > 1 THEN 2 ELSE 0 END AS least FROM i""")
def prompts(spark, sf_dir):
    q, l, a = F.col("question"), F.col("label"), F.col("answer")
    return answers(spark, sf_dir).select("p_partkey", contract.prompt(q, l).alias("plain"), contract.prompt(q, l, "final_answer_only_v1").alias("answer_only"), contract.prompt(q, l, "task_aware_v1").alias("with_evidence"),
                                         contract.structured(a).alias("as_is"), contract.structured(a, "task_aware_v1").alias("wrapped"), F.when(q == "", contract.least_different(l, F.col("p_size"))).otherwise(contract.least_different(F.when(text.family_label(l) == "", text.task_family(l, q)).otherwise(l), F.col("p_size"))).alias("least"))


@query(f"WITH {ANS} SELECT p_partkey, CASE {low('answer')} WHEN 'yes' THEN true WHEN 'no' THEN false ELSE CASE WHEN regexp_full_match({low('answer')}, '-?[0-9]+\\.?') THEN CAST(replace({low('answer')}, '.', '') AS BIGINT) <> 0 END END AS b FROM ans")
def to_bools(spark, sf_dir):
    return answers(spark, sf_dir).select("p_partkey", dataset.to_bool(F.col("answer")).alias("b"))


# -- responses: an answer put into a form, and found again ------------------------------------------

_LONG = "this line of the response goes on and on for so many words that nobody would call it short"
#: form, prefix of the answer in it, and the rule that finds it; {a}: the answer
FORMS = [
    ("Evidence: the {n}\nFinal answer: {a}", "Evidence: the {n}\nFinal answer: ", "structured_tag"), ("Answer: {a}", "Answer: ", "answer_tag"), ("final  answer：{a}", "final  answer：", "structured_tag"),
    ("Evidence: the {n}\n{a}", "Evidence: the {n}\n", "two_line_evidence"), ("{a}", "", "single_line_short"), (_LONG + "\n- {a}", _LONG + "\n- ", "last_short_line"), ("Final answer: `{a}`", "Final answer: `", "structured_tag"),
    ("Final answer:\n" + _LONG + "\nFinal answer:\n{a}", "Final answer:\n" + _LONG + "\nFinal answer:\n", "final_answer_next_line"), ("Answer:\n" + _LONG + "\nAnswer:\n{a}", "Answer:\n" + _LONG + "\nAnswer:\n", "answer_next_line"),
]


def _put(template: str, k: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{n}"), F.col("p_name")), F.lit("{a}"), F.concat(F.lit("object "), F.col("p_partkey").cast("string")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response to each part, whose answer is ``object`` and its key; every tenth is one long line without a form."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name", "p_size", F.get(F.array(*[_put(f, F.col("p_partkey")) for f, _, _ in FORMS], _put(_LONG + " {a}", F.col("p_partkey"))), (F.col("p_partkey") % 10).cast("int")).alias("response"))


def _sql_put(templates: list[str]) -> str:
    return f"replace(replace(([{', '.join(_quoted(t) for t in templates)}])[CAST(p_partkey % 10 AS INT) + 1], '{{n}}', p_name), '{{a}}', 'object ' || p_partkey)"


@query(f"SELECT p_partkey, {_sql_put(['{a}'] * 9 + [_LONG + ' {a}'])} AS answer, ([{', '.join(_quoted(s) for _, _, s in FORMS)}, 'fallback_raw'])[CAST(p_partkey % 10 AS INT) + 1] AS source, {_sql_put([p for _, p, _ in FORMS] + [''])} AS prefix, CASE WHEN p_partkey % 10 < 9 THEN length({_sql_put([p for _, p, _ in FORMS] + [''])}) END AS start FROM part")
def final_answers(spark, sf_dir):
    found = text.final_answer(F.col("response"))
    return responses(spark, sf_dir).select("p_partkey", "response", found.alias("f")).select("p_partkey", "f.answer", "f.source", text.answer_prefix(F.col("response"), F.col("f")).alias("prefix"), F.col("f.start").cast("bigint").alias("start"))


@query(f"""SELECT p_partkey, {_sql_put(['{a}'] * 9 + [_LONG + ' {a}'])} AS generated_text, CAST(CASE WHEN p_partkey % 10 < 9 THEN 2 ELSE 21 END AS INT) AS answer_length, CAST(length({_sql_put(['{a}'] * 9 + [_LONG + ' {a}'])}) AS INT) AS answer_char_length, false AS is_yesno,
  round(-(p_size + 1) / 2.0, 6) AS mean_logprob, round(-p_size * (p_size + 1) / 2.0, 6) AS sum_logprob, CASE WHEN p_size > 40 THEN NULL ELSE -1.0 * p_size END AS answer_mean FROM part""")
def candidate_rows(spark, sf_dir):
    lp = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: -i.cast("double"))
    own = F.when(F.col("p_size") > 40, F.slice(lp, 1, 0)).otherwise(F.array(-F.col("p_size").cast("double")))
    c = contract.candidate_row(F.col("response"), text.final_answer(F.col("response")), lp, own)
    flat = responses(spark, sf_dir).where("p_size > 0").select("p_partkey", c.alias("c"))
    return rounded(flat.select("p_partkey", "c.generated_text", "c.answer_length", "c.answer_char_length", "c.is_yesno", "c.mean_logprob", "c.sum_logprob", F.nanvl("c.final_answer_mean_logprob", F.lit(None)).alias("answer_mean")))


@query(f"""WITH r AS (SELECT p_partkey, {_sql_put([f for f, _, _ in FORMS] + [_LONG + ' {a}'])} AS response, {_sql_put([p for _, p, _ in FORMS] + [''])} AS prefix FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN 'invalid_final_answer' ELSE 'final_answer' END AS effective, CASE WHEN p_partkey % 10 = 9 THEN 'missing_char_span(source=fallback_raw)' ELSE '' END AS reason, CASE WHEN p_partkey % 10 = 9 THEN '' ELSE 'object ' || p_partkey END AS target,
  CASE WHEN p_partkey % 10 < 9 THEN CAST(length(prefix) // 3 AS INT) END AS first, CASE WHEN p_partkey % 10 < 9 THEN CAST((length(prefix) + length('object ' || p_partkey) - 1) // 3 AS INT) END AS last FROM r""")
def policy_scopes(spark, sf_dir):
    r = F.col("response")
    tokens = F.transform(F.sequence(F.lit(0), F.floor((F.length(r) - 1) / 3).cast("int")), lambda i: F.substr(r, i * 3 + 1, F.lit(3)))
    s = responses(spark, sf_dir).select("p_partkey", contract.policy_scope(r, tokens).alias("s"))
    return s.select("p_partkey", "s.effective", "s.reason", "s.target", F.array_min("s.indices").alias("first"), F.array_max("s.indices").alias("last"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'prompt_last' WHEN p_size % 7 = 1 THEN 'answer_first' ELSE 'answer_span' END AS mode, CASE WHEN p_size % 7 < 2 THEN p_size % 7 ELSE least(4, p_size % 7) END AS span, least(4, p_size % 7) AS fixed FROM part""")
def key_modes(spark, sf_dir):
    n = F.col("p_size") % 7
    return table(spark, sf_dir, "part").select("p_partkey", contract.key_mode("auto", n)["mode"].alias("mode"), contract.key_mode("auto", n)["span"].alias("span"), contract.key_mode("answer_span", n)["span"].alias("fixed"))


# -- style -----------------------------------------------------------------------------------------------

#: answer and response, {n}: p_name
STYLED = [("{n}", "Evidence: ...\nFinal answer: {n}"), ("can't tell", "can't tell"), ("n/a", "n/a"), ("two", "two"), ("", "Evidence:\nFinal answer: <x>"), ("no", "no"), ("42", "Evidence: seen\nFinal answer: 42"), ("not visible", "Evidence: <thing>\nFinal answer: not visible"),
          ("a very long answer about {n} that goes on", "a very long answer about {n} that goes on"), ("<answer>", "Final answer: <answer>"), ("", "Evidence: ...")]
TASKS = ["existence", "counting", "attribute", "spatial", "zzz"]


@query(f"""WITH s AS (SELECT p_partkey, p_size % 4 = 0 AS fail, ([{', '.join(f"'{t}'" for t in TASKS)}])[CAST(p_partkey % 5 AS INT) + 1] AS task, replace(([{', '.join(_quoted(a) for a, _ in STYLED)}])[CAST(p_partkey % 11 AS INT) + 1], '{{n}}', p_name) AS a, replace(([{', '.join(_quoted(r) for _, r in STYLED)}])[CAST(p_partkey % 11 AS INT) + 1], '{{n}}', p_name) AS r, CAST(p_partkey % 11 AS INT) AS k FROM part),
f AS (SELECT *, len(list_filter(string_split_regex(CASE WHEN a = '' THEN r ELSE a END, '\\s+'), lambda t: t <> '')) AS n, CASE WHEN task IN ('existence', 'counting') THEN 2 WHEN task = 'attribute' THEN 4 ELSE 6 END AS hi, CASE WHEN task = 'spatial' THEN 2 ELSE 1 END AS lo, k IN (0, 4, 6, 7, 10) AS has_evidence, k = 4 AS missing, k IN (0, 4, 7, 10) AS ev_placeholder, k IN (1, 2, 7) AS abstention FROM s),
v AS (SELECT *, greatest(0, n - hi) + greatest(0, lo - n) AS excess, k IN (1, 5, 7) AS negation, k = 5 AS yesno_short, k IN (3, 6) AS numeric_short FROM f)
SELECT p_partkey, CAST(n AS INT) AS length_tokens, CAST(excess AS INT) AS length_excess, negation AS has_negation, abstention AS is_abstention_like, fail AS is_parse_fail, numeric_short AS is_numeric_short, yesno_short AS is_yesno_short, has_evidence AS has_evidence_field, missing AS evidence_missing, ev_placeholder AS evidence_placeholder FROM v""")
def style_flags(spark, sf_dir):
    return _styled(spark, sf_dir).select("p_partkey", "f.length_tokens", "f.length_excess", "f.has_negation", "f.is_abstention_like", "f.is_parse_fail", "f.is_numeric_short", "f.is_yesno_short", "f.has_evidence_field", "f.evidence_missing", "f.evidence_placeholder")


def _styled(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), (F.col("p_partkey") % 11).cast("int")
    put = lambda side: F.replace(F.get(F.array(*[F.lit(x[side]) for x in STYLED]), k), F.lit("{n}"), F.col("p_name"))
    task = F.get(F.array(*map(F.lit, TASKS)), (F.col("p_partkey") % 5).cast("int"))
    rows = p.select("p_partkey", put(0).alias("generated_text"), put(1).alias("raw_generated_text"), task.alias("task_type"), (F.col("p_size") % 4 == 0).alias("is_parse_fail"))
    return rows.withColumn("f", contract.style_view(rows))


@query("""WITH s AS (SELECT p_partkey, CAST(p_partkey % 11 AS INT) AS k, p_size % 4 = 0 AS fail FROM part),
r AS (SELECT p_partkey, k, fail, list_filter([CASE WHEN k IN (2) THEN 'abstention_like' END, CASE WHEN k IN (2, 4, 9) THEN 'placeholder_answer' END, CASE WHEN k IN (4, 9) THEN 'placeholder_schema' END, CASE WHEN fail AND k IN (2, 4, 9) THEN 'parse_fail_placeholder' END], lambda x: x IS NOT NULL) AS reasons FROM s)
SELECT p_partkey, len(reasons) > 0 AS hard_veto, coalesce(reasons[1], '') AS veto_reason, array_to_string(reasons, ',') AS veto_reasons FROM r""")
def style_vetoes(spark, sf_dir):
    return _styled(spark, sf_dir).select("p_partkey", "f.hard_veto", "f.veto_reason", F.array_join("f.veto_reasons", ",").alias("veto_reasons"))


@query("""WITH s AS (SELECT p_partkey, CAST(p_partkey % 11 AS INT) AS k, CAST(p_partkey % 5 AS INT) AS t, p_size % 4 = 0 AS fail, p_name FROM part),
n AS (SELECT *, CASE k WHEN 0 THEN len(string_split(p_name, ' ')) WHEN 1 THEN 2 WHEN 4 THEN 4 WHEN 7 THEN 2 WHEN 8 THEN 8 + len(string_split(p_name, ' ')) WHEN 10 THEN 2 ELSE 1 END AS n FROM s),
e AS (SELECT *, greatest(0, n - CASE WHEN t IN (0, 1) THEN 2 WHEN t = 2 THEN 4 ELSE 6 END) + greatest(0, CASE WHEN t = 3 THEN 2 ELSE 1 END - n) AS excess FROM n)
SELECT p_partkey, round(least(0.35, 0.03 * excess + CASE WHEN k IN (1, 2, 7) THEN 0.10 ELSE 0 END + CASE WHEN k IN (2, 4, 7, 9) THEN 0.15 ELSE 0 END + CASE WHEN fail THEN 0.10 ELSE 0 END + CASE WHEN k = 4 THEN 0.06 ELSE 0 END + CASE WHEN k IN (0, 4, 7, 10) THEN 0.08 ELSE 0 END), 6)::DOUBLE AS penalty FROM e""")
def style_penalties(spark, sf_dir):
    return rounded(_styled(spark, sf_dir).select("p_partkey", style.style_penalty(F.col("f")).alias("penalty")))


# -- texts of conversations ------------------------------------------------------------------------------------

_WS = "[ \\t\\n\\r\\v\\f]"


@query(f"SELECT conv_id, turn, md5(regexp_replace(trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_WS}+', ' ', 'g')) AS h FROM conversations")
def normal_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.norm(F.col("text"))).alias("h"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(coalesce(text, '')), '{_WS}+'), lambda t: t <> '') AS w FROM conversations)
SELECT conv_id, turn, CAST(len(w) AS INT) AS n_words, round(CASE WHEN len(w) < 2 THEN 0 ELSE 1 - list_unique(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) / (len(w) - 1) END, 6) AS repetition FROM w""")
def repetition(spark, sf_dir):
    t = F.col("text")
    return rounded(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.word_count(t).alias("n_words"), text.repetition_rate(t).alias("repetition")))
