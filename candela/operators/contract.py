"""What passes between the steps: candidate rows, prompts, scopes, reward fields of records, choices of columns and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions import arrays, geometry, style, text as tx
from candela.functions.stats import finite
from candela.operators import dataset, groups
from candela.operators.ranges import mixed, numbered

# Core reward fields of each backend.
LEGACY_FIELDS = ("reward_logits_js", "reward_logits_cosine_dist", "reward_layer24_prompt_last_cosine", "reward_mix_js_promptlast", "reward_mix_cosine_promptlast")
ACTION_FIELDS = ("reward_action_logprob_ate", "reward_action_logprob_ate_supervised", "reward_action_logprob_ate_nolabel", "reward_main_correctness_only",
                 "reward_main_additive_evidence", "reward_main_routed_gated_evidence")
BACKEND_FIELDS = {"legacy_ced": LEGACY_FIELDS, "action_logprob_ate": ACTION_FIELDS, "both": LEGACY_FIELDS + ACTION_FIELDS}
PREFIX = "action_logprob_ate_"
# Instructions of the prompts, by family; '' for every other.
INSTRUCTIONS = {
    "existence": "For yes/no questions, the final answer must be exactly yes or no.",
    "counting": "For counting questions, the final answer must be a single integer or number phrase.",
    "spatial": "For spatial questions, the final answer must be a short noun phrase or location phrase.",
    "attribute": "For attribute or description questions, the final answer must be a concise attribute phrase.",
    "": "Keep the final answer short, specific, and directly grounded in the image.",
}
ANSWER_ONLY = "Answer the question using the image. Do not output chain-of-thought. Use exactly this one-line format:\nFinal answer: <answer only>\n"
WITH_EVIDENCE = ("Answer the question using the image. Do not output chain-of-thought. First write one very short evidence phrase grounded in the image (1-8 words, no full sentence), "
                 "then write the final answer. Do not add any extra lines. Use exactly this two-line format:\nEvidence: <1-8 grounded words>\nFinal answer: <answer only>\n")
ANSWER_PREFIX = "Final answer: "
PREFIXED_MODES = ("task_aware_v1", "short_evidence_v1", "final_answer_only_v1")


def mode_name(mode: str | None, default: str) -> str:
    return (mode or default).strip().lower()


# -- candidates ------------------------------------------------------------------

def candidate_row(raw: Column, found: Column, response_lp: Column, answer_lp: Column) -> Column:
    """struct of a candidate: texts, log-probabilities over the response and the answer (NaN of none), lengths, yes/no label."""
    nan = F.lit(float("nan"))

    def summed(a: Column) -> Column:
        return F.when(F.size(a) > 0, arrays.total(a)).otherwise(nan)

    def row(f: Column) -> Column:
        answer = f["answer"]
        label = tx.yesno(answer)
        return F.struct(
            raw.alias("raw_generated_text"), answer.alias("generated_text"), f["source"].alias("final_answer_extraction_source"),
            arrays.average(response_lp).alias("mean_logprob"), summed(response_lp).alias("sum_logprob"), arrays.average(answer_lp).alias("final_answer_mean_logprob"), summed(answer_lp).alias("final_answer_sum_logprob"),
            tx.word_count(answer).alias("answer_length"), F.length(tx.text(answer)).alias("answer_char_length"), tx.word_count(raw).alias("response_length"), F.length(tx.text(raw)).alias("response_char_length"),
            (label != "other").alias("is_yesno"), label.alias("yesno_label"))
    return arrays.bound(found, row)


def least_different(task_type: Column, n: Column) -> Column:
    """How many different answers a group should hold: two for yes/no and counts, if it has two at all."""
    return F.when(tx.task_family(task_type).isin("existence", "counting") & (n > 1), F.least(F.lit(2), n)).otherwise(0)


def key_mode(requested: str, n_tokens: Column, most: int = 4) -> Column:
    """struct(mode, span): which answer tokens are the key; ``auto`` goes by their number."""
    auto = F.when(n_tokens == 0, "prompt_last").when(n_tokens == 1, "answer_first").otherwise("answer_span")
    mode = auto if requested == "auto" else F.lit(requested)
    return F.struct(mode.alias("mode"), F.when(mode == "answer_span", F.least(F.lit(most), n_tokens)).when(mode == "answer_first", 1).otherwise(0).alias("span"))


# -- prompts and scopes ------------------------------------------------------------

def final_prefix(mode: str | None) -> str:
    return ANSWER_PREFIX if mode_name(mode, "raw_question") in PREFIXED_MODES else ""


def prompt(question: Column, task_type: Column, mode: str = "raw_question") -> Column:
    """The question as it is, or after the instructions of the mode and its family; an empty question stays empty."""
    if mode == "raw_question":
        return question
    family, said = tx.task_family(task_type, question), F.lit(INSTRUCTIONS[""])
    for name, words in INSTRUCTIONS.items():
        said = F.when(family == name, words).otherwise(said) if name else said
    head = ANSWER_ONLY if mode_name(mode, "raw_question") == "final_answer_only_v1" else WITH_EVIDENCE
    return F.when(question == "", "").otherwise(F.concat(F.lit(head), said, F.lit("\n\nQuestion: "), question))


def structured(answer: Column, wrapped: str = "raw_response") -> Column:
    t = tx.strip(answer)
    if mode_name(wrapped, "raw_response") != "task_aware_v1":
        return t
    return F.when(t == "", "Evidence:\nFinal answer:").otherwise(F.concat(F.lit("Evidence:\nFinal answer: "), t))


def answer_text(raw: Column, found: Column, source: str | None) -> Column:
    """The text that is graded: the extracted answer or the response."""
    return tx.strip(found["answer"]) if mode_name(source, "") == "final_answer" else tx.strip(raw)


def policy_scope(raw: Column, tokens: Column, requested: str = "final_answer", strict: bool = True) -> Column:
    """struct(effective, reason, target, indices, valid): the tokens of the answer, or why it is the whole response or nothing."""
    if mode_name(requested, "") != "final_answer":
        return F.struct(F.lit("full_response").alias("effective"), F.lit("").alias("reason"), tx.strip(raw).alias("target"), F.lit(None).cast("array<int>").alias("indices"), F.lit(True).alias("valid"))

    def fails(reason: Column, whole: Column) -> Column:
        return F.struct(F.lit("invalid_final_answer" if strict else "full_response").alias("effective"), reason.alias("reason"), (F.lit("") if strict else whole).alias("target"),
                        F.lit(None).cast("array<int>").alias("indices"), F.lit(not strict).alias("valid"))

    def told(x: Column) -> Column:
        answer, start, indices = x["answer"], x["start"], x["indices"]
        good = F.struct(F.lit("final_answer").alias("effective"), F.lit("").alias("reason"), answer.alias("target"), indices.alias("indices"), F.lit(True).alias("valid"))
        return (F.when(answer == "", fails(F.lit("empty_final_answer"), x["whole"])).when(start.isNull(), fails(F.concat(F.lit("missing_char_span(source="), x["source"], F.lit(")")), x["whole"]))
                .when(F.size(tokens) == 0, fails(F.lit("token_char_alignment_failed"), x["whole"])).when(F.size(indices) == 0, fails(F.lit("empty_token_span_for_answer"), x["whole"])).otherwise(good))

    def spanned(x: Column) -> Column:
        own = geometry.overlapping_tokens(geometry.token_spans(tokens), x["start"], x["start"] + F.length(x["answer"]))
        return arrays.bound(F.struct(tx.strip(x["answer"]).alias("answer"), x["source"].alias("source"), x["start"].alias("start"), own.alias("indices"), F.lit("" if strict else None).alias("whole") if strict else tx.strip(raw).alias("whole")), told)
    return arrays.bound(tx.final_answer(raw), spanned)


# -- fields of reward records --------------------------------------------------------

def prefixed(record: dict[str, Column], kept: tuple[str, ...] = ()) -> list[Column]:
    """Columns under PREFIX: numbers as finite or null, names in ``kept`` as they are."""
    return [(c if n in kept else finite(c)).alias(PREFIX + n) for n, c in record.items()]


def with_error_defaults(df: DataFrame, backend: str, failed: Column) -> DataFrame:
    """Core fields of the backend that a failed row lacks become 0; others stay as they are."""
    return df.withColumns({c: F.when(failed, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for c in BACKEND_FIELDS.get(backend, ()) if c in df.columns})


def error_reward(mode: str, correct: Column, parsed: Column, wrong: float, unparseable: float) -> Column:
    """Reward of a row that could not be scored."""
    bad = F.when(correct, 0.0).when(~correct & (parsed == "other"), unparseable).when(~correct, wrong)
    if mode == "legacy_hard_gate":
        return F.coalesce(bad, F.lit(0.0))
    if mode == "soft_shaping":
        return F.coalesce(F.when(correct, 0.25).when(~correct & (parsed == "other"), -1.0).when(~correct, -0.6), F.lit(0.0))
    return F.lit(0.0)


def main_contract(mode: str, total: dict[str, Column], correctness: Column, allowed: Column) -> Column:
    """struct(answer_coef, visual_coef, answer_reward, visual_reward, total, field): the evidence part is the total less correctness."""
    name = mode if mode in total else "routed_gated_evidence"
    value = F.coalesce(total[name], F.lit(0.0))
    c = F.coalesce(correctness, F.lit(0.0))
    return F.struct(F.lit(1.0).alias("answer_coef"), F.when(F.coalesce(allowed, F.lit(False)), 1.0).otherwise(0.0).alias("visual_coef"), c.alias("answer_reward"), (value - c).alias("visual_reward"),
                    value.alias("total"), F.lit(f"reward_main_{name}").alias("field"))


def supervised(task_type: Column, question: Column, present: Column, gold: Column) -> Column:
    return (tx.task_family(task_type, question) == "existence") & (present.isNotNull() | tx.yesno(tx.strip(gold)).isin("yes", "no"))


def backend_of(requested: str | None, has_label: Column) -> Column:
    b = mode_name(requested, "")
    if b in ("", "auto", "action_logprob_ate_auto"):
        return F.when(has_label, "action_logprob_ate_supervised").otherwise("action_logprob_ate_nolabel")
    return F.lit("action_logprob_ate_nolabel" if b in ("response_conditioned_final_answer_ate", "response_conditioned_final_answer_ate_nolabel") else b)


def used_reward(backend: Column, base: Column, shaped: Column, sample_level: Column, on_prefix: bool = True) -> Column:
    """struct(reward, field, semantics, uses_gt, scope, ranks): what a backend hands on, and where it is from; null for an unknown backend."""
    told = "response_conditioned" if on_prefix else "answer_only"

    def row(value: Column, field: str, semantics: str, gt: bool, scope: str, ranks: bool) -> Column:
        return F.struct(value.alias("reward"), F.lit(field).alias("field"), F.lit(semantics).alias("semantics"), F.lit(gt).alias("uses_gt"), F.lit(scope).alias("scope"), F.lit(ranks).alias("ranks"))
    scope = "response_conditioned" if on_prefix else "answer_only_isolated"
    return (F.when(backend == "action_logprob_ate_nolabel", row(base, "score_base_no_label", f"{told}_final_answer_ate", False, scope, True))
            .when(backend == "action_logprob_ate_supervised", row(shaped, "supervised_shaped_reward", f"{told}_supervised_ate", True, scope, True))
            .when(backend == "logodds_ate", row(F.coalesce(sample_level, F.lit(0.0)), "reward", "prompt_side_logodds_ate", False, "prompt_side_sample_level", False)))


def logodds_effect(before: Column, after: Column, yes: Column, no: Column) -> Column:
    """struct(reward, logodds_orig, logodds_replaced, prob_yes_orig, prob_yes_replaced) from the logits of both passes."""
    a, b = arrays.margin(before, yes, no), arrays.margin(after, yes, no)
    return F.struct(F.abs(a - b).alias("reward"), a.alias("logodds_orig"), b.alias("logodds_replaced"), F.exp(arrays.logsumexp(arrays.gather(before, yes)) - arrays.logsumexp(before)).alias("prob_yes_orig"),
                    F.exp(arrays.logsumexp(arrays.gather(after, yes)) - arrays.logsumexp(after)).alias("prob_yes_replaced"))


# -- choices over a whole table ---------------------------------------------------------

def logprob_key(df: DataFrame) -> str:
    """The answer's mean log-probability if any row has it, else the response's. One small job."""
    if "final_answer_mean_logprob" in df.columns and df.select(F.bool_or(finite(F.col("final_answer_mean_logprob")).isNotNull())).first()[0]:
        return "final_answer_mean_logprob"
    return "mean_logprob"


def length_key(df: DataFrame) -> str:
    return "response_length" if "response_length" in df.columns else "answer_length"


def style_view(df: DataFrame) -> Column:
    """Style features with the fields that a record may have: the first text that is there stands."""
    def first(*names: str) -> Column:
        there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*there, F.lit(""))
    answer = first("generated_text", "final_answer", "answer_text", "raw_generated_text")
    raw = F.coalesce(F.nullif(first("raw_generated_text", "response_text"), F.lit("")), answer)
    fail = F.coalesce(F.col("is_parse_fail"), F.lit(False)) if "is_parse_fail" in df.columns else F.lit(False)
    return style.style_features(answer, raw, first("task_type"), fail)


def template_risk(strategies: DataFrame) -> DataFrame:
    """(strategy, too_short, too_alike, risk) from (strategy, avg_answer_length, yesno_ratio); a missing figure is 0."""
    n, y = F.coalesce("avg_answer_length", F.lit(0.0)), F.coalesce("yesno_ratio", F.lit(0.0))
    return strategies.select("strategy", (n < 2).alias("too_short"), (y > 0.85).alias("too_alike"), ((n < 2) | (y > 0.85)).alias("risk"))


def unblocked(degeneracy: DataFrame) -> DataFrame:
    """Rewards that vary within at least one sample."""
    return degeneracy.where(F.coalesce("nonconstant_rate", F.lit(0.0)) > 0.0)


def diagnostic_strategies(rewards: DataFrame, name: str = "name") -> DataFrame:
    return rewards.select(F.concat(F.lit("diagnostic_select_by_"), F.col(name)).alias("strategy"), F.col(name).alias("reward"))


def collapsed(df: DataFrame, layer: str, order: str, n: int) -> DataFrame:
    """The first n groups that have a collapse layer."""
    return df.where(F.col(layer).isNotNull()).orderBy(order).limit(n)


def no_device(message: Column) -> Column:
    m = F.lower(tx.text(message))
    return m.contains("no cuda gpus are available") | (m.contains("cuda") & m.contains("not available"))


def zipped(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Parallel arrays as rows, with ``place``; a shorter one gives nulls."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("place", "_z")).select(*keys, "place", *[F.col(f"_z.{c}").alias(c) for c in columns])


def bucket_draws(df: DataFrame, family: str, key: str, draws: DataFrame, seed: int = 42) -> DataFrame:
    """(draw, family, key): for each ``draw``, a number, a family and then one of its rows, both by arithmetic of seed and draw; with replacement."""
    rows = numbered(df.where(F.col(family).isNotNull()).select(F.col(family).alias("family"), F.col(key).alias("key")), "family", "key", "row")
    named = rows.groupBy("family").agg(F.count("*").alias("size")).withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("family")) - 1)  # a row per family
    count = named.agg(F.count("*").alias("families"))
    pick = draws.select("draw").join(F.broadcast(count)).where("families > 0").withColumn("turn", (mixed(seed, F.col("draw"), 1) % F.col("families")).cast("int"))
    pick = pick.join(F.broadcast(named), "turn").withColumn("row", mixed(seed, F.col("draw"), 2) % F.col("size"))
    return pick.select("draw", "family", "row").join(rows, ["family", "row"]).select("draw", "family", "key")


# -- boxes to compare with --------------------------------------------------------------------

def random_box(width: Column, height: Column, key: Column) -> Column:
    """A square of 5 to 15 % of the image, drawn by the key."""
    def u(s: str, lo: Column, hi: Column) -> Column:
        return lo + (hi - lo) * geometry.unit_hash(F.concat_ws(":", key.cast("string"), F.lit(s)))
    side = F.sqrt(u("share", F.lit(0.05), F.lit(0.15)) * width * height)
    w, h = F.least(side, width * 0.5), F.least(side, height * 0.5)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(u("x", zero, F.greatest(one, width - w)), u("y", zero, F.greatest(one, height - h)), w, h)


def area_matched_box(box: Column, width: Column, height: Column, key: Column, tries: int = 20, most: float = 0.3) -> Column:
    """A box of about the same area and form elsewhere: the first draw that overlaps by less than ``most``, else the far corner. No draw is made after that one."""
    one, zero = F.lit(1.0), F.lit(0.0)

    def u(x: Column, s: Column) -> Column:
        return geometry.unit_hash(F.concat_ws(":", x["key"], s))

    def wide(x: Column) -> Column:
        target = x["area"] * (0.8 + 0.4 * u(x, F.lit("area")))
        return F.struct(x["b"].alias("b"), x["width"].alias("width"), x["height"].alias("height"), x["key"].alias("key"), x["area"].alias("area"), target.alias("target"),
                        F.greatest(one, F.least(F.sqrt(target * x["b"][2] / F.greatest(one, x["b"][3])), x["width"] * 0.9)).alias("w"))

    def placed(x: Column, w: Column, h: Column) -> Column:
        own, width, height = x["b"], x["width"], x["height"]

        def draw(i: Column) -> Column:
            return F.array(u(x, F.concat(F.lit("x"), i)) * F.greatest(one, width - w), u(x, F.concat(F.lit("y"), i)) * F.greatest(one, height - h), w, h)

        def share(c: Column) -> Column:
            across = F.greatest(zero, F.least(c[0] + c[2], own[0] + own[2]) - F.greatest(c[0], own[0]))
            down = F.greatest(zero, F.least(c[1] + c[3], own[1] + own[3]) - F.greatest(c[1], own[1]))
            return across * down / F.greatest(one, c[2] * c[3] + x["area"] - across * down)
        first = F.reduce(F.sequence(F.lit(1), F.lit(tries)), F.lit(None).cast("array<double>"), lambda had, i: F.when(had.isNotNull(), had).otherwise(F.get(F.filter(F.array(draw(i)), lambda c: share(c) < most), F.lit(0))))
        corner = F.array(F.when(own[0] + own[2] / 2 < width / 2, F.greatest(zero, width - w)).otherwise(0.0), F.when(own[1] + own[3] / 2 < height / 2, F.greatest(zero, height - h)).otherwise(0.0), w, h)
        return F.coalesce(first, corner)

    def sized(x: Column) -> Column:
        h = F.greatest(one, F.least(x["target"] / F.greatest(one, x["w"]), x["height"] * 0.9))
        return arrays.bound(F.struct(x.alias("x"), h.alias("h")), lambda y: placed(y["x"], y["x"]["w"], y["h"]))
    asked = F.struct(box.alias("b"), width.alias("width"), height.alias("height"), key.cast("string").alias("key"), F.greatest(one, box[2] * box[3]).alias("area"))
    return arrays.bound(asked, lambda x: arrays.bound(wide(x), sized))


def visual_range(ids: Column, image_token: Column) -> Column:
    """struct(first, end): places from the first image token to one past the last; null without one."""
    first = F.array_position(ids, image_token)
    return F.when(first > 0, F.struct((first - 1).cast("int").alias("first"), (F.size(ids) - F.array_position(F.reverse(ids), image_token) + 1).cast("int").alias("end")))


# -- data sets by name ---------------------------------------------------------------------------

def image_error(sample: dict[str, Column], resolved: Column) -> Column:
    """struct(error, pair_id, image_id, image_file): what is wrong where no image was found; null where one was."""
    return F.when(resolved.isNull(), F.struct(F.lit("image_not_found").alias("error"), *[sample[c].cast("string").alias(c) for c in ("pair_id", "image_id", "image_file")]))


def dataset_rows(raw: DataFrame, name: str | None, task_type: str = "", split: str = "all", allow: list[str] | None = None, most: int = 0, key: str = "sample_uid", seed: int = 42) -> DataFrame:
    """Rows of a data set by its name: ``vg_brutal`` canonical, filtered by task and split; any other as it is, filtered by task.

    Then the allow-list of tasks and families, and last of all a sample of ``most`` rows.
    """
    if mode_name(name, "legacy_vqa") == "vg_brutal":
        out = dataset.of_split(dataset.of_task(dataset.canonical_samples(raw), task_type), split)
    else:
        w = (task_type or "").strip().lower()
        out = raw if w in ("", "all", "any", "*") else raw.where(tx.strip(F.lower(tx.text(F.col("task_type")))) == w)
    out = dataset.allowed(out, [a.strip().lower() for a in allow or [] if a.strip()])
    return dataset.hash_sample(out, most, key, seed) if most else out


def legacy_rows(raw: DataFrame, task_type: str = "existence", most: int = 0, key: str = "sample_uid", seed: int = 42) -> DataFrame:
    """Rows whose task is exactly the one named, and a sample of them."""
    out = raw.where(F.col("task_type") == task_type) if task_type else raw
    return dataset.hash_sample(out, most, key, seed) if most else out


def best_correct(df: DataFrame, group: str, score: Column, order: str, correct: str) -> DataFrame:
    """(group, correct) of the best row of each group."""
    return groups.best_rows(df, group, score, order).select(group, correct)
