"""Style features of answers and the penalty made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candela.functions.arrays import bound
from candela.functions.text import exact_form, strip, text, word_count

# What reads as negation, abstention and an unfilled template.
NEGATION = r"(?iU)\b(?:no|not|none|never|without|cannot|can't|cant|unable|neither|n't)\b"
ABSTENTION = (r"(?iU)\b(?:cannot|can't|cant)\s+(?:determine|tell|infer|know)\b|\bnot\s+(?:visible|clear|enough information|sure)\b|"
              r"\b(?:unclear|unknown|unsure|hard to tell)\b|\b(?:cannot|can't|cant)\s+be\s+seen\b|\bnot\s+shown\b|\b(?:n/?a|not applicable)\b")
BRACKETS = r"<[^>]+>|\[[^\]]+\]"
TEMPLATE = (r"(?iU)<[^>]+>|\[[^\]]+\]|\b(?:short\s*answer|very\s*short|your\s*answer|fill\s+in|placeholder)\b|"
            r"\b(?:integer\s+or\s+short\s+phrase|left\s*/\s*right\s*/\s*top\s*/\s*bottom)\b|\b(?:evidence\s*:\s*\.\.\.|final\s*answer\s*:\s*\.\.\.)\b")
PLACEHOLDERS = ("...", "…", "n/a", "na", "none", "null", "unknown", "unsure", "unclear", "not applicable", "answer", "text", "short answer",
                "very short", "yes/no", "yes or no", "integer or short phrase", "left/right/top/bottom", "short attribute phrase")
# Lengths in words that a task's answers should have.
LENGTHS = (
    (("existence", "binary", "yesno"), 1, 2), (("counting", "count_exclusion"), 1, 2), (("attribute", "attr_conjunction", "finegrained"), 1, 4),
    (("spatial", "relation", "cooccur_bait", "multihop_cross", "action_state", "occlusion"), 2, 6),
)
# Weights of the penalty.
WEIGHTS = {"length": 0.03, "abstention": 0.10, "template": 0.15, "parse_fail": 0.10, "negation": 0.0, "evidence_missing": 0.06, "evidence_placeholder": 0.08}
MOST = 0.35


def placeholder(x: Column) -> Column:
    t = strip(F.lower(text(x)))
    return (t == "") | t.isin(*PLACEHOLDERS) | t.rlike(BRACKETS)


def field(raw: Column, label: str) -> Column:
    """Value of the last line ``label: value``; null without such a line."""
    values = F.regexp_extract_all(text(raw), F.lit(r"(?im)^[ \t]*" + label.replace(" ", r"\s*") + r"\s*[:：][ \t]*(.*)$"), F.lit(1))
    return F.when(F.size(values) > 0, strip(F.element_at(F.concat(F.array(F.lit("")), values), -1)))


def length_range(task_type: Column) -> tuple[Column, Column]:
    t = strip(F.lower(text(task_type)))
    lo, hi = F.lit(1), F.lit(6)
    for names, a, b in LENGTHS:
        lo, hi = F.when(t.isin(*names), a).otherwise(lo), F.when(t.isin(*names), b).otherwise(hi)
    return lo, hi


def style_features(answer: Column, raw_response: Column, task_type: Column, parse_fail: Column) -> Column:
    """struct of flags, lengths, veto and its reasons; what several of them need is worked out once, level by level."""
    lo, hi = length_range(task_type)
    stripped = F.struct(strip(answer).alias("ans"), strip(raw_response).alias("raw"))

    def read(x: Column) -> Column:
        ans, raw = x["ans"], x["raw"]
        return F.struct(ans.alias("ans"), raw.alias("raw"), F.when(ans != "", ans).otherwise(raw).alias("probe"), field(raw, "evidence").alias("evidence"), field(raw, "final answer").alias("final"), word_count(ans).alias("n"), placeholder(ans).alias("blank"))

    def judged(x: Column) -> Column:
        ev = F.coalesce(x["evidence"], F.lit(""))
        final = F.coalesce(x["final"], F.lit(""))
        return F.struct(x.alias("x"), ev.alias("ev"), ((final != "") & placeholder(final)).alias("final_bad"), placeholder(ev).alias("ev_blank"), exact_form(x["probe"]).alias("form"), x["probe"].rlike(ABSTENTION).alias("abstention"))

    def flagged(y: Column) -> Column:
        x, ev_bad = y["x"], (y["ev"] != "") & y["ev_blank"]
        empty = x["ans"] == ""
        n_fields = F.when(x["evidence"].isNotNull(), 1).otherwise(0) + F.when(x["final"].isNotNull(), 1).otherwise(0)
        template = (x["probe"] != "") & ((~empty & x["ans"].rlike(TEMPLATE)) | ((x["raw"] != "") & x["raw"].rlike(BRACKETS)) | y["final_bad"] | ((n_fields >= 2) & empty & ev_bad) | (~empty & x["blank"]))
        return F.struct(y.alias("y"), ev_bad.alias("ev_bad"), empty.alias("empty"), template.alias("template"), F.coalesce(parse_fail, F.lit(False)).alias("fail"))

    def vetoed(z: Column) -> Column:
        y, x = z["y"], z["y"]["x"]
        none = x["blank"] | y["final_bad"]
        reasons = F.array_compact(F.array(
            F.when(y["abstention"] & (none | z["empty"]), "abstention_like"), F.when(z["template"] & x["blank"], "placeholder_answer"),
            F.when(y["final_bad"] | (z["empty"] & z["ev_bad"]), "placeholder_schema"), F.when(z["fail"] & (none | (z["empty"] & z["ev_bad"])), "parse_fail_placeholder")))
        only_evidence = z["ev_bad"] & ~y["final_bad"] & ~z["empty"] & ~x["blank"]
        return F.struct(z.alias("z"), F.when(only_evidence, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))

    def features(v: Column) -> Column:
        z, reasons = v["z"], v["reasons"]
        y, x, n, form = z["y"], z["y"]["x"], z["y"]["x"]["n"], z["y"]["form"]
        excess = F.greatest(F.lit(0), n - hi) + F.greatest(F.lit(0), lo - n)
        return F.struct(
            n.alias("length_tokens"), excess.alias("length_excess"), x["probe"].rlike(NEGATION).alias("has_negation"), y["abstention"].alias("is_abstention_like"),
            z["template"].alias("is_template_like"), z["fail"].alias("is_parse_fail"), (form.rlike(r"^[-+]?\d+$") & (n <= 2)).alias("is_numeric_short"),
            (form.isin("yes", "no") & (n <= 2)).alias("is_yesno_short"), x["evidence"].isNotNull().alias("has_evidence_field"), (x["evidence"].isNotNull() & (y["ev"] == "")).alias("evidence_missing"),
            (x["evidence"].isNotNull() & y["ev_blank"]).alias("evidence_placeholder"), (F.size(reasons) > 0).alias("hard_veto"),
            F.coalesce(F.get(reasons, F.lit(0)), F.lit("")).alias("veto_reason"), reasons.alias("veto_reasons"))

    return bound(bound(bound(bound(bound(stripped, read), judged), flagged), vetoed), features)


def style_penalty(f: Column, weights: dict[str, float] = WEIGHTS, most: float = MOST) -> Column:
    flag = {"abstention": f["is_abstention_like"], "template": f["is_template_like"], "parse_fail": f["is_parse_fail"], "negation": f["has_negation"] & ~f["is_yesno_short"],
            "evidence_missing": f["evidence_missing"], "evidence_placeholder": f["evidence_placeholder"]}
    raw = F.lit(weights["length"]) * f["length_excess"]
    for name, on in flag.items():
        raw = raw + F.when(on, weights[name]).otherwise(0.0)
    return F.least(F.lit(most), F.greatest(F.lit(0.0), raw))
