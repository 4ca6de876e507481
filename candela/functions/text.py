"""Text parsing and grading of answers, as Column expressions.

Every function takes and returns Columns of built-in functions.  Null texts count as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from candela.functions.arrays import bound

# Labels that name a task family.
FAMILIES = ("counting", "attribute", "spatial", "existence", "other")
EVIDENCE_FAMILIES = ("counting", "attribute", "spatial")
FAMILY_ALIASES = {
    "existence": "existence", "yesno": "existence", "counting": "counting", "count": "counting", "spatial": "spatial",
    "location": "spatial", "attribute": "attribute", "description": "attribute", "count_exclusion": "counting",
    "spatial_chain": "spatial", "occlusion": "spatial", "multihop_cross": "spatial", "attr_conjunction": "attribute",
    "finegrained": "attribute", "action_state": "attribute", "cooccur_bait": "other",
}
# Parts of labels that name a family, in the order in which they are tried.
FAMILY_PARTS = (
    ("counting", ("count",)),
    ("attribute", ("attr", "fine", "state", "action", "desc", "color", "material")),
    ("spatial", ("spatial", "loc", "occlusion", "between", "relation", "behind", "front")),
    ("existence", ("exist", "presence", "yesno", "hallucination", "probe")),
)
# Openings of questions that name a family, in the order in which they are tried.
FAMILY_OPENINGS = (
    ("counting", r"(how\s+many|what\s+number\s+of)\b"),
    ("existence", r"(is|are|was|were|do|does|did|has|have|had|can|could|would|should|will|won't|can't)\b"),
    ("spatial", r"(where\b|what\s+is\s+located\b|what\s+is\s+between\b|what\s+is\s+behind\b|what\s+is\s+in\s+front\s+of\b|what\s+is\s+occluding\b|which\s+object\s+is\b)"),
    ("attribute", r"(describe\b|what\s+color\b|what\s+kind\b|what\s+material\b|what\s+state\b|what\s+condition\b|what\s+does\s+the\b)"),
)
# Phrases that leave a yes/no question open.
UNCERTAIN = (
    r"not sure", "maybe", "unknown", "unclear", "cannot determine", "can'?t determine", "unable to determine", "cannot tell", "can'?t tell",
    "not enough information", "insufficient information", "i do not know", "don't know", "do not know", "unsure",
)
#: Fixed value: characters that are stripped from a first word.
TOKEN_EDGE = r""" \t\r\n"'`(\[{<)\]}>.,!?;:\-_/\\"""
# Number words.
COUNT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NUMBER_WORDS = (*COUNT_WORDS, "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
# Label synonyms.
SYNONYMS = {
    "bike": "bicycle", "bikes": "bicycle", "bicycle": "bicycle", "bicycles": "bicycle", "tv": "television", "television": "television",
    "sofa": "couch", "couch": "couch", "cellphone": "phone", "cell phone": "phone", "mobile phone": "phone", "smartphone": "phone",
    "phone": "phone", "aeroplane": "airplane", "airplane": "airplane", "plane": "airplane",
}


def text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(text(x), r"(?U)^\s+|\s+$", "")


def norm(x: Column) -> Column:
    """Lower case, without space at the ends, one space inside."""
    return F.regexp_replace(strip(F.lower(text(x))), r"(?U)\s+", " ")


def _quoted(x) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)


def lookup(table: dict, key: Column) -> Column:
    """The table's value at the key, null where it has none; the table is one expression, parsed at once."""
    return F.try_element_at(F.expr(f"map({', '.join(_quoted(v) for kv in table.items() for v in kv)})"), key)


def tokens(x: Column) -> Column:
    return F.filter(F.split(strip(x), r"(?U)\s+"), lambda t: t != "")


def word_count(x: Column) -> Column:
    return F.size(tokens(x))


def contains_any(x: Column, parts: tuple[str, ...]) -> Column:
    return x.rlike("|".join(re.escape(p) for p in parts))


# -- families ------------------------------------------------------------------

def family_label(label: Column) -> Column:
    """Family of a label; '' for a blank one, other for an unknown one."""
    raw = strip(F.lower(text(label)))
    part = F.lit("other")
    for family, parts in reversed(FAMILY_PARTS):
        part = F.when(contains_any(raw, parts), family).otherwise(part)
    return F.coalesce(lookup({"": "", **{f: f for f in FAMILIES}, **FAMILY_ALIASES}, raw), part)


def task_family(task_type: Column, question: Column | None = None, *hints: Column) -> Column:
    """Family from the hints in order, then the task type, then the opening of the question, else other."""
    named = [F.nullif(family_label(x), F.lit("")) for x in (*hints, task_type)]
    q = strip(question if question is not None else F.lit(""))
    opened = F.lit(None).cast("string")
    for family, pattern in reversed(FAMILY_OPENINGS):
        opened = F.when(q.rlike(r"(?iU)^\s*" + pattern), family).otherwise(opened)
    return F.coalesce(*named, opened, F.lit("other"))


def allows_evidence(family: Column) -> Column:
    return family_label(family).isin(*EVIDENCE_FAMILIES)


def probe_only(family: Column) -> Column:
    return family_label(family) == "existence"


# -- yes and no ------------------------------------------------------------------

def first_token(x: Column) -> Column:
    t = F.regexp_extract(text(x), r"(?U)^\s*(\S+)", 1)
    return F.lower(F.regexp_replace(t, f"^[{TOKEN_EDGE}]+|[{TOKEN_EDGE}]+$", ""))


def uncertain(x: Column) -> Column:
    return strip(F.lower(text(x))).rlike(r"(?iU)\b(" + "|".join(UNCERTAIN) + r")\b")


def yesno_with_source(x: Column) -> Column:
    """struct(label, source): yes, no or other, and what told."""
    def said(label: str, source: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(source).alias("source"))

    def told(low: Column) -> Column:
        first = first_token(low)
        yes, no = low.rlike(r"(?iU)\byes\b"), low.rlike(r"(?iU)\bno\b")
        return (F.when(low == "", said("other", "other")).when(first == "yes", said("yes", "first_token")).when(first == "no", said("no", "first_token"))
                .when(uncertain(low), said("other", "uncertain")).when(yes & ~no, said("yes", "boundary_regex")).when(no & ~yes, said("no", "boundary_regex"))
                .otherwise(said("other", "other")))
    return bound(strip(F.lower(text(x))), told)


def yesno(x: Column) -> Column:
    return yesno_with_source(x)["label"]


# -- exact match and counts -----------------------------------------------------------

def _integer(t: Column) -> Column:
    """An integer without leading zeros and plus sign, of any length."""
    digits = F.regexp_replace(F.regexp_replace(t, r"^[-+]", ""), r"^0+(?=\d)", "")
    return F.when(t.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def exact_form(x: Column) -> Column:
    """Lower case without punctuation; number words to twenty and integers in plain digits."""
    words = tokens(F.regexp_replace(strip(F.lower(text(x))), r"(?U)[^\w\s]", " "))
    number = {w: str(i) for i, w in enumerate(NUMBER_WORDS)}
    return F.array_join(F.transform(words, lambda t: F.coalesce(lookup(number, t), F.when(t.rlike(r"^[-+]?\d+$"), _integer(t)), t)), " ")


def exact_match(a: Column, b: Column) -> Column:
    return bound(exact_form(a), lambda p: F.when((p != "") & (p == exact_form(b)), 1.0).otherwise(0.0))


def count_exact(x: Column) -> Column:
    """First integer of the exact form, as decimal; null without one."""
    return F.nullif(F.regexp_extract(exact_form(x), r"([-+]?\d+)", 1), F.lit("")).try_cast("decimal(38,0)")


def fits_family(answer: Column, family: Column) -> Column:
    fam = strip(F.lower(text(family)))
    return F.when(fam == "existence", yesno(answer).isin("yes", "no")).when(fam == "counting", count_exact(answer).isNotNull()).otherwise(False)


def slice_decision(question: Column, task_type: Column, gold: Column, allowed: tuple[str, ...] = ("counting", "existence")) -> Column:
    """struct(keep, family, reason): keeps a row whose gold answer fits its family."""
    def decided(fam: Column) -> Column:
        reason = (F.when(~fam.isin(*allowed), "family_not_allowed").when(~fam.isin("counting", "existence"), "unsupported_family").when(fits_family(gold, fam), "ok")
                  .when(fam == "counting", "counting_gt_not_integer").otherwise("existence_gt_not_yesno"))
        return F.struct((reason == "ok").alias("keep"), fam.alias("family"), reason.alias("reason"))
    return bound(task_family(task_type, question), decided)


def answer_score(pred: Column, gold: Column, family: Column) -> Column:
    """1.0 or 0.0 by the rule of the family: yes/no, count, or exact match."""
    yes = bound(yesno(pred), lambda p: F.when(p.isin("yes", "no") & (p == yesno(gold)), 1.0).otherwise(0.0))
    count = F.when(count_exact(pred) == count_exact(gold), 1.0).otherwise(0.0)
    return bound(family, lambda f: F.when(f == "existence", yes).when(f == "counting", count).otherwise(exact_match(pred, gold)))


def dedup_key(x: Column, family: Column) -> Column:
    """Key under which final answers count as the same."""
    s = norm(x)
    yn, number = yesno(s), F.regexp_extract(s, r"(-?\d+)", 1)
    return F.when(s == "", "").when((family == "existence") & yn.isin("yes", "no"), yn).when((family == "counting") & (number != ""), number).otherwise(s)


# -- labels --------------------------------------------------------------------------------

def label_form(x: Column) -> Column:
    """ASCII words without articles and plural s, with synonyms replaced word by word."""
    words = tokens(F.regexp_replace(strip(F.lower(text(x))), r"[^a-z0-9\s]", " "))
    words = F.filter(words, lambda t: ~t.isin("a", "an", "the"))
    words = F.transform(words, lambda t: F.when(t.endswith("s") & (F.length(t) > 3), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    words = F.transform(words, lambda t: F.coalesce(lookup(SYNONYMS, t), t))
    return F.array_join(F.filter(words, lambda t: ~t.isin("", "a", "an", "the")), " ")


def _form_count(form: Column) -> Column:
    digits = F.nullif(F.regexp_extract(form, r"(\d+)", 1), F.lit("")).try_cast("decimal(38,0)")
    return F.coalesce(digits, lookup({w: str(i) for i, w in enumerate(COUNT_WORDS)}, F.split(form, " ")[0]).cast("decimal(38,0)"))


def count_label(x: Column) -> Column:
    """First digits of the label form, else its first word as a number to ten; null without one."""
    return bound(label_form(x), _form_count)


def subset_either_way(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def _forms_near(p: Column, g: Column) -> Column:
    return (p != "") & (g != "") & ((p == g) | subset_either_way(F.split(p, " "), F.split(g, " ")))


def _forms_match(family: Column, p: Column, g: Column) -> Column:
    """Whether label forms agree by the rule of the family: count, words of an attribute, or the form itself."""
    return F.when(family == "counting", F.coalesce(_form_count(p) == _form_count(g), F.lit(False))).when(family == "attribute", _forms_near(p, g)).otherwise(p == g)


def attribute_match(pred: Column, gold: Column) -> Column:
    return bound(F.struct(label_form(pred).alias("p"), label_form(gold).alias("g")), lambda x: _forms_near(x["p"], x["g"]))


def open_ended_correct(task_type: Column, pred: Column, gold: Column) -> Column:
    return bound(F.struct(task_family(task_type).alias("f"), label_form(pred).alias("p"), label_form(gold).alias("g")), lambda x: _forms_match(x["f"], x["p"], x["g"]))


def behavior(pred: Column, gold: Column, present: Column, task_type: Column, aliases: Column | None = None) -> Column:
    """correct_positive, correct_negative, miss, hallucination or other; an alias is as good as the gold answer."""
    here = F.coalesce(present, F.lit(False))
    golds = F.array(text(gold)) if aliases is None else F.concat(F.array(text(gold)), F.coalesce(aliases, F.array().cast("array<string>")))

    def closed(yn: Column) -> Column:
        return F.when(yn == "other", "other").when(here, F.when(yn == "yes", "correct_positive").otherwise("miss")).otherwise(F.when(yn == "no", "correct_negative").otherwise("hallucination"))

    def opened(x: Column) -> Column:
        right = F.exists(F.transform(golds, label_form), lambda g: _forms_match(x["f"], x["p"], g))
        return F.when(right, "correct_positive").when(here, "miss").otherwise("hallucination")
    open_one = bound(F.struct(task_family(task_type).alias("f"), label_form(pred).alias("p")), opened)
    yes_or_no = F.coalesce(task_type == "existence", F.lit(False)) | (yesno(strip(F.lower(text(gold)))) != "other")
    return F.when(yes_or_no, bound(yesno(pred), closed)).otherwise(open_one)


def behavior_is_correct(b: Column) -> Column:
    return F.coalesce(b.isin("correct_positive", "correct_negative"), F.lit(False))


def yesno_correct(parsed: Column, present: Column, family: Column) -> Column:
    """Whether a yes/no answer is right; null outside existence or without a label."""
    return F.when((family == "existence") & present.isNotNull(), F.when(parsed.isin("yes", "no"), (parsed == "yes") == present).otherwise(False))


def parse_label(x: Column, family: Column) -> Column:
    """What monitoring counts: yes/no, the count, or the exact form; other where there is none."""
    count = count_exact(x).cast("string")
    return (F.when(family == "existence", yesno(x)).when(family == "counting", F.coalesce(count, F.lit("other")))
            .otherwise(F.coalesce(F.nullif(exact_form(x), F.lit("")), F.lit("other"))))


def repetition_rate(x: Column) -> Column:
    """1 - distinct / all word pairs in a row; 0 with fewer than two words."""
    w = tokens(F.lower(text(x)))
    n = F.size(w) - 1
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(w, i), F.try_element_at(w, i + 1)))
    return F.when(n < 1, 0.0).otherwise(1.0 - F.size(F.array_distinct(pairs)) / n)


# -- final answers -----------------------------------------------------------------------------

_COLON = "[:：]"


def _cleaned(line: Column) -> Column:
    """Without a bullet and a pair of backticks."""
    return bound(F.regexp_replace(strip(line), r"^[-*]\s+", ""), lambda s: F.when((F.length(s) >= 2) & s.startswith("`") & s.endswith("`"), strip(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(strip(s)))


_LABEL_INSIDE = r"(?iU)\b(evidence|final\s*answer|question)\b\s*" + _COLON


def _measured(line: Column, *more: Column) -> Column:
    """struct of a line cleaned, its length, its words, whether it may be an answer at all, and what else is asked for."""
    return bound(_cleaned(line), lambda c: F.struct(c.alias("clean"), F.length(c).alias("chars"), word_count(c).alias("words"), ((c != "") & ~c.rlike(r"[\n\r]") & ~c.rlike(_LABEL_INSIDE)).alias("plain"), *more))


def _short(m: Column, chars: int = 80, words: int = 12) -> Column:
    return m["plain"] & (m["chars"] <= chars) & (m["words"] <= words)


def final_answer(raw_text: Column) -> Column:
    """struct(answer, source, start): the answer, the rule that found it, and its place (from 0) in the stripped text.

    The rules in order: a line ``Final answer: x``; a line ``Answer: x``; a line of the tag
    alone and the next line; a first line of evidence and the second; one short line; the last
    short line; the whole text (start is null).  What several rules need is worked out once: a table of the lines, and only where no tag has an answer on its line.
    """
    return bound(strip(raw_text), _found)


def _found(raw: Column) -> Column:
    fallback = F.struct(raw.alias("answer"), F.lit("fallback_raw").alias("source"), F.lit(None).cast("int").alias("start"))

    def found(answer: Column, source: Column | str, offset: Column) -> Column:
        # the first place at or after the line's own start
        src = F.lit(source) if isinstance(source, str) else source
        return F.struct(answer.alias("answer"), src.alias("source"), F.when(answer != "", offset + F.instr(F.substr(raw, offset + 1, F.length(raw)), answer) - 1).cast("int").alias("start"))

    def tagged(pattern: str, source: str) -> Column:
        whole, m = F.regexp_extract(raw, pattern, 0), F.regexp_extract(raw, pattern, 1)

        def taken(x: Column) -> Column:
            return bound(_measured(x["m"]), lambda t: F.when(_short(t), found(t["clean"], source, F.instr(raw, x["whole"]) - 1 + F.length(x["whole"]) - F.length(x["m"]))))
        return bound(F.struct(whole.alias("whole"), m.alias("m")), lambda x: F.when(x["whole"] != "", taken(x)))

    tag_only = r"(?iU)^\s*(final\s*answer|answer)\s*[:：]\s*$"

    def table(lines: Column) -> Column:
        """A row for each line, with its number from 0 and where it starts if lines are joined by one character."""
        starts = F.aggregate(lines, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")), lambda s, x: F.struct((s["end"] + F.length(x) + 1).alias("end"), F.concat(s["at"], F.array(s["end"])).alias("at")))["at"]
        return bound(starts, lambda at: F.transform(lines, lambda x, i: _measured(x, x.alias("line"), i.alias("i"), F.get(at, i).alias("start"), (strip(x) != "").alias("solid"), x.rlike(tag_only).alias("tag"))))

    def by_lines(t: Column) -> Column:
        solid = F.filter(t, lambda x: x["solid"])

        def next_lines(own: Column) -> Column:
            pairs = F.transform(F.filter(t, lambda x: x["tag"]), lambda x: F.struct(x["line"].alias("tag"), F.get(F.filter(own, lambda y: y["i"] > x["i"]), F.lit(0)).alias("next")))
            return F.get(F.filter(pairs, lambda p: p["next"].isNotNull() & _short(p["next"])), F.lit(0))

        def last_line(own: Column) -> Column:
            return F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(F.filter(own, lambda x: ~strip(x["line"]).rlike(r"(?i)^(evidence|question)\s*[:：]")), lambda x: x["i"])), -1)

        after = F.when(F.exists(t, lambda x: x["tag"]), bound(bound(solid, next_lines), lambda g: F.when(g.isNotNull(), found(g["next"]["clean"], F.when(F.lower(g["tag"]).contains("final"), "final_answer_next_line").otherwise("answer_next_line"), g["next"]["start"]))))
        second = F.get(t, F.lit(1))
        evidence = F.when((F.size(t) >= 2) & _short(second, 60, 10) & F.get(t, F.lit(0))["line"].rlike(r"(?iU)^\s*evidence\s*[:：]"), found(second["clean"], "two_line_evidence", second["start"]))
        # a text of one line starts where it starts
        single = F.when((F.size(t) == 1) & _short(F.get(t, F.lit(0))), found(F.get(t, F.lit(0))["clean"], "single_line_short", F.lit(0)))
        last = bound(F.get(t, bound(solid, last_line)), lambda x: F.when(F.coalesce(_short(x, 60, 10), F.lit(False)), found(x["clean"], "last_short_line", x["start"])))
        return F.coalesce(after, evidence, single, last)

    return F.when(raw == "", fallback).otherwise(F.coalesce(
        tagged(r"(?im)^\s*final\s*answer\s*[:：]\s*([^\n\r]*)", "structured_tag"), tagged(r"(?im)^\s*answer\s*[:：]\s*([^\n\r]*)", "answer_tag"),
        bound(F.split(raw, r"\r\n|\n|\r"), lambda lines: bound(table(lines), by_lines)), fallback))


def answer_prefix(raw_text: Column, found: Column) -> Column:
    """The text before the answer: cut from the text as it is, at the place in the stripped one.

    Where the text has space at its start, the cut is early by so much and may fall inside the tag; so it does for those who read it this way.
    """
    return F.when(found["start"].isNotNull(), F.substr(text(raw_text), F.lit(1), found["start"])).otherwise("")


# -- prompts ---------------------------------------------------------------------------------------

def one_decimal(x: Column) -> Column:
    """A number with one decimal: its exact binary value is rounded, a true tie to the even digit. (format_string rounds the shortest decimal form up.)"""
    def rounded(v: Column) -> Column:
        a, k = v["a"], v["k"]
        tie = (2 * k + 1) / F.lit(20.0)
        # what 20 a is beyond 2 k + 1, without rounding: the sum of 16 a and 4 a and its error
        large, small = a * 16.0, a * 4.0
        near = large + small
        part = near - large
        off = (near - (2 * k + 1)) + ((large - (near - part)) + (small - part))
        up = F.when(a != tie, a > tie).when(off != 0, off > 0).otherwise(k % 2 == 1)
        return k + F.when(up, 1).otherwise(0)
    tenths = bound(F.struct(F.abs(x).cast("double").alias("a"), F.floor(F.abs(x) * 10).cast("bigint").alias("k")), rounded)
    return bound(tenths, lambda d: F.concat(F.when(x < 0, "-").otherwise(""), F.floor(d / 10).cast("bigint").cast("string"), F.lit("."), (d % 10).cast("string")))


def number_text(x: Column) -> Column:
    """A whole number without decimals, any other with one."""
    near = F.bround(x)
    return F.when(F.abs(x - near) < 1e-6, near.cast("long").cast("string")).otherwise(one_decimal(x))


def question_text(question: Column, bbox: Column) -> Column:
    """The question with ``[bbox]`` replaced by the box, where that is valid."""
    box = F.concat(F.lit("["), F.array_join(F.transform(bbox, number_text), ", "), F.lit("]"))
    return F.when(F.coalesce(F.size(bbox) == 4, F.lit(False)) & text(question).contains("[bbox]"), F.replace(text(question), F.lit("[bbox]"), box)).otherwise(text(question))
