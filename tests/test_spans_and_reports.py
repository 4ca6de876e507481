"""Interval and box joins against all pairs; reports on hand-made groups; bounded examples; greedy selection."""

import random

from pyspark.sql import functions as F

from candela.operators import evaluate, groups, reports, spans


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)

    def some(n, name):
        return [(rng.choice(["hot", "hot", "a", None]), f"{name}{i}", s := rng.choice([None, *range(0, 300, 3)]), None if s is None or rng.random() < 0.02 else s + rng.choice([0, 1, 3, 10, 250, -2])) for i in range(n)]
    left, right = some(150, "l"), some(120, "r")
    schema = "doc string, name string, start long, end long"
    want = sorted((d, a, b, max(s, t), min(e, f)) for d, a, s, e in left for c, b, t, f in right
                  if d is not None and d == c and None not in (s, e, t, f) and s < e and t < f and s < f and t < e)
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for width in (None, 1.0, 7.0, 1000.0):
        met = spans.overlaps(a, b, ["doc"], width=width)
        assert sorted((r.doc, r.left["name"], r.right["name"], r.start, r.end) for r in met.collect()) == want and len(want) > 500
        assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert spans.overlaps(a.limit(0), b, ["doc"]).collect() == []


def test_boxes_against_all_pairs(spark):
    rng = random.Random(2)

    def some(n):
        return [(rng.randrange(2), i, x := rng.uniform(-20, 50), y := rng.uniform(-20, 50), x + rng.choice([0.0, 0.5, 4.0, 30.0]), y + rng.choice([0.25, 4.0, 30.0])) for i in range(n)]
    left, right = some(80), some(90)
    schema = "image long, i long, x1 double, y1 double, x2 double, y2 double"
    want = {(a[0], a[1], b[1]): (min(a[4], b[4]) - max(a[2], b[2])) * (min(a[5], b[5]) - max(a[3], b[3])) for a in left for b in right
            if a[0] == b[0] and a[2] < a[4] and b[2] < b[4] and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])}
    for widths in (None, (3.0, 0.7), (500.0, 500.0)):
        rows = spans.box_overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["image"], widths=widths).collect()
        assert len(rows) == len(want) and all(abs(want[r.image, r.left["i"], r.right["i"]] - r.area) < 1e-9 for r in rows)


def test_word_spans(spark):
    df = spark.createDataFrame([(1, "ab  cde f"), (2, ""), (3, None)], "k long, t string")
    assert sorted(tuple(r) for r in spans.word_spans(df, "k", "t").collect()) == [(1, 0, 0, 2), (1, 2, 4, 7), (1, 3, 8, 9)]


def candidates(spark):
    rows = [  # group, candidate, score, other score, right, text
        ("g", 0, 1.0, 5.0, False, "x"), ("g", 1, 3.0, 5.0, True, "y"), ("g", 2, 3.0, None, False, "z"),
        ("h", 0, float("nan"), 2.0, True, "same"), ("h", 1, None, 1.0, False, " SAME "), ("i", 1, 0.0, None, None, "x"), ("i", 2, 0.0, None, True, "y")]
    full = [(*r, "miss" if not r[4] else "correct_positive", "t" if r[0] < "i" else None, "f", 2 + r[1], r[1] == 1) for r in rows]
    return spark.createDataFrame(full, "g string, candidate_id int, s double, o double, correct boolean, raw_text string, behavior string, task string, family string, answer_length int, is_yesno boolean")


def test_strategy_report(spark):
    long = reports.outcomes(candidates(spark), "g", "candidate_id", {"by_s": ("s", "verifier"), "by_o": ("o", "verifier")}, "by_o").cache()
    t = {r.strategy: r for r in reports.strategy_table(long).collect()}
    assert {n: (r.total, r.correct, r.informative_total, r.strong_informative_correct, r.top1_wrong_but_oracle_right_total) for n, r in t.items()} == {
        "by_s": (2, 1.0, 2, 1.0, 2), "by_o": (2, 1.0, 1, 0.0, 1), "top1": (3, 1.0, 2, 0.0, 2), "oracle": (3, 3.0, 2, 2.0, 2), "random": (3, 1 / 3 + 0.5 + 0.5, 2, 1 / 3 + 0.5, 2)}
    assert (t["by_s"].miss, t["by_s"].correct_positive, t["by_s"].avg_answer_length, t["by_s"].yesno_ratio, t["top1"].miss) == (1, 1, 3.0, 1.0, None)
    pairs = {(r.strategy, r.subset, r.against): (r.n_win, r.n_loss, r.n_tie) for r in reports.pairwise(long, "by_o").collect()}
    assert pairs == {("by_s", "overall", "top1"): (1, 0, 1), ("by_s", "informative", "top1"): (1, 0, 1), ("by_o", "overall", "top1"): (0, 0, 2), ("by_o", "informative", "top1"): (0, 0, 1),
                     ("by_s", "overall", "by_o"): (1, 0, 0), ("by_s", "informative", "by_o"): (1, 0, 0)}
    b = {(r.strategy, r.dim, r.key): r.total for r in reports.breakdown(long).collect()}
    assert b["oracle", "task", None] == 1 and b["oracle", "all", None] == 3 and b["by_s", "behavior", "miss"] == 1 and not any(d == "behavior" and s == "top1" for s, d, _ in b)


def test_step_diagnostics(spark):
    rows = [(True, True, False, 2.0, [1.0, 3.0], "raw", None), (False, True, True, None, [], None, None), (None, False, True, 4.0, None, "raw", None), (True, True, True, 9.0, [9.0], "x", "broken")]
    df = spark.createDataFrame(rows, "exact_match_all boolean, parse_identical boolean, final_reward_identical boolean, template_rate double, final_rewards array<double>, collapse_layer string, error string")
    r = reports.step_diagnostics(df).first()
    assert (r.n_steps, round(r.exact_match_group_rate, 6), r.mean_template_rate, r.mean_final_reward_std_within_group, r.collapse_layer_distribution) == (3, 0.333333, 2.0, 1.0, {"raw": 2, "none": 1})
    assert (r.n_groups_with_same_parse_but_diff_text, r.n_groups_with_diff_text_but_same_final_reward, r.raw_reward_nonconstant_group_rate, r.prompt_side_reward_blocked, r.mean_style_penalty) == (1, 2, 1.0, False, 0.0)
    assert len(r) >= 35 and reports.step_diagnostics(df.where("error = 'none'")).collect() == []


def test_examples_keep_their_limit(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = {r.g: [e["id"] for e in r.examples] for r in reports.examples(df, ["g"], [F.desc("id")], ["id"], 8).collect()}
    assert got == {g: [i for i in range(999, 0, -1) if i % 3 == g][:8] for g in range(3)}


def plain_selection(pool, n, least):
    taken, raws, finals = [], set(), set()
    for step in range(4):
        for i, (_, raw, final) in enumerate(pool):
            if len(taken) >= n or (step == 0 and len(finals) >= least):
                break
            if i not in taken and (step == 3 or (raw and raw not in raws if step == 1 else final and final not in finals)):
                taken.append(i)
                raws |= {raw} - {""}
                finals |= {final} - {""}
    while pool and len(taken) < n:
        taken.append(len(taken) % len(pool))
    return [pool[i][0] for i in taken]


def test_selection_of_large_and_small_pools(spark):
    rng = random.Random(3)
    pools = {f"p{j}": [(10 * i, rng.choice(["", "a", "b", "c", f"r{i % 9}"]), rng.choice(["", "x", "x", f"f{i % 5}"])) for i in range(rng.choice([1, 2, 5, 90]))] for j in range(25)}
    df = spark.createDataFrame([(g, *r) for g, p in pools.items() for r in p], "g string, at long, raw string, final string").repartition(3)
    for n, least in ((1, 1), (4, 2), (7, 5)):
        got = {}
        for r in groups.select_group(df, "g", "at", "raw", "final", n, least).orderBy("g", "slot").collect():
            got.setdefault(r.g, []).append(r.source)
        assert got == {g: plain_selection(p, n, least) for g, p in pools.items()}


def test_win_loss_of_two_choices(spark):
    a = spark.createDataFrame([("g", True), ("h", False), ("i", None), ("j", True)], "g string, correct boolean")
    b = spark.createDataFrame([("g", False), ("h", True), ("i", False), ("k", True)], "g string, correct boolean")
    assert tuple(evaluate.win_loss(a, b, "g", "correct").first()) == (1, 1, 1)
    assert tuple(evaluate.win_loss(a, b, "g", "correct", a.where("g = 'g'")).first()) == (1, 0, 0)
