"""Operators on small hand-made tables: nulls, NaN, ties, empty groups."""

import math

import pytest
from pyspark.sql import functions as F

from candela.functions import arrays, geometry, stats, text
from candela.operators import audit, checks, dataset, evaluate, groups, rewards, telemetry

CAND = "sample_id long, candidate_id int, score double, correct boolean, raw_text string, ord int"


def test_best_row_skips_nan_and_null_keeps_infinity_and_the_first_of_ties(spark):
    rows = [(1, 0, float("nan"), True, "a", 0), (1, 1, 2.0, False, "b", 1), (1, 2, 2.0, True, "c", 2), (2, 0, None, True, "a", 0), (3, 0, 1.0, False, "a", 0), (3, 1, float("inf"), True, "b", 1)]
    got = groups.best_rows(spark.createDataFrame(rows, CAND), "sample_id", F.col("score"), "ord").orderBy("sample_id").collect()
    assert [(r.sample_id, r.candidate_id) for r in got] == [(1, 1), (3, 1)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], CAND)
    assert groups.best_rows(empty, "sample_id", F.col("score"), "ord").count() == 0
    assert evaluate.degeneracy(empty, "sample_id", "ord", ["score"]).count() == 0
    assert groups.first_occurrences(empty, "sample_id", F.col("raw_text"), "ord", 3).count() == 0
    assert audit.quartile_lift(empty, ["score"], "correct", "ord").count() == 0


def test_gate_raises_where_a_group_has_no_flag(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, None)], "sample_id long, min_unique_satisfied boolean")
    with pytest.raises(ValueError):
        groups.min_unique_gate(df, "sample_id")


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (float("nan"), 1.0)], "x double, y double")
    assert df.agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_advantage_without_spread_is_the_distance(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.0), (2, 1.0)], "g long, r double")
    assert sorted(r.advantage for r in groups.advantages(df, "g", "r").collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_a_reward_at_the_rounded_mean_has_no_advantage_sign(spark):
    rows = [(1, r) for r in (0.1, 0.2, 0.3)] + [(2, r) for r in (1.0, 1.0 + 1e-8)]
    df = spark.createDataFrame(rows, "g long, r double").withColumns({"a": F.lit("x"), "c": F.lit(True)})
    assert sorted((r.g, r.n_positive, r.n_negative) for r in groups.step_metrics(df, "g", "r", "a", "c").collect()) == [(1, 1, 1), (2, 1, 1)]


def test_greedy_selection(spark):
    rows = [(1, 0, "a x", "x"), (1, 1, "b x", "x"), (1, 2, "c y", "y"), (2, 0, "", "")]
    df = spark.createDataFrame(rows, "g long, ord int, raw string, final string")
    got = groups.select_group(df, "g", "ord", "raw", "final", 3, 2).orderBy("g", "slot").collect()
    assert [(r.g, r.source) for r in got] == [(1, 0), (1, 2), (1, 1), (2, 0), (2, 0), (2, 0)]


def test_margin_with_no_one_and_many_negatives(spark):
    rows = [(1, "orig", 0.0), (1, "pos", -1.0), (2, "orig", 0.0), (2, "pos", -1.0), (2, "neg", -1.0), (3, "orig", 0.0), (3, "pos", -2.0), (3, "neg", -1.0), (3, "neg", -2.0)]
    got = {r.k: r.margin for r in rewards.evidence_margin(spark.createDataFrame(rows, "k long, kind string, mean_logprob double"), ["k"]).collect()}
    assert got[1] == pytest.approx(math.tanh(1.0)) and got[2] == pytest.approx(0.0) and got[3] == pytest.approx(math.tanh(0.5 / (0.5 + 1e-6)))


def test_kernels(spark):
    df = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0])], "p array<double>, q array<double>")
    r = df.select(arrays.js(F.col("p"), F.col("p")).alias("same"), arrays.js(F.col("p"), F.col("q")).alias("js"), arrays.entropy(F.col("p")).alias("h"), arrays.logsumexp(F.slice("p", 1, 0)).alias("none"),
                  arrays.top_js(F.col("p"), F.col("q"), 2).alias("short"), arrays.replaced(F.array("p", "q"), F.array(F.lit(0)), "mean", F.array(F.lit(1)))[0].alias("filled")).first()
    assert r.same == pytest.approx(0.0) and r.js == pytest.approx(0.2157615543, abs=1e-6) and r.h == pytest.approx(math.log(2)) and r.none == float("-inf") and r.short is None and r.filled == [1.0, 0.0]


def test_boxes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), (None,), ([0.0, 0.0, 0.0, 4.0],), ([-5.0, 0.0, 20.0, 4.0],)], "b array<double>")
    got = df.select(geometry.primary_box(F.lit(10), F.lit(10), ("arg", F.col("b"))).alias("p")).collect()
    assert [r.p.fallback for r in got] == [True, True, True, False] and got[3].p.bbox == [0.0, 0.0, 10.0, 4.0]
    neg = spark.range(20).select(geometry.negative_box(F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)), F.lit(10), F.lit(10), F.col("id")).alias("n"), F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)).alias("b"))
    assert neg.where("n is not null").select(F.max(geometry.iou(F.col("n"), F.col("b")))).first()[0] <= 0.05


def test_token_spans(spark):
    df = spark.createDataFrame([(["ab", "", "cde"],)], "t array<string>")
    r = df.select(geometry.token_spans(F.col("t")).alias("s")).select("s", geometry.overlapping_tokens(F.col("s"), F.lit(1), F.lit(3)).alias("o")).first()
    assert [(x.start, x.end) for x in r.s] == [(0, 2), (2, 2), (2, 5)] and r.o == [0, 1, 2]


def test_canonical_samples(spark):
    rows = [(0, None, "42", [1.0, 2.0, 3.0, 4.0], "q", "a", "Yes"), (1, "p", None, [1.0, 2.0, 3.0], "q", "a", None), (2, "p", None, [0.0, 0.0, -1.0, 0.0], "q", " ", "0"), (3, "p", None, [0.0, 0.0, -1.0, 0.0], "q", "b", "maybe")]
    df = spark.createDataFrame(rows, "ord long, pair_id string, image_id string, target_bbox array<double>, question string, answer string, gt_present string")
    got = dataset.canonical_samples(df).orderBy("sample_uid").collect()
    assert [(r.pair_id, r.sample_uid, r.image_id, r.gt_present) for r in got] == [("p", "p:3", "-1", None), ("vg_pair_0", "vg_pair_0:0", "42", True)]


def test_streak_and_verdict(spark):
    df = spark.createDataFrame([(1, i, on) for i, on in enumerate([True, True, False, True, True, True])], "run long, step long, on boolean")
    r = telemetry.longest_streaks(df, "run", "step", F.col("on"), 3).first()
    assert (r.longest, r.stop_step) == (3, 5)
    v = telemetry.verdict(spark.createDataFrame([(0.9, 1.0)], "final_reward_identical_rate double, mean_n_negative_advantage double")).first()
    assert v.issues == ["final_reward_identical"] and not v.ok


def test_probes(spark):
    df = checks.with_probes(spark.range(2), [("garbage", "x"), ("garbage", "y"), ("real", "z")])
    assert df.count() == 6 and set(df.columns) == {"id", "probe_group", "probe"}


def test_text_of_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "x string")
    r = df.select(text.norm(F.col("x")).alias("n"), text.yesno(F.col("x")).alias("y"), text.final_answer(F.col("x"))["source"].alias("s"), text.exact_form(F.col("x")).alias("e")).first()
    assert (r.n, r.y, r.s, r.e) == ("", "other", "fallback_raw", "")


def test_numbers_in_texts(spark):
    some = [0.25, 0.35, 0.45, 0.75, 12.35, 12.25, 1.05, 2.675, 99.95, 0.05, 0.15, 1e9 + 0.25, 1e9 + 0.75, 7.0000001, 8.9999999, 3.0, -2.25, -0.35, 123456.85] + [i / 100 for i in range(1, 400, 3)] + [i / 7 for i in range(60)]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    want = [str(round(x)) if abs(x - round(x)) < 1e-6 else f"{x:.1f}" for x in some]
    assert [r.t for r in df.select(text.number_text(F.col("x")).alias("t")).collect()] == want
