"""Summaries: ratios that leave no share, examples, statuses, rewards worked out anew."""

import pytest
from pyspark.sql import functions as F

from candela.operators import rewards, summaries

RAW = "ord long, pair_id string, image_id string, target_bbox array<double>, question string, answer string, gt_present string, image_file string, image_width int, image_height int, task_type string"


def raw(spark):
    rows = [(0, "p", "1", [1.0, 2.0, 3.0, 4.0], "q", "a", "yes", "there/x", 10, 20, "count"), (1, "p", "1", [1.0, 2.0, 3.0, 4.0], "q", "a", None, "x", None, 20, None),
            (2, "r", "2", None, "q", "a", "no", "x", 5, 5, "count"), (3, None, "3", [1.0, 2.0, 3.0, 4.0], "q", "b", "no", None, 0, 20, "count")]
    return spark.createDataFrame(rows, RAW)


def test_data_set_and_its_summary(spark):
    found = F.col("image_file").startswith("there/")
    samples, summary = summaries.loaded(raw(spark), found)
    r = summary.first()
    assert (r.raw_count, r.valid_count, r.dropped_count, r.pair_id_unique, r.pair_id_size_distribution, r.pair_id_exactly_two_ratio) == (4, 3, 1, 2, {2: 1, 1: 1}, 0.5)
    assert (r.task_type_distribution, r.gt_present_type_distribution, r.image_path_resolve_ok_count, r.has_image_size_count) == ({"count": 2, "unknown": 1}, {"bool": 2, "NoneType": 1}, 1, 1)
    few, small = summaries.loaded(raw(spark), found, task="count", most=1)
    assert few.count() == small.first().valid_count == 1
    assert summaries.loaded(raw(spark).limit(0), found)[1].first().valid_count == 0
    for train, val in ((0.9, 0.1), (0.0, 0.1), (0.5, -0.1), (1.2, 0.1)):
        with pytest.raises(ValueError):
            summaries.loaded(raw(spark), found, train=train, val=val)


def test_integrity_lists_what_fails(spark):
    df = spark.range(100).select("id", (F.col("id") % 3 == 0).alias("ok"))
    for most, n in ((10, 6), (0, 66)):
        r = summaries.integrity_report(df, F.col("ok"), "id", most, ["id"]).first()
        assert r.missing == n and [e["id"] for e in r.bad_path_examples] == [i for i in range(100) if i % 3][:min(n, 20)]
    assert summaries.integrity_report(df.where("ok"), F.col("ok"), "id", 10, ["id"]).first().bad_path_examples == []


def test_records(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, 3.0, None), (nan, 2.0, 3.0, None), (None, None, nan, True)], "js double, cos double, l24 double, bad boolean")
    got = summaries.rederived(df, "js", "cos", "l24", 0.25, 0.75)
    assert [(r.reward_mix_js_promptlast, r.reward_mix_cosine_promptlast) for r in got.collect()] == [(2.5, 2.75), (None, 2.75), (None, None)]
    hist = {r.status: r.n for r in summaries.statuses(df, ["js", "cos"], F.lit(True), F.col("bad")).collect()}
    assert hist == {"finite_ok": 1, "partial_finite": 1, "error": 1}
    active = {r.name: r.active for r in summaries.active_rewards(got, rewards.registry(spark)).collect()}
    assert active == dict.fromkeys(("reward_logits_js", "reward_logits_cosine_dist", "reward_layer24_prompt_last_cosine", "reward_mix_js_promptlast", "reward_mix_cosine_promptlast"), True)
    assert summaries.active_rewards(df, rewards.registry(spark)).collect() == []
