"""Tops of long vectors against a full sort, and noise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.functions import arrays, stats, vectors
from candela.sources import files


def test_top_places_against_a_sort():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300):
        for spread in (2, 50, 10 ** 9):
            a = rng.integers(0, spread, n).astype(float)
            for k in {1, n // 2 or 1, n}:
                assert vectors.top_places(a, k).tolist() == sorted(sorted(range(n), key=lambda i: (-a[i], i))[:k])


def test_divergences_of_tops(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, n).astype(float).tolist(), rng.normal(size=m).tolist()) for i, (n, m) in enumerate([(40, 40), (10, 10), (11, 11), (5, 5), (20, 21), (0, 0)])] + [(6, None, [1.0]), (7, [1.0] * 30, [2.0] * 30)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    got = {r.id: r for r in vectors.top_divergences(df, "id", "a", "b", (10, 20)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 7]
    for i, a, b in rows:
        for k in (10, 20):
            if i not in got:
                continue
            r = got[i]
            if len(a) != len(b) or k >= len(a):
                assert r[f"js_{k}"] is r[f"cos_{k}"] is r[f"mass_{k}"] is None
                continue
            at = sorted(range(len(a)), key=lambda j: (-a[j], j))[:k]
            p, q = ([math.exp(x) / sum(map(math.exp, v)) for x in v] for v in (a, b))
            mass = sum(p[j] for j in at)
            p, q = [p[j] / mass for j in at], [q[j] / sum(q[j] for j in at) for j in at]
            js = 0.5 * sum(x * math.log(2 * x / (x + y)) + y * math.log(2 * y / (x + y)) for x, y in zip(p, q))
            x, y = np.array(a)[at], np.array(b)[at]
            assert (r[f"mass_{k}"], r[f"js_{k}"]) == (pytest.approx(mass), pytest.approx(js, abs=1e-12))
            assert r[f"cos_{k}"] == pytest.approx(1 - x @ y / max(math.sqrt(x @ x) * math.sqrt(y @ y), 1e-8))


def test_noise_is_normal_and_repeats(spark):
    df = spark.range(4000).select("id", F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(0.0), F.lit(4.0)), F.array(F.lit(7.0), F.lit(7.0))).alias("s"))
    noisy = df.select("id", vectors.noised(F.col("s"), F.array(F.lit(1), F.lit(9)), F.col("id"), 3).alias("n"))
    r = noisy.agg(F.avg(noisy.n[1][0]), F.stddev(noisy.n[1][0]), F.corr(noisy.n[1][0], noisy.n[1][1]), F.min(noisy.n[2][0]), F.max(noisy.n[0][1])).first()
    sd = math.sqrt(8)
    assert abs(r[0]) < 0.2 and abs(r[1] - sd) < 0.2 and abs(r[2]) < 0.06 and r[3:] == (7.0, 5.0)
    assert noisy.exceptAll(df.repartition(7).select("id", vectors.noised(F.col("s"), F.array(F.lit(1), F.lit(9)), F.col("id"), 3))).count() == 0
    assert arrays.replaced is not None and pytest.raises(ValueError, arrays.replaced, F.col("s"), F.array(F.lit(1)), "noise")


def test_spans_states_and_correlations(spark):
    df = spark.createDataFrame([([],), ([2.0],), ([1.0, 4.0],), (None,)], "v array<double>")
    assert [tuple(r) for r in df.select(*[arrays.span_reduced(F.col("v"), m) for m in ("mean", "max", "single")]).collect()] == [(0.0, 0.0, 0.0), (2.0, 2.0, 2.0), (2.5, 4.0, 5.0), (0.0, 0.0, 0.0)]
    seq = spark.createDataFrame([([[1.0, 0.0], [3.0, 0.0]], [[0.0, 1.0], [0.0, 1.0]])], "a array<array<double>>, b array<array<double>>")
    d = seq.select(arrays.state_distances(F.col("a"), F.col("b"), F.array(F.lit(0), F.lit(1), F.lit(9)), F.lit(1)).alias("d"), arrays.state_distances(F.col("a"), F.col("b"), F.array(F.lit(5)), F.lit(4)).alias("e")).first()
    assert d.d.tgt_cosine == 1.0 and d.d.tgt_l2 == pytest.approx(math.sqrt(5)) and d.d.prompt_last_l2 == pytest.approx(math.sqrt(2)) and d.d.seq_last_l2 == pytest.approx(math.sqrt(10))
    assert d.e.tgt_cosine is None and d.e.prompt_last_l2 == d.e.seq_last_l2
    rows = [("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", 3.0, 6.0), ("nan", 1.0, 1.0), ("nan", float("nan"), 2.0), ("nan", 3.0, 3.0), ("nan", 4.0, 9.0), ("few", 1.0, 2.0), ("few", 2.0, 3.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(stats.pearson_of_all(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got["ok"] == pytest.approx(1.0) and all(math.isnan(got[k]) for k in ("nan", "few", "flat"))


def test_paths_of_a_data_set(spark):
    df = spark.createDataFrame([("/a//b",), ("./x/./y/",), ("z",), ("",), (None,)], "p string")
    assert [r.c for r in df.select(files.adapter_candidates(F.col("p"), "/r/").alias("c")).collect()] == [["/a//b"], ["/r/x/y", "x/y"], ["/r/z", "z"], [], []]
