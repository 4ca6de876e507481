"""Numbers of rows under skew, permutations by arithmetic, the balanced sampler, and long runs scanned in blocks."""

import random

from pyspark.sql import functions as F

from candela.operators import dataset, ranges, telemetry


def test_ordinals_of_clustered_keys(spark):
    rng = random.Random(1)
    keys = rng.sample(range(500_000, 501_000 * 2), 9900) + rng.sample(range(10 ** 9), 100)
    keys = sorted(set(k // 1000 if i % 2 else k for i, k in enumerate(keys)))
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    cut, n = ranges.ranged(df, "k", 16)
    sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * len(keys) / 16
    got = {r.k: r.ordinal for r in ranges.ordinals(df, "k", blocks=16).collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_ordinals_with_nulls_and_none(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "k long")
    assert {r.k: r.ordinal for r in ranges.ordinals(df, "k").collect()} == {1: 0, 2: 1, 3: 2, None: 3}
    assert ranges.ordinals(df.limit(0), "k").collect() == []


def test_shards_of_clustered_keys(spark):
    keys = [*range(1000), 10 ** 12]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted(r.k for r in dataset.modulo_shard(df, 7, 3, "k").collect()) == keys[3::7]
    assert sorted(r.k for r in dataset.range_shard(df, 4, 3, "k").collect()) == keys[753:]


def test_permutations_are_one_to_one(spark):
    for size in (1, 2, 3, 7, 64, 1000):
        df = spark.range(size).crossJoin(spark.range(4).withColumnRenamed("id", "own")).withColumn("own", F.col("own") * 536870911)
        got = df.select("own", "id", ranges.permuted(F.col("id"), F.lit(size).cast("long"), F.col("own")).alias("to")).collect()
        orders = [tuple(r.to for r in sorted(got) if r.own == own) for own in sorted({r.own for r in got})]
        assert all(sorted(o) == list(range(size)) for o in orders)
        if size > 60:
            assert len(set(orders)) == 4 and all(sum(i == x for i, x in enumerate(o)) < 12 for o in orders)
            assert all(abs(sum(a < b for a, b in zip(o, o[1:])) / size - 0.5) < 0.2 for o in orders)


def test_balanced_draws_over_families_in_blocks(spark):
    families = {"a": 23, "b": 5, "c": 57}
    df = spark.createDataFrame([(f, f"{f}{i}") for f, n in families.items() for i in range(n)] + [(None, "x")], "family string, key string").repartition(3)
    got = sorted(tuple(r) for r in dataset.balanced_draws(df, "family", "key", 14, rows_of_block=10).collect())
    assert [s for s, _, _ in got] == list(range(3 * 5 * 14)) and all(f == "abc"[s % 3] for s, f, _ in got)
    for f, n in families.items():
        drawn = [k for _, g, k in got if g == f]
        cycles = [drawn[i: i + n] for i in range(0, len(drawn), n)]
        assert all(len(set(c)) == len(c) for c in cycles)
        assert all(set(c) == {f"{f}{i}" for i in range(n)} for c in cycles[:-1])
        assert len({tuple(c) for c in cycles if len(c) == n}) == len([c for c in cycles if len(c) == n])
    again = sorted(tuple(r) for r in dataset.balanced_draws(df.repartition(5), "family", "key", 14, rows_of_block=10).collect())
    assert again == got and sorted(tuple(r) for r in dataset.balanced_draws(df, "family", "key", 14, seed=1).collect()) != got
    assert dataset.balanced_draws(df.limit(0), "family", "key", 3).collect() == []


def plain_scan(rows):
    out, streak, on = {}, {}, {}
    for run, step, flag in sorted(rows, key=lambda r: r[1]):
        place = len([k for k in out if k[0] == run]) + 1
        streak[run] = streak.get(run, 0) + 1 if flag else 0
        on[run] = on.get(run, 0) + bool(flag)
        out[run, step] = place, streak[run], on[run] / place
    return out


def test_long_runs_in_blocks(spark):
    rng = random.Random(2)
    rows = [("long", i, rng.random() < 0.8) for i in range(400)] + [("other", 7 * i, None if i % 9 == 0 else rng.random() < 0.9) for i in range(60)] + [("on", i, True) for i in range(100, 300)] + [("one", 5, True)]
    rows.sort(key=lambda r: rng.random())
    df = spark.createDataFrame(rows, "run string, step long, flag boolean").repartition(5)
    want = plain_scan(rows)
    for blocks in (1, 3, 40):
        assert {(r.run, r.step): r.streak for r in telemetry.streaks(df, "run", "step", F.col("flag"), blocks).collect()} == {k: v[1] for k, v in want.items()}
        assert {(r.run, r.step): round(r.running_rate, 9) for r in telemetry.running_rate(df, "run", "step", F.col("flag"), blocks).collect()} == {k: round(v[2], 9) for k, v in want.items()}
        longest = {r.run: (r.longest, r.stop_step) for r in telemetry.longest_streaks(df, "run", "step", F.col("flag"), 5, blocks).collect()}
        assert longest["on"] == (200, 104) and longest["one"] == (1, None)
        half = {r.run: (r.n, r.first_half, r.second_half) for r in telemetry.halves(df, "run", "step", "step", blocks=blocks).collect()}
        assert half["on"] == (200, 149.5, 249.5) and "one" not in half
        last = {(r.run, r.step): r.trailing_step for r in telemetry.trailing(df, "run", "step", ["step"], rows=10, every=10, blocks=blocks).collect()}
        assert last == {(run, step): sum(sorted(s for q, s, _ in rows if q == run and s <= step)[-10:]) / 10 for (run, step), v in want.items() if v[0] % 10 == 0}


def test_no_window_over_a_whole_run(spark):
    df = spark.range(1000).select(F.lit("r").alias("run"), F.col("id").alias("step"), (F.col("id") % 3 > 0).alias("flag"))
    plan = telemetry.longest_streaks(df, "run", "step", F.col("flag"), 3, blocks=10)._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window")]
    assert over and all("_block#" in line for line in over)
