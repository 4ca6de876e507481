"""What a task holds and does for a row, where that once grew with the tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from candela.operators import contract, dataset, groups, ranges
from candela.plans import boxes, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_candidates_part_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 500, raising=False)
    sizes = [r[0] for r in tables.candidates(spark, SF).groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert len(sizes) >= 10 and max(sizes) < 1000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_matched_box_is_sized_once(spark):
    plan = boxes.compared_boxes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") < 12


def test_a_matched_box_without_a_place_takes_the_far_corner(spark):
    b = F.array(*map(F.lit, (0.0, 0.0, 90.0, 90.0)))
    row = spark.range(1).select(contract.area_matched_box(b, F.lit(100.0), F.lit(100.0), F.col("id")).alias("a")).first().a
    assert row[0] == pytest.approx(100.0 - row[2]) and row[1] == pytest.approx(100.0 - row[3])


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 2**31 + 11])
def test_permuted_in_batches_is_the_fold(spark, size):
    df = spark.range(min(size, 500)).select((F.lit(size).cast("long") - 1 - F.col("id")).alias("place"), F.lit(size).cast("long").alias("size"), (F.col("id") * 7919 % 11 + 2147483000 * (F.col("id") % 2)).alias("own"))
    got = df.select(ranges.permuted_in_batches(F.col("place"), F.col("size"), F.col("own")).alias("a"), ranges.permuted(F.col("place"), F.col("size"), F.col("own")).alias("b")).collect()
    assert got and all(r.a == r.b for r in got)


def test_draws_have_no_fold(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "family string, key long")
    assert "reduce(" not in dataset.balanced_draws(df, "family", "key", 2)._jdf.queryExecution().optimizedPlan().toString()


def _few_tables(spark, folder, turned: bool, parts: int = 4) -> str:
    """Orders of four lines alike in number and price, in the files' order or turned about."""
    lines = [(o, (o + i) % parts, 1, 1.0 + i, 100.0, 0.01 * i, 0.02, "RNAR"[i]) for o in range(60) for i in range(4)]
    tables_ = {"lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"),
               "orders": ([(o, "1-URGENT") for o in range(60)], "o_orderkey long, o_orderpriority string"), "part": ([(p, f"part {p}") for p in range(parts)], "p_partkey long, p_name string")}
    for name, (rows, schema) in tables_.items():
        spark.createDataFrame(rows[::-1] if turned else rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_places_of_like_lines_do_not_hang_on_the_order_of_files(spark, tmp_path):
    one, other = (sorted(map(tuple, tables.candidates(spark, _few_tables(spark, tmp_path / str(t), t)).collect())) for t in (False, True))
    assert one == other and len(one) == 240


def test_many_parts_meet_in_partitions_by_rows(spark, tmp_path, monkeypatch):
    folder = _few_tables(spark, tmp_path / "t", False, parts=40)
    whole = sorted(map(tuple, tables.candidates(spark, folder).collect()))
    monkeypatch.setattr(tables, "ROWS", 30)
    df = tables.candidates(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan and "hashpartitioning(l_partkey" in plan
    assert sorted(map(tuple, df.collect())) == whole


@pytest.mark.parametrize("parts", [4, 40])
def test_no_scan_is_shuffled_into_more_partitions_than_few(spark, tmp_path, monkeypatch, parts):
    folder = _few_tables(spark, tmp_path / "t", False, parts)
    whole = sorted(map(tuple, tables.candidates(spark, folder).collect()))
    monkeypatch.setattr(tables, "ROWS", 30)
    monkeypatch.setattr(tables, "FEW", 5, raising=False)
    df = tables.candidates(spark, folder)
    for few in (df, df.select("sample_id", "score_ties")):  # whatever columns are read
        lines = [line for line in few._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line or "Scan parquet" in line]
        above = [a for a, b in zip(lines, lines[1:]) if "Scan" in b and "Scan" not in a]
        assert len(above) == (2 if parts == 4 else 3) and all(re.search(r", 5\), REPARTITION_BY_NUM", a) for a in above)
        assert sum(", 8), REPARTITION_BY_NUM" in x for x in lines) == 2
    assert sorted(map(tuple, df.collect())) == whole


def test_first_occurrences_number_texts_in_the_partitions_of_candidates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 30)
    c = tables.candidates(spark, _few_tables(spark, tmp_path / "t", False))
    df = groups.first_occurrences(c, "sample_id", F.col("raw_text"), "candidate_id", 3)
    exchanges = [d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for d in (c, df)]
    assert exchanges[0] == exchanges[1] and df.columns == c.columns
    assert sorted((r.sample_id, r.candidate_id, r.raw_text) for r in df.collect()) == [(o, i, f"part {i}") for o in range(60) for i in range(3)]
