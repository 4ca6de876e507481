"""Files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from candela.sources import files
from candela.streaming import steps


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_jsonl(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", [{"a": 1, "b": float("nan")}, "", "{bad", {"a": 2}])
    assert files.read_jsonl(spark, p, "a long, b double", strict=False).where("a is not null").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, p, "a long, b double").collect()
    good, bad = files.read_jsonl_audited(spark, p, "a long, b double")
    assert bad.cache().count() == 1
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0
    assert files.line_count(spark, p) == 3 and files.line_count(spark, str(tmp_path / "none")) == -1
    q = lines(tmp_path / "b.jsonl", [{"a": 3}])
    assert sorted((r.shard, r.a) for r in files.merge_jsonl(spark, [q, str(tmp_path / "none"), q], "a long").collect()) == [(0, 3), (2, 3)]
    files.write_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert files.read_document(spark, str(tmp_path / "none"), "a long") is None


def test_paths(spark):
    df = spark.createDataFrame([(1, "img/a.jpg", None), (2, None, "b.jpg"), (3, "zz", None)], "id long, image_file string, image_path string")
    there = spark.createDataFrame([("/d/img/a.jpg",), ("/d/img/b.jpg",)], "path string")
    got = {r.id: r.path for r in files.resolved_paths(df, "id", ["image_file", "image_path"], there, "/d/img").collect()}
    assert got == {1: "/d/img/a.jpg", 2: "/d/img/b.jpg", 3: None}
    assert files.diversity_path("/x/c_shard3.jsonl") == "/x/c_diversity.json"


def test_streams(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    lines(src / "0.json", [{"run": 1, "step": i, "flag": i in (1, 2, 3)} for i in range(4)])
    lines(src / "1.json", [{"run": 1, "step": i, "flag": True} for i in range(4, 6)])
    log = steps.read_steps(spark, str(src), "run long, step long, flag boolean")
    out = steps.drained(steps.streaks(log, "run", "step", "flag", 3), "streaks", "append", str(tmp_path / "c1"))
    assert out.agg(F.max("streak")).first()[0] >= 3 and out.count() == 6
    counts = steps.drained(steps.running_counts(log, "run", "flag"), "counts", "complete", str(tmp_path / "c2")).collect()
    assert [(r.n, r.n_on) for r in counts] == [(6, 5)]
    steps.write_steps(log, str(tmp_path / "copy"), str(tmp_path / "c3"), every=2).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert spark.read.json(str(tmp_path / "copy")).count() == 3


def test_ordered_lines_over_blocks_of_files(spark, tmp_path):
    made = {}
    for name, n in (("a", 400), ("b", 3), ("c", 150)):
        made[name] = [json.dumps({"a": i, "t": name * (i % 40)}) if i % 7 else " \t" * (i % 3) for i in range(n)]
        (tmp_path / name).write_text(("\r\n" if name == "b" else "\n").join(made[name]))
    (tmp_path / "folder").mkdir()
    for i, part in enumerate((made["a"][:90], made["a"][90:])):
        (tmp_path / "folder" / f"part-{i}").write_text("\n".join(part) + "\n")
    (tmp_path / "empty").write_text("")
    paths = [str(tmp_path / n) for n in ("a", "none", "b", "a", "empty", "folder", "c")]
    want, at = [], 0
    for shard, name in enumerate(("a", None, "b", "a", None, "a", "c")):
        for line, value in enumerate(made.get(name, []), 1):
            if value.strip():
                want.append((shard, line, at, value))
                at += 1
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("700", "0"), ("5000", "900"), ("1g", "4m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            assert sorted(tuple(r) for r in files.ordered_lines(spark, paths).select("shard", "line", "ordinal", "value").collect()) == want
            first = files.first_wins(files.merge_jsonl(spark, paths, "a long, t string"), ["a"]).orderBy("a").collect()
            assert [(r.a, r.shard) for r in first] == [(i, 0) for i in range(400) if i % 7]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    files.write_merged(files.ordered_lines(spark, paths), str(tmp_path / "out"))
    assert [r[0] for r in files.ordered_lines(spark, [str(tmp_path / "out")]).orderBy("ordinal").select("value").collect()] == [w[3] for w in want]


def test_merged_records_strict_and_lenient(spark, tmp_path):
    p, q = lines(tmp_path / "a.jsonl", [{"a": 1}, "", "{bad", {"a": 2}]), lines(tmp_path / "b.jsonl", [{"a": 3}])
    with pytest.raises(Exception):
        files.merge_jsonl(spark, [p, q], "a long").collect()
    got = files.merge_jsonl(spark, [p, q], "a long", strict=False).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0, 1), (0, 4, 2, 2), (1, 1, 3, 3)]
    assert files.ordered_lines(spark, [str(tmp_path / "none")]).collect() == []
    with pytest.raises(ValueError):
        files.merge_jsonl(spark, [p], "Line long")
    bad = tmp_path / "doc.json"
    bad.write_text("{ no")
    assert files.read_document(spark, str(bad), "a long") is None
    bad.write_text('{"a": 5}')
    assert files.read_document(spark, str(bad), "a long") == {"a": 5}
