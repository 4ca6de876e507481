"""The pipeline on the smallest tables: each stage against a brute-force version of it, given what it got."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candela.llm import quality
from candela.llm.common import stored
from tests.llm.conftest import words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def shingles(text):
    w = words(text)
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def without_repeats(rows, length=50):
    first, out = {}, {}
    for i, text in sorted(rows.items()):
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k: k + length], i) < i:
                gone[k: k + length] = b"\1" * length
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        if name != "segmentation":
            assert docs.columns == columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
            assert len(seen[name]) == docs.count()
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    machine, share = quality.train(table, labels, ~quality.held_out(F.col("id")))
    assert set(seen["quality"]) == {r.doc_id for r in quality.scored(table, machine, share, F.col("doc_id")).collect() if r.score >= 0.3}
    assert all(seen["quality"][i] == source[i] for i in seen["quality"])

    ids = sorted(seen["quality"])
    sets, root = {i: shingles(seen["quality"][i]) for i in ids}, {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            own, other = sets[i], sets[j]
            if (len(own & other) >= 0.8 * len(own | other) if own | other else True) and root[i] != root[j]:
                root = {x: min(root[i], root[j]) if r in (root[i], root[j]) else r for x, r in root.items()}
    assert set(seen["near_duplicates"]) == set(root.values())

    assert seen["suffix_dedup"] == without_repeats(seen["near_duplicates"])

    items = [s for s in (shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if s]
    clean = {i for i, t in seen["suffix_dedup"].items() if not any(len(shingles(t) & s) >= 0.8 * len(s) for s in items)}
    assert set(seen["decontaminate"]) == clean and len(clean) < len(seen["suffix_dedup"])

    rows = docs.collect()
    assert {r.doc_id for r in rows} == clean and all(r.decoded for r in rows)


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "suffix_dedup", "decontaminate", "segmentation"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
