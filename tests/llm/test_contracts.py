"""The registered queries on the smallest tables against plain Python, and the stages on columns with clashing names."""

import collections
import math
import os
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candela.llm import common, lm, registry, segment, sharding, topk
from tests.llm.conftest import low, words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@tables
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_and_its_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df, rel = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@tables
def test_sharding_against_plain_rendezvous(spark):
    rows = registry.QUERIES["op7_sharding"](spark, SF).collect()
    keys = sorted({r.doc_id for r in rows})
    # the draws themselves, one row a key and shard
    draws = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[sharding._draw(F.concat(F.lit("="), F.col("k").cast("string")), s).alias(f"s{s}") for s in range(9)]).collect()
    best = {d.k: [max(range(n), key=lambda s: (-1.0 / math.log(d[f"s{s}"]), -s)) for n in (8, 9)] for d in draws}
    assert all([r.shard, r.grown_shard] == best[r.doc_id] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@tables
def test_quality_tells_held_out_rows_apart(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op9_quality"](spark, SF).collect() if r.held_out}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None and r.doc_id in got}
    good, bad = ([got[i].score for i in label if label[i] == y] for y in (1, 0))
    if good and bad:
        assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.8


@tables
def test_base_scores_and_counts_against_plain_counts(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: [*words(t), None] for i, t in docs.items()}
    count = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(count.values()), len(count)
    for r in registry.QUERIES["op3_lm"](spark, SF).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in count for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6)
        assert r.score < 0


def test_model_scores_against_a_plain_class_bigram(spark):
    rows = [(i, " ".join(f"w{(i * j + j * j) % 17}" for j in range(30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    train = df.select("text")
    model, _, n, v = lm.learn(train, 10_000)
    got = {r.doc_id: r.score for r in lm.score_texts(df, F.lit(False)).collect()}
    enc = lambda t: lm.token_ids(*common.text_buffers(__import__("pyarrow").array([t])))[0]
    classes = {i: model.cls[lm._units(enc(t), model.top)] for i, t in rows}
    one = {w: c for i, t in rows for w, c in zip([*t.split(), None], classes[i])}
    count = collections.Counter(w for _, t in rows for w in [*t.split(), None])
    size = len(model.emit)
    pair, own, types = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    for _, t in rows:
        cs = [one[None], *[one[w] for w in [*t.split(), None]]]
        for a, b in zip(cs, cs[1:]):
            pair[a, b] += 1
    for w, c in count.items():
        own[one[w]] += c
        types[one[w]] += 1
    share = (own + 0.5) / (own.sum() + 0.5 * size)
    for i, t in rows:
        before, total = one[None], 0.0
        for w in [*t.split(), None]:
            c = one[w]
            total += math.log10((pair[before, c] + lm.BACKOFF * share[c]) / (pair[before].sum() + lm.BACKOFF)) + math.log10((count[w] + 0.5) / (own[c] + 0.5 * (types[c] + 1)))
            before = c
        assert got[i] == pytest.approx(total, abs=1e-6)


CLASHES = ["score", "_text", "_n_chars", "kept", "n_bytes", "n_removed", "n_spans", "_key", "key", "other", "_rid", "_gone", "row", "id", "node", "also", "kept_sha256"]


@tables
def test_stages_carry_columns_of_any_name(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = common.stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.count() > 0
        assert out.where(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in CLASHES)).count() == 0
        docs = out


def test_segments_of_a_text_beyond_every_slice(spark):
    long = "palabra \u00e9t\u00e9  word\n" * 90_000 + "x" * 50_000
    df = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    assert len(long.encode()) > 1.5 * segment.SLICE
    got = segment.sampled(df, digests=True).select("doc_id", "sample", "decoded", "n_pieces").collect()
    assert len(got) == 6 and all(r.decoded for r in got)


def test_scopes_drop_what_they_stored(spark):
    with common.scratch(spark):
        with common.scratch(spark):
            first, last = common.stored(spark.range(3), "a"), common.stored(spark.range(4), "b")
        assert last.count() == 4
        with pytest.raises(Exception):
            first.collect()


def test_entry_without_a_needed_module():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'op8_simhash' not in q and 'pipeline' not in q; e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_words_are_lower_cased_bytes():
    assert low("ÀB c") == "Àb c".encode() and topk.PIVOTS > 0
