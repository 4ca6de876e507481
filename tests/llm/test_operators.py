"""The ten operators on small tables: brute force, nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import math
import tempfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from candela.llm import decontaminate, lm, quality, segment, sharding, simhash, suffix, topk, url_filter, warc
from candela.llm.common import components
from tests.llm.conftest import doc, low, words


# -- components -------------------------------------------------------------------------

def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 -------------------------------------------------------------------------------------

def test_topk_keeps_large_components(spark):
    rows = [(0, [20000.0, 1.0]), (1, [20000.0, -1.0]), (2, [3.0, 1.0]), (3, [1e7, 1e7]), (4, [3e7, -2.0 ** -6]), (5, [1e400, 1.0]), (6, None), (7, [1.0, None]), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") >= 0, k=10).collect()
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows if i < 5}
    want = {(q, rank, i, s) for q in v for rank, (s, i) in enumerate(sorted(((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)), 1)}
    assert {(r.query_id, r["rank"], r.vec_id, -r.score) for r in got} == want


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(2)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, [1.0, 2.0]), (2020, []), (None, rows[1][1]), (40, rows[40][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, q string, across int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in ok if i % 20 == 0}:
        v = next(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# -- 2 -------------------------------------------------------------------------------------------

def removed(rows, length):
    first = {}
    for i, b in sorted(((math.inf if i is None else i, low_raw) for i, low_raw in rows), key=lambda r: r[0]):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k: k + length], i)
    out = []
    for i, b in rows:
        me = math.inf if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k: k + length]] < me:
                gone[k: k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark, docs, no_docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = suffix.without_repeats(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == removed(rows, 50)
    assert suffix.without_repeats(no_docs).count() == 0
    rng = np.random.default_rng(5)
    part = [bytes(rng.integers(97, 100, 80)).decode() for _ in range(6)]
    mixed = [doc(i, "".join(part[j] for j in rng.integers(0, 6, 4))[int(rng.integers(0, 40)):]) for i in range(25)]
    got = suffix.without_repeats(spark.createDataFrame(mixed, docs.schema), length=20, gram=8).collect()
    assert sorted((tuple(r) for r in got), key=repr) == removed([(m[0], m[1].encode()) for m in mixed], 20)


def test_collection_by_columns():
    rng = np.random.default_rng(2)
    for _ in range(12):
        strings = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 9)))) for _ in range(int(rng.integers(1, 9)))]
        data, size = np.frombuffer(b"".join(strings) or b"a", np.uint8), np.array([len(s) for s in strings])
        begin = np.cumsum(size) - size
        with tempfile.TemporaryDirectory() as folder:
            bwt, lcp = suffix.Collection(data, begin, begin + size, folder, block=int(rng.integers(2, 30))).arrays()
        order = sorted(([(1, c) for c in s[i:]] + [(0, j)], j, i) for j, s in enumerate(strings) for i in range(len(s) + 1))
        present = sorted(set(data.tolist()))
        assert bwt.tolist() == [0 if i == 0 else 1 + present.index(strings[j][i - 1]) for _, j, i in order]
        common = [0] + [next((k for k, (a, b) in enumerate(zip(x[0], y[0])) if a != b), 0) for x, y in zip(order, order[1:])]
        assert lcp.tolist() == common


# -- 3 -----------------------------------------------------------------------------------------------

def test_lm(docs, no_docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    rows = docs.select("doc_id", "text").collect()
    count = collections.Counter(t for r in rows if not held(r.doc_id) for t in [*words(r.text), None])
    n, v = sum(count.values()), len(count)
    want = sorted(((r.doc_id, held(r.doc_id), len(words(r.text)) + 1, sum(count[t] > 0 for t in [*words(r.text), None]), n, round(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in [*words(r.text), None]), 4)) for r in rows), key=repr)
    got = lm.score_texts(docs, lm.fold(F.col("doc_id")) == 1).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_texts(no_docs, lm.fold(F.col("doc_id")) == 1).count() == 0


def test_exchange_separates_what_follows_what():
    m = np.zeros((9, 9))
    for a in range(4):
        for b in range(4, 8):
            m[a, b] = m[b, a] = 50
    m[8, 0] = m[4, 8] = 1
    cls = lm.exchange(m, classes=3, sweeps=5)
    assert len(set(cls[:4])) == 1 and len(set(cls[4:8])) == 1 and cls[0] != cls[4] and cls[8] == 0


# -- 4 ---------------------------------------------------------------------------------------------------

def test_warc(spark):
    H = {"ETag": "a", "Content-Length": "5", "Server": "s"}
    rows = [(1, "response", "http://www.Ex.com/p/?utm_x=1&b=2&a=1#f", 10, "d1", H), (2, "response", "https://ex.com/p?a=1&b=2", 20, "d2", {"etag": "b"}), (3, "revisit", "http://ex.com:80/p?b=2&a=1", 15, "d1", {"etag": "a", "Date": "now", "Content-Length": "0"}),
            (4, "revisit", "http://ex.com/p?a=1&b=2", 20, "d1", {}), (5, "revisit", "http://ex.com/p?a=1&b=2", 25, "d1", {"etag": "a"}), (6, "revisit", "http://ex.com/other", 25, None, None), (7, "revisit", None, 5, None, None),
            (8, "response", None, 1, None, None), (9, "revisit", "http://ex.com/p?a=1&b=2", None, None, None), (3, "revisit", "http://ex.com:80/p?b=2&a=1", 15, "d1", {"etag": "a", "Date": "now", "Content-Length": "0"}), (10, "other", "x", 1, None, None)]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, digest string, headers map<string,string>").withColumn("near", F.lit(1)).withColumn("span", F.lit("x"))
    got = sorted(((r.record_id, r.response_id, r.status, r.headers) for r in warc.resolve_revisits(df).collect()), key=repr)
    merged = {"etag": "a", "content-length": "5", "server": "s", "date": "now"}
    assert got == sorted([(3, 1, "resolved", merged)] * 2 + [(4, 1, "resolved", {"etag": "a", "content-length": "5", "server": "s"}), (5, 2, "mismatch", None), (6, None, "no_response", None), (7, 8, "unverified", None), (9, None, "no_response", None)], key=repr)
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    bodies = spark.createDataFrame([(1, "BODY")], "record_id long, body string")
    assert {(r.record_id, r.body) for r in warc.with_bodies(warc.resolve_revisits(df), bodies).collect()} >= {(3, "BODY"), (5, None)}


# -- 5 -------------------------------------------------------------------------------------------------------

def test_url_filters(spark):
    rows = [(1, "https://A.Example.org/es/x", None), (2, "http://b.com/fr/1", '<a href="http://good.net/">'), (3, "http://c.com/de/", None), (4, "http://bad.net/x", '<a href="//c.com/de/">'), (5, "http://good.net", None), (6, None, None), (7, "nohost", None),
            (8, "x://example.org/en/1?q", ""), (9, "http://unseen.net/p#f", "<a HREF='https://Unseen.net/y'>"), (1, "https://A.Example.org/es/x", None), (10, "http://notorg/", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = sorted({(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()})
    assert [g[1:] for g in got] == [("a.example.org", "/es/x", "example.org/es/", "block"), ("b.com", "/fr/1", "com/fr/", "allow"), ("c.com", "/de/", "com/de/", "block"), ("bad.net", "/x", None, "block"), ("good.net", "", None, "allow"),
                                    ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/en/1", "example.org/en/1", "block"), ("unseen.net", "/p", None, "allow"), ("notorg", "/", None, "allow")]
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.limit(0)).count() == 0


def test_pagerank_against_matrices(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", 3, 0), ("b", 1, 2)], "host string, trusted long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(edges, seeds, rounds=10).collect()}
    m = np.array([[0, 0, 1], [0.25, 0, 0], [0.75, 1, 0]])
    back = np.array([[0, 0, 0], [0, 0, 0], [0, 0, 0]], float)
    w = np.array([[0, 1, 3], [0, 0, 1], [1, 0, 0]], float)
    back = w / w.sum(axis=0, keepdims=True)
    for k, (step, s) in enumerate(((m, np.array([0.75, 0.25, 0])), (back, np.array([0, 1.0, 0])))):
        x = s.copy()
        for _ in range(10):
            x = 0.85 * step @ x + 0.15 * s
        assert [got[h][k] if h in got else 0.0 for h in "abc"] == pytest.approx(x.tolist(), abs=1e-9)


# -- 6 -----------------------------------------------------------------------------------------------------------

def test_decontaminate(spark, docs, no_docs):
    long_item = " ".join(f"w{i}" for i in range(150))
    items = spark.createDataFrame([(1, "Unrelated SHORT passage about nothing much", 5), (2, "one two", 5), (3, None, 5), (4, "", 5), (5, long_item, 5), (5, long_item, 5), (6, "word1 other1 word2 other2 zz", 5)], "item_id long, text string, doc_id int")
    more = spark.createDataFrame([doc(20, "pre " + long_item[:len(long_item) - 60] + " post"), doc(21, long_item[: len(long_item) // 2])], docs.schema)
    both = docs.unionByName(more)
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contained(both, items).collect())
    sets = lambda t: {tuple(w[i: i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))} if words(t) else set()
    want = sorted((d.doc_id, i.item_id, len(sets(d.text) & sets(i.text)), len(sets(i.text))) for d in both.collect() for i in items.collect() if sets(i.text) and len(sets(d.text) & sets(i.text)) >= 0.8 * len(sets(i.text)))
    assert got == want and {g[0] for g in got} >= {7, 8, 12, 20}
    assert decontaminate.contained(no_docs, items).count() == 0 and decontaminate.contained(docs, items.limit(0)).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------------------------

def test_sharding(spark, docs, no_docs):
    many = docs.unionByName(spark.range(3000).selectExpr("id + 100 as doc_id", "'t' as text", "'' as lang", "'' as source", "1L as n_chars", "1 as bucket", "1L as node", "'' as chunk", "'' as kind", "1 as root", "'s' as shard", "1 as id"))
    got = sharding.shard_table(many).collect()
    assert len(got) == many.count()
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {8} and 0.07 < len(moved) / len(got) < 0.16
    sizes = {r.doc_id: (r["size"], r.text_crc32) for r in got if r.doc_id and r.doc_id < 100}
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect() if r.doc_id}
    assert sizes == {i: (len(t) + 1, zlib.crc32(t)) for i, t in text.items()}
    heavy = collections.Counter(r.shard for r in sharding.shard_table(many, weights=(1.0, 3.0, 0.0)).collect())
    assert set(heavy) == {0, 1} and 2.3 < heavy[1] / heavy[0] < 3.8
    assert sharding.shard_table(no_docs).count() == 0


# -- 8 -------------------------------------------------------------------------------------------------------------------

def fingerprint(text):
    w = words(text)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i: i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, no_docs):
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(((i, f"{f:016x}", least[c]) for (i, f), c in zip(rows, comp)), key=repr)
    assert sorted((tuple(r) for r in simhash.linked_fingerprints(docs).collect()), key=repr) == want
    assert simhash.linked_fingerprints(no_docs).count() == 0


def test_links_against_all_pairs():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = fp[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(200)], dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, near]))
    for radius in (2, 5):
        found = set()
        grid = simhash.cells(fp, radius)
        for g in range(radius + 1):
            for a, b in simhash.links_in_cells(grid[:, g], fp, radius):
                found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        assert found == {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= radius}


def test_near_duplicates(spark, docs, no_docs):
    base = " ".join(f"v{i}" for i in range(200))
    more = [doc(30, base), doc(31, base.replace("v150 ", "zz ")), doc(32, base + " end"), doc(33, " ".join(f"v{i * 7 % 200}" for i in range(200)))]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema)).coalesce(1)
    kept = sorted((r.doc_id for r in simhash.stage_near_duplicates(spark, table, "").select("doc_id").collect()), key=str)
    assert kept == sorted([1, 4, 7, 9, 10, 11, 12, 30, 33], key=str)
    assert simhash.stage_near_duplicates(spark, no_docs, "").count() == 0


def test_large_candidate_groups_go_through_rounds(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "NEIGHBOURS", (1,))
    base = [f"v{i}" for i in range(300)]
    rows = [doc(i, " ".join(w if j != 7 * i else f"new{i}" for j, w in enumerate(base))) for i in range(12)]
    kept = simhash.stage_near_duplicates(spark, spark.createDataFrame(rows, docs.schema).coalesce(1), "").collect()
    assert [r.doc_id for r in kept] == [0]


# -- 9 -----------------------------------------------------------------------------------------------------------------------

def test_quality(spark, docs, no_docs):
    good = [doc(100 + i, " ".join(f"plain{(i * 7 + j) % 50}" for j in range(30))) for i in range(120)]
    junk = [doc(300 + i, " ".join(f"BUY{(i * 5 + j) % 50}!!" for j in range(30))) for i in range(60)]
    table = docs.unionByName(spark.createDataFrame(good + junk, docs.schema))
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in junk] + [(1, None), (None, 1), (2, 5)], "doc_id long, quality int")
    machine, share = quality.train(table, labels, ~quality.held_out(F.col("id")))
    got = {r.doc_id: r.score for r in quality.scored(table, machine, share, F.col("doc_id")).collect()}
    held = [r[0] for r in good + junk if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all((got[i] >= 0.3) == (i < 300) for i in held) and all(0 <= s <= 1 for s in got.values())
    assert quality.scored(no_docs, machine, share, F.col("doc_id")).count() == 0
    none, share = quality.train(table, labels.limit(0), F.lit(True))
    assert none is None and share == 0.5 and quality.scored(docs, none, share, F.col("doc_id")).count() == docs.count()


def test_machine_against_all_pairs():
    m = quality.Machine(rank=3)
    m.w = np.random.default_rng(1).normal(size=m.w.shape).astype(np.float32)
    place, x = np.array([3, 9, 20, 3, 7]), np.array([0.5, -1.0, 2.0, 1.5, 0.3], dtype=np.float32)
    y, _ = m.raw(np.array([0, 0, 0, 1, 1]), place, x, 2)
    for row, part in ((0, range(3)), (1, range(3, 5))):
        want = sum(m.w[place[i]] * x[i] for i in part) + sum(m.v[place[i]] @ m.v[place[j]] * x[i] * x[j] for i in part for j in part if i < j)
        assert y[row] == pytest.approx(float(want), rel=1e-4, abs=1e-5)


# -- 10 ---------------------------------------------------------------------------------------------------------------------------

def test_segmentation_round_trip(spark, docs, no_docs):
    odd = spark.createDataFrame([doc(50, " ▁ lead  and\n\ttabs 🙂 \u0000 end "), doc(51, "a")], docs.schema)
    table = docs.where("length(text) < 5000 or text is null").unionByName(odd)
    out = segment.sampled(table.withColumn("rk", F.monotonically_increasing_id()), key="rk")
    back = segment.decoded(out.select(F.concat_ws("-", "rk", "sample").alias("k"), "ids"), key="k").collect()
    text = {r.rk: r.text or "" for r in table.withColumn("rk", F.monotonically_increasing_id()).collect()}
    assert all(r.text == text[int(r.k.split("-")[0])] for r in back)
    per = collections.defaultdict(set)
    for r in out.collect():
        per[r.rk].add(tuple(r.ids))
        assert r.log_inclusion <= 1e-12 and r.log_prob <= 0
    assert all(len(per[k]) == (1 if not t else 2 if t == "a" else 3) for k, t in text.items())
    same = segment.sampled(table, digests=True).where("doc_id = 9").select("sample", "pieces_hash").distinct().count()
    assert same == 3 and segment.sampled(table, digests=True).where("not decoded").count() == 0
    assert segment.sampled(no_docs).count() == 0


def by_text(found, n):
    """A list of (ids, log_prob, log_inclusion) for each text."""
    row, _, sizes, log_prob, log_in, ids = found
    out, cut = [[] for _ in range(n)], np.concatenate([[0], np.cumsum(sizes)])
    for i, r in enumerate(row.tolist()):
        out[r].append((ids[cut[i]: cut[i + 1]], log_prob[i], log_in[i]))
    return out


def test_samples_follow_their_weights():
    import pyarrow as pa

    from candela.llm.common import text_buffers
    p = segment.Pieces.load(alpha=0.3)
    index = {p.raw[i]: i for i in range(259, len(p.raw))}
    weight = {}

    def walk(b, at, ids, lp):
        if at == len(b):
            weight[tuple(ids)] = math.exp(lp)
        for end in range(at + 1, len(b) + 1):
            if b[at:end] in index:
                walk(b, end, [*ids, index[b[at:end]]], lp + p.logp[index[b[at:end]]])

    walk(b" tea", 0, [], 0.0)
    z, n = sum(weight.values()), 8000
    data, offsets = text_buffers(pa.array(["tea"] * n))
    got = by_text(segment.sample_slice(p, data, offsets, segment._seeds(np.arange(n), 5), 3), n)
    firsts, seconds = (collections.Counter(tuple(g[k][0].tolist()) for g in got) for k in (0, 1))
    for s, w in weight.items():
        pr = w / z
        second = sum(x / z * pr / (1 - x / z) for t, x in weight.items() if t != s)
        assert firsts[s] / n == pytest.approx(pr, abs=4 * math.sqrt(pr / n) + 1e-3)
        assert seconds[s] / n == pytest.approx(second, abs=4 * math.sqrt(second / n) + 1e-3)
        if pr > 0.05:  # inverse inclusion probabilities make the sum unbiased
            assert np.mean([sum(math.exp(-x[2]) for x in g if tuple(x[0].tolist()) == s) for g in got]) == pytest.approx(1.0, abs=0.1)
