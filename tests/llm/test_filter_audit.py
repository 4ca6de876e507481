"""The filter audit against plain Python: kernels, forced hash collisions, long texts, and all orders of the filters."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import regex

from candela.llm import filter_audit
from candela.llm.common import text_buffers
from tests.llm.conftest import DOC, doc

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(t):
    w = WORD.findall(t)
    return [len(w), len(set(w)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t)]


def texts(rng):
    some = ["", " ", "\t\n", "a", "A#b", "été É 日本語", "x" * 5000, "\x1f\x85 \x0b", "# $ % & * | %%"]
    for _ in range(60):
        some.append(rng.choice([" ", "\n", "\t \r"]).join(rng.choice(["Alpha", "beta", "γ", "d%", "longer-than-eight-bytes", "longer-than-eight-bytez", "E"]) + str(rng.randrange(40)) for _ in range(rng.randrange(400))))
    return some


def test_counts_of_every_text_at_any_slice():
    some = texts(random.Random(1))
    data, offsets = text_buffers(pa.array(some))
    for limit in (1, 7, 1000, 10_000_000):
        assert filter_audit.text_counts(data, offsets, limit).T.tolist() == [plain_counts(t) for t in some]


def test_words_that_share_a_hash_count_apart():
    some = texts(random.Random(2))
    data, offsets = text_buffers(pa.array(some))
    clash = lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3)
    for limit in (200, 10_000_000):
        assert filter_audit.text_counts(data, offsets, limit, clash).T.tolist() == [plain_counts(t) for t in some]


def brute(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        n, distinct, capitals, symbols, points = plain_counts(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        fails = {f for f, x in zip("ABCDE", (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * points, symbols > 0, copy)) if x}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[1]]
                total[f] += len(hit)
                out[part, "".join(order), step] = [len(left) - len(hit), len(hit), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in own), sum(d[2] for d in hit), sum(d[3] for d in hit)]
                left, gone = [d for d in left if f not in d[1]], gone + hit
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def test_all_orders_against_plain_filters(spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        t = " ".join(f"w{rng.randrange(rng.choice([30, 4000]))}" + rng.choice(["", "", "", "%"]) * (rng.random() < 0.02) for _ in range(rng.choice([20, 199, 200, 260])))
        t = t.upper() if rng.random() < 0.3 else t
        rows.append((rng.choice([None, i, i, i, i // 2]), rng.choice([t, t, None, rows[rng.randrange(i)][1] if i else t]), rng.choice(["en", "de", None, ""]), None, 5, 7, 8, "c", "k", 1, "s", 3))
    rows += rows[:9]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs, marks = spark.createDataFrame(rows, DOC).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(filter_audit.masks(docs, marks)).collect()}
    want = brute(rows, labels)
    assert got == want and len(got) == 3 * 600 and math.factorial(5) == 120
    assert any(v[2] for v in want.values()) and any(v[4] and v[5] for v in want.values())


def test_no_rows_give_no_rows(spark, no_docs):
    assert filter_audit.audit(filter_audit.masks(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect() == []
    one = spark.createDataFrame([doc(1, None)], DOC)
    assert filter_audit.audit(filter_audit.masks(one, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 600
