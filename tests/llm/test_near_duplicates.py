"""Near-duplicates against brute force, on copies with paragraphs appended or cut."""

import random

import numpy as np

from candela.llm import simhash
from tests.llm.conftest import doc, words


def shingles(text):
    w = words(text)
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def zipf(rng, n):
    return [f"w{int(3000 ** rng.random())}" for _ in range(n)]


def edited():
    """(id, text): texts of 60 to 1000 words, each with a copy that has an appended or a missing end, J about 0.75 to 0.9."""
    rng, rows = random.Random(5), []
    footer = zipf(rng, 30)
    for i in range(90):
        n = (60, 200, 1000)[i % 3]
        base, share = zipf(rng, n), rng.uniform(0.1, 0.3)
        more = zipf(rng, int(n * share)) if i % 2 else base[: 0]
        copy = base + more if i % 2 else base[: int(n * (1 - share))]
        if i % 5 == 0:
            base, copy = base + footer, copy + footer
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    return rows


def groups(rows, threshold=0.8):
    """The smallest id that each text is connected to."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, own in enumerate(sets):
        for j in range(i):
            if jaccard(own, sets[j]) >= threshold:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [rows[r][0] for r in root]


def test_appended_and_cut_paragraphs(spark, docs):
    rows = edited()
    table = spark.createDataFrame([doc(*r) for r in rows], docs.schema).coalesce(1)
    kept = {r.doc_id for r in simhash.stage_near_duplicates(spark, table, "").collect()}
    expected = set(groups(rows))
    assert 30 < len(rows) - len(expected) < 80
    assert kept == expected


def test_one_of_a_chain_stays(spark, docs):
    rng = random.Random(3)
    w = zipf(rng, 120)
    rows = [(i, " ".join(w[i * 10: i * 10 + 90] + [f"only{i}"])) for i in range(4)]
    rows = [rows[1], rows[0], rows[2], rows[3]]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    table = spark.createDataFrame([doc(*r) for r in rows], docs.schema)
    assert {r.doc_id for r in simhash.stage_near_duplicates(spark, table, "").collect()} == set(groups(rows, 0.8))
    got = {r.id: r.group_id for r in simhash.near_duplicates(table, threshold=0.6).collect()}
    assert got == dict(zip([i for i, _ in rows], groups(rows, 0.6))) and len(set(got.values())) < 4


def test_any_order_and_radius_give_the_same(spark, docs, monkeypatch):
    rows = edited()[:60]
    table = spark.createDataFrame([doc(*r) for r in rows], docs.schema).coalesce(1)
    found = []
    for radius, sample, frequent in ((8, 1, 4), (3, 1, 4), (0, 20_000_000, 1)):
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        monkeypatch.setattr(simhash, "FREQUENT", frequent)
        found.append(sorted((r.id, r.group_id, r.kept) for r in simhash.near_duplicates(table, radius=radius).collect()))
    assert found[0] == found[1] == found[2] and not all(k for _, _, k in found[0])


def test_equal_rows_and_null_ids_count_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (7, text), (7, text), (8, text + " more"), (9, ""), (None, None), (10, "unlike all of the others by far")]
    table = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], "doc_id long, text string, _node string, kept string, n int, id int").repartition(3)
    got = simhash.stage_near_duplicates(spark, table, "")
    assert got.columns == table.columns
    assert sorted((r.doc_id, r._node, r.kept, r.n, r.id) for r in got.collect()) == [(7, "x", "y", 1, 2), (9, "x", "y", 1, 2), (10, "x", "y", 1, 2)]


def test_manhattan_bounds_hamming_and_cells_meet(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    hamming, low = np.bitwise_count(a ^ b), simhash.manhattan(simhash.unary(a), simhash.unary(b))
    assert (low <= hamming).all() and (low < hamming).any()
    for alike in (1, 2, 3):
        assert (simhash.cells(a, 3, alike) == simhash.cells(b, 3, alike)).any(axis=1)[hamming <= 3].all()
