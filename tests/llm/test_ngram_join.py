"""The n-gram join against all pairs: edits, chains, long lists dealt into parts, short texts, hashes of long texts in pieces."""

import random

import numpy as np
import pyarrow as pa

from candela.llm import ngram_join, simhash
from candela.llm.common import parity_maps, shingle_sets, text_buffers
from tests.llm.conftest import DOC, doc, words


def grams(text):
    w = words(text)
    return {tuple(w[i: i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    """Sorted (id, number of shingles, smallest id of the component), by all pairs of sets."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if root[i] != root[j] and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root[i], root[j]
                root = [x if r == y else r for r in root]
    out = []
    for i, s in enumerate(sets):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((rows[i][0], len(s), min(ids, default=None)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([doc(*r) for r in rows], DOC).repartition(5)
    return sorted((tuple(r) for r in ngram_join.ngram_components(df).collect()), key=repr)


def prose(rng, n):
    return [f"w{int(2000 ** rng.random())}" for _ in range(n)]


def edited(rng, n):
    rows = []
    for i in range(n):
        base = prose(rng, rng.choice([5, 12, 40, 150, 700]))
        rows.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy, share = list(base), rng.uniform(0.0, 0.06)
            for _ in range(int(len(copy) * share) + 1):
                at = rng.randrange(len(copy))
                copy[at: at + rng.randrange(2)] = prose(rng, rng.randrange(3))
            rows.append(rng.choice([" ", "\n"]).join(copy + (prose(rng, int(len(copy) * 0.15)) if rng.random() < 0.3 else [])))
    return rows


def test_against_all_pairs(spark):
    rng = random.Random(1)
    some = edited(rng, 120) + [None, "", " \t", "one", "ONE", "one two", "One  two", "a b c d", "a b c d e f g", "a b c d e f g h"]
    rows = list(enumerate(some)) + [(None, some[0]), (None, "only here without any id at all"), (None, None), (3, some[3]), (3, some[3]), (4, some[0])]
    rng.shuffle(rows)
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] != r[0] for r in got) > 25


def test_large_groups_in_parts_and_lists_of_several_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 8)
    rng, rows = random.Random(2), []
    base, shared = prose(rng, 120), prose(rng, 80)
    for i in range(150):  # one group, no two alike
        copy = list(base)
        copy[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    for i in range(150, 260):  # a long passage in common, but not enough of it
        rows.append((i, " ".join(shared + [f"o{i}x{j}" for j in range(14 + i % 3)])))
    for i in range(260, 300):  # pairs among these
        rows.append((i, " ".join(shared + [f"p{i // 2}x{j}" for j in range(14)] + [f"q{i}"])))
    assert run(spark, rows) == brute(rows)
    for last, most in ((None, 1), (2, 3)):
        monkeypatch.setattr(ngram_join, "NEIGHBOURS", () if last is None else (last,))
        monkeypatch.setattr(ngram_join, "MOST_MATCHES", most)
        assert run(spark, rows) == brute(rows)


def test_no_rows(spark, no_docs):
    assert ngram_join.ngram_components(no_docs).collect() == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_prefixes_share_the_matches_they_ask_for():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 3000, 1 << 12).astype(np.uint32)
    asked = set()
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, max(1, n // 12))):], rng.integers(0, 1 << 63, int(rng.integers(0, 3 + n // 12)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b) or not ngram_join.similar(a, b):
            continue
        sides = []
        for s in (a, b):
            order, _, place, inside, _, l = ngram_join.adaptive_prefixes(s, np.array([len(s)]), counts)
            sides.append((dict(zip(s[order][inside].tolist(), place[inside].tolist())), int(l[0]), len(s)))
        both = min(sides[0][1], sides[1][1])
        shared = [x for x in sides[0][0] if x in sides[1][0] and all(at[x] < n - ngram_join.least_overlap(np.array(n)) + both for at, _, n in sides)]
        assert len(shared) >= both
        asked.add(both)
    assert len(asked) > 1


def test_maps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(6)
    for n in (1, 30, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, n // 9 + 1, dtype=np.uint64)]))
        x, y = (np.frombuffer(m, np.uint64) for m in parity_maps(np.concatenate([a, b]), np.array([len(a), len(b)])))
        apart = len(np.setxor1d(a, b))
        assert apart / 3 < np.bitwise_count(x ^ y).sum() <= apart and (np.bitwise_count(x ^ y).sum() - apart) % 2 == 0


def test_sets_of_long_texts_in_pieces():
    rng = random.Random(5)
    some = [" ".join(prose(rng, n)) for n in (0, 1, 3, 4, 5, 40, 3000)] + ["", "x" * 900, ("ab " * 700).upper()]
    data, offsets = text_buffers(pa.array(some))
    for k in (1, 4, 5):
        s, size = simhash.distinct_shingles(data, offsets, k)
        for limit in (16, 300, 1 << 20):
            got = list(shingle_sets(data, offsets, k, limit))
            assert [g[:2] for g in got][0][0] == 0 and got[-1][1] == len(some)
            assert (np.concatenate([g[2] for g in got]) == s).all() and (np.concatenate([g[3] for g in got]) == size).all()
