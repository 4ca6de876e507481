"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; the bit counts of the
segments are a point whose Manhattan distance to another's never exceeds the
Hamming distance.  Points are joined within Manhattan distance r on a grid: the segments are dealt
into r + j groups, and as at most r groups can differ, two points within r have the counts of j
groups at least in common.  So the cells are (j of the groups, their counts); j grows with the
number of points, so that cells stay small, and the result is the same at any.  In a cell, points are sorted by
their total count, which differs by r at most; each pair in that window is kept if the Manhattan
distance of the counts is r or less, and then verified on the fingerprints themselves.

Each distinct point is joined once, however many rows share it, and each task
hands on a spanning forest of the links it has found, not the pairs; the
forests are merged by distributed components.

Defined results of ``linked_fingerprints``: null texts are empty; a text without words has fingerprint
zero and links like any other; null ids take part and get the
component of their fingerprint, which is null only if all its ids are; repeated rows each get
their row; an empty table gives an empty table; other columns are not read, whatever their names.

``near_duplicates`` decides by similarity, the exact Jaccard similarity of the sets of k-word shingles; groups are
connected by pairs of at least the threshold.  Pairs first meet by fingerprints of their
distinct words at CANDIDATE_RADIUS or less (and, as similar sets have similar sizes, sizes within
the threshold).  What these miss comes from an exact prefix filter: with all shingles in one order,
rare ones first, two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each,
and the places of the first one they share bound what they can have in common; parity maps of the sets, which differ in no more bits than
the sets in shingles, drop most other pairs where they meet.
Shingles and texts are told apart by 64 and 128 bits of hash.

Defined results of ``near_duplicates``: null texts are empty, texts without words are similar to each other and to
nothing else, those of fewer than k words have one shingle; null ids come after all others, and equal rows count once;
an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import components, local_roots, lowered, map_distances, map_words, mix, ordered, parity_maps, scratch, shingle_hashes, slices, stored, text_buffers, text_or_empty, trimmed, word_hashes, words

SEED = 42
RADIUS = 2
K = 5
SIMILARITY = 0.8
CANDIDATE_RADIUS = 3
#: Rows of (long, long) up to which a table is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Shingles at least, and one text in how many at most, in the sample that tells frequent ones; the least count there, and
#: how many are kept. They only order the shingles, and any order gives the same result.
SAMPLE = 1_000_000
SAMPLE_ONE_IN = 16
FREQUENT = 4
FREQUENT_ROWS = 1 << 18
#: Neighbours in a cell that are compared in each round, before all that is still apart there.
NEIGHBOURS = (2, 64)
#: Prefix shingles, and points, that one task meets, about.
CELL_ROWS = 300_000
#: Points in a cell, about, up to which the grid has cells of fewer groups.
CELL_POINTS = 16
_EVEN = np.uint64(0x5555555555555555)


# -- fingerprints --------------------------------------------------------------

def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row the 64 bits that over half of its hashes have; zero for rows without hashes."""
    out = np.zeros(len(counts), dtype=np.uint64)
    ends = np.cumsum(counts)
    for i, (lo, hi) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
        if hi > lo:
            bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[i] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > hi - lo, bitorder="little").view(np.uint64)[0]
    return out


def shingle_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """SimHash of the k-word shingles, repeats included, each hashed by XXH64 as its space-joined words."""
    data = lowered(data)
    starts, ends, counts = words(data, offsets)
    size = ends - starts
    begin = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    solid = np.ones(len(joined), dtype=bool)
    solid[begin + size] = False
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    joined[solid] = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.repeat((np.cumsum(counts) - counts) - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    last = first + np.repeat(np.minimum(counts, k), per) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(begin[first].tolist(), (begin + size)[last].tolist())], dtype=np.uint64)
    return majority_bits(hashes, per)


def word_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """SimHash of the distinct words, the number of distinct k-word shingles, and the parity map of these."""
    data = lowered(data)
    starts, ends, counts = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    order = ordered(h, row)
    r, x = row[order], h[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    fp = majority_bits(x[new], np.bincount(r[new], minlength=n))
    s, per = shingle_hashes(h, counts, k)
    row = np.repeat(np.arange(n), per)
    order = ordered(s, row)
    r, x = row[order], s[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    size = np.bincount(r[new], minlength=n)
    return fp, size, parity_maps(x[new], size)


def _print_shingles(k: int):
    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            fp = [shingle_fingerprints(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], k) for lo, hi in slices(offsets)]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return run


def _print_words(k: int):
    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            parts = [word_fingerprints(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], k) for lo, hi in slices(offsets)]
            fp = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            size = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("node"), b.column("other"), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int64)), pa.array([m for p in parts for m in p[2]], pa.binary())], names=["id", "node", "other", "fp", "size", "bits"])
        trimmed()
    return run


# -- grid join -------------------------------------------------------------------

def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed two bits each."""
    return fp - ((fp >> np.uint64(1)) & _EVEN)


def unary(fp: np.ndarray) -> np.ndarray:
    """The segments' counts with as many set bits each: differing bits are then the Manhattan distance."""
    counts = segment_counts(fp)
    return counts | ((counts >> np.uint64(1)) & _EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points in the form of ``unary``."""
    return np.bitwise_count(a ^ b)


def cells(fp: np.ndarray, radius: int, alike: int = 1) -> np.ndarray:
    """Grid cells of each point: a column for each choice of ``alike`` of the radius + ``alike`` groups of segments."""
    counts, groups = segment_counts(fp), radius + alike
    cut = [2 * (32 * g // groups) for g in range(groups + 1)]
    masks = [np.uint64(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(cut[:-1], cut[1:])]
    out = []
    for n, chosen in enumerate(combinations(range(groups), alike)):
        mask = np.uint64(0)
        for g in chosen:
            mask |= masks[g]
        out.append(mix((counts & mask) ^ mix(np.full(1, n + 1, np.uint64))))
    return np.stack(out, axis=1) if len(fp) else np.zeros((0, len(out)), np.uint64)


def alike_groups(points: int, radius: int, least: int = 1) -> int:
    """Groups that a cell has in common, ``least`` at least: so many that evenly spread points (1.5 bits a segment) are about CELL_POINTS in a cell."""
    return next((j for j in range(least, 5) if 48 * j / (radius + j) >= np.log2(max(1, points / CELL_POINTS))), 5)


def _dealt(radius: int, alike: int, banded: bool):
    """(node, fp, size) to (cell, node, fp): a row for each cell, and twice for the bands of size."""
    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            node = b.column("node").to_numpy()
            key = cells(fp, radius, alike)
            if banded:
                band = np.floor(np.log(np.maximum(b.column("size").to_numpy(), 1)) / np.log(1 / SIMILARITY) + 1e-9).astype(np.uint64) + np.uint64(1)
                key = np.concatenate([mix(key + band[:, None]), mix(key + (band + np.uint64(1))[:, None])], axis=1)
            times = key.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, times)), pa.array(np.repeat(fp.view(np.int64), times))], names=["cell", "node", "fp"])
    return run


def links_in_cells(cell: np.ndarray, fp: np.ndarray, radius: int):
    """Positions (a, b) of verified links within the cells, in portions; input in any order."""
    weight = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((weight, cell))
    cell, fp, weight = cell[order], fp[order], weight[order]
    point = unary(fp)
    at, step = np.arange(len(cell)), 1
    while True:
        at = at[at + step < len(cell)]
        near = (cell[at] == cell[at + step]) & (weight[at + step] - weight[at] <= radius)
        at = at[near]  # rows past the window stay past it at greater steps
        if not len(at):
            return
        hit = at[manhattan(point[at], point[at + step]) <= radius]
        hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + step]) <= radius]
        if len(hit):
            yield order[hit], order[hit + step]
        step += 1


def _forest(radius: int):
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        cell, node, fp = (t.column(n).to_numpy() for n in ("cell", "node", "fp"))
        names, which = np.unique(node, return_inverse=True)
        root, held, n = np.arange(len(names)), [], 0
        found: list[np.ndarray] = []

        def grown(root: np.ndarray) -> np.ndarray:
            """Roots with the held links in, of which one for each union is kept."""
            ab = np.concatenate(held, axis=1)
            for a, b in ab.T.tolist():
                ra, rb = a, b
                while root[ra] != ra:
                    ra = root[ra]
                while root[rb] != rb:
                    rb = root[rb]
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    found.append((a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    return root
                root = up
        for a, b in links_in_cells(cell, fp.view(np.uint64), radius):
            a, b = which[a], which[b]
            held.append(np.stack([a, b])[:, root[a] != root[b]])
            n += held[-1].shape[1]
            if n > 100_000:
                root, held, n = grown(root), [], 0
        if n:
            grown(root)
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(names[pairs[:, 0]]), pa.array(names[pairs[:, 1]])], names=["a", "b"])
        trimmed()
    return run


def links(points: DataFrame, radius: int, banded: bool = False) -> DataFrame:
    """Links (a, b) that connect what all links connect; ``points``: distinct (node, fp[, size]), a stored table."""
    spread, n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.count()
    alike = alike_groups(n, radius, 2 if banded else 1)  # points of distinct words cluster more
    dealt = points.mapInArrow(_dealt(radius, alike, banded), "cell long, node long, fp long")
    rows = n * len(list(combinations(range(radius + alike), alike))) * (2 if banded else 1)
    return dealt.repartition(max(spread, rows // CELL_ROWS), "cell").mapInArrow(_forest(radius), "a long, b long")


def linked_fingerprints(documents: DataFrame, k: int = 3, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as hex, component_id) of every row."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    prints = stored(docs.mapInArrow(_print_shingles(k), "doc_id long, fp long"), "prints")
    with scratch(documents.sparkSession):
        classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        found = components(links(classes.select(F.col("fp").alias("node"), "fp"), radius))
        rooted = stored(classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- prefix filter -----------------------------------------------------------------

def distinct_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles, ascending in each row, and the number of them."""
    data = lowered(data)
    starts, ends, counts = words(data, offsets)
    s, per = shingle_hashes(word_hashes(data, starts, ends), counts, k)
    row = np.repeat(np.arange(len(per)), per)
    order = ordered(s, row)
    r, x = row[order], s[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return x[new], np.bincount(r[new], minlength=len(per))


def _sampled(k: int, one_in: int):
    """Counts of the shingles of the texts whose node is in the sample."""
    def run(batches):
        for b in batches:
            node = b.column("node").to_numpy().view(np.uint64)
            b = b.filter(pa.array(mix(node) % np.uint64(one_in) == 0))
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                s, _ = distinct_shingles(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], k)
                names, n = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])
    return run


def prefixes(data: np.ndarray, offsets: np.ndarray, k: int, threshold: float, frequent: np.ndarray, times: np.ndarray):
    """Prefix of each row's shingles, rare ones first: shingle, row, place in the row, and the size of each row.

    ``frequent``: ascending hashes of frequent shingles, ``times``: their counts.  A row without
    shingles has the one entry 0.
    """
    s, size = distinct_shingles(data, offsets, k)
    row = np.repeat(np.arange(len(size)), size)
    often = np.zeros(len(s), dtype=np.int64)
    if len(frequent) and len(s):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = np.where(frequent[at] == s, times[at], 0)
    order = ordered(s, often, row)
    place = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
    long = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    keep = place < long[row]
    none = np.flatnonzero(size == 0)
    return np.concatenate([s[order][keep], np.zeros(len(none), np.uint64)]), np.concatenate([row[keep], none]), np.concatenate([place[keep], np.zeros(len(none), np.int64)]), size


def _prefix_rows(k: int, threshold: float, shared):
    """(node, text) to (cell, node, size, place), each node once in a task."""
    def run(batches):
        frequent, times = shared.value
        seen: set[int] = set()
        for b in batches:
            fresh = []
            for x in b.column("node").to_pylist():
                fresh.append(x not in seen)
                seen.add(x)
            b = b.filter(pa.array(fresh, pa.bool_()))
            node = b.column("node").to_numpy()
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                cell, row, place, size = prefixes(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], k, threshold, frequent, times)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(node[lo:hi][row]), pa.array(size[row].astype(np.int32)), pa.array(place.astype(np.int32))],
                                                 names=["cell", "node", "size", "place"])
    return run


def near_in_cells(cell: np.ndarray, size: np.ndarray, place: np.ndarray, threshold: float, first: int = 1, last: int | None = None, maps: np.ndarray | None = None):
    """Positions (a, b) of pairs in the cells that may be similar, in portions; sorted by cell and size. ``maps``: parity maps of the rows' sets."""
    at, step = np.arange(len(cell)), first
    while last is None or step <= last:
        at = at[at + step < len(cell)]
        to = at + step
        at = at[(cell[at] == cell[to]) & (size[at] >= threshold * size[to] - 1e-9)]  # rows past the window stay past it at greater steps
        if not len(at):
            return
        to = at + step
        # of the first shingle they share, all before it in either set is apart
        most = np.minimum(size[at] - place[at], size[to] - place[to])
        hit = most >= threshold / (1 + threshold) * (size[at] + size[to]) - 1e-9
        hit |= size[at] + size[to] == 0
        a, b = at[hit], to[hit]
        if maps is not None:
            close = map_distances(maps, a, b) <= (1 - threshold) / (1 + threshold) * (size[a] + size[b]) + 1e-9
            a, b = a[close], b[close]
        if len(a):
            yield a, b
        step += 1


def _in_cells(batches):
    t = pa.Table.from_batches(batches)
    cell, node, size, place = (t.column(n).to_numpy() for n in ("cell", "node", "size", "place"))
    order = np.lexsort((node, size, cell))
    order = order[np.concatenate([[True], (cell[order][1:] != cell[order][:-1]) | (node[order][1:] != node[order][:-1])])]
    return t, order, cell[order], node[order], size[order].astype(np.int64), place[order].astype(np.int64)


def _met(threshold: float):
    """The rows that may be similar to another of their cell, each node once."""
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, order, cell, _, size, place = _in_cells(got)
        some = np.zeros(len(order), dtype=bool)
        for a, b in near_in_cells(cell, size, place, threshold):
            some[a] = some[b] = True
        yield from t.take(pa.array(order[some])).combine_chunks().to_batches()
    return run


def _cell_pairs(threshold: float, first: int, last: int | None):
    """Pairs (a, b) of nodes at ``first`` to ``last`` steps in a cell; with a column root, of those with different ones."""
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t, order, cell, node, size, place = _in_cells(got)
        root = t.column("root").to_numpy()[order] if "root" in t.column_names else node
        maps = map_words(t.column("bits"))[order]
        names, which = np.unique(node, return_inverse=True)
        held, n = [], 0

        def pairs():
            ab = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(names[ab // len(names)]), pa.array(names[ab % len(names)])], names=["a", "b"])
        for a, b in near_in_cells(cell, size, place, threshold, first, last, maps):
            apart = root[a] != root[b]
            a, b = which[a[apart]], which[b[apart]]
            held.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
            n += len(a)
            if n > 2_000_000:
                yield pairs()
                held, n = [], 0
        if n:
            yield pairs()
    return run


# -- near-duplicates by similarity -------------------------------------------------

def _shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    data, offsets = text_buffers(texts)
    out: list[np.ndarray] = []
    for lo, hi in slices(offsets):
        part = lowered(data[offsets[lo]: offsets[hi]])
        starts, ends, counts = words(part, offsets[lo: hi + 1] - offsets[lo])
        s, per = shingle_hashes(word_hashes(part, starts, ends), counts, k)
        cut = np.concatenate([[0], np.cumsum(per)])
        out += [np.unique(s[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def _similar_pairs(k: int, threshold: float):
    def run(batches):
        for b in batches:
            sides = []
            for node, text in (("a", "text_a"), ("b", "text_b")):  # a text of many pairs is read once a batch
                _, first, which = np.unique(b.column(node).to_numpy(), return_index=True, return_inverse=True)
                sets = _shingle_sets(b.column(text).take(pa.array(first)), k)
                sides.append([sets[i] for i in which])
            yield b.select(["a", "b"]).filter(pa.array([similar(x, y, threshold) for x, y in zip(*sides)], pa.bool_()))
    return run


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar; ``rows``: (id, node, text), ``nodes``: (node, first)."""
    with scratch(pairs.sparkSession):
        pairs = stored(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            return pairs
        wanted = stored(pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
                        .join(nodes.select("node", F.col("first.id").alias("_id")), F.col("_node") == F.col("node")).select("_node", "_id"), "wanted")
        few = wanted.count() <= BROADCAST_ROWS
        one_each = (rows.join(F.broadcast(wanted) if few else wanted, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")))
                    .select("node", "text").dropDuplicates(["node"]))
        texts = stored(one_each, "pair_texts")
        one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar_pairs(k, threshold), "a long, b long"), "similar")


def similar_groups(rows: DataFrame, nodes: DataFrame, known: DataFrame, k: int, threshold: float) -> DataFrame:
    """(node, root) of what similar pairs connect, some of which are ``known``; ``rows``: (id, node, text).

    Neighbours in each cell are verified first, then more distant ones and at last all pairs that are still in different
    components, so that a large group of copies is not compared pair by pair.
    """
    spark = rows.sparkSession
    shingles = int(nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    texts = rows.select("node", "text")
    often = (texts.mapInArrow(_sampled(k, min(SAMPLE_ONE_IN, max(1, shingles // SAMPLE))), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "cell").limit(FREQUENT_ROWS).toArrow())  # at most FREQUENT_ROWS rows
    cell, n = often.column("cell").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(cell)
    shared = spark.sparkContext.broadcast((cell[order], n[order]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // 4 // CELL_ROWS)
    schema = "cell long, node long, size int, place int"
    met = stored(texts.mapInArrow(_prefix_rows(k, threshold, shared), schema).repartition(parts, "cell").mapInArrow(_met(threshold), schema), "met")
    met = stored(met.join(nodes.select(F.col("node").alias("_node"), "bits"), F.col("node") == F.col("_node")).drop("_node"), "met_bits")
    first, out, roots = 1, known, None
    for last in (*NEIGHBOURS, None):
        held = met
        if roots is not None:
            held = met.join(F.broadcast(roots) if few else roots, F.col("node") == F.col("_node"), "left").select("cell", "node", "size", "place", "bits", F.coalesce("root", "node").alias("root"))
        near = _verified(held.repartition(parts, "cell").mapInArrow(_cell_pairs(threshold, first, last), "a long, b long"), rows, nodes, k, threshold)
        out, first = out.unionByName(near), (last or 0) + 1
        if roots is None or not near.isEmpty():
            roots = stored(components(out), "roots").withColumnRenamed("node", "_node")
            few = roots.count() <= BROADCAST_ROWS
    return roots.withColumnRenamed("_node", "node")


def _keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, node, other): the two hashes tell texts apart."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"))
    return rows.select("id", "text", F.xxhash64("text", F.octet_length("text")).alias("node"), F.xxhash64(F.octet_length("text"), "text").alias("other"))


def near_duplicates(documents: DataFrame, k: int = K, threshold: float = SIMILARITY, radius: int = CANDIDATE_RADIUS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each distinct id and text: id, node and other (hashes of the text), n (such rows),
    group_id (the smallest id of what similar pairs connect) and kept: whether it is that id's first text.

    ``radius`` says which pairs meet by fingerprint first; the others meet in the prefix filter, so the result
    is the same at any.  A text whose ``node`` is another's as well is kept, as a group of its own.
    """
    with scratch(documents.sparkSession):
        rows = _keyed(documents, doc_id, text)
        prints = stored(rows.mapInArrow(_print_words(k), "id long, node long, other long, fp long, size long, bits binary"), "prints")
        counted = stored(prints.groupBy("node", "other", "id").agg(F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bits").alias("bits")), "counted")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "other", "fp", "size", "bits")).alias("first")
        nodes = stored(counted.groupBy("node").agg(first).select("node", "first", F.col("first.fp").alias("fp"), F.col("first.size").alias("size"), F.col("first.bits").alias("bits")), "nodes")
        near = _verified(links(nodes.select("node", "fp", "size"), radius, banded=True), rows, nodes, k, threshold)
        found = similar_groups(rows, nodes, near, k, threshold)
        rooted = nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
        rooted = stored(rooted, "rooted")
        lead = rooted.groupBy("root").agg(F.min(F.struct("first.none", "first.id", "node")).alias("lead"))
        named = rooted.join(lead, "root").select("node", F.col("first.other").alias("_other"), F.col("first.id").alias("_first"), "lead")
        own = F.col("other") == F.col("_other")
        kept = ~own | ((F.col("node") == F.col("lead.node")) & F.col("id").eqNullSafe(F.col("lead.id")))
        return stored(counted.join(named, "node").select("id", "node", "other", "n", F.when(own, F.col("lead.id")).otherwise(F.col("id")).alias("group_id"), kept.alias("kept")), "near_duplicates")


def without_near_duplicates(documents: DataFrame, k: int = K, threshold: float = SIMILARITY, radius: int = CANDIDATE_RADIUS,
                            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose id and text ``near_duplicates`` keeps; of equal ones any one."""
    with scratch(documents.sparkSession):
        judged = near_duplicates(documents, k, threshold, radius, doc_id, text)
        acted = stored(judged.where("not kept or n > 1").select(F.col("id").alias("_id"), F.col("node").alias("_node"), F.col("other").alias("_other"), "kept"), "acted")
    few, again = acted.count() <= BROADCAST_ROWS, not acted.where("kept").isEmpty()
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"), F.struct("*").alias("row"))
    rows = rows.select("row", "id", F.xxhash64("text", F.octet_length("text")).alias("node"), F.xxhash64(F.octet_length("text"), "text").alias("other"))
    met = rows.join(F.broadcast(acted) if few else acted, (F.col("node") == F.col("_node")) & (F.col("other") == F.col("_other")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    out = met.where("kept is null").select("row.*")
    if again:
        out = out.unionByName(met.where("kept").groupBy("node", "other", "id").agg(F.first("row").alias("row")).select("row.*"))
    return out


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), with all its columns, whatever their names."""
    return without_near_duplicates(docs)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
