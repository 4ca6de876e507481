"""Centroid clustering by rounds of Lloyd's, with a tree over the vectors and a tree over the centroids.

The vectors lie in blocks, each with a cover tree that is built once and stored: points in
farthest-first order, whose levels are the powers of two below the distance at which a point was chosen, so the points of a level and above are apart by
that power at least and cover the level below within twice of it; each point hangs from the nearest one of the levels above,
and points not chosen lie in the bucket of the nearest chosen one.  In each round the centroids get such a tree of their
own.  Pairs of nodes, one of each tree, are followed down level by level: a pair is given up when its least possible
distance is above the largest possible distance to the best centroid known for the node of vectors.  A node left with one
centroid is assigned whole; leaf pairs are compared exactly, in whole numbers.

A round hands on a count and sums for each task and centroid; the sums are whole numbers of 38 digits, and only they, a row a
centroid, come to the driver.

Defined results: vectors of another length than asked for, null or with null or non-finite components, and rows without an id, take no part;
repeated rows are vectors each; with fewer vectors than centroids each vector starts one; an empty table gives an empty table; other columns are not
read, whatever their names.  A component or distance that no long can hold ends in an error.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import scratch, stored
from candela.llm.topk import scaled

CENTROIDS = 16
ROUNDS = 3
DIMENSION = 64
#: Vectors of a block, and of how many one is chosen for the tree's inner nodes.
BLOCK = 1024
BUCKET = 8
#: Largest component with which distances of 64 components are exact in longs.
NARROW = 1 << 27
#: Pairs of a vector and a centroid that are compared at a time.
PAIRS = 16_384


# -- trees -----------------------------------------------------------------------

class Tree:
    """Nodes level by level: ``center`` (a point), points ``lo`` to ``hi``, ``radius`` about the center, ``child`` and ``children`` (the first, how many)."""

    FIELDS = (("center", np.int32), ("lo", np.int32), ("hi", np.int32), ("child", np.int32), ("children", np.int32), ("radius", np.float64))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)


def cover_tree(x: np.ndarray, most: int) -> tuple[Tree, np.ndarray]:
    """Cover tree with at most ``most`` points above the buckets, and the order of the rows in which each node's are together."""
    x = x.astype(np.float64)
    chosen, reach = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())], [np.inf]
    near, owner = ((x - x[chosen[0]]) ** 2).sum(axis=1), np.zeros(len(x), np.int64)
    while len(chosen) < min(most, len(x)):
        at = int(near.argmax())
        if near[at] <= 0:
            break
        reach.append(float(np.sqrt(near[at])))
        d = ((x - x[at]) ** 2).sum(axis=1)
        closer = d < near
        near[closer], owner[closer] = d[closer], len(chosen)
        chosen.append(at)
    level = np.floor(np.log2(reach))
    below: list[dict[float, list[int]]] = [{} for _ in chosen]
    for i in range(1, len(chosen)):
        above = int(np.searchsorted(-level, -level[i]))  # those of higher levels come first
        parent = int(((x[chosen[:above]] - x[chosen[i]]) ** 2).sum(axis=1).argmin())
        below[parent].setdefault(level[i], []).append(i)
    buckets = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=len(chosen)))[:-1])
    order: list[np.ndarray] = []

    def node(i: int, steps: list[list[int]], at: int):
        """(point, lo, hi, nodes below) of the point ``i`` with its points of the levels ``steps``, from place ``at``."""
        if not steps:
            order.append(buckets[i])
            return chosen[i], at, at + len(buckets[i]), ()
        under, end = [], at
        for j, rest in [(i, steps[1:]), *[(j, list(below[j].values())) for j in steps[0]]]:
            under.append(node(j, rest, end))
            end = under[-1][2]
        return chosen[i], at, end, under

    rows, line = [], [node(0, list(below[0].values()), 0)]
    while line:
        rows += line
        line = [u for n in line for u in n[3]]
    order = np.concatenate(order)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    children = np.array([len(n[3]) for n in rows])
    ordered = x[order]
    radius = [np.sqrt(((ordered[lo:hi] - x[c]) ** 2).sum(axis=1).max()) for c, lo, hi, _ in rows]
    return Tree(center=place[[n[0] for n in rows]].astype(np.int32), lo=np.array([n[1] for n in rows], np.int32), hi=np.array([n[2] for n in rows], np.int32),
                child=(1 + np.cumsum(children) - children).astype(np.int32), children=children.astype(np.int32), radius=np.array(radius)), order


def joined(trees: list[Tree], sizes: list[int]) -> tuple[Tree, np.ndarray]:
    """Trees side by side over their points one after the other, and their roots."""
    nodes, points = (np.concatenate([[0], np.cumsum(n)])[:-1] for n in ([len(t.lo) for t in trees], sizes))
    moved = {name: np.concatenate([getattr(t, name) + (points[i] if name in ("center", "lo", "hi") else nodes[i] if name == "child" else 0) for i, t in enumerate(trees)]) for name, _ in Tree.FIELDS}
    return Tree(**moved), nodes


def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), then those of the next."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows, as whole numbers: longs where they fit for certain, else of any size."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) <= NARROW * 8 // max(8, int(np.sqrt(x.shape[1]))):
        d = x - c
        return (d * d).sum(axis=1)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


def pair_distances(x: np.ndarray, point: np.ndarray, own: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``exact_distances`` of x[point] and own[which]; where most pairs are asked for, from a product of doubles, if it is exact."""
    rows, at = np.unique(point, return_inverse=True)
    low = x[rows]
    if 4 * len(point) >= len(rows) * len(own) and 4 * x.shape[1] * max(int(np.abs(low).max()), int(np.abs(own).max())) ** 2 < 1 << 53:
        low, high = low.astype(np.float64), own.astype(np.float64)
        d = (low * low).sum(axis=1)[:, None] + (high * high).sum(axis=1)[None] - 2.0 * (low @ high.T)
        return d[at, which].astype(np.int64)
    return np.concatenate([exact_distances(x[point[i: i + PAIRS]], own[which[i: i + PAIRS]]) for i in range(0, len(point), PAIRS)])


def dual_tree_labels(x: np.ndarray, tree: Tree, roots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each row (of equally near ones the first), and the number of exact comparisons it took."""
    own, first = np.unique(centroids, axis=0, return_index=True)
    own, first = own[np.argsort(first)], np.sort(first)
    ctree, order = cover_tree(own, len(own))
    number, own = first[order], own[order]
    at = x[tree.center].astype(np.float64)
    cat = own[ctree.center].astype(np.float64)
    most = np.full(len(tree.lo), np.inf)
    n, c = np.asarray(roots, dtype=np.int64), np.zeros(len(roots), np.int64)
    label = np.full(len(x), -1, dtype=np.int64)
    pairs_n, pairs_c = [], []
    while len(n):
        d = np.concatenate([np.sqrt(((at[n[i: i + PAIRS]] - cat[c[i: i + PAIRS]]) ** 2).sum(axis=1)) for i in range(0, len(n), PAIRS)])
        np.minimum.at(most, n, d + tree.radius[n])
        # distances are rounded: what could be as near as the bound, but for that, stays
        keep = d - tree.radius[n] - ctree.radius[c] <= most[n] * (1 + 1e-9) + 1e-6
        n, c = n[keep], c[keep]
        begins = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        count = np.diff(np.append(begins, len(n)))
        open_c = ctree.children[c] > 0
        some_open = np.add.reduceat(open_c, begins) > 0
        sole = (count == 1) & ~some_open
        whole, by = n[begins[sole]], c[begins[sole]]
        label[spans(tree.lo[whole], tree.hi[whole] - tree.lo[whole])] = np.repeat(number[ctree.lo[by]], tree.hi[whole] - tree.lo[whole])
        leaf = ~sole & ~some_open & (tree.children[n[begins]] == 0)
        done = np.repeat(leaf, count)
        pairs_n.append(n[done])
        pairs_c.append(c[done])
        left = ~done & ~np.repeat(sole, count)
        n, c = n[left], c[left]
        down, across = np.maximum(tree.children[n], 1), np.maximum(ctree.children[c], 1)
        inner, cinner = tree.children[n] > 0, ctree.children[c] > 0
        pair = np.repeat(np.arange(len(n)), down * across)
        k = spans(np.zeros(len(n), np.int64), down * across)
        below = np.where(inner[pair], tree.child[n[pair]] + k // across[pair], n[pair])
        most[below] = np.minimum(most[below], most[n[pair]])
        c = np.where(cinner[pair], ctree.child[c[pair]] + k % across[pair], c[pair])
        order = np.argsort(below, kind="stable")
        n, c = below[order], c[order]
    n, c = np.concatenate(pairs_n or [n]), np.concatenate(pairs_c or [c])
    size = (tree.hi[n] - tree.lo[n]).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, np.int64)
    before = np.append(np.cumsum(size) - size, size.sum())[np.append(begins, len(n))]
    at = 0
    while at < len(begins):  # whole leaves, about PAIRS pairs at a time
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, side="right")) - 1)
        own_pairs = slice(begins[at], begins[to] if to < len(begins) else len(n))
        point, which = spans(tree.lo[n[own_pairs]].astype(np.int64), size[own_pairs]), np.repeat(ctree.lo[c[own_pairs]], size[own_pairs])
        d = pair_distances(x, point, own, which)
        if d.dtype == object:
            order = np.array(sorted(range(len(d)), key=lambda i: (point[i], d[i], number[which[i]])), dtype=np.int64)
        else:
            order = np.lexsort((number[which], d, point))
        best = order[np.concatenate([[True], point[order][1:] != point[order][:-1]])]
        label[point[best]] = number[which[best]]
        at = to
    return label, int(size.sum())


# -- blocks ------------------------------------------------------------------------

BLOCKS = "n int, ids binary, v binary, " + ", ".join(f"{name} binary" for name, _ in Tree.FIELDS)


def _blocks(dimension: int, block: int, bucket: int):
    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            x = b.column("v").flatten().to_numpy().reshape(-1, dimension)
            for lo in range(0, len(ids), block):
                part, own = x[lo: lo + block], ids[lo: lo + block]
                tree, order = cover_tree(part, -(-len(own) // bucket))
                fields = [pa.array([getattr(tree, name).astype(kind).tobytes()], pa.binary()) for name, kind in Tree.FIELDS]
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int32()), pa.array([own[order].tobytes()], pa.binary()), pa.array([part[order].tobytes()], pa.binary()), *fields],
                                                 names=["n", "ids", "v", *[name for name, _ in Tree.FIELDS]])
    return run


def _read(b: pa.RecordBatch, dimension: int):
    """ids, vectors, tree and roots of a batch of blocks."""
    def column(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(name).to_pylist()), dtype=kind)

    trees = [Tree(**{name: np.frombuffer(b.column(name)[i].as_py(), dtype=kind) for name, kind in Tree.FIELDS}) for i in range(b.num_rows)]
    tree, roots = joined(trees, b.column("n").to_pylist())
    return column("ids", np.int64), column("v", np.int64).reshape(-1, dimension), tree, roots


def _sums(centroids: np.ndarray):
    """Counts and sums of each centroid's vectors, a row a centroid and task."""
    kind = pa.list_(pa.decimal128(38, 0))

    def run(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        compared = seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            _, x, tree, roots = _read(b, centroids.shape[1])
            label, took = dual_tree_labels(x, tree, roots, centroids)
            compared, seen = compared + took, seen + len(x)
            order = np.argsort(label, kind="stable")
            names, begins = np.unique(label[order], return_index=True)
            exact = int(np.abs(x).max()) * len(x) < 1 << 62
            sums = np.add.reduceat((x if exact else x.astype(object))[order], begins, axis=0)
            for name, n, s in zip(names.tolist(), np.diff(np.append(begins, len(x))).tolist(), sums.astype(object)):
                before = total.get(name, (0, 0))
                total[name] = before[0] + n, before[1] + s
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([n for _, (n, _) in rows], pa.int64()), pa.array([[Decimal(int(v)) for v in s] for _, (_, s) in rows], kind),
                                          pa.array([compared] + [0] * (len(rows) - 1) if rows else [], pa.int64())], names=["cluster", "n", "sums", "compared"])
    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, tree, roots = _read(b, centroids.shape[1])
            label, _ = dual_tree_labels(x, tree, roots, centroids)
            d = np.concatenate([exact_distances(x[i: i + PAIRS], centroids[label[i: i + PAIRS]]) for i in range(0, len(x), PAIRS)])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label.astype(np.int32)), pa.array(d.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])
    return run


def centroid_rounds(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, list[int]]:
    """Centroids after the rounds, and the exact comparisons of each round."""
    schema, dimension, took = "cluster int, n long, sums array<decimal(38,0)>, compared long", centroids.shape[1], []
    for _ in range(rounds):
        found = blocks.mapInArrow(_sums(centroids), schema).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dimension)]).collect()  # a row a centroid
        took.append(sum(r.compared for r in found))
        centroids = centroids.copy()
        for r in found:
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dimension)]
    return centroids, took


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", embedding: str = "embedding",
              block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; the start is ``k`` of them by hash of seed and id."""
    spark = vectors.sparkSession
    fit = F.when(F.size(embedding) == dimension, scaled(F.col(embedding), scale))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), fit.alias("v")).where("id is not null and v is not null")
    with scratch(spark):
        start = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(k).select("v").collect()
        centroids = np.array([r.v for r in start], dtype=np.int64).reshape(-1, dimension)
        blocks = stored(rows.mapInArrow(_blocks(dimension, block, bucket), BLOCKS), "blocks")
        if len(centroids):
            centroids, _ = centroid_rounds(blocks, centroids, rounds)
        assigned = stored(blocks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # a row a centroid
    digests = [(r.cluster, r.inertia, sum(x.inertia for x in per), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in per]
    named = spark.createDataFrame(digests, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return assigned.join(F.broadcast(named), F.col("cluster") == F.col("_cluster")).drop("_cluster")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT id, e, arg_min(c, d * 16 + c) AS c, min(d) AS d
  FROM (SELECT id, e, n, c, CAST(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY id, e, n),
s{i} AS (SELECT c, p, CAST(sum(x) AS BIGINT) AS x, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{i}) GROUP BY c, p),
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(any_value(t.m), any_value(c{i}.m)) AS m
  FROM c{i} LEFT JOIN (SELECT c, list((x - ((x % n) + n) % n) // n ORDER BY p) AS m FROM s{i} GROUP BY c) t ON t.c = c{i}.c GROUP BY c{i}.c),"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, m) - 1 AS INT) AS c, m
  FROM (SELECT sha256('1:' || CAST(id AS VARCHAR)) AS h, e AS m FROM v) ORDER BY h, m LIMIT 16),{"".join(map(_round_sql, range(ROUNDS)))}
a AS MATERIALIZED (
  SELECT id, arg_min(c, d * 16 + c) AS c, min(d) AS d
  FROM (SELECT id, n, c, CAST(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{ROUNDS}) GROUP BY id, n)
SELECT id AS vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} z ON a.c = z.c
"""

QUERIES = {"op13_centroids": op13_centroids}
ORACLES = {"op13_centroids": OP13_SQL}
