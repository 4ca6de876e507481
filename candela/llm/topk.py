"""Exact top-k by inner product with pivot-table elimination.

Every vector's distances to many pivots are computed once and travel with it.
For a query q and a candidate x the largest |d(q, p) - d(x, p)| over the pivots
bounds d(q, x) from below, and as q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 that bounds the
score from above.  Candidates are scored in the order of their bounds, until the next
bound is below the k-th best score: no candidate left can enter.

Queries and candidates meet in a grid of cells, each holding at most about
QUERY_BLOCK queries and DATA_BLOCK candidates; the k best of each cell are merged per query.

Scores are exact integers: products of doubles where |q||x| stays below 2^52, whole numbers of Python where it does not.  A score or
component that no long can hold ends in an error.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of
different lengths are not compared; a query's own row is every row with its id; repeated
query rows are one query, repeated candidate rows are candidates each; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
DATA_BLOCK = 4096
PIVOTS = 16
#: Vectors (the first by hash of the id) from which the pivots are chosen; results don't depend on them.
PIVOT_SAMPLE = 2048
FIRST = 192


def _pivots(sample: list[np.ndarray], count: int) -> np.ndarray:
    """Farthest-first choice among the sampled vectors of the commonest length."""
    if not sample:
        return np.zeros((0, 0))
    sizes = [len(v) for v in sample]
    size = max(sorted(set(sizes)), key=sizes.count)
    x = np.array([v for v in sample if len(v) == size], dtype=np.float64).reshape(-1, size)
    far = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen: list[int] = []
    near = np.full(len(x), np.inf)
    for _ in range(min(count, len(x))):
        at = int(np.argmax(far))
        if chosen and near[at] == 0:
            break
        chosen.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(axis=1))
        far = near
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots) or x.shape[1] != pivots.shape[1]:
        return np.zeros((len(x), 0))
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _table(pivots: np.ndarray):
    """mapInArrow: (id, q, v list<long>) to (id, q, dim, v binary of int64, d binary of float64)."""
    schema = pa.schema([("id", pa.int64()), ("q", pa.bool_()), ("dim", pa.int32()), ("v", pa.binary()), ("d", pa.binary())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            begins = np.cumsum(sizes) - sizes
            vs, ds = [None] * b.num_rows, [b""] * b.num_rows
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = flat[(begins[rows][:, None] + np.arange(size)[None])]
                d = _distances(x.astype(np.float64), pivots)
                for i, r in enumerate(rows):
                    vs[r], ds[r] = x[i].tobytes(), d[i].tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("q"), pa.array(sizes.astype(np.int32)), pa.array(vs, pa.binary()), pa.array(ds, pa.binary())], schema=schema)
    return run


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers of any size."""
    own = q.tolist()
    return np.array([sum(a * b for a, b in zip(row, own)) for row in x.tolist()], dtype=object)


def search_block(qv: np.ndarray, qd: np.ndarray, qid: np.ndarray, xv: np.ndarray, xd: np.ndarray, xid: np.ndarray, k: int):
    """Per query the k best of the block: (query row, candidate row, score), by elimination."""
    qi, xi, qv, xv = qv, xv, qv.astype(np.float64), xv.astype(np.float64)
    q2, x2 = (qv * qv).sum(axis=1), (xv * xv).sum(axis=1)
    low = np.zeros((len(qv), len(xv)), dtype=np.float32)
    qf, xf = qd.astype(np.float32), xd.astype(np.float32)
    for p in range(qd.shape[1]):
        np.maximum(low, np.abs(qf[:, p][:, None] - xf[:, p][None]), out=low)
    # distances are rounded to float32: their errors are taken off the bound, and those of the squares put on it
    slack = np.float32(1e-3) + np.float32(1e-6) * (qf.max(initial=0.0) + xf.max(initial=0.0))
    low = np.maximum(low - slack, 0).astype(np.float64)
    half = (q2[:, None] + x2[None]) / 2
    bound = np.floor(half - low * low / 2 + 1e-6 + 1e-12 * half)
    wide = float(np.sqrt(q2.max(initial=0.0) * x2.max(initial=0.0))) >= float(1 << 52)
    out_q, out_x, out_s = [], [], []
    for i in range(len(qv)):
        ub = bound[i]
        own = xid == qid[i]
        best = np.zeros(0, np.int64)
        score = np.zeros(0, object if wide else np.float64)
        done, take, order = 0, min(FIRST, len(ub)), None
        while done < len(ub):
            if order is None:
                ahead = np.argpartition(-ub, take - 1)[:take] if take < len(ub) else np.arange(len(ub))
                ahead = ahead[np.argsort(-ub[ahead], kind="stable")]
                rest = -np.inf if take >= len(ub) else ub[ahead[-1]]
                part = ahead
            else:
                part = order[done: done + take]
                rest = ub[order[done + take]] if done + take < len(order) else -np.inf
            if len(score) >= k:
                part = part[ub[part] >= score[k - 1]]
            done += take
            part = part[~own[part]]
            if len(part):
                best = np.concatenate([best, part])
                score = np.concatenate([score, exact_scores(xi[part], qi[i]) if wide else xv[part] @ qv[i]])
                first = sorted(range(len(best)), key=lambda j: (-score[j], xid[best[j]]))[:k] if wide else np.lexsort((xid[best], -score))[:k]
                best, score = best[first], score[first]
            if len(score) >= k and rest < score[k - 1]:
                break
            if order is None:
                order = np.argsort(-ub, kind="stable")
                # what the first part held comes first again in another order of ties: score anew from the start
                best, score, done, take = best[:0], score[:0], 0, 4 * take
        out_q.append(np.full(len(best), i))
        out_x.append(best)
        out_s.append(score)
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s).astype(np.int64)


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("qh", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(t: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=kind).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0), kind)

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return schema.empty_table()
        qid, xid = q.column("id").to_numpy(), x.column("id").to_numpy()
        a, b, s = search_block(matrix(q, "v", np.int64), matrix(q, "d", np.float64), qid,
                               matrix(x, "v", np.int64), matrix(x, "d", np.float64), xid, k)
        return pa.table([qid[a], q.column("qh").to_numpy()[a], xid[b], s], schema=schema)
    return run


def scaled(column: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long; null where the vector takes no part."""
    v = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fit = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    large = F.exists(column, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) >= F.lit(float(1 << 62)))
    return F.when(fit, F.when(large, F.raise_error(F.lit("a component is too large for a long"))).otherwise(v).cast("array<long>"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id",
          embedding: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k highest integer inner products, ties to the smaller vec_id."""
    rows = (vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"),
                           F.when(F.col(embedding).isNotNull(), scaled(F.col(embedding), scale)).alias("v"))
            .where("id is not null and v is not null"))
    sample = [np.array(r.v) for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()]
    table = rows.mapInArrow(_table(_pivots(sample, pivots)), "id long, q boolean, dim int, v binary, d binary")
    n, m = rows.agg(F.count("*"), F.count_if("q")).first()
    across, down = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // DATA_BLOCK))
    hashed = F.xxhash64("id", F.lit("cell"))
    all_q, all_x = F.expr(f"sequence(0, {across - 1})"), F.expr(f"sequence(0, {down - 1})")
    q = (table.where("q").dropDuplicates(["id", "v"]).withColumn("qh", F.xxhash64("v"))
         .withColumn("down", F.explode(all_x)).withColumn("across", F.pmod(hashed, F.lit(across)).cast("int")))
    x = table.withColumn("across", F.explode(all_q)).withColumn("down", F.pmod(hashed, F.lit(down)).cast("int"))
    keys = ["across", "down", "dim"]
    found = q.drop("q").groupBy(*keys).cogroup(x.drop("q").groupBy(*keys)).applyInArrow(_cell(k), "query_id long, qh long, vec_id long, score long")
    w = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(x.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id AND len(q.e) = len(x.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op1_topk": op1_topk}
ORACLES = {"op1_topk": OP1_SQL}
