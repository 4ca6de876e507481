"""Benchmark items inside documents: size-partitioned MinHash containment, verified by exact shingles.

Items are dealt into partitions by their number of shingles (powers of two).  An
item's sketch is the smallest hashes of its shingles, a uniform sample of them: membership of the
sketch in a document's shingles tells how much of the item it contains, however long the
document is, which a sketch of the document itself could not.  A document that holds the
threshold's share of an item's n shingles lacks at most m of them, so with a sketch of s > m hashes
it has s - m of these at least.  A sketch has SKETCH hashes, or m + 1 for items whose m is larger (or
n, if the item has no more): so no pair is lost.  Documents with
too few shingles for a partition's items are skipped for it.  Each candidate is then
verified by the words themselves.

Items are sent to the executors in blocks whose bytes are checked against
ITEM_BLOCK; more items take further passes over the documents.

Defined results: A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``; an item of fewer than k words
has one shingle, its whole sequence, which only a document of just these
words holds; null or empty texts hold nothing and match nothing; repeated
rows each have their pairs; empty tables give an empty table; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import lowered, shingle_hashes, slices, text_buffers, text_or_empty, word_hashes, words

K = 5
THRESHOLD = 0.8
SKETCH = 16
#: Bytes of items that one pass sends to the executors.
ITEM_BLOCK = 4_000_000
_WORD = regex.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text: bytes, k: int) -> frozenset[tuple[bytes, ...]]:
    w = _WORD.findall(text)
    return frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


class Items:
    """Sketches of one block of items, indexed by hash."""

    def __init__(self, rows: list[tuple[int, str]], k: int, threshold: float, sketch: int):
        self.k, self.threshold = k, threshold
        data, offsets = text_buffers(pa.array([t for _, t in rows], pa.large_string()))
        data = lowered(data)
        starts, ends, counts = words(data, offsets)
        h, per = shingle_hashes(word_hashes(data, starts, ends), counts, k)
        self.ids = [i for i, _ in rows]
        self.sets = [shingle_set(data[offsets[i]: offsets[i + 1]].tobytes(), k) for i in range(len(rows))]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        at, keys, owners, need = 0, [], [], []
        for i, n in enumerate(per):
            own = np.unique(h[at: at + n])
            at += n
            lacked = len(own) - int(np.ceil(threshold * len(own) - 1e-9))
            taken = own[:max(sketch, lacked + 1)]
            keys.append(taken)
            owners.append(np.full(len(taken), i))
            need.append(max(1, len(taken) - lacked))
        self.need = np.array(need, dtype=np.int64)
        #: partition of each item, and by partition the fewest shingles a document must have
        self.part = np.floor(np.log2(np.maximum(self.sizes, 1))).astype(np.int64)
        self.least = np.ceil(threshold * 2.0 ** np.arange(64))
        key, owner = (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(key, kind="stable")
        self.owner = owner[order]
        self.key, self.begin, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def pairs(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item, shared) of the rows whose texts contain items."""
        data = lowered(data)
        starts, ends, counts = words(data, offsets)
        h, per = shingle_hashes(word_hashes(data, starts, ends), counts, self.k)
        hit = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.key) or not len(hit):
            return
        at = np.minimum(np.searchsorted(self.key, h[hit]), len(self.key) - 1)
        same = self.key[at] == h[hit]
        hit, at = hit[same], at[same]
        row = np.searchsorted(np.cumsum(per), hit, side="right")
        row, at = np.unique(np.stack([row, at]), axis=1) if len(row) else (row, at)
        n = self.count[at]
        owner = self.owner[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        pair, hits = np.unique(np.repeat(row, n) * len(self.ids) + owner, return_counts=True)
        row, item = pair // max(1, len(self.ids)), pair % max(1, len(self.ids))
        good = (hits >= self.need[item]) & (per[row] >= self.least[self.part[item]])
        last, own = -1, frozenset()
        for r, i in zip(row[good].tolist(), item[good].tolist()):
            if r != last:
                last, own = r, shingle_set(data[offsets[r]: offsets[r + 1]].tobytes(), self.k)
            shared = len(self.sets[i] & own)
            if shared and shared >= self.threshold * len(self.sets[i]) - 1e-9:
                yield r, i, shared


def _search(rows: list[tuple[int, str]], k: int, threshold: float, sketch: int):
    schema = pa.schema([("doc_id", pa.int64()), ("also", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])

    def run(batches):
        items = Items(rows, k, threshold, sketch)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            ids, also = b.column("doc_id").to_pylist(), b.column("also").to_pylist()
            out = [(ids[lo + r], also[lo + r], items.ids[i], n, int(items.sizes[i])) for lo, hi in slices(offsets)
                   for r, i, n in items.pairs(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
    return run


def contained(documents: DataFrame, items: DataFrame, k: int = K, threshold: float = THRESHOLD, sketch: int = SKETCH,
              doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", also: str | None = None) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of all pairs with containment >= threshold; ``also``: a second
    long column of documents, carried by this name."""
    second = F.col(also).cast("long") if also else F.lit(None).cast("long")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), second.alias("also"), text_or_empty(text).alias("text"))
    wanted = items.select(F.col(item_id).cast("long").alias("i"), text_or_empty(item_text).alias("t")).where("t <> ''")
    n_bytes = wanted.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(n_bytes) // ITEM_BLOCK))
    out = None
    for block in range(blocks):
        rows = [(r.i, r.t) for r in wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()]
        part = docs.mapInArrow(_search(rows, k, threshold, sketch), "doc_id long, also long, item_id long, n_shared long, n_item long")
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return out if also else out.drop("also")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns, whatever their names; rows are judged by their texts, so null and
    repeated ids don't matter."""
    rows = docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))
    keyed = rows.select("row", "text", F.xxhash64("text", F.octet_length("text")).alias("key"), F.xxhash64(F.octet_length("text"), "text").alias("other"))
    found = contained(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="key", also="other")
    bad = found.select(F.col("doc_id").alias("_key"), F.col("also").alias("_other")).distinct()
    return keyed.join(bad, (F.col("key") == F.col("_key")) & (F.col("other") == F.col("_other")), "left_anti").select("row.*")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT r, doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT r, item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n_item FROM bs GROUP BY r),
m AS (SELECT ds.r AS dr, doc_id, bs.r AS br, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n ON n.r = m.br WHERE n_shared >= 0.8 * n_item - 1e-9
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": OP6_SQL}
