"""Factorisation machine over hashed words, structure statistics and metadata.

score(x) = w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]:
all pairs of features interact, in time linear in those present.  Features of a text:

* words, A-Z as a-z, hashed to 2^BITS places, weight (1 + ln count) over the length of
  that vector, so that long texts don't outweigh short ones;
* structure: sizes on a log scale, shares of upper-case letters, digits, symbols,
  line breaks and bars, of words that end in symbols or are all upper case, mean word
  length, share of distinct words and lines;
* metadata: the column n_chars on a log scale and its distance from the text's own size.

The model is fitted on at most TRAIN_ROWS labelled rows, those first by a hash of the id
(a documented bound: the fit is on the driver), and has a fixed size, so it is broadcast.
Every row of the table is scored.

Defined results: null texts are empty; an empty text scores by its structure
and bias alone; a null n_chars counts as the text's own size; labels that are null or not 0/1 are not
learned from, of repeated labels the largest holds; without two kinds of labels
the score is the share of label 1 (0.5 without labels); repeated rows score alike; an
empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import lowered, slices, text_buffers, text_or_empty, word_hashes, words

BITS = 15
RANK = 8
#: Batches of 64 rows that the fit takes, whatever the number of rows.
STEPS = 600
#: Most labelled rows that the fit takes.
TRAIN_ROWS = 6000
THRESHOLD = 0.3
N_STATS = 16

_KIND = np.zeros((7, 256), dtype=bool)
_KIND[0, 65:91] = True                                             # upper case
_KIND[1, 48:58] = True                                             # digits
_KIND[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # symbols
_KIND[2, [44, 46, 39, 45]] = False                                 # , . ' - are prose
_KIND[3, 10] = True                                                # line breaks
_KIND[4, 124] = True                                               # bars
_KIND[5, 97:123] = True                                            # lower case
_KIND[6, 128:] = True                                              # beyond ASCII


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray):
    """(row, place, value) of the hashed words, sorted by row, and the rows' statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    by = [_sums(_KIND[i][data], offsets) for i in range(7)]
    starts, ends, counts = words(data, offsets)
    h = word_hashes(lowered(data), starts, ends)
    word_off = np.concatenate([[0], np.cumsum(counts)])
    last = data[ends - 1] if len(ends) else data[:0]
    up = np.concatenate([[0], np.cumsum(_KIND[0][data])])
    shout = (up[ends] - up[starts] >= 2) & (up[ends] - up[starts] >= 0.6 * (ends - starts))
    row = np.repeat(np.arange(n), counts)
    key = (row.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64)
    key, c = np.unique(key, return_counts=True)
    frow, place = key >> BITS, key & ((1 << BITS) - 1)
    value = 1.0 + np.log(c)
    norm = np.sqrt(np.bincount(frow, value * value, minlength=n))
    distinct = np.bincount(frow, minlength=n)
    some, letters = np.maximum(counts, 1), np.maximum(by[0] + by[5] + by[6], 1)
    n_chars = np.where(np.isnan(n_chars), size - by[6] / 2, n_chars)
    stats = np.stack([
        np.log1p(size), np.log1p(counts), np.minimum(_sums_words(ends - starts, word_off) / some, 40), by[0] / letters,
        by[1] / np.maximum(size, 1), by[2] / np.maximum(size, 1), by[3] / some, by[4] / some, by[6] / np.maximum(size, 1),
        _sums_words(_KIND[2][last], word_off) / some, _sums_words(shout, word_off) / some, distinct / some,
        (counts == 0).astype(float), (counts < 20).astype(float),
        np.log1p(np.maximum(n_chars, 0)), np.log1p(np.abs(size - n_chars)),
    ], axis=1) if n else np.zeros((0, N_STATS))
    return frow, place, value / np.maximum(norm[frow], 1e-12), stats


def _sums_words(x: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x.astype(np.int64))])
    return total[word_off[1:]] - total[word_off[:-1]]


class Machine:
    """Parameters of a factorisation machine; the statistics' places follow those of the words."""

    def __init__(self, rank: int = RANK, seed: int = 7):
        size = (1 << BITS) + N_STATS
        self.w0, self.w = 0.0, np.zeros(size, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)
        self.mean, self.std = np.zeros(N_STATS), np.ones(N_STATS)

    def joined(self, row, place, value, stats):
        """The same triples with the scaled statistics added, sorted by row."""
        n = len(stats)
        z = np.clip((stats - self.mean) / self.std, -4, 4) * 0.5
        row2 = np.concatenate([row, np.repeat(np.arange(n), N_STATS)])
        place2 = np.concatenate([place, np.tile((1 << BITS) + np.arange(N_STATS), n)])
        value2 = np.concatenate([value, z.ravel()])
        order = np.argsort(row2, kind="stable")
        return row2[order], place2[order], value2[order].astype(np.float32)

    def raw(self, row, place, value, n: int):
        """Scores before the logistic, and the sums of v x that the gradient needs."""
        begin = np.searchsorted(row, np.arange(n))
        vx = self.v[place] * value[:, None]
        sums = np.add.reduceat(vx, begin, axis=0) if len(row) else np.zeros((n, self.v.shape[1]))
        squares = np.add.reduceat((vx * vx).sum(axis=1), begin) if len(row) else np.zeros(n)
        linear = np.add.reduceat(self.w[place] * value, begin) if len(row) else np.zeros(n)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
        row, place, value, stats = features(data, offsets, n_chars)
        y, _ = self.raw(*self.joined(row, place, value, stats), len(stats))
        return 1.0 / (1.0 + np.exp(-np.clip(y.astype(np.float64), -30, 30)))


def fit(rows: list[tuple], labels: np.ndarray, rank: int = RANK, steps: int = STEPS, seed: int = 7) -> Machine:
    """Logistic loss, Adagrad over small batches. ``rows``: (place, value, stats) of each text."""
    m = Machine(rank, seed)
    stats = np.array([r[2] for r in rows])
    m.mean, m.std = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    share = float(labels.mean())
    m.w0 = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    gw, gv, g0 = np.full(m.w.shape, 1e-2, np.float32), np.full(m.v.shape, 1e-2, np.float32), 1e-2
    order = np.zeros(0, np.int64)
    for _ in range(steps):
        if not len(order):
            order = rng.permutation(len(rows))
        part, order = order[:64], order[64:]
        n = [len(rows[i][0]) for i in part]
        row, place, value = m.joined(np.repeat(np.arange(len(part)), n), np.concatenate([rows[i][0] for i in part]),
                                     np.concatenate([rows[i][1] for i in part]), stats[part])
        y, sums = m.raw(row, place, value, len(part))
        slope = ((1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]) / len(part)).astype(np.float32)
        used, where = np.unique(place, return_inverse=True)
        dx = slope[row] * value
        dw = np.bincount(where, dx, len(used)).astype(np.float32) + 1e-5 * m.w[used]
        dv_all = dx[:, None] * (sums[row] - m.v[place] * value[:, None])
        dv = np.stack([np.bincount(where, dv_all[:, f], len(used)) for f in range(rank)], axis=1).astype(np.float32) + 1e-4 * m.v[used]
        gw[used] += dw * dw
        gv[used] += dv * dv
        d0 = float(slope.sum())
        g0 += d0 * d0
        m.w[used] -= 0.2 * dw / np.sqrt(gw[used])
        m.v[used] -= 0.05 * dv / np.sqrt(gv[used])
        m.w0 -= 0.1 * d0 / g0 ** 0.5
    return m


def _extract(batches):
    schema = pa.schema([("quality", pa.int32()), ("place", pa.binary()), ("value", pa.binary()), ("stats", pa.binary())])
    for b in batches:
        data, offsets = text_buffers(b.column("text"))
        chars = b.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
        quality = b.column("quality").to_numpy(zero_copy_only=False)
        for lo, hi in slices(offsets):
            row, place, value, stats = features(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], chars[lo:hi])
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            part = [(place[a:z].astype(np.int32).tobytes(), value[a:z].astype(np.float32).tobytes()) for a, z in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(quality[lo:hi].astype(np.int32)), pa.array([p for p, _ in part], pa.binary()),
                                              pa.array([v for _, v in part], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], schema=schema)


def _scorer(model, constant: float):
    def run(batches):
        m = model.value
        schema = pa.schema([("row", pa.binary()), ("score", pa.float64())])
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            chars = b.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
            score = np.full(b.num_rows, constant)
            for lo, hi in slices(offsets):
                if m is not None:
                    score[lo:hi] = m.score(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], chars[lo:hi])
            rest = [b.column(i) for i, name in enumerate(b.schema.names) if name not in ("text", "n_chars")]
            names = [name for name in b.schema.names if name not in ("text", "n_chars")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], names=[*names, "score"])
    return run


def _texts(docs: DataFrame, text: str, n_chars: str | None, *more: Column) -> DataFrame:
    has = n_chars is not None and n_chars in docs.columns
    return docs.select(*more, text_or_empty(text).alias("text"), (F.col(n_chars) if has else F.lit(None)).cast("double").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, keep: Column, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text",
          n_chars: str | None = "n_chars", label: str = "quality", rank: int = RANK, steps: int = STEPS):
    """(machine or None, share of label 1) from labelled rows whose id fulfils ``keep``, a column over ``id``."""
    chosen = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("quality")).where("id is not null and quality in (0, 1)").where(keep)
              .groupBy("id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = _texts(docs, text, n_chars, F.col(doc_id).alias("_id"))
    # at most `rows` rows of two numbers, and at most `rows` texts: where ids repeat, the first by hash
    found = texts.join(F.broadcast(chosen), F.col("_id") == F.col("id")).select("text", "n_chars", "quality", "id")
    if found.count() > rows:
        found = found.orderBy(F.xxhash64("id"), F.xxhash64("text"), "n_chars").limit(rows)
    got = found.select("text", "n_chars", "quality").mapInArrow(_extract, "quality int, place binary, value binary, stats binary").collect()
    got.sort(key=lambda r: (bytes(r.stats), r.quality, bytes(r.place)))  # the fit doesn't depend on the tasks' order
    y = np.array([r.quality for r in got], dtype=np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2:
        return None, share
    parts = [(np.frombuffer(r.place, np.int32), np.frombuffer(r.value, np.float32), np.frombuffer(r.stats, np.float64)) for r in got]
    return fit(parts, y, rank, steps), share


def scored(docs: DataFrame, machine: Machine | None, share: float, *carry: Column, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The columns ``carry`` of every row of ``docs``, and its score."""
    rows = _texts(docs, text, n_chars, *carry)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "n_chars"))
    return rows.mapInArrow(_scorer(model, share), f"{kinds}, score double")


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine, share = train(docs, labels, ~held_out(F.col("id")))
    out = scored(docs, machine, share, F.col("doc_id"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns, whatever their names."""
    machine, share = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("id")))
    packed = docs.select("text", *(["n_chars"] if "n_chars" in docs.columns else []), F.struct("*").alias("row"))
    return scored(packed, machine, share, F.col("row")).where(F.col("score") >= THRESHOLD).select("row.*")


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
