"""Class-based bigram language model with classes from exchange clustering.

log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class);
the token before the first is an end.  Transitions are smoothed towards the classes' own
shares, emissions by half a count for each word and one unknown word in each class.

All counts are over every training token.  What is clustered are units: the WORDS
most frequent words each alone, and all other words by their spelling (last bytes, first
byte, length) in SPELLINGS units, so that every word, seen or not, has a class.  The unit
bigrams form a table of bounded size; the exchange runs on it on the driver: each
unit in turn moves to the class that gains most likelihood, until a sweep moves hardly any.

Word counts are kept by 64-bit hashes of the words, in hash buckets.  Words with at
least 1 / FREQUENT of all tokens (so at most FREQUENT words) are broadcast with their counts; for the
others each chunk of documents sends its tokens to the buckets and gets sums back, so
that no table of the vocabulary is ever in one place.

Defined results: a null text is empty; an empty text is its end token alone; a null id counts as
the id '' for the folds; without training rows every count is zero; repeated rows each count and
each get their row; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import lowered, mix, slices, stored, text_buffers, text_or_empty, trimmed, word_hashes, words

CLASSES = 64
WORDS = 4096
SPELLINGS = 1024
#: Sweeps of the exchange at most, and the share of units that moved below which it has settled.
SWEEPS = 30
SETTLED = 0.001
FREQUENT = 1 << 20
#: Pseudo-count of the classes' own shares in a transition.
BACKOFF = 100.0
#: Word types that one bucket of the counts holds, about.
BUCKET_TYPES = 1_000_000
#: Bytes of text whose tokens one bucket looks up, about.
BUCKET_BYTES = 64 << 20
_LOW = np.uint64(SPELLINGS - 1)
#: The end token: an id that no hash gets, as its spelling unit is its own.
END = np.uint64(0xFFFFFFFFFFFFFC00)
UNITS = WORDS + SPELLINGS + 1


def token_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens, each text's words and its end, and the number of tokens of each text.

    An id is the word's hash with the number of its spelling unit in the low bits.
    """
    data = lowered(data)
    starts, ends, counts = words(data, offsets)
    ids = np.zeros(0, np.uint64)
    if len(starts):
        last = data[ends - 1].astype(np.uint64)
        for back, shift in ((2, 8), (3, 16)):
            last |= data[np.maximum(ends - back, starts)].astype(np.uint64) << np.uint64(shift)
        size = np.minimum(ends - starts, 12).astype(np.uint64) // np.uint64(3)
        kind = (data[starts] >> np.uint8(5)).astype(np.uint64)
        unit = mix(last | size << np.uint64(24) | kind << np.uint64(32)) & _LOW
        h = word_hashes(data, starts, ends)
        ids = (h & ~_LOW) | unit
        ids[ids == END] -= np.uint64(1 << 20)
    total = counts + 1
    out = np.full(int(total.sum()), END, dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[np.cumsum(total) - 1] = False
    out[place] = ids
    return out, total


def _summed(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    i, c = np.concatenate(ids), np.concatenate(counts)
    names, where = np.unique(i, return_inverse=True)
    return names, np.bincount(where, c, len(names)).astype(np.int64)


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _blobs(ids: np.ndarray, counts: np.ndarray, buckets: int):
    which = _bucket(ids, buckets)
    order = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[order], np.arange(buckets + 1))
    ids, counts = ids[order], counts[order]
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([ids[cut[b]: cut[b + 1]].tobytes() for b in full], pa.binary()),
                                       pa.array([counts[cut[b]: cut[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "ids", "counts"])


def _count(buckets: int):
    def run(batches):
        ids, counts, held = [], [], 0
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                t, _ = token_ids(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                i, c = np.unique(t, return_counts=True)
                ids.append(i)
                counts.append(c)
                held += len(i)
                if held > 4_000_000:
                    i, c = _summed(ids, counts)
                    ids, counts, held = [i], [c], len(i)
                    if held > 2_000_000:
                        yield _blobs(i, c, buckets)
                        ids, counts, held = [], [], 0
        if ids:
            yield _blobs(*_summed(ids, counts), buckets)
    return run


def _merge(batches):
    """Counts of a partition's buckets, one row each, with what the model needs of them in sum."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, ids, counts in zip(batch.column("bucket").to_pylist(), batch.column("ids"), batch.column("counts")):
            h = held.setdefault(bucket, [[], [], 0, 0])
            h[0].append(np.frombuffer(ids.as_py(), np.uint64))
            h[1].append(np.frombuffer(counts.as_py(), np.int64))
            h[2] += len(h[0][-1])
            if h[2] > 1_000_000 + 2 * h[3]:
                i, c = _summed(h[0], h[1])
                held[bucket] = [[i], [c], len(i), len(i)]
    for bucket in sorted(held):
        i, c = _summed(held[bucket][0], held[bucket][1])
        unit = (i & _LOW).astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array([bucket], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()),
            pa.array([len(i)], pa.int64()), pa.array([int(c.sum())], pa.int64()),
            pa.array([np.bincount(unit, c, SPELLINGS).astype(np.int64)], pa.list_(pa.int64())), pa.array([np.bincount(unit, minlength=SPELLINGS).astype(np.int64)], pa.list_(pa.int64())),
        ], names=["bucket", "ids", "counts", "types", "tokens", "unit_tokens", "unit_types"])


def _heavy(least: float):
    def run(batches):
        for b in batches:
            for ids, counts in zip(b.column("ids"), b.column("counts")):
                i, c = np.frombuffer(ids.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64)
                big = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(i[big].view(np.int64)), pa.array(c[big])], names=["id", "n"])
    return run


def _units(ids: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Unit of each id; ``top``: sorted ids of the words that are units alone, without the end."""
    out = WORDS + (ids & _LOW).astype(np.int64)
    if len(top):
        at = np.minimum(np.searchsorted(top, ids), len(top) - 1)
        hit = top[at] == ids
        out[hit] = at[hit]
    out[ids == END] = UNITS - 1
    return out


_ROWS = 64


def _pairs(shared):
    """Unit bigrams of a task, summed, in blocks of _ROWS first units."""
    def run(batches):
        top = shared.value
        dense = np.zeros(UNITS * UNITS, dtype=np.int32)  # a task's counts
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                ids, total = token_ids(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                unit = _units(ids, top)
                before = np.empty_like(unit)
                before[1:] = unit[:-1]  # an end precedes the first word of the next text
                before[0] = UNITS - 1
                at, n = np.unique(before * UNITS + unit, return_counts=True)
                dense[at] += n.astype(np.int32)
        for block in range(-(-UNITS // _ROWS)):
            part = dense[block * _ROWS * UNITS: (block + 1) * _ROWS * UNITS]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([part[at].astype(np.int64).tobytes()], pa.binary())], names=["block", "at", "n"])
    return run


def _sum_pairs(batches):
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for block, at, n in zip(b.column("block").to_pylist(), b.column("at"), b.column("n")):
            dense = held.setdefault(block, np.zeros(_ROWS * UNITS, dtype=np.int64))
            dense[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(n.as_py(), np.int64)
    for block, dense in held.items():
        at = np.flatnonzero(dense)
        # what the driver gets is packed
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(np.diff(at, prepend=0).astype(np.int32).tobytes())], pa.binary()), pa.array([_pack(dense[at].tobytes())], pa.binary())], names=["block", "at", "n"])
    trimmed()


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(m: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the units from their bigram counts; the last unit, the end, is class 0 and alone."""
    size = len(m)
    m = m.astype(np.float64, copy=False)
    count = m.sum(axis=0)
    order = np.argsort(-count[:-1], kind="stable")
    cls = np.zeros(size, dtype=np.int64)
    cls[order] = 1 + np.arange(size - 1) % (classes - 1)
    one = np.zeros((size, classes))
    one[np.arange(size), cls] = 1.0
    right, left = m @ one, m.T @ one          # unit to class, class to unit
    n = one.T @ right
    own = one.T @ count
    diag = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if count[u] == 0 and not m[u].any():
                continue
            a, s = cls[u], m[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= s
            l[a] -= s
            n[a] -= r
            n[:, a] -= l
            n[a, a] -= s
            own[a] -= count[u]
            now = _f(n)
            gain = (_f(n + r) - now).sum(axis=1) + (_f(n + l[:, None]) - now).sum(axis=0)
            d = n[diag, diag]
            gain += _f(d + r + l + s) - _f(d) - (_f(d + r) - _f(d)) - (_f(d + l) - _f(d))
            gain -= 2 * (_f(own + count[u]) - _f(own))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b] += r
            n[:, b] += l
            n[b, b] += s
            own[b] += count[u]
            if b != a:
                right[:, a] -= m[:, u]
                right[:, b] += m[:, u]
                left[:, a] -= m[u]
                left[:, b] += m[u]
                cls[u] = b
                moved += 1
        if moved <= SETTLED * size:
            break
    return cls


class Model:
    """All of bounded size: classes of units, transitions, emission totals, frequent words."""

    def __init__(self, top, cls, pairs, unit_tokens, unit_types, frequent, frequent_counts):
        self.top, self.cls = top, cls
        classes = int(cls.max(initial=0)) + 1
        one = np.zeros((UNITS, classes))
        one[np.arange(UNITS), cls] = 1.0
        n = one.T @ pairs @ one
        own = one.T @ unit_tokens
        share = (own + 0.5) / (own.sum() + 0.5 * classes)
        self.step = np.log10((n + BACKOFF * share) / (n.sum(axis=1, keepdims=True) + BACKOFF))
        self.emit = np.log10(own + 0.5 * (one.T @ unit_types + 1))
        self.frequent = frequent
        self.log = np.log10(frequent_counts + 0.5)
        unit = _units(frequent, top)
        self.frequent_class = cls[unit]

    def local(self, ids: np.ndarray, total: np.ndarray):
        """Of each text: sum of transitions less emission totals, log10 sum and number of frequent tokens;
        then the ids and texts of the other tokens."""
        row = np.repeat(np.arange(len(total)), total)
        names, where = np.unique(ids, return_inverse=True)
        cls = self.cls[_units(names, self.top)]
        log, known = np.zeros(len(names)), np.zeros(len(names), dtype=bool)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, names), len(self.frequent) - 1)
            known = self.frequent[at] == names
            log = np.where(known, self.log[at], 0.0)
        c = cls[where]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[:1] = self.cls[UNITS - 1]
        model = np.bincount(row, self.step[before, c] - self.emit[c], len(total))
        k = known[where]
        rare = np.flatnonzero(~k)
        return model, np.bincount(row, log[where], len(total)), np.bincount(row, k, len(total)).astype(np.int64), ids[rare], row[rare]


def _ask(shared, buckets: int):
    """Chunks of documents to rows by bucket: the tokens looked for; the first also holds the chunk's own sums."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()),
                        ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sums", pa.binary())])

    def run(batches):
        model, seq = shared.value, 0
        part = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = text_buffers(b.column("text"))
            sums, ids, rows = [], [], []
            for lo, hi in slices(offsets):
                t, total = token_ids(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                m, log, known, rare, at = model.local(t, total)
                sums.append(np.stack([total, m, log, known]))
                ids.append(rare)
                rows.append((at + lo).astype(np.int32))
            ids, rows, sums = np.concatenate(ids), np.concatenate(rows), np.concatenate(sums, axis=1)
            which = _bucket(ids, buckets)
            order = np.lexsort((ids, which))
            cut = np.searchsorted(which[order], np.arange(buckets + 1))
            ids, rows = ids[order], rows[order]
            chunk = part << 32 | seq
            seq += 1
            home = chunk % buckets
            full = [k for k in range(buckets) if cut[k + 1] > cut[k] or k == home]
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array([1] * len(full), pa.int32()), pa.array([chunk] * len(full), pa.int64()),
                pa.array([ids[cut[k]: cut[k + 1]].tobytes() for k in full], pa.binary()), pa.array([rows[cut[k]: cut[k + 1]].tobytes() for k in full], pa.binary()),
                pa.array([b.column("doc_id").to_pylist() if k == home else None for k in full], pa.list_(pa.int64())),
                pa.array([b.column("held_out").to_pylist() if k == home else None for k in full], pa.list_(pa.bool_())),
                pa.array([np.ascontiguousarray(sums).tobytes() if k == home else None for k in full], pa.binary())], schema=schema)
    return run


def _answer(batches):
    """A bucket's counts come first, then the chunks' tokens: sums of each chunk's texts."""
    bucket, names, log = None, np.zeros(0, np.uint64), np.zeros(0)
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["bucket"] != bucket:
                bucket, names, log = r["bucket"], np.zeros(0, np.uint64), np.zeros(0)
            if r["kind"] == 0:
                names, log = np.frombuffer(r["ids"], np.uint64), np.log10(np.frombuffer(r["rows"], np.int64) + 0.5)
                continue
            ids, rows = np.frombuffer(r["ids"], np.uint64), np.frombuffer(r["rows"], np.int32)
            value, hit = np.full(len(ids), np.log10(0.5)), np.zeros(len(ids), dtype=bool)
            if len(names) and len(ids):
                at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
                hit = names[at] == ids
                value = np.where(hit, log[at], value)
            size = int(rows.max(initial=-1)) + 1
            got = np.stack([np.bincount(rows, value, size), np.bincount(rows, hit, size)]) if size else np.zeros((2, 0))
            out.append((r["chunk"], got.tobytes(), r["doc_id"], r["held_out"], r["sums"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.list_(pa.int64())),
                                              pa.array([o[3] for o in out], pa.list_(pa.bool_())), pa.array([o[4] for o in out], pa.binary())], names=["chunk", "got", "doc_id", "held_out", "sums"])


def _gather(tokens: int, types: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    below = np.log10(tokens + 0.5 * (types + 1))

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        home = next(r for r in rows if r["sums"] is not None)
        total, model, log, known = np.frombuffer(home["sums"]).reshape(4, -1)
        log, known = log.copy(), known.copy()
        for r in rows:
            got = np.frombuffer(r["got"]).reshape(2, -1)
            log[: got.shape[1]] += got[0]
            known[: got.shape[1]] += got[1]
        return pa.table([pa.array(home["doc_id"], pa.int64()), pa.array(home["held_out"], pa.bool_()), total.astype(np.int64), known.astype(np.int64),
                         np.full(len(total), tokens), log - total * below, log + model], schema=schema)
    return run


def learn(train: DataFrame, n_bytes: int) -> tuple[Model, DataFrame, int, int]:
    """Model, table of counts (bucket, ids, counts), training tokens and types; ``train``: (text)."""
    spark = train.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(spread, -(-n_bytes // (64 << 20)))
    counts = stored(train.mapInArrow(_count(buckets), "bucket int, ids binary, counts binary").repartition(spread, "bucket")
                    .mapInArrow(_merge, "bucket int, ids binary, counts binary, types long, tokens long, unit_tokens array<long>, unit_types array<long>"), "counts")
    sums = counts.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    types, tokens = int(sums[0]), int(sums[1])
    by_unit = counts.select(F.posexplode(F.arrays_zip("unit_tokens", "unit_types")).alias("unit", "x")).groupBy("unit").agg(F.sum("x.unit_tokens").alias("tokens"), F.sum("x.unit_types").alias("types")).collect()
    unit_tokens, unit_types = np.zeros(UNITS), np.zeros(UNITS)
    for r in by_unit:  # SPELLINGS rows
        unit_tokens[WORDS + r.unit], unit_types[WORDS + r.unit] = r.tokens, r.types
    heavy = counts.mapInArrow(_heavy(max(1.0, tokens / FREQUENT)), "id long, n long").toArrow()  # at most FREQUENT rows
    ids, n = heavy.column("id").to_numpy().view(np.uint64), heavy.column("n").to_numpy()
    order = np.argsort(ids)
    ids, n = ids[order], n[order]
    first = np.lexsort((ids, -n))
    top = np.sort(first[ids[first] != END][:WORDS])
    own = np.concatenate([top, np.flatnonzero(ids == END)])
    spelt = WORDS + (ids[own] & _LOW).astype(np.int64)
    np.subtract.at(unit_tokens, spelt, n[own])
    np.subtract.at(unit_types, spelt, 1)
    unit_tokens[: len(top)], unit_types[: len(top)] = n[top], 1
    unit_tokens[UNITS - 1], unit_types[UNITS - 1] = n[ids == END].sum(), (ids == END).sum()
    shared = spark.sparkContext.broadcast(ids[top])
    found = (train.mapInArrow(_pairs(shared), "block int, at binary, n binary").repartition("block").mapInArrow(_sum_pairs, "block int, at binary, n binary")).collect()  # UNITS x UNITS counts
    pairs = np.zeros(UNITS * UNITS)
    for r in found:
        pairs[r.block * _ROWS * UNITS + np.cumsum(_unpack(r.at, np.int32), dtype=np.int64)] += _unpack(r.n, np.int64)
    pairs = pairs.reshape(UNITS, UNITS)
    return Model(ids[top], exchange(pairs), pairs, unit_tokens, unit_types, ids, n), counts, tokens, types


def score_texts(documents: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows that are not held out."""
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty(text).alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    n_bytes = int(train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    model, counts, tokens, types = learn(train, n_bytes)
    # by types for the counts, and by bytes for the tokens that come to be looked up
    whole = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    buckets = max(8, -(-types // BUCKET_TYPES), -(-whole // BUCKET_BYTES))
    asked = rows.mapInArrow(_ask(spark.sparkContext.broadcast(model), buckets), "bucket int, kind int, chunk long, ids binary, rows binary, doc_id array<long>, held_out array<boolean>, sums binary")
    known = (counts.mapInArrow(_rebucket(buckets), "bucket int, ids binary, counts binary").repartition(buckets, "bucket").mapInArrow(_joined, "bucket int, ids binary, counts binary")
             .select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "ids", F.col("counts").alias("rows"), F.lit(None).cast("array<long>").alias("doc_id"), F.lit(None).cast("array<boolean>").alias("held_out"), F.lit(None).cast("binary").alias("sums")))
    met = asked.unionByName(known).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    back = met.mapInArrow(_answer, "chunk long, got binary, doc_id array<long>, held_out array<boolean>, sums binary")
    return back.groupBy("chunk").applyInArrow(_gather(tokens, types), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _rebucket(buckets: int):
    def run(batches):
        for b in batches:
            for ids, counts in zip(b.column("ids"), b.column("counts")):
                yield _blobs(np.frombuffer(ids.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64), buckets)
    return run


def _joined(batches):
    """One row per bucket, sorted by id; the parts share no id."""
    held: dict[int, list] = {}
    for b in batches:
        for bucket, ids, counts in zip(b.column("bucket").to_pylist(), b.column("ids"), b.column("counts")):
            h = held.setdefault(bucket, [[], []])
            h[0].append(np.frombuffer(ids.as_py(), np.uint64))
            h[1].append(np.frombuffer(counts.as_py(), np.int64))
    for bucket, (ids, counts) in held.items():
        i, c = np.concatenate(ids), np.concatenate(counts)
        order = np.argsort(i)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([i[order].tobytes()], pa.binary()), pa.array([c[order].tobytes()], pa.binary())], names=["bucket", "ids", "counts"])


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(F.col("doc_id")) == 1)


QUERIES = {"op3_lm": op3_lm}
ORACLES: dict[str, str] = {}
