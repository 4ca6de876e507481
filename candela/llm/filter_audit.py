"""How quality filters interact: what each one removes at each place of every order.

One scan works on the Arrow buffers of the texts: a table of byte classes turns a slice into flags, whose prefix sums
give each text's words, capitals, code points and symbols; distinct words are the runs of its sorted word hashes, of which
every two neighbours in a run are compared byte by byte, so that words that share a hash still count as two.  A text beyond
the slice is read in pieces cut between words, which are merged into one list of its distinct words.

The filters a document fails are the bits of its mask.  What an order of filters keeps after its first ones depends
only on their set, so per part 32 sums (documents whose mask meets no filter of the set) say all: what a filter removes at its
step is a difference of two of them, and so is its share over all orders.

The text's own filters and its copies are settled without a join: documents are counted by text and
id, then by text, and the smallest id of a text is all its copies are compared with; both counts combine before they shuffle.

Defined results: null texts and null parts are empty; a document without id has no smaller id's text and is none itself;
repeated rows are documents each, of equal id and so no copies of each other; of repeated labels any that says so counts; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import SLICE_BYTES, ordered, pieces, slices, text_buffers, text_or_empty, trimmed, word_hashes, words

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # of 100 words
MOST_CAPITALS = 3  # of 100 code points
SYMBOLS = b"#$%&*|"

#: Classes of a byte: capital, symbol, begin of a code point.
_CLASS = np.zeros((3, 256), dtype=bool)
_CLASS[0, 65:91] = True
_CLASS[1, list(SYMBOLS)] = True
_CLASS[2] = (np.arange(256) & 0xC0) != 0x80


# -- scan ----------------------------------------------------------------------

def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Capitals, symbols and code points of each row, as three rows, from prefix sums."""
    out = np.zeros((3, len(offsets) - 1), dtype=np.int64)
    for i, flags in enumerate(_CLASS):
        total = np.zeros(len(data) + 1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(flags[data], out=total[1:], dtype=total.dtype)
        out[i] = np.diff(total[offsets])
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] and data[b:b+length] are the same, for each pair, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,)) if len(data) else np.zeros(1, np.uint64)
    same, left = np.ones(len(a), dtype=bool), np.arange(len(a))
    for at in range(0, int(length.max(initial=0)), 8):
        left = left[same[left] & (length[left] > at)]
        rest = np.minimum(length[left] - at, 8)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - rest).astype(np.uint64) * np.uint64(8))
        same[left] = ((eight[a[left] + at] ^ eight[b[left] + at]) & mask) == 0
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n_rows: int, hashed=word_hashes):
    """Distinct words of each row, and the places of one of each: runs of sorted hashes, verified by their bytes."""
    h = hashed(data, starts, ends)
    order = ordered(h, row)
    r, x, length = row[order], h[order], (ends - starts)[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    twin = np.flatnonzero(~new)
    a, b = starts[order[twin - 1]], starts[order[twin]]
    alike = length[twin - 1] == length[twin]
    alike[alike] = same_bytes(data, a[alike], b[alike], length[twin][alike])
    run = np.cumsum(new)
    for one in np.unique(run[twin[~alike]]):  # words that share a hash: told apart by themselves
        at = np.flatnonzero(run == one)
        seen: set[bytes] = set()
        for i in at.tolist():
            word = data[starts[order[i]]: ends[order[i]]].tobytes()
            new[i] = word not in seen
            seen.add(word)
    return np.bincount(r[new], minlength=n_rows), order[new]


def text_counts(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES, hashed=word_hashes) -> np.ndarray:
    """Words, distinct words, capitals, symbols and code points of each row, as five rows."""
    out = np.zeros((5, len(offsets) - 1), dtype=np.int64)
    for lo, hi in slices(offsets, limit):
        part, cut = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        if len(part) <= limit:
            starts, ends, n = words(part, cut)
            out[0, lo:hi], out[2:, lo:hi] = n, class_counts(part, cut)
            out[1, lo:hi] = distinct_words(part, starts, ends, np.repeat(np.arange(hi - lo), n), hi - lo, hashed)[0]
            continue
        kept_s, kept_e = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in pieces(part, limit):
            piece, whole = part[a:b], np.array([0, b - a])
            starts, ends, n = words(piece, whole)
            out[0, lo] += n[0]
            out[2:, lo] += class_counts(piece, whole)[:, 0]
            one = distinct_words(piece, starts, ends, np.zeros(len(starts), np.int64), 1, hashed)[1]
            kept_s, kept_e = np.concatenate([kept_s, starts[one] + a]), np.concatenate([kept_e, ends[one] + a])
        # the distinct words of all pieces, set side by side, are a text whose distinct words are the whole's
        size = kept_e - kept_s
        begin = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
        for b0, s0, e0 in zip(begin.tolist(), kept_s.tolist(), kept_e.tolist()):
            joined[b0: b0 + e0 - s0] = part[s0:e0]
        out[1, lo] = distinct_words(joined, begin, begin + size, np.zeros(len(size), np.int64), 1, hashed)[0][0]
    return out


def failures(counts: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that a text fails, from its counts."""
    n, distinct, capitals, symbols, points = counts
    return ((n < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT * n) * 2 + (100 * capitals > MOST_CAPITALS * points) * 4 + (symbols > 0) * 8).astype(np.int32)


def _scan(batches):
    for b in batches:
        counts = text_counts(*text_buffers(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "part", "key", "other")] + [pa.array(failures(counts))], names=["id", "part", "key", "other", "mask"])
    trimmed()


# -- counts ----------------------------------------------------------------------

def masks(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.select("id", "part", "text", F.xxhash64("text", F.octet_length("text")).alias("key"), F.xxhash64(F.octet_length("text"), "text").alias("other"))
    scanned = rows.mapInArrow(_scan, "id long, part string, key long, other long, mask int")
    marks = (labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
             .where("_id is not null and (good or toxic)").groupBy("_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic")))
    no = F.lit(False)
    marked = scanned.join(marks, F.col("id") == F.col("_id"), "left").select("id", "part", "key", "other", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    kind = ["part", "mask", "good", "toxic"]
    by_id = marked.groupBy("key", "other", *kind, "id").agg(F.count("*").alias("n"))
    some = F.col("id").isNotNull()
    by_text = by_id.groupBy("key", "other", *kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(some, F.struct("id", "n"))).alias("first"))
    # few rows are left of a text: one for each part and label that its copies have
    merged = by_text.groupBy("key", "other").agg(F.min("first.id").alias("least"), F.collect_list(F.struct(*kind, "n", "nameless", "first")).alias("kinds"))
    each = merged.select("least", F.explode("kinds").alias("k")).select("least", "k.*")
    leading = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = each.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), leading.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - leading).alias("n")))).alias("m"))
    return split.select("part", "m.mask", "good", "toxic", "m.n").where("n > 0").groupBy(*kind).agg(F.sum("n").alias("n"))


def _shares() -> str:
    """SQL of what each filter removes, summed over all orders; ``all`` are the sums kept by set of filters."""
    factorial = (1, 1, 2, 6, 24)

    def share(f: int) -> str:  # a set of others comes before f, and nothing else, in |set|! (4 - |set|)! orders
        sets = [s for s in range(32) if not s >> f & 1]
        return " + ".join(f"{factorial[s.bit_count()] * factorial[4 - s.bit_count()]} * (all[{s}] - all[{s | 1 << f}])" for s in sets)
    return f"array({', '.join(share(f) for f in range(len(FILTERS)))})"


def audit(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    def kept(weight: str) -> Column:
        return F.expr(f"array({', '.join(f'coalesce(sum(CASE WHEN mask & {s} = 0 THEN {weight} END), 0)' for s in range(1 << len(FILTERS)))})")

    unique = ", ".join(f"coalesce(sum(CASE WHEN mask = {1 << f} THEN n END), 0)" for f in range(len(FILTERS)))
    per_part = counted.groupBy("part").agg(kept("n").alias("all"), kept("if(good, n, 0)").alias("good"), kept("if(toxic, n, 0)").alias("toxic"), F.expr(f"array({unique})").alias("unique"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = per_part.select("*", F.expr(_shares()).alias("shares"), F.explode(orders).alias("filter_order")).select("*", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")).alias("step"))
    earlier = " + ".join(f"if(instr(left(filter_order, step - 1), '{x}') > 0, {1 << f}, 0)" for f, x in enumerate(FILTERS))
    steps = steps.select("*", F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1)) - 1").alias("f"), F.expr(earlier).alias("before"))
    own, before = F.expr("shiftleft(1, f)"), F.col("before")

    def removed(column: str) -> Column:
        return F.get(column, before) - F.get(column, before + own)

    failing = F.get("all", F.lit(0)) - F.get("all", own)
    return steps.select("part", "filter_order", "step", F.get("all", before + own).alias("kept"), removed("all").alias("removed"), (failing - removed("all")).alias("redundant"), F.get("unique", F.col("f")).alias("unique_fails"),
                        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("shares", F.col("f")).alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 3 * length(w.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > m.least THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id JOIN m ON w.t = m.t),
b AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit),
p AS (
  SELECT a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
  FROM b a, b b, b c, b d, b e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT array_to_string(list_transform([b1, b2, b3, b4, b5], lambda x: substr('ABCDE', CAST(log2(x) AS INT) + 1, 1)), '') AS filter_order,
    unnest([1, 2, 3, 4, 5]) AS step, unnest([b1, b2, b3, b4, b5]) AS own, unnest([0, b1, b1 | b2, b1 | b2 | b3, b1 | b2 | b3 | b4]) AS before FROM p),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & own > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": OP12_SQL}
