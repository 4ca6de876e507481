"""Removal of repeated passages by the suffix order of a collection, built column by column.

``Collection`` builds the Burrows-Wheeler transform of many strings together: each round
inserts one more symbol of every string, from its end to its start.  A round reads the
transform and the common prefixes of neighbours from files in order, in blocks, finds where the new
suffixes go (symbols before them plus their rank) and what common prefixes change (one
more than the smallest between two occurrences of the symbol), and writes both files anew.
Rounds are as many as the longest string is long, so documents are not inserted whole:

* each ``length``-byte window of a document belongs to the smallest hash of the GRAM-byte strings
  in it, and windows in a row with the same one form a piece of at most 2 x length - GRAM bytes;
  equal windows have the same smallest hash, wherever they stand;
* only pieces whose hash occurs in two documents at least go on; equal pieces count once per
  chunk of documents, with the smallest id;
* a bucket of hashes is one collection of the runs of windows whose own hash another window has, so its strings
  are short and its size is set by the number of buckets; a task takes its buckets one after another; windows are equal
  where neighbours have ``length`` bytes in common;
* the chunk gets the smallest id of every window back and marks the bytes.

Chunks travel once, into a bucketed table; later passes join what is small to them.  A chunk sends a row to each bucket
that it has pieces for: no more rows than pieces.  What passes write is dropped once the result is written.

Defined results: a null text is empty; texts shorter than ``length`` keep all; a null id
comes after all ids: its repeats go, and nothing goes because of it; rows with the
same id are not earlier than each other; an empty table gives an empty table; other columns are
carried where asked for, and never read.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import made_table, mix, powers_down, prefix_hash, range_hash, scratch, shared_dir, slices, stored, text_buffers, text_or_empty, trimmed

LENGTH = 50
GRAM = 24
#: Bytes of text in a chunk, and of text for which a further bucket is made.
CHUNK = 4_000_000
BUCKET = 4_000_000
#: Bytes of text whose windows are hashed together: their arrays stay in the cache.
CACHED = 1 << 16
#: Symbols that a round holds of each file at a time.
BLOCK = 1 << 18
LAST = np.int64((1 << 63) - 1)


# -- the collection ---------------------------------------------------------------

class Collection:
    """Transform and common prefixes of strings, as files ``bwt`` and ``lcp`` in ``folder``.

    Strings are ranges of ``data`` of at most 254 bytes.  Codes: 0 ends a string, then the bytes
    that occur, in order.  ``lcp[i]`` is the common prefix of suffixes i - 1 and i in suffix order.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, folder: str, block: int = BLOCK):
        self.folder, self.block = folder, block
        self.m, self.size = len(begin), end - begin
        present = np.flatnonzero(np.bincount(data, minlength=256))
        code = np.zeros(256, dtype=np.uint8)
        code[present] = np.arange(1, len(present) + 1)
        self.data, self.begin, self.end, self.sigma = code[data], begin, end, len(present) + 1
        self.total = np.zeros(self.sigma, dtype=np.int64)  # occurrences of each code in the transform
        self.n = 0
        with ExitStack() as stack:
            self.files = {(name, k): stack.enter_context(open(f"{folder}/{name}{k}", "w+b")) for name in ("bwt", "lcp") for k in (0, 1)}
            self._build()
        del self.files

    def _symbols(self, who: np.ndarray, done: int) -> np.ndarray:
        """Code before the suffix of ``done`` bytes of each string; 0 where the suffix is the string."""
        at = self.end[who] - done - 1
        out = np.zeros(len(who), dtype=np.uint8)
        inside = at >= self.begin[who]
        out[inside] = self.data[at[inside]]
        return out

    def _open(self, name: str, k: int, write: bool = False):
        """One of the two files of a name, from its start: round k reads one and writes the other."""
        f = self.files[name, k % 2]
        f.seek(0)
        if write:
            f.truncate()
        return f

    def _build(self) -> None:
        who = np.arange(self.m)
        first = self._symbols(who, 0)
        self._open("bwt", 0, True).write(first.tobytes())
        self._open("lcp", 0, True).write(bytes(self.m))
        self.total = np.bincount(first, minlength=self.sigma).astype(np.int64)
        self.n, at, self.rounds = self.m, who.copy(), 0
        for t in range(1, int(self.size.max(initial=0)) + 1):
            live = self.size[who] >= t
            who, at = who[live], at[live]
            order = np.argsort(at, kind="stable")
            who, at = who[order], at[order]
            at = self._round(who, at, self._symbols(who, t), t - 1)
            self.rounds = t

    def _round(self, who: np.ndarray, at: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
        """Insert the next suffixes; ``at``: places of those they extend, in order. Returns their places."""
        sigma, block = self.sigma, self.block
        base = self.m + np.concatenate([[0, 0], np.cumsum(self.total[1:-1])]) if sigma > 1 else np.zeros(1, np.int64)
        seen = np.zeros(sigma, dtype=np.int64)
        gap = np.zeros(sigma, dtype=np.uint8)            # smallest lcp since the code's last occurrence
        fresh = np.zeros(sigma, dtype=bool)              # whether that occurrence is being inserted
        place = np.zeros(len(at), dtype=np.int64)
        spots, values = [], []
        cut = np.searchsorted(at, np.arange(0, self.n + block, block))
        f, g = self._open("bwt", k), self._open("lcp", k)
        for i in range(-(-self.n // block)):
            b, lcp = np.frombuffer(f.read(block), np.uint8), np.frombuffer(g.read(block), np.uint8)
            here = at[cut[i]: cut[i + 1]] - i * block
            counts = np.bincount(b, minlength=sigma)
            order = np.argsort(b, kind="stable")
            head = np.cumsum(counts) - counts
            mark = np.zeros(len(b), dtype=bool)
            mark[here] = True
            mark = mark[order]                       # by (code, place)
            prev = np.empty_like(mark)
            prev[1:] = mark[:-1]
            some = np.flatnonzero(counts)
            prev[head[some]] = fresh[some]
            look = np.flatnonzero(mark | prev)
            look = look[np.searchsorted(look, counts[0]):]  # ends are never extended
            q, c = order[look], b[order[look]]
            inner = look > head[c]                   # the occurrence before it is in this block
            table = _minima(lcp)
            low = np.empty(len(q), dtype=np.uint8)
            low[inner] = _range_min(table, order[look[inner] - 1] + 1, q[inner])
            outer = ~inner
            known = seen[c[outer]] > 0
            low[outer] = np.minimum(gap[c[outer]], _range_min(table, np.zeros(int(outer.sum()), np.int64), q[outer]))
            value = low.astype(np.int16) + 1
            value[np.flatnonzero(outer)[~known]] = 0
            to = base[c] + seen[c] + look - head[c]
            spots.append(to)
            values.append(value.astype(np.uint8))
            if len(here):
                rank = np.empty(len(here), dtype=np.int64)
                ins = np.flatnonzero(mark)
                rank[np.searchsorted(here, order[ins])] = to[np.searchsorted(look, ins)]
                place[cut[i]: cut[i + 1]] = rank
            tail = head + counts - 1
            ends = order[tail[some]]
            fresh[some] = mark[tail[some]]
            least = lcp.min()
            none = np.setdiff1d(np.arange(sigma), some)
            gap[none] = np.minimum(gap[none], least)
            inside = ends + 1 < len(b)
            gap[some] = 255
            gap[some[inside]] = _range_min(table, ends[inside] + 1, np.full(int(inside.sum()), len(b) - 1))
            seen += counts
        # codes that have not occurred have no gap: their first occurrence gets 0 by `seen`
        spot, value = np.concatenate(spots), np.concatenate(values)
        o = np.argsort(spot)
        spot, value = spot[o], value[o]
        o = np.argsort(place)
        goes, symbol = place[o], new[o]
        ahead = goes - np.arange(len(goes))              # old suffixes before each new one
        f, g, ff, gg = self._open("bwt", k), self._open("lcp", k), self._open("bwt", k + 1, True), self._open("lcp", k + 1, True)
        done, x, u = 0, 0, 0
        for i in range(-(-self.n // block)):
            b, lcp = np.frombuffer(f.read(block), np.uint8), np.frombuffer(g.read(block), np.uint8)
            final = (i + 1) * block >= self.n
            y = len(ahead) if final else int(np.searchsorted(ahead, (i + 1) * block, side="left"))
            out_b, out_l = np.zeros(len(b) + y - x, np.uint8), np.zeros(len(b) + y - x, np.uint8)
            old = np.ones(len(out_b), dtype=bool)
            old[goes[x:y] - done] = False
            out_b[goes[x:y] - done] = symbol[x:y]
            out_b[old], out_l[old] = b, lcp
            v = int(np.searchsorted(spot, done + len(out_b)))
            out_l[spot[u:v] - done] = value[u:v]
            ff.write(out_b.tobytes())
            gg.write(out_l.tobytes())
            done, x, u = done + len(out_b), y, v
        self.n += len(new)
        self.total += np.bincount(new, minlength=sigma)
        return place

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole transform and common prefixes."""
        return tuple(np.fromfile(f"{self.folder}/{name}{self.rounds % 2}", dtype=np.uint8) for name in ("bwt", "lcp"))

    def window_minima(self, length: int, values: np.ndarray) -> np.ndarray:
        """For every window of ``length`` bytes, string by string: the smallest value of the strings that hold it."""
        bwt, lcp = self.arrays()
        follow = np.empty(len(bwt), dtype=np.int64)
        follow[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        group = np.cumsum(lcp < length) - 1
        least = np.full(int(group[-1]) + 1 if len(group) else 0, LAST)
        windows = np.maximum(self.size - length + 1, 0)
        start = np.cumsum(windows) - windows
        of = np.zeros(int(windows.sum()), dtype=np.int64)
        who, at = np.arange(self.m), np.arange(self.m)
        for t in range(1, int(self.size.max(initial=0)) + 1):
            live = self.size[who] >= t
            who, at = who[live], follow[at[live]]
            if t >= length:
                of[start[who] + self.size[who] - t] = group[at]
                np.minimum.at(least, group[at], values[who])
        return least[of]


def _minima(x: np.ndarray) -> list[np.ndarray]:
    """Minima of runs of 1, 2, 4... symbols from each place."""
    out, step = [x], 1
    while 2 * step <= len(x):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
        step *= 2
    return out


def _range_min(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x[lo..hi], both included, for each pair."""
    out = np.empty(len(lo), dtype=np.uint8)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    for k in np.unique(level):
        pick = level == k
        out[pick] = np.minimum(table[k][lo[pick]], table[k][hi[pick] - (1 << int(k)) + 1])
    return out


# -- pieces of documents -----------------------------------------------------------------

def pieces(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(start, windows, hash, row) of the pieces of a slice of texts, in order."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    prefix = prefix_hash(data)
    low = mix((prefix[gram:] - prefix[:-gram]) * powers_down(len(prefix))[: len(prefix) - gram])
    span, step = length - gram + 1, 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step:])
    # a head where the hash changes or a row begins; what begins within the last bytes of a row is no window
    new = np.ones(n, dtype=bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < n]] = True
    head = np.flatnonzero(new)
    row = np.searchsorted(offsets, head, side="right") - 1
    stop = np.minimum(np.append(head[1:], n), offsets[row + 1] - length + 1)
    some = np.flatnonzero(stop > head)
    head, row, windows = head[some], row[some], (stop - head)[some]
    if windows.max(initial=0) > span:
        parts = -(-windows // span)
        of = np.repeat(np.arange(len(head)), parts)
        ahead = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * span
        head, row, windows = head[of] + ahead, row[of], np.minimum(windows[of] - ahead, span)
    return head, windows, low[head], row


def _key(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash: what chunks tell each other of it."""
    return h >> np.uint64(16)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(x: bytes) -> np.ndarray:
    raw = np.zeros((len(x) // 6, 8), dtype=np.uint8)
    raw[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view("<u8").astype(np.uint64)


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x) if x else b""


class Chunk:
    """Texts that travel together: bytes, offsets and ids (LAST for null), and their pieces by slice."""

    def __init__(self, row: dict, length: int, gram: int):
        self.data = np.frombuffer(_unpack(row["texts"]), np.uint8)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.length, self.gram = length, gram

    def parts(self):
        for lo, hi in slices(self.offsets, CACHED):
            a, z = self.offsets[lo], self.offsets[hi]
            start, windows, h, row = pieces(self.data[a:z], self.offsets[lo: hi + 1] - a, self.length, self.gram)
            yield start + a, windows, h, row + lo

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the chunk, and whether two ids of the chunk share them."""
        keys, ids = [], []
        for _, _, h, row in self.parts():
            k, d = _key(h), self.ids[row]
            o = np.lexsort((d, k))
            k, d = k[o], d[o]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            keys.append(k[new])
            ids.append(d[new])
        k, d = (np.concatenate(keys), np.concatenate(ids)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        o = np.argsort(k, kind="stable")
        k, d = k[o], d[o]
        names, first, where = np.unique(k, return_index=True, return_inverse=True)
        more = np.zeros(len(names), dtype=bool)
        more[where[d != d[first][where]]] = True
        return names, more

    def shared(self, keys: np.ndarray):
        """Pieces whose keys are among ``keys`` (sorted): start, windows, key, row, and content hash."""
        prefix, out = None, []
        for start, windows, h, row in self.parts():
            k = _key(h)
            at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
            hit = keys[at] == k if len(keys) else np.zeros(len(k), dtype=bool)
            start, windows, k, row = start[hit], windows[hit], k[hit], row[hit]
            if len(start):
                base = int(start[0])
                end = int((start + windows).max()) + self.length - 1
                prefix = prefix_hash(self.data[base:end])
                content = range_hash(prefix, start - base, start + windows + self.length - 1 - base)
                out.append((start, windows, k, row, content))
        if not out:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.uint64))
        return tuple(np.concatenate(x) for x in zip(*out))

    def distinct(self, keys: np.ndarray, buckets: int):
        """The shared pieces, which distinct one each is, and the distinct ones in the order (bucket, content)."""
        start, windows, k, row, content = self.shared(keys)
        bucket = (k % np.uint64(buckets)).astype(np.int64)
        o = np.lexsort((content, bucket))
        new = np.ones(len(o), dtype=bool)
        new[1:] = (content[o][1:] != content[o][:-1]) | (bucket[o][1:] != bucket[o][:-1])
        of = np.empty(len(o), dtype=np.int64)
        of[o] = np.cumsum(new) - 1
        return start, windows, row, of, o[new], bucket[o[new]]


#: Pieces whose windows are looked at together.
_PIECES = 20_000


# -- passes ---------------------------------------------------------------------------------

_CHUNK_TYPE = "chunk long, texts binary, offsets binary, doc_ids binary, rest binary"


def _chunked(limit: int):
    """Rows (id, text, and what is carried) to chunks; the other columns travel as an Arrow stream."""
    def chunk(tables: list[pa.Table], number: int):
        t = pa.concat_tables(tables)
        data, offsets = text_buffers(t.column("_text"))
        ids = t.column("_id").fill_null(int(LAST)).combine_chunks().to_numpy() if t.num_rows else np.zeros(0, np.int64)
        rest = t.drop_columns(["_text", "_id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_table(rest)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_pack(data.tobytes())], pa.binary()), pa.array([offsets.tobytes()], pa.binary()),
                                           pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()), pa.array([_pack(sink.getvalue().to_pybytes())], pa.binary())],
                                          names=["chunk", "texts", "offsets", "doc_ids", "rest"])

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            _, offsets = text_buffers(b.column("_text"))
            for lo, hi in slices(offsets, limit):
                n = int(offsets[hi] - offsets[lo])
                if held and size + n > limit:
                    yield chunk(held, part << 32 | seq)
                    seq, held, size = seq + 1, [], 0
                held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
                size += n
        if held:
            yield chunk(held, part << 32 | seq)
    return run


def _tell(buckets: int, length: int, gram: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                keys, more = Chunk(row, length, gram).keys()
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
                keys, more = keys[o], more[o]
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([row["chunk"]] * len(full), pa.int64()),
                                                  pa.array([_six(keys[cut[x]: cut[x + 1]]) for x in full], pa.binary()),
                                                  pa.array([np.packbits(more[cut[x]: cut[x + 1]]).tobytes() for x in full], pa.binary())], names=["bucket", "chunk", "keys", "more"])
    return run


def _by_bucket(batches):
    """The rows of each bucket in turn, from batches in the order of their buckets."""
    bucket, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != bucket and held:
                yield bucket, held
                held = []
            bucket = r["bucket"]
            held.append(r)
    if held:
        yield bucket, held


def _meet(batches):
    """Keys that two chunks hold, or two ids of one: a bit for each key told."""
    for bucket, told in _by_bucket(batches):
        keys = [_unsix(r["keys"]) for r in told]
        more = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(k)) for k, r in zip(keys, told)]).astype(bool)
        _, where, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        hit = (count > 1)[where] | more
        twice = np.zeros(len(count), dtype=bool)
        twice[where[hit]] = True
        hit, at, rows = twice[where], 0, []
        for r, k in zip(told, keys):
            if hit[at: at + len(k)].any():
                rows.append((r["chunk"], _six(k[hit[at: at + len(k)]])))
            at += len(k)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "bucket", "keys"])
    trimmed()


def _row_keys(row: dict) -> np.ndarray:
    return np.sort(np.concatenate([_unsix(x) for x in row["keys"]])) if row["keys"] else np.zeros(0, np.uint64)


def _send(buckets: int, length: int, gram: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("size", pa.binary()), ("body", pa.binary()), ("least", pa.binary())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, length, gram)
                start, windows, rows, of, one, bucket = c.distinct(_row_keys(row), buckets)
                least = np.full(len(one), LAST)
                np.minimum.at(least, of, c.ids[rows])
                size = windows[one] + length - 1
                begin = np.cumsum(size) - size
                body = c.data[np.repeat(start[one] - begin, size) + np.arange(int(size.sum()))]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                at = np.append(begin, len(body))
                for x in np.flatnonzero(np.diff(cut)).tolist():
                    lo, hi = cut[x], cut[x + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([size[lo:hi].astype(np.uint8).tobytes()], pa.binary()),
                                                      pa.array([_pack(body[at[lo]: at[hi]].tobytes())], pa.binary()), pa.array([_pack(least[lo:hi].tobytes())], pa.binary())], schema=schema)
    return run


def recurring(body: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int):
    """(piece, first window, windows) of the runs of windows whose hash another window of the pieces has, in order.

    Equal windows have equal hashes, so no window beyond these has an equal one.
    """
    where = np.cumsum(windows) - windows
    at = np.repeat(begin - where, windows) + np.arange(int(windows.sum()))
    h = range_hash(prefix_hash(body), at, at + length)
    order = np.argsort(h)
    h = h[order]
    same = np.zeros(len(h) + 1, dtype=bool)
    np.equal(h[1:], h[:-1], out=same[1:-1])
    hit = np.zeros(len(h) + 1, dtype=bool)
    hit[order] = same[1:] | same[:-1]
    first, cut = hit[:-1].copy(), np.zeros(len(h) + 1, dtype=bool)
    cut[where] = True
    first[1:] &= ~hit[:-2] | cut[1:-1]
    head = np.flatnonzero(first)
    last = np.flatnonzero(hit[:-1] & (~hit[1:] | cut[1:]))
    piece = np.searchsorted(where, head, side="right") - 1
    return piece, head - where[piece], last - head + 1


def _sort(length: int):
    """A bucket's pieces as one collection; each chunk gets the smallest id of each window of its pieces."""
    def solve(told: list[dict]):
        size = [np.frombuffer(r["size"], np.uint8).astype(np.int64) for r in told]
        body = np.frombuffer(b"".join(_unpack(r["body"]) for r in told), np.uint8)
        least = np.concatenate([np.frombuffer(_unpack(r["least"]), np.int64) for r in told])
        sizes = np.concatenate(size)
        begin = np.cumsum(sizes) - sizes
        content = range_hash(prefix_hash(body), begin, begin + sizes)
        _, one, of = np.unique(content, return_index=True, return_inverse=True)
        value = np.full(len(one), LAST)
        np.minimum.at(value, of, least)
        windows = sizes[one] - length + 1
        where = np.cumsum(windows) - windows
        # a window whose hash no other has is in no other piece: its own id is the smallest; runs of the others are the collection's strings
        met, skip, n = recurring(body, begin[one], windows, length)
        found = np.repeat(value, windows)
        if len(met):
            string = begin[one][met] + skip
            with tempfile.TemporaryDirectory() as folder:
                least = Collection(body, string, string + n + length - 1, folder).window_minima(length, value[met])
            found[np.repeat(where[met] + skip - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = least
        at = 0
        for r, s in zip(told, size):
            own = of[at: at + len(s)]
            at += len(s)
            n = windows[own]
            m = found[np.repeat(where[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            head = np.flatnonzero(np.diff(m, prepend=m[0] - 1)) if len(m) else np.zeros(0, np.int64)
            runs = np.diff(np.append(head, len(m)))
            yield r["chunk"], _pack(runs.astype(np.int32).tobytes()), _pack(m[head].tobytes())

    def run(batches):
        for bucket, told in _by_bucket(batches):
            rows = list(solve(told))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "bucket", "runs", "ids"])
        trimmed()
    return run


def covered(c: Chunk, keys: np.ndarray, buckets: int, told: list[dict]) -> np.ndarray:
    """Bytes of the chunk that go."""
    start, windows, row, of, one, _ = c.distinct(keys, buckets)
    n = windows[one]
    where = np.cumsum(n) - n
    told = sorted(told, key=lambda r: r["bucket"])
    runs = np.concatenate([np.frombuffer(_unpack(r["runs"]), np.int32) for r in told]).astype(np.int64) if told else np.zeros(0, np.int64)
    ids = np.concatenate([np.frombuffer(_unpack(r["ids"]), np.int64) for r in told]) if told else np.zeros(0, np.int64)
    begins = np.cumsum(runs) - runs  # the distinct pieces' windows, one after another, in runs of one smallest id
    step = np.zeros(len(c.data) + 1, dtype=np.int32)
    for lo in range(0, len(start), _PIECES):
        hi = min(lo + _PIECES, len(start))
        w = windows[lo:hi]
        at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        least = ids[np.searchsorted(begins, np.repeat(where[of[lo:hi]], w) + at, side="right") - 1]
        gone = least < np.repeat(c.ids[row[lo:hi]], w)
        first = (np.repeat(start[lo:hi], w) + at)[gone]
        np.add.at(step, first, 1)
        np.subtract.at(step, first + c.length, 1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def _finish(buckets: int, length: int, gram: int, texts: bool):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, length, gram)
                off, n = c.offsets, len(c.offsets) - 1
                gone = covered(c, _row_keys(row), buckets, row["told"] or [])
                total = np.concatenate([[0], np.cumsum(gone)])
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                inner = off[:-1][off[:-1] < len(gone)]
                head[inner] = gone[inner]
                heads = np.concatenate([[0], np.cumsum(head)])
                kept = c.data[~gone].tobytes()
                cut = (off - total[off]).tolist()
                texts_kept = [kept[a:z] for a, z in zip(cut[:-1], cut[1:])]
                rest = pa.ipc.open_stream(_unpack(row["rest"])).read_all().combine_chunks()
                cols = {name: rest.column(name) for name in rest.column_names}
                cols |= {"n_bytes": np.diff(off), "n_removed": total[off[1:]] - total[off[:-1]], "n_spans": heads[off[1:]] - heads[off[:-1]]}
                if texts:
                    # a character that lost some of its bytes goes whole
                    cols["kept"] = pa.array([x.decode("utf-8", "ignore") for x in texts_kept], pa.string())
                else:
                    cols["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts_kept], pa.string())
                yield from pa.table(cols).to_batches() if n else []
        trimmed()
    return run


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, length: int = LENGTH,
                    gram: int = GRAM, texts: bool = False) -> DataFrame:
    """The columns ``carry`` (doc_id alone if none are named), n_bytes, n_removed, n_spans and kept_sha256 of
    every row, or with ``texts`` the text ``kept``; carried columns of these names are refused."""
    if not 0 < gram < length <= 120:
        raise ValueError("0 < gram < length <= 120")
    carry = carry or [doc_id]
    tail = "kept string" if texts else "kept_sha256 string"
    if {c.lower() for c in carry} & {"n_bytes", "n_removed", "n_spans", tail.split()[0]}:
        raise ValueError("a carried column has the name of a result; carry it in a struct")
    spark = documents.sparkSession
    shared_dir(spark)
    rows = documents.select(F.col(doc_id).cast("long").alias("_id"), text_or_empty(text).alias("_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark):
        name = made_table(f"candela_chunks_{uuid.uuid4().hex}")
        rows.mapInArrow(_chunked(CHUNK), _CHUNK_TYPE).write.bucketBy(spread, "chunk").option("compression", "none").saveAsTable(name)
        chunks = spark.table(name)
        n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
        buckets = max(1, -(-int(n_bytes) // BUCKET))
        told = chunks.select("chunk", "texts", "offsets", "doc_ids").mapInArrow(_tell(buckets, length, gram), "bucket int, chunk long, keys binary, more binary")
        met = told.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "chunk long, bucket int, keys binary")
        keys = stored(met.groupBy("chunk").agg(F.collect_list("keys").alias("keys")), "keys")  # a chunk's own keys, at most
        sent = chunks.join(keys.hint("shuffle_hash"), "chunk").select("chunk", "texts", "offsets", "doc_ids", "keys").mapInArrow(_send(buckets, length, gram), "bucket int, chunk long, size binary, body binary, least binary")
        back = sent.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort(length), "chunk long, bucket int, runs binary, ids binary")
        back = stored(back.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "runs", "ids")).alias("told")), "told")
        kinds = [f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry))]
        done = (chunks.join(keys.hint("shuffle_hash"), "chunk", "left").join(back.hint("shuffle_hash"), "chunk", "left")
                .mapInArrow(_finish(buckets, length, gram, texts), ", ".join([*kinds, "n_bytes long, n_removed long, n_spans long", tail])))
        return stored(done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_bytes", "n_removed", "n_spans", tail.split()[0]), "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes that earlier ones hold; n_chars follows the text, and texts that lose everything
    stay, empty; other columns are carried as they are, whatever their names."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    out = without_repeats(packed, carry=["row"], texts=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}
