"""Kernels and storage helpers that the training-data operators share.

Text kernels work on the raw buffers of Arrow string arrays: a slice of rows is
one ``uint8`` array, and words, hashes and counts are numpy expressions over it,
so no Python object exists per word.  ``slices`` bounds the bytes handled at a
time; a single text longer than the bound is handled whole.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles (a longer single text is one pass).
SLICE_BYTES = 2_000_000

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Here(dict):
    """Values worked out in this process: a pickled kernel, which takes this module along, leaves them behind."""

    def __reduce__(self):
        return _Here, ()


_POWERS: dict[str, np.ndarray] = _Here()


# -- storage -----------------------------------------------------------------

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders and tables that ``stored`` and others have made and no scope has dropped yet.
_MADE: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (master local), and where the session names none, a temporary
    folder is made and set as the checkpoint folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="candela-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(("path", path))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def made_table(name: str) -> str:
    """Notes a table for the scope around it."""
    _MADE.append(("table", name))
    return name


def drop(spark: SparkSession, kind: str, name: str) -> None:
    if kind == "table":
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, *also: str):
    """Drops what is stored inside the scope when it ends, but for the last table stored.

    That one, the scope's result, belongs to the scope around it, if any.  ``also``: names of stored tables to
    leave as well.
    """
    begin = len(_MADE)
    try:
        yield
    finally:
        made = _MADE[begin:]
        del _MADE[begin:]
        last = max((i for i, (kind, _) in enumerate(made) if kind == "path"), default=-1)
        for i, (kind, name) in enumerate(made):
            if i == last or any(f"/{x}-" in name for x in also):
                _MADE.append((kind, name))
            else:
                drop(spark, kind, name)


def trimmed() -> None:
    """Gives memory that numpy and Arrow have freed back to the system: workers live longer than their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# -- text kernels ------------------------------------------------------------

def text_buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without nulls; offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, offs, data = arr.buffers()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64)[arr.offset: arr.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) whose texts together hold at most ``limit`` bytes, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the number of words of each row."""
    n_rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_rows, np.int64)
    solid = ~_WS[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def pieces(data: np.ndarray, limit: int):
    """Ends of pieces of about ``limit`` bytes of one text; a piece ends before white space or with the text."""
    at = 0
    while at < len(data):
        end, step = min(at + limit, len(data)), 4096
        while end < len(data):  # on to the end of the word
            gap = np.flatnonzero(_WS[data[end: end + step]])
            if len(gap):
                end += int(gap[0])
                break
            end, step = min(end + step, len(data)), 2 * step
        yield at, end
        at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        base = int(_BASE)
        inverse = pow(base, -1, 1 << 64)
        for name, x in (("up", base), ("down", inverse)):
            a = np.full(size, np.uint64(x), dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def powers_down(n: int) -> np.ndarray:
    """Inverse powers of the polynomial hash's base: they move a prefix sum's range to place 0."""
    return _powers(n)[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2^64; ``range_hash`` reads ranges from it."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair; equal bytes give equal hashes at any place."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(data), starts, ends)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, repeats included, and the number of them in each row.

    A row of 1 to k-1 words gives one shingle, its whole sequence; a row without
    words gives none.
    """
    n = len(hashes)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if n == 0:
        return np.zeros(0, np.uint64), per
    begins = np.cumsum(counts) - counts
    at = np.repeat(begins - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    length = np.repeat(np.minimum(counts, k), per)
    out = length.astype(np.uint64)
    for i in range(k):
        there = i < length
        nxt = hashes[np.minimum(at + i, n - 1)]
        out = np.where(there, mix(out * np.uint64(0xD6E8FEB86659FD93) + nxt), out)
    return out, per


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Order by the last key, ties by the one before it and so on; small whole numbers are sorted by radix."""
    out = np.argsort(keys[0])
    for key in keys[1:]:
        key = key[out]
        small = len(key) and key.dtype.kind in "iu" and key.min() >= 0 and key.max() < 1 << 16
        out = out[np.argsort(key.astype(np.uint16) if small else key, kind="stable")]
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, limit: int = SLICE_BYTES):
    """Per portion of rows (lo, hi): hashes of each row's distinct k-word shingles, ascending, and the number of them; A-Z count as a-z.

    A text beyond ``limit`` bytes is read in pieces: what it takes at a time are its words' hashes and its set.
    """
    for lo, hi in slices(offsets, limit):
        part, cut = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        if len(part) > limit:
            hashes = []
            for a, b in pieces(part, limit):
                piece = lowered(part[a:b])
                hashes.append(word_hashes(piece, *words(piece, np.array([0, b - a]))[:2]))
            hashes, step = np.concatenate(hashes), max(k, limit // 4)
            sets = [np.unique(shingle_hashes(hashes[at: at + step + k - 1], np.array([len(hashes[at: at + step + k - 1])]), k)[0]) for at in range(0, max(1, len(hashes) - k + 1), step)]
            out = np.unique(np.concatenate(sets))
            yield lo, hi, out, np.array([len(out)])
            continue
        part = lowered(part)
        starts, ends, counts = words(part, cut)
        s, per = shingle_hashes(word_hashes(part, starts, ends), counts, k)
        row = np.repeat(np.arange(hi - lo), per)
        order = ordered(s, row)
        r, x = row[order], s[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
        yield lo, hi, x[new], np.bincount(r[new], minlength=hi - lo)


#: Bits of a set's parity map.
MAP_BITS = 512


def parity_maps(s: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each set's map of bits, where every member turns over the one its hash names: two maps differ in no more bits than the sets in members."""
    row = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(row * MAP_BITS + (mix(s) >> np.uint64(20)).astype(np.int64) % MAP_BITS, minlength=len(size) * MAP_BITS)
    packed = np.packbits((counts & 1).astype(bool).reshape(-1, MAP_BITS), axis=1).tobytes()
    return [packed[i: i + MAP_BITS // 8] for i in range(0, len(packed), MAP_BITS // 8)]


def map_words(column) -> np.ndarray:
    """Parity maps of an Arrow column without nulls, as rows of 64-bit words."""
    bits = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(bits):
        return np.zeros((0, MAP_BITS // 64), np.uint64)
    return np.frombuffer(bits.buffers()[2], dtype=np.uint64, count=len(bits) * MAP_BITS // 64, offset=bits.offset * (MAP_BITS // 8)).reshape(len(bits), MAP_BITS // 64)


def map_distances(maps: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """In how many bits maps[a] and maps[b] differ, some pairs at a time."""
    out = [np.bitwise_count(maps[a[i: i + step]] ^ maps[b[i: i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), step)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pack_rows(values: np.ndarray, counts: np.ndarray):
    """Arrow list array with ``counts[i]`` of the values in row i."""
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values))


# -- components --------------------------------------------------------------

#: Edges up to which one task could hold those of any node.
MANY_EDGES = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of the component of each of n nodes, for undirected edges (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = lo != hi
        if not apart.any():
            break
        a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of each node: (node, root) from undirected edges (a, b).

    Alternates large-star and small-star steps; every step is a group-by that
    combines before it shuffles, each round is stored, and the rounds end when every
    edge leads to a root.  A node's neighbours are joined to its minimum, not gathered; beyond MANY_EDGES,
    nodes with a thousandth of all edges are joined where their edges are, by a broadcast of these few nodes.
    """
    e = (edges.where("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = stored(e, "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def star(e: DataFrame, large: bool, edges: int) -> DataFrame:
        pairs = e.select("u", "v")
        if large:
            pairs = pairs.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        if edges <= MANY_EDGES:
            linked = pairs.join(low, "u")
        else:  # an edge has two ends, so at most 2000 nodes have a thousandth of the edges
            top = F.broadcast(low.where(F.col("n") >= edges // 1000))
            linked = pairs.join(top, "u").unionByName(pairs.join(top, "u", "left_anti").join(low, "u"))
        if large:
            out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def settled(e: DataFrame, n: int) -> bool:
        """Whether each node has one edge, to a node without any."""
        return n == e.select(F.count_distinct("u")).first()[0] and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()

    for _ in range(most_rounds):
        n = e.count()
        if settled(e, n):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = stored(star(star(e, True, n), False, n), "star")
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
