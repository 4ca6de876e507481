"""Similarity join on the sets of word n-grams, with prefixes that each document makes as long as pays.

All shingles have one order, those with few documents first.  Two sets with an overlap of c and more share l shingles at
least among the first n - c + l of each, for any l up to c.  A longer prefix meets more lists of documents, but asks
for more matches in them before a pair is verified: each document takes the l whose estimated cost, the documents
in its prefix's lists and, of these, at most a part of 1/l that has l matches and is to be verified, is least.  Of a pair, the smaller l of
the two holds: it is verified if it has l matches within both prefixes of that l.

The order and the cost come from counters of the shingles' hashes over all documents, a fixed number of them, summed in blocks.  They bound the true numbers from above;
a shingle whose counter is one is in no other document and is not sent at all.  Any order and any l give the same result.

Each different set is joined once, however many documents have it.  Pairs come in rounds: neighbours by size in a shingle's list,
long lists dealt into parts at random, anew in each round; then all that is still apart in lists of several components.  There, documents of a list's
largest component meet only those of others, which go to every part of it, and these others meet in a grid of parts; so no task holds a long list, and a
large group of copies is not compared pair by pair.  Links are checked on the sets of both texts; components are taken in Spark.

Each set has a map of bits, where every shingle turns over the one its hash names: maps differ in no more bits than sets in shingles, so
a pair whose maps differ in more than similar sets may is dropped where it meets, whatever its matches.

Sets are told apart by 128 bits of hash, shingles by 64.

Defined results: null texts and texts without words have no shingles and are linked with nothing, not even each other, and their component is their own id; null ids
take part and get a component, null if all of its ids are; repeated rows each get their row; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import components, map_distances, map_words, mix, ordered, parity_maps, scratch, shingle_sets, stored, text_buffers, text_or_empty, trimmed

K = 4
#: Least similarity, as a fraction: intersection times OF >= union times AT_LEAST.
AT_LEAST, OF = 85, 100
#: Counters of shingles' documents, and how many of them travel in a row.
COUNTERS = 1 << 21
COUNTER_BLOCK = 1 << 14
#: Most matches that a prefix may ask for; cost of verifying a shingle, where meeting a document in a list costs one.
MOST_MATCHES = 4
VERIFY = 0.25
#: Documents of a list that meet in one task, about, and prefix shingles that a task holds.
LIST_ROWS = 1024
CELL_ROWS = 300_000
#: Steps to neighbours in a list, of the rounds before the last.
NEIGHBOURS = (2, 16)
#: Rows of three longs up to which a table is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


# -- sets and counters ---------------------------------------------------------------

def set_hashes(s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set, in any order of its members."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(s) + 1, dtype=np.uint64)
        np.cumsum(mix(s ^ np.uint64(salt)), out=total[1:])
        cut = np.concatenate([[0], np.cumsum(size)])
        out.append(mix(total[cut[1:]] - total[cut[:-1]] + size.astype(np.uint64)))
    return out[0], out[1]


def _prints(k: int, counters: int):
    """A row for each text with its set's size and hashes, and rows with blocks of the task's counters."""
    names = ["id", "text_key", "n", "node", "other", "bits", "block", "counts"]

    def run(batches):
        total = np.zeros(counters, dtype=np.uint32)
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for lo, hi, s, size in shingle_sets(data, offsets, k):
                np.add.at(total, s & np.uint64(counters - 1), np.uint32(1))
                node, other = set_hashes(s, size)
                n = hi - lo
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, n), b.column("text_key").slice(lo, n), pa.array(size.astype(np.int64)), pa.array(node.view(np.int64)), pa.array(other.view(np.int64)),
                                                  pa.array(parity_maps(s, size), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for i in range(0, counters, COUNTER_BLOCK):
            part = total[i: i + COUNTER_BLOCK]
            if part.any():
                packed = part.astype(np.uint8) if part.max() < 256 else part
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.binary()), pa.array([i // COUNTER_BLOCK], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=names)
        trimmed()
    return run


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
            counts = np.frombuffer(raw, np.uint8 if len(raw) <= COUNTER_BLOCK else np.uint32)
            own = total.setdefault(block, np.zeros(len(counts), np.uint64))
            own += counts
    for block, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(own, np.uint64((1 << 32) - 1)).astype(np.uint32).tobytes()], pa.binary())], names=["block", "counts"])


def document_counts(prints: DataFrame, counters: int) -> np.ndarray:
    """The counters over all documents; ``counters`` of them, whatever the input."""
    blocks = max(1, counters // COUNTER_BLOCK)
    out = np.zeros(counters, dtype=np.uint32)
    for r in prints.where("block is not null").select("block", "counts").repartition(blocks, "block").mapInArrow(_summed, "block int, counts binary").toLocalIterator():
        own = np.frombuffer(r.counts, np.uint32)
        out[r.block * COUNTER_BLOCK: r.block * COUNTER_BLOCK + len(own)] = own
    return out


# -- prefixes ------------------------------------------------------------------------

def least_overlap(n: np.ndarray) -> np.ndarray:
    """What a set of n shingles has in common with any set it is similar to, at least."""
    return -(-AT_LEAST * n // OF)


def adaptive_prefixes(s: np.ndarray, size: np.ndarray, counts: np.ndarray, most: int = MOST_MATCHES):
    """Of sets side by side: order of their shingles, place in the set, whether in its prefix, the documents of each, and each set's matches l."""
    n = size.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    docs = counts[s & np.uint64(len(counts) - 1)].astype(np.int64)
    order = ordered(s, docs, row)
    docs, begin = docs[order], np.cumsum(n) - n
    place = np.arange(len(s)) - np.repeat(begin, n)
    met = np.concatenate([[0], np.cumsum(docs - 1)])
    base, best, l = n - least_overlap(n), np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for matches in range(1, most + 1):
        length = np.minimum(base + matches, n)
        others = met[begin + length] - met[begin]
        cost = others * (1.0 + VERIFY * n / matches)
        better = (cost < best) & (matches <= least_overlap(n))
        best[better], l[better] = cost[better], matches
    return order, row, place, place < (base + l)[row], docs, l


def _prefix_rows(k: int, shared):
    """(cell, node, size, place, l, parts): the prefix of each set, once in a task; ``parts``: of the shingle's list."""
    def run(batches):
        counts, seen = shared.value, set()
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            for _, _, s, size in shingle_sets(data, offsets, k):
                node = set_hashes(s, size)[0]
                fresh = np.zeros(len(node), dtype=bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        fresh[i] = size[i] > 0
                        seen.add(x)
                s, size, node = s[np.repeat(fresh, size)], size[fresh], node[fresh]
                order, row, place, inside, docs, l = adaptive_prefixes(s, size, counts)
                inside &= docs > 1
                parts = 1 << np.ceil(np.log2(np.maximum(docs[inside] / LIST_ROWS, 1))).astype(np.int64)
                row = row[inside]
                yield pa.RecordBatch.from_arrays([pa.array(s[order][inside].view(np.int64)), pa.array(node.view(np.int64)[row]), pa.array(size[row].astype(np.int32)), pa.array(place[inside].astype(np.int32)),
                                                  pa.array(l[row].astype(np.int32)), pa.array(np.minimum(parts, 1 << 30).astype(np.int32))], names=["cell", "node", "size", "place", "l", "parts"])
        trimmed()
    return run


CELLS = "cell long, node long, size int, place int, l int, parts int"


def _gathered(batches, *names: str):
    """Columns of all batches sorted by cell, part, size and node, each node once in a part of a cell."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    c = {n: t.column(n).to_numpy() for n in (*names, "cell", "node", "size", "place", "l", "part", "side")}
    order = np.lexsort((c["node"], c["size"], c["part"], c["cell"]))
    cell, part, node = c["cell"][order], c["part"][order], c["node"][order]
    order = order[np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1])])]
    out = {n: v[order].astype(np.int64) for n, v in c.items()}
    if "bits" in t.column_names:
        out["bits"] = map_words(t.column("bits"))[order]
    return t, order, out


def matched(c: dict[str, np.ndarray], last: int | None = None):
    """Places (a, b) of rows of one list whose sets may be similar and that match within both prefixes, and the matches asked for, in portions."""
    size, place, l, side = c["size"], c["place"], c["l"], c["side"]
    base = size - least_overlap(size)
    at, step = np.arange(len(size)), 1
    while last is None or step <= last:
        at = at[at + step < len(size)]
        to = at + step
        at = at[(c["cell"][at] == c["cell"][to]) & (c["part"][at] == c["part"][to]) & (OF * size[at] >= AT_LEAST * size[to])]  # rows past the window stay past it at greater steps
        if not len(at):
            return
        to = at + step
        both = np.minimum(l[at], l[to])
        hit = (place[at] < base[at] + both) & (place[to] < base[to] + both)
        # before the shingle they share, and after it, they can't share more than the shorter has
        most = np.minimum(place[at], place[to]) + np.minimum(size[at] - place[at], size[to] - place[to])
        hit &= (OF + AT_LEAST) * most >= AT_LEAST * (size[at] + size[to])
        hit &= (side[at] != side[to]) | (side[at] < 0)
        a, b, both = at[hit], to[hit], both[hit]
        if "bits" in c:
            close = (OF + AT_LEAST) * map_distances(c["bits"], a, b) <= (OF - AT_LEAST) * (size[a] + size[b])
            a, b, both = a[close], b[close], both[close]
        if len(a):
            yield a, b, both
        step += 1


def _met(batches):
    """The rows of lists of one part that may match another, and all those of longer lists."""
    got = _gathered(batches, "parts")
    if got is None:
        return
    t, order, c = got
    some = c["parts"] > 1
    for a, b, _ in matched(c):
        some[a] = some[b] = True
    yield from t.take(pa.array(order[some])).combine_chunks().select(["cell", "node", "size", "place", "l", "parts"]).to_batches()
    trimmed()


def _matches(last: int | None):
    """(a, b, matches, asked): pairs of nodes with different roots and their matches in this task's lists."""
    def run(batches):
        got = _gathered(batches, "root")
        if got is None:
            return
        _, _, c = got
        names, which = np.unique(c["node"], return_inverse=True)
        held, asked, n = [], [], 0

        def portion():
            pairs, first, times = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names[pairs // len(names)]), pa.array(names[pairs % len(names)]), pa.array(times.astype(np.int64)), pa.array(np.concatenate(asked)[first].astype(np.int32))],
                                              names=["a", "b", "matches", "asked"])
        for a, b, both in matched(c, last):
            apart = c["root"][a] != c["root"][b]
            a, b = which[a[apart]], which[b[apart]]
            held.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
            asked.append(both[apart])
            n += len(a)
            if n > 1_000_000:
                yield portion()
                held, asked, n = [], [], 0
        if n:
            yield portion()
        trimmed()
    return run


# -- rounds ----------------------------------------------------------------------------

def _pairs(lists: DataFrame, parts: int, last: int | None) -> DataFrame:
    """Pairs with as many matches as they are asked for; ``lists``: rows with root, part and side."""
    found = lists.repartition(parts, "cell", "part").mapInArrow(_matches(last), "a long, b long, matches long, asked int")
    return found.groupBy("a", "b").agg(F.sum("matches").alias("matches"), F.first("asked").alias("asked")).where("matches >= asked").select("a", "b")


def _spread(held: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, so that every two of different ones meet in one part, where their sides differ or are negative."""
    sizes = held.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"))
    mixed = sizes.where("roots > 1").select(F.col("cell").alias("_cell"), F.col("all"), F.col("all") - F.col("top.n"), F.col("top.root")).toDF("_cell", "all", "few", "top")
    rows = held.join(mixed, F.col("cell") == F.col("_cell")).withColumns({"large": (F.greatest("all", F.lit(1)) / LIST_ROWS).cast("int") + 1, "small": (F.col("few") / LIST_ROWS).cast("int") + 1})
    own = F.pmod(F.xxhash64("node", F.lit("part")), F.col("small")).cast("int")
    columns = ["cell", "node", "size", "place", "l", "bits", "root"]

    def part(kind: int, x: Column, y: Column, side: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(kind), x, y).alias("part"), side.alias("side"))

    zero = F.lit(0)
    top = rows.where("root = top").select(*columns, part(0, F.pmod(F.xxhash64("node", F.lit("part")), F.col("large")).cast("int"), zero, zero).alias("at"))
    others = rows.where("root <> top")
    facing = others.select(*columns, F.explode(F.transform(F.sequence(zero, F.col("large") - 1), lambda i: part(0, i, zero, F.lit(1)))).alias("at"))
    among = others.select(*columns, F.explode(F.transform(F.sequence(zero, F.col("small") - 1), lambda i: part(1, F.least(own, i), F.greatest(own, i), F.when(own == i, -1).otherwise(own)))).alias("at"))
    return top.unionByName(facing).unionByName(among).select(*columns, "at.part", F.col("at.side").cast("int").alias("side"))


def _similar(k: int):
    """Of pairs of texts, those whose sets are similar."""
    def run(batches):
        for b in batches:
            sides = []
            for node, text in (("a", "text_a"), ("b", "text_b")):  # a text of many pairs is read once a batch
                _, first, which = np.unique(b.column(node).to_numpy(), return_index=True, return_inverse=True)
                sets: list[np.ndarray] = []
                for _, _, s, size in shingle_sets(*text_buffers(b.column(text).take(pa.array(first))), k):
                    sets += np.split(s, np.cumsum(size)[:-1])
                sides.append([sets[i] for i in which])
            yield b.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(*sides)], pa.bool_()))
        trimmed()
    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= AT_LEAST * (len(a) + len(b) - shared)


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Those of the pairs that are similar; ``rows``: (id, text, text_key), ``nodes``: (node, first)."""
    with scratch(pairs.sparkSession):
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
        wanted = stored(ends.join(nodes, F.col("_node") == F.col("node")).select("_node", F.col("first.text_key").alias("_key"), F.col("first.id").alias("_id")), "wanted")
        few = wanted.count() <= BROADCAST_ROWS
        texts = (rows.join(F.broadcast(wanted) if few else wanted, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).select(F.col("_node").alias("node"), "text").dropDuplicates(["node"]))
        texts = stored(texts, "pair_texts")
        one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar(k), "a long, b long"), "similar")


def similar_sets(rows: DataFrame, nodes: DataFrame, counts: np.ndarray, shingles: int, k: int) -> DataFrame:
    """(node, root) of what links connect; ``rows``: (id, text, text_key), ``nodes``: (node, first, bits)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // 5 // CELL_ROWS)

    def dealt(lists: DataFrame, seed: int) -> DataFrame:
        return lists.withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts"))).withColumn("side", F.lit(-1))

    prefixes = rows.select("text").mapInArrow(_prefix_rows(k, shared), CELLS)
    met = stored(dealt(prefixes, 0).repartition(parts, "cell", "part").mapInArrow(_met, CELLS), "met")
    met = stored(met.join(nodes.select(F.col("node").alias("_node"), "bits"), F.col("node") == F.col("_node")).drop("_node"), "met_bits")
    roots, links, few = None, None, False
    for seed, last in enumerate((*NEIGHBOURS, None)):
        held = met.withColumn("root", F.col("node"))
        if roots is not None:
            held = met.join(F.broadcast(roots) if few else roots, F.col("node") == F.col("_node"), "left").select(*met.columns, F.coalesce("root", "node").alias("root"))
        near = _verified(_pairs(dealt(held, seed) if last else _spread(held), parts, last), rows, nodes, k)
        links = near if links is None else links.unionByName(near)
        if roots is None or not near.isEmpty():
            roots = stored(components(links), "roots").withColumnRenamed("node", "_node")
            few = roots.count() <= BROADCAST_ROWS
    return roots.withColumnRenamed("_node", "node")


def ngram_components(documents: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text")).select("id", "text", F.xxhash64("text").alias("text_key"))
    prints = stored(rows.mapInArrow(_prints(k, counters), "id long, text_key long, n long, node long, other long, bits binary, block int, counts binary"), "prints")
    with scratch(documents.sparkSession):
        sets = prints.where("block is null").drop("block", "counts")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")
        classes = stored(sets.where("n > 0").groupBy("node", "other", "n").agg(F.min("id").alias("least"), first, F.first("bits").alias("bits")), "classes")
        nodes = stored(classes.groupBy("node").agg(F.min(F.struct("first", "other", "n", "bits")).alias("_")).select("node", "_.first", F.col("_.other").alias("own"), F.col("_.n").alias("n"), "_.bits"), "nodes")
        shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found = similar_sets(rows, nodes.select("node", "first", "bits"), document_counts(prints, counters), shingles, k)
        rooted = classes.join(nodes.select("node", "own"), "node").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        # a set whose first hash is another's as well stays by itself
        rooted = stored(rooted.select("node", "other", "n", "least", F.when(F.col("other") == F.col("own"), F.coalesce("root", "node")).alias("root")), "rooted")
        least = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("smallest"))
        named = stored(rooted.join(least, "root", "left").select("node", "other", "n", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id")), "named")
    return (sets.where("n > 0").join(named, ["node", "other", "n"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
            .unionByName(sets.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM s),
c AS MATERIALIZED (SELECT g, any_value(n) AS n, min(doc_id) AS least FROM n WHERE n > 0 GROUP BY g),
t AS (SELECT least, n, unnest(g) AS x FROM c),
e AS MATERIALIZED (SELECT a.least AS a, b.least AS b FROM t a JOIN t b ON a.x = b.x AND a.least <> b.least GROUP BY a.least, b.least, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(node, root) AS (SELECT least, least FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(m.root, n.doc_id) AS component_id
FROM n LEFT JOIN c ON n.g = c.g LEFT JOIN m ON m.node = c.least
"""

QUERIES = {"op11_ngram_join": op11_ngram_join}
ORACLES = {"op11_ngram_join": OP11_SQL}
