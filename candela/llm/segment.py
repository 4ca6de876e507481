"""Sampled segmentations into SentencePiece pieces, without replacement, and decoding.

A text, with a space before it and spaces as the piece file writes them, is a lattice: nodes
are byte positions, edges are pieces.  A path's weight is the product of its pieces'
probabilities (a Zipf law over the file's order of pieces, to the power ``alpha``), and
backward sums over the lattice give the exact share of every edge among the completions.

Gumbel top-k without replacement runs as a perturbed A* search.  In the form of
arrival times (the exponential of a negated Gumbel value), a set of paths of share r has its first
arrival after an exponential time of rate r.  The frontier holds disjoint sets of
paths: a prefix, and the edges not to be taken next.  The set that arrives first is
popped, its first path is drawn edge by edge, and what is left of it goes back:
the set itself without the edge taken, and for every later node of the path
the set that leaves the path there, each delayed by an exponential time of its own rate.
Paths pop in the order of their perturbed scores, all distinct.  With the next
arrival after the last one kept, tau, a path of share p has the inclusion probability
1 - exp(-p tau); it is 1 if the lattice has no further path.

No piece spans the start of a run of spaces, so the lattice of a text is a chain of
lattices of its words.  These are built once per distinct word of a slice, and drawn for all
texts of the slice together.  All draws are hashes of (row key, seed, position), so that a row
gives the same result in any partition.

Characters that no piece covers are written as byte pieces; so is a literal U+2581,
which makes decoding exact for every text.

Defined results: a null text is empty; an empty text has one segmentation, the empty
one; texts with fewer than k segmentations give all they have; a null key is a key like
others; repeated rows give equal results; an empty table gives an empty table; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import mix, powers_down, prefix_hash, range_hash, slices, text_buffers, text_or_empty, trimmed

MODEL = os.environ.get("CANDELA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SAMPLES = 3
ALPHA = 1.0
SEED = 17
SLICE = 1_000_000
TABLE_BITS = 18
#: Nodes of a partition's known words, about, and the size of the table of words seen.
ROOM = 1_000_000
SEEN_BITS = 22
NONE, SEVERAL = 0, 1
#: Negated log of a share of all paths that double precision does not see beside the rest.
NEGLIGIBLE = 45.0
#: Units of fixed-point logarithms and shares.
_FIXED, _SHARES = float(1 << 32), float(1 << 40)
_CHAR = np.ones(256, dtype=np.int64)
_CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:] = 2, 3, 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
#: The lowest 0 to 8 bytes of a number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def plain_hash(prefix: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position; for strings of equal length only."""
    return (prefix[at + n] - prefix[at]) * powers_down(len(prefix))[at]


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first lowest; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,)).copy()


def string_key(word: np.ndarray, prefix: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A number of the n bytes from each position: up to eight are the number themselves, of more it is a hash; for strings of equal length only."""
    return word[at] & _MASKS[n] if n <= 8 else plain_hash(prefix, at, n)


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _GOLD) >> np.uint64(64 - bits)).astype(np.int32)


class Pieces:
    """Pieces of a file, with spaces in place of U+2581, and their log-probabilities."""

    def __init__(self, raw: list[bytes], byte_ids: list[int], plain: list[int], alpha: float):
        self.raw, self.byte_ids = raw, np.array(byte_ids, dtype=np.int64)
        rank = np.full(len(raw), float(len(raw)))
        rank[plain] = np.arange(len(plain))
        used = np.concatenate([np.array(plain, dtype=np.int64), self.byte_ids])
        z = -np.log(rank + 2.0)
        self.logp = alpha * (z - np.log(np.exp(z[used]).sum()))
        self.size = np.array([len(p) for p in raw], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = np.array(plain, dtype=np.int64)
        prefix, word = prefix_hash(self.pool), words(self.pool)
        self.mask = _MASKS[np.minimum(self.size, 8)]
        self.word, self.pool_word = word[self.start] & self.mask, word
        self.tables = []
        for n in range(1, int(self.size[ids].max(initial=0)) + 1):
            # pieces of n bytes, and the first n bytes of longer ones: where these don't fit, no longer piece does
            own, longer = ids[self.size[ids] == n], ids[self.size[ids] > n]
            h = string_key(word, prefix, self.start[own], n)
            order = np.argsort(h)
            h, own = h[order], own[order]
            # by slot: twice the only piece there and 2, NONE, or SEVERAL; odd where a longer piece may begin
            starts = np.unique(string_key(word, prefix, self.start[longer], n))
            bits = int(min(TABLE_BITS, max(10, np.ceil(np.log2(max(len(h), len(starts), 1))) + 4)))
            which = np.full(1 << bits, 2 * NONE, dtype=np.int32)
            place, count = np.unique(slot(h, bits), return_counts=True)
            which[slot(h, bits)] = 2 * (np.arange(len(h)) + 2)
            which[place[count > 1]] = 2 * SEVERAL
            which[slot(starts, bits)] |= 1
            self.tables.append((n, h, own.astype(np.int32), which))

    @classmethod
    def load(cls, path: str = MODEL, alpha: float = ALPHA) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, byte_ids, plain = [], [0] * 256, []
        for i in range(m.GetPieceSize()):
            if m.IsByte(i):
                value = int(m.IdToPiece(i)[3:5], 16)
                byte_ids[value] = i
                raw.append(bytes([value]))
            elif m.IsControl(i) or m.IsUnknown(i):
                raw.append(b"")
            else:
                raw.append(m.IdToPiece(i).replace("▁", " ").encode())
                plain.append(i)
        return cls(raw, byte_ids, plain, alpha)

    def text_of(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, one after another."""
        n = self.size[ids]
        whole = int(n.sum())
        kind = np.int32 if whole + len(self.pool) < 1 << 31 else np.int64
        at = np.repeat((self.start[ids] - (np.cumsum(n) - n)).astype(kind), n)
        at += np.arange(whole, dtype=kind)
        return self.pool[at]

    def decode(self, ids) -> bytes:
        """The text that the pieces stand for: theirs without the space before it."""
        return self.text_of(np.asarray(ids, dtype=np.int64)).tobytes()[1:]


class Lattice:
    """Edges of the lattices of distinct words, those of a node together, with their shares among completions."""

    def __init__(self, pieces: Pieces, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        size = len(data)
        stop = np.repeat(end, end - begin).astype(np.int32)
        prefix, word = prefix_hash(data), words(data)
        first = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        width = _CHAR[data]
        found = []  # places, ids and size of the pieces of each size
        alone = np.zeros(size + 1, dtype=bool)
        pos = first
        for n, hashes, ids, which in pieces.tables:
            pos = pos[pos + n <= stop[pos]]
            if not len(pos):
                break
            h = string_key(word, prefix, pos, n)
            there = which[slot(h, len(which).bit_length() - 1)]
            maybe = np.flatnonzero(there > 1)
            if len(maybe):
                x, hm = (there[maybe] >> 1) - 2, h[maybe]
                many = np.flatnonzero(x == SEVERAL - 2)
                if len(many):
                    x[many] = np.minimum(np.searchsorted(hashes, hm[many]), len(hashes) - 1)
                hit = hashes[x] == hm
                own = pos[maybe[hit]]
                found.append((own, ids[x[hit]], n))
                if n <= 4:
                    alone[own[width[own] == n]] = True
            pos = pos[(there & 1) == 1]
        lost = first[~alone[first]]
        if len(lost):
            inner = _ragged(lost.astype(np.int64), width[lost]).astype(np.int32)
            found.append((inner, pieces.byte_ids[data[inner]].astype(np.int32), 1))
        # from the words' ends to their starts, node by node; a place is in each of ``found`` once at most
        edges_of = np.zeros(size + 1, dtype=np.int32)
        for own, _, _ in found:
            edges_of[own] += 1
        nodes = np.flatnonzero(edges_of).astype(np.int32)
        level = stop[nodes] - nodes if size else nodes
        order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
        nodes, level = nodes[order], level[order]
        many = edges_of[nodes]
        ends = np.cumsum(many, dtype=np.int64)
        heads, free = ends - many, edges_of
        free[nodes] = heads
        self.at = np.repeat(nodes, many)
        self.piece, self.next = np.empty(len(self.at), dtype=np.int32), np.empty(len(self.at), dtype=np.int32)
        for own, ids, n in found:
            to = free[own]
            self.piece[to], self.next[to] = ids, own + np.int32(n)
            free[own] = to + 1
        self.last = self.next == stop[self.at] if size else np.zeros(0, bool)
        owner = np.repeat(np.arange(len(heads)), many)
        goes = np.where(self.last, np.int32(size), self.next)
        beta = np.zeros(size + 1)
        self.lp = pieces.logp[self.piece]
        node_cut = np.flatnonzero(np.diff(level, prepend=-1)).tolist()
        for i, j in zip(node_cut, [*node_cut[1:], len(heads)]):
            a, z = int(heads[i]), int(ends[j - 1])
            x = self.lp[a:z] + beta[goes[a:z]]
            begins = heads[i:j] - a
            most = np.maximum.reduceat(x, begins)
            best = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, many[i:j])), begins))
            beta[nodes[i:j]] = best
            self.lp[a:z] = x - np.repeat(best, many[i:j])
        self.beta = beta
        np.minimum(self.lp, 0.0, out=self.lp)
        p = np.exp(self.lp)
        self.rank = np.zeros(size + 1, dtype=np.int32)
        self.rank[nodes] = np.arange(len(heads))
        self.lo, self.hi = heads.astype(np.int32), ends.astype(np.int32)
        # the likeliest edge of a node is tried first; the others follow in a table of running sums
        most = np.maximum.reduceat(p, heads) if len(heads) else p
        best = np.flatnonzero(p == np.repeat(most, many))
        best = best[np.flatnonzero(np.diff(owner[best], prepend=-1))]
        self.top, self.p_top = np.zeros(size + 1, dtype=np.int32), np.ones(size + 1)
        self.top[self.at[best]], self.p_top[self.at[best]] = best, p[best]
        p[best] = 0.0
        # sums of fixed-point numbers are exact, so they don't depend on the words beside
        run = np.cumsum(np.rint(p * _SHARES).astype(np.int64))
        base = np.concatenate([[0], run])[heads]
        self.key = (owner << 41) + (run - np.repeat(base, many))


#: What a lattice has for each node, edge and node rank, and by the number of which of these its values shift behind another lattice.
_LAID = {"beta": ("nodes", None), "rank": ("nodes", "ranks"), "top": ("nodes", "edges"), "p_top": ("nodes", None), "at": ("edges", "nodes"), "next": ("edges", "nodes"), "piece": ("edges", None),
         "last": ("edges", None), "lp": ("edges", None), "key": ("edges", "keys"), "lo": ("ranks", "edges"), "hi": ("ranks", "edges")}


class Known:
    """Lattice of the words of a partition that came again, until it has ROOM nodes; a slice only adds what is new.

    The arrays have room behind, so that a slice's other words are laid there without a copy of what is known.
    """

    def __init__(self):
        self.size = {"nodes": 0, "edges": 0, "ranks": 0}
        self.arrays: dict[str, np.ndarray] = {}
        self.hashes, self.begin = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.seen = np.zeros(1 << SEEN_BITS, dtype=bool)  # by hash: a word taken for another is only kept too early

    def again(self, names: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Which of some distinct words came before, or come more than once now; none where there is no more room."""
        place = names >> np.uint64(64 - SEEN_BITS)
        out = (times > 1) | self.seen[place] if self.size["nodes"] < ROOM else np.zeros(len(names), dtype=bool)
        self.seen[place] = True
        return out

    def with_words(self, more: Lattice) -> Lattice:
        """The known words' lattice and ``more`` behind it; it holds until the next call."""
        size = {"nodes": len(more.beta) - 1, "edges": len(more.at), "ranks": len(more.lo)}
        shift = {**self.size, "keys": self.size["ranks"] << 41}
        out = Lattice.__new__(Lattice)
        for name, (kind, by) in _LAID.items():
            old, whole = self.size[kind], self.size[kind] + size[kind]
            x = getattr(more, name)[:size[kind]]
            if name not in self.arrays or len(self.arrays[name]) < whole:
                room = np.empty(whole + whole // 4, dtype=x.dtype)
                room[:old] = self.arrays.get(name, room)[:old]
                self.arrays[name] = room
            y = self.arrays[name][:whole]
            if by:
                np.add(x, x.dtype.type(shift[by]), out=y[old:])
            else:
                y[old:] = x
            setattr(out, name, y)
        return out

    def keep(self, more: Lattice, names: np.ndarray, first_node: np.ndarray) -> None:
        """Adds the words of ``more``, by their hashes in order, to what is known."""
        self.with_words(more)
        at = np.searchsorted(self.hashes, names)
        self.hashes, self.begin = np.insert(self.hashes, at, names), np.insert(self.begin, at, first_node + self.size["nodes"])
        for kind, n in (("nodes", len(more.beta) - 1), ("edges", len(more.at)), ("ranks", len(more.lo))):
            self.size[kind] += n


def _words_lattice(pieces: "Pieces", text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[Lattice, np.ndarray]:
    """Lattice of the words at ``start`` of ``text``, and the first node of each."""
    begin = np.cumsum(length) - length
    data = text[np.repeat(start - begin, length) + np.arange(int(length.sum()))]
    return Lattice(pieces, data, begin, begin + length), begin


def _streamed(seed: np.ndarray, stream: int) -> np.ndarray:
    return mix(seed + np.uint64((int(_GOLD) * (stream + 1)) & ((1 << 64) - 1)))


def _uniform(seed: np.ndarray, at: np.ndarray, stream: int | None) -> np.ndarray:
    """Draws in (0, 1) from (row seed, position, stream); ``seed`` is streamed already where that is None."""
    base = seed if stream is None else _streamed(seed, stream)
    return _unit(base + at.astype(np.uint64) * _STEP)


def _unit(h: np.ndarray) -> np.ndarray:
    h = mix(h)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _passed(lat: Lattice, rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The first edge of each node, by its rank, whose running sum is above ``key``; the node's end if there is none.  Nodes have few edges."""
    x, end = lat.lo[rank], lat.hi[rank]
    live = np.arange(len(x))
    while len(live):
        at = x[live]
        live = live[lat.key[at] <= key[live]]
        x[live] += 1
        live = live[x[live] < end[live]]
    return x


def _draw(lat: Lattice, node: np.ndarray, token: np.ndarray, shift: np.ndarray, seed: np.ndarray, stream: int):
    """Paths from ``node`` to the end of each token's word: edges in order, and the number of each token.

    ``shift`` turns a node of the word's lattice into a position of the text; ``seed`` is per token.
    """
    n = len(node)
    count = np.zeros(n, dtype=np.int64)
    # the draw at a position is that of base + node * _STEP, as the shift is the token's own
    steps, live, cur, base = [], np.arange(n), node, _streamed(seed, stream) + shift.astype(np.uint64) * _STEP
    while len(live):
        u = _unit(base + cur.astype(np.uint64) * _STEP)
        e = lat.top[cur]
        u -= lat.p_top[cur]
        off = np.flatnonzero(u >= 0)
        if len(off):
            ro = lat.rank[cur[off]].astype(np.int64)
            x = _passed(lat, ro, (ro << 41) + (u[off] * _SHARES).astype(np.int64))
            # rounding may pass the node's last edge: the likeliest stands for it
            e[off] = np.where(x < lat.hi[ro], x, e[off])
        steps.append((live, e))
        more = np.flatnonzero(~lat.last[e])
        count[live] = len(steps)
        live, cur, base = live[more], lat.next[e[more]], base[more]
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.int32)
    for s, (who, e) in enumerate(steps):
        out[begin[who] + s] = e
    return out, count


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin[i], begin[i] + 1, ... of ``size[i]`` places for each i, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Paths:
    """The paths that one draw gave some of the texts: edges and tokens, and where each text's begin."""

    def __init__(self, n: int, rows: np.ndarray, edges: np.ndarray, tokens: np.ndarray, size: np.ndarray):
        self.edges, self.tokens = edges, tokens
        self.begin, self.size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.begin[rows], self.size[rows] = np.cumsum(size) - size, size
        self.log_prob = np.full(n, -np.inf)
        # sets that leave the path: arrival (one of each text is infinite and stands for none), edge, and log share before it
        self.first = np.arange(n)
        self.times, self.edge, self.before = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.zeros(n)

    def soonest(self) -> np.ndarray:
        return np.minimum.reduceat(self.times, self.first)

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges, and log shares before them, of the soonest sets of ``rows``, which are gone then."""
        owner = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.times))))
        hit = np.flatnonzero(self.times == self.soonest()[owner])
        at = hit[np.searchsorted(owner[hit], rows)]
        self.times[at] = np.inf
        return self.edge[at], self.before[at]


class Search:
    """Perturbed A* over the lattices of some texts together; a row of each array is a text."""

    def __init__(self, lat: Lattice, first: Paths, seeds: np.ndarray, token_end: np.ndarray, root: np.ndarray, shift: np.ndarray, token_seed: np.ndarray, k: int):
        n = len(seeds)
        self.lat, self.seeds, self.k, self.n = lat, seeds, k, n
        self.token_end, self.root, self.shift, self.token_seed = token_end, root, shift, token_seed
        self.paths = [first]
        # sets that lost an edge already: arrival, path, place, log share before it and the edges lost
        self.again = np.full((n, k), np.inf)
        self.again_of, self.again_at, self.again_before = np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.int64), np.zeros((n, k))
        self.again_lost = np.full((n, k, k + 1), -1, dtype=np.int64)
        rows = np.arange(n)
        self._arrive(first, rows, np.zeros(n, dtype=np.int64), np.log(-np.log(_uniform(seeds, np.zeros(n, np.int64), 1))), 2)
        for j in range(1, k):
            if not self._next(j):
                break

    def _arrive(self, p: Paths, rows: np.ndarray, since: np.ndarray, logt: np.ndarray, stream: int) -> None:
        """Log-probabilities of the paths of ``rows``, and arrivals of their sets from edge ``since`` on."""
        begin, size = p.begin[rows], p.size[rows]
        lp = np.maximum(self.lat.lp[p.edges], -1e6)
        p.log_prob[rows] = np.add.reduceat(lp, begin)
        # sums of fixed-point numbers are exact, so they don't depend on the texts beside
        fixed = np.rint(lp * _FIXED).astype(np.int64)
        ahead = np.cumsum(fixed) - fixed  # never rises, so what is near a path's start is a run of its edges
        # sets of shares below e^-NEGLIGIBLE in all arrive among the first with a chance below double precision
        near = np.searchsorted(-ahead, np.int64(NEGLIGIBLE * _FIXED) - ahead[begin]) - begin
        many = np.maximum(np.minimum(np.maximum(near, since + 8 * self.k), size) - since, 0)
        owner = np.repeat(np.arange(len(rows)), many)
        at = _ragged(begin + since, many)
        before, col = (ahead[at] - ahead[begin][owner]) / _FIXED, at - begin[owner]
        e = np.log(-np.log(_uniform(_streamed(self.seeds[rows], stream)[owner], col, None)))
        times = np.logaddexp(logt[owner], e - before - np.log(-np.expm1(lp[at])))  # infinite where nothing leaves the path
        count = np.ones(self.n, dtype=np.int64)
        count[rows] += np.bincount(owner, minlength=len(rows))
        p.first = np.cumsum(count) - count
        p.times, p.edge, p.before = np.full(int(count.sum()), np.inf), np.zeros(int(count.sum()), dtype=np.int64), np.zeros(int(count.sum()))
        to = _ragged(p.first[rows], count[rows] - 1)
        p.times[to], p.edge[to], p.before[to] = times, col, before

    def _next(self, j: int) -> bool:
        """Pop the set that arrives next of each text and draw its first path."""
        lat, all_rows = self.lat, np.arange(self.n)
        ahead = np.stack([p.soonest() for p in self.paths] + [self.again[:, m] for m in range(j - 1)], axis=1)
        pick = ahead.argmin(axis=1)
        logt = ahead[all_rows, pick]
        rows = np.flatnonzero(np.isfinite(logt))
        if not len(rows):
            return False
        pick, logt = pick[rows], logt[rows]
        of, at, before = pick.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
        lost = np.full((len(rows), self.k + 1), -1, dtype=np.int64)
        for i, p in enumerate(self.paths):
            own = np.flatnonzero(pick == i)
            at[own], before[own] = p.taken(rows[own])  # the next of the path's other sets takes its place
            lost[own, 0] = p.edges[p.begin[rows[own]] + at[own]]
        own = np.flatnonzero(pick >= j)
        slot_of = pick[own] - j
        of[own], at[own], before[own], lost[own] = self.again_of[rows[own], slot_of], self.again_at[rows[own], slot_of], self.again_before[rows[own], slot_of], self.again_lost[rows[own], slot_of]
        self.again[rows[own], slot_of] = np.inf
        base = np.cumsum([0, *[len(p.edges) for p in self.paths]])
        edges, tokens = np.concatenate([p.edges for p in self.paths]), np.concatenate([p.tokens for p in self.paths])
        begin = base[of] + np.stack([p.begin for p in self.paths])[of, rows]
        r = lat.rank[lat.at[edges[begin + at]]]
        lo, hi = lat.lo[r].astype(np.int64), lat.hi[r].astype(np.int64)
        among = lo[:, None] + np.arange(int((hi - lo).max()))
        free = (among < hi[:, None]) & ~(among[:, :, None] == lost[:, None, :]).any(axis=2)
        share = np.where(free, np.exp(lat.lp[np.minimum(among, len(lat.lp) - 1)]), 0.0)
        whole = share.sum(axis=1)
        seeds, mark = self.seeds[rows], j * 1_000_003 + at
        u = _uniform(seeds, mark, 3) * whole
        last_free = among.shape[1] - 1 - free[:, ::-1].argmax(axis=1)
        x = np.minimum((np.cumsum(share, axis=1) <= u[:, None]).sum(axis=1), last_free)
        taken = among[np.arange(len(rows)), x]
        rest = whole - share[np.arange(len(rows)), x]
        more = np.flatnonzero((free.sum(axis=1) > 1) & (rest > 0))
        v = _uniform(seeds[more], mark[more], 4)
        self.again[rows[more], j - 1] = np.logaddexp(logt[more], np.log(-np.log(v)) - before[more] - np.log(rest[more]))
        lost[np.arange(len(rows)), (lost >= 0).sum(axis=1)] = taken
        self.again_of[rows, j - 1], self.again_at[rows, j - 1], self.again_before[rows, j - 1], self.again_lost[rows, j - 1] = of, at, before, lost
        token = tokens[begin + at].astype(np.int64)
        through = lat.last[taken]
        own = token + through
        m = self.token_end[rows] - own
        tail = _ragged(own, m)
        node = self.root[tail]
        inner = np.flatnonzero(~through)
        node[(np.cumsum(m) - m)[inner]] = lat.next[taken[inner]]
        drawn, count = _draw(lat, node, tail, self.shift[tail], self.token_seed[tail], 10 + j)
        steps = np.concatenate([[0], np.cumsum(count)])
        cut = np.concatenate([[0], np.cumsum(m)])
        tail_size = steps[cut[1:]] - steps[cut[:-1]]
        size = at + 1 + tail_size
        to = np.cumsum(size) - size
        new_edges, new_tokens = np.empty(int(size.sum()), dtype=np.int32), np.empty(int(size.sum()), dtype=np.int32)
        head_to, head_from = _ragged(to, at), _ragged(begin, at)
        tail_to = _ragged(to + at + 1, tail_size)
        new_edges[head_to], new_edges[to + at], new_edges[tail_to] = edges[head_from], taken, drawn
        new_tokens[head_to], new_tokens[to + at], new_tokens[tail_to] = tokens[head_from], token, np.repeat(tail, count)
        p = Paths(self.n, rows, new_edges, new_tokens, size)
        self.paths.append(p)
        self._arrive(p, rows, at + 1, logt, 20 + j)
        return True

    def found(self):
        """Text, number from 0, edges, log-probability among all and log inclusion of each path, text by text, and the sizes of the paths."""
        ahead = np.concatenate([p.soonest()[:, None] for p in self.paths] + [self.again], axis=1).min(axis=1)
        size = np.stack([p.size for p in self.paths], axis=1)
        row, j = np.nonzero(size)
        log_prob = np.stack([p.log_prob for p in self.paths], axis=1)[row, j]
        base = np.cumsum([0, *[len(p.edges) for p in self.paths]])
        begin = base[j] + np.stack([p.begin for p in self.paths], axis=1)[row, j]
        edges = np.concatenate([p.edges for p in self.paths])[_ragged(begin, size[row, j])]
        x = log_prob + ahead[row]
        log_in = np.where(x > 4, 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 5.0))))))
        return row, j, edges, size[row, j], log_prob, log_in


def sample_slice(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, k: int, known: Known | None = None):
    """Of each text up to k samples, in the order of the search: rows of text, number from 1, size, log_prob,
    log_inclusion, and all ids one after another."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return _sample_slice(pieces, data, offsets, seeds, k, known)


def _sample_slice(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, k: int, known: Known | None):
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = size > 0
    # a space before every text that is not empty
    grown = np.full(len(data) + int(some.sum()), 0x20, dtype=np.uint8)
    doc_at = offsets[:-1] + np.cumsum(some) - some
    body = np.ones(len(grown), dtype=bool)
    body[doc_at[some]] = False
    grown[body] = data
    space = grown == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[doc_at[some]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(grown))
    tokens = np.diff(np.searchsorted(start, np.append(doc_at, len(grown))))
    tokens[~some] = 0
    doc_of = np.repeat(np.arange(n), tokens)
    token_cut = np.concatenate([[0], np.cumsum(tokens)])
    empty = np.flatnonzero(~some)
    parts = [(empty, np.zeros(len(empty), np.int64), np.zeros(0, np.int32), np.zeros(len(empty), np.int64), np.zeros(len(empty)), np.zeros(len(empty)))]
    if len(start):
        h = range_hash(prefix_hash(grown), start, end)
        order = np.argsort(h)
        head = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        which = order[head]
        names, times = h[which], np.diff(np.append(head, len(h)))
        word = np.empty(len(h), dtype=np.int64)
        word[order] = np.repeat(np.arange(len(names)), times)
        length = (end - start)[which]
        known = known or Known()
        fresh = np.ones(len(names), dtype=bool)
        if len(known.hashes):
            fresh = known.hashes[np.minimum(np.searchsorted(known.hashes, names), len(known.hashes) - 1)] != names
        fresh = np.flatnonzero(fresh)
        again = known.again(names[fresh], times[fresh])
        kept, fresh = fresh[again], fresh[~again]
        if len(kept):
            lattice, first_node = _words_lattice(pieces, grown, start[which[kept]], length[kept])
            known.keep(lattice, names[kept], first_node)
        wbegin = np.zeros(len(names), dtype=np.int64)
        old = np.ones(len(names), dtype=bool)
        old[fresh] = False
        wbegin[old] = known.begin[np.searchsorted(known.hashes, names[old])]
        lattice, first_node = _words_lattice(pieces, grown, start[which[fresh]], length[fresh])
        wbegin[fresh] = first_node + known.size["nodes"]
        lat = known.with_words(lattice)
        root = wbegin[word]
        shift = start - doc_at[doc_of] - root
        token_seed = seeds[doc_of]
        edges, count = _draw(lat, root, np.arange(len(start)), shift, token_seed, 0)
        cut = np.concatenate([[0], np.cumsum(count)])
        docs = np.flatnonzero(some)
        total = np.add.reduceat(lat.beta[root], token_cut[:-1][docs])  # log of the sum of all paths' weights
        begun = Paths(len(docs), np.arange(len(docs)), edges, np.repeat(np.arange(len(start), dtype=np.int32), count), cut[token_cut[docs + 1]] - cut[token_cut[docs]])
        row, j, ids, sizes, log_prob, log_in = Search(lat, begun, seeds[docs], token_cut[docs + 1], root, shift, token_seed, k).found()
        parts.append((docs[row], j, lat.piece[ids], sizes, log_prob + total[row], log_in))
    row, j, ids, sizes, log_prob, log_in = (np.concatenate(x) for x in zip(*parts))
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((j, row))
    return row[order], j[order] + 1, sizes[order], log_prob[order], log_in[order], ids[_ragged(begin[order], sizes[order])]


def _seeds(keys, seed: int) -> np.ndarray:
    return mix(np.asarray(keys, dtype=np.int64).view(np.uint64) + np.uint64((seed * int(_GOLD)) & ((1 << 64) - 1)))


def _segmenter(shared, k: int, seed: int, digests: bool):
    def run(batches):
        pieces, known = shared.value, Known()
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            seeds = _seeds(b.column("_seed").to_numpy(), seed)
            for lo, hi in slices(offsets, SLICE):
                part, offs = data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
                row, number, sizes, log_prob, log_in, ids = sample_slice(pieces, part, offs, seeds[lo:hi], k, known)
                cols = [b.column(0).take(pa.array(row + lo)), pa.array(number.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(log_prob), pa.array(log_in)]
                names = ["key", "sample", "n_pieces", "log_prob", "log_inclusion", "ids"]
                cut = np.concatenate([[0], np.cumsum(sizes)])
                cols.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))))
                if digests:
                    raw = np.ascontiguousarray(ids.astype(np.int32)).tobytes()
                    cols.append(pa.array([f"{xxhash.xxh64_intdigest(raw[4 * a: 4 * z]):016x}" for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.string()))
                    cols.append(pa.array(_decodes(pieces, ids, sizes, part, offs, row), pa.bool_()))
                    names += ["pieces_hash", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        trimmed()
    return run


def _decodes(pieces: Pieces, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether the pieces of each path stand for its text, byte by byte."""
    n = pieces.size[ids]
    after = np.cumsum(n)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.concatenate([[0], after])[cut]
    some = sizes > 0
    same = np.diff(ends) - some == np.diff(offsets)[row]
    word = words(data)
    # the place in its text of each piece, eight bytes at a time; the first piece's begins a byte before, with the space
    at = after - n
    at += np.repeat(offsets[:-1][row] - some - ends[:-1], sizes)
    begins = cut[:-1][some]
    unlike = word[np.clip(at, 0, len(data))]
    unlike[begins] = word[at[begins] + 1] << np.uint64(8)
    unlike ^= pieces.word[ids]
    unlike &= pieces.mask[ids]
    unlike[begins] &= ~_MASKS[1]
    wrong = [np.flatnonzero(unlike)]
    long = np.flatnonzero(n > 8)
    for skip in range(8, int(n.max(initial=0)), 8):
        long = long[n[long] > skip]
        other = word[np.clip(at[long] + skip, 0, len(data))] ^ pieces.pool_word[pieces.start[ids[long]] + skip]
        wrong.append(long[(other & _MASKS[np.minimum(n[long] - skip, 8)]) != 0])
    same[np.searchsorted(cut, np.concatenate(wrong), side="right") - 1] = False
    return same


def sampled(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, seed: int = SEED, model: str = MODEL,
            alpha: float = ALPHA, digests: bool = False) -> DataFrame:
    """Per row and sample: the key, sample (from 1), n_pieces, log_prob (natural log of the path's weight),
    log_inclusion, and ids; with ``digests`` also their hash and whether they decode to the text."""
    rows = documents.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("_seed"), text_or_empty(text).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(Pieces.load(model, alpha))  # the piece file's size
    kind = rows.schema["key"].dataType.simpleString()
    tail = "ids array<int>" + (", pieces_hash string, decoded boolean" if digests else "")
    out = rows.mapInArrow(_segmenter(shared, k, seed, digests), f"key {kind}, sample int, n_pieces int, log_prob double, log_inclusion double, {tail}")
    return out.withColumnRenamed("key", key)


def _decoder(shared):
    def run(batches):
        pieces = shared.value
        for b in batches:
            text = [None if ids is None else pieces.decode(ids).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            rest = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in rest], pa.array(text, pa.string())], names=[*rest, "text"])
    return run


def decoded(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text) of each row's pieces; null for null."""
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))
    return rows.mapInArrow(_decoder(shared), f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op10_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


def stage_segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what is left, as ids of pieces that decode to the texts: the query's columns, for the documents kept."""
    return sampled(docs, digests=True)


QUERIES = {"op10_segmentation": op10_segmentation}
ORACLES: dict[str, str] = {}
