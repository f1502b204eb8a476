"""Distinct sampled SentencePiece segmentations, and decoding (operator 5).

A text's lattice has its byte positions as nodes and pieces as edges; a character without a piece of its own has byte
pieces. A segmentation's probability is in proportion to the product of its pieces' weights to the power ``alpha``;
weights fall with the piece's rank in the vocabulary (rank + 50) ** -1, as a BPE model has merge ranks and no
probabilities; byte pieces rank last.

Gumbel top-k without replacement by A-star search: the backward sums of the lattice give each edge's probability, so a
subtree of segmentations (those that begin with a given prefix and leave it by other edges) has a known mass, and the
largest perturbed log-probability in it is a Gumbel variable, truncated at its parent's. The queue is ordered by that
bound, which is exact; the popped subtree yields one segmentation (its largest) and new subtrees along it. The first k
are the sample, in order; the next bound is the threshold kappa that gives each its inclusion score
``1 - exp(-exp(log_prob - kappa))``. All randomness comes from the row's key, sample, place and step, by hashing.

The lattice falls apart where no piece crosses; a task solves each distinct part once and keeps the solution until those
kept exceed ``KEPT`` nodes, and all steps of all texts of a chunk are drawn together in numpy. A part's solution depends
on its bytes alone, so neither chunks nor what is kept change a result. Rows are independent: one pass, no shuffle, and
memory for the kept parts and one chunk of about 0.25 MB of text, or one text; parts are solved ``NEW`` bytes at a time.

Defined cases: null and empty texts have one segmentation, the empty one; a text with fewer than k segmentations gives
all of them, with score 1 each; a literal piece-space character is encoded by its bytes, so decoding is exact; rows
are seeded by their doc_id and text, so repeated rows get the same samples; a null id is a key like any; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm import tokens as tk
from lorewell.llm.shared import reuse_freed, row_chunks, small_batches, text_chunks, trim

#: The vocabulary file, unless the session names another under this setting.
MODEL, SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.lorewell.pieces"
SAMPLES, ALPHA = 2, 0.3
KEPT, NEW, HEAD = 1 << 19, 1 << 16, 256
U = np.uint64
_SPACE = "▁"
_MOST = 40.0  # -log of the least noise, 2**-53, and some more


class Table:
    """Sorted distinct hashes and their values. A hash's high bits name where its few candidates begin."""

    def __init__(self, h: np.ndarray, values: np.ndarray):
        order = np.argsort(h)
        bits = max(1, int(4 * len(h)).bit_length())
        self.shift = U(64 - bits)
        self.start = np.searchsorted(h[order] >> self.shift, np.arange(1 << bits, dtype=U)).astype(np.int32)
        self.keys, self.values = np.append(h[order], ~U(0)), np.append(values[order], 0)  # with an end that no search passes

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is here, and the place of its value."""
        at = self.start[h >> self.shift]
        more = np.flatnonzero(self.keys[at] < h)
        while len(more):
            at[more] += 1
            more = more[self.keys[at[more]] < h[more]]
        return self.keys[at] == h, at


class Vocabulary:
    """Pieces as bytes, a space for the piece-space character."""

    def __init__(self, pieces: list[bytes | None], bytes_: list[int]):
        self.flat = np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8)
        self.size = np.array([len(p or b"") for p in pieces])
        self.start = np.cumsum(self.size) - self.size
        self.byte_ids = np.array(bytes_, np.int64)
        ids = [i for i, p in enumerate(pieces) if p and i not in set(bytes_)]
        rank = np.full(len(pieces), float(len(pieces)))
        rank[ids] = ids
        weight = 1 / (rank + 50)
        self.log_weight = np.log(weight / (weight[ids].sum() + weight[bytes_].sum()))
        by: dict[int, list[int]] = {}
        for i in ids:
            by.setdefault(len(pieces[i]), []).append(i)
        self.longest = max(by)
        # of each string that is a piece or begins one: twice the piece's id and 2, and 1 if longer pieces begin so
        self.short, self.by_length = [np.zeros(1 << 8, np.int32), np.zeros(1 << 16, np.int32)], {}
        for n in range(1, self.longest + 1):
            values = dict.fromkeys((pieces[i][:n] for i in ids if len(pieces[i]) > n), 1)
            for i in by.get(n, []):
                values[pieces[i]] = values.get(pieces[i], 0) % 2 + 2 * i + 2
            if n <= len(self.short):
                for x, value in values.items():
                    self.short[n - 1][int.from_bytes(x)] = value
            else:
                self.by_length[n] = self._table(list(values), np.array(list(values.values()), np.int32))

    @staticmethod
    def _table(strings: list[bytes], values: np.ndarray) -> Table:
        data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
        return Table(tk.hashes(data, ends[:-1], ends[1:], fold=False), values)

    def find(self, data: np.ndarray, hashed, live: np.ndarray, length: int) -> np.ndarray:
        """What is known of the strings of this length that begin at these bytes, or 0."""
        if length == 1:
            return self.short[0][data[live]]
        if length == 2:
            return self.short[1][data[live].astype(np.uint16) << np.uint16(8) | data[live + 1]]
        found, at = self.by_length[length].find(hashed(live, live + length))
        return np.where(found, self.by_length[length].values[at], 0)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [None if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) else m.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(n)]
        bytes_ = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(bytes_):
            pieces[i] = bytes([b])
        return cls(pieces, bytes_)

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of the texts with these piece ids."""
        ids = np.concatenate([np.zeros(0, np.int64), *rows])
        size = self.size[ids]
        end = np.cumsum(size)
        data = self.flat[np.repeat(self.start[ids] - end + size, size) + np.arange(size.sum())].tobytes()
        cuts = np.concatenate([[0], end])[np.cumsum([0, *map(len, rows)])].tolist()
        return [data[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:])]


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


class Lattice:
    """The lattices of some strings, laid out one after the other; node i is byte i, with one node more a string."""

    def __init__(self, v: Vocabulary, data: np.ndarray, offsets: np.ndarray, alpha: float):
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n = len(data)
        end = offsets[1:][owner]
        src, size, ids = [], [], []
        live, hashed = np.arange(n), tk.rolling(data)
        for length in range(1, v.longest + 1):
            live = live[live + length <= end[live]]
            if not len(live):
                break
            value = v.find(data, hashed, live, length)
            hit = np.flatnonzero(value > 1)
            src.append(live[hit])
            size.append(np.full(len(hit), length))
            ids.append((value[hit] >> 1).astype(np.int64) - 1)
            live = live[value & 1 == 1]
        # byte pieces for characters without a piece
        head = (data & 0xC0) != 0x80
        starts = np.flatnonzero(head)
        chars = np.diff(np.append(starts, n))
        whole = np.zeros(n, bool)
        char_size = np.zeros(n, np.int64)
        char_size[starts] = chars
        for s, z in zip(src[:4], size[:4]):
            whole[s[char_size[s] == z]] = True
        bare = np.flatnonzero(~np.repeat(whole[starts], chars)) if len(starts) else np.arange(n)
        src.append(bare)
        size.append(np.ones(len(bare), np.int64))
        ids.append(v.byte_ids[data[bare]])
        src, size, ids = (np.concatenate(x[::-1]) for x in (src, size, ids))
        order = np.argsort(src, kind="stable")  # of a node's edges the longest, mostly the likeliest, first
        src, size, ids = src[order], size[order], ids[order]
        node, left = src + owner[src], end[src] - src
        by = np.argsort(left.astype(np.int16) if left.max(initial=0) < 1 << 15 else left, kind="stable")
        self.nodes = n + len(sizes)
        self.root, self.stop = offsets[:-1] + np.arange(len(sizes)), offsets[1:] + np.arange(len(sizes))
        weight = alpha * v.log_weight[ids]
        beta = np.zeros(self.nodes)
        dst = node + size
        at, to, weight = node[by], dst[by], weight[by]
        first = np.flatnonzero(tk.first_of_runs(at))
        count = np.diff(np.append(first, len(at)))
        level = np.flatnonzero(tk.first_of_runs(left[by[first]]))  # nodes as far from their ends
        lp = np.empty(len(node))
        for x, y in zip(level, np.append(level[1:], len(first))):
            a, b = first[x], first[y - 1] + count[y - 1]
            value, own, many = weight[a:b] + beta[to[a:b]], first[x:y] - a, count[x:y]
            top = np.maximum.reduceat(value, own)
            total = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, many)), own))
            beta[at[first[x:y]]] = total
            lp[by[a:b]] = value - np.repeat(total, many)
        self.src, self.ids, self.lp, self.dst = node, ids, lp, dst
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=self.nodes))])
        self.upto = np.exp(self.lp)  # summed edge by edge, so that it doesn't depend on what lies before
        many, count = self.bounds[:-1], np.diff(self.bounds)
        for i in range(1, int(count.max(initial=0))):
            many = many[count > i]
            count = count[count > i]
            self.upto[many + i] += self.upto[many + i - 1]
        self.upto[self.bounds[1:][np.diff(self.bounds) > 0] - 1] = np.inf


class Lattices:
    """The lattices of the parts met so far, laid out one after the other, by the parts' hashes."""

    def __init__(self, v: Vocabulary, alpha: float):
        self.vocabulary, self.alpha, self.room = v, alpha, {}
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, U)
        self.root, self.stop, self.bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.src, self.dst, self.ids = (np.zeros(0, np.int32) for _ in range(3))
        self.lp, self.upto = np.zeros(0), np.zeros(0)
        self.room = {k: x for k, x in self.room.items() if len(x) <= 4 * KEPT}

    def place(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last nodes of the parts with these distinct hashes; parts not yet known are added."""
        if len(self.bounds) > KEPT:
            self._clear()
            trim()
        new = np.flatnonzero(~_find(self.known, keys)[0])
        if len(new):
            for a, b in row_chunks(np.concatenate([[0], np.cumsum((ends - starts)[new])]), NEW):
                some = new[a:b]
                lens = (ends - starts)[some]
                at = np.concatenate([[0], np.cumsum(lens)])
                self._add(keys[some], Lattice(self.vocabulary, data[np.arange(at[-1]) - np.repeat(at[:-1] - starts[some], lens)], at, self.alpha))
        at = _find(self.known, keys)[1]
        return self.root[at], self.stop[at]

    def _add(self, keys: np.ndarray, more: Lattice) -> None:
        node, edge = len(self.bounds) - 1, len(self.src)
        join = lambda x, y: np.concatenate([x, y.astype(x.dtype)])
        known = join(self.known, keys)
        order = np.argsort(known)
        self.known, self.root, self.stop = known[order], join(self.root, more.root + node)[order], join(self.stop, more.stop + node)[order]
        self._append("bounds", more.bounds[1:] + edge)
        self._append("src", more.src + node)
        self._append("dst", more.dst + node)
        for name in ("ids", "lp", "upto"):
            self._append(name, getattr(more, name))

    def _append(self, name: str, more: np.ndarray) -> None:
        """To an array with room behind it, of which the system has given nothing until it is written."""
        old = getattr(self, name)
        size = len(old) + len(more)
        if size > len(self.room.get(name, ())):
            self.room[name] = np.empty(max(4 * KEPT, size + (size >> 1)), old.dtype)
            self.room[name][: len(old)] = old
        self.room[name][len(old) : size] = more
        setattr(self, name, self.room[name][:size])

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each node, by its probability."""
        e = self.bounds[node]
        more = np.flatnonzero(self.upto[e] < u)
        while len(more):
            e[more] += 1
            more = more[self.upto[e[more]] < u[more]]
        return e


def _placed(key: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    return key + np.asarray(place).astype(U) * U(0x9FB21C651E98DF25)


def _uniform(placed: np.ndarray, step: int) -> np.ndarray:
    x = tk.mix(placed + U(step * 0xD1B54A32D192ED03 % (1 << 64)))
    return ((x >> U(12)).astype(float) + 0.5) / (1 << 52)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the parts of texts that each begin with a space: at texts, at spaces after another byte, and around newlines. Texts' bounds in parts."""
    start = np.zeros(len(data) + 1, bool)
    start[offsets[:-1]] = True
    start[1:-1] |= (data[1:] == 32) & (data[:-1] != 32)
    line = np.flatnonzero(data == 10)
    start[line] = True
    start[line + 1] = True
    at = np.flatnonzero(start[:-1])
    return at, np.searchsorted(at, offsets)


def _paths(lat: Lattices, node: np.ndarray, stop: np.ndarray, key: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the given nodes to the ends of their parts, part by part, and the parts' bounds."""
    live, edges, found = np.flatnonzero(node != stop), [], []
    at, stop, placed = node[live], stop[live], _placed(key[live], place[live])
    while len(live):
        e = lat.draw(at, _uniform(placed, step))
        edges.append(e)
        found.append(live)
        at = lat.dst[e]
        more = at != stop
        at, stop, placed, live = at[more], stop[more], placed[more], live[more]
        step += 1
    count = np.bincount(np.concatenate(found), minlength=len(node)) if found else np.zeros(len(node), np.int64)
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(bounds[-1], np.int64)
    for i, (who, e) in enumerate(zip(found, edges)):
        out[bounds[who] + i] = e
    return out, bounds


def sample_chunk(lat: Lattices, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int):
    """For each text up to k of (piece ids, log-probability, perturbed, inclusion score), best first."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    grown = offsets + np.minimum(np.arange(n + 1), np.concatenate([[0], np.cumsum(sizes > 0)]))
    own = np.full(grown[-1], 32, np.uint8)  # a space before each text that isn't empty
    own[np.arange(len(data)) + np.repeat((grown - offsets)[:-1] + 1, sizes)] = data
    part, of = _cuts(own, grown)
    ends = np.append(part[1:], len(own))
    h = tk.hashes(own, part, ends, fold=False)
    distinct, one, kind = np.unique(h, return_index=True, return_inverse=True)
    texts = tk.owners(of)
    root, stop = (x[kind] for x in lat.place(distinct, own, part[one], ends[one]))
    edges, bounds = _paths(lat, root, stop, tk.pair(keys, keys, 0)[texts], np.arange(len(part)) - of[texts], 1)
    where = np.repeat(np.arange(len(part)), np.diff(bounds))
    first = [(edges[bounds[a] : bounds[b]], where[bounds[a] : bounds[b]]) for a, b in zip(of[:-1], of[1:])]
    tops = -np.log(-np.log(_uniform(_placed(keys, 0), 1 << 21)))
    results: list[list] = [[] for _ in range(n)]
    queues: list[list] = [[] for _ in range(n)]

    def weighed(e: np.ndarray, key: np.ndarray, step: np.ndarray, number: int) -> tuple:
        """Of edges at these steps: log-probabilities, those of the other edges there, their number with the edge, and noise."""
        own = lat.lp[e]
        rest = np.log1p(-np.minimum(np.exp(own), 1.0), out=np.full(len(e), -np.inf), where=own < -1e-12)
        src = lat.src[e]
        kinds = lat.bounds[src + 1] - lat.bounds[src]
        rest[kinds == 1] = -np.inf
        return own, rest, kinds, -np.log(_uniform(_placed(key, step), 1 << 20 | number))

    def heads(who: list[int], paths: list, begins: list[int], number: int) -> list[tuple]:
        """``weighed`` of the first steps of all these paths at once."""
        some = [e[b : b + HEAD] for (e, _), b in zip(paths, begins)]
        sizes = np.array([len(e) for e in some])
        cuts = np.cumsum(sizes)
        step = np.arange(cuts[-1]) + np.repeat(begins + sizes - cuts, sizes)
        found = weighed(np.concatenate(some), np.repeat(keys[who], sizes), step, number)
        return [tuple(x[b - a : b] for x in found) for a, b in zip(sizes.tolist(), cuts.tolist())]

    def extend(i: int, path, number: int, top: float, begin: int, taken: tuple, head: tuple) -> None:
        """Emit a path, whose subtrees from step ``begin`` on are new; ``taken``: edges used up at that step; ``head``: its first steps weighed."""
        e, _ = path
        lp = lat.lp[e]
        total = np.cumsum(lp)
        results[i].append((path, float(total[-1]) if len(e) else 0.0, top))
        if begin >= len(e):
            return
        least, lo = -np.inf, begin
        while lo < len(e):
            hi = min(len(e), lo + HEAD)
            before = total[lo:hi] - lp[lo:hi]
            if before[0] + _MOST < least:  # masses only fall from here, and no noise lifts them that far
                break
            own, rest, kinds, noise = head if lo == begin else weighed(e[lo:hi], keys[i : i + 1], np.arange(lo, hi), number)
            if taken and lo == begin:
                gone = np.exp(lat.lp[list(taken)]).sum() + np.exp(own[0])
                rest[0] = -np.inf if kinds[0] <= len(taken) + 1 else np.log(max(1 - gone, 1e-300))
            mass = before + rest
            bound = mass - np.log(np.exp(np.minimum(mass - top, 700)) + noise)
            few = np.argpartition(-bound, k)[: k + 1] if len(bound) > k + 1 else np.arange(len(bound))
            for j in few.tolist():
                if mass[j] > -np.inf:
                    heapq.heappush(queues[i], (-bound[j], number, lo + j, (*(taken if lo + j == begin else ()), int(e[lo + j]))))
            if len(few) > k:
                least = max(least, bound[few].min())
            lo = hi

    for i, head in enumerate(heads(range(n), first, [0] * n, 0) if n else ()):
        extend(i, first[i], 0, float(tops[i]), 0, (), head)
    for number in range(1, k):
        todo, nodes, stops, parts, owner = [], [], [], [], []
        popped = [(i, *heapq.heappop(queues[i])) for i in range(n) if queues[i]]
        if not popped:
            break
        us = _uniform(_placed(keys[[x[0] for x in popped]], [x[3] for x in popped]), 1 << 22 | number)
        for (i, bound, come, step, taken), u in zip(popped, us.tolist()):
            (e, w), _, _ = results[i][come]
            src = lat.src[e[step]]
            some = np.array([x for x in range(lat.bounds[src], lat.bounds[src + 1]) if x not in taken])
            p = np.cumsum(np.exp(lat.lp[some] - lat.lp[some].max()))
            edge = int(some[min(np.searchsorted(p, u * p[-1]), len(some) - 1)])
            todo.append((i, come, step, taken, edge, -bound))
            here = int(w[step])
            later = np.arange(here + 1, of[i + 1])
            nodes.append(np.concatenate([[lat.dst[edge]], root[later]]))
            parts.append(np.concatenate([[here], later]))
            stops.append(np.concatenate([[stop[here]], stop[later]]))
            owner.append(np.full(len(later) + 1, i))
        parts, owner = np.concatenate(parts), np.concatenate(owner)
        salted = tk.pair(keys, keys, number)[owner]
        edges, bounds = _paths(lat, np.concatenate(nodes), np.concatenate(stops), salted, parts - of[owner], 1)
        where = parts[np.repeat(np.arange(len(parts)), np.diff(bounds))]
        begin = np.searchsorted(owner, [x[0] for x in todo])
        after = np.append(begin[1:], len(owner))
        paths = []
        for (i, come, step, _, edge, _), a, b in zip(todo, begin, after):
            e, w = results[i][come][0]
            paths.append((np.concatenate([e[:step], [edge], edges[bounds[a] : bounds[b]]]), np.concatenate([w[: step + 1], where[bounds[a] : bounds[b]]])))
        # a text that is still in the queue has given one path a round
        for (i, _, step, taken, _, top), path, head in zip(todo, paths, heads([x[0] for x in todo], paths, [x[2] for x in todo], number)):
            extend(i, path, number, top, step, taken, head)
    out = []
    for i in range(n):
        kappa = -queues[i][0][0] if queues[i] else -np.inf
        score = lambda lp, kappa=kappa: 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(lp - kappa, 700))))
        out.append([(lat.ids[e], lp, top, score(lp)) for (e, _), lp, top in results[i]])
    return out


_OUT = "doc_id long, sample int, n_pieces long, pieces binary, log_prob double, perturbed double, inclusion double, decoded string, exact boolean"


def sample_segmentations(docs: DataFrame, *, model: str | None = None, k: int = SAMPLES, alpha: float = ALPHA) -> DataFrame:
    """Up to k rows a document, by sample from 1: ``pieces`` are the ids as little-endian int32; ``exact``: they decode to the text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(model or spark.conf.get(SETTING, MODEL)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed()
        v = shared.value
        lat = Lattices(v, alpha)
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.float64()] * 3, pa.string(), pa.bool_()]
        for batch in batches:
            keys = batch.column(2).to_numpy().view(U)
            for lo, hi, data, offsets in text_chunks(batch, limit=1 << 18, trimmed=False):
                rows = []
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                raw = data.tobytes()
                chunk = sample_chunk(lat, data, offsets, keys[lo:hi], k)
                decoded = iter(v.decode([x[0] for found in chunk for x in found]))
                for i, found in enumerate(chunk):
                    text = raw[offsets[i] : offsets[i + 1]]
                    for s, (pieces, lp, top, inclusion) in enumerate(found, 1):
                        own = next(decoded)
                        back = own.decode("utf-8", "replace")
                        rows.append((ids[i], s, len(pieces), pieces.astype("<i4").tobytes(), lp, top, inclusion, back, back.encode() == text if own != text else True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        del lat
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    return rows.mapInArrow(run, _OUT)
