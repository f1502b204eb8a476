"""Repeated passages across documents, by recompression (operator 9).

A word covered by a window of ``window`` consecutive words goes if the same window starts in a document with a smaller
id. Windows are never compared each with each, nor all shuffled; recompression finds where they can repeat.

Recompression: a level either names maximal runs of a symbol (by symbol and length), or names pairs: all names are
parted into left and right halves at random, and a left symbol merges with a right one after it. A symbol that spans the
level's number of words or more stays as it is. A name is a hash of what it stands for, so every task gives equal parts
equal names. What stands before a passage can change its symbols only at its edge, and the passage alone says where:
a window's first run and last run of a run level, and a first right or last left symbol of a pair level, may be merged
with something outside and are popped; what is left between them is the same wherever the window occurs.

Rounds: a Spark round brings symbols up to its last level, tables the names made (with the smallest and the largest
document that hold each), and joins those that two documents share back to the documents. A window with an unshared
symbol between its popped edges can't repeat and is closed; documents without an open window leave. The first round runs
nine levels at once (symbols of about 8 words), because names of fewer words are shared by nearly all documents and their
tables would close nothing; after the second (about 12) few windows of 50 words have a whole symbol inside.

Verification: an open window stands for the sequence of its popped symbols, level by level, and the high-level symbols
between them; equal windows have equal sequences, others differ (but for hash collisions, 64 bits). Consecutive windows
with the same anchor, the symbol of least hash between their edges, form a piece, and a piece is known by its windows.
Of equal pieces the smallest document's stays, so a passage in a third of all documents sends one row a piece and task
through partial aggregation. Only where an anchor has several different pieces, their windows are compared one by one.

Scale: what is shuffled are a row a high-level symbol, a row a piece, and twice the texts that may matter: those with open
windows, then those with repeats (a filter of bounded size lets the others pass by); rows grow in proportion to the words. No pair of documents is formed, no group is collected into one task.

Defined cases: null texts have no words; shorter documents than a window keep all; a null doc_id counts as larger than
any; rows that share a doc_id never remove each other's words; repeated rows are answered each; other columns are kept as
they are, but those named as a result column (in any case) give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorewell.llm import tokens as tk
from lorewell.llm.shared import cut, done, id_filter, in_filter, row_chunks, small_batches, text_chunks, trim

RUN = 0
#: The levels of each round: RUN, or the words from which a symbol takes no part in a pair.
ROUNDS = ((RUN, *[10] * 8), (20, 20))
PIECE = 64
U = np.uint64
_NO_ID = (1 << 63) - 1
RESULT = ["n_words", "n_removed", "kept_text"]


class Level:
    """One level over symbols (names and their numbers of words; 0 words: the end of a text, which never merges)."""

    def __init__(self, name: np.ndarray, size: np.ndarray, number: int, frozen: int):
        self.run = frozen == RUN
        if self.run:
            first = tk.first_of_runs(name) | (size == 0)
            first[1:] |= size[:-1] == 0
            self.left = self.right = None
        else:
            side = (tk.mix(name ^ U(0xABCD + number)) >> U(63)).astype(bool)
            free = (size > 0) & (size < frozen)
            self.left, self.right = free & ~side, free & side
            first = np.ones(len(name), bool)
            first[1:] = ~(self.left[:-1] & self.right[1:])
        self.at = np.flatnonzero(first)
        self.count = np.diff(np.append(self.at, len(name)))
        second = name[np.minimum(self.at + 1, len(name) - 1)] if not self.run else self.count.astype(U)
        self.name = np.where(self.count > 1, tk.pair(name[self.at], second, 17), name[self.at])
        self.size = np.add.reduceat(size, self.at) if len(size) else size
        self.first, self.was, self.was_size = first, name, size

    def inside(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last word at which a window may start, and the first at which it may end, to keep each symbol whole."""
        last = self.at + self.count - 1
        if self.run:
            real = self.size > 0
            return before[self.at - real], after[np.minimum(last + real, len(after) - 1)]
        return before[self.at - self.right[self.at]], after[np.minimum(last + self.left[last], len(after) - 1)]

    def pop(self, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols lo to hi (exclusive) without their edges, as numbers of the new symbols; what went is added to sums."""
        to = np.cumsum(self.first) - 1
        last = hi - 1
        if self.run:
            run_lo, run_hi = to[lo], to[last]
            end = self.at[run_lo] + self.count[run_lo]
            sums = tk.pair(sums, tk.pair(self.was[lo], (end - lo).astype(U), 1), 2)
            sums = tk.pair(sums, tk.pair(self.was[last], (hi - self.at[run_hi]).astype(U), 3), 4)
            return np.where(self.was_size[lo] > 0, run_lo + 1, run_lo), np.where(self.was_size[last] > 0, run_hi, run_hi + 1), sums
        gone_lo, gone_hi = self.right[lo], self.left[last]
        sums = tk.pair(sums, np.where(gone_lo, self.was[lo], U(1)), 5)
        sums = tk.pair(sums, np.where(gone_hi, self.was[last], U(1)), 6)
        return to[lo + gone_lo], to[last - gone_hi] + 1, sums


def _framed(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and sizes at level 0, with an end before each text and after the last. Word p of text d is symbol p + d + 1."""
    place = np.arange(len(h)) + tk.owners(bounds) + 1
    name, size = np.zeros(len(h) + len(bounds), U), np.zeros(len(h) + len(bounds), np.int32)
    name[place], size[place] = h, 1
    return name, size


def _edges(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each symbol and the word after it; an end of a text lies out of reach on both sides."""
    end = np.cumsum(size, dtype=np.int64)
    return np.where(size > 0, end - size, end - 1), np.where(size > 0, end, end + 1)


def first_levels(name: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names, sizes, and between which words a window must start and end (see ``Level.inside``), after the first round."""
    before, after = _edges(size)
    for i, frozen in enumerate(ROUNDS[0]):
        x = Level(name, size, i, frozen)
        before, after = x.inside(before, after)
        name, size = x.name, x.size
    return name, size, before, after


def signatures(h: np.ndarray, bounds: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that start at words ``at``: signature, anchor's name and anchor's place (-1: no symbol inside)."""
    name, size = _framed(h, bounds)
    lo, sums = at + doc + 1, np.zeros(len(at), U)
    hi = lo + window
    for i, frozen in enumerate(ROUNDS[0]):
        x = Level(name, size, i, frozen)
        lo, hi, sums = x.pop(lo, hi, sums)
        name, size = x.name, x.size
    start = np.cumsum(size, dtype=np.int64) - size
    whole = (lo < hi) & (start[np.minimum(lo, len(start) - 1)] >= at)
    lo, hi = np.where(whole, lo, 0), np.where(whole, hi, 1)
    sums = np.where(whole, tk.pair(sums, _hash_of(name, lo, hi), 7), tk.mix(_hash_of(h, at, at + window)))
    order = tk.mix(name)
    least, power, width = order.copy(), 1, hi - lo
    best = np.zeros(len(at), U)
    while len(at):  # the least of a range, by two overlapping ranges of a power of two
        own = np.flatnonzero((width >= power) & (width < 2 * power))
        best[own] = np.minimum(least[lo[own]], least[hi[own] - power])
        if not (width >= 2 * power).any():
            break
        least[:-power] = np.minimum(least[:-power], least[power:])
        power *= 2
    # the first place of the least: neighbours that share it form a piece
    place = lo.copy()
    late = np.flatnonzero(order[place] != best) if len(at) else place
    while len(late):
        place[late] += 1
        late = late[order[place[late]] != best[late]]
    return sums, np.where(whole, best | U(1), U(0)), np.where(whole, place, -1)


def _hash_of(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each range of values."""
    up, down = tk._pow(len(values) + 1)
    sums = np.concatenate([[U(0)], np.cumsum(values * up[: len(values)], dtype=U)])
    return tk.mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    if kind == pa.int64() and values.dtype == U:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column side by side and their numbers; null is empty."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    return (values.to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, np.int64)), counts


def _intervals(mark: np.ndarray, owner: np.ndarray, start: np.ndarray, rows: int) -> pa.Array:
    """Where mark is set: lo, hi, lo, hi ... of each row, from the row's start."""
    edge = np.zeros(len(mark) + 1, bool)
    edge[1:-1] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
    edge[[0, -1]] = True
    cut_at = np.flatnonzero(edge)
    lo, hi = cut_at[:-1], cut_at[1:]
    keep = mark[lo] if len(mark) else np.zeros(len(lo), bool)
    lo, hi = lo[keep], hi[keep]
    who = owner[lo]
    flat = np.stack([lo - start[who], hi - start[who]], 1).reshape(-1)
    return _lists(flat, 2 * np.bincount(who, minlength=rows)[:rows], pa.int32())


_STATE = "rk long, id long, n int, name array<long>, shape binary, open array<int>, ask array<long>"


def _shaped(counts: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """Size, lead and tail of each text's symbols, one after the other, in bytes where they fit, else in four bytes each."""
    cuts = np.concatenate([[0], np.cumsum(counts)])
    over = np.concatenate([[0], np.cumsum(np.max(columns, axis=0) > 255)])
    wide = over[cuts[1:]] > over[cuts[:-1]]
    rows = np.stack(columns)
    return pa.array([rows[:, a:b].astype(np.int32 if w else np.uint8).tobytes() for a, b, w in zip(cuts[:-1], cuts[1:], wide)], pa.binary())


def _unshaped(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer(), np.int32 if len(x.as_buffer()) > 3 * n else np.uint8).reshape(3, n) for x, n in zip(column, counts.tolist())]
    return np.concatenate([np.zeros((3, 0), np.uint8), *rows], 1).astype(np.int64)


def _state(rk: pa.Array, ids: pa.Array, n: np.ndarray, name, size, before, after, opened: np.ndarray, fresh: np.ndarray, window: int) -> pa.RecordBatch:
    """The state of texts of n words. opened: whether a window at each word is; fresh: names that are new."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    ends = np.flatnonzero(size == 0)
    body = size > 0
    counts = np.diff(ends) - 1
    doc = np.repeat(np.arange(len(n)), counts)
    name, size, before, after, fresh = name[body], size[body], before[body], after[body], fresh[body]
    end = np.cumsum(size, dtype=np.int64)
    count = np.concatenate([[0], np.cumsum(opened)])
    lo, hi = np.maximum(after - window, bounds[doc]), np.minimum(before + 1, bounds[doc + 1])
    asked = fresh & (lo < hi) & (count[np.minimum(np.maximum(hi, lo), len(opened))] > count[np.minimum(lo, len(opened))])
    x, who = name[asked], doc[asked]
    order = np.lexsort((x, who))
    x, who = x[order], who[order]
    new = tk.first_of_runs(x) | tk.first_of_runs(who)
    x, who = x[new], who[new]
    lead, tail = np.minimum(end - size - before, window), np.minimum(after - end, window)
    spans = _intervals(opened, tk.owners(bounds), bounds[:-1], len(n))
    arrays = [rk, ids, pa.array(n, pa.int32()), _lists(name, counts, pa.int64()), _shaped(counts, size, lead, tail), spans, _lists(x, np.bincount(who, minlength=len(n)), pa.int64())]
    batch = pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _STATE.split(", ")])
    return batch.filter(pa.array(np.diff(count[bounds]) > 0))


def _first_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch):
                h, bounds = tk.words(data, offsets, fold=False)
                n = np.diff(bounds)
                long = n >= window
                if not long.any():
                    continue
                h = h[long[tk.owners(bounds)]]
                n = n[long]
                bounds = np.concatenate([[0], np.cumsum(n)])
                name, size, before, after = first_levels(*_framed(h, bounds))
                opened = np.arange(len(h)) <= np.repeat(bounds[1:] - window, n)
                rk, ids = (batch.column(c).slice(first, end - first).filter(pa.array(long)) for c in (0, 1))
                yield _state(rk, ids, n, name, size, before, after, opened, np.ones(len(name), bool), window)

    return run


def _parts(batch: pa.RecordBatch, words: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """A batch of states in parts of so many words, as arrays that have an element a word are many times its size."""
    n = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
    for lo, hi in row_chunks(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), words):
        yield batch.slice(lo, hi - lo)


def _next_task(window: int, number: int):
    """Closes windows with an unshared symbol and goes on to the levels of round ``number``, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            n = col["n"].to_numpy(zero_copy_only=False).astype(np.int64)
            name, counts = _flat(col["name"])
            size, lead, tail = _unshaped(col["shape"], counts)
            name = name.astype(np.int64).view(U)
            doc, bounds = np.repeat(np.arange(len(n)), counts), np.concatenate([[0], np.cumsum(n)])
            salt = tk.mix(np.arange(len(n), dtype=U))
            own = [tk.pair(v.astype(np.int64).view(U), np.repeat(salt, k)) for v, k in (_flat(col["ask"]), _flat(col["known"]))]
            here = tk.pair(name, salt[doc])
            dead = np.isin(here, own[0]) & ~np.isin(here, own[1])
            end = np.cumsum(size, dtype=np.int64)
            before, after = end - size - lead, end + tail
            spans, k = _flat(col["open"])
            spans = spans.reshape(-1, 2) + np.repeat(bounds[:-1], k // 2)[:, None]
            change = np.zeros(bounds[-1] + 1, np.int32)
            np.add.at(change, spans[:, 0], 1)
            np.add.at(change, spans[:, 1], -1)
            opened = np.cumsum(change[:-1]) > 0
            lo, hi = np.maximum(after - window, bounds[doc]), np.minimum(before + 1, bounds[doc + 1])
            hit = np.flatnonzero(dead & (lo < hi))
            change[:] = 0
            np.add.at(change, lo[hit], 1)
            np.add.at(change, hi[hit], -1)
            opened &= np.cumsum(change[:-1]) == 0
            place = np.arange(len(name)) + doc + 1  # ends of texts between them again
            total = len(name) + len(n) + 1
            framed = [np.zeros(total, x.dtype) for x in (name, size, before, after)]
            for whole, x in zip(framed, (name, size, before, after)):
                whole[place] = x
            stops = np.concatenate([[0], np.cumsum(counts)]) + np.arange(len(n) + 1)
            framed[2][stops], framed[3][stops] = bounds - 1, bounds + 1
            name, size, before, after = framed
            fresh = np.zeros(len(name), bool)
            for i, frozen in enumerate(ROUNDS[number] if number < len(ROUNDS) else ()):
                x = Level(name, size, 100 * number + i, frozen)
                before, after = x.inside(before, after)
                fresh = np.maximum.reduceat(fresh, x.at) | (x.count > 1)
                name, size = x.name, x.size
            yield _state(col["rk"], col["id"], n, name, size, before, after, opened, fresh, window)
            trim()

    return run


_PIECES = "rk long, id long, key long, anchor long, lo int, windows array<long>"


def _piece_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            column = batch.column(batch.schema.get_field_index("open"))
            for first, end, data, offsets in text_chunks(batch):
                h, bounds = tk.words(data, offsets, fold=False)
                spans, k = _flat(column.slice(first, end - first))
                owner = np.repeat(np.arange(end - first), k // 2)
                spans = spans.reshape(-1, 2).astype(np.int64)
                n = spans[:, 1] - spans[:, 0]
                at = np.arange(n.sum()) + np.repeat(spans[:, 0] + bounds[owner] - (np.cumsum(n) - n), n)
                doc = np.repeat(owner, n)
                if not len(at):
                    continue
                w, anchor, place = signatures(h, bounds, at, doc, window)
                new = tk.first_of_runs(place) | tk.first_of_runs(doc)
                new[1:] |= np.diff(at) > 1
                run_at = np.flatnonzero(new)
                new |= (np.arange(len(at)) - np.repeat(run_at, np.diff(np.append(run_at, len(at))))) % PIECE == 0
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(at))
                key = tk.pair(_hash_of(w, lo, hi), anchor[lo], 8)
                who = first + doc[lo]
                arrays = [pa.array(rk[who]), pa.array(ids[who]), pa.array(key.view(np.int64)), pa.array(anchor[lo].view(np.int64)), pa.array(at[lo] - bounds[doc[lo]], pa.int32()), _lists(w, hi - lo, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _named(filter_):
    """Rows whose rk the filter names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(filter_.value, batch.column(0).to_numpy())))

    return run


def _cut_task(window: int, but=None):
    """Cuts what is covered; with a filter only of rows that it doesn't name, by their rk, in the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if but is not None:
                batch = batch.filter(pa.array(~in_filter(but.value, batch.column(3).to_numpy())))
            texts, gone_at = batch.column(0).to_pylist(), batch.column(1)
            kept, n_words, n_removed = [], [], []
            for i, text in enumerate(texts):
                words = (text or "").encode().split()
                n, gone = len(words), 0
                if gone_at[i].is_valid:
                    mark = np.zeros(n + 1, np.int32)
                    for x in gone_at[i].as_py():
                        mark[x["lo"]] += 1
                        mark[x["lo"] + x["n"] - 1 + window] -= 1
                    covered = np.cumsum(mark[:-1]) > 0
                    gone = int(covered.sum())
                    words = [words[j] for j in np.flatnonzero(~covered)]
                kept.append(b" ".join(words).decode())
                n_words.append(n)
                n_removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["own", *RESULT])
            trim()

    return run


def remove_repeats(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """All columns but text, n_words, n_removed, and kept_text: the kept words joined by one space."""
    spark = docs.sparkSession
    small_batches(spark)
    own = [c for c in docs.columns if c != "text" and c.lower() not in RESULT]
    text, order = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = docs.select(F.xxhash64(order, text).alias("rk"), order.alias("id"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"))

    state = cut(rows.select("rk", "id", "text").mapInArrow(_first_task(window), _STATE))
    for number in range(1, len(ROUNDS) + 1):
        named = state.select("rk", "id", F.explode("ask").alias("name"))
        shared = named.groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("name")
        known = named.select("rk", "name").join(shared, "name").groupBy("rk").agg(F.collect_set("name").alias("known"))
        after = cut(state.join(known, "rk", "left").mapInArrow(_next_task(window, number), _STATE))
        done(state)
        state = after

    spans = state.select("rk", "id", "open").dropDuplicates(["rk", "id"])
    own_text = rows.select("rk", "id", "text")
    texts = own_text.mapInArrow(_named(spark.sparkContext.broadcast(id_filter(spans))), own_text.schema).join(spans, ["rk", "id"]).dropDuplicates(["rk", "id"])
    pieces = cut(texts.mapInArrow(_piece_task(window), _PIECES))
    done(state)
    least = pieces.groupBy("key").agg(F.min("id").alias("a"), F.min("anchor").alias("anchor"))
    mixed = least.where("anchor <> 0").groupBy("anchor").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("anchor", F.lit(True).alias("mixed"))
    least = least.join(mixed, "anchor", "left").select("key", "a", (F.col("mixed").isNotNull() | (F.col("anchor") == 0)).alias("mixed"))
    met = pieces.drop("anchor").join(least, "key").where("id > a or mixed")
    met = cut(met.select("rk", "id", "lo", F.size("windows").alias("n"), F.when(F.col("id") == F.col("a"), F.col("windows")).alias("windows")))
    done(pieces)
    copies = met.where("windows is null").select("rk", "id", "lo", "n")
    single = met.where("windows is not null").select("rk", "id", "lo", F.posexplode("windows").alias("i", "w"))
    first = single.groupBy("w").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("w", "a")
    again = single.join(first, "w").where("id > a").select("rk", "id", (F.col("lo") + F.col("i")).alias("lo"), F.lit(1).alias("n"))
    places = cut(copies.unionByName(again).groupBy("rk", "id").agg(F.collect_list(F.struct("lo", "n")).alias("places")))
    done(met)
    named = spark.sparkContext.broadcast(id_filter(places))
    joined = rows.mapInArrow(_named(named), rows.schema).join(places, ["rk", "id"], "left").select("text", "places", "own")
    others = rows.select("text", F.lit(None).cast(places.schema["places"].dataType).alias("places"), "own", "rk")
    schema = StructType([StructField("own", joined.schema["own"].dataType), *(StructField(c, LongType()) for c in RESULT[:2]), StructField(RESULT[2], StringType())])
    # one Python step a stage: a second would leave every executor twice the workers for all that follows
    return joined.mapInArrow(_cut_task(window), schema).unionByName(others.mapInArrow(_cut_task(window, named), schema)).select("own.*", *RESULT)
