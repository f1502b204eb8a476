"""Language-model scoring with a log-frequency Bloom filter (operator 1).

A bigram model with Witten-Bell smoothing. Counts are quantised to levels, level q covering counts of about
``BASE**(q-1)`` to ``BASE**q``; an n-gram of level q enters the filter as (n-gram, 1) ... (n-gram, q). A probe asks
for (n-gram, 1), (n-gram, 2), ... until the first miss; the last hit is the level, so errors only raise counts and
fall off geometrically. Word and bigram hashes have 64 bits.

Scale. Tasks count bigrams by some million tokens and send them as sorted blobs to hash shards (a row for each shard
that a chunk has bigrams of, so never more rows than bigrams). Shards are dealt by the hash of the whole bigram, so a hot
word is spread over all of them, and their number grows with the training text: ``SHARD_BYTES`` of it for each, so none
grows. What shards know of words (counts, and the kinds of words that follow) is summed by a plain aggregation, and the
words' part of the filter built in shards of its own. The filter is broadcast if it has at most ``broadcast_bytes``. A
larger one stays where it is: each chunk of texts sends its distinct probes to their shards, sorted and packed (a blob for
each shard that it asks), where they meet the shard's bits, and the levels come back to the chunk's texts, which travel
compressed; the corpus is read once and the probes grow in proportion to it. Probes are dealt once and only levels are
written (3.95 x the input of disk, measured at 0.51 GB).
Exact unigram counts (for ``base_score``) come from a head table, the most frequent words, at most ``HEAD``; of all other
words a document sends a row each to a join.

Defined cases: null and empty texts have the end token only; repeated rows are scored each; a null doc_id is never
held out; other columns are ignored; without training documents all counts are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lorewell.llm import tokens as tk
from lorewell.llm.shared import cut, done, small_batches, text_chunks, trim

U = np.uint64
BASE = 1.5
BITS_PER_ENTRY, PROBES, LINE = 12, 4, 8  # LINE words of 64 bits
HEAD, LEAST_HEAD = 1 << 20, 1 << 12  # words in the head table at most; counts told apart where its last is sought
SHARD_BYTES, SHARD_WORDS = 24 << 20, 1 << 20  # of training text for a shard of bigrams; words of one of words
SLICE = 1 << 16  # words in a row
CHUNK = 12 << 20  # bytes of text that send their probes together, where the filter is not broadcast
END, START = U(0x5EED0E4D0F7EC57), U(0x0057A47C0DE0F5E9)
_UNI, _TYPES = U(0x11D0BEEF5A17), U(0x77C0FFEE1234)

#: The first count of each level, and the count that stands for the level.
_FIRST = np.array(sorted({int(np.ceil(BASE**i)) for i in range(100)} - {0}), np.float64)
_MEANT = np.concatenate([[0.0], (_FIRST[:-1] + _FIRST[1:] - 1) / 2])
MAX_LEVEL = len(_MEANT) - 1
_LEVEL = np.arange(MAX_LEVEL + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(_FIRST, counts, "right"), MAX_LEVEL)


def _place(keys: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The first word of each key's line: all its levels are in one line, so that a probe costs one miss of the cache."""
    return ((keys & U(0xFFFFFFFF)) * lines >> U(32)) * U(LINE)


def _marks(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the line that (key, level) is in, and its bits there."""
    a = tk.mix(keys + _LEVEL[level])
    bits = U(1) << (a & U(63))
    for i in range(1, PROBES):
        bits |= U(1) << (a >> U(6 * i) & U(63))
    return a >> U(61), bits


def build_filter(keys: np.ndarray, levels: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The words of one shard's filter."""
    lines = max(1, -(-int(levels.sum()) * bits_per_entry // (64 * LINE)))
    words = np.zeros(lines * LINE, U)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = keys[levels >= level]
        word, bits = _marks(some, level)
        word += _place(some, U(lines))
        order = np.argsort(word)
        at = np.flatnonzero(tk.first_of_runs(word[order]))
        words[word[order][at]] |= np.bitwise_or.reduceat(bits[order], at)
    return words


class Filter:
    """Some or all shards of the filter. A key whose shard is elsewhere has level 0."""

    def __init__(self, sizes: dict[int, int], shards: int):
        """sizes: the bytes of each shard here."""
        self.data = np.zeros(max(1, sum(sizes.values()) // 8), U)
        self.lines, self.at = np.zeros(shards, U), np.zeros(shards, U)
        at = 0
        for k in sorted(sizes):
            self.lines[k], self.at[k] = sizes[k] // (8 * LINE), at
            at += sizes[k] // 8

    def fill(self, shard: int, bits: bytes) -> None:
        at = int(self.at[shard])
        self.data[at : at + len(bits) // 8] = np.frombuffer(bits, U)

    def levels(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The levels of keys, each in its shard."""
        out = np.zeros(len(keys), np.uint8)
        live = np.flatnonzero(self.lines[shard] > 0)
        keys, shard = keys[live], shard[live]
        start = _place(keys, self.lines[shard]) + self.at[shard]
        for level in range(1, MAX_LEVEL + 1):
            word, bits = _marks(keys, level)
            hit = np.flatnonzero((self.data[start + word] & bits) == bits)
            live, keys, start = live[hit], keys[hit], start[hit]
            if not len(live):
                break
            out[live] = level
        return out


def _bigrams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with each text's end, their histories, and the bounds with ends."""
    out = bounds + np.arange(len(bounds))
    t = np.empty(len(h) + len(bounds) - 1, U)
    ends = out[1:] - 1
    t[ends] = END
    inner = np.ones(len(t), bool)
    inner[ends] = False
    t[inner] = h
    before = np.empty(len(t), U)
    before[1:] = t[:-1]
    before[out[:-1]] = START
    return t, before, out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_COUNTED = "shard int, key binary, hist binary, n binary"


def _count_task(shards: int, flush: int = 1 << 22):
    """The distinct bigrams of about ``flush`` tokens by shard: key, history, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hists, size = np.empty(flush, U), np.empty(flush, U), 0

        def out():
            key = keys[:size]
            order = np.argsort(key)
            cuts = np.searchsorted(tk.bucket(key[order], shards), np.arange(shards + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[i] : cuts[i + 1]]
                own = key[some]
                at = np.flatnonzero(tk.first_of_runs(own))
                n = np.diff(np.append(at, len(own))).astype(np.uint32)
                cells = [pa.array([x.tobytes()], pa.binary()) for x in (own[at], hists[some[at]], n)]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *cells], names=["shard", "key", "hist", "n"])

        for batch in batches:
            for *_, data, offsets in text_chunks(batch):
                t, before, _ = _bigrams(*tk.words(data, offsets, fold=True))
                for lo in range(0, len(t), flush // 4):
                    part = slice(lo, min(len(t), lo + flush // 4))
                    n = part.stop - lo
                    if size + n > flush:
                        yield from out()
                        size = 0
                    keys[size : size + n], hists[size : size + n] = tk.mix(tk.pair(before[part], t[part])), before[part]
                    size += n
        if size:
            yield from out()

    return run


_BUILT = "shard int, bits binary, words array<struct<hist: long, c: long, kinds: long>>"


def _build_shard(bits_per_entry: int):
    """The filter of a shard's bigrams, and what it has of each history, in slices."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, hist, n = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("key", U), ("hist", U), ("n", np.uint32)))
        order = np.argsort(keys)
        at = np.flatnonzero(tk.first_of_runs(keys[order]))
        n = np.add.reduceat(n[order], at, dtype=np.int64)
        keys, hist = keys[order][at], hist[order][at]
        del order
        bits = build_filter(keys, levels_of(n), bits_per_entry)
        order = np.argsort(hist)
        at = np.flatnonzero(tk.first_of_runs(hist[order]))
        words = pa.StructArray.from_arrays([_signed(hist[order][at]), pa.array(np.add.reduceat(n[order], at)), pa.array(np.diff(np.append(at, len(hist))))], ["hist", "c", "kinds"])
        trim()
        cuts = [0, *range(SLICE, len(at), SLICE), len(at)]
        rows = len(cuts) - 1
        return pa.table({"shard": pa.array([key[0].as_py()] * rows, pa.int32()), "bits": pa.array([bits.tobytes(), *[None] * (rows - 1)], pa.binary()), "words": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words)})

    return run


def _word_entries(first: int, shards: int):
    """Filter entries of words (hist, c, kinds), dealt to shards from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hist = batch.column(0).to_numpy().view(U)
            word = np.where(hist == START, END, hist)  # a text has one start and one end
            keys = np.concatenate([tk.mix(word ^ _UNI), tk.mix(hist ^ _TYPES)])
            level = levels_of(np.concatenate([batch.column(1).to_numpy(), batch.column(2).to_numpy()]))
            yield pa.RecordBatch.from_arrays([pa.array(first + tk.bucket(keys, shards), pa.int32()), _signed(keys), pa.array(level, pa.int32())], names=["shard", "key", "level"])

    return run


def _build_words(bits_per_entry: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = build_filter(table["key"].to_numpy().view(U), table["level"].to_numpy(), bits_per_entry)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": [bits.tobytes()]})

    return run


def _probes(t: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct words, the word of each token, distinct bigrams, the bigram of each token."""
    types, of = np.unique(t, return_inverse=True)
    key, which = np.unique(tk.mix(tk.pair(before, t)), return_inverse=True)
    return types, of, key, which


def _keys(types: np.ndarray, key: np.ndarray, shards: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The filter keys that a chunk asks for (words, what follows them, what follows a start, bigrams) and their shards."""
    words = np.concatenate([tk.mix(types ^ _UNI), tk.mix(types ^ _TYPES), tk.mix(np.full(1, START ^ _TYPES))])
    return np.concatenate([words, key]), np.concatenate([shards[0] + tk.bucket(words, shards[1]), tk.bucket(key, shards[0])])


def _log_probability(answers: np.ndarray, types: int, of: np.ndarray, which: np.ndarray, first: np.ndarray, n: int, v: int, docs: int) -> np.ndarray:
    """Of each token, from the levels of ``_keys`` in their order."""
    uni, after, start, both = np.split(_MEANT[answers], [types, 2 * types, 2 * types + 1])
    was = np.concatenate([of[:1], of[:-1]])
    h, kinds = np.where(first, docs, uni[was]), np.where(first, start[0], after[was])
    p = (uni[of] + 1) / (n + v + 1)
    # a history without known followers is unknown: a false hit may give it a count
    return np.log10(np.where(kinds > 0, (np.minimum(both[which], h) + kinds * p) / np.maximum(h + kinds, 1), p))


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word long, times long"


def _scored(number: int, ids: pa.Array, held: pa.Array, t, before, bounds, answer: Callable[[np.ndarray, np.ndarray], np.ndarray], shards: tuple[int, int], head, n: int, v: int, docs: int) -> pa.RecordBatch:
    """A row a text (numbered from ``number``), with what the head table knows, and a row a text and other word."""
    types, of, key, which = _probes(t, before)
    logs = _log_probability(answer(*_keys(types, key, shards)), len(types), of, which, before == START, n, v, docs)
    words, counts = head
    place = np.minimum(np.searchsorted(words, types), max(0, len(words) - 1))
    known = words[place] == types if len(words) else np.zeros(len(types), bool)
    top = np.where(known, np.log10(counts[place] + 1.0), 0.0) if len(words) else np.zeros(len(types))
    at = bounds[:-1]
    rest = np.flatnonzero(~known[of])
    pairs, times = np.unique(tk.owners(bounds)[rest] * len(types) + of[rest], return_counts=True)
    doc, word = pairs // max(1, len(types)), types[pairs % max(1, len(types))]
    size, more = len(at), len(pairs)
    n_tokens = np.diff(bounds)
    base = np.add.reduceat(top[of], at) - n_tokens * np.log10(n + v + 1.0)
    columns = [n_tokens, np.add.reduceat(known[of].astype(np.int64), at), base, np.add.reduceat(logs, at)]
    pad = lambda x, kind: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind), pa.nulls(more, kind)])
    arrays = [pa.array(number + np.concatenate([np.arange(size), doc])), pad(ids.cast(pa.int64()), pa.int64()), pad(held.cast(pa.bool_()), pa.bool_())]
    arrays += [pad(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
    arrays += [pa.concat_arrays([pa.nulls(size, pa.int64()), pa.array(x, pa.int64())]) for x in (word.view(np.int64), times)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SCORED.split(", ")])


def _score_task(filter_, shards: tuple[int, int], head_, n: int, v: int, docs: int):
    """With the whole filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        head = [np.frombuffer(x, d) for x, d in zip(head_.value, (U, np.int64))]
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, limit=2 << 20):
                t, before, bounds = _bigrams(*tk.words(data, offsets, fold=True))
                yield _scored(number, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), t, before, bounds, filter_.value.levels, shards, head, n, v, docs)
                number += hi - lo

    return run


def _by_shard(ask: np.ndarray, shard: np.ndarray, few: int) -> np.ndarray:
    """The order of ``_keys`` by shard and key: bigrams have it already, words come first."""
    words = np.count_nonzero(shard >= few)
    return np.concatenate([np.arange(words, len(ask)), np.argsort(ask[:words], kind="stable")])


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, whose high bytes are mostly 0."""
    steps = np.diff(keys, prepend=U(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


_ASKED = "chunk long, shard int, part int, n int, blob binary, ids array<long>, held array<boolean>, bounds array<long>"
_ASKED_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_ASKED_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ASKED_TYPES)], names=[x.split()[0] for x in _ASKED.split(", ")])


def _ask_task(shards: tuple[int, int]):
    """Rows of a chunk's texts, in parts, and a row a shard with the distinct keys that the chunk asks for there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk, part, size, tokens = TaskContext.get().partitionId() << 40, None, 0, 0, []

        def asked() -> Iterator[pa.RecordBatch]:
            t, before = (np.concatenate(x) for x in zip(*tokens))
            types, _, key, _ = _probes(t, before)
            ask, shard = _keys(types, key, shards)
            order = _by_shard(ask, shard, shards[0])
            ask, shard = ask[order], shard[order]
            cuts = np.append(np.flatnonzero(tk.first_of_runs(shard)), len(shard)).tolist()
            for i in range(0, len(cuts) - 1, 256):
                yield _asked([(chunk, int(shard[a]), None, b - a, _pack(ask[a:b]), None, None, None) for a, b in zip(cuts[i : i + 256], cuts[i + 1 : i + 257])])
            trim()

        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                if tokens and size + len(data) > CHUNK:
                    yield from asked()
                    chunk, part, size, tokens = None, 0, 0, []
                chunk = number if chunk is None else chunk
                tokens.append(_bigrams(*tk.words(data, offsets, fold=True))[:2])
                text = pa.compress(data.tobytes(), "zstd", asbytes=True)
                ids, held = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in range(2))
                yield _asked([(chunk, (chunk + part) % sum(shards), part, None, text, ids, held, offsets)])
                number, part, size = number + hi - lo, part + 1, size + len(data)
        if tokens:
            yield from asked()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, its bits (without a chunk) first: texts as they are, of the keys the levels."""
    f, own = Filter({}, 1), -1
    for batch in batches:
        n, shard = batch.column(3).to_pylist(), batch.column(1).to_pylist()
        blobs, keep = batch.column(4).to_pylist(), np.asarray(batch.column(0).is_valid())
        for i, blob in enumerate(blobs):
            if not keep[i]:
                f, own = Filter({0: len(blob)}, 1), shard[i]
                f.fill(0, blob)
            elif n[i] is not None:
                levels = f.levels(_unpack(blob, n[i]), np.zeros(n[i], np.int64)) if own == shard[i] else np.zeros(n[i], np.uint8)
                blobs[i] = pa.compress(levels.tobytes(), "zstd", asbytes=True)
        columns = [pa.array(blobs, pa.binary()) if i == 4 else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))


def _finish_chunk(shards: tuple[int, int], head_, n: int, v: int, docs: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        levels = sorted((r["shard"], r["n"], r["blob"]) for r in rows if r["n"] is not None)
        level = np.concatenate([np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), np.uint8) for _, size, blob in levels])

        def answer(ask: np.ndarray, shard: np.ndarray) -> np.ndarray:
            out = np.empty(len(ask), np.uint8)
            out[_by_shard(ask, shard, shards[0])] = level
            return out

        parts, ids, held, at = [], [], [], 0
        for r in sorted((r for r in rows if r["n"] is None), key=lambda r: r["part"]):
            offsets = np.array(r["bounds"], np.int64)
            data = np.frombuffer(pa.decompress(r["blob"], int(offsets[-1]), "zstd", asbytes=True), np.uint8)
            t, before, bounds = _bigrams(*tk.words(data, offsets, fold=True))
            parts.append((t, before, bounds[:-1] + at))
            ids += r["ids"]
            held += r["held"]
            at += len(t)
        t, before, bounds = (np.concatenate(x) for x in zip(*parts))
        del rows, parts
        head = [np.frombuffer(x, d) for x, d in zip(head_.value, (U, np.int64))]
        out = _scored(key[0].as_py(), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), t, before, np.append(bounds, at), answer, shards, head, n, v, docs)
        trim()
        return pa.Table.from_batches([out])

    return run


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score_documents(docs: DataFrame, *, modulus: int = 7, remainder: int = 2, broadcast_bytes: int = 128 << 20, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: all texts by the model of those not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus, remainder).alias("held"), F.col("text").cast("string").alias("text"))
    train = docs.where(~F.col("held"))
    size, n_docs = (int(x or 0) for x in train.agg(F.sum(F.octet_length("text")), F.count("*")).first())
    few = max(1, -(-size // SHARD_BYTES))
    built = cut(train.select("text").mapInArrow(_count_task(few), _COUNTED).groupBy("shard").applyInArrow(_build_shard(bits_per_entry), _BUILT))
    words = cut(built.select(F.inline("words")).groupBy("hist").agg(F.sum("c").alias("c"), F.sum("kinds").alias("kinds")))
    n, v = (int(x or 0) for x in words.agg(F.sum("c"), F.count("*")).first())  # a start stands for the end, which is no history
    start = F.col("hist") == int(START.view(np.int64))

    word = F.when(start, F.lit(int(END.view(np.int64)))).otherwise(F.col("hist")).alias("word")
    often = words.groupBy(F.least("c", F.lit(LEAST_HEAD)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
    met, least = 0, max(LEAST_HEAD, n // HEAD + 1)  # words of a count above N / HEAD are fewer than HEAD
    for r in often:
        met += r.n
        if met > HEAD:
            break
        least = r.c
    tops = words.where(F.col("c") >= least).select(word, "c").toArrow()
    head = tops["word"].to_numpy().view(U), tops["c"].to_numpy().astype(np.int64)
    order = np.argsort(head[0])
    head = spark.sparkContext.broadcast(tuple(x[order].tobytes() for x in head))

    shards = few, max(-(-v // SHARD_WORDS), -(-few // 4))  # chunks ask a few times as many bigrams as words
    entries = words.select("hist", "c", "kinds").mapInArrow(_word_entries(*shards), "shard int, key long, level int")
    own = cut(entries.groupBy("shard").applyInArrow(_build_words(bits_per_entry), "shard int, bits binary"))
    bits = cut(built.where("bits is not null").select("shard", "bits"))
    done(built)  # its words, which take more than the bits, are summed
    built = bits.unionByName(own)
    sizes = built.agg(F.sum(F.length("bits"))).first()[0] or 0
    answered = None
    if sizes <= broadcast_bytes:
        f = Filter({r[0]: r[1] for r in built.select("shard", F.length("bits")).collect()}, sum(shards))
        for r in built.toLocalIterator():
            f.fill(r.shard, r.bits)
        f = spark.sparkContext.broadcast(f)
        scored = docs.mapInArrow(_score_task(f, shards, head, n, v, n_docs), _SCORED)
    else:
        asked = docs.mapInArrow(_ask_task(shards), _ASKED)
        stored = built.select(*((F.col({"shard": "shard", "blob": "bits"}[c]) if c in ("shard", "blob") else F.lit(None)).cast(kind).alias(c) for c, kind in (x.split() for x in _ASKED.split(", "))))
        dealt = asked.unionByName(stored).repartition("shard").sortWithinPartitions("shard", F.col("chunk").isNotNull())
        answered = cut(dealt.mapInArrow(_answer, _ASKED))
        scored = answered.groupBy("chunk").applyInArrow(_finish_chunk(shards, head, n, v, n_docs), _SCORED)
    scored = cut(scored)
    done(bits, own, *([answered] if answered else []))
    rest = scored.where("word is not null").select("row", "word", "times").join(words.select(word, "c"), "word")
    rest = rest.groupBy("row").agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    out = scored.where("word is null").drop("word", "times").join(rest, "row", "left")
    known, base = (F.col(a) + F.coalesce(b, F.lit(0)) for a, b in (("n_known", "times"), ("base_score", "logs")))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
