"""Near-duplicate documents from bottom-k sketches (operator 8).

A document's set is its distinct word shingles, as 64-bit hashes of one function; the ``K`` smallest are its sketch.
Documents with equal sets form a class; classes link when the Jaccard similarity of their full sets reaches the bar.

Candidates come from inverted lists of retained values. Sketches of sets at the bar share all but a few values (never
fewer than ``K - PREFIX + 1``, but for a chance of 3e-7, also where one text is the other with a quarter added), so two
such sketches share one of their ``PREFIX`` rarest values, and only these are listed: boilerplate that fills less than
half of a document lists nothing. Sets of at most ``SMALL`` shingles are whole in their sketch and take the exact prefix.
Entries carry ``BITS`` bits, one set by each retained value: two sketches share no more values than the bits they have in
common and the values that fell on a bit already set, which drops nearly all pairs that met by chance before anything
else of them is read. A list of a value that more than ``FEW`` classes retain is cut by size class (a class spans the
ratio that the bar allows), and an entry stands in its own class and as a guest in the next, so that two sets that may
link meet.

Links are found in three steps, so that a group of copies never gives all its pairs. First every entry meets its list's
leader, and each document is verified against the smallest that it met so; linked documents form components. Then only
pairs whose components differ count: all of short lists, and those of leaders. Last, in long lists, members outside the
list's main component meet the members of other components, in blocks of at most ``BLOCK`` by ``BLOCK``: once to find the
documents that any bits let pass, and once more among these with the ``LONG`` smallest shingles of each (the whole set of
shorter documents, so that the similarity is known; of longer ones the union's sketch estimates it), each pair in the list
of the smallest value that both are listed under. Where the similarity is known, a document gives its ``BEST`` pairs with
each other component, as one link joins them. Pairs are verified on the full sets, which only documents that such a pair
names give (found by a filter of bounded size, so no text is shuffled): the sketch of the union estimates the similarity
first, and what passes is compared exactly.

Defined cases: a text with fewer words than a shingle is one shingle; without words its set is empty and it links with
nothing; rows with a null doc_id take no part (component null, kept); rows that share a doc_id count as one document
with several texts; repeated rows are answered each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorewell.llm import tokens as tk
from lorewell.llm.components import components
from lorewell.llm.shared import cut, done, id_filter, in_filter, small_batches, text_chunks, trim

K, PREFIX, SMALL, FEW, BLOCK = 64, 31, 50, 24, 4096
BITS, LONG, BEST = 256, 256, 3
SLACK = {K: 0.29, LONG: 0.135}  # of the union sketch's estimate: at 0.8 a binomial share falls below with a chance of 8e-8 and 2.4e-7
U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and their bounds."""
    h, bounds = tk.words(data, offsets, fold=True)
    sizes = np.diff(bounds)
    n = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], n)
    s = h[at] if len(at) else h[:0]
    short = (sizes < width)[owner]
    for j in range(1, width):
        inside = at + j < bounds[1:][owner]
        s = np.where(inside, tk.pair(s, h[np.minimum(at + j, max(0, len(h) - 1))], 1), s) if len(at) else s
    s = np.where(short, tk.mix(s + U(width)), s)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = tk.first_of_runs(s) | tk.first_of_runs(owner)
    return s[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                s, bounds = shingle_sets(data, offsets, width)
                n = np.diff(bounds)
                a, b = (np.concatenate([[U(0)], np.cumsum(tk.mix(s + U(x)))])[bounds] for x in (0x51, 0xA7))
                keep = np.arange(len(s)) - np.repeat(bounds[:-1], n) < K
                ends = np.concatenate([[0], np.cumsum(np.minimum(n, K))]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array((s[keep] ^ U(1 << 63)).view(np.int64)))  # keeps the order
                marks = np.zeros((hi - lo, BITS), bool)
                marks[np.repeat(np.arange(hi - lo), np.diff(ends)), (s[keep] % U(BITS)).astype(np.int64)] = True
                marks = np.packbits(marks, axis=1).view(np.int64)
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(np.diff(a).view(np.int64)), pa.array(np.diff(b).view(np.int64)), sketch, *(pa.array(marks[:, i]) for i in range(marks.shape[1]))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SKETCHED.split(", ")])

    return run


_BITS = [f"b{i}" for i in range(BITS // 64)]
_SKETCHED = "doc_id long, n long, s1 long, s2 long, sketch array<long>, " + ", ".join(f"{b} long" for b in _BITS)


def _sets(width: int, named, long: bool = False):
    """The full sets of the documents that the filter names, or of each its smallest shingles, of whose order the high halves keep enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            batch = batch.filter(pa.array(in_filter(named.value, ids.fill_null(0).to_numpy()) & np.asarray(ids.is_valid())))
            if not batch.num_rows:
                continue
            for lo, hi, data, offsets in text_chunks(batch):
                s, bounds = shingle_sets(data, offsets, width)
                if long:
                    blobs = [(s[x : min(y, x + LONG)] >> U(32)).astype(np.uint32).tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
                else:
                    blobs = [s[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["rep", "shingles"])

    return run


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _shares(rows: list[np.ndarray]):
    """A function that counts what a row shares with every row."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    owner = np.repeat(np.arange(len(rows)), np.diff(at))
    _, code = np.unique(np.concatenate(rows), return_inverse=True)
    order = np.argsort(code, kind="stable")
    by, bounds = owner[order], np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))

    def of(i: int) -> np.ndarray:
        return np.bincount(np.concatenate([by[:0], *(by[bounds[c] : bounds[c + 1]] for c in code[at[i] : at[i + 1]])]), minlength=len(rows))

    return of


def _needed(n, m, percent: int, greater):
    """The fewest values that two sketches of sets of n and m at the bar share (numbers, arrays or columns)."""
    shared = (percent * (n + m) + 99 + percent) // (100 + percent) if not isinstance(n, Column) else F.ceil(percent * (n + m) / F.lit(100 + percent))
    return shared - greater(n - K, 0) - greater(m - K, 0)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes and bits of two entries (prefixes of their columns) let them reach the bar."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    bits = lambda of: [F.col(f"{of}{b}") for b in _BITS]
    count = lambda some: sum((F.bit_count(b) for b in some), F.lit(0))
    spare = F.least(F.least(n, F.lit(K)) - count(bits(x)), F.least(m, F.lit(K)) - count(bits(y)))
    least = F.when(F.least(n, m) > K, F.lit(K - PREFIX + 1)).otherwise(_needed(n, m, percent, lambda a, b: F.greatest(a, F.lit(b))))
    common = count(a.bitwiseAND(b) for a, b in zip(bits(x), bits(y)))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (common >= least - spare)


def _union_estimate(x: np.ndarray, y: np.ndarray, size: int = K) -> float:
    """The share of the union's ``size`` smallest values that both sets hold."""
    x, y = x[:size], y[:size]
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~twice])][:size]
    return int((both[:-1][twice] <= union[-1]).sum()) / len(union)


def _best_pairs(i: int, j: np.ndarray, longs: list, n: np.ndarray, comp: np.ndarray, bar: float) -> list[int]:
    """Of the candidates j those that may link with i: all whose similarity is estimated, of each component the best whose is known."""
    out, known = [], []
    for x in j.tolist():
        if max(n[i], n[x]) > LONG:
            if _union_estimate(longs[i], longs[x], LONG) >= bar - SLACK[LONG]:
                out.append(x)
        else:
            both = np.sort(np.concatenate([longs[i], longs[x]]))
            shared = int((both[1:] == both[:-1]).sum())
            if shared >= bar * (n[i] + n[x] - shared) - 1e-9:
                known.append((-shared / (n[i] + n[x] - shared), x))
    met: dict[int, int] = {}
    for _, x in sorted(known):
        met[comp[x]] = met.get(comp[x], 0) + 1
        if met[comp[x]] <= BEST:
            out.append(x)
    return out


def _block_pairs(percent: int, ids: bool):
    """Of a block of a list, members outside the main component with members of other components: the ids in any pair that bits let pass, or pairs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        v, c1, c2 = (key[i].as_py() for i in (0, 2, 3))
        rep, comp, n, chunk, guest = (table[c].to_numpy() for c in ("rep", "comp", "n", "chunk", "guest"))
        bits = np.stack([table[b].to_numpy() for b in _BITS], 1).view(U)
        spare = np.minimum(n, K) - np.bitwise_count(bits).sum(1, dtype=np.int64)  # values on bits already set
        minor = comp != table["main"].to_numpy()
        met, a, b = np.zeros(len(rep), bool), [], []
        if not ids:
            earlier = _shares([x[x < v] for x in _rows(table["listed"])])
            longs = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["long"]]
        for i in np.flatnonzero(minor):
            fits = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (~minor | (rep > rep[i]))
            fits &= ~guest | ~guest[i]  # two guests meet in their own class
            fits &= (chunk != chunk[i]) if c1 != c2 else True
            j = np.flatnonzero(fits)
            common = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
            least = np.where(np.minimum(n[j], n[i]) > K, K - PREFIX + 1, _needed(n[j], n[i], percent, np.maximum))
            j = j[common >= least - np.minimum(spare[j], spare[i])]
            if ids:
                met[j] = True
                met[i] |= len(j) > 0
            elif len(j):
                for x in _best_pairs(i, j[earlier(i)[j] == 0], longs, n, comp, percent / 100):
                    a.append(min(rep[i], rep[x]))
                    b.append(max(rep[i], rep[x]))
        if len(rep) > 1000:
            trim()
        if ids:
            return pa.table({"rep": rep[met]})
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                shared = -1
                if len(x) and len(y) and _union_estimate(x, y) >= percent / 100 - SLACK[K] * (max(len(x), len(y)) > K):
                    shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            trim()

    return run


def _links(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, that the full sets confirm."""
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    named = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    sets = cut(docs.mapInArrow(_sets(width, named), "rep long, shingles binary"))
    one, two = (sets.select(F.col("rep").alias(r), F.col("shingles").alias(s)) for r, s in (("a", "x"), ("b", "y")))
    found = cut(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long").distinct())
    done(sets)
    return found


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries of lists of ``chunks`` parts, each in every block of two parts that it belongs to."""
    own = entries.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("c1", F.least("chunk", "other")).withColumn("c2", F.greatest("chunk", "other")).drop("chunks", "other")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose components differ."""
    of = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"of_{c}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, *, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id (the least doc_id with the same set), component_id, kept."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(docs.mapInArrow(_sketch(width), _SKETCHED))
    own = [F.first(c).alias(c) for c in ("n", "sketch", *_BITS)]
    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), *own))

    values = classes.select("rep", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    met = values.join(often, "v").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("vs"))
    prefix = F.when(F.col("n") <= SMALL, F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).otherwise(F.least(F.lit(PREFIX), F.col("m"))).cast("int")
    listed = met.join(classes.select("rep", "n", F.least("n", F.lit(K)).cast("int").alias("m"), *_BITS), "rep")
    alone = F.col("m") - F.size("vs")  # values that no other class retains come first in the order of rarity
    # a ratio a little beyond the bar's, so that rounding never parts two sizes at the bar by two classes
    class_ = F.floor(F.log("n") / math.log(100 / percent * (1 + 1e-9))) if percent < 100 else F.col("n")
    lists = listed.select("rep", "n", *_BITS, class_.alias("class"), F.explode(F.slice("vs", F.lit(1), F.greatest(prefix - alone, F.lit(0)))).alias("x"))
    lists = cut(lists.select("rep", "n", *_BITS, "class", "x.v", (F.col("x.f") <= FEW).alias("few")))

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    in_cells = F.array(F.struct(F.col("class").alias("size"), F.lit(False).alias("guest")), F.struct((F.col("class") + 1).alias("size"), F.lit(True).alias("guest")))
    cells = F.when(F.col("few"), F.array(F.struct(F.lit(-1).cast("long").alias("size"), F.lit(False).alias("guest")))).otherwise(in_cells)
    entries = lists.select("v", F.explode(cells).alias("cell"), "few", "rep", "n", *_BITS).select("v", "cell.size", "cell.guest", "few", "rep", "n", *_BITS)
    lead = F.when(~F.col("guest"), F.struct("rep", "n", *_BITS))
    leaders = entries.groupBy("v", "size").agg(F.min(lead).alias("l"), F.count("*").alias("members")).where("members > 1 AND l IS NOT NULL").drop("members")
    star = entries.join(leaders, ["v", "size"]).where("rep <> l.rep").where(_may_link("", "l.", percent))
    first = cut(star.groupBy("rep").agg(F.min("l.rep").alias("o")).select(*ordered("rep", "o")).distinct())
    links = _links(first, docs, width, percent)
    label = components(links)

    of = label.withColumnRenamed("id", "rep").withColumnRenamed("label", "comp")
    few = lists.where("few").select("rep", "v", "n", *_BITS).join(of, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    met = few.join(few.toDF(*(c if c == "v" else f"o_{c}" for c in few.columns)), "v").where((F.col("rep") < F.col("o_rep")) & (F.col("comp") != F.col("o_comp")) & _may_link("", "o_", percent))
    apart = _apart(star.where("not few").select(*ordered("rep", "l.rep")), label)
    more = cut(met.select(*ordered("rep", "o_rep")).unionByName(apart).distinct().join(first, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links = cut(links.unionByName(_links(more, docs, width, percent)).distinct())
        label = components(links)
    tried = first.unionByName(more)

    long = lists.where("not few").groupBy("rep").agg(F.collect_list("v").alias("listed"))
    entries = entries.where("not few").drop("few")
    placed = entries.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
    shares = placed.groupBy("v", "size", "comp").agg(F.count("*").alias("k"))
    mains = shares.groupBy("v", "size").agg(F.max(F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("k").alias("members")).where("comps > 1").select("v", "size", "main.comp", "members").withColumnRenamed("comp", "main")
    open_ = cut(placed.join(mains, ["v", "size"]).withColumn("chunks", F.ceil(F.col("members") / BLOCK).cast("int")).drop("members"))
    cell = ("v", "size", "c1", "c2")
    named = cut(_dealt(open_).groupBy(*cell).applyInArrow(_block_pairs(percent, True), "rep long").distinct())
    longs = docs.mapInArrow(_sets(width, docs.sparkSession.sparkContext.broadcast(id_filter(named)), True), "rep long, long binary")
    again = open_.join(named, "rep").join(long, "rep").join(longs, "rep")
    more = _dealt(again).groupBy(*cell).applyInArrow(_block_pairs(percent, False), "a long, b long").distinct()
    more = cut(more.join(tried, ["a", "b"], "left_anti"))
    done(open_)
    if not more.isEmpty():
        links = links.unionByName(_links(more, docs, width, percent)).distinct()
        label = components(links)
    done(lists)
    ids = classes.select("s1", "s2", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2").join(ids, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
