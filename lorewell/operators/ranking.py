"""Related documents: shortlist by mean vectors, chunk similarity both ways, blends, floors and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1024
HELD = 1 << 21  # candidates that a task keeps before it hands them on


def _packed(items: DataFrame, keyed: bool) -> DataFrame:
    """Blocks of at most ``BLOCK`` rows of one key: key, n, ids, v (binary)."""
    kind = items.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, key, v = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            sizes = v.value_lengths().to_numpy()
            codes = key.dictionary_encode().indices.fill_null(-1).to_numpy() if keyed else np.zeros(len(ids), np.int64)
            edge = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (sizes[1:] != sizes[:-1])])) if len(ids) else []
            for lo, hi in zip(edge, [*edge[1:], len(ids)]):
                for at in range(lo, hi, BLOCK):
                    part = slice(at, min(hi, at + BLOCK))
                    x = v.slice(at, part.stop - at).flatten().to_numpy(zero_copy_only=False).astype(float)
                    yield pa.RecordBatch.from_arrays([key.slice(at, 1), pa.array([part.stop - at], pa.int32()), pa.array([ids[part].astype(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["key", "n", "ids", "v"])

    rows = items.repartition("key").sortWithinPartitions("key") if keyed else items
    return rows.select("id", "key", "v").mapInArrow(run, f"key {kind}, n int, ids binary, v binary")


def _grid(items: DataFrame, queries: DataFrame | None, keyed: bool) -> DataFrame:
    """Each block of queries beside each block of items of its key: q_ids, q, ids, x."""
    blocks = _packed(items, keyed)
    asked = blocks if queries is None else _packed(items.join(queries.select("id"), "id", "left_semi"), keyed)
    asked = asked.select(F.col("key").alias("q_key"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("v").alias("q"))
    met = blocks.join(asked, F.col("key").eqNullSafe(F.col("q_key"))) if keyed else blocks.crossJoin(asked)
    return met.select("q_ids", "q", "q_n", "ids", "v", "n")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, query vectors, ids, vectors and scores of each cell of a grid whose vectors have one length."""
    for batch in batches:
        for row in zip(*batch.columns):
            q_ids, ids = (np.frombuffer(row[i].as_buffer(), np.int64) for i in (0, 3))
            q, x = (np.frombuffer(row[i].as_buffer(), float).reshape(row[i + 1].as_py(), -1) for i in (1, 4))
            x = x.reshape(row[5].as_py(), -1)
            if q.shape[1] == x.shape[1]:
                yield q_ids, q, ids, x, q @ x.T


def _best(q: np.ndarray, n: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((n, -score, q))
    q, n, score = q[order], n[order], score[order]
    at = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(at, np.diff(np.append(at, len(q)))) < k
    return q[keep], n[keep], score[keep]


def _top_scanner(k: int, floor: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in _best(*map(np.concatenate, zip(*held)), k)], names=["q", "n", "score"])
        size = 0
        for q_ids, _, ids, _, scores in _cells(batches):
            scores = np.where(q_ids[:, None] == ids, -np.inf, scores)
            if floor is not None:
                scores[scores < floor] = -np.inf
            cut = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
            i, j = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))  # all that tie
            held.append((q_ids[i], ids[j], scores[i, j]))
            size += len(i)
            if size > HELD:
                kept = _best(*map(np.concatenate, zip(*held)), k)
                held, size = [kept], len(kept[0])
                if size > HELD // 2:
                    yield out()
                    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        yield out()

    return run


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best n of each q, with rank from 1; ties to the smaller n."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "n")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(items: DataFrame, k: int, *, key: Column | None = None, floor: float | None = None, queries: DataFrame | None = None) -> DataFrame:
    """items: id, v (unit vectors) -> q, n, score, rank: the k nearest others of each query, of equal ``key`` if given.

    Rows are packed into blocks of one key, and each block of queries meets each block of items as a row of a grid, which
    Spark deals to tasks (the smaller side is broadcast only if Spark finds it small); a cell is one matrix product, and
    a task hands on the k best of each query that it met, so that the shuffle is small and nothing runs on the driver.
    """
    items = items.select("id", "v", (F.lit(0) if key is None else key).alias("key")).where(F.col("v").isNotNull())
    grid = _grid(items, queries, key is not None)
    return ranked(grid.mapInArrow(_top_scanner(k, floor), "q long, n long, score double"), k)


def _pair_scanner(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, _, ids, _, scores in _cells(batches):
            i, j = np.nonzero((scores >= floor) & (q_ids[:, None] < ids))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(scores[i, j])], names=["a", "b", "score"])

    return run


def pairs_above(items: DataFrame, floor: float) -> DataFrame:
    """items: id, v (unit vectors) -> a, b (a < b), score: every pair that scores ``floor`` or more, however many a vector has.

    Copies of a vector form a class and only its least id is scanned, in the grid of ``nearest``; the pairs of classes
    are expanded to those of their members at the end.
    """
    items = items.select("id", "v").where(F.col("v").isNotNull()).persist()
    classes = items.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size")).persist()
    members = items.join(classes, "v").select("rep", "id")
    reps = classes.select(F.col("rep").alias("id"), "v", F.lit(0).alias("key"))
    found = _grid(reps, None, False).mapInArrow(_pair_scanner(floor), "a long, b long, score double")
    one, two = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = found.join(one, "a").join(two, "b").select("x", "y", "score")
    same = classes.where("size > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.aggregate(F.transform("v", lambda t: t * t), F.lit(0.0), lambda s, t: s + t).alias("score"))
    within = same.where(F.col("score") >= floor).join(one, "a").join(two, "b").where("x < y").select("x", "y", "score")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def ranks_of(items: DataFrame, targets: DataFrame) -> DataFrame:
    """items: id, v (unit vectors); targets: q, n -> q, n, rank of each target among all others of q, ties to the smaller id.

    Each target's own score is found by joins; packed blocks of targets meet packed blocks of items in a grid as in
    ``nearest``, and a cell gives one count a target.
    """
    items = items.select("id", "v").where(F.col("v").isNotNull()).persist()
    wanted = targets.select("q", "n").where("q <> n").distinct()
    wanted = wanted.join(items.select(F.col("id").alias("q"), F.col("v").alias("x")), "q").join(items.select(F.col("id").alias("n"), F.col("v").alias("y")), "n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                q, n = (part.column(i).to_numpy().astype(np.int64) for i in (0, 1))
                x, y = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(q), -1) for i in (2, 3))
                own = np.array([a @ b for a, b in zip(x, y)])
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (q, n, x.astype(float), own)], names=["q", "t", "x", "own"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                ids, q, n = (np.frombuffer(row[i].as_buffer(), np.int64) for i in (0, 3, 4))
                v, x, own = (np.frombuffer(row[i].as_buffer(), float) for i in (1, 5, 6))
                ahead = x.reshape(len(q), -1) @ v.reshape(len(ids), -1).T - own[:, None]
                first = (ahead > 1e-12) | ((ahead >= -1e-12) & (ids < n[:, None]))  # copies tie, whatever the rounding
                better = (first & (ids != q[:, None]) & (ids != n[:, None])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(better)], names=["q", "n", "better"])

    blocks = _packed(items.select("id", F.lit(0).alias("key"), "v"), False).select("ids", "v", "n")
    asked = wanted.select("q", "n", "x", "y").mapInArrow(pack, "q binary, t binary, x binary, own binary")
    found = blocks.crossJoin(asked).mapInArrow(count, "q long, n long, better long")
    return found.groupBy("q", "n").agg((F.sum("better") + 1).alias("rank"))


def _notes(chunks: DataFrame) -> DataFrame:
    """chunks: id, no, v -> id, nos, vs (flat): a note's chunk vectors in one row."""
    rows = chunks.where(F.col("v").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "v"))).alias("c"))
    return rows.select("id", F.col("c.no").cast("array<int>").alias("nos"), F.flatten("c.v").alias("vs"))


def _stacked(nos: pa.Array, vs: pa.Array, title_weight: float):
    """Chunk rows of several notes, their weights, and where each note's rows begin."""
    sizes = nos.value_lengths().to_numpy()
    x = vs.flatten().to_numpy(zero_copy_only=False).reshape(int(sizes.sum()), -1)
    return x, np.where(nos.flatten().to_numpy(zero_copy_only=False) == 0, title_weight, 1.0), np.cumsum(sizes) - sizes


def bi_max_of_all(chunks: DataFrame, title_weight: float = 2.0) -> DataFrame:
    """chunks: id, no, v of one length -> q, n, score: ``bi_max`` of every pair of notes, a matrix product for each two blocks of notes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                x, w, at = _stacked(part.column(1), part.column(2), title_weight)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (part.column(0).to_numpy().astype(np.int64), x.astype(float), w, at.astype(np.int64))], names=["ids", "x", "w", "at"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                (ids, x, w, at), (q_ids, q, qw, q_at) = ([np.frombuffer(row[i + j].as_buffer(), t) for j, t in enumerate((np.int64, float, float, np.int64))] for i in (0, 4))
                s = np.maximum(q.reshape(len(qw), -1) @ x.reshape(len(w), -1).T, 0)
                there = np.add.reduceat(np.maximum.reduceat(s, at, axis=1) * qw[:, None], q_at, axis=0) / np.add.reduceat(qw, q_at)[:, None]
                back = np.add.reduceat(np.maximum.reduceat(s, q_at, axis=0) * w, at, axis=1) / np.add.reduceat(w, at)
                i, j = np.nonzero(q_ids[:, None] != ids)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(((there + back) / 2)[i, j])], names=["q", "n", "score"])

    blocks = _notes(chunks).mapInArrow(pack, "ids binary, x binary, w binary, at binary")
    return blocks.crossJoin(blocks.toDF("q_ids", "q", "qw", "q_at")).mapInArrow(score, "q long, n long, score double")


def closest_by(items: DataFrame, buckets: int = 64) -> DataFrame:
    """items: id, x (a number) -> q, n, score, rank: the other item of the nearest x, ties to the smaller id; the score is
    1 / (1 + distance). Values are dealt by quantiles; a bucket also gets the nearest value of those on either side."""
    items = items.select("id", F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull()).persist()
    cuts = sorted({*items.approxQuantile("x", [i / buckets for i in range(1, buckets)], 0.5 / buckets)})
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("x"))) if cuts else F.lit(0)
    values = items.groupBy("x").agg(F.min("id").alias("first")).withColumn("bucket", bucket).persist()
    ends = sorted(values.groupBy("bucket").agg(F.min(F.struct("x", "first")).alias("lo"), F.max(F.struct("x", "first")).alias("hi")).collect(), key=lambda r: r.bucket)
    edges = [(b.bucket, *a.hi, False) for a, b in zip(ends, ends[1:])] + [(a.bucket, *b.lo, False) for a, b in zip(ends, ends[1:])]
    known = values.select("bucket", "x", "first", F.lit(True).alias("own")).unionByName(items.sparkSession.createDataFrame(edges, "bucket int, x double, first long, own boolean"))
    w = Window.partitionBy("bucket").orderBy("x")
    near = known.withColumn("below", F.lag(F.struct("x", "first")).over(w)).withColumn("above", F.lead(F.struct("x", "first")).over(w)).where("own")
    joined = items.join(near.select("x", "first", "below", "above"), "x")
    second = joined.where("id > first").groupBy("x").agg(F.min("id").alias("second"))
    option = lambda of, n: F.when(n.isNotNull(), F.struct(F.abs(of - F.col("x")).alias("d"), n.alias("n")))
    same = F.when(F.col("id") > F.col("first"), F.col("first")).otherwise(F.col("second"))
    best = F.array_min(F.array_compact(F.array(option(F.col("x"), same), option(F.col("below.x"), F.col("below.first")), option(F.col("above.x"), F.col("above.first")))))
    return joined.join(second, "x", "left").select(F.col("id").alias("q"), best.alias("b")).where("b IS NOT NULL").select("q", "b.n", (1 / (1 + F.col("b.d"))).alias("score"), F.lit(1).alias("rank"))


def _directions(pairs: DataFrame, chunks: DataFrame, means: DataFrame | None, title_weight: float) -> DataFrame:
    """q, n, there, back: both directions of each pair, from one matrix product of the two notes' chunks."""
    notes = _notes(chunks)
    if means is not None:
        notes = notes.join(means.select("id", "mean"), "id", "left")
    else:
        notes = notes.withColumn("mean", F.lit(None).cast("array<double>"))
    one, two = notes.toDF("q", "q_nos", "q_vs", "q_mean"), notes.toDF("n", "n_nos", "n_vs", "n_mean")

    def side(best: np.ndarray, nos: np.ndarray) -> float:
        w = np.where(nos == 0, title_weight, 1.0)
        return float((w * np.maximum(best, 0)).sum() / w.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, back = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, (a_no, a_v, a_mean, b_no, b_v, b_mean) in enumerate(zip(*batch.columns[2:])):
                a_no, b_no = (np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (a_no, b_no))
                a, b = (x.values.to_numpy(zero_copy_only=False).reshape(len(no), -1) for x, no in ((a_v, a_no), (b_v, b_no)))
                if a.shape[1] != b.shape[1]:
                    continue
                s = a @ b.T
                there[i], back[i] = side(s.max(1), a_no), side(s.max(0), b_no)
                if len(a) == 1 and b_mean.is_valid:
                    there[i] = max(0.0, float(a[0] @ b_mean.values.to_numpy(zero_copy_only=False)))
                if len(b) == 1 and a_mean.is_valid:
                    back[i] = max(0.0, float(b[0] @ a_mean.values.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(there), pa.array(back)], names=["q", "n", "there", "back"])

    kinds = dict(chunks.dtypes)["id"]
    return pairs.select("q", "n").join(one, "q").join(two, "n").select("q", "n", "q_nos", "q_vs", "q_mean", "n_nos", "n_vs", "n_mean").mapInArrow(run, f"q {kinds}, n {kinds}, there double, back double")


def max_sim(pairs: DataFrame, chunks: DataFrame, title_weight: float = 2.0) -> DataFrame:
    """pairs: q, n; chunks: id, no, v -> q, n, dir: the weighted mean over q's chunks of the best match in n, at least 0."""
    return _directions(pairs, chunks, None, title_weight).select("q", "n", F.col("there").alias("dir"))


def bi_max(pairs: DataFrame, chunks: DataFrame, means: DataFrame | None = None, title_weight: float = 2.0) -> DataFrame:
    """q, n, score: the mean of both directions. With ``means`` (id, mean) a note of one chunk meets the other's mean."""
    return _directions(pairs, chunks, means, title_weight).select("q", "n", ((F.col("there") + F.col("back")) / 2).alias("score"))


def blend_ideas(scores: DataFrame, ideas: DataFrame, weight: float) -> DataFrame:
    """(1 - weight) * score + weight * idea score; without idea scores the score stays. The mix is this package's choice."""
    joined = scores.join(ideas.select("q", "n", F.col("score").alias("idea")), ["q", "n"], "left")
    return joined.select("q", "n", ((1 - weight) * F.col("score") + weight * F.coalesce("idea", "score")).alias("score"))


def boost(scores: DataFrame, signals: DataFrame, most: float, floor: float) -> DataFrame:
    """score + most * signal (0 to 1), only for pairs already above the floor; the form is this package's choice."""
    joined = scores.where(F.col("score") >= floor).join(signals, ["q", "n"], "left")
    return joined.withColumn("score", F.col("score") + F.least(F.lit(most), most * F.coalesce("signal", F.lit(0.0)))).drop("signal")


def reason(linked: Column, shared: Column, top_tag: Column, co_cited: Column) -> Column:
    kind = F.when(linked, F.lit("linked")).when(shared > 0, F.lit("shared-tags")).when(co_cited > 0, F.lit("co-cited")).otherwise(F.lit("semantic"))
    return F.struct(kind.alias("kind"), F.when(shared > 0, top_tag).alias("detail"))


def best_passage(query: list[float], chunks: DataFrame, k: int | None) -> DataFrame:
    """id, score, no: the best chunk of each note for one query vector, the k best notes, or all."""
    from lorewell.functions.vectors import dot

    scored = chunks.withColumn("score", dot(F.col("v"), F.array(*map(F.lit, query))))
    best = scored.groupBy("id").agg(F.max("score").alias("score"), F.max_by("no", "score").alias("no"))
    return best if k is None else best.orderBy(F.desc("score"), "id").limit(k)


def by_keywords(queries: DataFrame, docs: DataFrame, k: int, least_letters: int = 4) -> DataFrame:
    """queries: q, text; docs: n, text -> q, n, score, rank: documents by the share of a query's distinct words that they hold.

    The stand-in for notes without a vector; the formula is this package's choice. Words join by hash; Spark broadcasts the queries' words only if they are few.
    """
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)[^\p{L}]+"), lambda w: F.length(w) >= least_letters)))
    asked, held = queries.select("q", words("text").alias("w")), docs.select("n", words("text").alias("w"))
    sizes = asked.groupBy("q").agg(F.count("*").alias("size"))
    both = held.join(asked, "w").groupBy("q", "n").agg(F.count("*").alias("hits")).join(sizes, "q")
    return ranked(both.select("q", "n", (F.col("hits") / F.col("size")).alias("score")), k)


def evaluate(rank: DataFrame, targets: DataFrame, at: tuple[int, ...] = (5, 10, 20), known: DataFrame | None = None) -> DataFrame:
    """rank: q, n, rank; targets: q, n (repeats count) -> recall at each depth and the mean reciprocal rank.

    With ``known`` (id) targets that are no note leave the denominator, and notes left without a target are skipped.
    """
    targets = targets.where("q <> n")
    if known is not None:
        targets = targets.join(known.select(F.col("id").alias("n")), "n", "left_semi")
    met = targets.join(rank, ["q", "n"], "left")
    by = met.groupBy("q").agg(*(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= d).cast("double")).alias(f"r{d}") for d in at), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return by.agg(*(F.avg(f"r{d}").alias(f"recall_{d}") for d in at), F.avg("rr").alias("mrr"), F.count("*").alias("n_queries"))
