"""Exact top-k inner-product search with a table of pivots (operator 2).

Pivots are vectors of the table, chosen far apart: each next one is that of a bounded sample (``SAMPLE`` rows of the
smallest hashes, for each of the ``LENGTHS`` most frequent lengths; others have none) whose nearest pivot is farthest. The distances of every vector to all pivots are
computed once and written beside it. They bound its distance to a query from below by ``max_p |d(q, p) - d(x, p)|`` and
so its inner product from above, as <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Candidates are evaluated in the order of
that bound until the next bound lies under the k-th best score. How many are (``counted``): in few dimensions or
on clustered vectors a small share, in many nearly all (distances to pivots then say little), and the result is exact
in any case.

Scale: the query set is stated (ids divisible by ``every``); packed blocks of ``BLOCK`` queries meet packed blocks of the
written table as rows of a grid that Spark deals to tasks. A task keeps k rows a query that it met and hands them on when
they are many, so the shuffle holds few rows a query and task, and nothing is collected on the driver but the pivots.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of
another length than a query's are no candidates for it; a query row never meets rows of its own vec_id; repeated
candidate rows count each; repeated query rows answer once; null ids take no part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lorewell.llm.shared import cut, small_batches

PIVOTS, SAMPLE, LENGTHS = 64, 2048, 16
BLOCK = 512
HELD = 1 << 18  # rows of results that a task keeps
_STEP = 64


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most n rows: the first, then always the one whose nearest chosen row is farthest."""
    if not len(x):
        return x
    chosen, near = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1]][None])[:, 0])
    return x[chosen]


_PACKED = "dims int, n int, rows binary, ids binary, v binary, far binary"


def _pack(pivots_):
    """Blocks of vectors of one length with their distances to its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = (batch.column(i).to_numpy() for i in (0, 1))
            column = batch.column(2)
            sizes, offsets, flat = column.value_lengths().to_numpy(), column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == d)
                for lo in range(0, len(some), BLOCK):
                    at = some[lo : lo + BLOCK]
                    x = flat[(offsets[at][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                    far = _distances(x.astype(float), pivots_.value.get(d, np.zeros((0, d))))
                    cells = [pa.array([y.tobytes()], pa.binary()) for y in (rows[at], ids[at], x.astype(np.int64), far)]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(at)], pa.int32()), *cells], names=[c.split()[0] for c in _PACKED.split(", ")])

    return run


_HITS = "query_id long, query_row long, vec_id long, score long, evaluated long"


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}  # query row: id, scores, ids (best first), evaluated

        def out():
            rows = [(q, row, i, s, n if not j else 0) for row, (q, scores, found, n) in best.items() for j, (s, i) in enumerate(zip(scores.tolist(), found.tolist()))]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=[x.split()[0] for x in _HITS.split(", ")])

        for batch in batches:
            for cells in zip(*batch.columns):
                d = cells[0].as_py()
                if d != cells[6].as_py():
                    continue
                (x_rows, x_ids, x, dx), (q_rows, q_ids, q, dq) = ([np.frombuffer(c.as_buffer(), t) for c, t in zip(part, (np.int64, np.int64, np.int64, float))] for part in (cells[2:6], cells[8:12]))
                x, q, dx, dq = x.reshape(-1, d), q.reshape(-1, d), dx.reshape(len(x_ids), -1), dq.reshape(len(q_ids), -1)
                exact = max(abs(x).max(), abs(q).max()) ** 2 * d < 1 << 52  # else sums of doubles may round
                xf, qf = x.astype(float), q.astype(float)
                x2, q2 = (xf * xf).sum(1), (qf * qf).sum(1)
                slack = 1e-6 * (q2.max() + x2.max()) + 1
                for i in range(len(q)):
                    low = np.abs(dx - dq[i]).max(1, initial=0.0)
                    bound = (q2[i] + x2 - low * low) / 2 + slack
                    own = best.setdefault(int(q_rows[i]), [int(q_ids[i]), np.zeros(0, np.int64), np.zeros(0, np.int64), 0])
                    _, scores, found, n = own
                    live = np.flatnonzero((bound >= scores[k - 1]) & (x_ids != q_ids[i]) if len(scores) >= k else x_ids != q_ids[i])
                    live, at = live[np.argsort(-bound[live])], 0
                    while at < len(live) and (len(scores) < k or bound[live[at]] >= scores[k - 1]):
                        some = live[at : at + _STEP]
                        at += _STEP
                        got = np.rint(xf[some] @ qf[i]).astype(np.int64) if exact else x[some] @ q[i]
                        scores, found = np.concatenate([scores, got]), np.concatenate([found, x_ids[some]])
                        top = np.lexsort((found, -scores))[:k]
                        scores, found = scores[top], found[top]
                    own[1:] = scores, found, n + min(at, len(live))
                if len(best) * k > HELD:
                    yield out()
        yield out()

    return run


def top_k(vectors: DataFrame, *, k: int = 10, scale: int = 1024, every: int = 100, counted: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product for each row whose vec_id
    is divisible by ``every``; with ``counted`` also ``evaluated``, how many candidates of the query had their score computed."""
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding"), scale).alias("v"))
    row = F.xxhash64("vec_id", "v")
    usual = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).select("d")
    order = Window.partitionBy(F.size("v")).orderBy(row, "vec_id")
    sample = vectors.join(F.broadcast(usual), F.size("v") == F.col("d"), "left_semi").withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).select("v").collect()
    lengths = {len(r.v) for r in sample}
    pivots = spark.sparkContext.broadcast({d: far_apart(np.array([r.v for r in sample if len(r.v) == d], float), PIVOTS) for d in lengths})
    packed = [x.select(row.alias("row"), "vec_id", "v").mapInArrow(_pack(pivots), _PACKED) for x in (vectors, vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]))]
    table, queries = (cut(x) for x in packed)
    grid = table.crossJoin(queries.toDF(*(f"q_{c}" for c in queries.columns)))  # of blocks: an equi join by length would be one task's
    hits = grid.mapInArrow(_search(k), _HITS)
    own = Window.partitionBy("query_id", "query_row")
    ranked = hits.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).withColumn("evaluated", F.sum("evaluated").over(own))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *(["evaluated"] if counted else []))
