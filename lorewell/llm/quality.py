"""Quality classification by a byte-level convolutional network in numpy (operator 4).

Filters of ``WIDTH`` bytes slide over every byte of the whole document; their rectified outputs are max-pooled over
chunks of ``2 * HALF`` bytes, which overlap by half; a hidden layer reads each chunk's pool, its units are max-pooled
over the chunks, and a logistic unit combines them into one probability. Chunk pools show both what a chunk holds
(symbol noise, capitals) and what it lacks (the variety of running text).

The network learns by Adam from at most ``SAMPLE`` labelled rows of at most ``LONGEST`` bytes, chosen by row hash.
Scoring is one pass without a shuffle with a broadcast of fixed size; a document's cost is
proportional to its bytes.

Defined cases: null and empty texts are one chunk of padding; rows without a label, or whose label isn't 0 or 1, teach
nothing; several labels of a document teach each; without labels of both kinds every score is 0.5; repeated rows are
answered each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm.lm_scoring import held_out
from lorewell.llm.shared import small_batches, text_chunks

WIDTH, FILTERS, EMBEDDING, HIDDEN, HALF = 5, 16, 8, 12, 128
SAMPLE, LONGEST, EPOCHS, BATCH, RATE = 2400, 1 << 15, 10, 24, 4e-3
PAD = 256
THRESHOLD = 0.7


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each padded to whole half chunks (one at least), and the half chunks' bounds."""
    sizes = np.diff(offsets)
    halves = np.maximum(1, -(-sizes // HALF))
    at = np.concatenate([[0], np.cumsum(halves)])
    out = np.full(at[-1] * HALF, PAD, np.int16)
    out[np.arange(len(data)) + np.repeat(at[:-1] * HALF - offsets[:-1], sizes)] = data
    return out, at


class ByteCNN:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (PAD + 1, EMBEDDING)),
            "k": r.normal(0, (WIDTH * EMBEDDING) ** -0.5 * 2, (WIDTH, EMBEDDING, FILTERS)),
            "kb": np.zeros(FILTERS),
            "w": r.normal(0, FILTERS**-0.5 * 1.4, (FILTERS, HIDDEN)), "wb": np.full(HIDDEN, 0.1),
            "o": r.normal(0, HIDDEN**-0.5, HIDDEN), "ob": np.zeros(1),
        }
        self.trained = False

    def _tables(self) -> np.ndarray:
        """Each filter's output for each byte at each of its places."""
        return np.einsum("be,oef->obf", self.p["e"], self.p["k"]).astype(np.float32)

    def _half_pools(self, tokens: np.ndarray, at: np.ndarray, tables: np.ndarray, where: bool = False):
        ends = at[1:] * HALF
        ids = np.concatenate([tokens, np.full(WIDTH - 1, PAD, np.int16)])
        n = len(tokens) // HALF
        pools = np.empty((n, FILTERS), np.float32)
        places = np.empty((n, FILTERS), np.int64) if where else None
        step = 256
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            own = ids[lo * HALF : hi * HALF + WIDTH - 1]
            out = tables[0].take(own[: len(own) - WIDTH + 1], axis=0)
            for o in range(1, WIDTH):
                out += tables[o].take(own[o : len(own) - WIDTH + 1 + o], axis=0)
            own_ends = ends[np.searchsorted(ends, lo * HALF, "right") : np.searchsorted(ends, hi * HALF, "right")]
            for k in range(1, WIDTH):  # a filter reads padding beyond its text, not the next text
                out[own_ends - k - lo * HALF] = sum(tables[o].take(ids[own_ends - k + o] if o < k else np.full(len(own_ends), PAD), axis=0) for o in range(WIDTH))
            out = out.reshape(hi - lo, HALF, FILTERS)
            pools[lo:hi] = out.max(1)
            if where:
                places[lo:hi] = out.argmax(1) + np.arange(lo, hi)[:, None] * HALF
        return pools, places

    @staticmethod
    def _chunks(pools: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Overlapping chunks: each half chunk with its successor in the same text; and which half holds the larger."""
        after = np.concatenate([pools[1:], pools[-1:]])
        last = np.zeros(len(pools), bool)
        last[at[1:] - 1] = True
        second = (after > pools) & ~last[:, None]
        return np.where(second, after, pools), second

    def _head(self, pools: np.ndarray, at: np.ndarray):
        x, second = self._chunks(pools, at)
        x = np.maximum(x + self.p["kb"], 0)
        h = np.maximum(x @ self.p["w"] + self.p["wb"], 0)
        top = np.maximum.reduceat(h, at[:-1], axis=0)
        return x, second, h, top, 1 / (1 + np.exp(-np.clip(top @ self.p["o"] + self.p["ob"], -30, 30)))

    def score(self, data: np.ndarray, offsets: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        if not self.trained:
            return np.full(len(offsets) - 1, 0.5)
        tokens, at = _padded(data, offsets)
        return self._head(self._half_pools(tokens, at, self._tables() if tables is None else tables)[0], at)[-1]

    def _gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        offsets = np.cumsum([0, *map(len, texts)])
        tokens, at = _padded(np.frombuffer(b"".join(texts), np.uint8), offsets)
        pools, places = self._half_pools(tokens, at, self._tables(), where=True)
        x, second, h, top, p = self._head(pools, at)
        g = {}
        d = (p - labels) * weights
        g["o"], g["ob"] = top.T @ d, np.array([d.sum()])
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        is_top = (h == top[doc]) & (h > 0)
        dh = is_top * (d[:, None] * self.p["o"])[doc]
        g["w"], g["wb"] = x.T @ dh, dh.sum(0)
        dx = (dh @ self.p["w"].T) * (x > 0)
        g["kb"] = dx.sum(0)
        half = np.arange(len(pools))[:, None] + second
        chunk, f = np.nonzero(dx)
        value, at_byte = dx[chunk, f], places[half[chunk, f], f]
        end = (at[1:] * HALF)[doc[chunk]]
        ids = np.concatenate([tokens, np.full(WIDTH - 1, PAD, np.int16)])
        g["k"], g["e"] = np.zeros_like(self.p["k"]), np.zeros_like(self.p["e"])
        for o in range(WIDTH):
            b = np.where(at_byte + o < end, ids[at_byte + o], PAD)
            table = np.zeros((PAD + 1, FILTERS))
            np.add.at(table, (b, f), value)
            g["k"][o] = self.p["e"].T @ table
            g["e"] += table @ self.p["k"][o].T
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> ByteCNN:
        if len(set(labels.tolist())) < 2:
            return self
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                g = self._gradients([texts[i] for i in some], labels[some], np.full(len(some), 1 / len(some)))
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - RATE * (0.5 ** (epoch // 3)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.trained = True
        return self


def train(docs: DataFrame, labels: DataFrame) -> ByteCNN:
    labels = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= LONGEST)
    n = labels.count()
    if not n:
        return ByteCNN()
    dealt = F.pmod(F.xxhash64("label_id"), F.lit(1_000_003))
    few = labels.where(dealt < min(1.0, 1.3 * SAMPLE / n) * 1_000_003).limit(2 * SAMPLE)  # bounded: it may be broadcast
    rows = texts.join(F.broadcast(few), "label_id").select("text", "quality", dealt.alias("k")).limit(2 * SAMPLE).collect()
    rows = sorted(rows, key=lambda r: (r.k, r.text, r.quality))[:SAMPLE]
    return ByteCNN().fit([r.text.encode() for r in rows], np.array([r.quality for r in rows], int))


def classify(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score (that quality is 1), predicted."""
    small_batches(docs.sparkSession)
    held = held_out(F.col("doc_id"), modulus, remainder)
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value._tables()
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, trimmed=False):
                score = model.value.score(data, offsets, tables)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
