"""Language identification by interpolated Kneser-Ney character models (operator 10).

One model of character 4-grams a language, each order a sorted array of 64-bit n-gram keys with counts (continuation
counts below the highest order). Letters are lower-cased; everything else is one boundary symbol. The prediction is
the language of the lowest cross-entropy a symbol. A text is rejected if that entropy lies above what calibration
texts of the language show, with a margin that grows for short texts, or if it has no letter. The score is the share
of the best language in the likelihoods; symbols beyond the hundredth weigh no more, or every long text had 1 (the
prediction reads them all). Letters above U+FFFF share symbols with others, as a key has 16 bits a symbol.

The models learn from every language that ``lang`` names: at most ``PER_LANGUAGE`` texts of each, chosen by row hash,
and fewer where there are more than ``LANGUAGES`` of them; every fourth of them calibrates. Of a text above ``LONGEST``
bytes a quarter as many characters from its first letter on are learned. Every text is scored whole, in one pass without
a shuffle; the rows learned are bounded by those parameters, and by one a language.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; ties go to the smaller
language name; null lang values are not learned; repeated rows are answered each; without training rows every text is
``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm.lm_scoring import held_out
from lorewell.llm.shared import small_batches, text_chunks, trim

ORDER = 4
PER_LANGUAGE, LONGEST, LANGUAGES = 400, 1 << 16, 64
SHORT_MARGIN = 8.0
U = np.uint64


@cache
def _symbols() -> np.ndarray:
    """For each code point its lower-case letter, folded to 16 bits, or 0 if it is no letter."""
    out = np.zeros(0x110000, U)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low if low < 0x10000 else low % 0xFFFF + 1
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each symbol, the bounds of each text's, and each text's number of letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = first[offsets]
    if bounds[-1] != len(points):  # invalid UTF-8
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        points, bounds = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, rows)])
    s = _symbols()[points]
    letters = np.diff(np.concatenate([[0], np.cumsum(s > 0)])[bounds])
    start = np.zeros(len(s) + 1, bool)
    start[bounds] = True
    keep = s > 0
    keep[1:] |= s[:-1] > 0
    keep |= start[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])[bounds]
    s, owner_start = s[keep], place[:-1]
    key, live = s.copy(), np.arange(len(s)) - np.repeat(owner_start, np.diff(place))
    for back in range(1, ORDER):
        before = np.zeros(len(s), U)
        before[back:] = s[:-back]
        key |= np.where(live >= back, before, U(0)) << U(16 * back)
    return key, place, letters


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


class KneserNey:
    """One language's model. Orders are from the highest down; a history is the key without its last symbol."""

    def __init__(self, keys: np.ndarray):
        self.orders = []
        own, n = np.unique(keys, return_counts=True)
        n = n.astype(float)
        for order in range(ORDER, 0, -1):
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 else 0.5
            history, total = _sum_by(own >> U(16), n)
            _, kinds = _sum_by(own >> U(16), np.ones(len(own)))
            self.orders.append((order, discount, own, n, history, total, kinds))
            mask = U((1 << (16 * (order - 1))) - 1)
            own, n = np.unique(own & mask, return_counts=True) if order > 1 else (own, n)
            n = n.astype(float)
        self.floor = 1.0 / (len(own) + 1)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), self.floor)
        for order, discount, own, n, history, total, kinds in reversed(self.orders):
            k = keys & U((1 << (16 * order)) - 1) if order < 4 else keys
            t = _get(history, total, k >> U(16))
            seen = t > 0
            held = discount * _get(history, kinds, k >> U(16)) * p + np.maximum(_get(own, n, k) - discount, 0)
            p = np.where(seen, held / np.maximum(t, 1), p)
        return p


class Identifier:
    """Models, and each language's bound on the entropy of its texts."""

    def __init__(self, rows: list[tuple[str, str]]):
        by: dict[str, list[bytes]] = {}
        for lang, text in rows:
            by.setdefault(lang, []).append(text.encode())
        self.languages = sorted(by)
        self.models = [KneserNey(self._of(by[x][: max(1, len(by[x]) * 3 // 4)])[0]) for x in self.languages]
        self.limit = np.full(len(self.languages), np.inf)
        for i, x in enumerate(self.languages):
            held = by[x][len(by[x]) * 3 // 4 :]
            key, place, letters = self._of(held)
            if len(held) >= 8 and (letters > 0).all():
                entropy = self.entropy(key, place)[:, i]
                over = entropy - SHORT_MARGIN / np.sqrt(np.diff(place))
                self.limit[i] = max(np.quantile(entropy, 0.5), over.max()) + 0.5

    @staticmethod
    def _of(texts: list[bytes]):
        return grams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    def entropy(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bits a symbol, a row for each text and a column for each language."""
        kinds, of = np.unique(key, return_inverse=True)
        n = np.maximum(np.diff(place), 1)
        sums = np.empty((len(n), len(self.models)))
        for i, m in enumerate(self.models):
            total = np.concatenate([[0.0], np.cumsum(-np.log2(m.probability(kinds))[of])])
            sums[:, i] = (total[place[1:]] - total[place[:-1]]) / n
        return sums

    def predict(self, data: np.ndarray, offsets: np.ndarray):
        key, place, letters = grams(data, offsets)
        n, known = np.diff(place), letters > 0
        if not self.models:
            return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), bool), np.zeros(len(n))
        h = self.entropy(key, place)
        best = h.argmin(1)
        low = h[np.arange(len(n)), best]
        score = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, 100)[:, None] * np.log(2)).sum(1)
        rejected = ~known | (low > self.limit[best] + SHORT_MARGIN / np.sqrt(np.maximum(n, 1)))
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0), rejected, np.where(known, low, 0.0)


def train(docs: DataFrame) -> Identifier:
    """docs: lang, text. Rows are chosen by their hash, in expectation half as many again as are used."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return Identifier([])
    most = min(PER_LANGUAGE, max(1, LANGUAGES * PER_LANGUAGE // len(counts)))
    # from Arrow, as rows of Python objects would start a second daemon on each executor, which stays
    shares = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([r[0] for r in counts], pa.string()), "share": [min(1.0, (1.5 * most + 20) / r[1]) for r in counts]})))
    text = F.when(F.octet_length("text") <= LONGEST, F.col("text")).otherwise(F.substring("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(LONGEST // 4)))
    dealt = F.pmod(F.xxhash64("lang", "text"), F.lit(1_000_003))
    rows = usable.join(shares, "lang").where(F.col("share") * 1_000_003 > dealt).select("lang", text.alias("text"), dealt.alias("k")).limit(2 * len(counts) * (most + 20)).collect()
    chosen: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.k, r.lang, r.text)):
        if len(chosen.setdefault(r.lang, [])) < most:
            chosen[r.lang].append((r.lang, r.text))
    return Identifier([x for v in chosen.values() for x in v])


def _predict(model, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, trimmed=False):
                lang, score, rejected, entropy = model.value.predict(data, offsets)
                kept = [c.slice(lo, hi - lo) for c in batch.columns[:columns]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(entropy)], names=[*batch.schema.names[:columns], "lang_pred", "score", "rejected", "entropy"])

    return run


_OUT = "lang_pred string, score double, rejected boolean, entropy double"


def identify(docs: DataFrame, *, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), rejected, entropy (bits a symbol)."""
    small_batches(docs.sparkSession)
    held = held_out(F.col("doc_id"), modulus, remainder)
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model, 2), "doc_id long, held_out boolean, " + _OUT)


def accepted(docs: DataFrame, *, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out(F.col("doc_id"), modulus, remainder)).select("lang", "text")))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch, trimmed=False):
                rejected = model.value.predict(data, offsets)[2]
                yield batch.slice(lo, hi - lo).filter(pa.array(~rejected))
        trim()

    return docs.mapInArrow(run, docs.schema)
