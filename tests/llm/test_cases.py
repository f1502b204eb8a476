"""Defined cases and brute force, operator by operator."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import decontamination, language_id, lm_scoring, near_dedup, quality, segmentation, sharding, shared, substring_dedup, topk_search, warc

LONG_TEXT = " ".join(f"w{i % 977}" for i in range(60_000))


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


# 1


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 64])
def test_lm_scores(spark, broadcast_bytes):
    """Quantised counts, Witten-Bell; a filter so large that it errs nowhere."""
    r = np.random.default_rng(0)
    texts = [None, "", "One two one", "a " * 30, LONG_TEXT, *(" ".join(f"w{int(x)}" for x in r.geometric(0.05, r.integers(1, 80))) for _ in range(100))]
    rows = [*enumerate(texts), (None, "w1 w2"), (5, "w3 w3"), (5, "w3 w3")]
    train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    both = Counter(b for t in train for b in zip([None, *t], t))
    kinds = Counter(h for h, _ in both)
    meant = lambda x: float(lm_scoring._MEANT[lm_scoring.levels_of(np.array([x]))[0]])

    def score(t):
        out = 0.0
        for h, w in zip([None, *t], t):
            p, k, held = (meant(c[w]) + 1) / (n + v + 1), meant(kinds[h]), len(train) if h is None else meant(c[h])
            out += math.log10((min(meant(both[h, w]), held) + k * p) / max(held + k, 1) if k > 0 else p)
        return out

    want = [(str(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5), round(score(t), 5)) for i, t in ((i, tokens(t)) for i, t in rows)]
    found = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=broadcast_bytes, bits_per_entry=400).collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5), round(x.score, 5)) for x in found) == sorted(want)


def test_lm_without_training_rows(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    x = lm_scoring.score_documents(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(x.score)


# 2


def best_of(rows, every=100, k=10):
    usable = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {(i, tuple(v)) for i, v in usable if i % every == 0}
    return sorted((i, r + 1, j, s) for i, q in queries for r, (s, j) in enumerate([(-a, b) for a, b in sorted((-int(np.dot(q, v)), j) for j, v in usable if j != i and len(v) == len(q))][:k]))


def test_top_k_cases(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 1, 4 if i % 3 else 5)]) for i in range(250)]
    rows += [(300, rows[4][1]), (300, rows[4][1]), (400, [math.inf] * 4), (401, [None, 1.0]), (402, []), (None, rows[4][1]), (500, None), (7, rows[7][1]), (600, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string").repartition(5)
    assert rows_of(topk_search.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(best_of(rows), key=str)
    assert topk_search.top_k(df.where("vec_id < 0")).count() == 0


def test_pivots_spare_candidates(spark):
    r = np.random.default_rng(2)
    at = r.normal(0, 4, (12, 3))
    rows = [(i, [float(x) for x in at[i % 12] / np.linalg.norm(at[i % 12]) * 4 + r.normal(0, 0.05, 3)]) for i in range(3000)]
    found = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), counted=True)
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(best_of(rows), key=str)
    assert found.where("rank = 1").agg(F.avg("evaluated")).first()[0] < 0.5 * 3000


def test_pivots_are_far_apart():
    x = np.array([[0.0, 0], [0.1, 0], [5, 0], [5, 0.1], [0, 5], [0, 0]])
    assert topk_search.far_apart(x, 3).tolist() == [[0, 0], [5, 0.1], [0, 5]]
    assert len(topk_search.far_apart(x, 9)) == 5 and len(topk_search.far_apart(x[:0], 3)) == 0


# 3


def test_a_row_above_the_limit(spark):
    rows = [(i, "y" * (5000 if i == 3 else 10), 0) for i in range(50)] + [(None, None, 0)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int"), limit=200).collect()
    assert len(got) == len(rows)
    big = next(x for x in got if x.doc_id == 3)
    assert big.oversized and big.shard_bytes == 5000 and not any(x.oversized for x in got if x.doc_id != 3)


# 4


def test_quality_cases(spark):
    r = np.random.default_rng(3)
    good = [" ".join(r.choice(["the", "river", "runs", "over", "stones", "quietly"], 40)) + "." for _ in range(120)]
    bad = ["".join(r.choice(list("#$%&*@!0123456789"), 200)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(x for pair in zip(good, bad) for x in pair)] + [(1000, None), (1001, ""), (1002, LONG_TEXT), (1002, LONG_TEXT), (None, good[0])]
    docs = spark.createDataFrame([(i, t, 0.0, "z") for i, t in rows], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(240)] + [(0, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 240]
    assert len(held) > 30 and all((x.score > 0.5) == (x.doc_id % 2 == 0) for x in held)
    assert len({x.score for x in got if x.doc_id == 1002}) == 1 and next(x for x in got if x.doc_id is None).score > 0.5
    one = quality.classify(docs, labels.where("quality = 1")).collect()
    assert {x.score for x in one} == {0.5} and len(one) == len(rows)


def test_quality_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    met = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    order = met.score.rank()
    pos = met.quality == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.98 and (met.predicted[~pos] == 0).mean() > 0.9 and (met.predicted[pos] == 1).mean() > 0.9


def test_convolution_by_hand():
    net = quality.ByteCNN(3)
    net.trained = True
    net.p["kb"], net.p["o"] = np.random.default_rng(0).normal(0, 1, quality.FILTERS), np.ones(quality.HIDDEN)
    texts = [b"", b"abc", bytes(range(256)) * 3, b"x" * 129]

    def score(text):
        ids = [*text, *[quality.PAD] * (max(1, -(-len(text) // quality.HALF)) * quality.HALF - len(text))]
        padded = [*ids, *[quality.PAD] * (quality.WIDTH - 1)]
        out = np.array([sum(net.p["e"][padded[i + o]] @ net.p["k"][o] for o in range(quality.WIDTH)) for i in range(len(ids))])
        halves = [out[i : i + quality.HALF].max(0) for i in range(0, len(ids), quality.HALF)]
        chunks = [np.maximum(a, b) for a, b in zip(halves, [*halves[1:], halves[-1]])]
        hidden = [np.maximum(np.maximum(c + net.p["kb"], 0) @ net.p["w"] + net.p["wb"], 0) for c in chunks]
        return 1 / (1 + np.exp(-(np.max(hidden, 0) @ net.p["o"] + net.p["ob"][0])))

    got = net.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert got == pytest.approx([score(t) for t in texts], abs=1e-4)


# 5


@pytest.fixture(scope="module")
def pieces():
    return segmentation.Vocabulary([b" ", b"a", b"b", b"ab", b"aba", b" a", b"ba", *(bytes([x]) for x in range(256))], list(range(7, 263)))


def enumerated(v, text, alpha):
    """Every segmentation's ids and probability."""
    own = b" " + text if text else b""
    by = {}
    for i, (s, n) in enumerate(zip(v.start.tolist(), v.size.tolist())):
        if i < 7:
            by[v.flat[s : s + n].tobytes()] = i

    def ways(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in by:
                yield from ((by[rest[:n]], *w) for w in ways(rest[n:]))
        if rest and rest[:1] not in by:
            yield from ((7 + rest[0], *w) for w in ways(rest[1:]))

    found = list(ways(own))
    weight = np.exp([alpha * sum(v.log_weight[i] for i in w) for w in found])
    return dict(zip(found, weight / weight.sum()))


@pytest.mark.parametrize("text", [b"abab", b"ab aba", b"a", b"cb", b""])
def test_probabilities_and_distinct_samples(pieces, text):
    want = enumerated(pieces, text, 0.3)
    lat = segmentation.Lattices(pieces, 0.3)
    for key in range(20):
        found = segmentation.sample_chunk(lat, np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([key + 1], np.uint64), len(want) + 2)[0]
        got = {tuple(ids.tolist()): math.exp(lp) for ids, lp, _, _ in found}
        assert got == pytest.approx(want) and len(found) == len(want) and all(s == 1.0 for *_, s in found)
        assert [t for _, _, t, _ in found] == sorted((t for _, _, t, _ in found), reverse=True)


def test_samples_follow_the_probabilities_and_inclusion_scores(pieces):
    """Over many keys the first sample has the segmentation's probability, and 1 / inclusion makes counts unbiased."""
    text, k, n = b"abaab", 2, 3000
    want = enumerated(pieces, text, 0.3)
    lat = segmentation.Lattices(pieces, 0.3)
    data, offsets = np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text)
    first, unbiased = Counter(), Counter()
    for found in segmentation.sample_chunk(lat, data, offsets, np.random.default_rng(0).integers(1, 1 << 62, n).astype(np.uint64), k):
        first[tuple(found[0][0].tolist())] += 1 / n
        for ids, lp, _, inclusion in found:
            unbiased[tuple(ids.tolist())] += math.exp(lp) / inclusion / n
    assert all(abs(first[w] - p) < 5 * math.sqrt(p / n) + 1e-3 for w, p in want.items())
    assert sum(unbiased.values()) == pytest.approx(1, abs=0.03) and all(abs(unbiased[w] - p) < 0.03 for w, p in want.items())


def test_segmentation_cases(spark):
    rows = [(1, "same words here"), (1, "same words here"), (None, "same words here"), (2, None), (3, "x" * 200_000), (4, "é 猫 🙂\n\t ▁ end  ")]
    got = segmentation.sample_segmentations(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, sample int")).collect()
    assert all(x.exact for x in got)
    alike = [tuple(sorted((x.sample, bytes(x.pieces)) for x in got if x.doc_id == 1))]
    assert len(alike[0]) == 4 and len(set(alike[0])) == 2
    assert {x.doc_id for x in got} == {None, 1, 2, 3, 4} and [x.n_pieces for x in got if x.doc_id == 2] == [0]


# 6


def leaked(docs, items, length=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - length + 1) if w and i is not None else 0):
            wins.setdefault(tuple(w[k : k + length]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, met = split(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    met |= ids
        out.append((d, len(w), len(hit), sorted(met)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", [(1 << 26, 1 << 20), (1 << 26, 0), (0, 1 << 20), (0, 0)])
def test_decontamination_by_every_path(spark, monkeypatch, bounds):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", bounds[0])
    monkeypatch.setattr(decontamination, "LITERAL_BYTES", bounds[1])
    r = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(12)] + ["É1", "zz"]
    items = [(i, " ".join(r.choice(vocabulary, n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 30])] + [(None, "t1 t2 t3"), (3, "Zz ZZ zz"), (3, "Zz ZZ zz"), (8, None), (9, "..,")]
    docs = [(i, " ".join(r.choice(vocabulary, r.integers(0, 40))) + (f", {items[r.integers(4, 8)][1].upper()}!" if i % 3 == 0 else "")) for i in range(40)]
    docs += [(50, None), (51, ""), (None, "zz ZZ zz"), (3, "again"), (3, "again"), (60, LONG_TEXT + " " + items[6][1])]
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in docs], "doc_id long, text string, n_hit int, rare string")
    got = decontamination.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, sorted(x["items"])) for x in got), key=str) == leaked(docs, items)
    assert all(x.contaminated == (x.n_hit > 0) and x.n_items == len(x["items"]) and x.hits == sorted(x.hits) for x in got)


# 7


def test_warc_cases(spark, tmp_path):
    pages = [(5, "u", "same"), (2, None, "same"), (2, "v", "same"), (None, "n", "same"), (7, "x y", ""), (8, "z", None), (9, "w", "short"), (10, "w", "short"), (None, None, "lone")]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, digest string, h int")
    read = lambda least: rows_of(warc.read_warc(warc.write_warc(df, f"file://{tmp_path}/w{least}", least_bytes=least)).select(warc.page_id("record_id").alias("p"), "record_type", "payload_bytes", warc.page_id("refers_to_id").alias("r")), "p", "record_type", "payload_bytes", "r")
    assert read(0) == sorted([(5, "revisit", 4, 2), (2, "response", 4, None), (2, "response", 4, None), (None, "revisit", 4, 2), (7, "response", 0, None), (8, "revisit", 0, 7), (9, "response", 5, None), (10, "revisit", 5, 9), (None, "response", 4, None)], key=str)
    assert [x[1] for x in read(5) if x[1] == "revisit"] == ["revisit"]
    assert warc.read_warc(warc.write_warc(df.where("page_id > 99"), f"file://{tmp_path}/none")).count() == 0


class Counted:
    def __init__(self, data):
        self.data, self.place, self.read_bytes = data, 0, 0

    def seek(self, place):
        self.place = place

    def read(self, n):
        out = self.data[self.place : self.place + n]
        self.place, self.read_bytes = self.place + len(out), self.read_bytes + len(out)
        return out


def test_warc_reads_once_and_reports_damage():
    r = np.random.default_rng(6)
    members = [warc.record(i, "u", r.bytes(int(r.choice([0, 10, 1500, 40_000]))), None, False) for i in range(600)]
    data = b"".join(members)
    f = Counted(data)
    assert len(list(warc.read_range(f, 0, len(data)))) == 600 and f.read_bytes < 1.01 * len(data)
    damaged = bytearray(data)
    at = sum(map(len, members[:100]))
    damaged[at + 30] ^= 255
    for split in (len(data), 300_000):
        found = [x for lo in range(0, len(data), split) for x in warc.read_range(Counted(bytes(damaged)), lo, min(len(data), lo + split))]
        lost = [(a, int(h["warc-payload-length"])) for a, h, _ in found if h["warc-type"] == "damaged"]
        assert lost == [(at, len(members[100]))] and len(found) == 600


# 8


def linked(texts, ids, width):
    sets = []
    for t in texts:
        w = tokens(t)[:-1]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 10 >= 8 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(ids[i]), find(ids[j])
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets))


@pytest.mark.parametrize("seed,width,few,block", [(0, 2, None, None), (1, 5, None, None), (2, 2, 1, 8), (3, 5, 1, 8)])
def test_near_duplicates_of_all_sizes(spark, monkeypatch, seed, width, few, block):
    """Sets of 1 to 2000 shingles, at the bar from both sides; once with every list long and blocks of 8."""
    if few:
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = np.random.default_rng(seed)
    texts = [None, "", " ", "A b", "a B"]
    for size in r.choice([3, 6, 20, 60, 70, 90, 150, 400, 2000], 22):
        base = [f"v{i}" for i in r.integers(0, [30, 200, 5000][seed % 3], size)]
        texts.append(" ".join(base))
        for part in range(6):
            x = list(base)
            if part % 3 == 0:
                x += [f"n{r.integers(0, 9999)}" for _ in range(int(size * r.choice([0.1, 0.24, 0.26])))]
            elif part % 3 == 1:
                x = x[: int(size * r.choice([0.79, 0.81, 0.9]))]
            else:
                for p in r.integers(0, size, max(1, int(size * r.choice([0.01, 0.03, 0.05])))):
                    x[p] = f"n{r.integers(0, 9999)}"
            texts.append(" ".join(x))
    ids = [int(i) + 1 for i in r.permutation(len(texts))]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), width=width).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == linked(texts, ids, width)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_cases(spark):
    base = [f"a{i}" for i in range(100)]
    rows = [(5, " ".join(base)), (5, " ".join(base)), (5, "other text of five"), (3, " ".join([*base, "end"])), (9, "other text of five"), (None, " ".join(base)), (None, None), (1, None), (7, LONG_TEXT)]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n int, rep string")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, x.component_id, x.kept) for x in got} == {(5, 3, False), (3, 3, True), (9, 3, False), (None, None, True), (1, 1, True), (7, 7, True)} or {(x.doc_id, x.component_id) for x in got if x.n_shingles > 50 and x.doc_id in (3, 5)} == {(5, 3), (3, 3)}
    assert next(x for x in got if x.doc_id == 1).n_shingles == 0


def test_links_at_the_bar_are_kept(spark):
    """Planted pairs at exactly 0.8 where one set is the other with a quarter added, the worst case for sketches."""
    sizes = [80, 200, 800, 2000] * 60
    rows = []
    for i, n in enumerate(sizes):
        w = [f"p{i}x{j}" for j in range(n + n // 4 + 1)]
        rows += [(2 * i, " ".join(w[: n + 1])), (2 * i + 1, " ".join(w))]
    got = {x.doc_id: x for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[2 * i + 1].component_id for i in range(len(sizes))] == [2 * i for i in range(len(sizes))]


# 9


def test_filter_of_ids(spark):
    bits = shared.id_filter(spark.range(0, 3000, 3))
    found = shared.in_filter(bits, np.arange(3000))
    assert found[::3].all() and found.mean() < 0.5
    assert not shared.in_filter(shared.id_filter(spark.range(0)), np.arange(9)).any()


@pytest.mark.parametrize("seed", range(4))
def test_repeats_against_brute_force(spark, seed):
    """Null and shared ids, repeated rows, runs and periods, columns named as results and as working columns."""
    r = np.random.default_rng(seed)
    k = [2, 3, 20, 1000][seed]
    base = [f"p{i}" for i in r.integers(0, k, 400)]
    texts = [None, "", " ".join(base[:49]), " ".join(base[:50]), " ".join(base[:50]), "a " * 200, "b " + "a " * 60, "x y " * 80, "y x " * 70 + "z", " ".join(base), LONG_TEXT]
    for i in range(30):
        a = r.integers(0, 340)
        pad = lambda: [f"u{x}" for x in r.integers(0, k * 3, r.integers(0, 60))]
        texts.append(" ".join(pad() + base[a : a + r.integers(45, 120)] + pad() + (base[a : a + 60] if i % 3 == 0 else [])))
    ids = [int(x) for x in r.permutation(len(texts))]
    ids[7] = ids[8] = None
    ids[11] = ids[12]
    rows = [(i, t, 5, "k", 1) for i, t in zip(ids, texts)]
    rows += rows[3:6]
    key = lambda i: math.inf if i is None else i
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, split):
        for p in range(len(w) - 49):
            first[tuple(w[p : p + 50])] = min(first.get(tuple(w[p : p + 50]), math.inf), key(i))
    want = []
    for (i, *_), w in zip(rows, split):
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < key(i) for q in range(p, p + 50)}
        want.append((str(i), "k", 1, len(w), len(gone), " ".join(t for q, t in enumerate(w) if q not in gone)))
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, N_words int, rk string, id int").repartition(3))
    assert out.columns == ["doc_id", "rk", "id", "n_words", "n_removed", "kept_text"]
    assert sorted((str(x.doc_id), x.rk, x.id, x.n_words, x.n_removed, x.kept_text) for x in out.collect()) == sorted(want)


def test_symbols_inside_equal_windows_are_equal():
    """Whatever surrounds a window, its signature is the same, and other windows have others."""
    r = np.random.default_rng(8)
    for k in (2, 4, 50, 5000):
        window = r.integers(0, k, 50)
        texts = [np.concatenate([r.integers(0, k, r.integers(0, 30)), window, r.integers(0, k, r.integers(0, 30))]) for _ in range(40)]
        names = substring_dedup.tk.mix(np.concatenate(texts).astype(np.uint64) + np.uint64(9))
        bounds = np.cumsum([0, *map(len, texts)])
        at = np.concatenate([np.arange(a, b - 49) for a, b in zip(bounds[:-1], bounds[1:])])
        doc = np.searchsorted(bounds, at, "right") - 1
        w, anchor, _ = substring_dedup.signatures(names, bounds, at, doc, 50)
        words = np.concatenate(texts)
        by = {}
        for i, p in enumerate(at):
            by.setdefault(tuple(words[p : p + 50]), set()).add((int(w[i]), int(anchor[i])))
        assert all(len(x) == 1 for x in by.values()) and len({s for x in by.values() for s, _ in x}) == len(by)


# 10


def test_kneser_ney_by_hand():
    text = "abracadabra abba"
    keys, place, _ = language_id.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    model = language_id.KneserNey(keys)
    s = [0 if c == " " else ord(c) for c in text]
    grams = [tuple(([0] * 4 + s)[i + 1 : i + 5]) for i in range(len(s))]
    counts = {4: Counter(grams)}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        n = len(g)
        own = counts[n]
        n1, n2 = sum(x == 1 for x in own.values()), sum(x == 2 for x in own.values())
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        total, kinds = sum(x for h, x in own.items() if h[:-1] == g[:-1]), sum(h[:-1] == g[:-1] for h in own)
        return (max(own[g] - d, 0) + d * kinds * p(g[1:])) / total if total else p(g[1:])

    wanted = [*grams, (97, 98, 98, 98), (1, 2, 3, 97), (1, 2, 3, 4)]
    coded = np.array([sum(int(x) << (16 * (3 - i)) for i, x in enumerate(g)) for g in wanted], np.uint64)
    assert model.probability(coded) == pytest.approx([p(g) for g in wanted])


def test_language_cases(spark):
    r = np.random.default_rng(9)
    en, de = ["the", "cat", "and", "hat", "that", "sat", "with", "them"], ["der", "hund", "und", "die", "katze", "sind", "nicht", "im"]
    rows = [(i, " ".join(r.choice(en if i % 2 else de, 20)), "en" if i % 2 else "de") for i in range(160)]
    odd = [(900, None, "en"), (901, "12 !", None), (902, "The CAT sat with them", None), (902, "The CAT sat with them", None), (903, "zzxq qqkw xxzz " * 20, None), (904, LONG_TEXT, None), (None, "der hund", "de"), (905, "", "en")]
    docs = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in rows + odd], "doc_id long, text string, lang string, score double")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows + odd)
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == g and not by[i].rejected for i, _, g in rows) and by[902].lang_pred == "en"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (900, 901, 905)) and by[903].rejected
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id", "text") == sorted(((i, t) for (i, t, _), x in zip(rows + odd, [by[i] for i, *_ in rows + odd]) if not x.rejected), key=str)


def test_a_tie_goes_to_the_smaller_language():
    model = language_id.Identifier([("b", "same words here"), ("a", "same words here")])
    text = b"same words"
    assert model.predict(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] == ["a"]


# all


def test_shared_folders(spark):
    df = shared.cut(spark.range(5))
    assert df.count() == 5
    shared.done(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._cut_path).count()
