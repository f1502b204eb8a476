"""Brute force on small fixtures: nulls, empty and repeated rows, ties, extra columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import decontamination, language_id, lm_scoring, near_dedup, quality, segmentation, sharding, substring_dedup, tokens as tk, topk_search, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string"


def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 1, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


TEXTS = [None, "", "  ", "One two one", "one TWO one", " ".join(f"w{i % 70}" for i in range(300)), "é É x", "a " * 120, "b " + "a " * 130, *["same text of copies here"] * 5, "\t".join(f"q{i}" for i in range(90))]


def test_lm_base_score(spark):
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs(spark, TEXTS)).collect()}
    c = Counter(w for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), ""])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), ""])
        assert got[i].base_score == pytest.approx(want) and got[i].train_tokens == n and math.isfinite(got[i].score)


def test_lm_in_groups_of_shards(spark):
    one, many = (sorted(map(tuple, lm_scoring.score_documents(docs(spark, TEXTS), broadcast_bytes=b).collect())) for b in (1 << 20, 64))
    assert one == many


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6) / 8]) for i in range(120)] + [(200, None), (300, [None] * 6), (400, [float("nan")] * 6)]
    got = [tuple(x) for x in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    x = np.floor(1024 * np.array([v for _, v in rows[:120]])).astype(int)
    want = [(q, k + 1, i, -s) for q in (0, 100) for k, (s, i) in enumerate(sorted((-int(x[q] @ x[j]), j) for j in range(120) if j != q)[:10])]
    assert sorted(got) == sorted(want)


def test_shards_and_a_hot_key(spark):
    rows = [(i, "x" * 100) for i in range(200)] + [(7, "x" * 100)] * 100 + [(None, None)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=1500).collect()
    assert len(got) == len(rows)
    sums = Counter()
    for r in got:
        sums[r.shard] += r.n_bytes
    assert max(sums.values()) <= 1500 and all(sums[r.shard] == r.shard_bytes for r in got)


def test_decontamination(spark):
    items = [(1, "Alpha beta, gamma DELTA e f g h i j k"), (2, "short item"), (3, None), (4, "")]
    texts = ["x alpha beta gamma delta e f g h i j k y", "a short-item", "alpha beta gamma", None, "", "short item short item"]
    got = {r.doc_id: r for r in decontamination.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [(got[i].n_hit, sorted(got[i]["items"])) for i in range(6)] == [(11, [1]), (2, [2]), (0, []), (0, []), (0, []), (4, [2])]


def test_warc_ranges(spark, tmp_path):
    pages = [(i, f"http://h/{i}", None if i % 9 == 0 else f"page {i % 40} " + "\x1f\x8b\x08" * 30) for i in range(100)]
    manifest = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/warc")
    for size in (64, 1000, 1 << 20):
        got = warc.read_warc(manifest, split_bytes=size).select(warc.page_id("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to_id").alias("r")).collect()
        first = {}
        for i, _, h in pages:
            first.setdefault(h or "", i)
        want = {(i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages}
        assert {tuple(r) for r in got} == want and len(got) == 100


def test_near_duplicates(spark):
    r = np.random.default_rng(2)
    base = [f"v{i}" for i in r.integers(0, 50, 60)]
    texts = [*TEXTS, *(" ".join(base[:k] + ["new"] + base[k:]) for k in range(0, 60, 3)), " ".join(base)]
    sets = [set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} - {()} for w in map(words, texts)]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {x.doc_id: x for x in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_substring_dedup(spark):
    r = np.random.default_rng(3)
    passage = [f"p{i}" for i in r.integers(0, 9, 55)]
    texts = [*TEXTS, *(" ".join([f"u{i}_{j}" for j in range(r.integers(0, 40))] + passage + [f"t{i}_{j}" for j in range(r.integers(0, 40))]) for i in range(12)), "a " * 60, "x " * 30 + "y " * 40, "x " * 28 + "y " * 35]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, w in enumerate(split):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for x in substring_dedup.remove_repeats(docs(spark, texts)).collect():
        w = split[x.doc_id]
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < x.doc_id for p in range(k, k + 50)}
        assert (x.n_words, x.n_removed) == (len(w), len(gone)) and x.kept_text == " ".join(t for p, t in enumerate(w) if p not in gone)


def test_segmentation(spark):
    got = segmentation.sample_segmentations(docs(spark, [*TEXTS[:7], "literal ▁ 猫\n\n  x", "a"]), k=3).collect()
    assert all(r.exact for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == 9 and len(by[0]) == len(by[1]) == 1
    for rows in by.values():
        assert len({bytes(r.pieces) for r in rows}) == len(rows)
        assert [r.perturbed for r in sorted(rows, key=lambda r: r.sample)] == sorted((r.perturbed for r in rows), reverse=True)


def test_language(spark):
    en, de = "the cat and the hat that sat with them", "der hund und die katze sind nicht im haus"
    rows = [(i, (en if i % 2 else de) + f" {w}", "en" if i % 2 else "de") for i, w in enumerate("abcdefghijklmnopqrst" * 4)] + [(900, None, "en"), (901, "12 !", None), (902, "the cat", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en" and 0 <= got[902].score <= 1


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    met = quality.classify(d, y).join(y, "doc_id").where("held_out")
    assert met.select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.85


def test_empty_tables(spark):
    none = docs(spark, ["x"]).where("doc_id > 5")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (lm_scoring.score_documents(none), sharding.assign_shards(none), quality.classify(none, labels), segmentation.sample_segmentations(none), near_dedup.near_duplicates(none), substring_dedup.remove_repeats(none), language_id.identify(none), decontamination.decontaminate(none, spark.createDataFrame([], "item_id long, text string"))):
        assert rows.count() == 0


def test_hashes_are_of_words_only():
    data = np.frombuffer(b"ab  AB\nab", np.uint8)
    h, bounds = tk.words(data, np.array([0, 4, 4, 9]), fold=True)
    assert bounds.tolist() == [0, 1, 1, 3] and len(set(h.tolist())) == 1
