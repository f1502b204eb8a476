"""The stages of the corpus pipeline, each against brute force on its own input."""

import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from lorewell.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with exact and near copies, a shared passage, a benchmark passage, noise, nulls and repeated ids."""
    r, sf = np.random.default_rng(11), str(tmp_path_factory.mktemp("corpus"))
    letters = ["ka", "lo", "mi", "tu", "re", "sa", "no", "vi"]
    word = lambda: "".join(r.choice(letters, r.integers(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item = text(70), text(14)
    texts = [text(int(n)) for n in r.integers(20, 200, 60)]
    texts += [texts[0], texts[0], texts[1] + " " + word(), f"{text(30)} {passage} {text(40)}", f"{text(25)} {passage}", f"{text(40)} {item} {text(9)}", passage]
    rows = [(i, t, "la", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(200, None, None, None, None), (201, "", "la", None, 0), (202, "1 2 3", None, "s", 5), (203, "zqxj wkzq " * 40, None, "s", 400), (3, text(50), "la", "t", 1), (4, texts[4], "la", "z", 2), (None, text(60), "la", "s", 3)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


@pytest.fixture(scope="module")
def staged(spark, corpus):
    """Each stage's input and output rows."""
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        after = pipeline.cut(stage(spark, docs, corpus))
        out[name] = docs, docs.collect(), after.collect(), after.columns
        docs = after
    return out


def bag(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_stages_keep_the_columns(staged):
    assert [n for n, _ in pipeline.STAGES] == list(staged)
    assert all(cols == ["doc_id", "text", "lang", "source", "n_chars"] for name, (*_, cols) in staged.items() if name != "segmentation")


def test_language_stage(staged):
    df, before, after, _ = staged["language"]
    rejected = {(r.doc_id) for r in language_id.identify(df).where("rejected").collect()}
    assert {200, 201, 202, 203} <= rejected and bag(after) == bag(r for r in before if r.doc_id not in rejected)
    assert len(after) >= len(before) - 6


def test_near_duplicate_stage(staged):
    _, before, after, _ = staged["near_duplicates"]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    rows = [(r.doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for r in before if r.doc_id is not None for w in [split(r.text)]]
    root = {i: i for i, _ in rows}
    for _ in range(4):
        for i, a in rows:
            for j, b in rows:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    kept = {i for i, x in root.items() if i == x}
    want = {(r.doc_id, r.text) for r in before if r.doc_id in kept or r.doc_id is None}
    assert {(r.doc_id, r.text) for r in after} == want and len(after) == len(want)
    assert {60, 61, 62}.isdisjoint(kept) and next(r.source for r in after if r.doc_id == 4) == "s"


def test_passage_stage(staged):
    _, before, after, _ = staged["repeated_passages"]
    first, key = {}, lambda r: float("inf") if r.doc_id is None else r.doc_id
    for r in before:
        w = r.text.split()
        for p in range(len(w) - 49):
            first[tuple(w[p : p + 50])] = min(first.get(tuple(w[p : p + 50]), float("inf")), key(r))
    want = []
    for r in before:
        w = r.text.split()
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < key(r) for q in range(p, p + 50)}
        if gone and len(gone) == len(w):
            continue
        text = " ".join(x for q, x in enumerate(w) if q not in gone) if gone else r.text
        want.append((r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars))
    assert bag(after) == bag(want) and len(after) < len(before)


def test_decontamination_stage(staged):
    _, before, after, _ = staged["decontamination"]
    assert bag(after) == bag(r for r in before if r.doc_id != 65) and len(after) == len(before) - 1


def test_segmentation_stage(spark, corpus, staged):
    _, before, after, _ = staged["segmentation"]
    assert all(r.exact for r in after) and {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sorted(map(str, pipeline.run(spark, corpus).collect())) == sorted(map(str, after))


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
