"""Operators do the whole job, beyond what the small tables show."""

import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell.llm import language_id, lm_scoring, near_dedup, segmentation, shared, substring_dedup


def test_near_dedup_of_a_text_inside_another(spark):
    """1200 of 1499 shingles, of whose 64 smallest hashes only 37 are shared."""
    words = [f"w2864x{i}" for i in range(1500)]
    rows = [(1, " ".join(words)), (2, " ".join(words[110:1311]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 1499, 1), (2, 1200, 1)}


def test_every_language_is_learned(spark):
    rows = [(f"l{i:02d}", f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)} {j}") for i in range(70) for j in range(3)] + [("long", "12 " + "word " * 20_000)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == sorted({x for x, _ in rows})
    texts = [(chr(0x4E00 + i) * 3).encode() for i in range(70)] + [b"word word"]
    assert model.predict(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))[0] == model.languages


def test_a_written_table_leaves_no_shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()

    def shuffled():
        files = env.blockManager().diskBlockManager().getAllFiles()
        return {str(f) for i in range(files.size()) if "shuffle_" in str(f := files.apply(i))}

    before, df = shuffled(), spark.range(400_000).groupBy(F.xxhash64("id").alias("id")).count()
    assert shared.cut(df).count() == 400_000
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not [f for f in left if os.path.getsize(f) > 10_000]
    assert spark.conf.get(shared.FREED, None) is None


def test_probes_of_a_large_filter_take_little_disk(spark, monkeypatch):
    """Texts go compressed, of the probes only the levels are written."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"word{int(x)}" for x in r.geometric(0.002, 3000)) for _ in range(60)]
    rows, written = [*enumerate(texts), (60, ""), (61, None)], []
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    want = sorted((x.doc_id, x.n_tokens, x.n_known, x.base_score, x.score) for x in lm_scoring.score_documents(docs).collect())

    def cut(df):
        out = shared.cut(df)
        top = out._cut_path.removeprefix("file://")
        written.append((df.columns, sum(os.path.getsize(f"{top}/{f}") for f in os.listdir(top))))
        return out

    monkeypatch.setattr(lm_scoring, "cut", cut)
    for chunk in (lm_scoring.CHUNK, 50_000):  # several parts a chunk, and several chunks
        monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
        got = sorted((x.doc_id, x.n_tokens, x.n_known, x.base_score, x.score) for x in lm_scoring.score_documents(docs, broadcast_bytes=64).collect())
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert [x for w in got for x in w[3:]] == pytest.approx([x for w in want for x in w[3:]])
    asked = max(size for columns, size in written if "chunk" in columns)
    assert asked < 0.6 * sum(map(len, texts))


def test_segmentation_gives_memory_back_with_its_lattices(monkeypatch):
    """Workers live on: what a full store of lattices took doesn't stay with them."""
    given = []
    monkeypatch.setattr(segmentation, "trim", lambda: given.append(1), raising=False)
    monkeypatch.setattr(segmentation, "KEPT", 20)
    lat = segmentation.Lattices(segmentation.Vocabulary.load(segmentation.MODEL), 0.3)
    for text in (b"the first words of some text", b"other words that follow", b"and more"):
        segmentation.sample_chunk(lat, np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.ones(1, np.uint64), 2)
    assert len(given) == 2


def test_segmentation_works_on_chunks_not_texts(monkeypatch):
    """Draws are made for all texts of a chunk at once, and what is kept isn't copied to add to it."""
    v, calls, mix = segmentation.Vocabulary.load(segmentation.MODEL), [], segmentation.tk.mix

    def sample(lat, texts):
        calls.clear()
        data = np.frombuffer(b"".join(texts), np.uint8)
        segmentation.sample_chunk(lat, data, np.cumsum([0, *map(len, texts)]), np.arange(len(texts)).astype(np.uint64), 2)
        return len(calls)

    monkeypatch.setattr(segmentation.tk, "mix", lambda x: calls.append(1) or mix(x))
    lat = segmentation.Lattices(v, 0.3)
    few = sample(lat, [b"some words of a text"] * 3)
    kept = lat.lp
    assert sample(lat, [b"some words of a text"] * 60 + [b"another"]) <= few + 40  # lengths of the new part, no draw a text
    assert len(lat.lp) > len(kept) and np.shares_memory(lat.lp, kept)


def test_segmentation_takes_little_memory(spark, monkeypatch):
    """A worker's arrays beside its batch and what it keeps: those of one chunk."""
    monkeypatch.setattr(segmentation, "KEPT", 1 << 12)
    caught, docs = [], spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
    segmentation.sample_segmentations(docs)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoinshr"), 7)) for _ in range(30_000)]
    texts = [" ".join(rng.choice(words, 250)) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), pa.array(texts), pa.array(range(700), pa.int64())], names=["doc_id", "text", "key"])
    tracemalloc.start()
    try:
        n = sum(x.num_rows for x in caught[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert n == 1400
    assert peak < 75, peak


def test_segmentation_solves_new_parts_a_few_at_a_time(monkeypatch):
    """Building lattices takes many arrays; the parts of a chunk aren't all built at once, and give the same."""
    rng = np.random.default_rng(6)
    data = np.frombuffer(" ".join("".join(rng.choice(list("etaoinshr"), 7)) for _ in range(30_000)).encode(), np.uint8)
    v, sizes, built = segmentation.Vocabulary.load(segmentation.MODEL), [], segmentation.Lattice
    sample = lambda: segmentation.sample_chunk(segmentation.Lattices(v, 0.3), data, np.array([0, len(data)]), np.ones(1, np.uint64), 2)[0]
    monkeypatch.setattr(segmentation, "Lattice", lambda v, data, *a: sizes.append(len(data)) or built(v, data, *a))
    some = sample()
    assert max(sizes) <= 1 << 16
    monkeypatch.setattr(segmentation, "NEW", 1 << 30)
    sizes.clear()
    for (e, *x), (f, *y) in zip(some, sample(), strict=True):
        assert (e == f).all() and x == y
    assert len(sizes) == 1


def test_repeats_are_removed_with_one_worker_a_task(spark):
    """Workers that a stage of two Python steps starts stay on the executors for all that follows."""
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, "a " + words), (3, "b")], "doc_id long, text string")
    found = substring_dedup.remove_repeats(docs)

    def steps(node, n=0):
        n = 0 if "Join" in node.nodeName() or "Exchange" in node.nodeName() else n + ("MapInArrow" in node.nodeName())
        below = node.children()
        return max([n, *(steps(below.apply(i), n) for i in range(below.size()))])

    assert steps(found._jdf.queryExecution().sparkPlan()) == 1
    assert [(r.doc_id, r.n_removed, r.kept_text) for r in found.orderBy("doc_id").collect()] == [(1, 0, words), (2, 60, "a"), (3, 0, "b")]


def test_states_are_taken_in_parts(monkeypatch):
    text = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(range(6), pa.int64()), pa.array([" ".join(f"w{i}" for i in range(100_000))] * 6)], names=["rk", "id", "text"])
    states = pa.Table.from_batches(substring_dedup._first_task(50)(iter([text]))).combine_chunks().to_batches()[0]
    states = states.append_column("known", states.column(states.schema.get_field_index("ask")))
    sizes, state = [], substring_dedup._state
    monkeypatch.setattr(substring_dedup, "_state", lambda rk, ids, n, *a: sizes.append(int(n.sum())) or state(rk, ids, n, *a))
    assert sum(x.num_rows for x in substring_dedup._next_task(50, 1)(iter([states]))) == 6
    assert sum(sizes) == 600_000 and max(sizes) <= 1 << 18


def test_languages_are_counted_without_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "some words"), ("de", "ein paar")], "lang string, text string").coalesce(1).cache()
    docs.count()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("rows of Python objects"))
    assert language_id.train(docs).languages == ["de", "en"]
