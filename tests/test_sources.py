"""Sources, sinks, embedders and the report."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell import index
from lorewell.functions import text as tx, vectors as vx
from lorewell.operators import graph, suggest
from lorewell.options import Options
from lorewell.sources import embedder, index_store, synthetic
from lorewell.streaming import changes


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.md").write_text("# One\nline")
    (tmp_path / "a/b/three.md").write_text("x")
    (tmp_path / "a/b/empty.md").write_text("")
    (tmp_path / "a/skip.txt").write_text("no")
    got = {r.basename: r for r in index_store.read_markdown(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "three"}  # Spark's file sources skip empty files
    assert got["one"].body == "# One\nline" and got["one"].folder.endswith("/a") and got["one"].mtime > 1_600_000_000_000


def test_evaluation_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"path": "a.md", "basename": "a", "links": ["b.md"], "body": "x"}, {"path": "b.md", "basename": "b", "links": [], "body": None}]))
    assert [(r.path, r.links, r.body) for r in index_store.read_json_corpus(spark, str(tmp_path / "c.json")).orderBy("path").collect()] == [("a.md", ["b.md"], "x"), ("b.md", [], None)]


def entries(spark):
    rows = [("a", 1, 2, 1, [1.0, 0.0], [([1, 2], 0.5)], None, "l", [0]), ("b", 2, 2, 2, [0.0, 1.0], [([1, 2], 0.5)], None, None, [0]), ("c", 3, 2, 1, [0.0, 1.0], [([3, 4], 0.5)], ["t"], "m", [0, 1])]
    return spark.createDataFrame(rows, "path string, mtime long, dims int, chunk_count int, mean array<double>, chunks array<struct<q: array<tinyint>, scale: double>>, chunk_texts array<string>, label string, idea_of array<int>")


def test_index_gate_guards_and_labels(spark, tmp_path):
    path = str(tmp_path / "ix")
    index_store.save(entries(spark), {"model_id": "m", "dims": 2}, path)
    assert index_store.load(spark, path, "other", 2) is None and index_store.load(spark, path, "m", 3) is None
    got = {r.path: r for r in index_store.load(spark, path, "m", 2).collect()}
    assert set(got) == {"a", "c"} and got["a"].idea_of == [0] and got["c"].idea_of is None and got["a"].label == "l"
    index_store.save_labels(spark.createDataFrame([("a", "new")], "path string, label string"), path)
    assert {r.path: r.label for r in index_store.load(spark, path, "m", 2).collect()} == {"a": "new", "c": None}


def test_manifest_places_every_byte_once(spark):
    r = np.random.default_rng(0)
    rows = [(f"n{i}", 8, int(r.integers(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "path string, dims int, chunk_count int")
    placed = index_store.manifest(df, 7)
    got = placed.collect()
    spans = sorted([(x.mean_offset, 32) for x in got] + [(x.chunk_offset, 8 * x.chunk_count) for x in got])
    assert [a for a, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist() and max(x.mean_offset for x in got) < min(x.chunk_offset for x in got)
    h = index_store.header(placed, "m", True).first()
    assert (h.version, h.total_bytes, h.dims, h.has_chunk_text) == (4, sum(n for _, n in spans), 8, True)


def test_cache_expiry(spark):
    notes = spark.createDataFrame([("a", 1), ("b", 3)], "path string, mtime long")
    cache = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 1, "z")], "path string, mtime long, snippet string")
    assert [r.snippet for r in changes.still_valid(cache, notes).collect()] == ["x"]


def test_models_and_pooling():
    assert embedder.model_spec("org/Jina-Embeddings-v5-nano").whole_note and embedder.model_spec("x/paraphrase-multilingual-y").query_prefix == ""
    assert embedder.model_spec("e5").passage_prefix == "passage: "
    assert embedder.last_token(np.array([[1.0, 0], [3, 4]])).tolist() == [0.6, 0.8] and embedder.last_token(np.zeros((2, 2))).tolist() == [0, 0]
    assert embedder.mean_pool(np.array([[1.0, 0], [0, 1]])) == pytest.approx([2**-0.5] * 2)


def test_report(spark):
    text = graph.report({"Stale": spark.createDataFrame([("a.md", 1)], "path string, mtime long"), "Orphans": spark.createDataFrame([], "id string")})
    assert "## Stale" in text and "- path: a.md, mtime: 1" in text and "_none_" in text


def test_trigger_and_paragraphs(spark):
    row = spark.createDataFrame([("a [[no", "a [[x]] b", "p one\n two\n\n\n\n three \n\n \n")], "a string, b string, p string")
    got = row.select(suggest.trigger(F.col("a")).alias("a"), suggest.trigger(F.col("b")).alias("b"), tx.paragraphs(F.col("p")).alias("p")).first()
    assert (got.a, got.b, got.p) == ("no", None, ["p one  two", "three"])


def test_synthetic_means_are_unit(spark):
    assert all(abs(r.d - 1) < 1e-9 for r in synthetic.index(spark, 20, 8).select(vx.dot(F.col("mean"), F.col("mean")).alias("d")).collect())


def test_search_falls_back_and_raises_titles(spark):
    notes = spark.createDataFrame([("a.md", "river", "water flows along", 1, None, None), ("b.md", "stone", "water flows along", 1, None, None), ("c.md", "late", "the river water flows", 1, None, None)], "path string, basename string, body string, mtime long, tags array<string>, aliases array<string>")
    empty = spark.createDataFrame([], "src string, dst string")
    ix = index.NoteIndex.build(notes.where("path <> 'c.md'"), empty, spark.createDataFrame([("b.md", "#x")], "path string, tag string"), Options())
    got = ix.search("river water", notes).collect()
    assert [(r.path, r.approximate) for r in got] == [("a.md", False), ("b.md", False), ("c.md", True)] and got[2].score == 1.0
