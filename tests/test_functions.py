import pytest
from pyspark.sql import functions as F

from lorewell.functions import chunking, text as tx, vectors as vx
from lorewell.operators import mentions
from lorewell.options import parse_areas, parse_list
from lorewell.sources import index_store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("s,out", [("category", "categories"), ("categories", "category"), ("boxes", "box"), ("class", "classes"), ("embeddings", "embedding"), ("box", None), ("analysis", "analysises"), ("bus", None)])
def test_inflect(spark, s, out):
    assert one(spark, tx.inflect(F.lit(s))) == out


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(t)) for t in x))
    assert one(spark, vx.dot(v(1, 2), v(1, 2, 3))) == 0
    assert one(spark, vx.unit(v(0, 0))) == [0, 0]
    assert one(spark, vx.unit(v(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, vx.center(v(1, 1), v(1, 0))) == pytest.approx([0, 1])
    r = one(spark, vx.quantize(v(127, -127, 0.5, -0.5)))
    assert list(r.q) == [127, -127, 1, 0] and r.scale == 1
    assert one(spark, vx.quantize(v(0, 0))).scale == 1


@pytest.mark.parametrize("age,out", [(0, "just now"), (3_600_000, "1h ago"), (86_400_000, "1d ago"), (30 * 86_400_000, "1mo ago"), (365 * 86_400_000, "1y ago"), (-1, "")])
def test_relative_time(spark, age, out):
    now = 10**13
    assert one(spark, tx.relative_time(F.lit(now - age), F.lit(now))) == out


def test_windows_and_budget():
    s = " ".join(["w"] * 50) + "."
    assert chunking.windows([s, s]) == [f"{s} {s}", s]
    assert chunking.windows(["a " * 74 + "a.", "b b b b b.", "c."])[0].endswith("b. b b b b b. c.")
    assert chunking.budget("x" * 480) == ["x" * 480]
    assert [len(p) for p in chunking.budget("x" * 481)] == [480, 1]


def test_lists_and_wikilinks(spark):
    assert parse_list("a/, b\n\n c ") == ["a", "b", "c"]
    assert parse_areas("#goa/, goa/character, GOA") == ["goa"]
    assert one(spark, tx.wikilink(F.lit("Base"), F.lit("base"))) == "[[Base]]"
    assert one(spark, tx.wikilink(F.lit("Base"), F.lit("bases"))) == "[[Base|bases]]"


def test_folders(spark):
    notes = spark.createDataFrame([("Archive/x.md",), ("Archive2/x.md",), ("Archive",)], "path string")
    kept = index_store.without_folders(notes, spark.createDataFrame([("Archive/",), ("",)], "folder string"))
    assert [r.path for r in kept.collect()] == ["Archive2/x.md"]


def test_codec_and_guards():
    entries = [{"path": "a", "mean": [1.0, 0.0], "chunks": [[1, -1]], "scales": [0.5], "idea_of": [0]}, {"path": "b", "mean": [0.0, 1.0], "chunks": [[2, 3]], "scales": [0.5], "idea_of": []}]
    head, blob = index_store.pack(entries)
    back = index_store.unpack(head, blob)
    assert back[0]["chunks"] == [[1, -1]] and "idea_of" not in back[1]
    assert [e["path"] for e in index_store.unpack(head, blob[:-1])] == ["a"]
    assert index_store.from_base64(index_store.to_base64([-128, 127])) == [-128, 127]


def test_mentions(spark):
    notes = spark.createDataFrame([("a.md", "Deep Work", ["focus"]), ("b.md", "Work", [])], "path string, basename string, aliases array<string>")
    body = "# Work title\nDeep work and `focus` then focus. Work!\n```\nwork\n"
    docs = spark.createDataFrame([("d.md", body)], "doc string, body string")
    hits = mentions.detect(docs, mentions.surfaces(notes))
    found = sorted((r.start, r.text) for r in hits.collect())
    assert [t for _, t in found] == ["Deep work", "Work"]
    linked = mentions.apply_links(docs, hits, notes).first()
    assert "[[Deep Work]]" in linked.body and linked.n_links == 2
