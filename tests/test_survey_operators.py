"""Operators against brute force and by hand."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell import index
from lorewell.functions import text as tx
from lorewell.operators import graph, mentions, ranking, suggest
from lorewell.options import Options
from lorewell.sources import embedder
from lorewell.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,out",
    [
        ("---\nk: v\n---\nbody", "\nbody"),
        ("a\n```\ncode\n```\nb", "a\n\n\nb"),
        ("~~~\nkept\n~~~", "\nkept\n"),
        ("a `x\ny` b", "a   b"),
        ("a <b\nc> d", "a   d"),
        ("[[a|b]] [[c]] [t](u) ![[e]] ![i](j)", "b c t    "),
        ("  ## h\n > q\n+ i\n12. n\n#tag", "h\nq\ni\nn\n#tag"),
        ("**b** _i_ ~s~", "b i s"),
    ],
)
def test_clean_markdown(spark, text, out):
    assert one(spark, tx.clean_markdown(F.lit(text))) == out


def test_strip(spark):
    assert one(spark, tx.strip(F.lit(" a \t b \nc \r\n\n\n\nd "))) == "a b\nc\n\nd"


def test_mentions_have_the_places_of_the_body(spark):
    body = unicodedata.normalize("NFD", "éééé target here, Über  Café, 각 target")
    notes = spark.createDataFrame([("t.md", "target", None), ("u.md", "über café", None), ("k.md", "각 x", ["각 target"])], "path string, basename string, aliases array<string>")
    found = mentions.detect(spark.createDataFrame([("d", body)], "doc string, body string"), mentions.surfaces(notes), every=True).collect()
    got = sorted((r.start, unicodedata.normalize("NFC", r.text)) for r in found)
    assert [t for _, t in got] == ["target", "Über  Café", "각 target"]
    assert all(body[r.start : r.end] == r.text for r in found)


def test_a_dictionary_in_parts(spark):
    r = np.random.default_rng(0)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    notes = spark.createDataFrame([(f"{i}.md", f"{words[a]} {words[b]}" if i % 2 else words[a], None) for i, (a, b) in enumerate(zip(r.permutation(36), r.permutation(36)))], "path string, basename string, aliases array<string>")
    docs = spark.createDataFrame([(f"d{i}", " ".join(words[x] for x in r.integers(0, 36, 80)) + " `waa` waa") for i in range(10)], "doc string, body string")
    whole, parts = (sorted(map(tuple, mentions.detect(docs, mentions.surfaces(notes), every=True, broadcast_bytes=b).collect())) for b in (1 << 20, 500))
    assert whole == parts and len(whole) > 100


def test_later_mentions_and_single_link(spark):
    hits = spark.createDataFrame([("d", 0, 3, "a"), ("d", 10, 13, "a"), ("d", 20, 23, "b")], "doc string, start int, end int, path string")
    links, cursors = spark.createDataFrame([("d", "a")], "doc string, path string"), spark.createDataFrame([("d", 13)], "doc string, cursor int")
    assert [r.start for r in mentions.later_mentions(hits, links, cursors).collect()] == [0]
    put = lambda surface, base: one(spark, mentions.insert_link(F.lit("see foo now"), F.lit(4), F.lit(7), F.lit(surface), F.lit(base).cast("string")))
    assert (put("foo", "Foo"), put("foo", "Bar"), put("fox", "Foo"), put("foo", None)) == ("see [[Foo]] now", "see [[Bar|foo]] now", "see foo now", "see foo now")


def applied(held: dict, events: list) -> dict:
    """The changes one after the other: path -> mtime."""
    held, fresh = {p: (m, False) for p, m in held.items()}, None
    for ts, op, path, to in events:
        if op == "modify":
            held[path] = (ts, True)
        elif op == "delete":
            held.pop(path, None)
        else:
            fresh = held.pop(path, None)
            held.pop(to, None)
            if fresh is not None:
                held[to] = fresh
    return {p: m for p, (m, _) in held.items() if p.endswith(".md")}


@pytest.mark.parametrize("seed", range(4))
def test_upsert_in_order(spark, seed):
    r = np.random.default_rng(seed)
    names = [f"{c}.md" for c in "abcdefgh"] + ["x.txt"]
    held = {p: -i - 1 for i, p in enumerate(names[:6])}
    events = []
    for ts in range(40):
        a, b = r.choice(len(names), 2, replace=False)
        op = r.choice(["modify", "delete", "rename", "rename"])
        if names[a].endswith(".md") or op == "rename":
            events.append((ts, str(op), names[a], names[b] if op == "rename" else None))
    index_ = spark.createDataFrame(list(held.items()) + [("quiet.md", -99)], "path string, mtime long")
    told = spark.createDataFrame(events, "ts long, op string, path string, new_path string")
    got = changes.upsert(index_, told.repartition(3), lambda rows: rows.select("path", F.col("ts").alias("mtime"))).collect()
    assert {r.path: r.mtime for r in got} == applied(held, events) | {"quiet.md": -99} and len(got) == len({r.path for r in got})


def test_upserts_from_a_stream(spark, tmp_path):
    state = {"index": spark.createDataFrame([("a.md", 1), ("b.md", 1)], "path string, mtime long").collect()}
    schema = "path string, op string, new_path string, ts long"
    spark.createDataFrame([("a.md", "rename", "c.md", 5), ("b.md", "modify", None, 6)], schema).write.parquet(f"{tmp_path}/in")

    def write(rows, batch):
        state["index"] = rows.collect()

    query = changes.stream_upserts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda: spark.createDataFrame(state["index"], "path string, mtime long"), write, lambda rows: rows.select("path", F.col("ts").alias("mtime")), f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert {(r.path, r.mtime) for r in state["index"]} == {("c.md", 1), ("b.md", 6)}


def test_topic_labels_rank_what_is_telling(spark):
    df = spark.createDataFrame([(1, "common rarely rarely"), (2, "common other"), (3, None)], "id long, text string")
    assert {r.id: r.label for r in suggest.topic_labels(df, 1).collect()} == {1: "rarely", 2: "other"}


def test_names_in_use(spark):
    wanted = spark.createDataFrame([(1, "a: b"), (2, "a b"), (3, "c"), (4, "??"), (5, "d 7")], "id long, concept string")
    taken = spark.createDataFrame([("a b",), ("a b 3",), ("d 7",)], "name string")
    assert {r.id: r.name for r in suggest.unused_names(wanted, taken).collect()} == {1: "a b 2", 2: "a b 4", 3: "c", 5: "d 7 2"}


def test_insertion_and_context(spark):
    put = lambda line, at: one(spark, suggest.insert_at_trigger(F.lit(line), F.lit(at), F.lit("[[N]]")))
    assert (put("a [[qu]] b", 6), put("a [[qu b", 6), put("no", 2)) == ("a [[N]] b", "a [[N]] b", "no")
    assert one(spark, suggest.context(F.lit("x [[op rest"), F.lit(6))) == "x  "
    assert one(spark, suggest.context(F.lit("x [[op]] rest"), F.lit(6))) == "x [[op]] rest"
    assert one(spark, suggest.block_key(F.lit("p"), F.lit("a😀"))) == "p:" + base36(djb2([97, 0xD83D, 0xDE00]))


def djb2(units):
    h = 5381
    for u in units:
        h = (h * 33 + u) % (1 << 32)
    return h


def base36(n):
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def test_what_asks_for_a_rebuild():
    o = Options()
    assert (o.rebuild(Options(device="gpu")), o.rebuild(Options(chunking=False)), o.rebuild(Options(top_k=3)), o.rebuild(Options(device="gpu", chunking=False))) == ("engine", "force", None, "engine")


def test_nearest_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (90, 4)).astype(float)
    area = r.integers(0, 3, 90).tolist()
    df = spark.createDataFrame([(i, v.tolist(), None if a == 2 else a) for i, (v, a) in enumerate(zip(x, area))] + [(200, None, 0), (201, [1.0], 0)], "id long, v array<double>, area int").repartition(3)
    want = lambda i, k, same: [j for _, j in sorted((-float(x[i] @ x[j]), j) for j in range(90) if j != i and (not same or area[i] == area[j]))[:k]]
    for same in (False, True):
        got = ranking.nearest(df, 5, key=F.col("area") if same else None).where("q < 100").orderBy("q", "rank").collect()
        assert [[g.n for g in got if g.q == i] for i in range(90)] == [want(i, 5, same) for i in range(90)]
    some = ranking.nearest(df, 3, queries=df.where("id = 4")).collect()
    assert [g.n for g in sorted(some, key=lambda g: g.rank)] == want(4, 3, False)


def test_recall_leaves_unknown_targets_out(spark):
    ranks = spark.createDataFrame([(1, 2, 3)], "q long, n long, rank int")
    targets = spark.createDataFrame([(1, 2), (1, 99), (3, 99), (1, 1)], "q long, n long")
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    r = ranking.evaluate(ranks, targets, known=known).first()
    assert (r.recall_5, r.mrr, r.n_queries) == (1.0, pytest.approx(1 / 3), 1)


def test_linked_notes(spark):
    links = spark.createDataFrame([("a.md", "c.md", 3), ("a.md", "b.md", 5), ("a.md", "c.md", 9), ("a.md", "p.png", 1), ("a.md", "gone.md", 2)], "src string, dst string, at int")
    notes = spark.createDataFrame([("a.md",), ("b.md",), ("c.md",), ("p.png",)], "path string")
    assert [(r.n, r.rank) for r in graph.linked_notes(links, notes).orderBy("rank").collect()] == [("c.md", 1), ("b.md", 2)]


def test_pairs_of_graph_reasons(spark):
    r = np.random.default_rng(3)
    tags = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 12, (60, 2))], "id long, tag long")
    links = tags.toDF("src", "dst")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12) if (a + b) % 3 == 0], "a long, b long")
    for whole, some in ((graph.shared_tags(tags), graph.shared_tags(tags, pairs)), (graph.co_citations(links), graph.co_citations(links, pairs=pairs))):
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.join(pairs, ["a", "b"]).collect()))


def test_index_of_notes(spark):
    text = {"cats": "the cat sat with another cat", "kittens": "a kitten is a small cat that sat", "cars": "engines and wheels drive cars", "trucks": "trucks have engines and large wheels", "old": "nothing of note here"}
    notes = spark.createDataFrame([(f"{k}.md", k, v, i, ["animal/pet"] if "cat" in v else ["#Vehicle"], None) for i, (k, v) in enumerate(text.items())], "path string, basename string, body string, mtime long, tags array<string>, aliases array<string>")
    links = spark.createDataFrame([("cats.md", "kittens.md")], "src string, dst string")
    tags = notes.select("path", F.explode("tags").alias("tag"))
    ix = index.NoteIndex.build(notes, links, tags, Options(min_similarity=-1.0))
    best = {r.q: r.n for r in ix.rank().where("rank = 1").collect()}
    assert best["cats.md"] == "kittens.md" and best["trucks.md"] == "cars.md" and len(best) == 5
    assert {r.q for r in ix.rank(["cars.md"]).collect()} == {"cars.md"}
    assert ix.rank_by_query("wheels engines").first().path in ("cars.md", "trucks.md")
    apart = index.NoteIndex.build(notes, links, tags, Options(min_similarity=-1.0, isolated_areas=("vehicle",))).rank().collect()
    assert {(r.q in ("cars.md", "trucks.md", "old.md"), r.n in ("cars.md", "trucks.md", "old.md")) for r in apart} == {(True, True), (False, False)}
    seen = ix.insights()
    assert {r.id for r in seen["orphans"].collect()} == {"cars.md", "trucks.md", "old.md"} and seen["stale"].first().id == "cats.md"
    told = spark.createDataFrame([("old.md", "modify", None, 9, "old", "engines wheels cars trucks", 9), ("cats.md", "rename", "felines.md", 10, None, None, None)], "path string, op string, new_path string, ts long, basename string, body string, mtime long")
    after = ix.update(told)
    assert {r.path for r in after.entries.collect()} == {"felines.md", "kittens.md", "cars.md", "trucks.md", "old.md"}
    assert after.rank(["old.md"]).where("rank = 1").first().n in ("cars.md", "trucks.md")
    again = index.NoteIndex.build(notes.where("path <> 'old.md'"), links, tags, old=ix)
    assert sorted(r.path for r in again.entries.collect()) == ["cars.md", "cats.md", "kittens.md", "trucks.md"]


def test_whole_note_vectors_and_a_model(spark):
    notes = spark.createDataFrame([("a.md", "a", "x " * 4000, 1), ("b.md", "b", None, 1)], "path string, basename string, body string, mtime long")
    model = embedder.batch_embedder(embedder.load_hashing, 2)
    rows = {r.path: r for r in index.note_vectors(notes, model, whole_note=True).collect()}
    assert len(rows["a.md"].chunk_texts[0]) == 6000 and rows["b.md"].chunk_texts == ["b. "] and len(rows["a.md"].chunks) == 1
    assert list(rows["a.md"].mean) == pytest.approx(embedder.hash_embed(rows["a.md"].chunk_texts[0]))
