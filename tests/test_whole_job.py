"""Queries do the whole job, beyond what the small tables show."""

import numpy as np
import pytest

from lorewell.plans import queries as plans


def test_near_duplicates_of_a_dense_cluster(spark, tmp_path):
    r = np.random.default_rng(4)
    x = np.concatenate([np.eye(8)[0] + r.normal(0, 0.05, (90, 8)), np.repeat(r.normal(0, 1, (1, 8)), 80, 0), -np.eye(8)[0] + r.normal(0, 0.05, (90, 8))])
    spark.createDataFrame([(i, [float(t) for t in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype(np.float32).astype(float)
    c = x.mean(0) / np.linalg.norm(x.mean(0))
    v = x - (x @ c)[:, None] * c
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = {(a, b): s for a, b in zip(*np.triu_indices(len(v), 1)) if (s := v[a] @ v[b]) >= 0.4}
    got = plans.QUERIES["near_duplicates"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == pytest.approx(want, abs=2e-6)


def test_markdown_clean_of_a_long_text(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 150 + "\n> **bold** end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert plans.QUERIES["markdown_clean"](spark, str(tmp_path)).first().clean.endswith("x x\nbold end")


def test_mentions_in_every_language(spark, tmp_path):
    docs = [(1, "a benchmark word", "en"), (2, "ein benchmark wort", "de"), (3, "benchmark", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, plans.QUERIES["mention_first_per_target"](spark, str(tmp_path)).collect())) == [(1, 2, "benchmark"), (2, 4, "benchmark"), (3, 0, "benchmark")]
    assert sorted((r.doc, r.n_links) for r in plans.QUERIES["linked_text"](spark, str(tmp_path)).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_new_concepts_are_no_known_surface(spark):
    sf = "/root/testdata/sf0.001"
    known = {r.surface for r in plans.QUERIES["surface_dictionary"](spark, sf).collect()}
    got = [r.concept for r in plans.QUERIES["new_concepts_antijoin"](spark, sf).collect()]
    assert got and not known & {c.lower() for c in got}


@pytest.fixture(scope="module")
def hundred_notes(spark, tmp_path_factory):
    """The folder, the notes' centred chunks (note, chunk, component) and their labels."""
    r, sf = np.random.default_rng(5), str(tmp_path_factory.mktemp("notes"))
    x, labels = r.normal(0, 1, (100, 4, 8)).astype(np.float32).astype(float), r.integers(0, 100, (100, 4))
    rows = [(10 * i + k, [float(t) for t in x[i, k]], int(labels[i, k])) for i in range(100) for k in range(4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    c = x.mean((0, 1)) / np.linalg.norm(x.mean((0, 1)))
    v = x - (x @ c)[..., None] * c
    return sf, v / np.linalg.norm(v, axis=2)[..., None], labels


def test_recall_ranks_all_notes(spark, hundred_notes):
    sf, v, labels = hundred_notes
    m = v.mean(1) / np.linalg.norm(v.mean(1), axis=1)[:, None]
    s = m @ m.T
    ranks = [[1 + sum(s[i, j] > s[i, t] for j in range(100) if j != i) for t in {*labels[i, :3].tolist()} - {i}] for i in range(100)]
    assert max(min(x) for x in ranks) > 60
    got = plans.QUERIES["recall_mrr"](spark, sf).first()
    assert got.mrr == pytest.approx(np.mean([1 / min(x) for x in ranks]), abs=1e-6) and got.n_queries == 100
    assert got.recall_20 == pytest.approx(np.mean([np.mean([t <= 20 for t in x]) for x in ranks]), abs=1e-6)


def test_eval_variant_scores_all_pairs(spark, hundred_notes):
    sf, v, _ = hundred_notes
    w = np.array([2, 1, 1, 1]) / 5
    s = np.maximum(np.einsum("iax,jbx->ijab", v, v), 0)
    want = (s.max(3) @ w + s.max(2) @ w) / 2
    got = plans.QUERIES["bimax_eval_variant"](spark, sf).collect()
    assert len({(r.q, r.n) for r in got}) == len(got) == 9900 and all(abs(r.score - want[r.q, r.n]) < 2e-6 for r in got)


def test_ideas_rescore_the_whole_shortlist(spark, hundred_notes):
    assert plans.QUERIES["idea_similarity"](spark, hundred_notes[0]).count() == 6000


def test_orphans_closest_by_price(spark):
    sf = "/root/testdata/sf0.001"
    price = {r.p_partkey: r.p_retailprice for r in plans.table(spark, sf, "part").collect()}
    price_of = lambda a: min((abs(p - price[a]), b) for b, p in price.items() if b != a)
    got = plans.QUERIES["orphans_with_closest"](spark, sf).collect()
    assert len(got) == 69 and all((r.closest, r.closest_score) == (price_of(r.id)[1], pytest.approx(1 / (1 + price_of(r.id)[0]))) for r in got)
