"""One query for each operator, over the supplied tables; stand-ins for notes, links and tags are named where used.

Notes are groups of ten vectors (note = vec_id div 10, chunk = vec_id % 10, chunk 0 the title); a note's tags are its
vectors' labels; note a links to the note whose number is a label of its first three chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell import index
from lorewell.functions import chunking, sections, text as tx, vectors as vx
from lorewell.operators import graph, mentions, ranking, suggest
from lorewell.options import Options
from lorewell.sources import embedder, index_store, synthetic
from lorewell.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark, sf) -> DataFrame:
    return vx.centered(table(spark, sf, "embeddings"), "embedding").select(F.col("vec_id").alias("id"), "v", F.col("label").cast("long").alias("label"))


def chunks(spark, sf) -> DataFrame:
    return vectors(spark, sf).select(F.floor(F.col("id") / 10).alias("id"), (F.col("id") % 10).alias("no"), "v", "label")


def means(spark, sf) -> DataFrame:
    return vx.mean_by(chunks(spark, sf), ["id"], "v")


def links(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").where("vec_id % 10 < 3")
    return e.select(F.floor(F.col("vec_id") / 10).alias("src"), F.col("label").cast("long").alias("dst")).where("src <> dst").distinct()


def tags(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("id"), F.col("label").cast("long").alias("tag")).distinct()


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def centroid(spark, sf):
    return rounded(vx.centroid(table(spark, sf, "embeddings"), "embedding").select(F.posexplode("centroid").alias("pos", "value")), "value")


@query
def centered_vectors(spark, sf):
    return rounded(vectors(spark, sf).select(F.col("id").alias("vec_id"), F.posexplode("v").alias("pos", "value")), "value")


@query
def stage1_topk(spark, sf):
    return rounded(ranking.nearest(vectors(spark, sf), 12), "score")


@query
def isolated_area_topk(spark, sf):
    return rounded(ranking.nearest(vectors(spark, sf), 12, key=F.col("label")), "score")


@query
def floor_topk(spark, sf):
    return rounded(ranking.nearest(vectors(spark, sf), 12, floor=0.2), "score")


@query
def near_duplicates(spark, sf):
    return rounded(ranking.pairs_above(vectors(spark, sf), 0.4), "score")


@query
def note_means(spark, sf):
    return rounded(means(spark, sf).select(F.col("id").alias("note_id"), F.posexplode("mean").alias("pos", "value")), "value")


def _shortlist(spark, sf) -> DataFrame:
    return ranking.nearest(means(spark, sf).withColumnRenamed("mean", "v"), 60)


@query
def bimax_topk(spark, sf):
    m = means(spark, sf)
    scores = ranking.bi_max(_shortlist(spark, sf), chunks(spark, sf), m)
    return rounded(ranking.ranked(scores, 12), "score")


@query
def bimax_eval_variant(spark, sf):
    """The evaluation's scores: of all pairs of notes, without a shortlist."""
    return rounded(ranking.bi_max_of_all(chunks(spark, sf)), "score")


@query
def idea_similarity(spark, sf):
    """Ideas are halves of a note; ideas blend in by the default weight."""
    c = chunks(spark, sf)
    ideas = vx.mean_by(c.withColumn("no", F.floor(F.col("no") / 5)), ["id", "no"], "v", "v")
    short = _shortlist(spark, sf)
    base, idea = ranking.bi_max(short, c, means(spark, sf)), ranking.bi_max(short, ideas, title_weight=1.0)
    return rounded(ranking.blend_ideas(base, idea, 0.3), "score")


@query
def structural_boost(spark, sf):
    """Signals: a link counts 1, a shared tag a quarter each up to three, a shared source a quarter."""
    short = _shortlist(spark, sf).drop("rank")
    pairs = short.select("q", "n", F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b"))
    linked = graph.both_ways(links(spark, sf)).withColumn("linked", F.lit(1.0))
    signals = pairs.join(linked, ["q", "n"], "left").join(graph.shared_tags(tags(spark, sf), pairs), ["a", "b"], "left").join(graph.co_citations(links(spark, sf), pairs=pairs), ["a", "b"], "left")
    signal = F.coalesce("linked", F.lit(0.0)) + 0.25 * F.least(F.coalesce("n_shared", F.lit(0)), F.lit(3)) + F.when(F.col("n_sources") > 0, 0.25).otherwise(0.0)
    return rounded(ranking.boost(short, signals.select("q", "n", signal.alias("signal")), 0.15, 0.05).select("q", "n", "score"), "score")


@query
def recall_mrr(spark, sf):
    """The evaluation of notes as one vector each, over all notes."""
    targets = links(spark, sf).select(F.col("src").alias("q"), F.col("dst").alias("n"))
    found = index.evaluate_whole(means(spark, sf).withColumnRenamed("mean", "v"), targets)
    return rounded(found, "recall_5", "recall_10", "recall_20", "mrr")


@query
def eval_windows(spark, sf):
    """The evaluation by chunks both ways, over all notes."""
    targets = links(spark, sf).select(F.col("src").alias("q"), F.col("dst").alias("n"))
    return rounded(index.evaluate_windows(chunks(spark, sf), targets), "recall_5", "recall_10", "recall_20", "mrr")


@query
def quantize_roundtrip(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", vx.quantize(F.col("embedding")).alias("r"))
    back = vx.dequantize(F.col("r.q"), F.col("r.scale"))
    return rounded(e.select("vec_id", F.aggregate("r.q", F.lit(0), lambda s, x: s + x).alias("q_sum"), F.col("r.scale").alias("scale"), vx.dot(back, F.col("embedding")).alias("cosine")), "scale", "cosine")


@query
def label_propagation(spark, sf):
    return graph.suggested_tags(_shortlist(spark, sf).where("rank <= 12"), tags(spark, sf), 3, 1.0)


@query
def suggested_pairs_unlinked(spark, sf):
    return rounded(graph.suggested_links(_shortlist(spark, sf), links(spark, sf), 50), "score")


@query
def orphans_with_closest(spark, sf):
    """Parts without a returned line of 45 or more, and the closest part by price."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    e = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    alone = e.select(F.lit(-1).cast("long").alias("src"), "dst")
    return graph.orphans(parts, alone, ranking.closest_by(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))))


@query
def co_citation(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.co_citations(e, 2)


@query
def shared_tags_overlap(spark, sf):
    return graph.shared_tags(tags(spark, sf))


@query
def link_degrees(spark, sf):
    return graph.degrees(links(spark, sf))


@query
def link_reasons(spark, sf):
    short = _shortlist(spark, sf).where("rank <= 5").select("q", "n", F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b"))
    linked = graph.both_ways(links(spark, sf)).withColumn("linked", F.lit(True))
    shared, cited = graph.shared_tags(tags(spark, sf), short), graph.co_citations(links(spark, sf), pairs=short)
    j = short.join(linked, ["q", "n"], "left").join(shared, ["a", "b"], "left").join(cited, ["a", "b"], "left")
    r = ranking.reason(F.coalesce("linked", F.lit(False)), F.coalesce("n_shared", F.lit(0)), F.col("top_tag"), F.coalesce("n_sources", F.lit(0)))
    return j.select("q", "n", r["kind"].alias("kind"), r["detail"].alias("detail"))


def _users(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.floor(F.max("us") / 1000).alias("mtime"))


@query
def stale_entities(spark, sf):
    return graph.stale(_users(spark, sf), 20)


@query
def recent_entities(spark, sf):
    opened = table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"))
    return graph.recent(opened, _users(spark, sf), 12)


@query
def relative_time(spark, sf):
    now = F.lit(1_706_745_600_000)  # 2024-02-01
    return _users(spark, sf).select("id", tx.relative_time(F.col("mtime"), now).alias("age"), tx.ymd(F.col("mtime")).alias("day"))


@query
def folder_exclusion(spark, sf):
    """Paths brand/type/part; one brand and one brand's type are excluded."""
    notes = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    return index_store.without_folders(notes, spark.createDataFrame([("Brand#1/",), ("Brand#2/ECONOMY",), ("",)], "folder string"))


def _titles(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("basename"), F.array("p_brand").alias("aliases"))


@query
def surface_dictionary(spark, sf):
    return mentions.surfaces(_titles(spark, sf), ascii_only=True)


@query
def inflect_variants(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("surface")).distinct()
    return words.select("surface", tx.inflect(F.col("surface")).alias("variant"))


@query
def resolve_ambiguous(spark, sf):
    return mentions.resolve(mentions.surfaces(_titles(spark, sf), ascii_only=True)).select("surface", "path", "ambiguous")


def _words(spark, sf) -> DataFrame:
    """Titles for mentions: the ASCII words of the benchmark."""
    w = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 8").distinct()
    return w.select(F.concat(F.lit("w/"), "word").alias("path"), F.col("word").alias("basename"), F.lit(None).cast("array<string>").alias("aliases"))


@query
def mention_first_per_target(spark, sf):
    dictionary = mentions.surfaces(_words(spark, sf), ascii_only=True).where("exact")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.regexp_replace(F.lower("text"), "[^a-z]", " ").alias("body"))
    return mentions.detect(docs, dictionary).select("doc", "start", "surface")


@query
def linked_text(spark, sf):
    names = _words(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.regexp_replace(F.lower("text"), "[^a-z]", " ").alias("body"))
    hits = mentions.detect(docs, mentions.surfaces(names, ascii_only=True), every=True)
    out = mentions.apply_links(docs, hits, names)
    return out.select("doc", "n_links", F.length("body").alias("n_chars"))


@query
def wikilink_text(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", tx.wikilink(F.col("p_name"), F.upper("p_name")).alias("plain"), tx.wikilink(F.col("p_name"), F.col("p_brand")).alias("aliased"))


@query
def word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("n_words"))


@query
def markdown_clean(spark, sf):
    """Documents wrapped in Markdown, as none has any."""
    body = F.concat(F.lit("# Head\n> *quoted* `code` [[Note|alias]] [[Other]] [label](http://x/y)\n- **item** ![p](q)\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tx.strip(tx.clean_markdown(body)).alias("clean"))


@query
def snippets(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.card_line(F.lit(""), tx.snippet(F.col("text"))).alias("line"))


@query
def keyword_overlap_rank(spark, sf):
    """Documents by the share of a benchmark item's words of four letters or more that they hold."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text")
    return rounded(ranking.by_keywords(items, table(spark, sf, "documents").select(F.col("doc_id").alias("n"), "text"), 10), "score")


@query
def blend_fuzzy_semantic(spark, sf):
    """Part names that fit what is typed; every third has a context score, a ten-thousandth of its price."""
    c = table(spark, sf, "part").select(F.lit(0).alias("q"), F.col("p_partkey").alias("id"), suggest.fuzzy(F.lit("wd"), F.col("p_name")).alias("raw"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") / 10000).alias("semantic"))
    return rounded(suggest.top(suggest.blend(c.where("raw IS NOT NULL"))).select("id", "score", "rank"), "score")


@query
def fuzzy_names(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", suggest.fuzzy(F.lit("rdwt"), F.col("p_name")).alias("raw"))
    return p.where("raw IS NOT NULL")


@query
def new_concepts_antijoin(spark, sf):
    labels = table(spark, sf, "part").select((F.col("p_partkey") % 5).alias("q"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("score"), F.concat_ws(" · ", "p_name", "p_type", "p_brand").alias("label"))
    shown = spark.createDataFrame([(1, "economy")], "q long, surface string")
    dictionary = mentions.surfaces(_titles(spark, sf), ascii_only=True)
    return rounded(suggest.new_concepts(labels, dictionary, shown), "score")


@query
def latest_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return changes.latest(e, "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")


@query
def session_coalesce(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = changes.sessions(e, 6 * 3600, "user_id")
    return out.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


@query
def reuse_by_mtime(spark, sf):
    """Users whose last event the index, which holds the purchases, doesn't have."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("mtime"), "event_type")
    notes = e.groupBy("path").agg(F.max("mtime").alias("mtime"))
    return changes.to_embed(notes, e.where("event_type = 'purchase'"))


@query
def percent_pills(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", tx.percent(F.element_at("embedding", 1).cast("double"), F.col("label") == 0).alias("pill"))


@query
def chunk_windows(spark, sf):
    d = table(spark, sf, "documents")
    made = d.select("doc_id", chunking.chunked(F.concat(F.lit("note "), F.col("doc_id").cast("string")), F.col("text")).alias("c"))
    made = made.select("doc_id", "c.n_dropped", F.posexplode("c.chunks").alias("no", "chunk"))
    return made.select("doc_id", "no", F.length("chunk").alias("n_chars"), F.xxhash64("chunk").alias("hash"), "n_dropped")


@query
def budget_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.budget_of(F.col("text"))).alias("no", "piece")).select("doc_id", "no", F.length("piece").alias("n_chars"))


def _noted(spark, sf) -> DataFrame:
    """Documents cut into Markdown sections, their own marks blanked so that SQL knows the sections: doc_id, name, body."""
    text = F.translate("text", "#`~", "   ")
    head, rest = F.substring(text, 1, 300), F.substring(text, F.lit(301), F.length("text"))
    body = F.concat(F.lit("---\nk: v\n---\nlead\n# Alpha *one*\n"), head, F.lit("\n## Beta ##\n```\n# no heading\n```\n### `Gamma` [[x|two]]\n## Delta\n"), rest)
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("name"), body.alias("body"))


@query
def section_split(spark, sf):
    found = _noted(spark, sf).select("doc_id", F.posexplode(sections.sections_of(F.col("body"))).alias("no", "s"))
    return found.select("doc_id", "no", "s.level", "s.breadcrumb", F.md5(F.col("s.text").cast("binary")).alias("text_md5"))


@query
def heading_context(spark, sf):
    made = _noted(spark, sf).select("doc_id", sections.chunked(F.col("name"), F.col("body")).alias("c")).select("doc_id", "c.n_dropped", F.posexplode("c.chunks").alias("no", "c"))
    return made.select("doc_id", "no", "c.section", F.length("c.text").alias("n_chars"), F.xxhash64("c.text").alias("hash"), "n_dropped")


@query
def idea_segments(spark, sf):
    """Ideas of each note: their chunks and words."""
    made = _noted(spark, sf).select("doc_id", sections.chunks(F.col("name"), F.col("body"), heading_context=False).alias("c"))
    each = made.select("doc_id", F.posexplode(F.arrays_zip(F.col("c.text").alias("text"), sections.ideas_of(F.col("c")).alias("idea"))).alias("no", "x"))
    return each.groupBy("doc_id", F.col("x.idea").alias("idea")).agg(F.count("*").alias("n_chunks"), F.sum(tx.word_count(F.col("x.text")).cast("long")).alias("n_words"))


@query
def legacy_index(spark, sf):
    """Notes of one chunk through the legacy JSON lines and back."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("vec_id").alias("mtime"), F.size("embedding").alias("dims"), F.lit(1).alias("chunk_count"), vx.doubles(F.col("embedding")).alias("mean"), F.array(vx.quantize(F.col("embedding"))).alias("chunks"))
    back = index_store.from_legacy(index_store.to_legacy(e))
    first = F.element_at("chunks", 1)
    return rounded(back.select(F.col("mtime").alias("vec_id"), "chunk_count", F.aggregate(first["q"], F.lit(0), lambda s, x: s + x).alias("q_sum"), first["scale"].alias("scale"), F.element_at("mean", 1).alias("first")), "scale", "first")


@query
def synthetic_index(spark, sf):
    """The made-up index: chunks a note and the least and greatest int8 value."""
    i = synthetic.index(spark)
    q = F.flatten("chunks.q")
    return i.select("path", "mtime", "dims", "chunk_count", F.array_min(q).alias("least"), F.array_max(q).alias("most"))


@query
def topic_labels(spark, sf):
    """The five terms of the highest tf-idf of each document, joined by a middle dot; the formula is ours."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return suggest.topic_labels(d.withColumnRenamed("doc_id", "id"), 5).withColumnRenamed("id", "doc_id")


@query
def hash_embed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", embedder.embed(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("dims"), F.round(vx.dot(F.col("v"), F.col("v")), 6).alias("norm"))


@query
def query_search(spark, sf):
    """The best conversation passage for one text, by hashed vectors."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("no"), embedder.embed(F.col("text")).alias("v"))
    return rounded(ranking.best_passage(embedder.hash_embed("the tion and ing"), turns, 12), "score")


@query
def linked_notes(spark, sf):
    """Parts of an order by line, as the Markdown notes that a note links to."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.concat(F.col("l_partkey").cast("string"), F.lit(".md")).alias("dst"), F.col("l_linenumber").alias("at"))
    notes = table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return graph.linked_notes(e, notes)


@query
def topic_gate(spark, sf):
    """Linked notes that are off topic: their centred means score below 0."""
    v = means(spark, sf).select("id", F.col("mean").alias("v"))
    pairs = links(spark, sf).select(F.col("src").alias("doc"), F.col("dst").alias("path"))
    return mentions.topic_gate(v, pairs)


@query
def tag_alias_folding(spark, sf):
    p = table(spark, sf, "part")
    made = tx.embed_input(F.col("p_name"), F.array("p_type", "p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.upper("p_name"))))
    return p.select("p_partkey", made.alias("input"))


@query
def median_size(spark, sf):
    return rounded(table(spark, sf, "part").groupBy("p_brand").agg(vx.median(F.col("p_retailprice")).alias("middle")), "middle")


@query
def report_exclusion(spark, sf):
    return graph.without_report(table(spark, sf, "part").select(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("path")), "parts/7")


@query
def link_exclusion(spark, sf):
    """Brands that are in the index but never linked go as well as those outside it."""
    o = Options(exclude_folders=("Brand#1",), exclude_folders_links=("Brand#2/ECONOMY",))
    notes = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    return index_store.without_folders(notes, spark.createDataFrame([(f,) for f in o.link_excluded], "folder string"))


@query
def empty_query_pool(spark, sf):
    """What an empty query shows while there is no vector: the last changed."""
    return suggest.unqueried(None, _users(spark, sf), has_vector=False)


@query
def suggestion_list(spark, sf):
    """Parts by price and new concepts from their labels, as one list."""
    p = table(spark, sf, "part")
    notes = suggest.top(p.select((F.col("p_partkey") % 5).alias("q"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("score")))
    return suggest.assembled(notes, new_concepts_antijoin(spark, sf).select("q", "concept", "k"))


@query
def typed_concepts(spark, sf):
    """Customers' names typed as queries: those that are no part's surface are offered."""
    typed = table(spark, sf, "customer").select(F.col("c_custkey").alias("q"), F.col("c_name").alias("text")).unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("text")))
    return suggest.queried_concepts(typed, mentions.surfaces(_titles(spark, sf), ascii_only=True), spark.createDataFrame([], "q long, surface string"))


@query
def unused_names(spark, sf):
    """File names for part names that several want, some in use."""
    p = table(spark, sf, "part")
    taken = p.select(F.col("p_name").alias("name")).distinct().unionByName(p.select(F.concat("p_name", F.lit(" 3")).alias("name")).distinct())
    return suggest.unused_names(p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("#"), "p_name", F.lit("?")).alias("concept")), taken)


@query
def context_badge(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", tx.badge(F.element_at("embedding", 1).cast("double")).alias("badge"))


@query
def link_insertion(spark, sf):
    """A link completed in a line that has text behind it, with closing brackets for every second part."""
    p = table(spark, sf, "part")
    before = F.concat(F.lit("see [[x]] and [["), F.substring("p_name", 1, 4))
    line = F.concat(before, F.when(F.col("p_partkey") % 2 == 0, "]]").otherwise(""), F.lit(" end"))
    return p.select("p_partkey", suggest.trigger(before).alias("query"), suggest.insert_at_trigger(line, F.length(before), tx.wikilink(F.col("p_name"), F.col("p_name"), True)).alias("line"))


@query
def cursor_context(spark, sf):
    """What stands around a cursor in the middle of each document, where a link was opened."""
    half = (F.length("text") / 2).cast("int")
    body = F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit("[[open"), F.substring(F.col("text"), half + 1, F.length("text")))
    return table(spark, sf, "documents").select("doc_id", F.md5(suggest.context(body, half + 6).cast("binary")).alias("context_md5"))


@query
def context_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", suggest.block_key(F.col("p_brand"), F.col("p_name")).alias("key"))


@query
def context_rank(spark, sf):
    """Notes by their mean's product with the first vector, without note 0."""
    v = means(spark, sf).select(F.col("id").alias("path"), F.col("mean"))
    q = vectors(spark, sf).where("id = 0").first().v
    empty = spark.createDataFrame([], "src long, dst long")
    return rounded(index.NoteIndex(v, empty, empty).rank_for_context(q, 80, 0), "semantic")


@query
def later_mentions(spark, sf):
    """Mentions in documents of words that the document's benchmark item, doc_id modulo their number, holds; the cursor is at 100."""
    names = _words(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.regexp_replace(F.lower("text"), "[^a-z]", " ").alias("body"))
    n = table(spark, sf, "benchmark").count()
    w = table(spark, sf, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 8").distinct()
    linked = docs.select("doc", (F.col("doc") % n).alias("item_id")).join(w, "item_id").select("doc", F.concat(F.lit("w/"), "word").alias("path"))
    hits = mentions.detect(docs, mentions.surfaces(names, ascii_only=True).where("exact"), every=True)
    return mentions.later_mentions(hits, linked, docs.select("doc", F.lit(100).alias("cursor"))).select("doc", "start", "surface")


@query
def single_link(spark, sf):
    """One link put in place of each part's first word; every third range no longer holds it."""
    p = table(spark, sf, "part")
    first = F.regexp_extract("p_name", r"^(\S+)", 1)
    said = F.when(F.col("p_partkey") % 3 == 0, F.lit("gone")).otherwise(first)
    return p.select("p_partkey", mentions.insert_link(F.concat(F.lit("a "), "p_name"), F.lit(2), F.length(first) + 2, said, F.col("p_type")).alias("body"))


@query
def skipped_spans(spark, sf):
    """Mentions between spans where none may be: of the five places of a word the plain ones count."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.regexp_extract("p_name", r"^(\S+)", 1).alias("w"))
    body = F.concat(F.lit("# "), "w", F.lit("\n`"), "w", F.lit("` [["), "w", F.lit("]] "), "w", F.lit("\n```\n"), "w", F.lit("\n```\nand "), "w")
    names = p.select(F.concat(F.lit("w/"), "w").alias("path"), F.col("w").alias("basename"), F.lit(None).cast("array<string>").alias("aliases")).distinct()
    return mentions.detect(p.select("doc", body.alias("body")), mentions.surfaces(names, ascii_only=True).where("exact"), every=True).select("doc", "start", "surface")


@query
def rebuild_predicate(spark, sf):
    """What a change of each setting asks for."""
    changed = {"model_id": "other", "device": "gpu", "index_speed": "fast", "chunking": False, "max_chunks": 64, "show_summary": True, "heading_context": True, "top_k": 20, "min_similarity": 0.5}
    rows = [(k, Options().rebuild(replace(Options(), **{k: v}))) for k, v in changed.items()]
    return spark.createDataFrame(rows, "setting string, rebuild string")


@query
def upserts(spark, sf):
    """Users as notes: an index of the first events, changed by all others in their order: purchases rename, clicks delete."""
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("u"), "event_id", "event_type")
    path = lambda c: F.concat(F.lit("u"), c.cast("string"), F.lit(".md"))
    held = e.groupBy("u").agg(F.min("event_id").alias("mtime")).select(path(F.col("u")).alias("path"), "mtime")
    op = F.when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "click", "delete").otherwise("modify")
    to = F.when(F.col("event_type") == "purchase", path((F.col("u") * 7 + F.col("event_id")) % 50))
    told = e.select(path(F.col("u")).alias("path"), op.alias("op"), to.alias("new_path"), F.col("event_id").alias("ts")).where("new_path IS NULL OR new_path <> path")
    return changes.upsert(held, told, lambda rows: rows.select("path", F.col("ts").alias("mtime")))


@query
def paragraph_split(spark, sf):
    """Paragraphs of the documents with their sentences' ends as line ends."""
    text = F.regexp_replace(F.regexp_replace("text", r"\. ", ".\n"), r"! |\? ", "\n\n\n")
    found = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.paragraphs(text)).alias("no", "p"))
    return found.select("doc_id", "no", F.md5(F.col("p").cast("binary")).alias("text_md5"))


@query
def whole_note_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.whole_note(F.concat(F.lit("note "), F.col("doc_id").cast("string")), F.col("text")).cast("binary")).alias("text_md5"))


@query
def cache_expiry(spark, sf):
    """Users' cached views that are still their last event."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("mtime"), "event_type")
    return changes.still_valid(e.where("event_type = 'view'").select("path", "mtime"), e.groupBy("path").agg(F.max("mtime").alias("mtime")))


@query
def index_header(spark, sf):
    """The header of an index of notes of ten chunks, from their places in one blob."""
    e = table(spark, sf, "embeddings")
    notes = e.groupBy(F.floor(F.col("vec_id") / 10).cast("string").alias("path")).agg(F.first(F.size("embedding")).alias("dims"), F.count("*").cast("int").alias("chunk_count"))
    return index_store.header(index_store.manifest(notes), "m", False)


@query
def index_round_trip(spark, sf):
    """The index written as tables and read back: rows that its guards keep."""
    import tempfile

    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("vec_id").alias("mtime"), F.size("embedding").alias("dims"), F.when(F.col("vec_id") % 7 == 0, 2).otherwise(1).alias("chunk_count"), vx.doubles(F.col("embedding")).alias("mean"), F.array(vx.quantize(F.col("embedding"))).alias("chunks"), F.lit(None).cast("array<string>").alias("chunk_texts"), F.lit("l").alias("label"), F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(0))).alias("idea_of"))
    dims = e.first().dims
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    path = f"{base}/lorewell-index-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    index_store.save(e, {"model_id": "m", "dims": dims}, path)
    return index_store.load(spark, path, "m", dims).select("path", "mtime", "label", F.size(F.coalesce("idea_of", F.array())).alias("n_ideas"))
