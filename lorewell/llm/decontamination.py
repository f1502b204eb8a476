"""Benchmark passages in documents: a prefix-filtered set join, with DataFrame functions only (operator 6).

Every benchmark item gives windows of its consecutive words (an item below the window's length is one window). A
document window that contains a window's words in their order contains its rarest word, so the prefix that must be
joined is one token: tokens are ordered by how many times all documents hold them, and each window is indexed by its
rarest. A document token that equals it gives a candidate whose start follows from the token's place in the window
(positional bound) and must leave room for all its words (length bound); the words at that place are then compared.

Scale: with an index of at most ``BROADCAST_BYTES``, which is broadcast, document tokens are exploded and joined inside one
stage, and nothing but candidates and a row a document is shuffled; words of at most ``LITERAL_BYTES`` become a literal
set. A larger index is joined by shuffle: tokens travel alone (row, place, word), filtered by the index's words first, and
only rows with a candidate meet their text again. Long documents cost their own words only; a hot passage costs its
occurrences, and a hot word's rows are a skewed join that Spark splits.

Defined cases: null or empty texts and items have no words and match nothing; repeated rows are answered each;
repeated items with the same id count once; null item ids are ignored; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorewell.llm.shared import cut

WINDOW = 10
BROADCAST_BYTES = 64 << 20
LITERAL_BYTES = 1 << 20
CANDIDATES = 3
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words in their own case. A-Z are folded where words are compared: ``lower`` of one word depends on it alone."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that hold them: words, items."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(fold(F.col("text"))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - length, F.lit(0))
    cut_out = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.slice("w", i, length))).alias("words"))
    return cut_out.groupBy("words").agg(F.collect_set("item_id").alias("items"))


def _among(tokens: DataFrame, vocabulary: DataFrame, also: Column | None = None) -> DataFrame:
    """Rows whose ``rare`` is in a vocabulary: a literal set while that is small, which compiles with the explode, else a join."""
    if (vocabulary.agg(F.sum(F.octet_length("rare") + 16)).first()[0] or 0) <= LITERAL_BYTES:
        known = F.col("rare").isin([r[0] for r in vocabulary.collect()])
        return tokens.where(known if also is None else known | also)
    return tokens.join(vocabulary, "rare", "left_semi") if also is None else tokens


def index(benchmark: DataFrame, docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """Windows by their rarest word: rare, place (from 0), phrase, n, items.

    Of each window the ``CANDIDATES`` words that fewest windows hold are counted in all documents.
    """
    tokens = cut(windows(benchmark, length).select("*", F.posexplode("words").alias("place", "word")).withColumn("rare", F.lower("word")))
    held = tokens.groupBy("rare").agg(F.count("*").alias("held"))
    order = Window.partitionBy("words").orderBy("held", F.desc(F.length("rare")), "place")
    tokens = cut(tokens.join(held, "rare").withColumn("k", F.row_number().over(order)).where(F.col("k") <= CANDIDATES))
    # the outer form: of the inner one Spark infers a filter that splits every text again
    met = docs.select(F.explode_outer(words(F.col("text"))).alias("w")).select(F.lower("w").alias("rare"))
    counts = _among(met, tokens.select("rare").distinct()).groupBy("rare").count()
    ranked = tokens.join(counts, "rare", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "rare", "place")).alias("r"), F.first("items").alias("items"))
    return ranked.select("r.rare", "r.place", F.array_join("words", " ").alias("phrase"), F.size("words").alias("n"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, length: int = WINDOW) -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, n_items, items (ids), hits (places of hit words, from 0), contaminated."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    idx = cut(index(benchmark, docs, length))
    size = idx.agg(F.sum(F.octet_length("phrase") + F.octet_length("rare") + 12 * F.size("items") + 64)).first()[0] or 0
    by_doc = (_beside if size <= BROADCAST_BYTES else _apart)(docs, idx)
    return by_doc.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits", (F.size("hits") > 0).alias("contaminated"))


def _same(w: Column, start: Column, n: Column, phrase: Column) -> Column:
    return fold(F.array_join(F.slice(w, F.greatest(start, F.lit(0)) + 1, n), " ")) == phrase


def _beside(docs: DataFrame, idx: DataFrame) -> DataFrame:
    """doc_id, n_words, hits, items, with the index broadcast: tokens, candidates and their comparison in one stage."""
    first = F.col("pos").isNull() | (F.col("pos") == 0)  # a row for every document
    tokens = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    tokens = tokens.select("doc_id", "row", "w", F.posexplode_outer("w").alias("pos", "word"))
    met = _among(tokens.withColumn("rare", F.lower("word")), idx.select("rare").distinct(), first).join(F.broadcast(idx), "rare", "left")
    start = F.col("pos") - F.col("place")
    fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
    # functions that compile with the explode and the join (no lambdas), so that rows are made for matches only
    match = F.coalesce(fits & _same(F.col("w"), start, F.coalesce("n", F.lit(1)), F.col("phrase")), F.lit(False))
    kept = met.where(match | first)
    kept = kept.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.when(match, start).alias("start"), "n", "items")
    hit = F.when(F.col("start").isNotNull(), F.sequence("start", F.col("start") + F.col("n") - 1))
    some = F.when(F.col("start").isNotNull(), F.col("items"))
    return kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(hit)))).alias("hits"), F.array_distinct(F.flatten(F.collect_list(some))).alias("items"))


def _apart(docs: DataFrame, idx: DataFrame) -> DataFrame:
    """The same by shuffles. The documents are written once with their row numbers, so that all plans read the same."""
    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", words(F.col("text")).alias("w")).select("row", F.size("w").alias("size"), F.posexplode("w").alias("pos", "word"))
    tokens = _among(found.select("row", "size", "pos", F.lower("word").alias("rare")), idx.select("rare").distinct())
    start = F.col("pos") - F.col("place")
    met = tokens.join(idx, "rare").where((start >= 0) & (start + F.col("n") <= F.col("size"))).select("row", F.struct(start.alias("start"), "n", "phrase", "items").alias("c"))
    candidates = met.groupBy("row").agg(F.collect_list("c").alias("c"))
    joined = rows.select("row", "doc_id", words(F.col("text")).alias("w")).join(candidates, "row", "left")
    true = F.filter(F.coalesce("c", F.array().cast(candidates.schema["c"].dataType)), lambda x: _same(F.col("w"), x["start"], x["n"], x["phrase"]))
    told = joined.select("doc_id", F.size("w").cast("long").alias("n_words"), true.alias("c"))
    hits = F.flatten(F.transform("c", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    return told.select("doc_id", "n_words", F.array_sort(F.array_distinct(hits)).alias("hits"), F.array_distinct(F.flatten("c.items")).alias("items"))
