"""A training corpus from ``documents``: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.llm import decontamination, language_id, near_dedup, segmentation, substring_dedup
from lorewell.llm.shared import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, or unlike every language learned, go."""
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8: that of the smallest id.

    Rows that share its id and text stay one, the least by their other columns; other texts under its id stay too.
    """
    found = near_dedup.near_duplicates(docs, width=5).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    known = docs.join(found, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("__rest"))
    return known.select("doc_id", "text", "__rest.*").select(docs.columns).unionByName(docs.where("doc_id is null"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a smaller id has; untouched texts keep their white space."""
    names = docs.columns
    own = substring_dedup.remove_repeats(docs.withColumn("__own", F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("__own"))
    out = own.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word passage of a benchmark item."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.coalesce("doc_id", F.lit(-1)).alias("bad")).distinct()
    return docs.join(bad, F.coalesce("doc_id", F.lit(-1)) == F.col("bad"), "left_anti").select(docs.columns)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, with inclusion scores."""
    found = segmentation.sample_segmentations(docs)
    return found.select("doc_id", "sample", "n_pieces", "pieces", "log_prob", "inclusion", "exact")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("decontamination", drop_contaminated),
    ("segmentation", sample_pieces),
]
#: Sampling and the language models have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
