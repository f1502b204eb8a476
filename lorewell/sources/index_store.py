"""The persisted index: Parquet tables, their guards, and the legacy text codecs of int8 rows."""

from __future__ import annotations

import base64
import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

VERSION = 4


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, basename, folder, body, mtime (ms) of all Markdown files below a folder, but empty ones, which Spark's file sources skip."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.unix_millis("_metadata.file_modification_time").alias("mtime"))
    return rows.select("path", F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("basename"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "body", "mtime")


def read_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, basename string, body string, links array<string>").json(path, multiLine=True)


def in_folder(path: Column, folder: Column) -> Column:
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def without_folders(notes: DataFrame, folders: DataFrame) -> DataFrame:
    """notes outside all folders. An equi join on a path's own ancestors, not a scan of folders for each note."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    named = folders.select(F.regexp_replace(F.trim("folder"), "/+$", "").alias("folder")).where("folder <> ''")
    bad = notes.select("path", F.explode(above).alias("folder")).join(named, "folder", "left_semi").select("path").distinct()
    return notes.join(bad, "path", "left_anti")


def save(entries: DataFrame, meta: dict, path: str) -> None:
    """entries: path, mtime, dims, chunk_count, mean, chunks array<struct<q, scale>>, chunk_texts, label, idea_of."""
    entries.drop("label").write.mode("overwrite").parquet(f"{path}/entries")
    entries.select("path", "label").write.mode("overwrite").parquet(f"{path}/labels")
    entries.sparkSession.createDataFrame([(VERSION, meta["model_id"], meta["dims"])], "version int, model_id string, dims int").write.mode("overwrite").parquet(f"{path}/meta")


def save_labels(labels: DataFrame, path: str) -> None:
    """Rewrites labels alone; vectors stay."""
    labels.select("path", "label").write.mode("overwrite").parquet(f"{path}/labels")


def guarded(entries: DataFrame, dims: int) -> DataFrame:
    """Rows whose vectors have the right lengths; idea numbers of a wrong length become null."""
    fine = (F.size("mean") == dims) & (F.size("chunks") == F.col("chunk_count")) & F.forall("chunks", lambda c: (F.size(c["q"]) == dims) & c["scale"].isNotNull())
    return entries.where(F.coalesce(fine, F.lit(False))).withColumn("idea_of", F.when(F.size("idea_of") == F.col("chunk_count"), F.col("idea_of")))


def load(spark: SparkSession, path: str, model_id: str, dims: int) -> DataFrame | None:
    """The index, or None if its version, model or dimensions differ."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if (meta.version, meta.model_id, meta.dims) != (VERSION, model_id, dims):
        return None
    return guarded(spark.read.parquet(f"{path}/entries"), dims).join(spark.read.parquet(f"{path}/labels"), "path", "left")


def to_base64(q: list[int]) -> str:
    return base64.b64encode(np.array(q, np.int8).tobytes()).decode()


def from_base64(text: str) -> list[int]:
    return np.frombuffer(base64.b64decode(text), np.int8).tolist()


_LEGACY = "path string, mtime long, dims int, chunkCount int, meanVector array<double>, chunks struct<scales: array<double>, q: string>"


def _base64_of(q: Column) -> Column:
    """array<tinyint> as base64 of its bytes."""
    digits = F.transform(q, lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit(255)).cast("long")), 2, "0"))
    return F.base64(F.unhex(F.array_join(digits, "")))


def _int8_of(text: Column) -> Column:
    """The bytes of base64 as signed numbers."""
    digits = F.regexp_extract_all(F.hex(F.unbase64(text)), F.lit("(..)"), F.lit(1))
    return F.transform(digits, lambda d: (F.pmod(F.conv(d, 16, 10).cast("int") + 128, F.lit(256)) - 128).cast("tinyint"))


def to_legacy(entries: DataFrame) -> DataFrame:
    """One column ``value``: a JSON object for each entry, all chunks' int8 rows as one base64 text (version 3)."""
    flat = F.struct(F.col("chunks.scale").alias("scales"), _base64_of(F.flatten("chunks.q")).alias("q"))
    return entries.select(F.to_json(F.struct("path", "mtime", "dims", F.col("chunk_count").alias("chunkCount"), F.col("mean").alias("meanVector"), flat.alias("chunks"))).alias("value"))


def from_legacy(lines: DataFrame) -> DataFrame:
    """What ``to_legacy`` took. Entries that don't parse, or whose bytes or scales don't fit their counts, are left out."""
    e = lines.select(F.from_json("value", _LEGACY).alias("e")).select("e.*").withColumn("flat", _int8_of(F.col("chunks.q")))
    fits = (F.size("flat") == F.col("chunkCount") * F.col("dims")) & (F.size("chunks.scales") == F.col("chunkCount")) & (F.size("meanVector") == F.col("dims"))
    row = lambda s, i: F.struct(F.slice("flat", i * F.col("dims") + 1, F.col("dims")).alias("q"), s.alias("scale"))
    kept = e.where(F.coalesce(fits & (F.col("dims") > 0), F.lit(False)))
    return kept.select("path", "mtime", "dims", F.col("chunkCount").alias("chunk_count"), F.col("meanVector").alias("mean"), F.transform("chunks.scales", row).alias("chunks"))


def manifest(entries: DataFrame, buckets: int = 256) -> DataFrame:
    """entries: path, dims, chunk_count, ... -> with mean_offset and chunk_offset: where each entry's bytes lie in one blob
    that holds all float32 means first, then all int8 chunks, in the order of a hash bucket and the path.

    Offsets are running sums within a bucket and the sums of the buckets before, so no task sees more than a bucket.
    """
    sized = entries.withColumn("__bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).withColumn("__mean", 4 * F.col("dims").cast("long")).withColumn("__chunks", F.col("dims").cast("long") * F.col("chunk_count"))
    sums = sized.groupBy("__bucket").agg(F.sum("__mean").alias("m"), F.sum("__chunks").alias("c"))
    before = sums.alias("x").join(sums.alias("y"), F.col("y.__bucket") < F.col("x.__bucket"), "left").groupBy("x.__bucket").agg(F.coalesce(F.sum("y.m"), F.lit(0)).alias("m0"), F.coalesce(F.sum("y.c"), F.lit(0)).alias("c0"))
    before = before.crossJoin(sums.agg(F.sum("m").alias("all_means")))
    own = Window.partitionBy("__bucket").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("m", F.coalesce(F.sum("__mean").over(own), F.lit(0))).withColumn("c", F.coalesce(F.sum("__chunks").over(own), F.lit(0))).join(F.broadcast(before), "__bucket")
    return placed.withColumn("mean_offset", F.col("m0") + F.col("m")).withColumn("chunk_offset", F.col("all_means") + F.col("c0") + F.col("c")).select(*entries.columns, "mean_offset", "chunk_offset")


def header(placed: DataFrame, model_id: str, has_chunk_text: bool) -> DataFrame:
    """One row: version, model_id, dims, quantized, has_chunk_text, total_bytes, of what ``manifest`` placed."""
    total = F.coalesce(F.sum(4 * F.col("dims").cast("long") + F.col("dims").cast("long") * F.col("chunk_count")), F.lit(0))
    return placed.agg(F.lit(VERSION).alias("version"), F.lit(model_id).alias("model_id"), F.coalesce(F.max("dims"), F.lit(0)).alias("dims"), F.lit(True).alias("quantized"), F.lit(has_chunk_text).alias("has_chunk_text"), total.alias("total_bytes"))


def pack(entries: list[dict]) -> tuple[str, bytes]:
    """A manifest and one blob: all float32 means first, then all int8 chunks, with byte offsets in the manifest."""
    means = [np.array(e["mean"], "<f4").tobytes() for e in entries]
    rows = [b"".join(np.array(c, np.int8).tobytes() for c in e["chunks"]) for e in entries]
    at, out = sum(map(len, means)), []
    mean_at = 0
    for e, m, r in zip(entries, means, rows):
        out.append({k: v for k, v in e.items() if k not in ("mean", "chunks")} | {"mean_offset": mean_at, "chunk_offset": at, "chunk_count": len(e["chunks"])})
        mean_at, at = mean_at + len(m), at + len(r)
    blob = b"".join(means + rows)
    return json.dumps({"version": VERSION, "dims": len(entries[0]["mean"]) if entries else 0, "total_bytes": len(blob), "entries": out}), blob


def unpack(manifest: str, blob: bytes) -> list[dict]:
    """The entries whose bytes are all there."""
    head = json.loads(manifest)
    dims, out = head["dims"], []
    for e in head["entries"]:
        a, b, n = e["mean_offset"], e["chunk_offset"], e["chunk_count"]
        if a + 4 * dims > len(blob) or b + n * dims > len(blob) or len(e.get("scales", [0] * n)) != n:
            continue
        kept = {k: v for k, v in e.items() if not k.endswith("_offset")}
        if len(kept.get("idea_of") or []) != n:
            kept.pop("idea_of", None)
        kept["mean"] = np.frombuffer(blob, "<f4", dims, a).tolist()
        kept["chunks"] = np.frombuffer(blob, np.int8, n * dims, b).reshape(n, dims).tolist()
        out.append(kept)
    return out
