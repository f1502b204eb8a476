"""A made-up index of any size: notes of a title and up to 32 more chunks, with unit vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorewell.functions import vectors as vx

#: Fixed values of the shape.
NOTES, DIMS, SPAN, FIRST_MTIME = 1000, 384, 16, 1_700_000_000_000


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: any row can be made anywhere, in any order."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def index(spark: SparkSession, notes: int = NOTES, dims: int = DIMS, seed: int = 1) -> DataFrame:
    """path, mtime, dims, chunk_count, chunks array<struct<q, scale>>, mean: 1 to 33 chunks a note, most often 17."""
    n = spark.range(notes).withColumnRenamed("id", "note")
    s = F.lit(seed)
    n = n.withColumn("chunk_count", (1 + F.floor((uniform(s, "note", F.lit(-1)) + uniform(s, "note", F.lit(-2))) * SPAN + 0.5)).cast("int"))
    raw = lambda c: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: uniform(s, F.col("note"), c, i) * 2 - 1)
    rows = F.transform(F.sequence(F.lit(0), F.col("chunk_count") - 1), lambda c: vx.quantize(vx.unit(raw(c))))
    path = F.concat(F.lit("notes/note-"), F.col("note").cast("string"), F.lit(".md"))
    made = n.select(path.alias("path"), (F.col("note") + FIRST_MTIME).alias("mtime"), F.lit(dims).alias("dims"), "chunk_count", rows.alias("chunks"))
    zero = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda _: F.lit(0.0))
    sums = F.aggregate("chunks", zero, lambda s, c: F.zip_with(s, vx.dequantize(c["q"], c["scale"]), lambda x, y: x + y))
    return made.withColumn("mean", vx.unit(sums))
