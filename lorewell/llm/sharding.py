"""Shards of bounded bytes by extendible hashing, with DataFrame functions only (operator 3).

A row's key hash gives its bucket: the root holds all rows; a bucket above the byte limit splits on the next hash bit,
and only such a bucket does, so shards are the leaves of a binary trie. A round aggregates the bytes of hash cells
``ROUND_BITS`` deeper than the open buckets and finds the leaves among all depths at once; rows whose cell is still
open take part in the next round. The directory is joined by cell, never collected.

A bucket whose rows all share one hash can't split on it. Its rows split the same way on the bits of a hash of their
own row number (overflow pages), so a key that holds a third of all rows fills many shards. A single row above the
limit is a shard by itself, ``oversized``.

Defined cases: a null key hashes as the empty string; null text has 0 bytes; an empty table gives no rows; repeated
rows are placed each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorewell.llm.shared import cut

BITS = 60
ROUND_BITS = 16


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column) -> Column:
    """The first ``depth`` bits; shiftright takes no column."""
    return F.call_function("shiftright", bits, F.lit(BITS) - depth)


def _bits(bits: Column, depth: Column) -> Column:
    return F.substring(F.lpad(F.conv(bits.cast("string"), 10, 2), BITS, "0"), F.lit(1), depth)


def _leaves(rows: DataFrame, limit: int) -> DataFrame:
    """rows: group, bits, n_bytes, ... -> with depth, shard_bytes, shard_rows, single (all rows share all bits)."""
    done, open_ = None, rows
    for base in range(0, BITS, ROUND_BITS):
        deep = min(BITS, base + ROUND_BITS)
        cell = F.shiftright("bits", BITS - deep)
        cells = open_.groupBy("group", cell.alias("cell")).agg(F.sum("n_bytes").alias("n"), F.count("*").alias("r"), F.min("bits").alias("lo"), F.max("bits").alias("hi"))
        depths = cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth")).withColumn("prefix", _prefix(F.col("lo"), F.col("depth")))
        sums = depths.groupBy("group", "depth", "prefix").agg(F.sum("n").alias("shard_bytes"), F.sum("r").alias("shard_rows"), F.min("lo").alias("least"), F.max("hi").alias("most"))
        closed = sums.where((F.col("shard_bytes") <= limit) | (F.col("least") == F.col("most"))).withColumn("single", F.col("least") == F.col("most"))
        found = (
            depths.select("group", "cell", "depth", "prefix").join(closed, ["group", "depth", "prefix"])
            .groupBy("group", "cell").agg(F.min_by(F.struct("depth", "shard_bytes", "shard_rows", "single"), "depth").alias("leaf"))
        )
        if base == 0:  # all rows that can close do so here, mostly; the directory then has 2**16 cells a group at most
            found = cut(found)
        placed = open_.withColumn("cell", cell).join(found, ["group", "cell"], "left").drop("cell")
        here = placed.where(F.col("leaf").isNotNull()).select(*rows.columns, "leaf.*")
        done = here if done is None else done.unionByName(here)
        if deep == BITS:
            return done
        left = placed.where(F.col("leaf").isNull()).select(*rows.columns)
        if left.isEmpty():
            return done
        open_ = cut(left)
    return done


def assign_shards(df: DataFrame, *, key: str = "doc_id", payload: str = "text", limit: int = 1 << 20) -> DataFrame:
    """key, n_bytes, shard (its hash bits; a page's follow a dot), depth, shard_bytes, shard_rows, oversized."""
    n_bytes = F.coalesce(F.octet_length(payload).cast("long"), F.lit(0).cast("long"))
    rows = df.select(F.col(key).alias("k"), key_hash(F.col(key)).alias("bits"), n_bytes.alias("n_bytes"), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4).alias("salt"), F.lit("").alias("group"))
    placed = _leaves(cut(rows), limit).withColumn("shard", _bits(F.col("bits"), F.col("depth")))
    full = F.col("single") & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    whole = placed.where(~full)
    chained = placed.where(full)
    if not chained.isEmpty():
        pages = _leaves(cut(chained.select("k", F.col("salt").alias("bits"), "n_bytes", "salt", F.col("shard").alias("group"), F.col("depth").alias("above"))), limit)
        pages = pages.withColumn("shard", F.concat("group", F.lit("."), _bits(F.col("bits"), F.col("depth")))).withColumn("depth", F.col("depth") + F.col("above"))
        whole = whole.unionByName(pages, allowMissingColumns=True)
    return whole.select(F.col("k").alias(key), "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized"))
