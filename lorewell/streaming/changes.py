"""Changes of notes: coalescing, latest state, reuse of vectors, and upserts from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F


def latest(changes: DataFrame, key: str = "path", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last change of each key: one partial aggregate, no sort."""
    row = F.struct(*order, *(c for c in changes.columns if c not in (key, *order)))
    return changes.groupBy(key).agg(F.max(row).alias("r")).select(key, "r.*")


def coalesced(changes: DataFrame, gap: str, key: str = "path", time: str = "ts") -> DataFrame:
    """Bursts of changes less than ``gap`` apart: key, start, end, n. Works on streams with a watermark."""
    return changes.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(changes: DataFrame, gap_seconds: int, key: str = "path", time: str = "ts") -> DataFrame:
    """The batch form by window functions: key, first, last, n."""
    w = Window.partitionBy(key).orderBy(time)
    new = (F.col(time).cast("double") - F.lag(F.col(time).cast("double")).over(w) >= gap_seconds) | F.lag(time).over(w).isNull()
    numbered = changes.withColumn("s", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "s").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("s")


def to_embed(notes: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Notes whose path and mtime the index doesn't hold."""
    return notes if force else notes.join(index.select("path", "mtime"), ["path", "mtime"], "left_anti")


def still_valid(cache: DataFrame, notes: DataFrame) -> DataFrame:
    """cache: path, mtime, ... -> the entries whose note is still there with the same mtime; others have expired."""
    return cache.join(notes.select("path", "mtime").distinct(), ["path", "mtime"], "left_semi")


def _settled(changes: DataFrame) -> DataFrame:
    """What a batch of changes (path, op, new_path, ts, ...) leaves: path, root, gone (a row of the index that is no more), touched (the last create or modify).

    Each path's time is cut into stays by what arrives at it, leaves or is deleted. A stay begins empty, with the index's
    row (the first) or with what a rename brought, whose stay is the one before; stays are followed back to their first
    by pointer doubling, one small join a round.
    """
    order = F.struct("ts", F.when(F.col("op") == "rename", F.coalesce("new_path", F.lit(""))).otherwise(F.lit("")).alias("to"))
    events = changes.select("path", "op", "new_path", order.alias("t"), F.struct(*changes.columns).alias("row"))
    arrive = events.where("op = 'rename' AND new_path IS NOT NULL").select(F.col("new_path").alias("path"), F.lit("arrive").alias("op"), F.col("path").alias("new_path"), "t", F.lit(None).cast(events.schema["row"].dataType).alias("row"))
    ends = F.col("op").isin("rename", "delete", "arrive").cast("int")
    by = Window.partitionBy("path").orderBy("t", F.col("op") == "arrive")
    told = events.unionByName(arrive).withColumn("stay", F.sum(ends).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    touched = told.where("op IN ('create', 'modify')").groupBy("path", "stay").agg(F.max(F.struct("t", "row")).alias("last"))
    left = told.where("op = 'rename'").select(F.col("path").alias("source"), F.col("new_path").alias("path"), "t", (F.col("stay") - 1).alias("source_stay"))
    came = told.where("op = 'arrive'").select("path", F.col("new_path").alias("source"), "t", "stay").join(left, ["source", "path", "t"])
    first = told.groupBy("path").agg(F.max("stay").alias("last_stay")).select("path", F.explode(F.sequence(F.lit(0), F.col("last_stay"))).alias("stay"), "last_stay")
    stays = first.join(came.select("path", "stay", "source", "source_stay"), ["path", "stay"], "left").join(touched, ["path", "stay"], "left").persist()
    at = stays.select("path", "stay", "source", "source_stay", F.coalesce("source", "path").alias("root"), F.coalesce("source_stay", "stay").alias("root_stay"), "last")
    while not at.where("source IS NOT NULL").isEmpty():
        before = at.select(F.col("path").alias("source"), F.col("stay").alias("source_stay"), F.col("source").alias("s"), F.col("source_stay").alias("n"), F.col("root").alias("r"), F.col("root_stay").alias("k"), F.col("last").alias("l"))
        at = at.join(before, ["source", "source_stay"], "left").select("path", "stay", F.col("s").alias("source"), F.col("n").alias("source_stay"), F.coalesce("r", "root").alias("root"), F.coalesce("k", "root_stay").alias("root_stay"), F.coalesce("last", "l").alias("last")).persist()
    final = at.join(stays.select("path", "stay", "last_stay"), ["path", "stay"]).where("stay = last_stay")
    return final.select("path", F.when(F.col("root_stay") == 0, F.col("root")).alias("root"), F.col("last.row").alias("touched"))


def upsert(index: DataFrame, changes: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """index after changes (path, op, new_path, ts, ...), in the order of ts: removed, renamed without embedding, embedded anew.

    Renames are followed to their end, in chains too; a note that was changed before it was renamed is embedded under its
    last path. A path that another note is renamed to loses its own; a note renamed to what is no Markdown file is removed.
    """
    settled = _settled(changes).where(F.col("path").endswith(".md")).persist()
    met = changes.select("path").unionByName(changes.where("new_path IS NOT NULL").select(F.col("new_path").alias("path"))).distinct()
    rest = index.join(met, "path", "left_anti")
    moved = settled.where("touched IS NULL AND root IS NOT NULL").select(F.col("path").alias("__to"), F.col("root").alias("path"))
    moved = index.join(moved, "path").withColumn("path", F.col("__to")).select(index.columns)
    row = [F.col(f"touched.{c}").alias(c) if c != "path" else F.col("path") for c in changes.columns]
    fresh = embed(settled.where("touched IS NOT NULL").select(row))
    return rest.unionByName(moved).unionByName(fresh.select(index.columns))


def stream_upserts(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], embed: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A streaming query that applies each micro-batch; ``write`` gets the new index and the batch number, so that a repeat overwrites itself."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: write(upsert(read(), batch, embed), n)).start()
