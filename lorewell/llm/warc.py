"""WARC archives: a writer and a splittable reader (operator 7).

The writer puts each record into a gzip member of its own. The reader cuts files into byte ranges, one task each: a
task looks for gzip magic from its range's start, accepts a member only if what it inflates begins with a WARC header,
and owns the records whose member starts inside its range, reading beyond the end to finish the last; so every
record is read once and whatever number of tasks share a file. Damaged members are reported, not passed over.

Scale: payload digests come first; only digests that occur twice are grouped, by partial aggregation, and those with
more than 1 / ``HOT`` of the rows (fewer than ``HOT`` of them) are joined by broadcast, so one payload of a third of
all pages meets in no single task. Pages whose digest a filter of bounded size knows as single pass by the join. Files are written under attempt names; the manifest lists what finished attempts
wrote. Paths may be of any filesystem that Arrow knows.

Defined cases: a null payload is empty; null page ids are written as such and are never the response that others
revisit unless all ids of the payload are null; a page_id that repeats with the same payload is a response each time
if it is the smallest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lorewell.llm.shared import id_filter, in_filter, shared_dir, small_batches

HOT = 1000
SPLIT_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member with one record. A revisit has the payload's digest and length in its header, and no block."""
    block = b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    head += [("WARC-Target-URI", "".join((url or "").split())), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Payload-Length", str(len(payload)))]
    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))] if revisit else []
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(_VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n") + out.flush()


_MANIFEST = "path string, n_bytes long, n_records long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        size = n = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            for batch in batches:
                for page_id, url, html, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    member = record(page_id, url, (html or "").encode(), refers_to, revisit)
                    f.write(member)
                    size, n = size + len(member), n + 1
        if n:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_bytes": [size], "n_records": [n]})

    return run


def _named(filter_, yes: bool):
    """Pages whose digest the filter of repeated ones names, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(filter_.value, batch.column(batch.schema.get_field_index("h")).to_numpy()) == yes))

    return run


def link_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with refers_to and revisit, from the smallest page_id of each payload that occurs more than once."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    groups = digests.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    path = shared_dir(spark)
    groups.write.parquet(path)  # also ends the lineage of what is joined twice
    groups = spark.read.parquet(path)
    n = pages.count()
    repeated = spark.sparkContext.broadcast(id_filter(groups.select(F.xxhash64("digest"))))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("h", F.xxhash64("digest"))
    single = pages.mapInArrow(_named(repeated, False), pages.schema).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    pages = pages.mapInArrow(_named(repeated, True), pages.schema).drop("h")
    hot = groups.where(F.col("n") * HOT > n).select("digest", F.col("refers_to").alias("hot_to"))  # fewer than HOT rows
    rest = groups.where(F.col("n") * HOT <= n).select("digest", "refers_to")
    known = pages.join(F.broadcast(hot), "digest", "left")
    # a hot row joins nothing by shuffle: its key becomes one that spreads and matches none
    known = known.withColumn("cold", F.when(F.col("hot_to").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    joined = known.join(rest.withColumnRenamed("digest", "cold"), "cold", "left").withColumn("refers_to", F.coalesce("hot_to", "refers_to"))
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return single.unionByName(joined.select("page_id", "url", "html", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit")))


def write_warc(pages: DataFrame, folder: str, *, least_bytes: int = 0) -> DataFrame:
    """Write pages to ``folder`` (a URI); the manifest of the finished files."""
    path = shared_dir(pages.sparkSession)
    link_copies(pages, least_bytes).mapInArrow(_write(folder), _MANIFEST).write.parquet(path)
    return pages.sparkSession.read.schema(_MANIFEST).parquet(path)


_RECORDS = "path string, at long, record_type string, record_id string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"


class _Window:
    """A file's bytes where the reader is, ``step`` at a time; only what no record began with is read again."""

    def __init__(self, f, step: int):
        self.f, self.step, self.base, self.held = f, step, 0, b""

    def at(self, where: int, least: int = 1) -> memoryview:
        """What is held from ``where`` on, ``least`` bytes or more unless the file ends before."""
        if not 0 <= where - self.base <= len(self.held) - least:
            self.f.seek(where)
            self.base, self.held = where, self.f.read(self.step)
        return memoryview(self.held)[where - self.base :]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds and where it ends; None if there is no whole WARC record."""
    out, parts, seen, used, take = zlib.decompressobj(31), [], 0, 0, 1 << 12
    while not out.eof:
        raw = window.at(at + used)[:take]
        if not len(raw):
            return None
        used, take = used + len(raw), min(2 * take, window.step)
        try:
            got = out.decompress(raw)
        except zlib.error:
            return None
        parts.append(got)
        seen += len(got)
        if seen >= len(_VERSION) and not b"".join(parts[:2]).startswith(b"WARC/1."):
            return None
    return (b"".join(parts), at + used - len(out.unused_data)) if seen else None


def _parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = fields.get("content-length", "")
    return (fields, rest[: int(n)]) if n.isdigit() and len(rest) >= int(n) else None


def read_range(f, start: int, end: int, step: int = 1 << 18) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records of the members that start in [start, end), and for bytes between members that are none a row of type
    ``damaged`` with their number as its length. What precedes the first member of a later range is its predecessor's."""
    window, at, known, lost = _Window(f, step), start, start == 0, -1
    damage = lambda to: (lost, {"warc-type": "damaged", "warc-payload-length": str(to - lost)}, b"")
    while at < end:
        if not known:  # look for magic that may also cross the end of what is held
            held = window.at(at, len(_MAGIC))
            found = bytes(held[: end - at + len(_MAGIC) - 1]).find(_MAGIC)
            if found < 0:
                at += max(1, min(len(held) - len(_MAGIC) + 1, end - at))
                continue
            at += found
        member = _member(window, at)
        fields = member and _parse(member[0])
        if not fields:
            lost = at if known else lost
            at, known = at + 1, False
            continue
        if lost >= 0:
            yield damage(at)
            lost = -1
        yield at, *fields
        at, known = member[1], True
    if lost >= 0:
        yield damage(min(at, end))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for path, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
            fs, local = pafs.FileSystem.from_uri(path)
            held, weight = [], 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

            with fs.open_input_file(local) as f:
                for at, h, payload in read_range(f, start, end):
                    revisit = h.get("warc-type") in ("revisit", "damaged")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None if revisit else base32_sha1(payload)
                    n = int(h.get("warc-payload-length", "0")) if revisit else len(payload)
                    held.append((path, at, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), n, digest, payload))
                    weight += len(payload)
                    if weight > 4 << 20:
                        yield out()
                        held, weight = [], 0
            if held:
                yield out()


def read_warc(manifest: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the files in ``manifest`` (path, n_bytes), see ``_RECORDS``; bytes that are in no record give a row of
    record_type ``damaged`` each run of them, whose payload_bytes is their number."""
    starts = F.explode(F.expr(f"sequence(0L, greatest(n_bytes - 1, 0L), {split_bytes}L)"))
    ranges = manifest.select("path", "n_bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "n_bytes"))
    n = max(1, min(1 << 16, ranges.count()))
    return ranges.repartition(n, "path", "start").mapInArrow(_read, _RECORDS)


def page_id(urn: str):
    """The page id of a record's URN; null for a null id."""
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(-?[0-9]+)>$', 1) as long)")
