"""A dictionary of note titles and its mentions in documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lorewell.functions.text import inflect, normalize, wikilink
from lorewell.functions.vectors import dot

LEAST = 3


def surfaces(notes: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """notes: path, basename, aliases -> surface, path, exact: names and aliases of three letters or more, and the other
    number of each, unless some note owns that exactly."""
    named = notes.select("path", F.explode(F.concat(F.array("basename"), F.coalesce("aliases", F.array()))).alias("s"))
    exact = named.select(normalize(F.col("s"), ascii_only).alias("surface"), "path").where(F.length("surface") >= LEAST).distinct()
    variant = exact.select(inflect(F.col("surface")).alias("surface"), "path").where(F.length("surface") >= LEAST).distinct()
    variant = variant.join(exact.select("surface"), "surface", "left_anti")
    return exact.withColumn("exact", F.lit(True)).unionByName(variant.withColumn("exact", F.lit(False)))


def resolve(dictionary: DataFrame) -> DataFrame:
    """surface, path (the shortest, then the first), ambiguous (several notes own it)."""
    return dictionary.groupBy("surface").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"), (F.countDistinct("path") > 1).alias("ambiguous"), F.max("exact").alias("exact"))


def skip_spans(text: str) -> list[tuple[int, int]]:
    """Where no mention may be: frontmatter, fences (an unclosed one to the end), code, links, images, top headings."""
    out = []
    if m := re.match(r"---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)", text, re.S):
        out.append(m.span())
    begin, at = None, 0
    for line in text.splitlines(keepends=True):
        if line.lstrip().startswith(("```", "~~~")):
            if begin is None:
                begin = at
            else:
                out.append((begin, at + len(line)))
                begin = None
        elif begin is None and line.startswith("# "):
            out.append((at, at + len(line)))
        at += len(line)
    if begin is not None:
        out.append((begin, len(text)))
    for pattern in (r"`[^`\n]+`", r"!?\[\[[^\]\n]*\]\]", r"!?\[[^\]\n]*\]\([^)\n]*\)"):
        out += [m.span() for m in re.finditer(pattern, text)]
    return sorted(out)


def _composed(text: str) -> tuple[str, list[int], list[int]]:
    """The text in NFC, and where in the text each of its characters begins and ends."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text, list(range(len(text))), list(range(1, len(text) + 1))
    out, begins, ends = [], [], []
    at, held = 0, ""
    for i, c in enumerate([*text, ""]):
        own = unicodedata.normalize("NFC", held + c)
        if held and (not c or (not unicodedata.combining(c) and own == unicodedata.normalize("NFC", held) + unicodedata.normalize("NFC", c))):
            made = unicodedata.normalize("NFC", held)
            out.append(made)
            begins += [at] * len(made)
            ends += [i] * len(made)
            at, held = i, ""
        held += c
    return "".join(out), begins, ends


def _fold(text: str) -> tuple[str, list[int], list[int]]:
    """NFC, lower case and single blanks, and where in the text each character begins and ends."""
    text, begins, ends = _composed(text)
    out, first, last = [], [], []
    for i, c in enumerate(text):
        c = " " if c.isspace() else c.lower()
        if c == " " and out and out[-1] == " ":
            continue
        for x in c:
            out.append(x)
            first.append(begins[i])
            last.append(ends[i])
    return "".join(out), first, last


def hits_in(text: str, automaton, own: str | None = None) -> list[tuple]:
    """Every hit: start, -end, surface, path, ambiguous, and whether it may be given (it is no self link and in no skipped span)."""
    folded, first, last = _fold(text)
    word = [c.isalnum() for c in folded]
    spans, hits = skip_spans(text), []
    for end, (surface, path, ambiguous, exact) in automaton.iter(folded):
        start = end - len(surface) + 1
        if (start and word[start - 1]) or (end + 1 < len(word) and word[end + 1]) or (exact and path == own):
            continue
        a, b = first[start], last[end]
        hits.append((a, -b, surface, path, ambiguous, path != own and not any(x < b and a < y for x, y in spans)))
    return hits


def without_overlap(hits: Iterable[tuple]) -> Iterator[tuple]:
    """From left to right, longest first: a hit that may not be given still takes its text."""
    at = -1
    for hit in sorted(hits):
        if hit[0] >= at:
            at = -hit[1]
            if hit[5]:
                yield hit


def automaton_of(rows):
    a = ahocorasick.Automaton()
    for surface, path, ambiguous, exact in rows:
        a.add_word(surface, (surface, path, ambiguous, exact))
    if len(a):
        a.make_automaton()
    return a


def topic_gate(vectors: DataFrame, pairs: DataFrame, floor: float = 0.0) -> DataFrame:
    """pairs: doc, path; vectors: id, v (centred) -> the pairs that are off topic: both have a vector and score below ``floor``."""
    a, b = vectors.select(F.col("id").alias("doc"), F.col("v").alias("x")), vectors.select(F.col("id").alias("path"), F.col("v").alias("y"))
    return pairs.join(a, "doc").join(b, "path").where(dot(F.col("x"), F.col("y")) < floor).select("doc", "path")


_HIT = "start int, end int, surface string, path string, ambiguous boolean, text string"


def detect(docs: DataFrame, dictionary: DataFrame, *, every: bool = False, allow_ambiguous: bool = False, gate: DataFrame | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """docs: doc, body -> doc, start, end, surface, path, ambiguous, text. The first of each target unless ``every``.

    ``gate`` (doc, path) lists pairs that are off topic. Offsets are those of the body as it is, whatever its
    normalisation. A dictionary of at most ``broadcast_bytes`` is broadcast and scanned for at once; a larger one in hash
    parts of that size, one broadcast and pass over the documents each, whose hits are resolved together by document.
    """
    spark = docs.sparkSession
    named = resolve(dictionary).select("surface", "path", "ambiguous", "exact").persist()
    size = named.agg(F.sum(F.octet_length("surface") + F.octet_length("path") + 80)).first()[0] or 0
    parts = max(1, -(-size // broadcast_bytes))
    kind = dict(docs.dtypes)["doc"]
    names = ["doc", "start", "end", "surface", "path", "ambiguous", "text"]

    def scanner(rows, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = automaton_of(zip(*rows.value))
            for batch in batches:
                found = []
                for doc, body in zip(batch["doc"], batch["body"]) if len(automaton) else ():
                    if body:
                        hits = hits_in(body, automaton, str(doc))
                        found += [(doc, a, -b, s, p, m, body[a:-b], given) for a, b, s, p, m, given in (without_overlap(hits) if last else hits)]
                yield pd.DataFrame(found, columns=[*names, "given"])

        return run

    hits = None
    for part in range(parts):
        rows = named.where(F.pmod(F.xxhash64("surface"), F.lit(parts)) == part).toArrow()
        rows = spark.sparkContext.broadcast([c.to_pylist() for c in rows.columns])
        found = docs.select("doc", "body").mapInPandas(scanner(rows, parts == 1), f"doc {kind}, {_HIT}, given boolean")
        hits = found if hits is None else hits.unionByName(found)
    if parts > 1:

        def settle(rows: pd.DataFrame) -> pd.DataFrame:
            order = [(r.start, -r.end, r.surface, r.path, r.ambiguous, r.given, i) for i, r in enumerate(rows.itertuples())]
            return rows.iloc[[h[6] for h in without_overlap(order)]]

        hits = hits.groupBy("doc").applyInPandas(settle, hits.schema)
    hits = hits.select(*names)
    if not allow_ambiguous:
        hits = hits.where(~F.col("ambiguous"))
    if gate is not None:
        hits = hits.join(gate, ["doc", "path"], "left_anti")
    if every:
        return hits
    return hits.withColumn("k", F.row_number().over(Window.partitionBy("doc", "path").orderBy("start"))).where("k = 1").drop("k")


def later_mentions(hits: DataFrame, links: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """Hits of targets that the document links already (links: doc, path), outside the cursor's range (cursors: doc, cursor; both ends count as inside)."""
    kept = hits.join(links.select("doc", "path").distinct(), ["doc", "path"], "left_semi")
    if cursors is None:
        return kept
    inside = kept.join(cursors, "doc").where("cursor >= start AND cursor <= end").select("doc", "start", "end")
    return kept.join(inside, ["doc", "start", "end"], "left_anti")


def insert_link(body: Column, start: Column, end: Column, surface: Column, basename: Column) -> Column:
    """The body with one link in place of a range, if the range still holds the surface and the surface has a note."""
    still = (F.substring(body, start + 1, end - start) == surface) & basename.isNotNull()
    return F.when(F.coalesce(still, F.lit(False)), F.overlay(body, wikilink(basename, surface), start + 1, end - start)).otherwise(body)


def apply_links(docs: DataFrame, hits: DataFrame, names: DataFrame) -> DataFrame:
    """docs with each hit replaced by its link, where the text is still the hit's: doc, body, n_links."""
    linked = hits.join(names.select("path", "basename"), "path").select("doc", "start", "end", "text", wikilink(F.col("basename"), F.col("text")).alias("link"))
    spans = linked.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("start")).alias("neg"), "start", "end", "text", "link"))).alias("spans"))
    joined = docs.join(spans, "doc", "left").withColumn("spans", F.coalesce("spans", F.array()))
    fits = F.filter("spans", lambda s: F.substring(F.col("body"), s["start"] + 1, s["end"] - s["start"]) == s["text"])
    joined = joined.withColumn("spans", fits)
    body = F.aggregate("spans", F.col("body"), lambda acc, s: F.overlay(acc, s["link"], s["start"] + 1, s["end"] - s["start"]))
    return joined.select("doc", body.alias("body"), F.size("spans").alias("n_links"))
