"""Sections of a Markdown note, their chunks, and ideas: runs of chunks on one matter.

The survey knows only the shape of these steps. Every constant and rule of boundaries below is this package's choice.
Each is one linear fold over a row's own text, so nothing is shuffled and a task holds one Arrow batch.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lorewell.functions.chunking import n_words, passages
from lorewell.functions.vectors import let

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\r?$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_FRONTMATTER = re.compile(r"\A---[ \t]*\r?\n(?:.*\n)*?---[ \t]*\r?(?:\n|\Z)")
_INLINE = [
    (re.compile(r"!?\[\[(?:[^\]|]*\|)?([^\]]*)\]\]"), r"\1"),
    (re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"[*_~`]+|<[^>]+>"), ""),
]
#: Words: the least and most of an idea, what is one idea at any rate. Similarity below which a valley parts ideas.
LEAST, MOST, ATOMIC, VALLEY = 200, 500, 300, 0.1
_CONTENT = re.compile(r"[^\W\d_]{4,}")


def heading(line: str) -> tuple[int, str] | None:
    """Level and bare title of an ATX heading."""
    found = _HEADING.match(line)
    if not found:
        return None
    title = found[2] or ""
    for pattern, to in _INLINE:
        title = pattern.sub(to, title)
    return len(found[1]), title.strip()


def sections(text: str) -> list[tuple[int, list[str], str]]:
    """(level, titles from the outermost to its own, text) in order. What precedes the first heading has level 0.

    Frontmatter is left out, lines of a fence are no headings, an unclosed fence lasts to the end.
    """
    out: list[tuple[int, list[str], str]] = []
    stack: list[tuple[int, str]] = []
    held: list[str] = []
    fence = ""

    def flush() -> None:
        if stack or any(line.strip() for line in held):
            out.append((stack[-1][0] if stack else 0, [t for _, t in stack], "\n".join(held)))
        held.clear()

    for line in _FRONTMATTER.sub("", text).split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not mark[2].strip():
                fence = ""
        elif mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
        elif found := heading(line):
            flush()
            while stack and stack[-1][0] >= found[0]:
                stack.pop()
            stack.append(found)
            continue
        held.append(line)
    flush()
    return out


_SECTION = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("breadcrumb", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_SECTION)
def sections_of(body: pd.Series) -> pd.Series:
    """array<struct<level, breadcrumb, text>>; null for null."""
    make = lambda t: [{"level": n, "breadcrumb": " > ".join(titles), "text": own} for n, titles, own in sections(t)]
    return body.map(make, na_action="ignore")


def section_chunks(basename: str, text: str, context: bool) -> list[dict]:
    out = []
    for no, (_, titles, own) in enumerate(sections(text), 1):
        for i, piece in enumerate(passages(own)):
            head = " > ".join([basename, *titles]) + "\n" if context and i == 0 else ""
            out.append({"section": no, "text": head + piece})
    return out


_CHUNK = T.ArrayType(T.StructType([T.StructField("section", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_CHUNK)
def _with_context(basename: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([section_chunks(b or "", t or "", True) for b, t in zip(basename, body)])


@F.pandas_udf(_CHUNK)
def _without_context(basename: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([section_chunks(b or "", t or "", False) for b, t in zip(basename, body)])


def chunks(basename: Column, body: Column, *, most: int = 48, heading_context: bool = True) -> Column:
    """array<struct<section, text>>: the title as section 0, then the passages of each section, at most ``most``.

    With ``heading_context`` a section's first chunk opens with the note's name and the headings above it.
    """
    made = (_with_context if heading_context else _without_context)(basename, body)
    title = F.struct(F.lit(0).alias("section"), F.coalesce(basename, F.lit("")).alias("text"))
    return F.concat(F.array(title), F.slice(made, 1, most - 1))


def chunked(basename: Column, body: Column, *, most: int = 48, heading_context: bool = True) -> Column:
    """struct<chunks, n_dropped>: what ``chunks`` gives, and how many passages it leaves out."""
    title = F.struct(F.lit(0).alias("section"), F.coalesce(basename, F.lit("")).alias("text"))
    own = lambda p: F.struct(F.concat(F.array(title), F.slice(p, 1, most - 1)).alias("chunks"), F.greatest(F.size(p) - (most - 1), F.lit(0)).alias("n_dropped"))
    return let((_with_context if heading_context else _without_context)(basename, body), own)


def ideas(parts: list[str], section: list[int]) -> list[int]:
    """The idea of each chunk: 0 for the title, then 1, 2, ... in runs.

    A note of at most ``ATOMIC`` words is one idea. Else an idea ends at a new section, where it would pass ``MOST``
    words, and, from ``LEAST`` words on, at a valley: neighbours that share few content words, fewer than those around.
    A run of under ``LEAST`` words joins the one before, or the first the one behind, if both fit ``MOST``.
    """
    body, out = range(1, len(parts)), [0] * min(1, len(parts))
    sizes = [n_words(p) for p in parts]
    if sum(sizes[1:]) <= ATOMIC:
        return out + [1] * len(body)
    words = [set(_CONTENT.findall(p.lower())) for p in parts]
    alike = [1.0] * (len(parts) + 1)
    for i in body[1:]:
        alike[i] = len(words[i - 1] & words[i]) / max(1, len(words[i - 1] | words[i]))
    runs: list[list[int]] = []  # first chunk, words
    for i in body:
        valley = alike[i] < VALLEY and alike[i] <= min(alike[i - 1], alike[i + 1])
        if not runs or section[i] != section[i - 1] or runs[-1][1] + sizes[i] > MOST or (runs[-1][1] >= LEAST and valley):
            runs.append([i, 0])
        runs[-1][1] += sizes[i]
    merged: list[list[int]] = []
    for first, size in runs:
        fits = merged and merged[-1][1] + size <= MOST
        if fits and (size < LEAST or (len(merged) == 1 and merged[0][1] < LEAST)):
            merged[-1][1] += size
        else:
            merged.append([first, size])
    starts = {first for first, _ in merged}
    for i in body:
        out.append(out[-1] + (i in starts))
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ideas_of(parts: pd.Series, section: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else ideas([t or "" for t in p], list(s)) for p, s in zip(parts, section)])


def ideas_of(made: Column) -> Column:
    """array<int> beside what ``chunks`` made."""
    return _ideas_of(made["text"], made["section"])
