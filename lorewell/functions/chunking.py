"""Sentence windows and character budgets: folds over a note's sentences, in vectorised Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lorewell.functions.vectors import let

WORDS, SHORT_TAIL, CHARS = 80, 10, 480
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")


def sentences(text: str) -> list[str]:
    """An approximation of Unicode sentence boundaries: a terminator and white space."""
    return [s for s in (x.strip() for x in _SENTENCE_END.split(text)) if s]


def n_words(text: str) -> int:
    return len(text.split())


def windows(parts: list[str], words: int = WORDS, tail: int = SHORT_TAIL) -> list[str]:
    """Sentences gathered to ``words`` words, the last of each window opening the next.

    A short rest joins the last window; another rest is a window unless it equals the last.
    """
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        held.append(part)
        if sum(map(n_words, held)) >= words:
            out.append(" ".join(held))
            held = held[-1:]
    rest = " ".join(held)
    if rest and out and n_words(rest) < tail:
        out[-1] = f"{out[-1]} {rest}"
    elif rest and (not out or out[-1] != rest):
        out.append(rest)
    return out


def budget(text: str, chars: int = CHARS) -> list[str]:
    """Pieces of at most ``chars``: whole sentences where they fit, else cut at the last blank of the second half, or hard."""
    if len(text) <= chars:
        return [text]
    out: list[str] = []
    held = ""
    for sentence in sentences(text):
        joined = f"{held} {sentence}" if held else sentence
        if len(joined) <= chars:
            held = joined
            continue
        if held:
            out.append(held)
        while len(sentence) > chars:
            at = sentence.rfind(" ", 0, chars + 1)
            at = at if at >= chars // 2 else chars
            out.append(sentence[:at].strip())
            sentence = sentence[at:].strip()
        held = sentence
    return [*out, held] if held else out


def passages(text: str) -> list[str]:
    found = [" ".join(p.split("\n")).strip() for p in re.split(r"\n{2,}", text)]
    return [piece for p in found if p for w in windows(sentences(p)) for piece in budget(w)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def passages_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: passages(t or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def budget_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: budget(t or ""))


def chunks(basename: Column, body: Column, most: int = 48) -> Column:
    """Title first, then passages, at most ``most``."""
    return F.concat(F.array(basename), F.slice(passages_of(body), 1, most - 1))


def chunked(basename: Column, body: Column, most: int = 48) -> Column:
    """struct<chunks, n_dropped>: what ``chunks`` gives, and how many passages it leaves out. What the reference does above
    the cap is unknown; this is counted, not hidden."""
    own = lambda p: F.struct(F.concat(F.array(basename), F.slice(p, 1, most - 1)).alias("chunks"), F.greatest(F.size(p) - (most - 1), F.lit(0)).alias("n_dropped"))
    return let(passages_of(body), own)
