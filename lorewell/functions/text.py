"""Text cleaning, labels and dates as column expressions; NFC in a vectorised function, as Spark has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: White space as Unicode has it, line ends included.
_BLANK = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_IN_LINE = _BLANK.replace("\\n", "")
_LINE_START = "(?<![^\\n\\r\\u2028\\u2029])"
#: The passes over Markdown in their order, each a pattern (Java syntax) and its replacement.
_CLEAN = [
    (r"\A---\n[\s\S]*?\n---\n?", "\n"),  # frontmatter
    (r"```[\s\S]*?```", "\n"),  # fenced code
    (r"`[^`]*`", " "),  # inline code
    (r"!\[\[[^\]]*\]\]", " "),  # embeds
    (r"!\[[^\]]*\]\([^)]*\)", " "),  # images
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),  # wikilink with alias
    (r"\[\[([^\]]+)\]\]", "$1"),  # wikilink
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),  # link
    (rf"{_LINE_START}[{_BLANK}]{{0,3}}(#{{1,6}}|>|[-*+]|\d+\.)[{_BLANK}]+", ""),  # line prefixes
    (r"[*_~]", ""),
    (r"<[^>]+>", " "),
]


def clean_markdown(text: Column) -> Column:
    for pattern, to in _CLEAN:
        text = F.regexp_replace(text, pattern, to)
    return text


def strip(text: Column) -> Column:
    """Single blanks within lines, no white space at line ends, at most one empty line, none around."""
    text = F.regexp_replace(text, r"[ \t\f\x0B]+", " ")
    text = F.regexp_replace(text, rf"[{_IN_LINE}]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), rf"\A[{_BLANK}]+|[{_BLANK}]+\z", "")


def paragraphs(text: Column) -> Column:
    """What stands between empty lines, its lines joined by blanks; nothing for nothing."""
    lines = F.transform(F.split(text, r"\n{2,}"), lambda p: F.regexp_replace(F.translate(p, "\n", " "), rf"\A[{_BLANK}]+|[{_BLANK}]+\z", ""))
    return F.filter(lines, lambda p: p != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def snippet(text: Column, size: int = 160) -> Column:
    return F.substring(strip(clean_markdown(text)), 1, size)


def whole_note(basename: Column, body: Column, size: int = 6000) -> Column:
    return F.substring(F.concat(basename, F.lit(". "), strip(clean_markdown(body))), 1, size)


def card_line(label: Column, snip: Column, show_label: bool = True, show_snippet: bool = True) -> Column:
    own = F.coalesce(F.when(label != "", label), snip) if show_label else snip if show_snippet else F.lit(None)
    return F.when(own != "", own)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize(surface: Column, ascii_only: bool = False) -> Column:
    """NFC, lower case, trimmed, single blanks."""
    s = surface if ascii_only else nfc(surface)
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " ")


def inflect(s: Column) -> Column:
    """The other number of an English surface by the first ending that fits; null if none may be made."""
    cut = lambda n: F.substring(s, F.lit(1), F.length(s) - n)
    return (
        F.when(F.length(s) < 4, F.lit(None))
        .when(s.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies")))
        .when(s.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(s.rlike("(ss|x|z|ch|sh)es$"), cut(2))
        .when(s.rlike("(ss|us|is)$"), F.concat(s, F.lit("es")))
        .when(s.endswith("s"), cut(1))
        .when(s.rlike("(x|z|ch|sh)$"), F.concat(s, F.lit("es")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def is_alias(basename: Column, surface: Column, ascii_only: bool = False) -> Column:
    """Whether the surface is not the basename itself, both normalised."""
    return normalize(basename, ascii_only) != normalize(surface, ascii_only)


def wikilink(basename: Column, surface: Column, ascii_only: bool = False) -> Column:
    """[[base]] for the basename itself, else [[base|surface]]."""
    same = ~is_alias(basename, surface, ascii_only)
    return F.when(same, F.concat(F.lit("[["), basename, F.lit("]]"))).otherwise(F.concat(F.lit("[["), basename, F.lit("|"), surface, F.lit("]]")))


def safe_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r'[\\/:*?"<>|#^\[\]]', ""))


def embed_input(text: Column, tags: Column, aliases: Column) -> Column:
    """A note's text with its aliases and tags before it, each on a line of its own; where they go is this package's choice."""
    line = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.array_join(c, ", "))
    return F.concat_ws("\n", line(aliases), line(tags), F.coalesce(text, F.lit("")))


def badge(semantic: Column) -> Column:
    """The percent of a context score, where it says anything."""
    return F.when(semantic > 0.01, percent(semantic))


def namespace(tag: Column) -> Column:
    """A tag's first part, lower-cased, without its mark."""
    return F.lower(F.regexp_extract(F.trim(tag), r"^#?([^/]*)", 1))


def percent(score: Column, approximate: Column | None = None) -> Column:
    text = F.concat(F.floor(score * 100 + F.lit(0.5)).cast("string"), F.lit("%"))
    return text if approximate is None else F.when(approximate, F.concat(F.lit("~"), text)).otherwise(text)


def relative_time(mtime_ms: Column, now_ms: Column) -> Column:
    """just now, Nh ago, Nd ago, Nmo ago (30 days) or Ny ago (365 days); empty for nothing or the future."""
    age = (now_ms - mtime_ms).cast("long")
    unit = lambda ms, name: F.concat(F.floor(age / F.lit(ms)).cast("string"), F.lit(name))
    hour, day = 3_600_000, 86_400_000
    return (
        F.when(mtime_ms.isNull() | (mtime_ms == 0) | (age < 0), F.lit(""))
        .when(age < hour, F.lit("just now"))
        .when(age < day, unit(hour, "h ago"))
        .when(age < 30 * day, unit(day, "d ago"))
        .when(age < 365 * day, unit(30 * day, "mo ago"))
        .otherwise(unit(365 * day, "y ago"))
    )


def ymd(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
