"""Text scalars as Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of the ECMAScript ``\s`` class, written in
# the regex subset shared by Java and RE2.
WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# Combining diacritical marks removed after decomposition.
COMBINING_MARKS = r"[\x{300}-\x{36F}]"

# Code point ranges whose canonical decomposition is folded by a translate
# table: Latin-1 supplement, Latin extended A/B/additional, Greek, Cyrillic.
_FOLD_RANGES = ((0x00C0, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF),
                (0x1E00, 0x1EFF), (0x1F00, 0x1FFF))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: each character whose canonical
    decomposition minus combining marks is one other character."""
    src, dst = [], []
    for lo, hi in _FOLD_RANGES:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            base = "".join(c for c in unicodedata.normalize("NFD", ch)
                           if not 0x300 <= ord(c) <= 0x36F)
            if base != ch and len(base) == 1:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


def _s(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(col, body) -> Column:
    """Evaluate ``col`` once and apply ``body`` to the value.

    Conditional branches (``CASE`` chains, ``coalesce``) are not covered by
    common-subexpression elimination, so a helper that reads its input in
    many branches would re-run the input's whole expression each time; the
    value is bound as a lambda variable instead."""
    return F.element_at(F.transform(F.array(_s(col)), body), 1)


def normalize_whitespace(col) -> Column:
    """Collapse every whitespace run to one space and trim; NULL -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(_s(col), F.lit("")), WHITESPACE_CLASS + "+", " "))


def strip_html_tags(col) -> Column:
    """Tags -> space, then ``&nbsp;`` and ``&amp;`` only (no other entities)."""
    c = F.regexp_replace(F.coalesce(_s(col), F.lit("")), "<[^>]+>", " ")
    c = F.regexp_replace(c, "(?i)&nbsp;", " ")
    return F.regexp_replace(c, "(?i)&amp;", "&")


def strip_html(col) -> Column:
    """Tag strip plus whitespace collapse (link and title text)."""
    return normalize_whitespace(strip_html_tags(col))


def fold_text(col) -> Column:
    """Whitespace-normalise, drop accents (canonical decomposition), lower-case."""
    src, dst = fold_table()
    c = F.translate(normalize_whitespace(col), src, dst)
    c = F.regexp_replace(c, COMBINING_MARKS, "")
    return F.lower(c)


def slugify(col) -> Column:
    """Folded text, non ``[a-z0-9]`` runs -> ``-``, edge dashes trimmed, 100 chars."""
    c = F.regexp_replace(fold_text(col), "[^a-z0-9]+", "-")
    c = F.regexp_replace(c, "^-+|-+$", "")
    return F.substring(c, 1, 100)


def nullif_empty(col) -> Column:
    c = _s(col)
    return F.when(c != F.lit(""), c)


def blank_to_empty(col) -> Column:
    return F.coalesce(_s(col), F.lit(""))


def shorten(col, max_length: int = 220) -> Column:
    """Whitespace-normalised text cut to ``max_length - 1`` chars plus an ellipsis."""
    return let(normalize_whitespace(col), lambda t: F.when(F.length(t) <= max_length, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, max_length - 1)), F.lit("…"))))


def xml_escape(col) -> Column:
    c = F.replace(F.coalesce(_s(col), F.lit("")), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escape(col) -> Column:
    c = F.replace(F.coalesce(_s(col), F.lit("")), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def percent_label(col) -> Column:
    """``round(x * 100)%`` with JS rounding (half towards +infinity)."""
    return F.concat(F.floor(_s(col) * 100 + F.lit(0.5)).cast("bigint").cast("string"), F.lit("%"))
