"""Accent folding as JVM expressions.

Spark has no Unicode normalisation function, so the compatibility decomposition
is turned into a ``translate`` table generated from the Unicode database. The
few signs that decompose into several characters are replaced through a literal
map, evaluated only for rows that hold one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Letters without a decomposition that the folding maps by hand.
STROKED = {"Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d"}


def _decomposed(ch: str) -> str:
    out = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    return "".join(STROKED.get(c, c) for c in out)


def fold_exact(text: str | None) -> str | None:
    """Plain-Python folding; the reference point for the expression below."""
    return None if text is None else _decomposed(text)


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for ``translate`` and the map of signs that grow."""
    single, many = [], {}
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            continue
        out = _decomposed(ch)
        if out != ch and any(c.isascii() and c.isalnum() for c in out):  # the rest never reaches a key
            if len(out) == 1:
                single.append((ch, out))
            else:
                many[ch] = out
    return "".join(a for a, _ in single), "".join(b for _, b in single), many


def char_class(chars) -> str:
    """Regular-expression class of the characters, neighbours joined to ranges."""
    spans: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def text_map(pairs: dict[str, str]) -> Column:
    """A constant map of texts as one small expression, folded to a literal before the query runs."""
    return F.str_to_map(F.lit("\u0002".join(f"{k}\u0001{v}" for k, v in pairs.items())), F.lit("\u0002"), F.lit("\u0001"))


def fold_accents(col: Column) -> Column:
    """Compatibility decomposition without marks, plus the stroked letters, of all
    signs whose folded form holds a plain letter or digit; others stay."""
    src, dst, many = fold_tables()
    bare = F.regexp_replace(col, r"\p{M}+", "")
    grown = text_map(many)
    spread = F.array_join(F.transform(F.split(bare, ""), lambda c: F.coalesce(F.element_at(grown, c), c)), "")
    full = F.translate(F.when(bare.rlike(char_class(many)), spread).otherwise(bare), src, dst)
    return F.when(col.rlike(r"[^\x00-\x7f]"), full).otherwise(col)


def match_key(col: Column) -> Column:
    """Folded, lower-case, runs of other signs as one blank."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(col)), "[^a-z0-9]+", " "))


def author_key(col: Column) -> Column:
    """Folded, lower-case letters and digits only; empty for other alphabets."""
    return F.regexp_replace(F.lower(fold_accents(col)), "[^a-z0-9]+", "")


def author_key_exact(text: str | None) -> str | None:
    """Plain-Python ``author_key``."""
    if text is None:
        return None
    return "".join(c for c in _decomposed(text).lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
