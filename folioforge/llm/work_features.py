"""What a book row and an online row say about the work, in one common form."""

from __future__ import annotations

import re
from functools import lru_cache

from folioforge.functions.folding import fold_exact
from folioforge.llm.name_rules import edits, likeness
from folioforge.operators.packed import PEOPLE, split_cell

_PAREN = re.compile(r"\(([^()]*)\)\s*$")
_IN_PAREN = re.compile(r"^(.*?)[,\s]*(?:#|tom|vol\.?|book|bd\.?|t\.)\s*(\d+)\s*$", re.I)
_NUMBERED = re.compile(r"^(.*\D)\s+#?(\d{1,3})\s*[:.]\s+(.+)$")
_TAIL_NUMBER = re.compile(r"^(.*\D)\s+#?(\d{1,3})$")
_PART = re.compile(r"(?::|\.|\s[-–—])\s+")
_SEGMENT_SERIES = re.compile(r"^(.*?)\s*#\s*(\d{1,3})\b")
_WORDS = re.compile(r"[a-z0-9]+")
LONE = ("", "standalone")
ARTICLES = ("a", "an", "the")
NONE_VOLUME = -1


class _Folded(dict):
    """Each code point as ``fold_exact`` has it, folded when first met."""

    def __missing__(self, point: int) -> str:
        self[point] = out = fold_exact(chr(point))
        return out


_FOLDED = _Folded()


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text if text.isascii() else text.translate(_FOLDED)).lower()) if text else []


def compact(text: str | None) -> str:
    """Folded title without a leading article."""
    w = words(text)
    return " ".join(w[1:] if len(w) > 1 and w[0] in ARTICLES else w)


def series_key(text: str | None) -> str:
    w = words(text)
    key = " ".join(w[1:] if len(w) > 1 and w[0] in ("cykl", "seria", "series", "saga") else w)
    return "" if key in LONE else key


def title_claims(title: str | None) -> tuple[list[str], str, int]:
    """(possible titles, series, volume) that a title text claims."""
    text, series, volume, out = (title or "").strip(), "", NONE_VOLUME, []
    if m := _PAREN.search(text):
        if n := _IN_PAREN.match(m[1]):
            series, volume = series_key(n[1]), int(n[2])
        text = text[: m.start()].strip()
    if m := _NUMBERED.match(text):
        series, volume = series or series_key(m[1]), int(m[2]) if volume < 0 else volume
        parts = [m[3]]
    else:
        parts = _PART.split(text)
    for part in parts:
        if m := _TAIL_NUMBER.match(part.strip()):
            volume = int(m[2]) if volume < 0 else volume
            part = m[1]
        if key := compact(part):
            out.append(key)
    return list(dict.fromkeys(out)), series, volume


def stem_claims(stem: str | None, authors: list[str]) -> tuple[list[str], str, int, list[str]]:
    """(possible titles, series, volume, persons) of a file name; of two sides that may be the person both are given."""
    text = (stem or "").strip()
    if " -- " in text:
        segments = [s.strip() for s in text.split(" -- ")]
        titles, series, volume = title_claims(segments[0])
        for s in segments[2:3]:
            if m := _SEGMENT_SERIES.match(s):
                series, volume = series or series_key(m[1]), int(m[2]) if volume < 0 else volume
        return titles, series, volume if series else NONE_VOLUME, people(segments[1:2])
    if m := re.match(r"^\[\d+\]\s*(.*)_([^_]*)$", text):
        return *title_claims(m[1]), people([m[2]])
    if " - " in text:
        sides = text.split(" - ", 1)
        near = [max((likeness(words(s), a.split(), frozenset()) for a in authors), default=0.0) for s in sides]
        persons = people(sides)
        if near[0] != near[1]:
            persons = people([sides[near[0] < near[1]]])
            sides = [sides[near[0] > near[1]]]
        got = [title_claims(s) for s in sides]
        return [t for g in got for t in g[0]], "", max(g[2] for g in got), persons
    return *title_claims(text), []


def isbns(identifiers: list[str] | None) -> list[str]:
    """13-digit and 10-sign book numbers of identifiers in any notation."""
    out = []
    for x in identifiers or []:
        s = re.sub(r"^(?:urn:)?isbn[:\s]*", "", (x or "").strip(), flags=re.I)
        s = re.sub(r"[\s-]", "", s).upper()
        if re.fullmatch(r"\d{13}|\d{9}[\dX]", s):
            out.append(s)
    return list(dict.fromkeys(out))


def people(cells: list[str] | None) -> list[str]:
    """Persons of author cells as folded words."""
    out = []
    for cell in cells or []:
        for item, _ in split_cell(cell, PEOPLE):
            if w := words(re.sub(r'"[^"]*"', " ", item)):
                out.append(" ".join(w))
    return list(dict.fromkeys(out))


def book_claims(title, stem, creators, identifiers, meta_series, volume) -> dict:
    authors = people(creators)
    titles, s1, v1 = title_claims(title)
    more, s2, v2, persons = stem_claims(stem, authors)
    # of a name and a title in one file name the side that is the known title is no person
    persons = [p for p in persons if compact(p) not in titles]
    major = volume["major"] if volume and volume["major"] else NONE_VOLUME
    series = series_key(meta_series) or s1 or s2
    return _claims(titles, more, authors, persons if not authors else [], identifiers, series, next((v for v in (major, v1, v2) if v > 0), NONE_VOLUME))


def online_claims(title, authors, identifiers, series, volume) -> dict:
    titles, s1, v1 = title_claims(title)
    major = volume["major"] if volume and volume["major"] else NONE_VOLUME
    return _claims(titles, [], people(authors), [], identifiers, series_key(series) or s1, next((v for v in (v1, major) if v > 0), NONE_VOLUME))


def _claims(titles, more, authors, persons, identifiers, series, volume) -> dict:
    """``parts`` are those of a title of several parts, ``whole`` a title of one."""
    every = list(dict.fromkeys(titles + more))
    return {"titles": [t for t in every if t != series] or every, "parts": titles if len(titles) > 1 else [], "whole": titles[0] if len(titles) == 1 else "",
            "authors": authors, "persons": persons, "isbns": isbns(identifiers), "series": series, "volume": volume}


def gap(a: str, b: str, most: float = 0.25) -> float:
    """Edits between two compact texts as a share of the longer, more than ``most`` when beyond."""
    if a == b:
        return 0.0
    n = max(len(a), len(b))
    limit = max(1, int(n * most))
    if abs(len(a) - len(b)) > limit + 3 or sum(max(0, a.count(c) - b.count(c)) for c in set(a)) > limit + 3:
        return most + 0.01
    d = edits(a.replace(" ", ""), b.replace(" ", ""), limit)
    return d / n if d <= limit else max(d / n, most + 0.01)


#: The matching functions in the order of their votes.
FUNCTIONS = ("title_close", "title_equal", "title_words", "title_rare", "author", "author_count", "isbn", "series", "volume", "guess")


@lru_cache(1 << 15)
def same_person(x: str, y: str) -> bool:
    """Whether two folded names can be one person's; a lone word is taken for a family name."""
    a, b = x.split(), y.split()
    if len(a) > 1 and len(b) > 1:
        return likeness(a, b, frozenset(), 2) >= 0.4
    lone, other = (a, b) if len(a) == 1 else (b, a)
    return any(edits(lone[0], w, 1) <= (len(lone[0]) > 4) for w in (other[0], other[-1]) if len(w) > 2)


def votes(b: dict, o: dict, guesses: list[str], shared_titles: list[str]) -> list[int]:
    """1 for, -1 against, 0 abstains; one vote per matching function.

    ``shared_titles`` are those titles of the book row that several persons' works carry.
    """
    pairs = [(x, y) for x in b["titles"] for y in o["titles"]]
    shared = max((len(s & t) / max(1, len(s | t)) for x, y in pairs for s, t in [(set(x.split()), set(y.split()))]), default=None)
    equal = [x for x, y in pairs if x == y]
    near = 0.0 if equal else min((gap(x, y) for x, y in pairs), default=None)
    persons = b["authors"] or b["persons"]
    like = [[same_person(x, y) for y in o["authors"]] for x in persons]
    met = sum(map(any, like))
    known = bool(persons and o["authors"])
    counted = bool(met and b["authors"] and o["authors"])
    close = lambda x, y: gap(x, y) <= 0.13
    return [
        0 if near is None else 1 if near <= 0.13 else -1 if near > 0.25 else 0,
        0 if near is None else 1 if near == 0 else -1,
        0 if shared is None else 1 if shared >= 0.5 else -1 if shared < 0.25 else 0,
        0 if not equal else -1 if set(equal) <= set(shared_titles) else 1,
        0 if not known else 1 if met else -1,
        0 if not counted else 1 if met == max(len(b["authors"]), len(o["authors"])) else -1 if met < min(len(b["authors"]), len(o["authors"])) else 0,
        0 if not (b["isbns"] and o["isbns"]) else 1 if set(b["isbns"]) & set(o["isbns"]) else -1,
        0 if not (b["series"] and o["series"]) else 1 if close(b["series"], o["series"]) else -1,
        0 if b["volume"] < 0 or o["volume"] < 0 else 1 if b["volume"] == o["volume"] else -1,
        0 if not guesses or not o["series"] else 1 if any(close(g, o["series"]) for g in guesses) else -1,
    ]


#: What the votes need of a row as one text: lists of folded words and numbers, of which none holds these signs. Far cheaper to move and to read than structures.
FIELD, ITEM = "\x1e", "\x1f"
LISTS = ("titles", "authors", "persons", "isbns", "guesses", "carried")


@lru_cache(1 << 13)
def unpacked(text: str) -> dict:
    """The claims that a text of ``LISTS``, series and volume holds."""
    *lists, series, volume = text.split(FIELD)
    return {n: x.split(ITEM) if x else [] for n, x in zip(LISTS, lists)} | {"series": series, "volume": int(volume)}


def vote_code(b: dict, o: dict) -> int:
    """The votes on two unpacked rows as one number of three digits a function."""
    code = 0
    for v in reversed(votes(b, o, b["guesses"], b["carried"])):
        code = 3 * code + v + 1
    return code


def code_votes(code: int) -> list[int]:
    """The votes of a number."""
    return [code // 3**i % 3 - 1 for i in range(len(FUNCTIONS))]
