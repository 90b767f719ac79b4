"""Per-document text statistics, computed over the whole text in one pass."""

from __future__ import annotations

import math
import re
from collections import Counter

#: Order of the statistics in every vector.
NAMES = (
    "log_words", "mean_word_len", "symbol_share", "digit_share", "upper_share", "line_end_share",
    "stop_share", "distinct_share", "short_share", "mean_line_words", "cell_line_share",
    "item_line_share", "shape_share", "loop_share", "odd_word_share", "noise_line_share",
)

_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_PLAIN = re.compile(r"(?:[^\W\d_]++[.,:!?]?+ ?+)++[-=¬‐]?+\s*+")
_NUMERIC = re.compile(r"^[\W_]*\d[\d.,:/*'’·■()%-]*\S?$|^[—–-]$")
_BULLET = re.compile(r"\s*(?:[*•·\-–—+#▪►○]\s+|\(?\d{1,4}[.)]\s|\(?[a-zA-Z][.)]\s)\S")
_LEADER = re.compile(r"\S\s?(?:\.[.,]{2,}|…|(?:[.,] ){3,}|_{3,})\s*\S")
_GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_BROKEN = ("-", "=", "¬", "‐")
_ENDS = re.compile(r"[.!?…][\"'”»)]?[ \t]*$", re.M)
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻŒ]")
_ODD = re.compile(r"(?<!\w)[^\W\d_aeiouyąęóäöüàâéèêëîïôûœæ]{4,}(?!\w)", re.I)


def line_kind(line: str, tokens: list[str]) -> str:
    """``cells``, ``item``, ``noise`` or ``text`` for one line."""
    if _PLAIN.fullmatch(line):
        return "text"
    n, visible = len(tokens), sum(map(len, tokens))
    solid = sum(map(str.isalnum, line))
    bars = line.count("|") + line.count("¦")
    if line.count("\t") >= 2 or (bars >= 2 and solid > 0.4 * visible):
        return "cells"
    numeric = sum(1 for t in tokens if _NUMERIC.match(t))
    if numeric >= 3 and numeric >= 0.45 * n:
        return "cells"
    if numeric >= 2 and len(_GAP.findall(line)) >= 2:
        return "cells"
    if solid < 0.55 * visible and n >= 2:
        return "noise"
    if _BULLET.match(line) or _LEADER.search(line):
        return "item"
    return "text"


def page_stats(text: str | None, stop: dict[str, frozenset]) -> tuple[str, list[float]]:
    """Language by its function words ('' if none is found) and the statistics.

    A NULL or blank text has language '' and all statistics 0.
    """
    text = text or ""
    raw = _WORD.findall(text)
    lines = [(x, t) for x in text.split("\n") if (t := x.split())]
    if not lines:
        return "", [0.0] * len(NAMES)
    n_tokens = sum(len(t) for _, t in lines)
    visible = sum(sum(map(len, t)) for _, t in lines)
    letters, digits = sum(map(len, raw)), len(_DIGIT.findall(text))
    counts = Counter(_WORD.findall(text.lower()))
    n_lines, n_words = len(lines), max(1, len(raw))
    hits = {lang: sum(counts[w] for w in counts.keys() & ws) for lang, ws in stop.items()}
    lang = max(hits, key=lambda k: (hits[k], k)) if hits else ""
    best = hits.get(lang, 0)
    kinds, shapes = Counter(), Counter()
    for line, t in lines:
        kinds[line_kind(line, t)] += 1
        # a wrapped prose line has neither an item's marks nor one form again and again
        if len(t) >= 2 and t[-1][-1] not in _BROKEN:
            key = "".join(["A" if x[0].isupper() else "a" if x[0].isalpha() else "0" for x in t])
            key += "," * min(3, line.count(",")) + (t[-1][-1] if t[-1][-1] in ",;:" else "")
            if key.strip("a"):
                shapes[key] += 1
    common = sum(c for _, c in shapes.most_common(3) if c > 1)
    loops = 1 - len(set(zip(raw, raw[1:], raw[2:]))) / (n_words - 2) if n_words > 3 else 0
    odd = len(_ODD.findall(text))
    short = sum(c for w, c in counts.items() if len(w) <= 2)
    vals = (
        math.log1p(len(raw)), letters / n_words, max(0.0, 1 - (letters + digits) / visible),
        digits / visible, len(_UPPER.findall(text)) / visible,
        len(_ENDS.findall(text)) / n_lines, best / n_words, len(counts) / n_words ** 0.9,
        short / n_words, n_tokens / n_lines,
        kinds["cells"] / n_lines, kinds["item"] / n_lines, common / n_lines,
        loops, odd / n_words, kinds["noise"] / n_lines,
    )
    return (lang if best else ""), [float(v) for v in vals]
