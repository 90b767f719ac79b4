"""Several values packed in one cell, split by a parsing expression grammar.

    cell      <- blank* item (sep item)* blank*
    item      <- quoted / bracketed / bare
    quoted    <- blank* '"' ('""' / !'"' .)* '"' blank* &(sep / end)
    bracketed <- blank* balanced blank* &(sep / end)
    bare      <- (balanced / inner / !sep .)*
    inner     <- '"' (!'"' .)* '"'

Alternatives are tried in order; where one fails the parser goes back to the
start of the item and takes the next, so a malformed quote or bracket ends as
part of a bare value and leaves an error flag. In cells of personal names a
comma separates only when every part between stronger separators has at least
two words, so "Last, First" stays whole.

Defined results: NULL and blank cells give no value; empty values between two
separators are skipped and not counted; repeated values stay; texts of any
length are parsed in linear time (bracket partners are found in one pass).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BAD_QUOTE, BAD_BRACKET = "malformed-quote", "unbalanced-bracket"
PAIRS = {"(": ")", "[": "]", "{": "}"}
PARTICLES = frozenset("van von de del della der den di da dos du la le ten ter af av zu zur".split())


@dataclass(frozen=True)
class Dialect:
    """What separates: ``hard`` always, ``soft`` only between full names."""

    name: str
    hard: str
    soft: str = ""

    @property
    def hard_re(self) -> re.Pattern:
        return re.compile(self.hard)  # re keeps compiled patterns


CODES = Dialect("codes", r"[|;,/+&\n\r\t；，｜]")
PEOPLE = Dialect("people", r"[|;/+&\n\r\t；｜]|(?<=\s)(?:i|oraz|and|und|et)(?=\s)", ",")
MAYBE_PACKED = {"codes": r"[|;,/+&\n\r\t；，｜]", "people": r"(?U)[|;/+&\n\r\t；｜,]|\s(?:i|oraz|and|und|et)\s"}


def _partners(text: str) -> dict[int, int]:
    """Position of the closing sign of every balanced opening bracket."""
    stack, out = [], {}
    for i, ch in enumerate(text):
        if ch in PAIRS:
            stack.append(i)
        elif stack and ch == PAIRS[text[stack[-1]]]:
            out[stack.pop()] = i
    return out


class Parser:
    """Recursive-descent form of the grammar over one cell."""

    def __init__(self, text: str, dialect: Dialect):
        self.text, self.n = text, len(text)
        self.partner = _partners(text)
        self.sep_end = {m.start(): m.end() for m in dialect.hard_re.finditer(text)}
        self.soft = dialect.soft

    def blank(self, i: int) -> int:
        while i < self.n and self.text[i].isspace() and i not in self.sep_end:
            i += 1
        return i

    def ends(self, i: int) -> bool:
        return i >= self.n or i in self.sep_end or self.text[i] in self.soft

    def quoted(self, i: int) -> tuple[int, str] | None:
        i = self.blank(i)
        if i >= self.n or self.text[i] != '"':
            return None
        j = i + 1
        while True:
            j = self.text.find('"', j)
            if j < 0:
                return None
            if self.text.startswith('""', j):
                j += 2
                continue
            end = self.blank(j + 1)
            return (end, self.text[i + 1 : j].replace('""', '"')) if self.ends(end) else None

    def bracketed(self, i: int) -> tuple[int, str] | None:
        i = self.blank(i)
        if i not in self.partner:
            return None
        end = self.blank(self.partner[i] + 1)
        return (end, self.text[i : self.partner[i] + 1]) if self.ends(end) else None

    def bare(self, i: int) -> tuple[int, str, list[str], list[int]]:
        start, flags, soft = i, [], []
        while i < self.n and i not in self.sep_end:
            ch = self.text[i]
            if i in self.partner:
                i = self.partner[i] + 1
                continue
            if ch in PAIRS:
                flags.append(BAD_BRACKET)
            elif ch == '"':
                close = self.text.find('"', i + 1)
                if close > 0 and not any(k in self.sep_end for k in range(i, close)):
                    i = close + 1
                    continue
                flags.append(BAD_QUOTE)
            elif ch in self.soft:
                soft.append(i)
            i += 1
        return i, self.text[start:i], flags, [k - start for k in soft]

    def cell(self) -> list[tuple[str, str]]:
        """Non-empty values in order with their error flags."""
        out: list[tuple[str, str]] = []
        i = 0
        while i <= self.n:
            if got := self.quoted(i) or self.bracketed(i):
                i, value = got
                self._keep(out, value, [])
            else:
                i, value, flags, soft = self.bare(i)
                for part in self._names(value, soft):
                    self._keep(out, part, flags)
            if i >= self.n:
                break
            i = self.sep_end.get(i, i + 1)
        return out

    @staticmethod
    def _keep(out: list, value: str, flags: list[str]) -> None:
        if value.strip():
            out.append((value.strip(), " ".join(dict.fromkeys(flags))))

    @staticmethod
    def _names(value: str, soft: list[int]) -> list[str]:
        """The bare value, or its parts when each part is a full name."""
        if not soft:
            return [value]
        cuts = [-1, *soft, len(value)]
        parts = [value[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
        full = [p for p in parts if p.strip()]
        if len(full) < len(parts) and len(full) == 1:
            return full
        words = [p.split() for p in full]
        if all(len(w) >= 2 for w in words) and not all(x.lower() in PARTICLES for x in words[0][:-1]):
            return full
        if len(full) > 2 and len(full) % 2 == 0 and all(len(w) == 1 for w in words[::2]):
            return [f"{full[k]},{full[k + 1]}" for k in range(0, len(full), 2)]  # Last, First, Last, First
        return [value]


def split_cell(text: str | None, dialect: Dialect) -> list[tuple[str, str]]:
    """Values of one cell; the plain-Python face of the operator."""
    return Parser(text, dialect).cell() if text else []


_ITEMS = pa.list_(pa.struct([("item", pa.string()), ("flags", pa.string())]))


def items_of(cell: Column, dialect: Dialect) -> Column:
    """Array of (item, flags) of each cell, by an Arrow function with a per-batch memo."""

    @F.arrow_udf("array<struct<item:string,flags:string>>")
    def run(cells: pa.Array) -> pa.Array:
        seen: dict[str | None, list] = {}
        out = []
        for text in cells.to_pylist():
            if text not in seen:
                seen[text] = [{"item": a, "flags": b} for a, b in split_cell(text, dialect)]
            out.append(seen[text])
        return pa.array(out, _ITEMS)

    return run(cell)


def unpack(cells: DataFrame, cell: str, dialect: Dialect, keep: list[str], min_values: int = 1) -> DataFrame:
    """One row per value: ``keep`` columns, ``pos`` from 1, ``item``, ``flags``.

    ``min_values``=2 returns only packed cells; cells that show no separator at
    all are then left out before any row goes to Python.
    """
    c = F.col(f"`{cell}`")
    src = cells.select(*[F.col(f"`{k}`") for k in keep], c.alias("_cell")).where(F.col("_cell").isNotNull())
    if min_values > 1:
        src = src.where(F.col("_cell").rlike(MAYBE_PACKED[dialect.name]))
    return (
        src.select(*keep, items_of(F.col("_cell"), dialect).alias("_items"))
        .where(F.size("_items") >= min_values)
        .select(*keep, F.posexplode("_items").alias("_p", "_v"))
        .select(*keep, (F.col("_p") + 1).cast("int").alias("pos"), F.col("_v.item").alias("item"), F.col("_v.flags").alias("flags"))
    )
