"""Text that looks ordinary but is written with other characters.

All steps are SQL expressions. Suspicious cells get a look-alike-mapped form;
forms are grouped under the accent-sensitive Unicode collation, in which
differently composed forms of one text are equal and invisible signs weigh
nothing; the canonical member of each class is the one with the fewest signs
left to change, then the smallest in byte order; it is joined back to the cells.

A word is judged by its own letters: one letter that only Cyrillic has makes it a
Cyrillic word, a Latin letter makes it Latin, and a word of shared shapes alone
follows the rest of its cell. Signs that look different (quotes, dashes, numero,
fractions, superscripts) are no cases.

Defined results: NULL, empty and plain cells are no cases; blanks are kept as
many as they are; decomposed letters without a composed form stay; a cell of
shared shapes only, all of one alphabet, stays.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.folding import char_class, text_map

# Letters of other alphabets with the shape of a Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјкорсухԁһԛԝүѵ"
CYR_LATIN = "ABESIJKMHOPCTYXYGQWaesijkopcyxdhqwyv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιονρυκϲϳ"
GRE_LATIN = "ABEZHIKMNOPTYXaiovpukcj"
# Latin letters inside a Cyrillic word, and their Cyrillic shapes.
LATIN_IN_CYR = "ABESIJKMHOPCTYXaesijkopcyxë"
CYR_IN_CYR = "АВЕЅІЈКМНОРСТУХаеѕіјкорсухё"
GREEK_IN_CYR = "ΑΒΕΗΙΚΜΟΡΤΧαιορ"
CYR_FOR_GREEK = "АВЕНІКМОРТХаіор"
# Signs without width.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Ligatures of plain letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
BLANKS = "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs")
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
HYPHENS = "\u2010\u2011"

SUSPECT = char_class(set(INVISIBLE + BLANKS + WIDE + HYPHENS + "".join(LIGATURES)))[:-1] + r"\p{IsCyrillic}\p{IsGreek}\p{Mn}]"
_OWN_CYR = r"[\p{IsCyrillic}&&[^" + "".join(f"\\x{{{ord(c):x}}}" for c in CYRILLIC) + "]]"
_OWN_GREEK = r"[\p{IsGreek}&&[^" + "".join(f"\\x{{{ord(c):x}}}" for c in GREEK) + "]]"


@lru_cache(maxsize=1)
def composed_pairs() -> dict[str, str]:
    """Base letter with marks -> composed letter, from the Unicode database."""
    out = {}
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch and not unicodedata.combining(parts[0]):
            out[parts] = ch
            if len(parts) == 3:
                out[unicodedata.normalize("NFC", parts[:2]) + parts[2]] = ch
    return out


def compose(text: Column) -> Column:
    """Composed letters, cluster by cluster."""
    pairs = text_map(composed_pairs())
    clusters = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}\p{Mn}+"), F.lit(0)))
    done = F.aggregate(clusters, text, lambda t, c: F.replace(t, c, F.coalesce(F.element_at(pairs, c), c)))
    return F.when(text.rlike(r"\p{Mn}"), done).otherwise(text)


def _word(w: Column, latin_cell: Column, cyr_cell: Column) -> Column:
    own_cyr, own_greek, latin = w.rlike(_OWN_CYR), w.rlike(_OWN_GREEK), w.rlike(r"\p{IsLatin}")
    foreign = w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")
    mixed = w.rlike(r"\p{IsCyrillic}") & w.rlike(r"\p{IsGreek}")
    to_latin = F.translate(w, CYRILLIC + GREEK, CYR_LATIN + GRE_LATIN)
    to_cyr = F.translate(w, LATIN_IN_CYR + GREEK_IN_CYR, CYR_IN_CYR + CYR_FOR_GREEK)
    return (
        F.when(~foreign, w)
        .when(own_cyr, to_cyr)
        .when(own_greek, w)
        .when(latin | latin_cell | mixed, to_latin)
        .when(cyr_cell, to_cyr)
        .otherwise(w)
    )


def mapped(text: Column) -> Column:
    """Look-alike-mapped and composed form of a text."""
    # translate pairs signs by position, so those to remove come last
    src = BLANKS + HYPHENS + WIDE + INVISIBLE
    dst = " " * len(BLANKS) + "-" * len(HYPHENS) + NARROW
    t = F.translate(text, src, dst)
    for lig, plain in LIGATURES.items():
        t = F.replace(t, F.lit(lig), F.lit(plain))
    words = F.split(t, r"(?<=[^\p{L}\p{M}])|(?=[^\p{L}\p{M}])")
    own_latin = t.rlike(r"\p{IsLatin}")
    own_cyr = t.rlike(_OWN_CYR)
    fixed = F.array_join(F.transform(words, lambda w: _word(w, own_latin, own_cyr)), "")
    return compose(F.when(t.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), fixed).otherwise(t))


def clean_cells(cells: DataFrame, text: str = "cell") -> DataFrame:
    """The suspicious cells whose canonical text differs, with ``clean_text``.

    ``cells`` may hold any other columns; they are kept.
    """
    hit = cells.where(F.col(text).rlike(SUSPECT)).withColumn("_skeleton", mapped(F.col(text)))
    left = F.length(F.regexp_replace("_skeleton", SUSPECT, "")) - F.length("_skeleton")
    spark = cells.sparkSession
    hit.select("_skeleton", (-left).alias("_left")).createOrReplaceTempView("_lookalike_members")
    classes = spark.sql("""
        SELECT m COLLATE UNICODE AS class_key, min(struct(n, m)).m AS clean_text
        FROM (SELECT _skeleton AS m, min(_left) AS n FROM _lookalike_members GROUP BY _skeleton)
        GROUP BY m COLLATE UNICODE""")
    key = F.collate(F.col("_skeleton"), "UNICODE")
    return (
        hit.join(classes, key == F.col("class_key"))
        .where(F.col("clean_text") != F.col(text))
        .drop("_skeleton", "class_key")
    )
