"""What to ask the catalogs for: search variants of a record and terms of the local catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import STANDALONE, UNKNOWN_AUTHOR, clean, last_first, let, match_text
from folioforge.functions.titles import clean_author, query_title, words
from folioforge.operators.online import author_match_keys
from folioforge.runtime import cut

_NONE = "array<string>"
# Normalised chunks of a name that say nothing about a work.
_EMPTY_CHUNK = r"^(?:|standalone|tom|book|part|volume|vol|tom \d+(?: \d+)?)$"


def _people(names: Column) -> Column:
    """Cleaned creators, each in last-first form and as it stands."""
    both = F.flatten(F.transform(F.coalesce(names, F.array().cast(_NONE)), lambda n: let(clean_author(n), lambda x: F.array(clean_author(last_first(x)), x))))
    return F.array_distinct(F.filter(both, lambda x: x != ""))


def search_variants(records: DataFrame, key: str) -> DataFrame:
    """(key, pos, title, creators): up to four searches of each record, no two of equal title and author keys.

    The cleaned title, the same after its series, the longest telling chunk of
    the core without authors, and the file's own title. ``records`` has author,
    series, volume, title, ``own_title``, core and creators; empty titles ask nothing.
    """
    c = F.col
    text = lambda x: F.coalesce(c(x), F.lit(""))
    named = F.when(text("author").isin("", UNKNOWN_AUTHOR), F.coalesce("creators", F.array().cast(_NONE))).otherwise(F.filter(F.transform(F.split("author", "&"), F.trim), lambda a: a != ""))
    chunks = F.filter(F.transform(F.split(text("core"), r"\s+-\s+"), clean), lambda x: ~match_text(x).rlike(_EMPTY_CHUNK) & (match_text(x) != match_text(text("author"))) & (match_text(x) != match_text(text("series"))))
    longest = F.array_max(F.transform(chunks, lambda x, i: F.struct(F.length(match_text(x)).alias("n"), F.length(x).alias("m"), (-i).alias("i"), x.alias("x"))))["x"]
    rows = records.select(key, "series", "title", text("own_title").alias("own"), F.coalesce("creators", F.array().cast(_NONE)).alias("creators"), named.alias("people"),
                          F.when(text("core").contains(" - "), F.coalesce(longest, F.lit(""))).otherwise("").alias("chunk"), query_title(text("title"), text("author"), text("series"), c("volume")).alias("asked"))
    none = F.lit("")
    rows = cut(rows.withColumn("short", let(query_title(c("chunk"), none, none, F.lit(None).cast("struct<major:int,minor:string>")), lambda q: F.when(q == "", c("chunk")).otherwise(q))), "search-texts")
    one = lambda cond, title, who: F.when(cond, F.struct(title.alias("title"), who.alias("who")))
    every = F.array(one(c("asked") != "", c("asked"), c("people")), one((c("asked") != "") & ~text("series").isin("", STANDALONE), F.concat_ws(" ", "series", "asked"), c("people")),
                    one((c("short") != "") & (match_text(c("short")) != match_text(c("asked"))), c("short"), F.array().cast(_NONE)), one((c("own") != "") & (clean(c("own")) != clean(c("title"))), c("own"), c("creators")))
    made = F.transform(F.array_compact(every), lambda v: F.struct(clean(v["title"]).alias("title"), _people(v["who"]).alias("creators")))
    keyed = F.transform(F.filter(made, lambda v: v["title"] != ""), lambda v: F.struct(F.concat_ws("|", match_text(v["title"]), author_match_keys(v["creators"])).alias("k"), v["title"].alias("title"), v["creators"].alias("creators")))
    fresh = let(keyed, lambda vs: let(F.transform(vs, lambda v: v["k"]), lambda ks: F.filter(vs, lambda v, i: F.array_position(ks, v["k"]) == i + 1)))
    return rows.select(key, F.posexplode(fresh).alias("pos", "v")).select(key, "pos", "v.title", "v.creators")


def local_terms(books: DataFrame, key: str) -> DataFrame:
    """(key, pos, term): searches of the local catalog, each outer word of the authors before the title first, then the title alone.

    The title loses quotes, brackets and signs; one with a full stop is also asked for without what follows.
    """
    c = F.col
    none = F.lit("")
    title = let(query_title(F.coalesce(F.nullif(c("title"), F.lit("")), c("core"), none), none, none, F.lit(None).cast("struct<major:int,minor:string>")), _bare_title)
    people = F.flatten(F.transform(_people(c("creators")), lambda n: let(F.filter(words(n), lambda w: F.length(w) > 1), lambda w: F.when(F.size(w) >= 2, F.array(F.element_at(w, -1), F.element_at(w, 1))).otherwise(F.array().cast(_NONE)))))
    rows = cut(books.select(key, title.alias("t"), people.alias("p")), "search-titles")
    first = let(F.transform("p", match_text), lambda ks: F.filter("p", lambda w, i: (match_text(w) != "") & (F.array_position(ks, F.try_element_at(ks, i + 1)) == i + 1)))
    titles = F.array_distinct(F.filter(F.array("t", clean(F.split("t", r"\.")[0])), lambda x: x != ""))
    made = F.flatten(F.transform(titles, lambda x: F.concat(F.transform(first, lambda w: clean(F.concat_ws(" ", w, x))), F.array(x))))
    fresh = let(made, lambda ts: let(F.transform(ts, match_text), lambda ks: F.filter(ts, lambda x, i: (match_text(x) != "") & (F.array_position(ks, F.try_element_at(ks, i + 1)) == i + 1))))
    return rows.select(key, F.posexplode(fresh).alias("pos", "term"))


def _bare_title(t: Column) -> Column:
    """A search title up to a quote, doubled comma or apostrophe, without signs the search takes amiss."""
    plain = F.regexp_replace(F.regexp_replace(F.split(F.regexp_replace(F.translate(t, "_", " "), r"\?", ""), '"|,,')[0], "[&()]", " "), "#", "")
    return clean(F.split(plain, "'")[0])
