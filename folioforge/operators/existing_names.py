"""Names of files that already follow the output form: author, series, volume, title and genre read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import STANDALONE, clean, clean_series, genre_suffix, match_text, parse_volume
from folioforge.functions.titles import PART_WORD, VOLUME, before_last, group, has, is_structural, words
from folioforge.runtime import cut

# The pattern decides what counts as a series and volume within a title.
_EMBEDDED = rf"^(.+?)\s*\(\s*(?:{PART_WORD}\s*)?({VOLUME})\s*\)\s*(?:[-:._]\s*)?(.+)$"


def _author(c: Column, index: Column) -> Column:
    """A cleaned author; where ``index`` holds without the numbers in front."""
    value = clean(c)
    rest = clean(F.regexp_replace(value, r"^\d{1,4}(?:(?:[.)_-]+|\s+)\d{0,4})*(?:[.)_-]+|\s+)", ""))
    return F.when(index & (rest != "") & value.rlike(r"^\d{1,4}(?:[.)_-]|\s)"), rest).otherwise(value)


def _is_author(c: Column) -> Column:
    n = F.size(words(c))
    lone = (n == 1) & ((F.length(c) <= 2) | (F.lower(c) == c))
    return (c != "") & c.rlike("[A-Za-z]") & ~lone & ~c.rlike(r"^[#(\[]?\s*\d") & ~has(c, "^[IVXLCDM]+$")


def existing_names(files: DataFrame, key: str, stem: str = "stem") -> DataFrame:
    """(key, author, series, volume, title, genre) of every file name in the output form; others are left out.

    The form is ``author - series - Tom nn.nn - title [genre]`` or ``author - series - title``.
    Author and title that an earlier run put in each other's place are exchanged,
    and a series with its volume in a title of no series is taken out of it.
    NULL and empty stems are left out.
    """
    c = F.col
    rows = files.select(key, *[x.alias(n) for x, n in zip(before_last(c(stem)), ("prefix", "shown"))]).where("shown <> ''")
    rows = rows.select(key, "shown", *[x.alias(n) for x, n in zip(before_last(c("prefix")), ("left", "last"))], genre_suffix(c("shown")).alias("g")).where(c("prefix").contains(" - "))
    rows = rows.select(key, "left", "last", c("g.title").alias("name"), c("g.genre").alias("genre"), c("last").startswith("Tom ").alias("numbered"), parse_volume(c("last")).alias("volume"))
    # written between the steps: conditions on computed columns would else be copied into each other
    rows = cut(rows, "name-ends")

    # with a volume: author and series stand before it, and before these perhaps an older title
    head, series = before_last(c("left"))
    both = (head != "") & (series != "") & c("left").contains(" - ")
    tom = rows.where("numbered AND volume is not null").select(key, "genre", "volume", c("name").alias("title"), "left", both.alias("both"),
                                                               F.when(both, head).otherwise("").alias("head"), F.when(both, clean_series(series)).otherwise("").alias("series"))
    tom = tom.withColumn("index", c("both") & (c("series") != "") & (c("series") != STANDALONE))
    old_title, old_author = before_last(c("head"))
    tom = cut(tom, "name-heads").select("*", F.when(c("both"), _author(c("head"), c("index"))).otherwise(clean(c("left"))).alias("author"), clean(old_title).alias("old"), _author(old_author, c("index")).alias("who"))
    tom = cut(tom, "name-authors")
    older = c("both") & c("head").contains(" - ") & (c("old") != "") & _is_author(c("who"))
    split_name = older & (F.size(words(c("title"))) == 1) & (F.size(words(c("who"))) == 1) & c("title").rlike("[A-Za-z]")
    weak = (c("title") == "") | is_structural(c("title")) | (match_text(c("title")) == match_text(c("series"))) | ((F.size(words(c("title"))) < 2) & (F.size(words(c("old"))) >= 2))
    joined, tail = before_last(c("old"), " & ")
    short = F.when(c("old").contains(" & ") & (F.size(words(clean(tail))) == 1) & (clean(joined) != ""), clean(joined)).otherwise(c("old"))
    tom = tom.select(key, "genre", "volume", "series", "index", F.when(split_name, clean(F.concat_ws(" ", "title", "who"))).when(older & weak, c("who")).otherwise(c("author")).alias("author"),
                     F.when(split_name, short).when(older & weak, c("old")).otherwise(c("title")).alias("title"))
    tom = cut(tom, "name-parts")
    inner = clean(c("title"))
    got = F.struct(clean_series(group(inner, _EMBEDDED, 1)).alias("series"), parse_volume(group(inner, _EMBEDDED, 2)).alias("volume"), clean(group(inner, _EMBEDDED, 3)).alias("title"))
    tom = tom.withColumn("in", F.when(c("series").isin("", STANDALONE) & (c("volume.major") == 0) & (c("volume.minor") == "00"), got))
    inside = c("in").isNotNull() & c("in.volume").isNotNull() & (c("in.title") != "") & (F.size(words(c("in.series"))) >= 2) & ~is_structural(c("in.series")) & ~is_structural(c("in.title"))
    tom = cut(tom.withColumn("inside", F.coalesce(inside, F.lit(False))), "name-series")
    pick = lambda n: F.when(c("inside"), c(f"in.{n}")).otherwise(c(n)).alias(n)
    tom = tom.select(key, "author", pick("series"), pick("volume"), pick("title"), "genre", "index")
    tom = cut(tom, "name-fields").where(_is_author(c("author")) & ~is_structural(c("title")) & (c("series").isin("", STANDALONE) | ~is_structural(c("series")))).drop("index")

    # without a volume
    author, series = clean(c("left")), clean_series(c("last"))
    alone = (match_text(c("name")) == "standalone") & (clean(c("last")) != "") & (match_text(c("last")) != "standalone")
    plain = ~alone & (series != "") & ~(_is_author(series) & clean(c("name")).startswith("[")) & ~is_structural(series) & ~is_structural(c("name"))
    rest = rows.where(~c("numbered") & _is_author(author)).where(alone | plain).select(
        key, author.alias("author"), F.when(alone, STANDALONE).otherwise(series).alias("series"), F.lit(None).cast("struct<major:int,minor:string>").alias("volume"),
        F.when(alone, clean(c("last"))).otherwise(clean(c("name"))).alias("title"), "genre")
    return tom.select(key, "author", "series", "volume", "title", "genre").unionByName(rest)
