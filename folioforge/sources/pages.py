"""Parsers of catalog pages and provider answers: search results, book pages, author lists, JSON."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioforge.functions.text import clean, clean_series, key_of, parse_volume
from folioforge.functions.titles import PART_WORD, VOLUME, group, has

# Class names and labels of the pages, patterns over them, and particles of names in links.
_RESULT = r"(?is)(?=<a\b[^>]*authorAllBooks__singleTextTitle)"
_AUTHORS = r'(?is)<div\b[^>]*authorAllBooks__singleTextAuthor[^>]*>(.*?)</div>'
_CYCLE = r'(?is)<div\b[^>]*listLibrary__info--cycles[^>]*>(.*?)</div>'
_LABEL = (r"(?is){0}:\s*<a[^>]*>\s*([^<]+?)\s*</a>", r"(?is)Kategoria:.*?<dt[^>]*>\s*{0}:\s*</dt>\s*<dd[^>]*>\s*<a[^>]*>\s*([^<]+?)\s*</a>")
_GENRES = (r'(?is)class="book__category[^"]*"[^>]*>\s*([^<]+?)\s*</a>', r"(?is)Kategoria:\s*</dt>\s*<dd[^>]*>\s*<a[^>]*>\s*([^<]+?)\s*</a>",
           r'(?is)<a[^>]+href="/kategoria/[^"]+"[^>]*>\s*([^<]+?)\s*</a>')
_TITLES = (r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""", r"""(?is)<h1[^>]*class=["'][^"']*book__title[^"']*["'][^>]*>(.*?)</h1>""", r"(?is)<h1[^>]*>(.*?)</h1>")
_AUTHOR_LINK = r"""(?is)<a[^>]+href=["'](?:https?://[^"'/]+)?/autor/(\d+)/([^"']+)["'][^>]*>(.*?)</a>"""
_SERIES = rf"^(.+?)\s*\(\s*{PART_WORD}\s*({VOLUME})\s*\)\s*$"
LINK_PARTICLES = "al ap ben bin da dal de del della der des di dos du el ibn la le st van von y".split()
_SEP = "\u001f"


@F.arrow_udf(T.StringType())
def _decode(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


def plain(c: Column) -> Column:
    """Text without tags, entities decoded, cleaned."""
    return clean(_decode(F.regexp_replace(c, "<[^>]+>", " ")))


def _plain_list(parts: Column) -> Column:
    """``plain`` of an array, in one call of the decoder."""
    joined = _decode(F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, "<[^>]+>", " ")), _SEP))
    return F.filter(F.transform(F.split(joined, _SEP), clean), lambda x: x != "")


def series_of(text: Column) -> Column:
    """struct<series, volume> of ``Series (tom 3)`` or a bare series."""
    value = clean(text)
    numbered = has(value, _SERIES)
    return F.struct(clean_series(F.when(numbered, group(value, _SERIES, 1)).otherwise(value)).alias("series"), F.when(numbered, parse_volume(group(value, _SERIES, 2))).alias("volume"))


def search_results(pages: DataFrame, key: str, body: str = "html") -> DataFrame:
    """(key, pos, title, authors, series, volume, url, cycle_source) of every hit of a search page, in order.

    Hits without a title are left out; NULL and empty pages have none.
    """
    c = F.col
    hits = pages.select(key, F.posexplode(F.split(c(body), _RESULT)).alias("pos", "chunk")).where(c("chunk").rlike(r"(?is)^<a\b[^>]*authorAllBooks__singleTextTitle"))
    rows = hits.select(key, "pos", plain(F.regexp_extract("chunk", r"(?is)^<a\b[^>]*>(.*?)</a>", 1)).alias("title"), F.regexp_extract("chunk", r"""(?is)^<a\b[^>]*?href=["']([^"']*)["']""", 1).alias("url"),
                       _plain_list(F.regexp_extract_all(F.regexp_extract("chunk", _AUTHORS, 1), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))).alias("authors"),
                       plain(F.regexp_extract(F.regexp_extract("chunk", _CYCLE, 1), r"(?is)<a\b[^>]*>(.*?)</a>", 1)).alias("cycle")).where("title <> ''")
    rows = rows.select(key, "pos", "title", "authors", series_of(c("cycle")).alias("s"), "url")
    found = (c("s.series") != "") | c("s.volume").isNotNull()
    return rows.select(key, "pos", "title", "authors", "s.series", "s.volume", "url", F.when(found, "search").otherwise("").alias("cycle_source"))


def book_details(pages: DataFrame, key: str, body: str = "html") -> DataFrame:
    """(key, series, volume, genres) of book pages: the cycle, else the series; labels of the first place that has any."""
    c = F.col
    at = lambda label: F.coalesce(*[F.nullif(F.regexp_extract(c(body), p.replace("{0}", label), 1), F.lit("")) for p in _LABEL], F.lit(""))
    found = [F.regexp_extract_all(c(body), F.lit(p), F.lit(1)) for p in _GENRES]
    labels = F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(found[2])
    rows = pages.select(key, plain(at("Cykl")).alias("cycle"), plain(at("Seria")).alias("seria"), F.array_distinct(_plain_list(labels)).alias("genres"))
    s = series_of(F.when(c("cycle") != "", c("cycle")).otherwise(c("seria")))
    return rows.select(key, s.alias("s"), "genres").select(key, "s.series", "s.volume", "genres")


def with_details(hits: DataFrame, details: DataFrame, url: str = "url") -> DataFrame:
    """Search hits with what their book page says; the page wins where it says something."""
    c = F.col
    d = details.select(url, c("series").alias("d_series"), c("volume").alias("d_volume"), c("genres").alias("d_genres"))
    told = (F.coalesce("d_series", F.lit("")) != "") | c("d_volume").isNotNull()
    return hits.join(d, url, "left").withColumns({
        "series": F.when(F.coalesce("d_series", F.lit("")) != "", c("d_series")).otherwise(c("series")), "volume": F.coalesce("d_volume", "volume"),
        "genres": F.coalesce("d_genres", F.array().cast("array<string>")), "cycle_source": F.when(told, "detail").otherwise(c("cycle_source"))}).drop("d_series", "d_volume", "d_genres")


def book_pages(pages: DataFrame, key: str, body: str = "html") -> DataFrame:
    """(key, title, authors) of book pages: the first of three places with a title, authors distinct by key."""
    title = F.coalesce(*[F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in _TITLES], F.lit(""))
    rows = pages.select(key, F.regexp_replace(plain(title), r"(?i)\s*[-|]\s*Lubimyczytac.*$", "").alias("title"), _plain_list(F.regexp_extract_all(body, F.lit(_AUTHOR_LINK), F.lit(3))).alias("a"))
    return rows.select(key, "title", distinct_by_key(F.col("a")).alias("authors"))


def distinct_by_key(names: Column) -> Column:
    """The first name of each key, in order."""
    keys = F.transform(names, key_of)
    firsts = F.transform(names, lambda n, i: F.when((key_of(n) != "") & (F.array_position(keys, key_of(n)) == i + 1), n))
    return F.array_compact(firsts)


def link_name(slug: Column) -> Column:
    """Name of a link: words capitalised, particles small, runs of lone letters as joined initials."""
    parts = F.filter(F.split(F.btrim(slug, F.lit("/")), "-"), lambda x: x != "")
    shaped = F.transform(parts, lambda w: F.when(w.rlike("(?i)^[a-z]$"), F.concat(F.upper(w), F.lit("."))).when(F.lower(w).isin(LINK_PARTICLES), F.lower(w)).otherwise(F.initcap(w)))
    return F.regexp_replace(F.array_join(shaped, " "), r"(?<=(?<!\p{L})\p{Lu}\.) (?=\p{Lu}\.)", "")


def link_last_first(name: Column) -> Column:
    """Family name first; particles before the last word belong to it, but never the first word."""
    w = F.filter(F.split(name, " "), lambda x: x != "")
    n = F.size(w)
    plain_words = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i == 1) | ~F.rtrim(F.lower(F.element_at(w, i)), F.lit(".")).isin(LINK_PARTICLES))
    start = F.array_max(plain_words) + 1
    return F.when(n <= 1, name).otherwise(F.concat_ws(" ", F.slice(w, start, n), F.slice(w, F.lit(1), start - 1)))


def author_list(pages: DataFrame, body: str = "html") -> DataFrame:
    """Pattern rows of the author links of list pages (page, html); every link of a page, in order."""
    c = F.col
    part = lambda n: F.regexp_extract_all(body, F.lit(_AUTHOR_LINK), F.lit(n))
    rows = pages.select("page", F.posexplode(F.arrays_zip(part(1).alias("id"), part(2).alias("slug"), part(3).alias("label"))).alias("pos", "x"))
    rows = rows.select("page", "pos", c("x.id").alias("source_author_id"), c("x.slug").alias("slug"), F.trim(F.regexp_replace(F.regexp_replace(_decode(c("x.label")), "<[^>]+>", " "), r"(?U)\s+", " ")).alias("label"))
    first = link_name(c("slug"))
    rows = rows.select("*", first.alias("author_first_last"))
    return rows.select("page", "pos", F.lit("lubimyczytac").alias("source"), F.when(c("label") == "", c("author_first_last")).otherwise(c("label")).alias("author_raw"), "author_first_last",
                       F.when(c("label").contains("..."), link_last_first(c("author_first_last"))).otherwise(c("label")).alias("author_last_first"), "source_author_id",
                       F.concat(F.lit("/autor/"), "source_author_id", F.lit("/"), "slug").alias("source_url"), F.lit("medium").alias("confidence"))


def crawl(pages: DataFrame, stale: int | None, body: str = "html") -> tuple[DataFrame, DataFrame]:
    """(author rows, page statistics) of a crawl in order of pages.

    It ends before the first page of status 404 and, with ``stale``, after so many
    pages in a row without a new author. The first row of an author counts. One
    row per page is held together for the order, never a page's text.
    """
    c = F.col
    rows = author_list(pages, body)
    first = rows.groupBy("source_author_id").agg(F.min(F.struct("page", "pos")).alias("f"))
    new = first.groupBy(c("f.page").alias("page")).agg(F.count(F.lit(1)).alias("new_rows"))
    seen = rows.groupBy("page").agg(F.count(F.lit(1)).alias("rows"))
    stats = pages.select("page", "status").join(seen, "page", "left").join(new, "page", "left").na.fill(0, ["rows", "new_rows"])
    # pages are numbers in order: the last page with something new before each page is a running maximum over blocks
    limit = stats.where("status = 404").agg(F.min("page").alias("p"))
    if stale is not None:
        busy = F.array_sort(F.collect_list(F.when(c("new_rows") > 0, c("page"))))
        spans = stats.agg(busy.alias("b"), F.min("page").alias("lo"), F.max("page").alias("hi"))
        steps = F.concat(F.array(c("lo") - 1), "b", F.array(c("hi") + stale + 1))
        gap = F.filter(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.when(F.element_at(steps, i + 1) - F.element_at(steps, i) > stale, F.element_at(steps, i) + stale + 1)), lambda x: x.isNotNull())
        limit = limit.unionAll(spans.select(F.array_min(gap)))
    end = limit.agg(F.min("p")).first()[0]
    kept = stats if end is None else stats.where(F.col("page") < end)
    picked = rows.join(first.select("source_author_id", "f.page", "f.pos"), ["source_author_id", "page", "pos"], "left_semi").join(kept.select("page"), "page", "left_semi")
    return picked, kept


# The fields read from each provider's answer.
ANSWERS = {
    "google-books": "items array<struct<volumeInfo:struct<title:string,subtitle:string,authors:array<string>,industryIdentifiers:array<struct<identifier:string>>,categories:array<string>>>>",
    "open-library": "docs array<struct<title:string,author_name:array<string>,isbn:array<string>>>",
    "crossref": "message struct<items:array<struct<type:string,title:array<string>,subtitle:array<string>,author:array<struct<given:string,family:string>>,ISBN:array<string>>>>",
    "hathitrust": "items array<struct<fromRecord:string>>, records map<string,struct<title:string,authors:array<string>>>",
}


def provider_rows(answers: DataFrame, key: str, provider: str, body: str = "body", most: int = 10) -> DataFrame:
    """(key, pos, provider, title, authors, identifiers, genres) of the hits in JSON answers; the first ten of an answer, as each provider's page.

    Broken JSON and answers without hits give no rows.
    """
    c = F.col
    parsed = answers.select(key, F.from_json(body, ANSWERS[provider]).alias("j"))
    none = F.array().cast("array<string>")
    listed = lambda x: F.filter(F.transform(F.coalesce(x, none), clean), lambda v: v != "")
    titled = lambda t, s: F.when((clean(t) != "") & (clean(s) != ""), F.concat(clean(t), F.lit(": "), clean(s))).otherwise(clean(t))
    if provider == "google-books":
        rows = parsed.select(key, F.posexplode(F.slice("j.items", 1, most)).alias("pos", "x")).select(key, "pos", "x.volumeInfo.*")
        out = rows.select(key, "pos", titled(c("title"), c("subtitle")).alias("title"), listed(c("authors")).alias("authors"), listed(c("industryIdentifiers.identifier")).alias("identifiers"), listed(c("categories")).alias("genres"))
    elif provider == "open-library":
        rows = parsed.select(key, F.posexplode(F.slice("j.docs", 1, most)).alias("pos", "x")).select(key, "pos", "x.*")
        out = rows.select(key, "pos", clean(c("title")).alias("title"), listed(c("author_name")).alias("authors"), listed(F.slice("isbn", 1, 5)).alias("identifiers"), none.alias("genres"))
    elif provider == "crossref":
        rows = parsed.select(key, F.posexplode(F.slice("j.message.items", 1, most)).alias("pos", "x")).select(key, "pos", "x.*").where(F.lower(clean(c("type"))).isin("book", "book-chapter", "monograph"))
        people = F.transform(F.coalesce("author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", clean(a["given"]), clean(a["family"])))
        out = rows.select(key, "pos", titled(F.try_element_at("title", F.lit(1)), F.try_element_at("subtitle", F.lit(1))).alias("title"), listed(people).alias("authors"), listed(c("ISBN")).alias("identifiers"), none.alias("genres"))
    else:
        records = F.map_values("j.records")
        held = F.filter(F.transform("j.items", lambda i: F.element_at(c("j.records"), i["fromRecord"])), lambda r: r.isNotNull())
        rows = parsed.select(key, F.posexplode(F.when(F.size("j.items") > 0, held).otherwise(records)).alias("pos", "x")).select(key, "pos", "x.*")
        out = rows.select(key, "pos", clean(c("title")).alias("title"), listed(c("authors")).alias("authors"), none.alias("identifiers"), none.alias("genres"))
    return out.select(key, "pos", F.lit(provider).alias("provider"), "title", "authors", "identifiers", "genres")
