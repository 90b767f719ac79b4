"""Records checked against online candidates: which of them speak for a record, what they confirm, what they know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import STANDALONE, UNKNOWN_AUTHOR, canonical_authors, clean, clean_series, match_text, most_alike
from folioforge.functions.titles import sanitize_title, split_authors, strip_leading_index
from folioforge.operators.candidates import name_guesses, title_guesses
from folioforge.operators.online import LOCAL, author_match_keys

#: Likeness from which an author, a title in context, and a confirmed title count as the same.
SAME_AUTHOR, SAME_TITLE, CONFIRMED_TITLE = 0.86, 0.88, 0.9
_NONE = "array<string>"


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def is_authoritative(series: Column, volume: Column, cycle_source: Column) -> Column:
    """Series data that do not come from a search page alone."""
    told = (clean_series(F.coalesce(series, F.lit(""))) != "") | volume.isNotNull()
    return told & (F.lower(F.trim(F.coalesce(cycle_source, F.lit("")))) != "search")


def is_strong_candidate(provider: Column, score: Column, reason: Column, series: Column, volume: Column) -> Column:
    """A candidate whose word counts: well scored, not ambiguous; of the local catalog with a series or a named reason, else not approximate."""
    why = F.coalesce(reason, F.lit(""))
    named = why.isin("isbn-exact", "title-author-exact", "title-exact", "title-author-approx")
    told = (clean_series(F.coalesce(series, F.lit(""))) != "") | volume.isNotNull()
    return (score >= 150) & ~why.contains("ambiguous") & F.when(provider == LOCAL, (score >= 210) & (told | named)).otherwise(~why.contains("approx"))


def pair_up(records: DataFrame, books: DataFrame, candidates: DataFrame, key: str = "book_id") -> DataFrame:
    """One row per record and candidate of its book, with what the tests compare, each computed once per record or candidate.

    ``records`` has key, author, series, volume, title; ``books`` title, core,
    creators; ``candidates`` key, pos and the fields of an online candidate.
    """
    c = F.col
    short = sanitize_title(c("core"), c("series"), c("volume"))
    r = records.select(key, "author", "series", "volume", "title").join(books.select(key, c("title").alias("own"), "core", "creators"), key)
    r = r.select("*", short.alias("short"), F.flatten(F.transform(F.concat(F.when(F.coalesce(c("author"), F.lit("")).isin("", UNKNOWN_AUTHOR), F.array().cast(_NONE)).otherwise(F.array("author")), _texts(c("creators"))), split_authors)).alias("people"))
    shown = F.array("title", "own", "short")
    probes = F.filter(F.array_distinct(F.transform(F.concat(shown, F.transform(shown, strip_leading_index)), match_text)), lambda x: x != "")
    r = r.select(key, "author", "series", "volume", "title", author_match_keys(c("people")).alias("expected"), author_match_keys(split_authors(c("author"))).alias("own_keys"), probes.alias("probes"),
                 match_text(c("title")).alias("title_key"), F.when(c("series") == STANDALONE, "").otherwise(match_text(c("series"))).alias("series_key"))
    o = candidates.select(key, "pos", "provider", "score", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("series", F.lit("")).alias("c_series"), c("volume").alias("c_volume"), "cycle_source",
                          c("title").alias("c_title"), author_match_keys(_texts(c("authors"))).alias("c_keys"), canonical_authors(_texts(c("authors"))).alias("c_authors"),
                          F.concat(title_guesses(c("title")), name_guesses(c("title"), F.array().cast(_NONE))).alias("parsed"))
    o = o.select("*", F.filter(F.array_distinct(F.transform(F.concat(F.array("c_title"), F.transform("parsed", lambda g: g["title"])), match_text)), lambda x: x != "").alias("c_titles"),
                 is_authoritative(c("c_series"), c("c_volume"), c("cycle_source")).alias("authoritative"), is_strong_candidate(c("provider"), c("score"), c("reason"), c("c_series"), c("c_volume")).alias("strong"))
    return r.join(o, key)


def with_support(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``supports``: the candidate has the record's author, or where none is known its title."""
    c = F.col
    alike = pairs.select("*", most_alike(c("expected"), c("c_keys")).alias("author_like"), most_alike(c("probes"), c("c_titles")).alias("title_like"), most_alike(F.array("title_key"), c("c_titles")).alias("own_like"))
    by_author = F.arrays_overlap("expected", "c_keys") | (c("author_like") >= SAME_AUTHOR)
    by_title = (F.size("probes") == 0) | F.arrays_overlap("probes", "c_titles") | (c("title_like") >= SAME_TITLE)
    return alike.withColumn("supports", F.when(F.size("expected") > 0, by_author).otherwise(by_title))


def verification(supported: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, author, title, series and volume confirmed, providers) of each record with candidates.

    A flag is confirmed by the first candidate that confirms it. Candidates are
    read in their order until all four are: providers are those read by then. All
    of it are minima of positions, so a record of many candidates combines before it moves.
    """
    c = F.col
    known = c("volume").isNotNull() & ~((c("volume.major") == 0) & (c("volume.minor") == "00"))
    same_series = F.exists("parsed", lambda g: match_text(g["series"]) == c("series_key")) | (c("authoritative") & (match_text(c("c_series")) == c("series_key")))
    same_volume = F.exists("parsed", lambda g: g["volume"] == c("volume")) | (c("authoritative") & (c("c_volume") == c("volume")))
    flags = {
        "author": (F.size("own_keys") > 0) & F.arrays_overlap("own_keys", "c_keys"),
        "title": (c("title_key") != "") & (F.array_contains("c_titles", c("title_key")) | (c("own_like") >= CONFIRMED_TITLE)),
        "series": c("supports") & (c("series_key") != "") & same_series,
        "volume": c("supports") & known & same_volume,
    }
    marked = supported.select(key, "pos", "provider", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])
    firsts = [F.min(F.when(c(k), c("pos"))).alias(k) for k in flags]
    per = marked.groupBy(key, "provider").agg(F.min("pos").alias("at"), *firsts)
    whole = per.groupBy(key).agg(*[F.min(k).alias(k) for k in flags], F.array_sort(F.collect_list(F.struct("at", "provider"))).alias("seen"))
    end = F.when(F.least(*[c(k).isNotNull().cast("int") for k in flags]) == 1, F.greatest(*[c(k) for k in flags]))
    read = F.filter("seen", lambda s: end.isNull() | (s["at"] <= end))
    return whole.select(key, *[c(k).isNotNull().alias(f"{k}_confirmed") for k in flags], F.transform(read, lambda s: s["provider"]).alias("providers"))


def role_evidence(supported: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, role, label_key, label) of what strong candidates name: the first label of each key per role, and volumes.

    Roles are author, title, series and volume.
    """
    c = F.col
    strong = supported.where("strong").select(key, "pos", "c_title", "c_authors", "c_series", "c_volume", "authoritative", "parsed")
    best = F.array_max(F.transform("parsed", lambda g, i: F.struct(g["score"].alias("s"), (-i).alias("i"), g["series"].alias("series"), g["volume"].alias("volume"), g["title"].alias("title"))))
    rows = strong.select(key, "pos", "c_title", "c_authors", best.alias("b"), F.when(c("authoritative") & (clean_series(c("c_series")) != ""), F.struct(clean_series(c("c_series")).alias("series"), c("c_volume").alias("volume"))).alias("told"))
    entry = lambda role, label: F.struct(F.lit(role).alias("role"), label.alias("label"))
    said = F.concat(F.transform("c_authors", lambda a: entry("author", a)), F.array(entry("title", clean(c("c_title"))), entry("title", F.coalesce("b.title", F.lit(""))), entry("series", F.coalesce("told.series", "b.series", F.lit(""))),
                    entry("volume", F.coalesce(F.concat_ws(".", F.coalesce("told.volume", "b.volume")["major"].cast("string"), F.coalesce("told.volume", "b.volume")["minor"]), F.lit("")))))
    long = rows.select(key, "pos", F.posexplode(said).alias("i", "e")).select(key, "pos", "i", "e.role", "e.label").where("label <> ''")
    keyed = long.select(key, "role", F.when(c("role") == "author", F.regexp_replace(match_text(c("label")), " ", "")).when(c("role") == "volume", c("label")).otherwise(match_text(c("label"))).alias("label_key"), "label", F.struct("pos", "i").alias("o")).where("label_key <> ''")
    return keyed.groupBy(key, "role", "label_key").agg(F.min_by("label", "o").alias("label"))


def without_advice(reasons: Column, provider_local: Column, confirmed: Column) -> Column:
    """Review reasons without the advisory ones of the online search, where the local catalog confirms everything."""
    return F.when(provider_local & confirmed, F.array_except(reasons, F.array(F.lit("online-best-effort"), F.lit("online-niejednoznaczne")))).otherwise(reasons)
