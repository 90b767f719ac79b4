"""Online candidates: ranking ladder, consensus groups, ambiguity margin, early stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.functions.text import clean, clean_series, extract_isbns, last_first, match_text, most_alike
from folioforge.functions.titles import is_polish, keyword_genre, split_authors
from folioforge.runtime import cut

CONSENSUS_BONUS, MARGIN, AMBIGUOUS_COST, EFFORT_COST = 25, 25, 10, 15
# What a provider's score gains, the catalog whose hits count as local, and the order of providers by mode.
PROVIDER_GAIN = {"google-books": 18, "open-library": 14, "hathitrust": 6, "crossref": -22, "lubimyczytac": -34}
LOCAL = "lubimyczytac"
MODES = {
    "PL": [LOCAL],
    "PL+": [LOCAL, "google-books", "open-library", "crossref", "hathitrust"],
    "EN": ["google-books", "open-library", "crossref", "hathitrust", LOCAL],
}


def author_match_keys(authors: Column) -> Column:
    """Sorted distinct match texts of each author in both orders."""
    both = F.flatten(F.transform(authors, lambda a: F.array(match_text(a), match_text(last_first(a)))))
    return F.array_sort(F.array_distinct(F.filter(both, lambda x: x != "")))


def rank_ladder(isbn_hit: Column, title_equal: Column, author_equal: Column, title_sim: Column, author_sim: Column) -> Column:
    """struct<score, reason> of one candidate."""
    blended = (title_sim * 100).cast("int") + (author_sim * 35).cast("int") - F.when((title_sim >= 0.75) & (author_sim < 0.25), 20).otherwise(0)
    row = lambda s, r: F.struct(s.cast("int").alias("score"), F.lit(r).alias("reason"))
    return (
        F.when(isbn_hit, row(F.lit(420), "isbn-exact"))
        .when(title_equal & author_equal, row(F.lit(320), "title-author-exact"))
        .when(title_equal, row(250 + (author_sim * 40).cast("int"), "title-exact"))
        .when((title_sim >= 0.82) & (author_equal | (author_sim >= 0.68)), row(180 + blended, "title-author-approx"))
        .when(title_sim >= 0.9, row(150 + blended, "title-approx"))
        .otherwise(row(100 + blended, "approx"))
    )


def known_title(books: DataFrame) -> Column:
    """A book's title, its core where it has none."""
    return F.coalesce(F.nullif(books["title"], F.lit("")), books["core"])


def equal_pairs(books: DataFrame, online: DataFrame) -> DataFrame:
    """(book_id, online_id) of the rows that share a book number or a title's match text: all pairs of the exact rungs."""
    numbers = F.transform(extract_isbns(F.coalesce("identifiers", F.array())), lambda n: F.concat(F.lit("#"), n))
    keys = lambda df, key, title: df.select(key, F.explode(F.array_append(numbers, match_text(title))).alias("key")).where("key <> ''")
    return keys(books, "book_id", known_title(books)).join(keys(online, "online_id", online["title"]), "key").select("book_id", "online_id").distinct()


def rank_pairs(pairs: DataFrame, books: DataFrame, online: DataFrame) -> DataFrame:
    """(book_id, online_id, score, reason) of each pair by the ladder; a book without title is known by its core."""
    of = lambda title, people: (
        clean(title).alias("t"), match_text(title).alias("m"), author_match_keys(people).alias("a"), extract_isbns(F.coalesce("identifiers", F.array())).alias("n"))
    people = F.flatten(F.transform(F.coalesce("creators", F.array()), split_authors))
    # each row's keys once, not once per pair
    b = cut(books.select("book_id", F.struct(*of(known_title(books), people)).alias("b")), "rank-books")
    o = cut(online.select("online_id", F.struct(*of(F.col("title"), F.coalesce("authors", F.array()))).alias("o")), "rank-online")
    met = pairs.join(b, "book_id").join(o, "online_id").select(
        "book_id", "online_id", F.arrays_overlap("b.n", "o.n").alias("hit"), ((F.col("b.t") != "") & (F.col("b.m") == F.col("o.m"))).alias("title_equal"),
        F.arrays_overlap("b.a", "o.a").alias("author_equal"), most_alike(*[F.filter(F.array(m), lambda x: x != "") for m in ("b.m", "o.m")]).alias("title_sim"), most_alike(F.col("b.a"), F.col("o.a")).alias("author_sim"))
    r = rank_ladder(*map(F.col, ("hit", "title_equal", "author_equal", "title_sim", "author_sim")))
    return met.select("book_id", "online_id", r.alias("r")).select("book_id", "online_id", "r.score", "r.reason")


def confidence_of(score: Column) -> Column:
    return F.when(score >= 420, 78).when(score >= 320, 72).when(score >= 250, 66).when(score >= 180, 60).otherwise(54)


def polish_books(books: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, polish, title_key) of each book: whether its texts look Polish, and its title's match text."""
    texts = F.concat(F.array("title", "core"), F.coalesce("creators", F.array()), F.coalesce("subjects", F.array()))
    return books.select(key, is_polish(texts).alias("polish"), match_text(known_title(books)).alias("title_key"))


def provider_gain(provider: Column, reason: Column, polish: Column, same_title: Column) -> Column:
    """What a candidate's score gains by its provider, the book's language and an equal title."""
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROVIDER_GAIN.items() for x in kv]), provider), F.lit(0))
    local = provider == LOCAL
    named = reason.isin("title-author-exact", "title-exact", "title-author-approx")
    return own + F.when(polish & local, 28 + F.when(named, 10).otherwise(0)).when(polish & provider.isin("google-books", "open-library"), -6).otherwise(0) + F.when(local & same_title, 8).otherwise(0)


def normalised(raw: DataFrame) -> DataFrame:
    """Raw provider rows with cleaned texts and a genre from their labels; rows with neither title nor author are left out."""
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean), lambda x: x != "")
    out = raw.withColumns({"title": clean(F.col("title")), "authors": tidy(F.col("authors")), "identifiers": tidy(F.col("identifiers")), "genre": keyword_genre(F.col("genres"))})
    return out.drop("genres").where((F.col("title") != "") | (F.size("authors") > 0))


def consensus(candidates: DataFrame, order: str, *by: str) -> DataFrame:
    """Groups of equal title, authors and book numbers: the best row's fields, providers and sources in order of first row.

    A group's score gains for each further provider. Within ``by`` (the book, if
    the rows belong to one); NULL texts and lists count as empty; of equal
    scores the first row by ``order`` describes the group.
    """
    c = F.col
    none = F.array().cast("array<string>")
    rows = candidates.select(*by, order, "provider", "source", clean(c("title")).alias("title"), F.coalesce("authors", none).alias("authors"), F.coalesce("identifiers", none).alias("identifiers"),
                             "score", "reason", "series", "volume", "genre", "cycle_source")
    keyed = rows.select("*", match_text(c("title")).alias("title_key"), F.array_join(author_match_keys(c("authors")), "|").alias("author_keys"),
                        F.array_join(F.array_sort(extract_isbns(c("identifiers"))), "|").alias("isbn_keys"))
    best = F.max_by(F.struct("title", "authors", "identifiers", "reason", "score", "series", "volume", "genre", "cycle_source"), F.struct("score", -c(order)))
    # first row of each provider and source before the group: a hot group keeps as many entries as it has providers
    keys = [*by, "title_key", "author_keys", "isbn_keys"]
    first = keyed.groupBy(*keys, "provider", "source").agg(best.alias("b"), F.max(F.struct("score", (-c(order)).alias("first"))).alias("s"), F.min(order).alias("at"))
    listed = lambda name: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda x: x[name]))
    per = first.groupBy(*keys).agg(F.max_by("b", "s").alias("b"), listed("provider").alias("providers"), listed("source").alias("sources"), F.min("at").alias("first"))
    n = F.size("providers")
    return per.select(*keys, "providers", "sources", "first", c("b.title").alias("title"), c("b.authors").alias("authors"), c("b.identifiers").alias("identifiers"),
                      (c("b.score") + CONSENSUS_BONUS * (n - 1)).cast("long").alias("score"), F.when(n > 1, F.concat(c("b.reason"), F.lit("+consensus"))).otherwise(c("b.reason")).alias("reason"),
                      clean_series(c("b.series")).alias("series"), c("b.volume").alias("volume"), clean(c("b.genre")).alias("genre"), F.coalesce(c("b.cycle_source"), F.lit("")).alias("cycle_source"))


def best_online(groups: DataFrame, books: DataFrame, key: str = "book_id") -> DataFrame:
    """The best consensus group of each book with its reason and score.

    Groups rank by the score adjusted for Polish books. Below the score of an
    equal book number a second within the margin costs points (``+ambiguous``),
    and so does a hit of the local catalog alone for a book that does not look
    Polish (``+best-effort``); scores stay at 0 or more.
    """
    c = F.col
    rows = groups.drop("title_key").join(polish_books(books, key), key)
    local = F.array_contains("providers", LOCAL)
    gain = F.when(c("polish") & local, 18 + F.when(F.size("providers") == 1, 8).otherwise(0) + F.when((c("title_key") != "") & (match_text(c("title")) == c("title_key")), 6).otherwise(0)).otherwise(0)
    w = Window.partitionBy(key).orderBy(F.desc("adjusted"), F.desc("score"), "first")
    ranked = rows.withColumn("adjusted", c("score") + gain).withColumns({"rn": F.row_number().over(w), "second": F.lead("adjusted").over(w)}).where("rn = 1")
    ranked = ranked.where((c("score") >= 140) | (c("title") != ""))
    close = c("second").isNotNull() & (c("score") < 420) & (c("adjusted") - c("second") < MARGIN)
    once = ranked.withColumns({"score": F.when(close, F.greatest(F.lit(0), c("score") - AMBIGUOUS_COST)).otherwise(c("score")), "reason": F.when(close, F.concat("reason", F.lit("+ambiguous"))).otherwise(c("reason"))})
    weak = (F.size("providers") == 1) & (c("providers")[0] == LOCAL) & (c("score") < 420) & ~c("polish")
    done = once.withColumns({"score": F.when(weak, F.greatest(F.lit(0), c("score") - EFFORT_COST)).otherwise(c("score")), "reason": F.when(weak, F.concat("reason", F.lit("+best-effort"))).otherwise(c("reason"))})
    return done.drop("rn", "second", "adjusted", "polish", "title_key", "first")


def online_record(best: DataFrame, key: str = "book_id") -> DataFrame:
    """Record fields of a best match: a series known from a search page alone is left out, the local catalog keeps its order of authors."""
    c = F.col
    in_order = F.array_distinct(F.filter(F.transform("authors", last_first), lambda x: x != ""))
    joined = F.when(F.size(in_order) > 0, F.array_join(F.when(F.array_contains("providers", LOCAL), in_order).otherwise(F.array_sort(in_order)), " & ")).otherwise("Nieznany Autor")
    search = F.lower(F.trim("cycle_source")) == "search"
    reasons = F.array_compact(F.array(F.when(c("reason").contains("ambiguous"), "online-niejednoznaczne"), F.when(c("reason").contains("best-effort"), "online-best-effort")))
    return best.select(key, joined.alias("author"), F.when(search, "").otherwise(c("series")).alias("series"), F.when(~search, c("volume")).alias("volume"), "title", F.array_join("sources", ",").alias("source"),
                       "identifiers", "genre", confidence_of(c("score")).alias("confidence"), reasons.alias("review_reasons"), F.concat(F.lit("match:"), "reason").alias("match"))


def is_strong(reason: Column, score: Column) -> Column:
    """A candidate good enough to ask no further provider."""
    return ((reason == "isbn-exact") & (score >= 420)) | ((reason == "title-author-exact") & (score >= 260)) | ((reason == "title-exact") & (score >= 280))


def providers_asked(rows: DataFrame, mode: str, group: str = "book_id") -> DataFrame:
    """Rows of the providers that a run of this mode would have asked.

    PL asks the local catalog only; the others go on until a provider gives an
    equal book number, or a strong row (PL+: of the local catalog; EN: of any
    other). The provider that ends the search keeps all its rows.
    """
    c = F.col
    order = MODES[mode]
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(order) for x in (p, i)]), c("provider")), F.lit(len(order)))
    kept = rows if mode != "PL" else rows.where(c("provider") == LOCAL)
    by_number = (c("reason") == "isbn-exact") & (c("score") >= 420)
    by_rank = is_strong(c("reason"), c("score")) & (c("provider") == LOCAL if mode == "PL+" else c("provider") != LOCAL)
    ends = by_number | by_rank if mode != "PL" else by_number
    return early_stop(kept.withColumn("_rank", rank), group, "_rank", ends).drop("_rank")


def early_stop(rows: DataFrame, group: str, rank: str, strong: Column) -> DataFrame:
    """Rows up to and including the first rank of each group that holds a strong row.

    The ranks of ends are few: they are aggregated before any row moves, so a hot
    group is not brought together.
    """
    stop = rows.where(strong).groupBy(group).agg(F.min(rank).alias("_stop"))
    return rows.join(stop, group, "left").where(F.col("_stop").isNull() | (F.col(rank) <= F.col("_stop"))).drop("_stop")


def ambiguity(scored: DataFrame, group: str, order: str) -> DataFrame:
    """Best row per group; below 420 a second within the margin costs points, not under 0.

    Two partial maxima instead of a window: a hot group is combined on the map side.
    """
    c = F.col
    best = scored.groupBy(group).agg(F.max(F.struct("score", (-c(order)).alias("o"))).alias("b"))
    rest = scored.join(best, group).where(-c(order) != c("b.o")).groupBy(group).agg(F.max("score").alias("second"))
    close = c("second").isNotNull() & (c("b.score") < 420) & (c("b.score") - c("second") < MARGIN)
    return best.join(rest, group, "left").select(group, (-c("b.o")).alias(order), F.when(close, F.greatest(F.lit(0), c("b.score") - AMBIGUOUS_COST)).otherwise(c("b.score")).alias("score"), close.alias("ambiguous"))
