"""Queries of titles, rules, catalog and plans, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.functions import text as t, titles
from folioforge.operators import arbitration, authors, candidates, existing_names as names, local_names, online, records, searches, verify
from folioforge.plans import destinations as plans
from folioforge.queries import sql_clean, sql_fold, sql_key, sql_match
from folioforge.runtime import cut, table
from folioforge.sources import pages
from folioforge.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NONE = "CAST([] AS VARCHAR[])"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_volume(x: str) -> tuple[str, str]:
    """(major, minor) of a text already cleaned: the first number, else a roman number of two letters or more."""
    number = f"regexp_extract({x}, '(\\d+)(?:\\.(\\d+))?', 1)"
    minor = f"regexp_extract({x}, '(\\d+)(?:\\.(\\d+))?', 2)"
    digits = f"list_transform(regexp_extract_all(upper({x}), '.'), lambda ch: CASE ch WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END)"
    roman = f"list_sum(list_transform({digits}, lambda dg, i: CASE WHEN dg < coalesce(list_max(list_slice({digits}, i + 1, NULL)), 0) THEN -dg ELSE dg END))"
    is_roman = f"regexp_matches({x}, '^[IVXLCDMivxlcdm]{{2,}}$') AND {roman} BETWEEN 1 AND 3999"
    return (f"CASE WHEN {number} <> '' THEN TRY_CAST({number} AS INT) WHEN {is_roman} THEN CAST({roman} AS INT) END",
            f"CASE WHEN {number} <> '' THEN CASE WHEN TRY_CAST({number} AS INT) IS NOT NULL THEN CASE WHEN length({minor}) < 2 THEN lpad({minor}, 2, '0') ELSE {minor} END END WHEN {is_roman} THEN '00' END")


def sql_last_first(x: str) -> str:
    """Last-first form of a text, as an expression over one row."""
    particles = ", ".join(_lit(p) for p in t.SURNAME_PARTICLES)
    name = sql_clean(f"regexp_replace({x}, '\\[.*?\\]', '', 'g')")
    return f"""(SELECT CASE WHEN contains(n, ',') AND len(p) = 2 THEN p[1] || ' ' || p[2] WHEN contains(n, ',') AND len(p) > 2 THEN n
      WHEN len(w) >= 2 AND g > 0 THEN array_to_string(w[g + 1:], ' ') || ' ' || array_to_string(w[:g], ' ') ELSE n END
      FROM (SELECT n, p, w, coalesce(list_max(list_filter(range(1, len(w)), lambda i: NOT list_contains([{particles}], rtrim(lower(w[i]), '.')))), 0) AS g
        FROM (SELECT n, list_filter(list_transform(string_split(n, ','), lambda q: trim(q)), lambda q: q <> '') AS p, string_split(n, ' ') AS w FROM (SELECT {name} AS n))))"""


_major, _minor = sql_volume("x")


@query(f"SELECT book_id, coalesce({_major}, -1) AS major, coalesce({_minor}, '') AS minor FROM (SELECT book_id, {sql_clean('stem')} AS x FROM books)")
def volume_parse(spark: SparkSession, d: str) -> DataFrame:
    """First number or roman number of every file stem."""
    return table(spark, d, "books").select("book_id", t.parse_volume(F.col("stem")).alias("v")).select("book_id", F.coalesce("v.major", F.lit(-1)).alias("major"), F.coalesce("v.minor", F.lit("")).alias("minor"))


@query(f"""SELECT book_id, pos, word, CASE WHEN v BETWEEN 1 AND 3999 AND regexp_matches(upper(word), '^[IVXLCDM]{{2,}}$') THEN CAST(v AS INT) ELSE -1 END AS roman FROM (
  SELECT book_id, pos, word, list_sum(list_transform(ds, lambda v, i: CASE WHEN v < coalesce(list_max(list_slice(ds, i + 1, NULL)), 0) THEN -v ELSE v END)) AS v FROM (
    SELECT book_id, pos, word, list_transform(regexp_extract_all(upper(word), '.'), lambda ch: CASE ch WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END) AS ds
    FROM (SELECT book_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT book_id, string_split({sql_clean('stem')}, ' ') AS w FROM books))))""")
def roman_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Value of every word of the file stems that is a roman number."""
    w = table(spark, d, "books").select("book_id", F.posexplode(F.split(t.clean(F.col("stem")), " ")).alias("pos", "word"))
    return w.select("book_id", F.col("pos").cast("long").alias("pos"), "word", F.coalesce(t.roman_value(F.col("word")), F.lit(-1)).alias("roman"))


@query()
def split_author_lists(spark: SparkSession, d: str) -> DataFrame:
    """Authors of every record's author field; tested against fixed cases, the cleaning of segments being beyond SQL."""
    return table(spark, d, "records").select("record_id", F.array_join(titles.split_authors(F.col("author")), "|").alias("parts"))


@query()
def canonical_author_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("record_id", F.array_join(t.canonical_authors(titles.split_authors(F.col("author"))), " & ").alias("authors"))


@query(f"SELECT row_id, {sql_last_first('author_first_last')} AS last_first FROM author_rows WHERE author_first_last IS NOT NULL")
def author_last_first(spark: SparkSession, d: str) -> DataFrame:
    """Family name first, of every row's name."""
    return table(spark, d, "author_rows").where("author_first_last is not null").select("row_id", t.last_first(F.col("author_first_last")).alias("last_first"))


@query(f"""SELECT book_id, CASE WHEN x IS NULL THEN '' WHEN r = '' THEN x ELSE r END AS title FROM (
  SELECT book_id, x, {sql_clean(f"regexp_extract(x, {_lit('(?i)' + titles.LEADING_INDEX)}, 1)")} AS r FROM (SELECT book_id, {sql_clean('core')} AS x FROM books))""")
def title_without_index(spark: SparkSession, d: str) -> DataFrame:
    """Core of every name without the number in front."""
    return table(spark, d, "books").select("book_id", titles.strip_leading_index(F.col("core")).alias("title"))


@query()
def sanitized_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles without genre, series, volume and author, and as search texts; tested against fixed cases."""
    c = F.col
    b = table(spark, d, "books")
    author = F.coalesce(F.try_element_at("creators", F.lit(1)), F.lit(""))
    return b.select("book_id", titles.sanitize_title(c("title"), c("meta_series"), c("meta_volume")).alias("title"), titles.strip_author(c("core"), author).alias("without_author"),
                    titles.query_title(F.coalesce(F.nullif("title", F.lit("")), "core"), author, c("meta_series"), c("meta_volume")).alias("search"))


_genre_rows = ", ".join(f"({i}, {_lit(g)}, {_lit(k.replace('-', ' '))}, {len(k.replace('-', ' ').split())})" for i, (g, ks) in enumerate(titles.GENRES.items()) for k in ks)


@query(f"""
WITH k(i, genre, word, n) AS (VALUES {_genre_rows}),
l AS (SELECT book_id, lbl, row_number() OVER (PARTITION BY book_id ORDER BY p) - 1 AS li FROM (
  SELECT book_id, {sql_match('s')} AS lbl, p FROM (SELECT book_id, unnest(subjects) AS s, generate_subscripts(subjects, 1) AS p FROM books)) WHERE lbl <> ''),
h AS (SELECT book_id, i, genre, sum(n) AS score, min(instr(lbl, word)) AS place, min(li) AS first FROM l JOIN k ON instr(lbl, word) > 0 GROUP BY ALL),
f AS (SELECT book_id, max(CASE WHEN genre = 'fantasy' THEN place END) AS fa, max(CASE WHEN genre = 'sci-fi' THEN place END) AS sa FROM h GROUP BY book_id),
b AS (SELECT book_id, genre FROM h QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY score DESC, place, genre = 'mlodziezowa', first * 100 + i) = 1)
SELECT books.book_id, CASE WHEN fa <= sa THEN 'fantasy' ELSE coalesce(genre, '') END AS genre FROM books LEFT JOIN b USING (book_id) LEFT JOIN f USING (book_id)""")
def keyword_genre(spark: SparkSession, d: str) -> DataFrame:
    """Genre of every book by the keywords in its subjects."""
    return table(spark, d, "books").select("book_id", titles.keyword_genre(F.col("subjects")).alias("genre"))


_noise = ", ".join(map(_lit, authors.NOISE_WORDS))
_corporate = ", ".join(map(_lit, authors.CORPORATE_WORDS))
_stripped = f"""array_to_string(list_filter(list_transform(list_filter(string_split({sql_clean('author_raw')}, ' '), lambda q: q <> ''), lambda q: trim(q, '()[]{{}}.,;:')),
  lambda q: q <> '' AND NOT regexp_matches(trim(q, '-'), '^\\d{{3,4}}(?:[-/]\\d{{2,4}})?$') AND NOT list_contains([{_noise}], lower(q))), ' ')"""


@query(f"""SELECT row_id, name, coalesce(len(w) BETWEEN 2 AND 6 AND len(list_filter(w, lambda q: regexp_matches(q, '\\pL'))) >= 2 AND length(regexp_replace(name, '[^\\pL]', '', 'g')) >= 4
  AND NOT regexp_matches(name, '\\d') AND NOT (len(w) >= 3 AND len(list_filter(w, lambda q: list_contains([{_corporate}], lower(q)))) > 0), false) AS plausible
 FROM (SELECT row_id, name, list_filter(string_split(name, ' '), lambda q: q <> '') AS w FROM (SELECT row_id, {_stripped} AS name FROM author_rows))""")
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    """Raw names without noise, and whether they can be authors."""
    raw = F.col("author_raw")
    return table(spark, d, "author_rows").select("row_id", authors.strip_noise(raw).alias("name"), authors.is_plausible_author(raw).alias("plausible"))


def _merge_sql() -> str:
    fields = ["author_first_last", "author_last_first", "author_raw"]
    best = ", ".join(
        f"coalesce(arg_min({x}, row(CAST(contains({x}, '...') AS INT), CAST(regexp_matches({sql_clean(x)}, '\\d') AS INT), "
        f"len(list_filter(string_split({sql_clean(x)}, ' '), lambda w: length(w) = 1)), sr, -cr, -length({x}), row_id)) FILTER ({x} <> ''), '') AS {x}" for x in fields)
    return f"""
WITH r AS (SELECT group_key, row_id, coalesce(source_rank, 99) AS sr, coalesce(confidence_rank, -1) AS cr, source, {', '.join(f"trim(coalesce({x}, ''), ' ') AS {x}" for x in fields)} FROM author_rows WHERE group_key <> ''),
m AS (SELECT group_key, count(*) AS n_rows, {best} FROM r GROUP BY group_key),
s AS (SELECT group_key, string_agg(k, ' | ' ORDER BY CASE k WHEN 'lc' THEN 0 WHEN 'ol' THEN 1 ELSE 99 END, k) AS source FROM (
  SELECT DISTINCT group_key, CASE v WHEN 'lubimyczytac' THEN 'lc' WHEN 'openlibrary' THEN 'ol' ELSE v END AS k FROM (
    SELECT group_key, lower(trim(unnest(string_split(source, '|')), ' ')) AS v FROM r WHERE source IS NOT NULL)) WHERE k <> '' GROUP BY group_key)
SELECT m.group_key, n_rows, author_first_last, author_last_first, CASE WHEN author_raw IN (author_first_last, author_last_first) THEN '' ELSE author_raw END AS author_raw, coalesce(source, '') AS source
FROM m LEFT JOIN s USING (group_key)"""


@query(_merge_sql())
def author_merge(spark: SparkSession, d: str) -> DataFrame:
    """Grouped author merge: best name forms by text quality, trust, confidence and length, and all sources."""
    return authors.merge_authors(table(spark, d, "author_rows")).select("group_key", "n_rows", "author_first_last", "author_last_first", "author_raw", "source")


def sql_catalog_name(x: str) -> str:
    """Cleaned name; dots after lone letters go. Neighbouring letters share a blank, hence twice."""
    once = lambda y: f"regexp_replace({y}, '(^|[^\\pL\\pN_])(\\pL)\\.(\\s|$)', '\\1\\2\\3', 'g')"
    return once(once(sql_clean(x)))


def _catalog_sql(tail: str) -> str:
    given = ", ".join(map(_lit, authors.GIVEN_NAMES))
    ranks = "CASE lower(trim(source)) " + " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in authors.CATALOG_RANK.items()) + " ELSE 99 END"
    form = lambda pos, x: f"SELECT id, {pos} AS pos, {sql_catalog_name(x)} AS name FROM c"
    alias = lambda x: f"SELECT id, {sql_catalog_name(x)} AS alias FROM c"
    return f"""
WITH merged AS ({_merge_sql()}),
c AS (SELECT row_number() OVER (ORDER BY group_key) AS id, {ranks} AS rk, {sql_clean('author_first_last')} AS fl, {sql_clean('author_last_first')} AS lf, {sql_clean('author_raw')} AS raw FROM merged),
f AS ({form(0, 'fl')} UNION ALL {form(1, 'raw')} UNION ALL {form(2, sql_last_first('lf'))} UNION ALL {form(3, sql_last_first('raw'))}),
w AS (SELECT id, pos, name, list_transform(string_split(name, ' '), lambda q: lower(q)) AS p FROM f WHERE name <> ''),
pref AS (SELECT id, name AS preferred FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN p[1] IN ({given}) THEN 2 ELSE 0 END DESC,
   CASE WHEN p[-1] IN ({given}) THEN -1 ELSE 0 END DESC, len(list_filter(p, lambda q: length(q) = 1)), length(name) DESC, pos) = 1),
r AS (SELECT c.*, preferred, coalesce(nullif({sql_key('fl')}, ''), nullif({sql_key('lf')}, ''), {sql_key('raw')}) AS gk FROM c JOIN pref USING (id)),
canon AS (SELECT gk, preferred AS canonical FROM r WHERE gk <> '' QUALIFY row_number() OVER (PARTITION BY gk ORDER BY rk, length(fl) DESC, length(preferred) DESC, preferred) = 1),
a AS ({' UNION '.join(alias(x) for x in ('fl', 'lf', 'raw', sql_last_first('fl'), sql_last_first('raw')))}),
k AS (SELECT alias, {sql_key('alias')} AS alias_key, canonical, rk, length(fl) AS n FROM a JOIN r USING (id) JOIN canon USING (gk) WHERE alias <> ''),
best AS (SELECT alias_key, canonical FROM k WHERE alias_key <> '' QUALIFY row_number() OVER (PARTITION BY alias_key ORDER BY rk, n DESC, canonical) = 1)
{tail}"""


def _catalog(spark: SparkSession, d: str) -> authors.Catalog:
    return authors.build_catalog(cut(authors.merge_authors(table(spark, d, "author_rows")), "merged-authors"))


@query(_catalog_sql("SELECT alias_key, canonical FROM best"))
def author_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Alias keys of all merged authors."""
    return _catalog(spark, d).aliases


_letters = f"list_transform(string_split(alias, ' '), lambda q: regexp_extract(lower({sql_fold('q')}), '\\pL', 0))"


@query(_catalog_sql(f"""SELECT initials, string_agg(canonical, '|' ORDER BY length(canonical), canonical) AS authors FROM (SELECT DISTINCT array_to_string({_letters}, '') AS initials, canonical FROM k
  WHERE len(string_split(alias, ' ')) BETWEEN 2 AND 5 AND len(list_filter({_letters}, lambda q: q = '')) = 0) WHERE initials <> '' GROUP BY initials"""))
def catalog_initials(spark: SparkSession, d: str) -> DataFrame:
    """Authors by their initials, shortest first."""
    return _catalog(spark, d).initials.select("initials", F.array_join("authors", "|").alias("authors"))


@query(_catalog_sql(f"""SELECT record_id, author, canonical FROM (
  SELECT record_id, author, canonical, row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN p[1] IN ({', '.join(map(_lit, authors.GIVEN_NAMES))}) THEN 2 ELSE 0 END DESC, CASE WHEN p[-1] IN ({', '.join(map(_lit, authors.GIVEN_NAMES))}) THEN -1 ELSE 0 END DESC,
    len(list_filter(p, lambda q: length(q) = 1)), length(canonical) DESC, probe) AS rn FROM (
    SELECT x.record_id, x.author, x.probe, b.canonical, list_transform(string_split(coalesce(b.canonical, ''), ' '), lambda q: lower(q)) AS p FROM (
      SELECT record_id, author, 0 AS probe, {sql_catalog_name('author')} AS form FROM records UNION ALL SELECT record_id, author, 1, {sql_catalog_name(sql_last_first(sql_catalog_name('author')))} FROM records) x
    LEFT JOIN best b ON b.alias_key = {sql_key('x.form')} AND b.canonical IS NOT NULL) QUALIFY canonical IS NOT NULL OR probe = 0) WHERE rn = 1"""))
def resolve_record_authors(spark: SparkSession, d: str) -> DataFrame:
    """Known author of every record's author field."""
    return authors.resolve(table(spark, d, "records").select("record_id", "author"), "author", _catalog(spark, d).aliases)


@query()
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Longest known author at the start or end of every core."""
    b, known = table(spark, d, "books"), _catalog(spark, d)
    first = authors.known_ends(b, "book_id", "core", known).withColumn("place", F.lit("start"))
    return first.unionByName(authors.known_ends(b, "book_id", "core", known, suffix=True).withColumn("place", F.lit("end")))


@query()
def author_spans(spark: SparkSession, d: str) -> DataFrame:
    """Known authors named anywhere in every record's author field."""
    got = authors.known_authors(table(spark, d, "records"), "record_id", "author", _catalog(spark, d))
    return got.select("record_id", F.array_join("authors", "|").alias("authors"))


def _rules_sql() -> str:
    parts = []
    for source, rules in (("title", candidates.TITLE_RULES), ("core", candidates.CORE_RULES)):
        for r in rules:
            if r.tag in ("title:square-bracket-series-book", "title:trailing-series-book", "title:leading-index-dotted", "core:title-author"):
                continue
            g = lambda n, r=r: f"regexp_extract(x, {_lit('(?i)' + r.pattern)}, {n})"
            ma, mi = sql_volume("v")
            guard = "true"
            if r.tag == "title:indexed":
                guard = f"NOT regexp_matches({sql_clean(g(3))}, '^\\d')"
            if r.tag in ("core:comma", "core:joined", "core:spaced"):
                guard = f"NOT regexp_matches({sql_clean(g(1))}, {_lit('(?i)' + candidates._GENERIC_END)})"
                if r.tag != "core:comma":
                    guard += f" AND NOT regexp_matches({sql_clean(g(3))}, '^\\d+\\b')"
            has_volume = "major IS NOT NULL" if r.volume else "true"
            parts.append(f"""SELECT book_id, {r.score} AS score, series, coalesce(major, -1) AS major, coalesce(minor, '') AS minor, title_override, '{r.tag}' AS source FROM (
              SELECT book_id, trim({sql_clean('s')}, ' ,') AS series, {ma if r.volume else 'CAST(NULL AS INT)'} AS major, {mi if r.volume else 'CAST(NULL AS VARCHAR)'} AS minor, {sql_clean('ti')} AS title_override FROM (
                SELECT book_id, {g(r.series)} AS s, {g(r.volume) if r.volume else "''"} AS v, {g(r.title) if r.title else "''"} AS ti FROM (SELECT book_id, {sql_clean(source)} AS x FROM books)
                WHERE regexp_matches(x, {_lit('(?i)' + r.pattern)}) AND {guard})) WHERE series <> '' AND {has_volume}""")
    return " UNION ALL ".join(parts)


@query(_rules_sql())
def pattern_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Guesses of the rules that are one pattern over title or core."""
    c = F.col
    special = ["title:square-bracket-series-book", "title:trailing-series-book", "title:leading-index-dotted", "core:title-author", "opf"]
    rows = candidates.rule_candidates(table(spark, d, "books"), "book_id").where(~c("source").isin(special) & ~c("source").startswith("segment:"))
    return rows.select("book_id", "score", "series", F.coalesce("volume.major", F.lit(-1)).alias("major"), F.coalesce("volume.minor", F.lit("")).alias("minor"), "title_override", "source")


@query()
def rule_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Guesses of all rules over title, core, segments and own metadata; the rules beyond one pattern are tested against fixed cases."""
    rows = candidates.rule_candidates(table(spark, d, "books"), "book_id")
    return rows.select("book_id", "pos", "score", "series", t.format_volume(F.col("volume")).alias("volume"), "title_override", "source")


def _given_guesses(spark: SparkSession, d: str) -> DataFrame:
    """The table's guesses with title and core of their book; repeated rows are numbered apart by what they say."""
    c = F.col
    g = table(spark, d, "candidates").select("book_id", "pos", "score", F.coalesce("series", F.lit("")).alias("series"), "volume", F.coalesce("title_override", F.lit("")).alias("title_override"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    return g.join(table(spark, d, "books").select("book_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("core", F.lit("")).alias("core")), "book_id").where(c("series") != "")


_prio = "CASE source " + " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in candidates.SERIES_PRIORITY.items()) + " ELSE score END"


@query(f"""SELECT book_id, series, score, source FROM (SELECT DISTINCT c.book_id, c.pos, c.score, c.series, coalesce(c.title_override, '') AS t, coalesce(c.source, '') AS source, volume FROM candidates c JOIN books USING (book_id) WHERE c.series <> '')
 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY {_prio} DESC, score DESC, t <> '' DESC, pos, series DESC) = 1""")
def top_series(spark: SparkSession, d: str) -> DataFrame:
    """Series guess of each book by the trust in its source, then score, then a title."""
    return candidates.top_series(_given_guesses(spark, d), "book_id").select("book_id", "series", "score", "source")


@query("""SELECT book_id, title_override, score FROM (SELECT DISTINCT c.book_id, c.pos, c.score, c.series, c.title_override FROM candidates c JOIN books USING (book_id) WHERE c.series <> '' AND c.title_override <> '')
 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY score DESC, length(title_override) DESC, pos) = 1""")
def top_title(spark: SparkSession, d: str) -> DataFrame:
    """Guess with a title of each book by score, then length."""
    return candidates.top_title(_given_guesses(spark, d), "book_id").select("book_id", "title_override", "score")


@query()
def local_series(spark: SparkSession, d: str) -> DataFrame:
    """Series guess that fits each book's own texts best."""
    return candidates.local_series(_given_guesses(spark, d), "book_id").select("book_id", "series", "score", "source")


@query()
def local_title(spark: SparkSession, d: str) -> DataFrame:
    """Title guess that fits each book's own texts and chosen series best."""
    g = _given_guesses(spark, d)
    return candidates.local_title(g, "book_id", candidates.local_series(g, "book_id")).select("book_id", "title_override", "score", "source")


@query()
def existing_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in the output form, made of every record, read back."""
    c = F.col
    stem = F.concat_ws(" - ", t.clean(c("author")), F.when(F.coalesce(c("series"), F.lit("")) == "", "Standalone").otherwise(c("series")), t.format_volume(c("volume")), t.clean(c("title")))
    got = names.existing_names(table(spark, d, "records").select("record_id", stem.alias("stem")), "record_id")
    return got.select("record_id", "author", "series", t.format_volume(c("volume")).alias("volume"), "title", "genre")


@query()
def hybrid_names(spark: SparkSession, d: str) -> DataFrame:
    """Author and title read out of every core by the first rule that fits."""
    rows = local_names.hybrid_names(table(spark, d, "books").select("book_id", "core"))
    return rows.where("h is not null").select("book_id", "h.author", "h.title", t.format_volume(F.col("h.volume")).alias("volume"), "h.source", "h.confidence")


@query()
def local_records(spark: SparkSession, d: str) -> DataFrame:
    """Record of every book from its own name and metadata."""
    c = F.col
    rows = local_names.local_records(table(spark, d, "books"))
    return rows.select("book_id", "author", "series", t.format_volume(c("volume")).alias("volume"), "title", "genre", "source", "confidence", "title_from_core", F.array_join("isbns", "|").alias("isbns"))


_fin = """
WITH r AS (SELECT record_id, author, coalesce(records.title, '') AS title, coalesce(series, '') AS series, volume, source, confidence, errors, coalesce(review_reasons, CAST([] AS VARCHAR[])) AS earlier FROM records LEFT JOIN books USING (path)),
p AS (SELECT record_id, confidence, earlier, list_filter([
  CASE WHEN author = 'Nieznany Autor' THEN 'nieznany-autor' END, CASE WHEN title IN ('', 'Bez tytulu') THEN 'brak-tytulu' END,
  CASE WHEN source = 'fallback' THEN 'tytul-z-nazwy-pliku' END, CASE WHEN source = 'fallback' THEN 'fallback' END,
  CASE WHEN series NOT IN ('', 'Standalone') AND (volume IS NULL OR (volume.major = 0 AND volume.minor = '00')) THEN 'seria-bez-tomu' END,
  CASE WHEN len(errors) > 0 THEN 'blad-odczytu-metadanych' END,
  CASE WHEN regexp_matches(title, '(?i)\\b[0-9a-f]{12,}\\b') THEN 'szum-w-tytule' END,
  CASE WHEN regexp_matches(title, '(?i)\\banna.?s archive\\b') THEN 'artefakt-zrodla' END], lambda x: x IS NOT NULL) AS found FROM r),
q AS (SELECT record_id, found, earlier, CAST(greatest(0, least(100, confidence - list_sum(list_concat([0], list_transform(found, lambda x: CASE x WHEN 'nieznany-autor' THEN 25
  WHEN 'brak-tytulu' THEN 30 WHEN 'fallback' THEN 15 WHEN 'seria-bez-tomu' THEN 12 WHEN 'blad-odczytu-metadanych' THEN 10 WHEN 'tytul-z-nazwy-pliku' THEN 5 ELSE 20 END))))) AS INT) AS confidence FROM p),
e AS (SELECT record_id, confidence, list_concat(earlier, list_filter(found, lambda x: NOT list_contains(earlier, x))) AS reasons FROM q)
"""


def _final(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    r = table(spark, d, "records").join(table(spark, d, "books").select("path", "errors"), "path", "left")
    q = records.finalize(c("author"), c("title"), c("series"), c("volume"), c("source"), c("source") == "fallback", c("errors"), c("confidence"), c("review_reasons"))
    return r.select("record_id", q.alias("q")).select("record_id", "q.confidence", "q.reasons")


@query(_fin + "SELECT record_id, confidence, array_to_string(reasons, '|') AS reasons FROM e")
def confidence_finalize(spark: SparkSession, d: str) -> DataFrame:
    """Confidence and reasons of every record after the penalties; a fallback takes its title from the file name."""
    return _final(spark, d).select("record_id", "confidence", F.array_join("reasons", "|").alias("reasons"))


@query(_fin + f"SELECT (confidence < 65 OR list_has_any(reasons, [{', '.join(map(_lit, ['online-niejednoznaczne', 'online-best-effort', 'nieznany-autor', 'brak-tytulu', 'fallback', 'szum-w-tytule', 'artefakt-zrodla']))}])) AS needs_review, count(*) AS n FROM e GROUP BY 1")
def review_split(spark: SparkSession, d: str) -> DataFrame:
    """Records by whether they need a review."""
    f = _final(spark, d)
    return f.groupBy(records.needs_review(F.col("confidence"), F.col("reasons")).alias("needs_review")).agg(F.count("*").alias("n"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "online_candidates").drop("book_id", "pos")


_cons = f"""
WITH a AS (SELECT online_id, unnest(authors) AS a FROM online_candidates),
k AS (SELECT online_id, string_agg(k, '|' ORDER BY k) AS author_keys FROM (SELECT DISTINCT online_id, k FROM (
  SELECT online_id, {sql_match('a')} AS k FROM a UNION ALL SELECT online_id, {sql_match('lf')} AS k FROM (SELECT online_id, {sql_last_first('a')} AS lf FROM a)) WHERE k <> '') GROUP BY online_id),
i AS (SELECT online_id, string_agg(n, '|' ORDER BY n) AS isbn_keys FROM (SELECT DISTINCT online_id, upper(unnest(regexp_extract_all(v, '(97[89][0-9]{{10}}|[0-9]{{9}}[0-9Xx])', 1))) AS n FROM (SELECT online_id, unnest(identifiers) AS v FROM online_candidates)) GROUP BY online_id),
r AS (SELECT o.online_id, provider, source, score, {sql_clean('title')} AS title, {sql_match('title')} AS title_key, coalesce(author_keys, '') AS author_keys, coalesce(isbn_keys, '') AS isbn_keys, coalesce(reason, '') AS reason FROM online_candidates o LEFT JOIN k USING (online_id) LEFT JOIN i USING (online_id)),
f AS (SELECT title_key, author_keys, isbn_keys, provider, min(online_id) AS seen FROM r GROUP BY ALL),
p AS (SELECT title_key, author_keys, isbn_keys, string_agg(provider, '|' ORDER BY seen) AS providers, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY title_key, author_keys, isbn_keys ORDER BY score DESC, online_id) = 1)
SELECT title_key, author_keys, isbn_keys, providers, title, CAST(score + 25 * (n - 1) AS BIGINT) AS score, CASE WHEN n > 1 THEN reason || '+consensus' ELSE reason END AS reason FROM b JOIN p USING (title_key, author_keys, isbn_keys)"""


@query(_cons)
def online_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Groups of online rows of equal title, authors and book numbers."""
    o = _found(spark, d).withColumn("reason", F.coalesce("reason", F.lit("")))
    return online.consensus(o, "online_id").select("title_key", "author_keys", "isbn_keys", F.array_join("providers", "|").alias("providers"), "title", "score", "reason")


@query()
def best_online(spark: SparkSession, d: str) -> DataFrame:
    """Best consensus group of each book among the online rows of an equal book number or title, with its record fields."""
    b, o = table(spark, d, "books"), _found(spark, d)
    ranked = online.rank_pairs(online.equal_pairs(b, o), b, o)
    rows = o.drop("score", "reason").join(ranked, "online_id").join(online.polish_books(b), "book_id")
    gain = online.provider_gain(F.col("provider"), F.col("reason"), F.col("polish"), t.match_text(F.col("title")) == F.col("title_key"))
    best = online.best_online(online.consensus(rows.withColumn("score", F.col("score") + gain), "online_id", "book_id"), b)
    r = online.online_record(best)
    return r.select("book_id", "author", "series", t.format_volume(F.col("volume")).alias("volume"), "title", "source", "confidence", F.array_join("review_reasons", "|").alias("reasons"), "match")


@query("""WITH r AS (SELECT c_nationkey, c_custkey, CAST(round(c_acctbal / 20) AS INT) AS score, row_number() OVER w AS rn, lead(CAST(round(c_acctbal / 20) AS INT)) OVER w AS second
  FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY CAST(round(c_acctbal / 20) AS INT) DESC, c_custkey))
 SELECT c_nationkey, c_custkey, CASE WHEN second IS NOT NULL AND score < 420 AND score - second < 25 THEN greatest(0, score - 10) ELSE score END AS score,
  coalesce(second IS NOT NULL AND score < 420 AND score - second < 25, false) AS ambiguous FROM r WHERE rn = 1""")
def ambiguity_margin(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.round(F.col("c_acctbal") / 20).cast("int").alias("score"))
    return online.ambiguity(c, "c_nationkey", "c_custkey")


def _asked_sql(mode: str) -> str:
    order = online.MODES[mode]
    rank = "CASE provider " + " ".join(f"WHEN {_lit(p)} THEN {i}" for i, p in enumerate(order)) + f" ELSE {len(order)} END"
    side = f"provider {'=' if mode == 'PL+' else '<>'} '{online.LOCAL}'"
    strong = f"(reason = 'isbn-exact' AND score >= 420) OR ({side} AND ((reason = 'title-author-exact' AND score >= 260) OR (reason = 'title-exact' AND score >= 280)))"
    return f"""WITH r AS (SELECT online_id, {sql_match('title')} AS work, provider, coalesce(reason, '') AS reason, score, {rank} AS rk FROM online_candidates),
      s AS (SELECT work, min(rk) AS stop FROM r WHERE {strong} GROUP BY work) SELECT '{mode}' AS mode, online_id FROM r LEFT JOIN s USING (work) WHERE stop IS NULL OR rk <= stop"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_asked_sql(m)})" for m in ("PL+", "EN")))
def provider_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Online rows of a title that a run of two modes would have asked for."""
    rows = _found(spark, d).select("online_id", t.match_text(F.col("title")).alias("work"), "provider", F.coalesce("reason", F.lit("")).alias("reason"), "score")
    asked = [online.providers_asked(rows, m, "work").select(F.lit(m).alias("mode"), "online_id") for m in ("PL+", "EN")]
    return asked[0].unionByName(asked[1])


def _part_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    p = table(spark, d, "part").select("p_partkey", c("p_brand").alias("folder"), c("p_name").alias("stem"), F.lit("epub").alias("ext"), c("p_size").alias("confidence"))
    return p, p.where("confidence > 45").select("folder", F.upper("stem").alias("stem"), "ext").distinct()


@query("""WITH e AS (SELECT DISTINCT p_brand AS f, lower(p_name) AS s FROM part WHERE p_size > 45),
 m AS (SELECT p_partkey, p_name AS stem, p_size, s IS NOT NULL AND p_brand = 'Brand#11' AS moved, CASE WHEN s IS NOT NULL AND p_brand = 'Brand#11' THEN p_brand || '/dubel' ELSE p_brand END AS folder
   FROM part LEFT JOIN e ON f = p_brand AND s = lower(p_name)),
 n AS (SELECT p_partkey, stem, p_size, moved, folder, row_number() OVER (PARTITION BY folder, lower(stem) ORDER BY p_partkey) - 1 + CASE WHEN s IS NOT NULL THEN 1 ELSE 0 END AS number FROM m LEFT JOIN e ON f = folder AND s = lower(stem))
 SELECT p_partkey, folder, CAST(number AS BIGINT) AS number, stem || CASE WHEN number > 0 THEN ' (' || number || ')' ELSE '' END AS final_stem,
   CAST(greatest(0, greatest(0, p_size - CASE WHEN moved THEN 3 ELSE 0 END) - 5 * number) AS BIGINT) AS confidence FROM n""")
def dedupe_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that collide neither with each other nor with existing files."""
    rows, existing = _part_files(spark, d)
    got = plans.assign_names(rows, existing, "Brand#11", "p_partkey")
    return got.select("p_partkey", "folder", F.col("number").cast("long").alias("number"), "final_stem", F.col("confidence").cast("long").alias("confidence"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its source and target place: Polish titles stay in their folder."""
    c = F.col
    r = table(spark, d, "records")
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    target = F.concat(F.when(c("record_id") % 3 == 0, name).otherwise(F.concat(F.regexp_replace(t.clean(c("title")), r"[/\\]", "-"), F.lit("-"), c("record_id").cast("string"), F.lit(".epub"))))
    return r.select("*", folder.alias("source_folder"), name.alias("source_name"), F.when(c("record_id") % 2 == 0, folder).otherwise("out").alias("target_folder"), target.alias("target_name"),
                    F.concat(F.lit("archive/"), name).alias("archive_path"), F.when(c("online_applied"), "copied+archived").alias("status"), F.lit("planned").alias("metadata_status"))


_place = f"""SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS source_folder, regexp_extract(path, '([^/]*)$', 1) AS source_name,
  CASE WHEN record_id % 2 = 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE 'out' END AS target_folder,
  CASE WHEN record_id % 3 = 0 THEN regexp_extract(path, '([^/]*)$', 1) ELSE regexp_replace({sql_clean('title')}, '[/\\\\]', '-', 'g') || '-' || record_id || '.epub' END AS target_name FROM records"""
_moves = f"""WITH r AS ({_place}), m AS (SELECT *, source_folder = target_folder AS same FROM r WHERE NOT (source_folder = target_folder AND source_name = target_name))
 SELECT record_id, 1 AS step, CASE WHEN same THEN 'rename' ELSE 'copy' END AS operation, source_folder || '/' || source_name AS source,
   CASE WHEN same THEN source_folder || '/__tmp_rename_s_' || record_id || '.' || lower(regexp_extract(source_name, '\\.([^.]+)$', 1)) END AS temp, target_folder || '/' || target_name AS destination FROM m
 UNION ALL SELECT record_id, 2, 'move', source_folder || '/' || source_name, NULL, 'archive/' || source_name FROM m WHERE NOT same"""


@query(_moves)
def move_plan(spark: SparkSession, d: str) -> DataFrame:
    """Renames over temporary names, and copies with the original archived."""
    return plans.build_moves(_placed(spark, d), "record_id", "s", archive=True)


@query(f"""WITH p AS ({_moves}), g AS (SELECT *, row_number() OVER (PARTITION BY lower(destination) ORDER BY record_id, step) AS rn FROM p), f AS (SELECT DISTINCT lower(path) AS x FROM books), s AS (SELECT DISTINCT lower(source) AS x FROM p)
 SELECT record_id, step, 'duplicate-destination:' || regexp_extract(destination, '([^/\\\\]+)$', 1) AS error FROM g WHERE rn > 1
 UNION ALL SELECT record_id, step, 'destination-exists:' || regexp_extract(destination, '([^/\\\\]+)$', 1) FROM g WHERE rn = 1 AND lower(destination) IN (SELECT x FROM f) AND NOT (operation = 'rename' AND lower(destination) IN (SELECT x FROM s))""")
def destination_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Moves of the plan that go to a place another move or an existing file has."""
    return plans.check_moves(move_plan(spark, d), table(spark, d, "books").select("path"), "record_id")


_review = "(confidence < 65 OR coalesce(list_has_any(review_reasons, ['online-niejednoznaczne', 'online-best-effort', 'nieznany-autor', 'brak-tytulu', 'fallback', 'szum-w-tytule', 'artefakt-zrodla']), false))"


@query(f"""WITH r AS ({_place}) SELECT source_name, target_name, target_folder, coalesce(author, '') AS author, array_to_string(coalesce(identifiers, {NONE}), ',') AS identifiers, CASE WHEN {_review} THEN 'CHECK' ELSE 'OK' END AS review,
  CASE WHEN online_checked THEN 'yes' ELSE 'no' END AS online_checked, CASE WHEN source_folder = target_folder AND source_name = target_name THEN 'unchanged' ELSE 'copy+archive' END AS change_status,
  CASE WHEN online_applied THEN 'copied+archived' WHEN {_review} THEN 'review-required' WHEN source_folder = target_folder AND source_name = target_name THEN 'unchanged' ELSE 'planned' END AS execution_status, 'apply' AS mode FROM r""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The report of a run over all records, ten of its columns."""
    return plans.report(_placed(spark, d), "copy+archive", False).select("source_name", "target_name", "target_folder", "author", "identifiers", "review", "online_checked", "change_status", "execution_status", "mode")


@query(f"""WITH r AS ({_place}), u AS (SELECT * FROM r WHERE online_applied AND source_name <> '' AND target_name <> '' AND source_name <> target_name)
 SELECT record_id, 1 AS step, 'delete' AS operation, target_folder || '/' || target_name AS source, source_folder || '/' || source_name AS destination FROM u""")
def undo_plan(spark: SparkSession, d: str) -> DataFrame:
    """What takes back the copies of a run."""
    rows = _placed(spark, d).withColumns({"mode": F.lit("apply"), "execution_status": F.col("status"), "operation": F.lit("copy+archive")})
    return plans.undo_plan(rows.select("record_id", "source_name", "target_name", "source_folder", "target_folder", "mode", "execution_status", "operation"), "record_id")


@query(f"""SELECT count(*) AS total, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (review) AS review, count(*) FILTER (s IN ('planned', 'review-required')) AS to_write, count(*) FILTER (s = 'copied') AS written, 0 AS errors
 FROM (SELECT CASE WHEN online_applied THEN 'copied' WHEN {_review} THEN 'review-required' ELSE 'planned' END AS s, {_review} AS review FROM records)""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a run over all records."""
    review = records.needs_review(F.col("confidence"), F.coalesce("review_reasons", F.array().cast("array<string>")))
    status = F.when(F.col("online_applied"), "copied").when(review, "review-required").otherwise("planned")
    return records.run_counts(table(spark, d, "records").select(status.alias("status"), review.alias("review")))


def _manifest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as files, and the done ones among them as a manifest, some of them failed or of another size since."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    files = o.select(name.alias("name"), F.col("o_custkey").alias("size"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime_ns"))
    status = F.when(F.col("o_orderstatus") == "F", " Copied ").when(F.col("o_orderstatus") == "P", "failed").otherwise("renamed")
    held = o.select(F.lower(name).alias("key"), name.alias("source_name"), name.alias("target_name"), status.alias("status"),
                    (F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("size"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime_ns"))
    return files, held


@query("SELECT 'Order ' || o_orderkey AS name FROM orders WHERE NOT (o_orderstatus <> 'P' AND o_orderkey % 5 <> 0)")
def manifest_skip(spark: SparkSession, d: str) -> DataFrame:
    """Files not done before, failed then, or changed since."""
    return plans.skip_processed(*_manifest(spark, d)).select("name")


@query("""SELECT lower('Order ' || o_orderkey) AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'moved' WHEN o_orderstatus = 'F' THEN ' Copied ' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'renamed' END AS status FROM orders""")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The manifest after a run that moved every second order; failed ones are not entered."""
    held = _manifest(spark, d)[1]
    key = F.regexp_extract("source_name", r"(\d+)", 1).cast("long")
    done = held.select("source_name", "target_name", F.when(key % 2 == 0, "moved").otherwise("failed").alias("status"), "size", "mtime_ns")
    return plans.upsert_manifest(held, done).select("key", "status")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'view', 'click') AS failed FROM events),
 f AS (SELECT user_id, event_id, ts, failed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e) WHERE rn = 1
  UNION ALL SELECT user_id, event_id, ts, failed FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS rn FROM f JOIN e ON e.user_id = f.user_id AND f.failed AND e.ts >= f.ts + INTERVAL 60 SECOND) WHERE rn = 1)
 SELECT event_id, user_id FROM f""")
def negative_cache(spark: SparkSession, d: str) -> DataFrame:
    """Requests that go out when good answers are kept and failures for a minute."""
    e = table(spark, d, "events").withColumn("failed", F.col("event_type").isin("error", "view", "click"))
    return incremental.requests_to_fetch(e, "user_id", "ts", "event_id", "failed", 60).select("event_id", "user_id")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS due, 2400000 + (event_id % 5) * 800000 AS delay FROM events),
 s AS (SELECT *, coalesce(sum(delay) OVER (PARTITION BY user_id ORDER BY due, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
 SELECT event_id, CAST(before + max(due - before) OVER (PARTITION BY user_id ORDER BY due, event_id) AS BIGINT) AS starts_at FROM s""")
def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Start of every request when requests of a user wait for the one before and its delay."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.lit(2400000) + (F.col("event_id") % 5) * 800000).alias("delay"))
    return incremental.spaced_requests(e, "user_id", "at", "event_id", "delay").select("event_id", "starts_at")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def incremental_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the events as a stream of files."""
    return incremental.stream_counts(spark, d, "events.parquet", ["event_type"], incremental.new_checkpoint(spark, "stream"))


@query(f"""SELECT o.online_id, {sql_clean("coalesce(title, '')")} AS title, coalesce((SELECT string_agg(x, '|' ORDER BY p) FROM (SELECT {sql_clean('a')} AS x, p FROM (SELECT unnest(o.authors) AS a, generate_subscripts(o.authors, 1) AS p)) WHERE x <> ''), '') AS authors
 FROM online_candidates o WHERE {sql_clean("coalesce(title, '')")} <> ''""")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Hits of search pages made of every online row, read back."""
    c = F.col
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    links = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit('<a href="/autor/1/x">'), esc(a), F.lit("</a>"))), ", ")
    page = F.concat(F.lit('<html><nav>x</nav><a class="authorAllBooks__singleTextTitle" href="/ksiazka/'), c("online_id").cast("string"), F.lit('">'), esc(F.coalesce("title", F.lit(""))),
                    F.lit('</a><div class="authorAllBooks__singleTextAuthor">'), links, F.lit("</div></html>"))
    got = pages.search_results(table(spark, d, "online_candidates").select("online_id", page.alias("html")), "online_id")
    return got.select("online_id", "title", F.array_join("authors", "|").alias("authors"))


@query(f"""SELECT o.online_id, {sql_clean("coalesce(title, '')")} AS title, coalesce((SELECT string_agg(x, '|' ORDER BY p) FROM (SELECT {sql_clean('a')} AS x, p FROM (SELECT unnest(o.authors) AS a, generate_subscripts(o.authors, 1) AS p)) WHERE x <> ''), '') AS authors,
 coalesce((SELECT string_agg(x, '|' ORDER BY p) FROM (SELECT {sql_clean('a')} AS x, p FROM (SELECT unnest(o.identifiers) AS a, generate_subscripts(o.identifiers, 1) AS p)) WHERE x <> ''), '') AS identifiers FROM online_candidates o""")
def provider_answers(spark: SparkSession, d: str) -> DataFrame:
    """Hits of JSON answers made of every online row, read back."""
    item = F.struct(F.struct("title", "authors", F.transform("identifiers", lambda x: F.struct(x.alias("identifier"))).alias("industryIdentifiers")).alias("volumeInfo"))
    bodies = table(spark, d, "online_candidates").select("online_id", F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    got = pages.provider_rows(bodies, "online_id", "google-books")
    return got.select("online_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("identifiers", "|").alias("identifiers"))


def _supported(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a book's local record and the online rows of an equal book number or title."""
    c = F.col
    b, o = table(spark, d, "books"), _found(spark, d)
    near = online.equal_pairs(b, o).join(o.withColumn("pos", c("online_id")), "online_id")
    r = b.select("book_id", F.array_join(t.canonical_authors(F.flatten(F.transform(F.coalesce("creators", F.array()), titles.split_authors))), " & ").alias("author"), F.coalesce("meta_series", F.lit("")).alias("series"), c("meta_volume").alias("volume"), F.coalesce("title", F.lit("")).alias("title"))
    return verify.with_support(verify.pair_up(r, b, near))


@query()
def verify_flags(spark: SparkSession, d: str) -> DataFrame:
    """What the online rows of a book confirm of its record."""
    got = verify.verification(_supported(spark, d))
    return got.select("book_id", "author_confirmed", "title_confirmed", "series_confirmed", "volume_confirmed", F.array_join("providers", "|").alias("providers"))


@query()
def role_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Authors, titles, series and volumes that strong online rows name for each book."""
    return verify.role_evidence(_supported(spark, d))


def _replies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every record, and a reply to it: some fenced, some broken, some without an object."""
    c = F.col
    r = table(spark, d, "records").withColumn("own_title", F.lit(""))
    body = F.to_json(F.struct(F.lit("Kot Jan").alias("author"), F.lit("").alias("series"), F.concat(F.lit("["), (c("record_id") % 9).cast("string"), F.lit(', "5"]')).alias("volume"), F.lit("Nowy dom").alias("title"), (c("record_id") % 101).alias("confidence")))
    kind = c("record_id") % 5
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Oto wynik: "), body)).when(kind == 2, "brak").when(kind == 3, F.concat(body, F.lit("}"))).otherwise(body)
    return r, r.select("record_id", text.alias("response_text"))


@query("""SELECT record_id, CASE WHEN record_id % 5 = 2 THEN 'no object' WHEN record_id % 5 = 3 THEN 'broken object' ELSE '' END AS error,
 CASE WHEN record_id % 5 IN (2, 3) THEN -1 ELSE CAST(record_id % 9 AS INT) END AS major, CASE WHEN record_id % 5 IN (2, 3) THEN -1 ELSE CAST(record_id % 101 AS INT) END AS confidence FROM records""")
def resolver_answers(spark: SparkSession, d: str) -> DataFrame:
    """Replies read and checked."""
    a = arbitration.answers(_replies(spark, d)[1], "record_id")
    bad = F.col("error").isNotNull()
    return a.select("record_id", F.coalesce("error", F.lit("")).alias("error"), F.when(bad, -1).otherwise(F.col("volume.major")).alias("major"), F.when(bad, -1).otherwise(F.col("confidence")).alias("confidence"))


@query(f"""SELECT record_id, CASE WHEN NOT asked THEN '' WHEN record_id % 5 IN (2, 3) THEN 'error' WHEN record_id % 101 < 88 THEN 'below-threshold' ELSE 'applied' END AS state,
 CASE WHEN asked AND record_id % 5 NOT IN (2, 3) AND record_id % 101 >= 88 THEN 'Kot Jan' ELSE coalesce(author, '') END AS author
 FROM (SELECT *, confidence < 75 OR {_review} OR coalesce(list_has_any(review_reasons, ['seria-bez-tomu', 'online-brak-potwierdzenia-autora', 'online-brak-potwierdzenia-serii', 'online-brak-potwierdzenia-tomu', 'online-brak-potwierdzenia-tytulu']), false) OR coalesce(list_has_any(notes, ['existing-format:author-recovered-from-title', 'existing-format:trailing-author-reinterpreted']), false) OR author = 'Nieznany Autor' OR coalesce(title, '') IN ('', 'Bez tytulu') OR coalesce(starts_with(source, 'fallback'), false)
   OR coalesce(len(list_filter(decision_reasons, lambda x: starts_with(x, 'online-verify-') AND ends_with(x, ':no'))) > 0, false) AS asked FROM records)""")
def arbitration_states(spark: SparkSession, d: str) -> DataFrame:
    """Every record after arbitration in the mode that applies good answers."""
    records_, replies = _replies(spark, d)
    got = arbitration.arbitrate(records_, replies, "record_id", "AUTO")
    return got.select("record_id", F.coalesce("arbitration", F.lit("")).alias("state"), F.coalesce("author", F.lit("")).alias("author"))


@query(f"""WITH x AS (SELECT record_id, unnest(regexp_split_to_array(coalesce(genre, '') || ',' || coalesce(source, '') || ';' || coalesce(genre, ''), '[,;|\\n]+')) AS v, generate_subscripts(regexp_split_to_array(coalesce(genre, '') || ',' || coalesce(source, '') || ';' || coalesce(genre, ''), '[,;|\\n]+'), 1) AS p FROM records),
 y AS (SELECT record_id, {sql_clean('v')} AS v, {sql_match('v')} AS k, p FROM x), z AS (SELECT record_id, k, arg_min(v, p) AS v, min(p) AS p FROM y WHERE k <> '' GROUP BY ALL)
 SELECT r.record_id, coalesce((SELECT string_agg(v, '|' ORDER BY p) FROM z WHERE z.record_id = r.record_id), '') AS labels FROM records r""")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every record's genre and source as one text, each once."""
    c = F.col
    text = F.concat(F.coalesce("genre", F.lit("")), F.lit(","), F.coalesce("source", F.lit("")), F.lit(";"), F.coalesce("genre", F.lit("")))
    return table(spark, d, "records").select("record_id", F.array_join(titles.distinct_labels(text), "|").alias("labels")).select("record_id", c("labels"))


@query("""SELECT record_id, CASE WHEN coalesce(series, '') IN ('', 'Standalone') THEN '' ELSE series END AS series,
 CASE WHEN coalesce(series, '') IN ('', 'Standalone') OR volume IS NULL OR (volume.major = 0 AND volume.minor = '00') THEN '' ELSE volume.major || '.' || CASE WHEN length(volume.minor) < 2 THEN lpad(volume.minor, 2, '0') ELSE volume.minor END END AS series_index FROM records""")
def metadata_updates(spark: SparkSession, d: str) -> DataFrame:
    """Series and place in it as they are to be written into every record's file."""
    got = plans.metadata_updates(table(spark, d, "records"), "record_id")
    return got.select("record_id", F.coalesce("series", F.lit("")).alias("series"), F.coalesce("series_index", F.lit("")).alias("series_index"))


@query()
def search_variants(spark: SparkSession, d: str) -> DataFrame:
    """Searches for every book by its own metadata."""
    c = F.col
    b = table(spark, d, "books")
    author = F.array_join(t.canonical_authors(F.flatten(F.transform(F.coalesce("creators", F.array()), titles.split_authors))), " & ")
    r = b.select("book_id", author.alias("author"), c("meta_series").alias("series"), c("meta_volume").alias("volume"), titles.strip_leading_index(c("core")).alias("title"), c("title").alias("own_title"), "core", "creators")
    return searches.search_variants(r, "book_id").select("book_id", "pos", "title", F.array_join("creators", "|").alias("creators"))


@query()
def local_terms(spark: SparkSession, d: str) -> DataFrame:
    """Search terms of the local catalog for every book."""
    return searches.local_terms(table(spark, d, "books"), "book_id")


@query()
def display_names(spark: SparkSession, d: str) -> DataFrame:
    """Given names first, of every merged author's last-first form."""
    rows = table(spark, d, "author_rows").select("row_id", "author_last_first").where("author_last_first is not null")
    return rows.select("row_id", titles.display_name(F.col("author_last_first")).alias("shown"))


@query()
def swapped_titles(spark: SparkSession, d: str) -> DataFrame:
    """Books whose title is a known author and whose creators are none, exchanged."""
    got = authors.swapped_back(table(spark, d, "books"), "book_id", _catalog(spark, d))
    return got.select("book_id", "title", F.array_join(F.coalesce("creators", F.array().cast("array<string>")), "|").alias("creators"), "swapped")


@query("SELECT count(*) AS files, count(m.k) AS matched FROM (SELECT o_orderkey AS k FROM orders) f LEFT JOIN (SELECT o_orderkey AS k FROM orders) m USING (k)")
def manifest_matches(spark: SparkSession, d: str) -> DataFrame:
    """Files of the folder, and those among them the manifest knows by name."""
    files, held = _manifest(spark, d)
    met = files.select(F.lower("name").alias("key")).join(held.select("key", F.lit(1).alias("m")), "key", "left")
    return met.agg(F.count(F.lit(1)).alias("files"), F.count("m").alias("matched"))
