"""Queries of the resolution pipeline's own operators, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.functions import text as t
from folioforge.functions.folding import fold_tables
from folioforge.operators import authors, online, records
from folioforge.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_src, _dst, _many = fold_tables()


def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_fold(x: str) -> str:
    """Folding in DuckDB: marks dropped, growing signs of these tables replaced, the rest translated."""
    out = f"regexp_replace({x}, '\\p{{M}}+', '', 'g')"
    for sign in "½ﬁﬂ№":
        out = f"replace({out}, '{sign}', '{_q(_many[sign])}')"
    return f"translate({out}, '{_q(_src)}', '{_q(_dst)}')"


def sql_clean(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in ((r"(\pL)[-_](\d{1,3})\.(\pL)", r"\1 \2 \3"), (r"(\pL)[-_](\d{1,3})([-_:])", r"\1 \2 \3"), (r"(\d{1,3})\.(\pL)", r"\1 \2")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"trim(regexp_replace(replace({out}, '_', ' '), '[\\s\\p{{Z}}]+', ' ', 'g'), ' .-')"


def sql_key(x: str) -> str:
    return f"regexp_replace(lower({sql_fold(sql_clean(x))}), '[^a-z0-9]+', '', 'g')"


def sql_match(x: str) -> str:
    return f"trim(regexp_replace(lower({sql_fold(sql_clean(x))}), '[^a-z0-9]+', ' ', 'g'))"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add


@query(f"SELECT record_id, {sql_clean('title')} AS clean_title FROM records")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("record_id", t.clean(F.col("title")).alias("clean_title"))


@query(f"SELECT record_id, {sql_match('title')} AS title_key, {sql_key('author')} AS author_key FROM records")
def match_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("record_id", t.match_text(F.col("title")).alias("title_key"), t.key_of(F.col("author")).alias("author_key"))


@query(f"SELECT {sql_key('p_name')} AS name_key, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1")
def author_key_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(t.key_of(F.col("p_name")).alias("name_key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("""SELECT record_id, CASE WHEN volume IS NULL OR (volume.major = 0 AND coalesce(TRY_CAST(volume.minor AS INT), 0) = 0) THEN 'Tom 00.00'
  ELSE 'Tom ' || CASE WHEN volume.major < 10 THEN '0' ELSE '' END || volume.major || '.' || CASE WHEN length(volume.minor) < 2 THEN '0' ELSE '' END || coalesce(volume.minor, '00') END AS label FROM records""")
def volume_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("record_id", t.format_volume(F.col("volume")).alias("label"))


@query("""WITH x AS (SELECT book_id, unnest(identifiers) AS v, generate_subscripts(identifiers, 1) AS i FROM books),
 f AS (SELECT book_id, i, unnest(regexp_extract_all(v, '(97[89][0-9]{10}|[0-9]{9}[0-9Xx])', 1)) AS n FROM x),
 g AS (SELECT book_id, upper(n) AS n, min(i) AS i FROM f GROUP BY ALL)
 SELECT b.book_id, coalesce((SELECT string_agg(n, '|' ORDER BY i, n) FROM g WHERE g.book_id = b.book_id), '') AS isbns FROM books b""")
def isbn_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "books").select("book_id", F.array_join(t.extract_isbns(F.coalesce("identifiers", F.array())), "|").alias("isbns"))




@query(f"SELECT c_custkey, 'van ' || c_name || ' ' || c_mktsegment AS turned, c_mktsegment || ' ' || c_name AS swapped FROM customer")
def last_first_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", t.last_first(F.concat_ws(" ", "c_mktsegment", F.lit("van"), "c_name")).alias("turned"),
                    t.last_first(F.concat(F.col("c_mktsegment"), F.lit(", "), F.col("c_name"))).alias("swapped"))


@query("SELECT p_partkey, regexp_replace(p_name || '- ' || p_type, '[<>:\"/\\\\|?*]', '-', 'g') AS safe, p_brand || ' - ' || p_name || ' - Tom 01.00 - ' || p_type AS stem FROM part")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", t.sanitize_component(F.concat(F.col("p_name"), F.lit(": "), F.col("p_type"))).alias("safe"),
                    t.filename_stem(F.col("p_brand"), F.col("p_name"), F.lit("Tom 01.00"), F.col("p_type")).alias("stem"))


@query("SELECT p_partkey, p_name AS title, p_brand AS genre FROM part")
def genre_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.genre_suffix(F.concat(F.col("p_name"), F.lit(" ["), F.col("p_brand"), F.lit("]"))).alias("g")).select("p_partkey", "g.title", "g.genre")


@query("SELECT n_nationkey, n_name || ' & ' || n_regionkey AS plain FROM nation")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_nationkey", t.strip_html(F.concat(F.lit("<b>"), F.col("n_name"), F.lit("</b> &amp; <i>"), F.col("n_regionkey").cast("string"), F.lit("</i>"))).alias("plain"))


@query()
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Block-matching similarity of each record's title to its book's title."""
    r = table(spark, d, "records").select("record_id", "path", F.col("title").alias("r"))
    b = table(spark, d, "books").select("path", F.col("title").alias("b"))
    return r.join(b, "path").select("record_id", F.round(t.similarity(F.col("r"), F.col("b")), 6).alias("score"))


@query("SELECT row_id, author_first_last, author_last_first, author_raw FROM author_rows WHERE coalesce(group_key, '') = ''")
def author_ungrouped(spark: SparkSession, d: str) -> DataFrame:
    return authors.ungrouped(table(spark, d, "author_rows"))


@query("SELECT online_id, CASE WHEN score >= 420 THEN 78 WHEN score >= 320 THEN 72 WHEN score >= 250 THEN 66 WHEN score >= 180 THEN 60 ELSE 54 END AS confidence FROM online_candidates")
def online_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "online_candidates").select("online_id", online.confidence_of(F.col("score")).alias("confidence"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL)
 SELECT user_id, string_agg(event_type, '|' ORDER BY first_at) AS seen FROM f GROUP BY user_id""")
def first_seen_types(spark: SparkSession, d: str) -> DataFrame:
    return records.ordered_distinct(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT s_suppkey, 'supplier ' || lpad(CAST(length(CAST(s_suppkey AS VARCHAR)) AS VARCHAR), 9, '0') || s_suppkey AS sort_key FROM supplier")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", records.natural_key(F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"))).alias("sort_key")).orderBy("sort_key")


@query("""SELECT doc_id, source FROM documents WHERE lower(trim(coalesce(source, ''))) <> 'dziennik-lumenta' UNION ALL SELECT 0, 'dziennik-lumenta'""")
def source_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return records.replace_source(docs, spark.range(1).select(F.col("id").alias("doc_id"), F.lit("dziennik-lumenta").alias("source")), "source", "dziennik-lumenta")

