"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.functions.folding import author_key, match_key
from folioforge.llm.canonical_list import map_to_list
from folioforge.llm.containers import fill_containers
from folioforge.llm.layout_copies import layout_copies
from folioforge.llm.linkage import blocked, link_works, matches
from folioforge.llm.lookalikes import SUSPECT, clean_cells, mapped
from folioforge.llm.mixture import draw_mixture, mixture_shares
from folioforge.llm.name_variants import link_names
from folioforge.llm.quality import page_quality
from folioforge.llm.survivors import ranked_values, survivors
from folioforge.llm.tokens import TOKENIZER, token_counts
from folioforge.operators import online
from folioforge.operators.packed import PEOPLE, items_of
from folioforge.runtime import cut, table

NAME_FIELDS = ["author_raw", "author_first_last", "author_last_first"]


def author_names(spark: SparkSession, d: str) -> DataFrame:
    """(key, name): each author key with one folded spelling whose words make it up.

    Of a key the fields decide in their order, then the spelling. Only distinct
    values are folded, and a later field only for keys that no earlier one fits.
    """
    rows = table(spark, d, "author_rows").where("group_key <> ''").select(F.col("group_key").alias("key"), "author_first_last", "author_last_first", "author_raw")
    cells = table(spark, d, "books").select(F.explode("creators").alias("cell")).where("cell is not null").distinct()
    single = cells.where(F.size(items_of(F.col("cell"), PEOPLE)) == 1)
    held = single.select(author_key(F.col("cell")).alias("key"), "cell").where("key <> ''")
    values = _values(rows, ["author_first_last"])
    first = cut(_fitting(values), "names-that-fit")
    open_keys = cut(values.select("key").distinct().join(first, "key", "left_anti"), "keys-without-name")
    later = _fitting(_values(rows.join(open_keys, "key", "left_semi"), ["author_last_first", "author_raw"]))
    cells = _fitting(_values(held, ["cell"]))
    every = first.unionByName(later).select("key", F.lit(0).alias("i"), "name").unionByName(cells.select("key", F.lit(1).alias("i"), "name"))
    bare = open_keys.union(held.select("key").distinct()).select("key", F.lit(2).alias("i"), F.col("key").alias("name"))
    return every.unionByName(bare).groupBy("key").agg(F.min(F.struct("i", "name")).alias("best")).select("key", "best.name")


def _values(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct (key, i, v) of the fields, NULL too. Written once: the filter on
    the folded value would else move before the distinct and fold every row."""
    values = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("v")) for i, f in enumerate(fields)])).alias("f"))
    return cut(values.select("key", "f.i", "f.v").distinct(), "name-values")


def _fitting(values: DataFrame) -> DataFrame:
    """(key, name): the folded value of each key that is the key but for its blanks, of the first field that has one, the smallest."""
    c = F.col("v")
    # two plans: the mapping of look-alikes is far dearer than the folding
    plain = values.where(~c.rlike(SUSPECT)).unionByName(values.where(c.rlike(SUSPECT)).withColumn("v", mapped(c)))
    folded = plain.select("key", "i", match_key(c).alias("name"))
    fits = folded.where(F.translate("name", " ", "") == F.col("key"))
    return fits.groupBy("key").agg(F.min(F.struct("i", "name")).alias("best")).select("key", "best.name")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of author keys that stand for the same author."""
    keys = cut(author_names(spark, d).withColumn("form", F.array_join(F.array_sort(F.split("name", " ")), " ")), "author-keys")
    # numbers in a fixed order; small ones travel in less room than hashes
    forms = keys.groupBy("form").agg(F.min("name").alias("name")).sortWithinPartitions("form").withColumn("id", F.monotonically_increasing_id())
    forms = cut(forms, "forms")
    authors = link_names(forms.select("id", "name"))
    tied = keys.join(forms.select("form", "id"), "form").join(authors, "id", "left").select("key", F.coalesce("author", "id").alias("author"))
    tied = cut(tied, "authors")
    return tied.select(F.col("key").alias("key_a"), "author").join(tied.select(F.col("key").alias("key_b"), "author"), "author").where(
        "key_a < key_b").select("key_a", "key_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The row whose value survives, per group key and name field."""
    conf = F.col("confidence_rank")
    order = [F.coalesce(F.col("source_rank"), F.lit(2**31 - 1)), conf.isNull().cast("int"), -conf.cast("long"),
             F.col("author_len").isNull().cast("int"), -F.col("author_len").cast("long")]
    rows = table(spark, d, "author_rows")
    return ranked_values(rows, "group_key", "row_id", NAME_FIELDS, order).select("group_key", "field", "row_id")


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One built author per group key, by trust and recency votes."""
    rows = table(spark, d, "author_rows")
    trust = 1.0 / (1.0 + F.coalesce(F.col("source_rank"), F.lit(99))) * (2.0 + F.coalesce(F.col("confidence_rank"), F.lit(-1)))
    return survivors(rows, "group_key", "row_id", NAME_FIELDS, trust, "seen_at")


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return layout_copies(table(spark, d, "author_rows"), "group_key", "row_id", "author_raw")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each copy with the row kept in its place."""
    return _copies(spark, d).where("row_id <> kept_row_id").select("kept_row_id", "row_id")


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per set of copies with the number of its copies."""
    return _copies(spark, d).where("row_id = kept_row_id").select("kept_row_id", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each free-entered subject or genre with its entry, 0 if there is none."""
    books = table(spark, d, "books").select(F.lit("books.subjects").alias("field"), F.col("book_id").alias("rec_key"), F.posexplode("subjects").alias("p", "cell"))
    books = books.select("field", "rec_key", (F.col("p") + 1).cast("int").alias("pos"), "cell")
    records = table(spark, d, "records").select(
        F.lit("records.genre").alias("field"), F.col("record_id").cast("string").alias("rec_key"), F.lit(1).alias("pos"), F.col("genre").alias("cell"))
    out = map_to_list(books.unionByName(records), table(spark, d, "subject_list"))
    return out.select("field", "rec_key", "pos", "entry_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each cell with look-alike or hidden signs, in its ordinary form."""
    records = table(spark, d, "records").select(F.col("record_id").cast("string").alias("rec_key"), F.explode(
        F.array(F.struct(F.lit("records.title").alias("f"), F.col("title").alias("v")), F.struct(F.lit("records.author").alias("f"), F.col("author").alias("v")))).alias("c"))
    rows = table(spark, d, "author_rows").select(F.lit("author_rows.author_first_last").alias("field"), F.col("row_id").cast("string").alias("rec_key"), F.col("author_first_last").alias("cell"))
    cells = records.select(F.col("c.f").alias("field"), "rec_key", F.col("c.v").alias("cell")).unionByName(rows)
    return clean_cells(cells).select("field", "rec_key", "clean_text")


def _works(spark: SparkSession, d: str) -> DataFrame:
    return link_works(table(spark, d, "books"), table(spark, d, "candidates"), table(spark, d, "online_candidates"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Book rows and online rows of the same work."""
    return matches(_works(spark, d)).select("book_id", "online_id")


def p7_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair with its votes and confidence."""
    return _works(spark, d)


def online_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranking ladder over all candidate pairs of book and online rows and those of an equal book number or title."""
    books, found = table(spark, d, "books"), table(spark, d, "online_candidates")
    near = blocked(books, table(spark, d, "candidates"), found)[2]
    pairs = cut(near.union(online.equal_pairs(books, found)).distinct(), "rank-pairs")
    return online.rank_pairs(pairs, books, found)


def p8_containers(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Container and place of every document, for each capacity."""
    sized = cut(token_counts(table(spark, d, "documents"), "doc_id", "text", path=tokenizer), "tokens")
    return fill_containers(sized, table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, their fill and the fewest that could do, by capacity."""
    return p8_containers(spark, d).groupBy("container", "capacity").agg(
        F.countDistinct("bin").alias("containers"), F.sum("tokens").alias("tokens")).select(
        "container", "capacity", "containers", "tokens",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))


def _mix(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sized = cut(token_counts(table(spark, d, "documents"), "doc_id", "text", ["source"], tokenizer), "tokens")
    return draw_mixture(sized, table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture with their repetitions, in random order."""
    return _mix(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture_shares(_mix(spark, d), table(spark, d, "mix_targets"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return page_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are mainly lists, tables or junk."""
    return _pages(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def p10_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance from prose and each statistic's share of it, every page."""
    return _pages(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_survivors, p4_found, p4_collapsed, p5_found, p6_found, p7_found, p7_confidence, online_rank, p8_containers, p8_fill, p9_mixture, p9_shares, p10_found, p10_distance)}

def _survivors_sql() -> str:
    """Votes of trust times decay, summed per value that differs in case and blanks only."""
    long = " UNION ALL ".join(f"SELECT group_key, row_id, vote, '{f}' AS field, {f} AS value FROM v" for f in NAME_FIELDS)
    shown = ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in NAME_FIELDS)
    return f"""
        WITH t AS (SELECT max(epoch_us(seen_at)) / 1e6 AS hi, min(epoch_us(seen_at)) / 1e6 AS lo FROM author_rows),
        v AS (SELECT group_key, row_id, {', '.join(NAME_FIELDS)}, (1.0::DOUBLE / (1.0 + coalesce(source_rank, 99))) * (2.0 + coalesce(confidence_rank, -1))
                * pow(0.5::DOUBLE, coalesce(hi - epoch_us(seen_at) / 1e6, hi - lo + 31536000.0) / 31536000.0) AS vote FROM author_rows, t WHERE group_key <> ''),
        n AS (SELECT *, trim(regexp_replace(lower(value), '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ') AS norm FROM ({long}) WHERE regexp_matches(value, '\\pL')),
        s AS (SELECT group_key, field, norm, sum(vote) AS votes, min(row_id) AS first, arg_min(value, row_id) AS value FROM n GROUP BY ALL),
        w AS (SELECT group_key, field, value FROM s QUALIFY row_number() OVER (PARTITION BY group_key, field ORDER BY round(votes, 9) DESC, first) = 1),
        g AS (SELECT group_key, count(*) AS n_rows FROM author_rows WHERE group_key <> '' GROUP BY group_key)
        SELECT g.group_key, n_rows, {shown} FROM g LEFT JOIN w ON w.group_key = g.group_key GROUP BY g.group_key, n_rows"""


ORACLES = {
    "p3_found": " UNION ALL ".join(f"""
        SELECT group_key, '{f}' AS field, row_id FROM (
          SELECT group_key, row_id, row_number() OVER (PARTITION BY group_key ORDER BY source_rank NULLS LAST,
            confidence_rank DESC NULLS LAST, author_len DESC NULLS LAST, row_id) AS rn
          FROM author_rows WHERE regexp_matches({f}, '\\pL') AND group_key IN (
            SELECT group_key FROM author_rows WHERE group_key <> '' GROUP BY 1 HAVING count(*) >= 2)) WHERE rn = 1""" for f in NAME_FIELDS),
    "p3_survivors": _survivors_sql(),
    "p4_found": """
        WITH c AS (SELECT row_id, group_key, array_to_string(list_sort(regexp_extract_all(lower(author_raw), '[\\pL\\p{Nd}]+')), ' ') AS w
                   FROM author_rows WHERE group_key <> '' AND regexp_matches(author_raw, '\\pL')),
        k AS (SELECT row_id, min(row_id) OVER (PARTITION BY group_key, w) AS kept_row_id FROM c)
        SELECT kept_row_id, row_id FROM k WHERE row_id <> kept_row_id""",
    "p4_collapsed": """
        WITH c AS (SELECT row_id, group_key, array_to_string(list_sort(regexp_extract_all(lower(author_raw), '[\\pL\\p{Nd}]+')), ' ') AS w
                   FROM author_rows WHERE group_key <> '' AND regexp_matches(author_raw, '\\pL'))
        SELECT min(row_id) AS kept_row_id, count(*) AS copies FROM c GROUP BY group_key, w""",
}
