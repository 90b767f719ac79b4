"""Queries of the packed-values operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.operators.packed import CODES, PEOPLE, unpack
from folioforge.runtime import table


def _cells(spark: SparkSession, d: str) -> list[tuple[DataFrame, object]]:
    one = F.lit(1).alias("elem")
    rows = table(spark, d, "author_rows").select(
        F.lit("author_rows.source").alias("field"), F.col("row_id").cast("string").alias("rec_key"), one, F.col("source").alias("cell"))
    books = table(spark, d, "books").select("book_id", F.posexplode("creators").alias("p", "cell")).select(
        F.lit("books.creators").alias("field"), F.col("book_id").alias("rec_key"), (F.col("p") + 1).cast("int").alias("elem"), "cell")
    records = table(spark, d, "records").select(
        F.lit("records.author").alias("field"), F.col("record_id").cast("string").alias("rec_key"), one, F.col("author").alias("cell"))
    return [(rows, CODES), (books.unionByName(records), PEOPLE)]


def _split(spark: SparkSession, d: str, least: int) -> DataFrame:
    parts = [unpack(df, "cell", dialect, ["field", "rec_key", "elem"], least) for df, dialect in _cells(spark, d)]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of each cell that holds two or more."""
    return _split(spark, d, 2).select("field", "rec_key", "elem", "pos", "item")


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    """Values, cells' positions and error flags over all cells, by field."""
    return _split(spark, d, 1).groupBy("field", "flags").agg(
        F.count("*").alias("n_values"), F.max("pos").alias("most_in_a_cell"))


QUERIES = {"p2_found": p2_found, "p2_flags": p2_flags}
