"""Readers of author dumps, author lists and pattern files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.functions.text import last_first

PATTERN_COLUMNS = ["source", "author_raw", "author_first_last", "author_last_first", "title_example", "language",
                   "source_author_id", "source_work_id", "source_url", "confidence", "notes"]


def author_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    """(author_id, name, author_last_first) of tab-separated dump lines of authors; other lines and bad JSON are left out."""
    parts = F.split(F.col(column), "\t", 5)
    body = F.from_json(F.element_at(parts, 5), "name string, personal_name string")
    name = F.trim(F.coalesce(F.when(F.trim(body["name"]) != "", body["name"]), body["personal_name"]))
    rows = lines.where(F.size(parts) == 5).where(F.element_at(parts, 1) == "/type/author")
    return rows.select(F.regexp_extract(F.element_at(parts, 2), r"([^/]+)$", 1).alias("author_id"), name.alias("name")).where("name <> ''").withColumn(
        "author_last_first", last_first(F.col("name")))


def author_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Author pattern file: quoted CSV with a header and possibly a byte-order mark."""
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in PATTERN_COLUMNS), quote='"', escape='"', multiLine=True)
