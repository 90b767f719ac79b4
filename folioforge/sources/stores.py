"""Tables kept from run to run: merged authors, arbitration log, answer cache, catalog snapshot, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioforge.operators.authors import Catalog

#: Raised when a stored catalog's tables change their meaning.
CATALOG_VERSION = 1
_PARTS = ("aliases", "initials", "first_words", "last_words")


def write_authors(merged: DataFrame, loose: DataFrame, path: str) -> None:
    """Merged authors, then those without a key, as CSV in the four columns; a new table takes the old one's place when it is complete."""
    cols = ["source", "author_raw", "author_first_last", "author_last_first"]
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols]
    both = merged.select(*texts).unionByName(loose.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in loose.columns else F.lit("").alias(c) for c in cols]))
    both.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_log(rows: DataFrame, path: str) -> None:
    """Arbitration log, one JSON object a line, NULL fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report as it was written; columns that an undo needs must be there."""
    rows = spark.read.csv(path, sep=";", header=True, quote='"', escape='"', encoding="UTF-8", multiLine=True)
    first = {c: c.lstrip("\ufeff") for c in rows.columns}
    rows = rows.toDF(*first.values())
    missing = {"source_name", "target_name", "mode", "execution_status"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing in the log: {', '.join(sorted(missing))}")
    return rows


def cache_key(kind: Column, url: Column) -> Column:
    return F.concat(kind, F.lit(":"), url)


def is_host(url: Column, host: str) -> Column:
    """Whether a URL is of the host or one below it."""
    own = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return (own == host) | own.endswith(f".{host}")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(kind, url, body) of a cache of one JSON object per key; answers that are plain page texts are left out."""
    lines = spark.read.text(path, wholetext=True)
    entries = lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "body"))
    rows = entries.select(F.split("k", ":", 2)[0].alias("kind"), F.split("k", ":", 2)[1].alias("url"), "body")
    return rows.where("body is null OR kind = 'json'")


def update_cache(old: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache after a run: fetched answers replace those of the same kind and URL."""
    return old.join(fetched.select("kind", "url"), ["kind", "url"], "left_anti").unionByName(fetched)


def save_catalog(known: Catalog, path: str, source: str) -> None:
    """The catalog's tables below a folder, and last a note of version and source, which makes them valid."""
    for name in _PARTS:
        getattr(known, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = known.aliases.sparkSession
    spark.createDataFrame([(json.dumps({"version": CATALOG_VERSION, "source": source}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def load_catalog(spark: SparkSession, path: str, source: str) -> Catalog | None:
    """The stored catalog if it is there, of this version and of the same source; else None."""
    jvm, place = spark.sparkContext._jvm, f"{path}/note"
    at = jvm.org.apache.hadoop.fs.Path(place)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    note = json.loads(spark.read.text(place).first()[0])
    if note != {"version": CATALOG_VERSION, "source": source}:
        return None
    return Catalog(*[spark.read.parquet(f"{path}/{name}") for name in _PARTS])
