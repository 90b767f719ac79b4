"""Records: quality, review, names, orders, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import NO_TITLE, STANDALONE, UNKNOWN_AUTHOR, filename_stem, format_volume, sanitize_component

REVIEW_BELOW = 65
# Reasons that always ask for a review.
BLOCKING = ["online-niejednoznaczne", "online-best-effort", "nieznany-autor", "brak-tytulu", "fallback", "szum-w-tytule", "artefakt-zrodla"]


def finalize(author: Column, title: Column, series: Column, volume: Column, source: Column, from_core: Column, errors: Column, base: Column, earlier: Column) -> Column:
    """struct<confidence, reasons> after the penalties, clamped to 0..100; reasons follow the ``earlier`` ones, each once."""
    no_volume = volume.isNull() | ((volume["major"] == 0) & (volume["minor"] == "00"))
    rules = [
        (author == UNKNOWN_AUTHOR, 25, "nieznany-autor"),
        ((F.coalesce(title, F.lit("")) == "") | (title == NO_TITLE), 30, "brak-tytulu"),
        (from_core, 5, "tytul-z-nazwy-pliku"),
        (source == "fallback", 15, "fallback"),
        ((F.coalesce(series, F.lit("")) != "") & (series != STANDALONE) & no_volume, 12, "seria-bez-tomu"),
        (F.coalesce(F.size(errors), F.lit(0)) > 0, 10, "blad-odczytu-metadanych"),
        (title.rlike(r"(?i)\b[0-9a-f]{12,}\b"), 20, "szum-w-tytule"),
        (title.rlike(r"(?i)\banna.?s archive\b"), 20, "artefakt-zrodla"),
    ]
    lost = sum((F.when(c, p).otherwise(0) for c, p, _ in rules), F.lit(0))
    told = F.concat(F.coalesce(earlier, F.array().cast("array<string>")), F.array_compact(F.array(*[F.when(c, r) for c, _, r in rules])))
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), base - lost)).alias("confidence"), F.array_distinct(told).alias("reasons"))


def needs_review(confidence: Column, reasons: Column, blocking: list[str] | None = None) -> Column:
    """Low confidence or a blocking reason."""
    held = F.array(*map(F.lit, blocking or BLOCKING))
    return (confidence < REVIEW_BELOW) | F.coalesce(F.arrays_overlap(reasons, held), F.lit(False))


def output_name(author: Column, series: Column, volume: Column, title: Column) -> Column:
    """Sanitised file stem of a record."""
    return sanitize_component(filename_stem(author, series, format_volume(volume), title))


def natural_key(c: Column) -> Column:
    """Sort key in which numbers of any length stand in order of their value, so that 2 comes before 10."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 9, "0"), bare(p))).otherwise(p)), "")


def replace_source(old: DataFrame, new: DataFrame, column: str, source: str) -> DataFrame:
    """Rows of other sources kept, this source's rows replaced."""
    return old.where(F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))) != source).unionByName(new)


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Values of each group in order of first occurrence, joined by a bar."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("at"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]), "|").alias("seen"))


def run_counts(rows: DataFrame) -> DataFrame:
    """Counters of a run from the status of each file and its need of review."""
    c = F.col
    of = lambda *s: F.count_if(c("status").isin(*s))
    return rows.agg(F.count(F.lit(1)).alias("total"), of("skipped").alias("skipped"), F.count_if(c("review")).alias("review"), of("planned", "review-required").alias("to_write"),
                    of("renamed", "copied", "copied+archived", "moved").alias("written"), F.count_if(c("status").startswith("failed")).alias("errors"))
