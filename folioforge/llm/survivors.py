"""Best representative of each duplicate group, field by field.

Fields are unpivoted to long rows, votes are gathered per normalised value, the
winner of each field is taken by ``max_by``, and the record
is pivoted back. Every aggregation has a map-side part, so a group holding a
third of all rows costs one partial row per task.

Defined results: a value without any letter counts as missing and never wins; a
field whose values are all missing gives NULL (``survivors``) or no row
(``ranked_values``). NULL ranks come last. Ties end at the smallest row id.
Rows without a key are left out. Empty input gives an empty result; columns
with other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LETTER = r"\p{L}"


def unpivot_fields(rows: DataFrame, key: str, row_id: str, fields: list[str], extra: dict[str, Column]) -> DataFrame:
    """(key, row_id, extra..., field, value), one row per field of each keyed row."""
    return (
        rows.where((F.col(key) != "") & F.col(key).isNotNull())
        .select(F.col(key).alias("_key"), F.col(row_id).alias("_row"), *[c.alias(n) for n, c in extra.items()],
                F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in fields])).alias("_fv"))
        .select("_key", "_row", *extra, F.col("_fv.f").alias("_field"), F.col("_fv.v").alias("_value"))
    )


def ranked_values(rows: DataFrame, key: str, row_id: str, fields: list[str], order: list[Column], least: int = 2) -> DataFrame:
    """(key, field, row_id) of the row that wins each field by ``order``.

    ``order`` is a list of integer expressions over ``rows``, smallest first; row ids
    end ties. Every row votes once for the value it holds, with a vote of as many
    places as there are expressions, so that no number of lesser votes outweighs a
    greater one; the winner of each field is taken by ``max_by`` over the votes, which
    gives one record per key, and the records are unpivoted. Only groups of at least
    ``least`` rows count. Texts never move, only row ids and votes.
    """
    vote = F.struct(*[(-c).alias(f"v{i}") for i, c in enumerate(order)], (-F.col(row_id)).alias("first"))
    held = rows.where((F.col(key) != "") & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(row_id).alias("_row"), vote.alias("_vote"), *[F.col(f).rlike(LETTER).alias(f"_has{i}") for i, f in enumerate(fields)])
    # max_by passes over NULL votes: a field is won among the rows that hold a value
    won = [F.max_by("_row", F.when(F.col(f"_has{i}"), F.col("_vote"))).alias(f"_w{i}") for i in range(len(fields))]
    record = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *won).where(F.col("_n") >= least)
    long = record.select(F.col("_key").alias(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_w{i}").alias(row_id)) for i, f in enumerate(fields)])).alias("_f"))
    return long.select(key, "_f.*").where(F.col(row_id).isNotNull())


def survivors(rows: DataFrame, key: str, row_id: str, fields: list[str], trust: Column, seen_at: str,
              half_life_days: float = 365.0, least: int = 1) -> DataFrame:
    """One built record per key: the value with most trust-times-recency votes per field.

    Votes of spellings that differ only in case and blanks are summed; the spelling
    shown is that of the smallest row id. A NULL time votes with one half-life more
    than the oldest. ``trust`` is a non-negative expression over ``rows``.
    """
    newest = F.max(F.col(seen_at).cast("double"))
    span = rows.agg(newest.alias("hi"), F.min(F.col(seen_at).cast("double")).alias("lo")).first()
    hi, lo = (span["hi"] or 0.0), (span["lo"] or 0.0)
    half = half_life_days * 86400.0
    age = F.coalesce(F.lit(hi) - F.col(seen_at).cast("double"), F.lit(hi - lo + half))
    vote = F.coalesce(trust, F.lit(0.0)) * F.pow(F.lit(0.5), age / F.lit(half))
    long = unpivot_fields(rows, key, row_id, fields, {"_vote": vote}).where(F.col("_value").rlike(LETTER))
    norm = F.trim(F.regexp_replace(F.lower("_value"), r"(?U)\s+", " "))
    voted = long.groupBy("_key", "_field", norm.alias("_norm")).agg(
        F.sum("_vote").alias("_votes"), F.min(F.struct("_row", "_value")).alias("_shown"), F.count(F.lit(1)).alias("_n"))
    won = voted.groupBy("_key", "_field").agg(
        F.max_by("_shown", F.struct(F.round("_votes", 9), -F.col("_shown._row"))).alias("_w"), F.sum("_n").alias("_n"))
    sizes = rows.where(F.col(key) != "").groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n_rows"))
    wide = won.groupBy("_key").pivot("_field", fields).agg(F.first("_w._value"))
    return sizes.where(F.col("n_rows") >= least).join(wide, "_key", "left").withColumnRenamed("_key", key)
