"""Arbitration of doubtful records by an outside resolver: requests out, texts in, checked answers applied."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioforge.functions.text import NO_TITLE, STANDALONE, UNKNOWN_AUTHOR, clean, clean_series, key_of, let, match_text, parse_volume
from folioforge.operators.records import needs_review

# Confidence below which a record is sent, from which an answer is applied; reasons and notes that ask for it.
ASK_BELOW, APPLY_FROM = 75, 88
MODES = ("OFF", "REVIEW", "ASSIST", "AUTO")
STRUCTURAL_REASONS = ["online-niejednoznaczne", "online-best-effort", "nieznany-autor", "brak-tytulu", "fallback", "seria-bez-tomu", "szum-w-tytule", "artefakt-zrodla",
                      "online-brak-potwierdzenia-autora", "online-brak-potwierdzenia-serii", "online-brak-potwierdzenia-tomu", "online-brak-potwierdzenia-tytulu"]
STRUCTURAL_NOTES = ["existing-format:author-recovered-from-title", "existing-format:trailing-author-reinterpreted"]
ANSWER = "author string, series string, volume string, title string, confidence string, decision_reasons array<string>"


def signals(records: DataFrame, key: str, own_title: str = "own_title") -> DataFrame:
    """(key, signals) of the records that ask for arbitration: why, in a fixed order, each once."""
    c = F.col
    reasons, decisions = F.coalesce("review_reasons", F.array().cast("array<string>")), F.coalesce("decision_reasons", F.array().cast("array<string>"))
    title, own = F.coalesce("title", F.lit("")), F.coalesce(own_title, F.lit(""))
    found = F.concat(
        F.array(F.when(c("confidence") < ASK_BELOW, F.concat(F.lit("low-confidence:"), c("confidence").cast("string"))), F.when(needs_review(c("confidence"), reasons), "needs-review")),
        F.transform(F.filter(reasons, lambda r: r.isin(STRUCTURAL_REASONS)), lambda r: F.concat(F.lit("review:"), r)),
        F.transform(F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda r: r.isin(STRUCTURAL_NOTES)), lambda r: F.concat(F.lit("note:"), r)),
        F.filter(decisions, lambda r: r.startswith("online-verify-") & r.endswith(":no")),
        F.array(F.when(c("author") == UNKNOWN_AUTHOR, "unknown-author"), F.when(title.isin("", NO_TITLE), "missing-title"), F.when(F.coalesce("source", F.lit("")).startswith("fallback"), "fallback-source"),
                F.when((clean(own) != "") & (clean(title) != "") & (match_text(own) != match_text(title)), "meta-title-differs")))
    return records.select(key, F.array_distinct(F.array_compact(found)).alias("signals")).where(F.size("signals") > 0)


def requests(records: DataFrame, key: str, own_title: str = "own_title") -> DataFrame:
    """(key, payload): the JSON request of each record that asks for arbitration."""
    body = F.struct("author", "series", "volume", "title", "genre", "source", "confidence", "signals")
    return records.join(signals(records, key, own_title), key).select(key, F.to_json(body).alias("payload"))


def json_object(text: Column) -> Column:
    """The outermost braces of an answer, fences and words around them dropped; NULL without any."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))


@F.arrow_udf(T.BooleanType())
def _is_object(texts: pa.Array) -> pa.Array:
    """Whether a text is one JSON object and nothing else; the JVM's reader stops at the end of the first."""
    def check(x: str | None) -> bool:
        try:
            return isinstance(json.loads(x or ""), dict)
        except ValueError:
            return False

    return pa.array([check(x) for x in texts.to_pylist()], pa.bool_())


def _listed_volume(v: Column) -> Column:
    """A volume told as ``[2, "5"]``, a number or a text; the part after the point is cut to two digits."""
    number = F.regexp_extract(v, r'^\[\s*"?(\d{1,9})"?', 1)
    minor = F.regexp_extract(v, r'^\[[^,\]]*,\s*"?(\d*)"?\s*\]$', 1)
    two = F.substring(F.when(F.length(minor) < 2, F.lpad(minor, 2, "0")).otherwise(minor), 1, 2)
    return F.when(v.startswith("["), F.when(number != "", F.struct(number.cast("int").alias("major"), two.alias("minor")))).otherwise(parse_volume(v))


def answers(responses: DataFrame, key: str, text: str = "response_text") -> DataFrame:
    """(key, author, series, volume, title, confidence, decision_reasons, error) of every response.

    A text without an object, broken JSON, a volume or confidence that is none and
    names without a letter leave an ``error``; its other fields are then not to be used.
    """
    c = F.col
    parsed = responses.select(key, json_object(c(text)).alias("blob")).select(key, "blob", F.from_json("blob", ANSWER, {"mode": "PERMISSIVE"}).alias("j"), _is_object("blob").alias("valid"))
    told = F.coalesce("j.volume", F.lit(""))
    rows = parsed.select(
        key, c("blob").isNull().alias("none"), c("valid"), clean(c("j.author")).alias("author"), let(clean_series(c("j.series")), lambda s: F.when(s == "", STANDALONE).otherwise(s)).alias("series"), told.alias("told"),
        _listed_volume(told).alias("volume"), clean(c("j.title")).alias("title"), F.coalesce("j.confidence", F.lit("0")).alias("shown"),
        F.filter(F.transform(F.coalesce("j.decision_reasons", F.array().cast("array<string>")), clean), lambda x: x != "").alias("decision_reasons"))
    number = c("shown").try_cast("double")
    letter = lambda x: c(x).rlike(r"\p{L}")
    error = (
        F.when(c("none"), "no object").when(~F.coalesce("valid", F.lit(False)), "broken object").when(~c("told").isin("", "[]") & c("volume").isNull(), "volume").when(number.isNull(), "confidence")
        .when(~letter("author"), "author").when(~letter("title"), "title").when((c("series") != STANDALONE) & ~letter("series"), "series").when(key_of(c("author")) == key_of(c("title")), "title equals author"))
    return rows.select(key, "author", "series", "volume", "title", F.greatest(F.lit(0), F.least(F.lit(100), number.cast("int"))).alias("confidence"), "decision_reasons", error.alias("error"))


def arbitrate(records: DataFrame, responses: DataFrame, key: str, mode: str, own_title: str = "own_title") -> DataFrame:
    """``records`` after arbitration, with ``arbitration``: NULL, queued, error, suggested, below-threshold or applied.

    OFF asks nothing; REVIEW only queues; ASSIST suggests; AUTO applies answers of
    enough confidence and takes back the review reasons they settle. One response per key.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    c = F.col
    if mode == "OFF":
        return records.withColumn("arbitration", F.lit(None).cast("string"))
    asked = records.join(signals(records, key, own_title).select(key, F.lit(True).alias("_asked")), key, "left")
    if mode == "REVIEW":
        return asked.withColumn("arbitration", F.when(c("_asked"), "queued")).drop("_asked")
    fields = ("author", "series", "volume", "title", "confidence")
    a = answers(responses, key).select(key, *[c(f).alias(f"_{f}") for f in fields], c("decision_reasons").alias("_reasons"), "error", F.lit(True).alias("_there"))
    met = asked.join(a, key, "left")
    state = F.when(c("_asked").isNull(), None).when(c("_there").isNull() | c("error").isNotNull(), "error").otherwise("suggested" if mode == "ASSIST" else F.when(c("_confidence") < APPLY_FROM, "below-threshold").otherwise("applied"))
    met = met.withColumn("arbitration", state)
    done = c("arbitration") == "applied"
    settled = F.array_compact(F.array(F.when(c("_author") != UNKNOWN_AUTHOR, "nieznany-autor"), F.when(c("_title") != NO_TITLE, "brak-tytulu"), F.when(F.coalesce("source", F.lit("")).startswith("fallback"), "fallback")))
    none = F.array().cast("array<string>")
    return met.withColumns({
        **{f: F.when(done, c(f"_{f}")).otherwise(c(f)) for f in fields},
        "source": F.when(done, F.concat(F.coalesce("source", F.lit("")), F.lit("+ai-local"))).otherwise(c("source")),
        "review_reasons": F.when(done, F.filter(F.coalesce("review_reasons", none), lambda r: ~F.array_contains(settled, r))).otherwise(c("review_reasons")),
        "decision_reasons": F.when(done, F.array_distinct(F.concat(F.coalesce("decision_reasons", none), c("_reasons"), F.array(F.lit("ai-local:auto-applied"))))).otherwise(c("decision_reasons")),
    }).select(*records.columns, "arbitration")
