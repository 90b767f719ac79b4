"""Author merge and catalog: noise filter, grouped arg-minima, alias index, lookups."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioforge.functions.text import SURNAME_PARTICLES, clean, fold_text, key_of, last_first, let
from folioforge.functions.titles import bare, words
from folioforge.runtime import cut

# Trust ranks of compacted sources, for the merge and for the catalog, and of confidence words.
MERGE_RANK = {"lc": 0, "ol": 1}
CATALOG_RANK = {"lc": 0, "lc | ol": 1, "ol": 2}
CONFIDENCE = {"high": 2, "medium": 1, "low": 0}
NAMES = ["author_first_last", "author_last_first", "author_raw"]
# Words that are no part of a name, words of bodies, and given names that tell the order of a name.
NOISE_WORDS = ["author", "joint", "unknown", "anonymous", "various"]
CORPORATE_WORDS = """academy administration agency assembly association authority board brake bureau center centre church city college commission
committee company conference congress corporation council county court dept department director division encyclopedia encyclopaedia faculty federation
foundation general government governor group health hospital india industries institute judicial laboratory land league legal legislative library
limited ltd manufacturing media ministry municipal museum music office park planning popular press province public publishing records record recrd
reforms revenue rural sales samiti scientific society state steam study superintendent tax team trust university women workshop world writers""".split()
GIVEN_NAMES = """adrian agatha alan alina ann anna arthur cecelia colleen dakota eric harlan james jerry john jodi karen katarzyna marie nicholas nora
remigiusz robert sarah stephen tess victoria""".split()
#: Most authors one text is read as.
MOST_AUTHORS = 4


def rank_of(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(99)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def source_tokens(c: Column) -> Column:
    """Distinct compacted tokens of a ``|`` list."""
    token = lambda s: F.when(s.isin("lubimyczytac", "lc"), "lc").when(s.isin("openlibrary", "ol"), "ol").otherwise(s)
    tokens = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: token(F.lower(F.trim(x))))
    return F.array_distinct(F.filter(tokens, lambda x: x != ""))


def joined_sources(tokens: Column) -> Column:
    """Tokens in order of trust, then of the alphabet, as one text."""
    ranked = F.array_sort(F.transform(F.array_distinct(tokens), lambda x: F.struct(rank_of(x, MERGE_RANK).alias("r"), x.alias("s"))))
    return F.array_join(F.transform(ranked, lambda x: x["s"]), " | ")


def compact_source(c: Column) -> Column:
    """Distinct tokens of a `` | `` list in trust order."""
    return joined_sources(source_tokens(c))


def strip_noise(c: Column) -> Column:
    """A name without years, brackets, edge signs and noise words."""
    trimmed = F.transform(words(clean(c)), lambda w: F.btrim(w, F.lit("()[]{}.,;:")))
    year = lambda w: F.btrim(w, F.lit("-")).rlike(r"^\d{3,4}(?:[-/]\d{2,4})?$")
    return F.concat_ws(" ", F.filter(trimmed, lambda w: (w != "") & ~year(w) & ~F.lower(w).isin(NOISE_WORDS)))


def is_plausible_author(c: Column) -> Column:
    """Two to six words, two with letters, four letters, no figures, no body of three or more words."""
    parts = words(strip_noise(c))
    letters = F.transform(parts, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")))
    return (
        F.size(parts).between(2, 6) & (F.size(F.filter(letters, lambda n: n > 0)) >= 2) & (F.aggregate(letters, F.lit(0), lambda s, n: s + n) >= 4)
        & ~F.exists(parts, lambda w: w.rlike(r"\d")) & ~((F.size(parts) >= 3) & F.exists(parts, lambda w: F.lower(w).isin(CORPORATE_WORDS)))
    )


def first_key(*names: Column) -> Column:
    """Key of the first name that has one, else empty."""
    return F.coalesce(*[F.nullif(key_of(n), F.lit("")) for n in names], F.lit(""))


def ingest_patterns(raw: DataFrame, row_id: str) -> DataFrame:
    """Raw author rows as rows of the merge; those without a plausible name are left out.

    NULL fields count as empty. ``confidence`` is a word; the result has its rank.
    """
    named = raw.select(row_id, F.trim(F.coalesce("source", F.lit(""))).alias("source"), F.lower(F.trim(F.coalesce("confidence", F.lit("")))).alias("confidence"),
                       *[strip_noise(F.col(n)).alias(n) for n in NAMES])
    kept = named.where(F.exists(F.array(*NAMES), is_plausible_author))
    level = F.lit(-1)
    for k, v in CONFIDENCE.items():
        level = F.when(F.col("confidence") == k, v).otherwise(level)
    one = F.lower("source")
    token = F.when(one.isin("lubimyczytac", "lc"), "lc").when(one.isin("openlibrary", "ol"), "ol").otherwise(one)
    return kept.select(row_id, first_key(*map(F.col, NAMES)).alias("group_key"), compact_source(F.col("source")).alias("source"), *NAMES,
                       rank_of(token, MERGE_RANK).alias("source_rank"), level.alias("confidence_rank"), F.length(NAMES[0]).alias("author_len"))


def value_priority(value: Column, source_rank: Column, confidence: Column) -> list[Column]:
    """Smaller wins: no ellipsis, no figures, few one-letter words, trust, confidence, length."""
    tokens = F.split(clean(value), " ")
    return [value.contains("...").cast("int"), clean(value).rlike(r"\d").cast("int"), F.size(F.filter(tokens, lambda t: F.length(t) == 1)),
            source_rank, -confidence, -F.length(value)]


def merge_authors(rows: DataFrame) -> DataFrame:
    """One row per non-empty group key: the best value of each name field, joined sources, row count.

    Rows need group_key, source, the three names, source_rank, confidence_rank and row_id.
    NULL names count as missing, NULL ranks as the worst; a raw name equal to a form is blank.
    """
    rank, conf = F.coalesce("source_rank", F.lit(99)), F.coalesce("confidence_rank", F.lit(-1))
    best = []
    for f in NAMES:
        v = F.trim(F.coalesce(F.col(f), F.lit("")))
        best.append(F.min(F.when(v != "", F.struct(*[c.alias(f"p{i}") for i, c in enumerate(value_priority(v, rank, conf))], "row_id", v.alias("v")))).alias(f))
    joined = rows.where("group_key <> ''").groupBy("group_key").agg(*best, joined_sources(F.flatten(F.collect_set(source_tokens(F.col("source"))))).alias("source"), F.count(F.lit(1)).alias("n_rows"))
    name = lambda f: F.coalesce(F.col(f"{f}.v"), F.lit(""))
    raw = F.when(name("author_raw").isin("") | (name("author_raw") == name("author_first_last")) | (name("author_raw") == name("author_last_first")), "").otherwise(name("author_raw"))
    return joined.select("group_key", name("author_first_last").alias("author_first_last"), name("author_last_first").alias("author_last_first"), raw.alias("author_raw"), "source", "n_rows")


def ungrouped(rows: DataFrame) -> DataFrame:
    """Rows without a key pass through."""
    return rows.where("coalesce(group_key, '') = ''").select("row_id", *NAMES)


def catalog_name(c: Column) -> Column:
    """Cleaned name; the dot after a lone letter goes."""
    return F.regexp_replace(clean(c), r"(?<=(?<![\p{L}\p{N}_])\p{L})\.(?=\s|$)", "")


def initials_key(c: Column) -> Column:
    """First letters of the words; empty if a word has no letter."""
    letters = F.transform(words(c), lambda w: F.regexp_extract(F.lower(fold_text(w)), r"\p{L}", 0))
    return F.when(F.exists(letters, lambda x: x == ""), "").otherwise(F.array_join(letters, ""))


def is_substantial(c: Column) -> Column:
    """Two to five words, two with letters, six letters, one word of three."""
    parts = F.filter(F.transform(words(clean(c)), lambda w: F.regexp_replace(bare(w), r"(?U)\d", "")), lambda w: w != "")
    return (F.size(words(clean(c))).between(2, 5) & (F.size(parts) >= 2) & (F.length(F.array_join(parts, "")) >= 6) & F.exists(parts, lambda w: F.length(w) >= 3))


def form_score(name: Column) -> Column:
    """Greater for a name that starts with a given name, does not end with one and has few initials; then the longer."""
    parts = F.transform(words(catalog_name(name)), F.lower)
    return F.struct(F.when(F.try_element_at(parts, F.lit(1)).isin(GIVEN_NAMES), 2).otherwise(0).alias("first"), F.when(F.try_element_at(parts, F.lit(-1)).isin(GIVEN_NAMES), -1).otherwise(0).alias("last"),
                    (-F.size(F.filter(parts, lambda w: F.length(w) == 1))).alias("initials"), F.length(name).alias("n"))


def best_form(names: Column) -> Column:
    """The best scored of an array of names, the first of equal ones; empty without any."""
    scored = F.transform(F.filter(names, lambda n: n != ""), lambda n, i: F.struct(form_score(n).alias("s"), (-i).alias("first"), n.alias("n")))
    return F.coalesce(F.array_max(scored)["n"], F.lit(""))


@dataclass(frozen=True)
class Catalog:
    """Alias keys with their author, and the keys that tell whether words may be an author at all."""

    aliases: DataFrame
    initials: DataFrame
    first_words: DataFrame
    last_words: DataFrame


def build_catalog(merged: DataFrame) -> Catalog:
    """The catalog of merged author rows (source and the three names); independent of their order."""
    c = F.col
    rows = merged.select(rank_of(F.lower(F.trim("source")), CATALOG_RANK).alias("rank"), *[clean(c(n)).alias(n) for n in NAMES])
    rows = rows.select("rank", *NAMES, first_key(*map(c, NAMES)).alias("group_key"), best_form(F.array(
        catalog_name(c(NAMES[0])), catalog_name(c(NAMES[2])), catalog_name(last_first(c(NAMES[1]))), catalog_name(last_first(c(NAMES[2]))))).alias("preferred")).where("group_key <> '' AND preferred <> ''")
    order = F.struct("rank", -F.length(NAMES[0]), -F.length("preferred"), "preferred")
    canonical = rows.groupBy("group_key").agg(F.min_by("preferred", order).alias("canonical"))
    forms = F.array(*[catalog_name(x) for x in (c(NAMES[0]), c(NAMES[1]), c(NAMES[2]), last_first(c(NAMES[0])), last_first(c(NAMES[2])))])
    aliases = rows.join(canonical, "group_key").select("canonical", "rank", F.length(NAMES[0]).alias("n"), F.explode(F.array_distinct(forms)).alias("alias")).where("alias <> ''")
    keyed = aliases.select("canonical", "rank", "n", "alias", key_of(c("alias")).alias("alias_key")).where("alias_key <> ''")
    best = keyed.groupBy("alias_key").agg(F.min_by("canonical", F.struct("rank", -c("n"), "canonical")).alias("canonical"))
    named = aliases.select("canonical", words(c("alias")).alias("w"), "alias").where(F.size("w").between(2, 5))
    initials = named.select(initials_key(c("alias")).alias("initials"), "canonical").where("initials <> ''").groupBy("initials").agg(F.collect_set("canonical").alias("s"))
    shown = F.transform(F.array_sort(F.transform("s", lambda x: F.struct(F.length(x).alias("n"), x.alias("c")))), lambda x: x["c"])
    ends = lambda e, n: named.select(key_of(e).alias(n)).where(f"{n} <> ''").distinct()
    return Catalog(best, initials.select("initials", shown.alias("authors")), ends(F.try_element_at("w", F.lit(1)), "first_word"), ends(F.try_element_at("w", F.lit(-1)), "last_word"))


def catalog(merged: DataFrame) -> DataFrame:
    """(alias_key, canonical) of the catalog."""
    return build_catalog(merged).aliases


def joins_words(query: Column, canonical: Column) -> Column:
    """Whether the query is the canonical name with words after the first run together, none of them a particle."""
    return let(F.struct(words(catalog_name(query)).alias("q"), words(catalog_name(canonical)).alias("k"), (key_of(query) == key_of(canonical)).alias("same")), lambda v: v["same"] & _joined(v["q"], v["k"]))


def _joined(q: Column, k: Column) -> Column:
    ends = lambda parts: F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.length(F.array_join(F.transform(F.slice(parts, F.lit(1), i), key_of), "")))
    return F.size(q).between(2, F.size(k) - 1) & let(F.struct(ends(q).alias("q"), ends(k).alias("k")), lambda at: _merges(k, at["q"], at["k"]))


def _merges(k: Column, at_q: Column, at_k: Column) -> Column:
    merged = F.zip_with(k, F.transform(at_k, lambda e, i: ~F.array_contains(at_q, e) | ((i > 0) & ~F.array_contains(at_q, F.coalesce(F.try_element_at(at_k, i), F.lit(0))))), lambda w, m: m & F.lower(w).isin(SURNAME_PARTICLES))
    return (F.try_element_at(at_q, F.lit(1)) == F.try_element_at(at_k, F.lit(1))) & (F.size(F.array_except(at_q, at_k)) == 0) & ~F.exists(merged, lambda m: m)


def resolve(texts: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``texts`` with ``canonical``: by the key of the text, else of its last-first form, in the better spelling.

    Distinct texts meet the aliases, so repeated texts and hot names are looked
    up once; the join strategy is left to the optimizer. NULL without a hit.
    """
    c = F.col
    held = texts.select(F.col(column).alias("_text")).where("_text is not null").distinct()
    forms = held.select("_text", catalog_name(c("_text")).alias("_plain")).where("_plain <> ''")
    forms = forms.select("_text", F.posexplode(F.array_distinct(F.array("_plain", catalog_name(last_first(c("_plain")))))).alias("_probe", "_form"))
    hit = cut(forms.select("_text", "_probe", "_form", catalog_name(last_first(c("_form"))).alias("_turned"), key_of(c("_form")).alias("alias_key")).join(aliases, "alias_key"), "alias-hits")
    turned = c("_turned")
    own = best_form(F.array(F.when(joins_words(c("_form"), c("canonical")), c("_form")).otherwise(""), F.when(joins_words(turned, c("canonical")), turned).otherwise("")))
    shown = hit.select("_text", "_probe", F.when(own == "", c("canonical")).otherwise(own).alias("_name"))
    best = shown.groupBy("_text").agg(F.max_by("_name", F.struct(form_score(c("_name")), -c("_probe"))).alias("canonical"))
    return texts.join(best, texts[column] == best["_text"], "left").drop("_text")


def may_be_authors(texts: DataFrame, column: str, known: Catalog) -> DataFrame:
    """The texts of two to five words whose first or last word and whose initials the catalog knows."""
    parts = words(clean(F.col(column)))
    rows = texts.where(F.size(parts).between(2, 5)).withColumns({"initials": initials_key(clean(F.col(column))), "first_word": key_of(F.try_element_at(parts, F.lit(1))), "last_word": key_of(F.try_element_at(parts, F.lit(-1)))})
    rows = rows.join(known.initials.select("initials"), "initials", "left_semi")
    rows = rows.join(known.first_words.withColumn("_f", F.lit(True)), "first_word", "left").join(known.last_words.withColumn("_l", F.lit(True)), "last_word", "left")
    return rows.where("_f OR _l").select(*texts.columns)


def known_ends(texts: DataFrame, key: str, column: str, known: Catalog, suffix: bool = False) -> DataFrame:
    """(key, author, title): the longest known author of two to five words at the start (or end) of a text, and the rest."""
    c = F.col
    rows = texts.select(key, words(clean(c(column))).alias("w")).where(F.size("w") > 2)
    rows = rows.select(key, "w", F.explode(F.sequence(F.lit(2), F.least(F.lit(5), F.size("w") - 1))).alias("n"))
    n, size = c("n"), F.size("w")
    author = F.slice("w", size - n + 1, n) if suffix else F.slice("w", F.lit(1), n)
    rest = F.slice("w", F.lit(1), size - n) if suffix else F.slice("w", n + 1, size)
    rows = cut(rows.select(key, "n", F.concat_ws(" ", author).alias("span"), clean(F.concat_ws(" ", rest)).alias("title")).where("title <> ''"), "name-ends")
    got = resolve(may_be_authors(rows, "span", known), "span", known.aliases).where("canonical is not null")
    return got.groupBy(key).agg(F.max_by(F.struct(c("canonical").alias("author"), "title"), "n").alias("b")).select(key, "b.*")


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("author", T.StringType())])


def best_path(spans: list[dict], most: int = MOST_AUTHORS) -> list[str]:
    """Authors of disjoint spans that cover the most words, then are the most; earlier gaps are kept over later ones."""
    n = max((s["stop"] for s in spans), default=0)
    starts: dict[int, list] = {}
    for s in sorted(spans, key=lambda s: s["stop"]):
        starts.setdefault(s["start"], []).append(s)
    # table[used][place]: (covered, count, authors) of the best rest from there
    later = [(0, 0, ())] * (n + 1)
    for _ in range(most):
        row = [(0, 0, ())] * (n + 1)
        for i in range(n - 1, -1, -1):
            row[i] = row[i + 1]
            for s in starts.get(i, []):
                covered, count, rest = later[s["stop"]]
                if (s["stop"] - i + covered, 1 + count) > row[i][:2]:
                    row[i] = (s["stop"] - i + covered, 1 + count, (s["author"], *rest))
        later = row
    return list(later[0][2]) if later[0][0] >= 2 else []


@F.arrow_udf(T.ArrayType(T.StringType()))
def _best_paths(spans: pa.Array) -> pa.Array:
    return pa.array([best_path(s or []) for s in spans.to_pylist()], pa.list_(pa.string()))


def distinct_names(names: Column) -> Column:
    """Names in order, the first of each key."""
    start = F.array().cast("array<string>")
    return F.aggregate(names, start, lambda acc, x: F.when((key_of(x) == "") | F.exists(acc, lambda y: key_of(y) == key_of(x)), acc).otherwise(F.array_append(acc, x)))


def known_authors(texts: DataFrame, key: str, column: str, known: Catalog) -> DataFrame:
    """(key, authors): the known authors a text names, empty if none.

    The first way that succeeds counts: the whole text is an author; its parts
    between ``&``, ``;``, and, i; its parts between commas; else disjoint runs of
    words. Parts count if all are known and few, or two at least are known.
    NULL and empty texts give an empty array; repeated keys are not expected.
    """
    c = F.col
    held = texts.select(key, clean(c(column)).alias("text"))
    strong = F.regexp_replace(F.regexp_replace("text", ";", " & "), r"(?i)\s+(?:and|i)\s+", " & ")
    parts = lambda t, sep: F.filter(F.transform(F.split(t, sep), clean), lambda x: x != "")
    w = words(c("text"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.transform(
        F.sequence(i + 1, F.least(F.size(w), i + 4)), lambda j: F.struct(F.lit(3).alias("stage"), (i - 1).alias("start"), j.alias("stop"), F.concat_ws(" ", F.slice(w, i, j - i + 1)).alias("piece")))))
    piece = lambda stage, arr: F.transform(arr, lambda x, i: F.struct(F.lit(stage).alias("stage"), i.alias("start"), (i + 1).alias("stop"), x.alias("piece")))
    none = F.array().cast("array<struct<stage:int,start:int,stop:int,piece:string>>")
    every = F.concat(piece(0, F.array("text")), F.when(strong.contains("&"), piece(1, parts(strong, "&"))).otherwise(none),
                     F.when(F.size(parts(c("text"), ",")) > 1, piece(2, parts(c("text"), ","))).otherwise(none), F.when(F.size(w) > 1, spans).otherwise(none))
    # written once: three joins read the pieces, and each would else compute them again
    rows = cut(held.where("text <> ''").select(key, F.explode(every).alias("p")).select(key, "p.*"), "author-pieces")
    distinct = rows.where("stage > 0").select("piece").distinct()
    whole = rows.where("stage = 0").select("piece").distinct()
    seen = resolve(whole, "piece", known.aliases).withColumn("whole", F.lit(True)).unionByName(resolve(may_be_authors(distinct, "piece", known), "piece", known.aliases).withColumn("whole", F.lit(False)))
    seen = cut(seen, "author-hits").where(is_substantial(c("canonical"))).select("piece", "whole", "canonical")
    met = rows.withColumn("whole", c("stage") == 0).join(seen, ["piece", "whole"], "left")
    per = met.groupBy(key, "stage").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(c("canonical").isNotNull(), F.struct("start", "stop", c("canonical").alias("author"))))).alias("hits"))
    k = F.size("hits")
    good = per.where(F.when(c("stage") < 3, ((k == c("n")) & (c("n") <= MOST_AUTHORS)) | ((c("stage") > 0) & (k >= 2))).otherwise(k > 0))
    named = good.select(key, "stage", F.when(c("stage") < 3, F.transform("hits", lambda h: h["author"])).otherwise(_best_paths("hits")).alias("authors"))
    first = named.where(F.size("authors") > 0).groupBy(key).agg(F.min_by("authors", "stage").alias("authors"))
    return held.select(key).join(first, key, "left").select(key, distinct_names(F.coalesce("authors", F.array().cast("array<string>"))).alias("authors"))


def swapped_back(books: DataFrame, key: str, known: Catalog) -> DataFrame:
    """``books`` (title, creators) with title and creators exchanged where the title names known authors and the creators none.

    Such a title becomes empty and its authors the creators; ``swapped`` tells them.
    """
    c = F.col
    none = F.array().cast("array<string>")
    both = books.select(key, F.explode(F.array(F.struct(F.lit("t").alias("k"), F.coalesce("title", F.lit("")).alias("x")), F.struct(F.lit("c").alias("k"), F.array_join(F.coalesce("creators", none), " & ").alias("x")))).alias("e"))
    got = known_authors(both.select(F.struct(key, "e.k").alias("_at"), "e.x"), "_at", "x", known)
    wide = got.groupBy(c(f"_at.{key}").alias(key)).agg(F.first(F.when(c("_at.k") == "t", c("authors")), ignorenulls=True).alias("_t"), F.first(F.when(c("_at.k") == "c", c("authors")), ignorenulls=True).alias("_c"))
    met = books.join(wide, key, "left")
    swap = F.coalesce((F.size("_t") > 0) & (F.size("_c") == 0), F.lit(False))
    return met.withColumns({"creators": F.when(swap, c("_t")).otherwise(c("creators")), "title": F.when(swap, "").otherwise(c("title")), "swapped": swap}).drop("_t", "_c")
