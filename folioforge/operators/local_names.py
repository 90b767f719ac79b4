"""Author and title read out of a file name, and the record a book gives without any lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import NO_TITLE, STANDALONE, SURNAME_PARTICLES, UNKNOWN_AUTHOR, canonical_authors, clean, clean_series, extract_isbns, let, match_text, parse_volume
from folioforge.functions.titles import (
    STRUCTURAL, bare, before_last, clean_author, group, has, is_author_like, keyword_genre, sanitize_title, split_authors, strip_artifacts, strip_author, strip_leading_index, words)
from folioforge.operators.candidates import local_series, local_title, name_guesses, own_guess, title_guesses
from folioforge.operators.existing_names import existing_names
from folioforge.runtime import cut

# Words that no name holds, given names that tell a name, words before a volume.
NO_NAME = ["a", "an", "and", "book", "chronicles", "cykl", "ksiega", "księga", "of", "part", "series", "the", "tom", "volume"]
GIVEN = """agatha ann adrian adrianna alan aleksandra alexandra alina anders andrzej anna anthony arthur barbara charles cheslaw czeslaw cyril dakota emil ewa
francis gerald gojko grzegorz harlan henryk jacek james jan jerry joanna john joseph julia krzysztof lidia maja marcin marek maria marie michael piotr rafal
richard robert saladin scott stanislaw stephen victoria wasilij william ake ahmed""".split()
_VOLUME_END = r"(?:^|[\s,._-])(?:book|tom|volume|vol\.?|part|cykl|czesc|część|ksiega|księga)\s+\d+(?:\.\d+)?\s*$"
_PARSE = "struct<title:string,author:string,volume:struct<major:int,minor:string>,source:string,confidence:int>"


def is_label(name: Column) -> Column:
    """A name of two to five words, two of them with letters beside particles, six letters, one word of three."""
    def fits(parts: Column) -> Column:
        real = F.filter(F.transform(F.filter(parts, lambda w: ~F.rtrim(F.lower(w), F.lit(".")).isin(SURNAME_PARTICLES)), lambda w: F.regexp_replace(bare(w), r"(?U)\d", "")), lambda w: w != "")
        return F.size(parts).between(2, 5) & (F.size(real) >= 2) & (F.length(F.array_join(real, "")) >= 6) & F.exists(real, lambda w: F.length(w) >= 3)

    return let(words(clean_author(name)), fits)


def is_strong_name(name: Column) -> Column:
    """Two to four capitalised words or initials, with an initial or a known given name among them."""
    initial = lambda w: w.rlike(r"^[A-Z]\.?$")
    particle = lambda w: F.lower(w).isin(SURNAME_PARTICLES)

    def fits(v: Column) -> Column:
        parts = words(v)
        shaped = F.forall(parts, lambda w: particle(w) | initial(w) | (w.rlike(r"^\p{Lu}") & w.rlike(r"^\p{L}[^\s,;:!?/\\]*$")))
        return (v != "") & is_author_like(v) & F.size(parts).between(2, 4) & ~F.exists(parts, lambda w: F.lower(w).isin(NO_NAME)) & shaped & F.exists(parts, lambda w: F.lower(w).isin(GIVEN) | initial(w))

    return let(clean_author(name), fits)


def is_series_payload(text: Column) -> Column:
    """Bracket contents that name a series and a volume."""
    round_, tail = r"^(.*?)\s*\(([^()]+)\)\s*$", r"^(.*?)\s+(\d+(?:\.\d+)?|[IVXLCDM]+)\s*$"
    named = lambda v, p: (clean(group(v, p, 1)) != "") & parse_volume(group(v, p, 2)).isNotNull()
    return let(clean(text), lambda v: (v != "") & ~v.rlike(r"^\d{1,4}$") & F.when(has(v, round_), named(v, round_)).otherwise(named(v, tail)))


def trailing_author(core: Column) -> Column:
    """Author at the end of a core: after the last hyphen, else the last two words, or three with a particle or initial between."""
    def last(parts: Column, n: int) -> Column:
        middle = lambda w: F.lower(F.try_element_at(w, F.lit(2))).isin(SURNAME_PARTICLES) | F.try_element_at(w, F.lit(2)).rlike(r"^[A-Za-z]\.?$")
        name = clean_author(F.concat_ws(" ", F.slice(parts, F.size(parts) - n + 1, n)))

        def fits(v: Column) -> Column:
            w = words(v)
            good = is_author_like(v) & ~F.exists(w, lambda x: F.lower(x).isin("book", "part", "series", "tom", "volume"))
            return F.when(good & (middle(w) if n == 3 else F.lit(True)), v)

        return F.when(F.size(parts) >= n, let(name, fits))

    def read(v: Column) -> Column:
        after = let(clean_author(before_last(v)[1]), lambda a: F.when(v.contains(" - ") & is_author_like(a), a))
        return F.coalesce(after, let(words(v), lambda parts: F.coalesce(last(parts, 2), last(parts, 3))), F.lit(""))

    return let(strip_artifacts(core), read)


def hybrid_names(rows: DataFrame, core: str = "core") -> DataFrame:
    """``rows`` with ``h``: struct<title, author, volume, source, confidence> of the first rule that fits the core, NULL if none does.

    A column ``known``, if there is one, is what the catalog finds in the core:
    struct<whole, prefix:struct<author, title>, suffix:struct<author, title>, first:array, last:array>;
    without it the rules that need it never fit. The costly tests run once over
    arrays of all parts that any rule looks at.
    """
    c = F.col
    at = lambda name, i: F.try_element_at(c(name), F.lit(i + 1))
    n_words = lambda x: F.size(words(x))
    lead, tail = r"^\[([^\]]+)\]\s*(.+)$", r"^(.*?)\s*\[([^\]]+)\]\s*$"
    base = rows.withColumn("_v", clean(c(core)))
    base = base.withColumns({"_p": F.filter(F.transform(F.split("_v", r"\s+-\s+"), clean), lambda x: x != ""), "_w": words(c("_v"))})
    n = F.size("_p")
    join_from = lambda k: F.array_join(F.slice("_p", k, F.greatest(n - (k - 1), F.lit(0))), " - ")
    text = {"first": F.coalesce(at("_p", 0), F.lit("")), "last": F.coalesce(F.try_element_at("_p", F.lit(-1)), F.lit("")), "second": F.coalesce(at("_p", 1), F.lit("")), "rest": join_from(2),
            "third": clean(F.regexp_replace(join_from(3), r"^\s*\[[^\]]+\]\s*", "")), "middle": F.when(n > 2, clean(F.array_join(F.slice("_p", 2, F.greatest(n - 2, F.lit(0))), " - "))).otherwise(""),
            "pair": F.concat_ws(" ", F.slice("_w", 1, 2)), "after": F.concat_ws(" ", F.slice("_w", 3, F.greatest(F.size("_w") - 2, F.lit(0)))), "amp_l": clean(before_last(c("_v"), " & ")[0]), "amp_r": before_last(c("_v"), " & ")[1]}
    base = base.select("*", F.struct(*[x.alias(k) for k, x in text.items()]).alias("_t"))
    t = lambda k: c(f"_t.{k}")
    names = {"first": t("first"), "last": t("last"), "second": t("second"), "plain": F.regexp_replace(t("last"), r"\s*\[[^\]]+\]\s*$", ""), "head": group(t("last"), tail, 1), "amp": t("amp_r"), "pair": t("pair")}
    titles = {"first": t("first"), "last": t("last"), "rest": t("rest"), "third": t("third"), "middle": t("middle"), "after": t("after"), "amp": t("amp_l"), "in_first": group(t("first"), lead, 2), "in_last": group(t("last"), lead, 2),
              "inner": clean(F.btrim(t("first"), F.lit("[](){} ")))}
    base = base.withColumns({"_a": F.transform(F.array(*names.values()), clean_author), "_i": F.transform(F.array(*titles.values()), strip_leading_index)})
    a = lambda k: at("_a", list(names).index(k))
    i = lambda k: at("_i", list(titles).index(k))
    turn = let(words(a("pair")), lambda w: F.when((F.size(w) == 2) & F.lower(F.try_element_at(w, F.lit(2))).isin(GIVEN) & ~F.lower(F.try_element_at(w, F.lit(1))).isin(GIVEN), F.concat_ws(" ", F.reverse(w))).otherwise(F.concat_ws(" ", w)))
    joined = F.array(*[F.filter(F.transform(F.split(a("first"), sep), clean), lambda p: p != "") for sep in (r"(?i)\s+i\s+", r"\s*&\s*")])
    base = base.select("*", turn.alias("_pair"), joined.alias("_joined"))
    like = {**{f"a_{k}": a(k) for k in ("first", "last", "second", "plain", "head")}, "t_first": i("first")}
    firm = {"first": t("first"), "rest": i("rest"), "pair": c("_pair"), "after": i("after"), "t_first": i("first")}
    payload = {"first": group(t("first"), lead, 1), "last": group(t("last"), lead, 1), "tail": group(t("last"), tail, 2)}
    base = base.withColumns({"_like": F.transform(F.array(*like.values()), is_author_like), "_strong": F.transform(F.array(*firm.values()), is_strong_name), "_pay": F.transform(F.array(*payload.values()), is_series_payload),
                             "_co": F.exists("_joined", lambda p: (F.size(p) >= 2) & F.forall(p, is_strong_name)), "_vol": parse_volume(F.btrim(t("first"), F.lit("()[]{} "))), "_mark": _only_structural(i("middle"))})
    liked = lambda k: at("_like", list(like).index(k))
    strong = lambda k: at("_strong", list(firm).index(k))
    paid = lambda k: at("_pay", list(payload).index(k))
    none = F.lit(None).cast("struct<major:int,minor:string>")

    def out(title: Column, author: Column, source: str, confidence, volume: Column = none) -> Column:
        score = F.lit(confidence) if isinstance(confidence, int) else confidence
        return F.struct(title.alias("title"), author.alias("author"), volume.alias("volume"), F.lit(f"hybrid:{source}").alias("source"), score.alias("confidence"))

    flat = ~c("_v").contains(" - ")
    two = ~flat & (n == 2)
    rules = []
    if "known" in rows.columns:
        plain = flat & ~c("_v").contains(" -- ") & ~c("_v").contains(",")
        found = F.transform(F.array(F.coalesce("known.whole", F.lit("")), F.coalesce("known.prefix.author", F.lit("")), F.coalesce("known.suffix.author", F.lit(""))), lambda x: F.struct(is_label(x).alias("ok"), clean_author(x).alias("a")))
        base = base.withColumn("_known", found)
        k = lambda j: at("_known", j)
        rules += [(plain & k(0)["ok"], out(F.lit(""), k(0)["a"], "compact-author-only", 94)),
                  (plain & k(1)["ok"], out(strip_leading_index(c("known.prefix.title")), k(1)["a"], "compact-author-title", 92)),
                  (plain & k(2)["ok"], out(strip_leading_index(c("known.suffix.title")), k(2)["a"], "compact-title-author", 92))]
    rules += [(flat & c("_v").contains(" & ") & (n_words(a("amp")) >= 2) & (n_words(t("amp_l")) >= 2), out(i("amp"), a("amp"), "ampersand-title-author", 86)),
              (flat & F.size("_w").between(3, 6) & strong("pair") & (i("after") != "") & ~strong("after"), out(i("after"), c("_pair"), "compact-author-title", 83))]
    if "known" in rows.columns:
        one = lambda x, y: two & (F.size(x) == 1) & (F.coalesce(F.size(y), F.lit(0)) <= 0)
        who = lambda x: F.try_element_at(x, F.lit(1))
        mixed = lambda seg, x: seg.rlike("[&,;]") | (n_words(seg) > n_words(x))
        kf, kl = c("known.first"), c("known.last")
        rules += [(one(kf, kl) & (i("last") != "") & mixed(t("first"), who(kf)), out(i("last"), who(kf), "catalog-delimited-author-title", 93)),
                  (one(kl, kf) & (i("first") != "") & mixed(t("last"), who(kl)), out(i("first"), who(kl), "catalog-delimited-title-author", 93))]
    hinted = (c("_v").rlike(r"^\s*[\[(]\d{1,4}[\])]") & a("first").rlike("[A-Za-z]")) | c("_co") | F.exists(words(a("first")), lambda w: F.lower(w).endswith("owie"))
    led = (a("first") != "") & (i("rest") != "")
    many = ~flat & (n >= 2)
    score = F.when(c("_vol").isNotNull(), 92).otherwise(88)
    has_middle = (t("middle") != "") & (t("middle") != a("plain"))
    clear = n_words(a("plain")) >= 2
    short = (n_words(i("first")) == 1) & F.length(i("first")).between(1, 4) & clear
    alone = ~liked("t_first") | (clear & i("first").rlike(r"(?i)\s+(?:i|&)\s+")) | (clear & has(i("first"), _VOLUME_END)) | (short & ~strong("t_first"))
    lone_word = t("first")
    rules += [
        (many & (n >= 3) & (F.lower(lone_word) == lone_word) & (n_words(lone_word) == 1) & (F.length(lone_word) <= 3) & liked("a_second") & (n_words(a("second")) >= 2) & (n_words(t("third")) >= 2), out(i("third"), a("second"), "prefixed-noise-title-author", 87)),
        (two & liked("a_plain") & titles["inner"].rlike("[A-Za-z]") & t("first").rlike(r"^[\[(].*[\])]$"), out(i("inner"), a("plain"), "bracketed-title-author", 90)),
        (two & liked("a_last") & paid("first") & (i("in_first") != ""), out(t("first"), a("last"), "delimited-title-author", 91)),
        (two & liked("a_head") & paid("tail") & (i("first") != ""), out(i("first"), a("head"), "delimited-title-author", 88)),
        (two & liked("a_first") & paid("last") & (i("in_last") != ""), out(t("last"), a("first"), "delimited-author-title", 91)),
        (two & led & strong("first") & ~strong("rest"), out(i("rest"), a("first"), "delimited-author-title", 89)),
        (many & led & hinted & (i("rest").rlike(r"\(\d+\)\s*$") | (n_words(i("rest")) >= 2)), out(i("rest"), a("first"), "delimited-author-title", 90)),
        (many & ~liked("a_plain"), F.lit(None)),
        (many & has_middle & c("_mark") & (i("first") != ""), out(i("first"), a("plain"), "delimited-index-title-author+leading-title", score)),
        (many & has_middle, out(i("middle"), a("plain"), "delimited-index-title-author", score, c("_vol"))),
        (many & (i("first") != "") & alone, out(i("first"), a("plain"), "delimited-title-author", 84, F.when(~short, c("_vol")))),
    ]
    chain = None
    for cond, value in rules:
        chain = F.when(F.coalesce(cond, F.lit(False)), value) if chain is None else chain.when(F.coalesce(cond, F.lit(False)), value)
    return base.withColumn("h", chain).select(*rows.columns, "h")


def _only_structural(text: Column) -> Column:
    """Words for volumes and numbers only, one at least."""
    parts = F.filter(F.transform(words(clean(text)), lambda w: F.lower(bare(w))), lambda w: w != "")
    return let(parts, lambda p: (F.size(p) > 0) & F.forall(p, lambda w: w.isin(STRUCTURAL) | w.rlike(r"^\d+$")))


def authors_of(creators: Column, segment: Column) -> Column:
    """Authors of the creators, and of the segment where there is one creator at most, last name first, joined by ``&``."""
    raw = F.flatten(F.transform(F.coalesce(creators, F.array().cast("array<string>")), split_authors))
    more = F.when(segment.rlike("[A-Za-z]") & (F.size(F.coalesce(creators, F.array().cast("array<string>"))) <= 1), split_authors(segment)).otherwise(F.array().cast("array<string>"))
    identity = lambda x: F.array_join(F.array_sort(F.filter(F.transform(words(x), lambda w: F.lower(F.regexp_replace(bare(w), r"(?U)\d", ""))), lambda w: w != "")), " ")
    first = lambda names: let(F.transform(names, identity), lambda keys: F.filter(names, lambda x, i: F.array_position(keys, F.try_element_at(keys, i + 1)) == i + 1))
    joined = F.array_join(let(canonical_authors(F.concat(raw, more)), first), " & ")
    return let(joined, lambda x: F.when(x == "", UNKNOWN_AUTHOR).otherwise(x))


def local_records(books: DataFrame, key: str = "book_id") -> DataFrame:
    """The record of each book from its name and own metadata alone: author, series, volume, title, genre, source, confidence.

    A name in the output form is taken as it is. Else the author comes from
    creators and one segment of the name; series and title from the best fitting
    guesses of the rules, or from the name as a whole. Every book gives one row.
    """
    c = F.col
    held = books.select(key, *[F.coalesce(x, F.lit("")).alias(x) for x in ("stem", "core", "title", "meta_series")], "segments", "creators", "subjects", "identifiers", "meta_volume")
    both = held.select(key, F.posexplode(F.array("core", "stem")).alias("o", "name")).select(F.struct(key, "o").alias("at"), "name")
    formed = existing_names(both, "at", "name").groupBy(c(f"at.{key}").alias(key)).agg(F.min_by(F.struct("author", "series", "volume", "title", "genre"), "at.o").alias("f"))
    rows = cut(hybrid_names(held.join(formed, key, "left")), "parsed-names")

    done = rows.where("f is not null").select(
        key, let(clean_author(c("f.author")), lambda a: F.when(a == "", c("f.author")).otherwise(a)).alias("author"), F.when(c("f.series") == "", STANDALONE).otherwise(c("f.series")).alias("series"), c("f.volume").alias("volume"),
        let(sanitize_title(c("f.title"), F.when(c("f.series") == "", STANDALONE).otherwise(c("f.series")), c("f.volume")), lambda t: F.when(t == "", F.when(clean(c("f.title")) == "", NO_TITLE).otherwise(clean(c("f.title")))).otherwise(t)).alias("title"),
        F.when(clean(c("f.genre")) != "", clean(c("f.genre"))).otherwise(keyword_genre(c("subjects"))).alias("genre"), F.lit("existing-format").alias("source"), F.lit(100).alias("confidence"), F.lit(False).alias("title_from_core"))

    seg = clean_author(F.coalesce(F.try_element_at("segments", F.lit(2)), F.lit("")))
    own = F.size(F.coalesce("creators", F.array().cast("array<string>"))) > 0
    segment = F.coalesce(let(seg, lambda s: F.when(is_author_like(s), s)), F.nullif(clean_author(c("h.author")), F.lit("")), F.when(~own, trailing_author(c("core"))), F.lit(""))
    rest = rows.where("f is null").select("*", segment.alias("segment"))
    hint = F.coalesce("h.title", F.lit(""))
    whole = (F.coalesce("h.source", F.lit("")) == "hybrid:delimited-author-title") & (hint != "") & ~hint.rlike(r"\[[^\]]*\d[^\]]*\]")
    none = F.array().cast("array<string>")
    tail = group(c("core"), r"\[([^\]]+)\]\s*$", 1)
    framed = F.when((tail != "") & (c("h.source") == "hybrid:delimited-title-author"), clean(F.concat(hint, F.lit(" ["), tail, F.lit("]")))).otherwise("")
    rest = rest.select("*", authors_of(c("creators"), c("segment")).alias("author"), whole.alias("whole"), hint.alias("hint"), framed.alias("framed"))
    shown = F.array("title", F.when(clean(c("hint")) != clean(c("title")), c("hint")).otherwise(""), F.when(c("framed") != clean(c("hint")), c("framed")).otherwise(""))
    named = name_guesses(F.when(~c("whole"), c("core")).otherwise(""), F.when(~c("whole"), F.coalesce("segments", none)).otherwise(none))
    # written once: what follows reads the guesses three times, and one plan of all steps would be very large
    rest = cut(rest.select("*", F.concat(own_guess(c("meta_series"), c("meta_volume")), F.flatten(F.transform(shown, title_guesses)), named).alias("found")), "guesses")
    found = c("found")
    every = rest.select(key, "title", "core", F.posexplode(found).alias("pos", "g")).select(key, "title", "core", "pos", "g.score", "g.series", "g.volume", c("g.title").alias("title_override"), "g.source")
    series = local_series(every, key)
    title = local_title(every, key, series).select(key, c("title_override").alias("t"), c("source").alias("ts"), c("score").alias("tc"))
    best = series.select(key, c("series").alias("s"), c("volume").alias("v"), c("title_override").alias("st"), c("source").alias("ss"), c("score").alias("sc")).join(title, key, "left")
    met = cut(rest.drop("found").join(best, key, "left"), "best-guesses")
    hit = c("s").isNotNull() & ~c("whole")
    plain = F.coalesce(c("h.source"), F.lit("fallback"))
    met = met.select(
        key, "title", "core", "author", "segment", "subjects", "hint", F.when(hit, c("s")).otherwise(STANDALONE).alias("series"), F.when(hit, c("v")).alias("volume"),
        F.when(c("whole"), clean(c("hint"))).when(hit, F.coalesce("t", "st", F.lit(""))).otherwise("").alias("override"),
        F.when(hit, F.array_join(F.array_distinct(F.array_compact(F.array("ss", "ts"))), "+")).otherwise(plain).alias("source"),
        F.greatest(F.when(c("s").isNotNull(), F.greatest(c("sc"), F.coalesce("tc", F.lit(0)))).otherwise(F.lit(45)), F.when(c("whole") | c("s").isNull(), F.coalesce(c("h.confidence"), F.lit(0))).otherwise(F.lit(0))).alias("confidence"), own.alias("own"))
    met = met.select("*", sanitize_title(c("title"), c("series"), c("volume")).alias("local"))
    head, end = before_last(c("fallback"))
    met = met.select("*", let(clean(c("hint")), lambda h: F.when(h == "", strip_leading_index(c("core"))).otherwise(h)).alias("fallback"))
    met = met.withColumn("fallback", F.when((c("segment") != "") & c("fallback").contains(" - ") & (clean(end) == clean(c("segment"))), clean(head)).otherwise(c("fallback")))
    longer = (c("local") != "") & (c("override") != "") & ((F.length("override") > F.length("local") + 12) | has(c("override"), r"\b[0-9a-f]{12,}\b") | has(c("override"), r"\bAnna.?s Archive\b"))
    first = lambda *x: F.coalesce(*[F.nullif(v, F.lit("")) for v in x], F.lit(""))
    met = met.select("*", F.when(longer, c("local")).otherwise(first(c("override"), c("local"), c("fallback"), clean(c("core")))).alias("chosen"), (first(c("override"), c("local")) == "").alias("title_from_core"))
    only_author = (c("source") == "hybrid:compact-author-only") | ((c("source") == "fallback") & (c("title") == "") & ~c("own") & ~c("core").contains(" - ") & ~c("core").contains(" -- ") & (c("core") != ""))
    signature = lambda x: F.array_sort(F.filter(F.split(match_text(x), " "), lambda w: w != ""))
    is_author = lambda t: only_author & (match_text(c("author")) != "") & (signature(t) == signature(c("author")))
    tidy = sanitize_title(clean(F.regexp_replace(strip_author(c("chosen"), c("author")), r"(?i)\bAnna.?s Archive\b", "")), c("series"), c("volume"))
    met = met.select("*", is_author(c("chosen")).alias("same"), tidy.alias("tidy"))
    same = c("same") | is_author(c("tidy"))
    local = met.select(key, "author", F.when(clean_series(c("series")) == "", STANDALONE).otherwise(clean_series(c("series"))).alias("series"), "volume", F.when(same, NO_TITLE).otherwise(c("tidy")).alias("title"),
                       keyword_genre(c("subjects")).alias("genre"), "source", "confidence", (c("title_from_core") & ~same).alias("title_from_core"))
    numbers = held.select(key, extract_isbns(F.coalesce("identifiers", F.array().cast("array<string>"))).alias("isbns"))
    return done.unionByName(local).join(numbers, key)
