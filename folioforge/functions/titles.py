"""Cleaning and parsing of titles, file-name parts and author segments as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioforge.functions.text import SURNAME_PARTICLES, clean, clean_series, last_first, let, match_text, most_alike, parse_volume, volume_pattern

# Parts of patterns and whole patterns that decide what counts as a volume, a series or noise.
VOLUME = r"(?:\d+(?:\.\d+)?|[IVXLCDM]+)"
SERIES_WORD = r"(?:Book|Tom|Volume|Vol\.?|#|Part|Cykl|Czesc|Część|Ksiega|Księga)"
BOOK_WORD = r"(?:Book|Tom|Volume|Vol\.?)"
PART_WORD = r"(?:Book|Tom|Volume|Vol\.?|Czesc|Część|Ksiega|Księga)"
SOURCE_ARTIFACT = r"\b(?:Anna.?s Archive|libgen(?:\.li)?|z-?library|zlib)\b"
DOMAIN = r"(?:https?://)?(?:www\.)?(?:[a-z0-9-]+\.){1,}[a-z]{2,}(?:/\S*)?"
HEX_NOISE = r"\b[0-9a-f]{12,}\b"
RENAME_TAIL = r"(?:\s+-\s+(?:standalone|tom(?:\s+\d+(?:\.\d+)?)?|vol(?:ume)?(?:\s+\d+(?:\.\d+)?)?)){2,}\s*$"
PUBLISHER = r"\b(?:press|publishing|books|book group|media|house|studio|audio|audiobooks|editions)\b"
NULLISH = r"^(?:null|none|n/?a)(?:\s*,\s*(?:null|none|n/?a|\d{4}))*$"
GENRE_TAIL = r"\s*(?:\[[^\]]+\]|\((?:isekai|litrpg|progression fantasy|cultivation|fantasy|sci-fi|scifi)[^)]*\))\s*$"
SERIES_SUFFIX = rf"\s*\(([^()]*{SERIES_WORD}\s*{VOLUME}[^()]*)\)\s*$"
QUERY_NOISE = r"\((?:[^)]*\d{4}[^)]*|[^)]*(?:press|publishing|books)\b[^)]*)\)"
LEADING_INDEX = rf"^(?:#\s*)?(?:\(\s*)?{VOLUME}(?:\s*\))?[.)\s:_-]+\s*(.+)$"
LEADING_SERIES = rf"^(.+?)\s*\(\s*(?:{PART_WORD}\s*)?{VOLUME}\s*\)\s*(?:[-:._]\s*)?(.+)$"
UNKNOWN_WORDS = ["known", "u", "n", "unk", "unknown"]
LINKERS = ["a", "do", "i", "na", "o", "od", "po", "u", "w", "we", "z", "za", "ze"]
STRUCTURAL = ["book", "cykl", "czesc", "ksiega", "part", "standalone", "tom", "vol", "volume"]
# Words that tell a genre.
GENRES = {
    "litrpg": ["litrpg", "game lit", "gamelit"],
    "fantasy": ["fantasy", "dark fantasy", "epic fantasy", "heroic fantasy", "urban fantasy", "myth"],
    "sci-fi": ["science fiction", "sci fi", "sci-fi", "sf", "space opera", "cyberpunk", "dystopia", "post apocalyptic"],
    "kryminal": ["crime", "mystery", "detective", "kryminal", "kryminalna", "noir", "police procedural"],
    "thriller": ["thriller", "suspense", "sensacja"],
    "horror": ["horror", "ghost", "supernatural"],
    "romans": ["romance", "romans", "love story", "love stories", "erotica", "new adult"],
    "historyczna": ["historical fiction", "historical", "powiesc historyczna", "fiction historical"],
    "mlodziezowa": ["young adult", "juvenile fiction", "teen", "ya fiction"],
    "biografia": ["biography", "autobiography", "memoir", "biogra", "autobiogra"],
    "literatura-faktu": ["nonfiction", "non-fiction", "reportage", "essay", "history", "self help", "psychology"],
}


def any_case(pattern: str) -> str:
    """The pattern for the JVM, letters of either case, classes over all of Unicode."""
    return f"(?iU){pattern}"


def has(c: Column, pattern: str) -> Column:
    return c.rlike(any_case(pattern))


def without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, any_case(pattern), "")


def group(c: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract(c, any_case(pattern), n)


def words(c: Column) -> Column:
    """Non-empty words between blanks."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def bare(c: Column) -> Column:
    """A word without signs and underscores."""
    return F.regexp_replace(c, r"(?U)[\W_]+", "")


def literal(c: Column) -> Column:
    """The text as a regular expression that matches just it."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def before_last(c: Column, sep: str = " - ") -> tuple[Column, Column]:
    """What stands before and after the last separator; both empty without one."""
    pattern = f"(?s)^(.*){sep}(.*)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def before_first(c: Column, sep: str = " - ") -> tuple[Column, Column]:
    pattern = f"(?s)^(.*?){sep}(.*)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def is_noise(c: Column) -> Column:
    """Nothing but unknown-words, lone letters, one lower-case word or mostly figures."""
    return let(clean(c), _noise)


def _noise(value: Column) -> Column:
    return let(F.filter(F.transform(words(value), bare), lambda w: w != ""), lambda parts: _noise_parts(value, parts))


def _noise_parts(value: Column, parts: Column) -> Column:
    figures = F.length(F.regexp_replace(value, r"\D", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return (
        (value == "")
        | ((F.size(parts) > 0) & F.forall(parts, lambda w: F.lower(w).isin(UNKNOWN_WORDS) | (F.length(w) == 1)))
        | ((F.size(parts) == 1) & F.forall(parts, lambda w: (F.lower(w) == w) & (F.length(w) >= 2)))
        | ((figures > 0) & (figures >= F.greatest(F.lit(4), letters)))
    )


def is_author_head(c: Column) -> Column:
    """One to four words, each an initial or capitalised."""
    return let(words(clean(c)), lambda parts: F.size(parts).between(1, 4) & F.forall(parts, lambda w: (F.length(bare(w)) == 1) | ((bare(w) != "") & w.rlike(r"^\p{Lu}"))))


def is_publisher(c: Column) -> Column:
    return has(clean(c), PUBLISHER)


def is_artifact(c: Column) -> Column:
    """Name of a download site, a web address, or a spelled-out missing value."""
    return let(clean(c), lambda v: has(v, SOURCE_ARTIFACT) | has(v, NULLISH) | has(v, f"^{DOMAIN}$"))


def strip_artifacts(c: Column) -> Column:
    """Text without site names, addresses, long hexadecimal runs, copy numbers, rename tails and noise before ``&``."""
    value = let(without(clean(c), SOURCE_ARTIFACT), lambda v: F.when(has(v, f"^{DOMAIN}$"), "").otherwise(v))
    value = without(F.regexp_replace(without(value, HEX_NOISE), r"\s*\(\d+\)\s*$", ""), RENAME_TAIL)

    def real_side(v: Column) -> Column:
        left, right = before_first(v, " & ")
        return F.when(v.contains(" & ") & is_noise(left) & is_author_head(F.split(right, " - ")[0]), right).otherwise(v)

    return clean(let(value, real_side))


def is_author_like(c: Column) -> Column:
    """A segment that may name an author: plain letters, no publisher, no site, no year."""
    return let(strip_artifacts(c), lambda v: (v != "") & ~is_publisher(v) & ~is_artifact(v) & v.rlike("[A-Za-z]") & ~v.rlike(r"^\d{4}$"))


def clean_author(c: Column) -> Column:
    """An author segment without bracketed and trailing numbers and without a noisy side of ``&``."""
    value = F.regexp_replace(strip_artifacts(c), r"^\s*[\[(]\d{1,4}[\])]\s*", "")
    value = F.regexp_replace(F.regexp_replace(value, r"\s*[-,;]\s*\d+(?:\s*,\s*\d{4})?\s*$", ""), r"\s*,\s*\d{4}\s*$", "")

    def real_side(v: Column) -> Column:
        left, right = before_first(v, " & ")
        noisy = F.struct(is_noise(left).alias("l"), is_noise(right).alias("r"))
        return F.when(v.contains(" & "), let(noisy, lambda n: F.when(n["l"] & ~n["r"], right).when(n["r"] & ~n["l"], left).otherwise(v))).otherwise(v)

    return clean(let(value, real_side))


def strip_leading_index(c: Column) -> Column:
    """A title without the number in front of it; a title of nothing else stays."""
    return let(clean(c), lambda v: let(clean(group(v, LEADING_INDEX)), lambda rest: F.when(rest == "", v).otherwise(rest)))


def is_structural(c: Column) -> Column:
    """Nothing but words for volumes and numbers."""
    parts = lambda v: F.filter(F.transform(words(v), match_text), lambda w: w != "")
    return let(clean(c), lambda v: (v == "") | has(v, f"^{VOLUME}$") | F.forall(parts(v), lambda w: w.isin(STRUCTURAL) | w.rlike(r"^\d+$")))


def names_series_only(title: Column, series: Column, volume: Column) -> Column:
    """A title that is the series and its volume, in either order."""
    name, number = literal(clean_series(series)), F.concat(F.lit("(?:"), volume_pattern(volume), F.lit(")"))
    joint, word = r"\s*(?:[-_:,]\s*)?", rf"(?:{SERIES_WORD}\s*)?"
    whole = F.concat(F.lit(any_case("^(?:")), name, F.lit(joint + word), number, F.lit(f"|{word}"), number, F.lit(joint), name, F.lit(")$"))
    return (clean(title) != "") & (clean_series(series) != "") & volume.isNotNull() & F.coalesce(F.regexp_like(clean(title), whole), F.lit(False))


def turned_title(c: Column) -> Column:
    """A title whose first word was put last or whose last word was put first, in its right order."""
    return let(clean(c), lambda v: let(words(v), lambda parts: let(F.transform(parts, bare), lambda bares: _turned(v, parts, bares))))


def _turned(value: Column, parts: Column, bares: Column) -> Column:
    n = F.size(parts)
    first, last = F.try_element_at(bares, F.lit(1)), F.try_element_at(bares, F.lit(-1))
    to_end = F.concat_ws(" ", F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), F.slice(parts, 1, 1))
    linker = (
        (n >= 3) & F.lower(last).isin(LINKERS) & (F.length(first) >= 4) & F.try_element_at(parts, F.lit(1)).rlike(r"^\p{Lu}") & ~has(first, f"^{VOLUME}$")
        & F.exists(F.slice(bares, 2, F.greatest(n - 2, F.lit(0))), lambda w: F.length(w) >= 4)
    )
    return F.when(linker, clean(to_end)).otherwise(value)


def fronted_title(c: Column) -> Column:
    """A lower-case first word before a capitalised one goes to the end."""
    return let(clean(c), lambda v: let(words(v), lambda parts: let(F.transform(parts, bare), lambda bares: _fronted(v, parts, bares))))


def _fronted(value: Column, parts: Column, bares: Column) -> Column:
    fronted = (
        (F.size(parts) >= 2) & (F.length(F.try_element_at(bares, F.lit(1))) >= 3) & ~F.lower(F.try_element_at(bares, F.lit(1))).isin(LINKERS) & F.try_element_at(parts, F.lit(1)).rlike(r"^\p{Ll}")
        & (F.try_element_at(bares, F.lit(2)) != "") & F.try_element_at(parts, F.lit(2)).rlike(r"^\p{Lu}")
    )
    return F.when(fronted, clean(F.concat_ws(" ", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1)))).otherwise(value)


def sanitize_title(title: Column, series: Column, volume: Column) -> Column:
    """A title without genre tail, series and volume; empty if it was nothing else."""
    return let(without(without(strip_artifacts(title), GENRE_TAIL), SERIES_SUFFIX), lambda v: _sanitized(v, series, volume))


def _sanitized(value: Column, series: Column, volume: Column) -> Column:
    name, number = literal(series), volume_pattern(volume)
    prefix = F.concat(F.lit(any_case("^")), name, F.lit(r"\s+"), number, F.lit(r"\s*[:\-]\s*"))
    suffix = F.concat(F.lit(any_case(r"\s+")), name, F.lit(rf"\s*,?\s*{BOOK_WORD}\s*"), number, F.lit("$"))
    shorter = F.regexp_replace(F.regexp_replace(value, prefix, F.lit("")), suffix, F.lit(""))
    value = F.when((F.coalesce(series, F.lit("")) != "") & volume.isNotNull(), shorter).otherwise(value)
    return let(value, lambda v: F.when((v == "") | names_series_only(v, series, volume), "").otherwise(fronted_title(turned_title(v))))


def strip_author(title: Column, author: Column) -> Column:
    """A title without a leading author segment and without the outer words of the ``&``-joined authors."""
    return let(F.struct(_after_author(clean(title)).alias("t"), F.coalesce(author, F.lit("")).alias("a")), lambda v: _author_stripped(v["t"], v["a"]))


def _after_author(value: Column) -> Column:
    """What follows a leading author segment and a hyphen, else all."""

    def rest(v: Column) -> Column:
        left, right = before_first(v)
        return F.when(v.contains(" - ") & is_author_like(left), right).otherwise(v)

    return let(value, rest)


def _author_stripped(value: Column, author: Column) -> Column:
    names = F.transform(F.split(author, "&"), lambda a: F.filter(words(clean(a)), lambda w: F.length(w) > 1))
    outer = F.flatten(F.transform(F.filter(names, lambda n: F.size(n) >= 2), lambda n: F.array(F.element_at(n, 1), F.element_at(n, -1))))
    cut = F.aggregate(outer, value, lambda t, w: F.regexp_replace(t, F.concat(F.lit(any_case(r"\b")), literal(w), F.lit(r"\b")), F.lit("")))
    tidy = clean(F.regexp_replace(F.regexp_replace(cut, r"\s{2,}", " "), r"\s*[-,:]\s*$", ""))
    return F.when(author == "", clean(value)).otherwise(tidy)


def query_title(title: Column, author: Column, series: Column, volume: Column) -> Column:
    """The title as a search text: no noise in brackets, no author, series, volume or leading number."""
    first = _after_author(without(strip_artifacts(title), QUERY_NOISE))
    short = let(first, lambda v: let(sanitize_title(v, series, volume), lambda t: F.when(t == "", v).otherwise(t)))

    def after_series(v: Column) -> Column:
        lead, rest = clean(group(v, LEADING_SERIES, 1)), clean(group(v, LEADING_SERIES, 2))
        return F.when((rest != "") & (F.size(words(lead)) >= 2), rest).otherwise(v)

    return clean(strip_leading_index(let(strip_author(short, author), after_series)))


def _genre_places(keys: list[str]):
    """Function of a label and its index: where each keyword stands in it, from 1."""
    return lambda t, i: F.array(*[F.struct(F.instr(t, k).alias("at"), F.lit(len(k.split())).alias("n"), i.alias("label")) for k in keys])


def keyword_genre(labels: Column) -> Column:
    """Genre of an array of labels by keywords.

    A keyword found in a label counts its words; the most words win, then the
    earliest place, then any but the youth genre; fantasy beats science fiction
    where it does not stand later. Empty without a hit; NULL labels are skipped.
    """
    return let(F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), match_text), lambda x: x != ""), _genre)


def _genre(texts: Column) -> Column:
    found = []
    for i, (genre, keys) in enumerate(GENRES.items()):
        norm = [k.replace("-", " ") for k in keys]
        places = F.flatten(F.transform(texts, _genre_places(norm)))
        found.append(let(F.filter(places, lambda p: p["at"] > 0), _genre_score(i, genre)))
    # the earlier label, then the earlier genre, breaks what ties remain
    return let(F.filter(F.array(*found), lambda g: g["score"] > 0), _best_genre)


def _genre_score(i: int, genre: str):
    """Function of the hits of a genre: its score, place and what breaks ties."""
    return lambda hits: F.struct(
        F.aggregate(hits, F.lit(0), lambda s, p: s + p["n"]).alias("score"), (-F.array_min(F.transform(hits, lambda p: p["at"]))).alias("at"), F.lit(genre != "mlodziezowa").alias("grown"),
        (-(F.try_element_at(hits, F.lit(1))["label"] * 100 + i)).alias("order"), F.lit(genre).alias("genre"))


def _best_genre(hit: Column) -> Column:
    place = lambda name: F.array_max(F.transform(F.filter(hit, lambda g: g["genre"] == name), lambda g: g["at"]))
    return F.when(F.size(hit) == 0, "").when(place("fantasy") >= place("sci-fi"), "fantasy").otherwise(F.array_max(hit)["genre"])


def is_polish(texts: Column) -> Column:
    """Whether joined metadata texts look Polish: a letter with a Polish mark or one of a few words."""
    joined = F.array_join(F.filter(F.transform(texts, clean), lambda x: x != ""), " | ")
    # Words that mark Polish metadata.
    marks = r" (?:tom|czesc|ksiega|kategoria|cykl|powiesc|opowiadania) "
    return joined.rlike("[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]") | F.concat(F.lit(" "), F.lower(F.translate(joined, "ąćęłńóśźż", "acelnoszz")), F.lit(" ")).rlike(marks)


def best_likeness(text: Column, probes: Column) -> Column:
    """Greatest similarity of a text with an array of texts, 0 where either is empty."""
    keyed = lambda a: F.filter(F.transform(a, match_text), lambda x: x != "")
    return most_alike(keyed(F.array(text)), keyed(probes))


def leading_volume(c: Column) -> Column:
    """struct<volume, rest> of a text that starts with a number; NULL otherwise."""
    pattern = rf"^({VOLUME})[.)\s:_-]+\s*(.+)$"
    return let(clean(c), lambda v: F.when(has(v, pattern), F.struct(parse_volume(group(v, pattern, 1)).alias("volume"), clean(group(v, pattern, 2)).alias("rest"))))


def split_authors(c: Column) -> Column:
    """Authors of one cleaned text: a shared plural family name, strong separators, else commas between full names."""
    return let(F.regexp_replace(clean_author(c), r"\[.*?\]", ""), lambda t: let(words(t), lambda parts: _authors(t, parts)))


def _authors(text: Column, parts: Column) -> Column:
    given = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    n, at = F.size(given), F.array_position(F.transform(given, F.lower), "i")
    family = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    shared = F.lower(family).endswith("owie") & (F.length(family) > 4) & ~family.rlike("[,;]") & (at > 1) & (at < n)
    root = F.substring(family, F.lit(1), F.length(family) - 4)
    one = F.concat_ws(" ", F.slice(given, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))
    two = F.concat_ws(" ", F.slice(given, (at + 1).cast("int"), F.greatest(n - at, F.lit(0)).cast("int")))
    joined = F.regexp_replace(F.regexp_replace(text, ";", " & "), r"(?i)\s+(?:and|i)\s+", " & ")
    tidy = lambda sep: F.filter(F.transform(F.split(joined, sep), clean), lambda x: x != "")
    commas = tidy(",")
    full = ~joined.contains("&") & (F.size(commas) >= 2) & F.forall(commas, lambda x: F.size(words(x)) >= 2)
    return F.when(shared, F.array(clean(F.concat_ws(" ", one, root)), clean(F.concat_ws(" ", two, root)))).when(full, commas).otherwise(tidy("&"))


def distinct_labels(c: Column) -> Column:
    """Labels of one text between commas, semicolons, bars and line ends, the first of each match text."""
    return first_labels(F.split(F.coalesce(c, F.lit("")), r"[,;|\n]+"))


def first_labels(labels: Column) -> Column:
    """Cleaned labels, the first of each match text; those without one are left out."""
    parts = F.filter(F.transform(labels, clean), lambda x: match_text(x) != "")
    return let(parts, lambda p: let(F.transform(p, match_text), lambda keys: F.filter(p, lambda x, i: F.array_position(keys, F.try_element_at(keys, i + 1)) == i + 1)))


def series_index(volume: Column) -> Column:
    """``2.05`` of a volume; empty for NULL and 0.00."""
    minor = F.when(F.length(F.coalesce(volume["minor"], F.lit(""))) < 2, F.lpad(F.coalesce(volume["minor"], F.lit("")), 2, "0")).otherwise(volume["minor"])
    return F.when(volume.isNull() | ((volume["major"] == 0) & (minor == "00")), "").otherwise(F.concat(volume["major"].cast("string"), F.lit("."), minor))


def display_name(c: Column) -> Column:
    """Given names first, of a name in last-first form: the shortest given part whose turning gives the name again; else the name."""

    def turned(name: Column) -> Column:
        w = words(name)
        n = F.size(w)
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((n - i).alias("n"), F.element_at(w, F.least(i + 1, n)).alias("first"), clean_author(F.concat_ws(" ", F.slice(w, i + 1, n), F.slice(w, F.lit(1), i))).alias("x")))
        fits = F.filter(cuts, lambda k: ~F.rtrim(F.lower(k["first"]), F.lit(".")).isin(SURNAME_PARTICLES) & (match_text(last_first(k["x"])) == match_text(name)))
        best = F.array_min(F.transform(fits, lambda k: F.struct(k["n"].alias("n"), F.length(k["x"]).alias("m"), k["x"].alias("x"))))
        return F.when(n < 2, name).otherwise(F.coalesce(best["x"], name))

    return let(clean_author(c), turned)


def author_shape(authors: Column) -> Column:
    """struct<parts, long, letters> of ``&``-joined authors: names, words of three letters, letters less two per initial; particles do not count."""
    names = F.filter(F.transform(split_authors(authors), clean_author), lambda x: x != "")

    def shape(parts: Column) -> Column:
        real = F.filter(F.flatten(F.transform(parts, words)), lambda w: ~F.rtrim(F.lower(w), F.lit(".")).isin(SURNAME_PARTICLES))
        sizes = F.filter(F.transform(real, lambda w: F.length(F.regexp_replace(bare(w), r"(?U)\d", ""))), lambda k: k > 0)
        return let(sizes, lambda k: F.struct(F.size(parts).alias("parts"), F.size(F.filter(k, lambda x: x >= 3)).alias("long"), (F.aggregate(k, F.lit(0), lambda s, x: s + x) - 2 * F.size(F.filter(k, lambda x: x == 1))).alias("letters")))

    return let(names, shape)


def keeps_authors(current: Column, candidate: Column) -> Column:
    """Whether several authors are kept against a candidate with fewer names, fewer long words or clearly fewer letters."""
    pair = F.struct(author_shape(current).alias("a"), author_shape(candidate).alias("b"))
    return let(pair, lambda p: (p["a"]["parts"] >= 2) & (p["b"]["parts"] > 0) & ((p["b"]["parts"] < p["a"]["parts"]) | (p["b"]["long"] < p["a"]["long"]) | (p["b"]["letters"] + 3 < p["a"]["letters"])))
