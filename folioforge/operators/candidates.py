"""Series and title guesses of a book: rules as data over title, core and segments, and the best guess."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import clean, clean_series, let, match_text, parse_volume
from folioforge.functions.titles import (
    BOOK_WORD, PART_WORD, SERIES_WORD, VOLUME, best_likeness, group, has, is_artifact, is_author_like, is_publisher, leading_volume, strip_artifacts, strip_leading_index, words)


@dataclass(frozen=True)
class Rule:
    """A tagged pattern and the groups that hold series, volume and title (0: none)."""

    tag: str
    score: int
    pattern: str
    series: int
    volume: int
    title: int = 0


_BOX = r"^(.*?)\s+(The Complete Series|Complete Series|Omnibus|Box Set)(?:\s*[-:]\s*(.*?))?(?:\s*\([^)]*\))?$"
_PAREN = rf"^(.*?)\s*\(([^()]+?)\s*{SERIES_WORD}\s*({VOLUME})\)\s*$"
# Tags, scores and patterns of the rules, in the order they are tried.
TITLE_RULES = (
    Rule("title:dotted-series-book", 97, rf"^(.*?)\.\s*{PART_WORD}\s*({VOLUME})\.\s*(.+)$", 1, 2, 3),
    Rule("title:double-colon-book", 98, rf"^(.*?)\s*:\s*(.+?)\s*:\s*{BOOK_WORD}\s*({VOLUME})(?:\s*\([^)]*\))?$", 2, 3, 1),
    Rule("title:square-bracket-series-book", 96, "", 0, 0),
    Rule("title:trailing-series-book", 95, rf"^(.*?)\s*,?\s*{BOOK_WORD}\s*({VOLUME})(?:\s*\[[^\]]+\])?$", 0, 2),
    Rule("title:series-book", 93, rf"^(.*?)\s*:\s*(.+?)\s*\(\s*{SERIES_WORD}\s*({VOLUME})\s*\)\s*$", 2, 3, 1),
    Rule("title:paren-series", 92, _PAREN, 2, 3, 1),
    Rule("title:series-index-only", 91, rf"^(.+?)\s*\(\s*{PART_WORD}\s*({VOLUME})\s*\)\s*$", 1, 2),
    Rule("title:colon-series-index", 94, rf"^(.*?)\s*:\s*(.+?)\s*,\s*{SERIES_WORD}\s*({VOLUME})\s*$", 2, 3, 1),
    Rule("title:leading-index-dotted", 89, "", 0, 0),
    Rule("title:indexed", 86, rf"^(.+?)\s+({VOLUME})\s*[:\-]\s*(.+)$", 1, 2, 3),
    Rule("title:index-only", 78, rf"^(.+?)\s*[-:]\s*({VOLUME})$", 1, 2),
    Rule("title:box-set", 82, _BOX, 1, 0, 2),
)
CORE_RULES = (
    Rule("core:box-set", 81, _BOX, 1, 0, 2),
    Rule("core:paren-series", 90, _PAREN, 2, 3, 1),
    Rule("core:title-author", 91, rf"^(.+?)\s+({VOLUME})\s+(.+?)\s+-\s+(.+)$", 1, 2, 3),
    Rule("core:comma", 87, rf"^(.+?)\s+({VOLUME})\s*,\s*(.+)$", 1, 2, 3),
    Rule("core:joined", 88, rf"^(.+?)\s+({VOLUME})\s*[-_:]\s*(.+)$", 1, 2, 3),
    Rule("core:spaced", 80, rf"^(.+?)\s+({VOLUME})\s+(.+)$", 1, 2, 3),
    Rule("core:index-only", 76, rf"^(.+?)\s+({VOLUME})$", 1, 2),
)
SEGMENT_RULES = (
    Rule("segment:hash", 74, rf"(.+?)\s*#\s*({VOLUME})\b", 1, 2),
    Rule("segment:comma", 72, rf"^([^,]{{3,}}?),\s*({VOLUME})\s*(?:,|$)", 1, 2),
    Rule("segment:year", 75, rf"^(.+?)\s+({VOLUME})\s*,\s*\d{{4}}\b", 1, 2),
)
_GENERIC_END = r"(?:^|[\s,._-])(?:book|tom|volume|vol\.?|part|cykl|czesc|część|ksiega|księga)\s*$"
# Trust in the rules when a series is chosen.
SERIES_PRIORITY = {
    "opf": 140, "title:series-book": 136, "title:dotted-series-book": 135, "title:paren-series": 132, "title:colon-series-index": 130,
    "title:series-index-only": 128, "core:paren-series": 126, "segment:hash": 122, "segment:year": 118, "segment:comma": 116, "core:comma": 110,
    "core:joined": 106, "title:indexed": 104, "title:index-only": 100, "core:spaced": 92, "core:index-only": 88,
}


def _raw(rule: Rule, series: Column, number: Column | None, title: Column | None, hit: Column) -> Column:
    """A guess before its volume is read; ``free`` guesses need no volume."""
    return F.when(hit, F.struct(
        F.lit(rule.score).alias("score"), F.lit(rule.tag).alias("tag"), series.alias("series"), (F.lit("") if number is None else number).alias("number"),
        (F.lit("") if title is None else title).alias("title"), F.lit(number is None).alias("free")))


def _by_pattern(rule: Rule, text: Column, guard: Column | None = None) -> Column:
    part = lambda n: group(text, rule.pattern, n) if n else None
    hit = has(text, rule.pattern)
    return _raw(rule, part(rule.series), part(rule.volume), part(rule.title), hit if guard is None else hit & guard)


def bracket_parts(text: Column) -> Column:
    """struct<title, series, number> of ``[Series 2] Title`` or ``Title [Series (2)]``, NULL otherwise."""

    def payload(inner: Column, title: Column) -> Column:
        return let(F.struct(group(clean(inner), r"^(?:(?:cykl|seria)\s*[-:\s]+)?(.*)$").alias("n"), clean(title).alias("t")), lambda v: parts(v["n"], v["t"]))

    def parts(name: Column, title: Column) -> Column:
        round_series, round_number = clean_series(group(name, r"^(.*?)\s*\(([^()]+)\)\s*$", 1)), group(name, r"^(.*?)\s*\(([^()]+)\)\s*$", 2)
        tail = r"^(.*?)\s+(\d+(?:\.\d+)?|[IVXLCDM]+)\s*$"
        tail_series, tail_number = clean_series(group(name, tail, 1)), group(name, tail, 2)
        whole = lambda s, n: F.struct(title.alias("title"), s.alias("series"), n.alias("number"))
        return F.when(title == "", None).when((round_series != "") & parse_volume(round_number).isNotNull(), whole(round_series, round_number)).when(
            (tail_series != "") & parse_volume(tail_number).isNotNull(), whole(tail_series, tail_number))

    before, after = r"^\[([^\]]+)\]\s*(.+)$", r"^(.*?)\s*\[([^\]]+)\]\s*$"
    return let(clean(text), lambda v: F.coalesce(payload(group(v, before, 1), group(v, before, 2)), payload(group(v, after, 2), group(v, after, 1))))


def trailing_parts(body: Column) -> Column:
    """struct<title, series>: the best place to cut ``Title Series``, the first of equal ones; NULL under three words."""
    return let(words(clean(body)), _trailing)


def _trailing(parts: Column) -> Column:
    n = F.size(parts)
    # Words that may stand in lower case within a series name.
    joiners = ["of", "the", "and", "a", "an", "&"]

    def at(i: Column) -> Column:
        cut = F.struct(clean(F.concat_ws(" ", F.slice(parts, F.lit(1), i))).alias("t"), clean_series(F.concat_ws(" ", F.slice(parts, i + 1, n))).alias("s"))
        return let(cut, lambda v: scored(i, v["t"], v["s"]))

    def scored(i: Column, title: Column, series: Column) -> Column:
        names = words(series)
        shaped = F.size(F.filter(names, lambda w: w.rlike(r"^[\p{Lu}(\[]") | F.lower(w).isin(joiners)))
        score = F.when(has(series, r"^(?:The|A|An)\b"), 30).otherwise(0) + F.when(F.size(names).between(2, 5), 20).otherwise(0) + shaped
        ok = (title != "") & (F.size(names) >= 2) & ~is_publisher(series)
        return F.when(ok, F.struct(score.alias("score"), (-i).alias("at"), title.alias("title"), series.alias("series")))

    best = F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), at), lambda x: x.isNotNull()))
    return F.when(n >= 3, let(best, lambda b: F.struct(b["title"].alias("title"), b["series"].alias("series"))))


def _from_brackets(rule: Rule, title: Column) -> Column:
    return let(bracket_parts(title), lambda b: _raw(rule, b["series"], b["number"], b["title"], b.isNotNull()))


def _from_tail(rule: Rule, title: Column) -> Column:
    found = F.when(has(title, rule.pattern), trailing_parts(group(title, rule.pattern, 1)))
    return let(found, lambda t: _raw(rule, t["series"], group(title, rule.pattern, 2), t["title"], t["series"].isNotNull()))


def _from_index(rule: Rule, title: Column) -> Column:
    parts = F.filter(F.transform(F.split(leading_volume(title)["rest"], r"\."), clean), lambda x: x != "")
    number = group(title, rf"^({VOLUME})[.)\s:_-]+\s*(.+)$", 1)
    rest = lambda p: F.concat_ws(". ", F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    return let(parts, lambda p: _raw(rule, F.try_element_at(p, F.lit(1)), number, rest(p), (F.size(p) >= 2) & F.size(words(F.try_element_at(p, F.lit(1)))).between(1, 4)))


_OWN_WAY = {"title:square-bracket-series-book": _from_brackets, "title:trailing-series-book": _from_tail, "title:leading-index-dotted": _from_index}


def _title_guesses(title: Column) -> list[Column]:
    out = []
    for rule in TITLE_RULES:
        if rule.tag in _OWN_WAY:
            out.append(_OWN_WAY[rule.tag](rule, title))
        else:
            out.append(_by_pattern(rule, title, ~clean(group(title, rule.pattern, 3)).rlike(r"^\d") if rule.tag == "title:indexed" else None))
    return out


def _core_guesses(core: Column) -> list[Column]:
    out = []
    for rule in CORE_RULES:
        guard = None
        if rule.tag in ("core:title-author", "core:comma", "core:joined", "core:spaced"):
            guard = ~has(clean(group(core, rule.pattern, 1)), _GENERIC_END)
            if rule.tag != "core:comma":
                guard = guard & ~clean(group(core, rule.pattern, 3)).rlike(r"^\d+\b")
            if rule.tag == "core:title-author":
                guard = guard & is_author_like(group(core, rule.pattern, 4))
        out.append(_by_pattern(rule, core, guard))
    return out


def _segment_guesses(segments: Column) -> Column:
    kept = F.transform(F.slice(segments, 3, 4), strip_artifacts)
    kept = F.filter(kept, lambda s: (s != "") & ~is_artifact(s) & ~is_publisher(s))
    return F.flatten(F.transform(kept, lambda s: F.array(*[_by_pattern(r, s) for r in SEGMENT_RULES])))


_READ = "array<struct<score:int,source:string,series:string,volume:struct<major:int,minor:string>,title:string>>"


def _read(raw: Column) -> Column:
    """Guesses with series and, but for free ones, a volume; their texts cleaned."""
    found = F.filter(raw, lambda g: g.isNotNull() & (clean_series(g["series"]) != ""))
    read = F.transform(found, lambda g: F.struct(
        g["score"].alias("score"), g["tag"].alias("source"), clean_series(g["series"]).alias("series"), parse_volume(g["number"]).alias("volume"), clean(g["title"]).alias("title"), g["free"].alias("free")))
    return F.transform(F.filter(read, lambda g: g["free"] | g["volume"].isNotNull()), lambda g: g.dropFields("free"))


def title_guesses(title: Column) -> Column:
    """The guesses of a title alone."""
    return _read(let(clean(title), lambda t: F.array(*_title_guesses(t))))


def name_guesses(core: Column, segments: Column) -> Column:
    """The guesses of a file name's core and segments."""
    return _read(F.concat(let(clean(core), lambda t: F.array(*_core_guesses(t))), _segment_guesses(F.coalesce(segments, F.array().cast("array<string>")))))


def own_guess(series: Column, volume: Column) -> Column:
    """The series of the file's own metadata as an array of one guess, empty if it is empty or looks like a publisher."""
    own = lambda s: F.struct(F.lit(100).alias("score"), F.lit("opf").alias("source"), s.alias("series"), volume.alias("volume"), F.lit("").alias("title"))
    return let(clean_series(series), lambda s: F.when((s != "") & ~is_publisher(s), F.array(own(s))).otherwise(F.array().cast(_READ)))


def guesses(title: Column, core: Column, segments: Column, series: Column, volume: Column) -> Column:
    """Array of struct<score, source, series, volume, title>: the file's own series, then all rules that fit in their order.

    NULL and empty texts give no guesses.
    """
    return F.concat(own_guess(series, volume), title_guesses(title), name_guesses(core, segments))


def rule_candidates(books: DataFrame, key: str, *extra: str) -> DataFrame:
    """(key, pos, score, series, volume, title_override, source, extra...) of every book and rule that fits."""
    g = guesses(F.col("title"), F.col("core"), F.col("segments"), F.col("meta_series"), F.col("meta_volume"))
    rows = books.select(key, *extra, F.posexplode(g).alias("pos", "g"))
    return rows.select(key, "pos", F.col("g.score").alias("score"), F.col("g.series").alias("series"), F.col("g.volume").alias("volume"), F.col("g.title").alias("title_override"), F.col("g.source").alias("source"), *extra)


def _priority(source: Column, score: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in SERIES_PRIORITY.items() for x in kv])
    return F.coalesce(F.element_at(ranks, source), score)


_GUESS = ("score", "series", "volume", "title_override", "source", "pos")


def _best(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The guess of each key that is greatest in ``order``, the first of equal ones."""
    keys = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], (-F.col("pos")).alias("first"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*_GUESS), keys).alias("b")).select(key, "b.*")


def top_series(rows: DataFrame, key: str) -> DataFrame:
    """The series guess of most trusted source, then score, then with a title."""
    return _best(rows, key, [_priority(F.col("source"), F.col("score")), F.col("score"), F.col("title_override") != ""])


def top_title(rows: DataFrame, key: str) -> DataFrame:
    """The guess with a title of greatest score, then longest title."""
    return _best(rows.where("title_override <> ''"), key, [F.col("score"), F.length("title_override")])


def _probes() -> Column:
    """Texts a guess is compared with; ``rows`` carries title and core of the book."""
    return F.filter(F.array(clean(F.col("title")), clean(F.col("core")), strip_leading_index(F.col("title")), strip_leading_index(F.col("core"))), lambda x: x != "")


def local_series(rows: DataFrame, key: str) -> DataFrame:
    """The series guess that fits the book's own title and core best; ``rows`` has guesses with title and core."""
    own, title = match_text(F.col("series")), clean(F.col("title_override"))
    with_probes = rows.select(key, *_GUESS, _probes().alias("probes")).withColumn("like", best_likeness(title, F.col("probes")))
    n = F.size(words(F.col("series")))
    signal = (
        F.when((own != "") & F.exists("probes", lambda p: match_text(p).contains(own)), 12).otherwise(0)
        + F.when(title != "", F.when(is_author_like(title), -22).otherwise(0) + (F.col("like") * 10).cast("int") + F.when(match_text(title) == own, -10).otherwise(0)).otherwise(0)
        + F.when(F.col("source").startswith("title:"), 6).when(F.col("source").startswith("segment:"), -4).otherwise(0)
        - F.when(n > 6, F.least(F.lit(18), (n - 6) * 3)).otherwise(0)
    )
    scored = with_probes.withColumn("signal", signal)
    return _best(scored, key, [_priority(F.col("source"), F.col("score")) + F.col("signal"), F.col("score") + F.col("signal"), F.col("title_override") != "", -n])


def local_title(rows: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """The title guess that fits the chosen series and the book's own texts best; author-like titles come last."""
    title = clean(F.col("title_override"))
    held = rows.where("title_override <> ''").join(chosen.select(key, F.col("series").alias("chosen")), key, "left").select(key, *_GUESS, "chosen", _probes().alias("probes"))
    held = held.withColumn("like", best_likeness(title, F.col("probes")))
    good = (title != "") & ~is_author_like(title)
    order = [(match_text(F.col("series")) == match_text(F.coalesce("chosen", F.lit("")))).cast("int"),
             F.exists("probes", lambda p: match_text(p) == match_text(title)).cast("int"), (F.col("like") * 100).cast("int") + F.col("score")]
    return _best(held, key, [F.when(good, c).otherwise(-(10**9)) for c in order])
