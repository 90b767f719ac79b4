"""Matching two sources without keys by a label model over matching functions.

Blocking pairs rows that share a family name, give or take one edit, with a title
word or a volume of a series; rare title words alone; or a book number. Parts of titles that are series or
standing additions are learned from the tables and taken out of the titles
first. Each candidate pair gets a vote of every matching function. Pairs are
counted by vote pattern (at most 3 to the number of functions), and a generative
model is learned from the counts alone by expectation-maximisation. Its classes
are the match and the ways of being no match (another work of the author, a work
of another author with the same title, another volume, nothing in common), each
held to its meaning by limits of a few votes (``CLASSES``). Per class it learns each
function's votes, an abstention saying nothing, and, for the correlations, each
function's dependence on the one function it is most tied to within the classes
(a tree of largest conditional mutual information). The posterior of the class
of matches is the pair's confidence.

Defined results: empty titles fall back to the file name, an empty list of
creators to the persons named there; NULL arrays and fields abstain; repeated
rows are matched each; empty tables give no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folioforge.llm.work_features import FIELD, FUNCTIONS, ITEM, LISTS, book_claims, code_votes, online_claims, series_key, unpacked, vote_code
from folioforge.runtime import cut

_TEXTS = T.ArrayType(T.StringType())
_FIELDS = [(n, True) for n in ("titles", "parts", "authors", "persons", "isbns")] + [("whole", False), ("series", False)]
#: Types as objects: a type text would need a session when this module is imported.
CLAIMS = T.StructType([T.StructField(n, _TEXTS if many else T.StringType()) for n, many in _FIELDS] + [T.StructField("volume", T.IntegerType())])
_CLAIMS = pa.struct([(n, pa.list_(pa.string()) if many else pa.string()) for n, many in _FIELDS] + [("volume", pa.int32())])


@F.arrow_udf(CLAIMS)
def _book(title: pa.Array, stem: pa.Array, creators: pa.Array, identifiers: pa.Array, series: pa.Array, volume: pa.Array) -> pa.Array:
    return pa.array([book_claims(*r) for r in zip(*(x.to_pylist() for x in (title, stem, creators, identifiers, series, volume)))], _CLAIMS)


@F.arrow_udf(CLAIMS)
def _online(title: pa.Array, authors: pa.Array, identifiers: pa.Array, series: pa.Array, volume: pa.Array) -> pa.Array:
    return pa.array([online_claims(*r) for r in zip(*(x.to_pylist() for x in (title, authors, identifiers, series, volume)))], _CLAIMS)


@F.arrow_udf(_TEXTS)
def _series_keys(cells: pa.Array) -> pa.Array:
    return pa.array([sorted({k for x in c or [] if (k := series_key(x))}) for c in cells.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.IntegerType())
def _votes(b: pa.Array, o: pa.Array) -> pa.Array:
    return pa.array([vote_code(unpacked(x), unpacked(y)) for x, y in zip(b.to_pylist(), o.to_pylist())], pa.int32())


def _packed(**lists: str) -> Column:
    """Claims as the one text that ``unpacked`` reads."""
    every = [F.coalesce(F.array_join(lists.get(n, f"c.{n}"), ITEM), F.lit("")) if lists.get(n, n) else F.lit("") for n in LISTS]
    return F.concat_ws(FIELD, *every, "c.series", F.col("c.volume").cast("string"))


#: Share of persons up to which a name's outer word counts as a family name; the rarer of the two always does.
FAMILY = 0.001
_PERSONS = "if(size(c.authors) > 0, c.authors, c.persons)"
_ENDS = "array_distinct(filter(array(element_at(split(a, ' '), 1), element_at(split(a, ' '), -1)), x -> length(x) > 2))"


def _outer_words(rows: DataFrame) -> DataFrame:
    """(id, a, w): outer words of each person of a row."""
    return rows.select("id", F.explode(F.expr(_PERSONS)).alias("a")).select("id", "a", F.explode(F.expr(_ENDS)).alias("w"))


def learned_parts(rows: DataFrame) -> DataFrame:
    """(id, drop, series) of the rows whose title has parts that are no titles.

    A part is a series if some row of the author names it as one, or if it stands
    beside two or more different other parts with one author; it is a standing
    addition ("new edition") if it stands beside several others with any author
    and is never a whole title.
    """
    many = rows.where("size(c.parts) > 1").select("id", F.explode("c.parts").alias("p"), F.col("c.parts").alias("every")).select(
        "id", "p", F.explode(F.array_except("every", F.array("p"))).alias("other"))
    person = _outer_words(rows).select("id", F.col("w").alias("f")).distinct()
    told = rows.select("id", F.explode(F.array_union(F.array("c.series"), F.coalesce("g", F.array().cast("array<string>")))).alias("p")).where("p <> ''")
    told = told.join(person, "id").select("f", "p").distinct()
    beside = many.join(person, "id").groupBy("f", "p").agg(F.countDistinct("other").alias("n")).where("n > 1").select("f", "p")
    series = many.select("id", "p").join(person, "id").join(told.union(beside).distinct(), ["f", "p"], "left_semi").select("id", "p", F.lit(True).alias("s"))
    whole = rows.select(F.col("c.whole").alias("p")).where("p <> ''").distinct()
    common = many.groupBy("p").agg(F.countDistinct("other").alias("n")).where("n > 2").join(whole, "p", "left_anti")
    extra = many.select("id", "p").join(common, "p", "left_semi").select("id", "p", F.lit(False).alias("s"))
    found = series.union(extra).groupBy("id").agg(F.collect_set("p").alias("drop"), F.min(F.when(F.col("s"), F.col("p"))).alias("series"))
    return found


def without_parts(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """The rows with series and additions out of their titles, unless no title is left."""
    rest = F.array_except("c.titles", F.coalesce("drop", F.array().cast("array<string>")))
    c = F.col("c").withField("titles", F.when(F.size(rest) > 0, rest).otherwise(F.col("c.titles"))).withField(
        "series", F.when(F.col("c.series") == "", F.coalesce("series", F.lit(""))).otherwise(F.col("c.series")))
    return rows.join(learned, "id", "left").select("id", c.alias("c"), "g")


def carried_titles(rows: DataFrame) -> DataFrame:
    """Titles (t) that stand with persons of several family names that share no other title word or spelling."""
    held = rows.select("id", F.explode("c.titles").alias("t"), F.expr(_PERSONS).alias("p"))
    names = held.select("t", F.explode("p").alias("a")).select("t", F.explode(F.expr(_ENDS)).alias("w")).groupBy("t", "w").agg(F.count(F.lit(1)).alias("n"))
    rows_of = held.where("size(p) > 0").groupBy("t").agg(F.count(F.lit(1)).alias("rows"))
    # one work's author is on most of its rows, several authors share them out
    return names.groupBy("t").agg(F.max("n").alias("n")).join(rows_of, "t").where("n < 0.7 * rows").select("t")


_LESS = "array_union(array({0}), if(length({0}) < 5, array(), transform(sequence(1, length({0})), i -> concat(substring({0}, 1, i - 1), substring({0}, i + 1)))))"


def _families(b: DataFrame, o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, f): the words that can be a person's family name, those of books as the online rows spell them.

    Words of one edit share what is left of them without one letter; only the
    distinct words meet for that.
    """
    sides = [_outer_words(x) for x in (b, o)]
    df = cut(sides[0].select("w").unionAll(sides[1].select("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")), "person-words")
    floor = max(8.0, FAMILY * (df.agg(F.sum("df")).first()[0] or 0) / 2)
    rarest = F.min("df").over(Window.partitionBy("id", "a"))
    kept = [x.join(df, "w").withColumn("least", rarest).where((F.col("df") <= floor) | (F.col("df") == F.col("least"))).select("id", "w").distinct() for x in sides]
    left, right = (cut(x, "families") for x in kept)
    less = [x.select("w").distinct().select(F.col("w").alias(n), F.explode(F.expr(_LESS.format("w"))).alias("d")) for x, n in ((left, "w"), (right, "f"))]
    near = less[0].join(less[1], "d").select("w", "f").distinct()
    return left.join(near, "w").select("id", "f").distinct(), right.select("id", F.col("w").alias("f"))


def _block_keys(rows: DataFrame, df: DataFrame, families: DataFrame) -> DataFrame:
    """(id, key, need, nameless, joint) of the rows; ``df`` counts each title word.

    A row of one title with three rare words has their three pairs as keys, and all must be met where
    the other row has no other: between two such rows the ``joint`` key of all three decides, and the pairs need not meet.
    """
    titles = rows.select("id", F.explode("c.titles").alias("t")).distinct()
    # a word of one row alone can meet none
    word = titles.select("id", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w")).where("length(w) >= 3").join(df.where("df > 1"), "w")
    rare = word.groupBy("id", "t").agg(F.transform(F.slice(F.array_sort(F.collect_set(F.struct("df", "w"))), 1, 3), lambda x: x["w"]).alias("r"))
    two = rare.select("id", F.explode(F.expr(
        "flatten(transform(r, x -> transform(filter(r, y -> y > x), y -> concat(x, ' ', y))))")).alias("key"),
        F.when(F.size("r") > 2, 3).otherwise(1).alias("need"))
    # with a family name any title word is enough, of a title of one word what is left without one letter, or the place in a series
    lone = titles.where("instr(t, ' ') = 0 AND length(t) >= 5").select("id", F.explode(F.expr(_LESS.format("t"))).alias("k"))
    placed = rows.where("c.series <> '' AND c.volume > 0").select("id", F.concat(F.lit("#"), "c.series", F.lit(" "), "c.volume").alias("k"))
    with_family = word.select("id", F.col("w").alias("k")).union(lone.select("id", F.concat(F.lit("~"), "k"))).union(placed).distinct()
    family = families.join(with_family, "id").select("id", F.concat(F.lit("@"), "f", F.lit(" "), "k").alias("key"), F.lit(0).alias("need"))
    isbn = rows.select("id", F.explode("c.isbns").alias("key"), F.lit(0).alias("need"))
    keys = two.union(family).union(isbn).groupBy("id", "key").agg(F.min("need").alias("need"))
    every = cut(keys.join(rows.select("id", (F.size(F.expr(_PERSONS)) == 0).alias("nameless")), "id"), "row-keys")
    one = every.where("need = 3 AND NOT nameless").groupBy("id").agg(F.collect_list("key").alias("three")).where("size(three) = 3")
    one = one.select("id", F.concat(F.lit("&"), F.array_join(F.array_sort("three"), " ")).alias("key"))
    tagged = every.join(one.select("id", F.lit(True).alias("one")), "id", "left").select("id", "key", "need", "nameless", (F.col("one").isNotNull() & (F.col("need") == 3)).alias("joint"))
    return tagged.unionByName(one.select("id", "key", F.lit(3).alias("need"), F.lit(False).alias("nameless"), F.lit(False).alias("joint")))


def candidates(b: DataFrame, o: DataFrame, df: DataFrame) -> DataFrame:
    """(book_id, online_id) of the pairs worth a vote.

    A book number, or a family name (one edit allowed) with a title word or the place in a
    series, is enough; without either all rare title words must agree, or two where a side names no person.
    """
    of_b, of_o = _families(b, o)
    # written between the steps, so that no plan holds all of them: the driver's memory goes with the size of a plan
    left = cut(_block_keys(b, df, of_b), "book-keys").select("key", F.col("id").alias("book_id"), F.col("need").alias("n1"), F.col("nameless").alias("l1"), F.col("joint").alias("j1"))
    right = cut(_block_keys(o, df, of_o), "online-keys").select("key", F.col("id").alias("online_id"), F.col("need").alias("n2"), F.col("nameless").alias("l2"), F.col("joint").alias("j2"))
    met = left.join(right, "key").where("NOT (j1 AND j2)").groupBy("book_id", "online_id").agg(
        F.sum(F.when(F.col("key").startswith("&"), 3).otherwise((F.col("n1") > 0).cast("int"))).alias("n"), F.min(F.least("n1", "n2")).alias("need"), F.max(F.col("l1") | F.col("l2")).alias("nameless"))
    return met.where("need = 0 OR n >= need OR nameless").select("book_id", "online_id")


#: The classes, and in each the greatest share of votes of one kind: what makes the class what it is.
CLASSES = {
    "match": {("title_close", -1): 0.05, ("title_words", -1): 0.05, ("author", -1): 0.01, ("volume", -1): 0.002, ("series", -1): 0.2},
    "other work": {("title_equal", 1): 0.01, ("title_close", 1): 0.05, ("isbn", 1): 0.05},
    "other author": {("author", 1): 0.01, ("isbn", 1): 0.05},
    "other volume": {("volume", 1): 0.01, ("volume", 0): 0.02, ("isbn", 1): 0.2},
    "unrelated": {("author", 1): 0.01, ("title_equal", 1): 0.01, ("isbn", 1): 0.05},
}


def _first_guess(patterns: np.ndarray) -> np.ndarray:
    """Posteriors (pattern, class) to start from: the vote that tells each kind of no match."""
    at = {f: patterns[:, i] for i, f in enumerate(FUNCTIONS)}
    same = at["isbn"] == 1
    volume = at["volume"] == -1
    author = (at["author"] == -1) & ~same
    work = (at["title_close"] < 1) & ((at["title_words"] < 1) | (at["title_close"] < 0)) & ~same
    kind = np.select([author & work, volume, author, work], [4, 3, 2, 1], 0)
    return np.where(kind[:, None] == np.arange(len(CLASSES)), 0.96, 0.01)


def _bounded(rate: np.ndarray, limits: dict, i: int) -> np.ndarray:
    """Rates (parent's vote, against or for) of one function within the limits of a class."""
    for vote, side in ((-1, 0), (1, 1)):
        if (most := limits.get((FUNCTIONS[i], vote))) is not None:
            rate[:, side] = np.minimum(rate[:, side], most)
            rate[:, 1 - side] = 1 - rate[:, side]
    return rate


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of match for each vote pattern (rows of -1, 0, 1)."""
    n, m = patterns.shape
    if not n:
        return np.zeros(0)
    v, every = patterns + 1, np.zeros(n, int)
    said = patterns != 0
    silent = np.clip(counts @ ~said / counts.sum(), 0.01, 0.99)
    post = _first_guess(patterns)
    parent = np.full(m, -1)
    for k in range(rounds):
        weight = counts[:, None] * post
        if k == rounds // 2:
            parent = _tree(v, weight.T)
        prior = weight.sum(0) + 1.0
        logit = np.tile(np.log(prior / prior.sum()), (n, 1))
        for y, limits in enumerate(CLASSES.values()):
            for i in range(m):
                w = np.where(said[:, i], weight[:, y], 0.0)
                at = v[:, parent[i]] if parent[i] >= 0 else every
                table = np.zeros((3, 3))
                np.add.at(table, (at, v[:, i]), w)
                # the dependence is pulled towards the function's own rate where the parent's vote is rare
                alone = np.bincount(v[:, i], weights=w, minlength=3)[[0, 2]] + 0.5
                rate = (table[:, [0, 2]] + 5 * alone / alone.sum()) / (table[:, [0, 2]].sum(1, keepdims=True) + 5)
                rate = _bounded(rate, limits, i)
                if (most := limits.get((FUNCTIONS[i], 0))) is not None:
                    # an abstention tells only where a class by its meaning has few
                    few = min(most, silent[i])
                    logit[:, y] += np.where(said[:, i], np.log((1 - few) / (1 - silent[i])), np.log(few / silent[i]))
                logit[:, y] += np.where(said[:, i], np.log(rate[at, v[:, i] // 2]), 0.0)
        post = np.exp(logit - logit.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    return post[:, 0]


def _tree(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Parent of each function: maximum spanning tree of conditional mutual information."""
    m = v.shape[1]
    total = sum(w.sum() for w in weight)
    info = np.zeros((m, m))
    for w in weight:
        for i in range(m):
            for j in range(i):
                joint = np.zeros((3, 3))
                np.add.at(joint, (v[:, i], v[:, j]), w)
                q = (joint + 1e-9) / (joint.sum() + 9e-9)
                base = q.sum(1, keepdims=True) * q.sum(0, keepdims=True)
                info[i, j] += w.sum() / total * (q * np.log(q / base)).sum()
    info += info.T
    parent, inside = np.full(m, -1), {0}
    while len(inside) < m:
        i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda x: info[x])
        parent[j] = i
        inside.add(j)
    return parent


def blocked(books: DataFrame, guesses: DataFrame, online: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The claims of both sides and the pairs (book_id, online_id) worth a vote."""
    held = guesses.where("series is not null").groupBy("book_id").agg(F.collect_set("series").alias("g"))
    b = books.select("book_id", _book("title", "stem", "creators", "identifiers", "meta_series", "meta_volume").alias("c"))
    b = cut(b.join(held, "book_id", "left").select(F.concat(F.lit("b"), F.col("book_id").cast("string")).alias("id"), "c", _series_keys("g").alias("g")), "books")
    o = online.select(F.concat(F.lit("o"), F.col("online_id").cast("string")).alias("id"), _online("title", "authors", "identifiers", "series", "volume").alias("c"))
    o = cut(o.withColumn("g", F.lit(None).cast("array<string>")), "online")
    learned = cut(learned_parts(b.unionByName(o)), "title-parts")
    b, o = (cut(without_parts(x, learned).withColumn("id", F.substring("id", 2, 2**31 - 1).cast(kind)), "works") for x, kind in (
        (b, books.schema["book_id"].dataType), (o, online.schema["online_id"].dataType)))
    titles = b.select("c.titles").union(o.select("c.titles"))
    df = cut(titles.select(F.explode(F.array_distinct(F.split(F.array_join("titles", " "), " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")), "title-words")
    return b, o, candidates(b, o, df)


def link_works(books: DataFrame, guesses: DataFrame, online: DataFrame) -> DataFrame:
    """(book_id, online_id, votes..., confidence) of every candidate pair."""
    spark = books.sparkSession
    b, o, pairs = blocked(books, guesses, online)
    carried = carried_titles(b.select("id", "c").unionByName(o.select(F.col("id").cast("string").alias("id"), "c")))
    common = b.select("id", F.explode("c.titles").alias("t")).join(carried, "t", "left_semi").groupBy("id").agg(F.collect_list("t").alias("carried"))
    b, pairs = cut(b.join(common, "id", "left"), "carried"), cut(pairs, "pairs")
    # so many partitions whatever their bytes: the votes take time by the pairs
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    voted = (
        pairs.join(b.select(F.col("id").alias("book_id"), _packed(guesses="g", carried="carried").alias("bc")), "book_id")
        .repartition(parts, "online_id")
        .join(o.select(F.col("id").alias("online_id"), _packed(guesses="", carried="").alias("oc")), "online_id")
        .select("book_id", "online_id", _votes("bc", "oc").alias("v"))
    )
    voted = cut(voted, "votes")
    rows = voted.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([code_votes(r["v"]) for r in rows], int).reshape(-1, len(FUNCTIONS))
    post = learn(patterns, np.array([r["n"] for r in rows], float))
    known = spark.createDataFrame([(r["v"], *code_votes(r["v"]), float(p)) for r, p in zip(rows, post)], ", ".join(["v int", *(f"{f} int" for f in FUNCTIONS), "confidence double"]))
    return voted.join(F.broadcast(known), "v").select("book_id", "online_id", *FUNCTIONS, "confidence")


def matches(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs held to be one work."""
    return scored.where(F.col("confidence") >= least)
