"""Variant spellings of names: n-gram vectors, sparse cosine join, average linkage.

Every name is a set of folded words. Its vector has the padded character
4-grams of each word, told apart by the first letters of the other words, and
each whole word; a feature's weight is its squared inverse document frequency
less that of a feature in ``COMMON`` of all names, so what is common weighs
nothing. A link needs a cosine of ``COSINE`` and the rules (``name_rules``), which accept
what can be one author's. The names that share features grow with the square of the names,
so the rules come first: names meet by the family word, give or take one edit, and leave the join where
their first given names agree (``rule_pairs``); the cosine is summed for the pairs that the rules accepted.
Where a family name itself is that common its names need no cosine and meet by
the family word with a key of the first given name (``given_keys``). No top-n cap is
set, since names of frequent families would lose true partners. Accepted links form connected
components, and each is cut by average linkage over the likeness of all its
pairs, so one stray link does not join two authors.

Defined results: NULL and letterless names have no vector and no links; a name of
a single word links to nothing but its own reorderings; repeated names count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from folioforge.llm.name_rules import GIVEN_NAMES, SHORT_FORMS, deletions, edits, full_forms, given_keys, likeness
from folioforge.runtime import cut

#: Share of names from which a feature weighs nothing, and the least such count.
COMMON, LEAST = 0.0004, 24
#: Share of names from which a word that does not stand as a family name counts as a common given name; at most words-per-name / share of them.
GIVEN = 0.0008
COSINE = 0.25
LINKED = 0.45
#: Components up to this many names are compared in the task that clusters them, larger ones by blocks of so many names.
ALL_PAIRS = 300


def _features(names: DataFrame) -> DataFrame:
    """(id, feature) of each name, every feature once; ``names`` has id and words."""
    other = "array_distinct(transform(filter(words, (o, m) -> m <> j), o -> substring(o, 1, 1)))"
    grams = f"""transform(filter(transform(words, (w, j) -> named_struct('w', w, 'p', concat('^', w, '$'), 'ctx', if(size(words) > 1, {other}, array('')))), x -> length(x.w) >= 3),
        x -> array_union(array(x.p), flatten(transform(sequence(1, length(x.p) - 3), i -> transform(x.ctx, c -> concat(c, ' ', substring(x.p, i, 4)))))))"""
    return names.select("id", F.explode(F.expr(f"array_distinct(flatten({grams}))")).alias("feature"))


def vectors(names: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, feature, w), weights of unit length; ``names`` has id and words. All of them count for the weights, those whose id is in ``of`` get vectors."""
    n = names.count()
    floor = max(LEAST, COMMON * n)
    df = _features(names).groupBy("feature").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") > 1) & (F.col("df") <= floor))
    feats = _features(names.join(of, "id", "left_semi") if of else names)
    weighted = feats.join(df, "feature").withColumn("w", F.pow(F.log(F.lit(n + 1.0) / F.col("df")), 2) * F.when(F.col("feature").startswith("^"), 2.0).otherwise(1.0))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "feature", (F.col("w") / F.col("norm")).alias("w"))


def cosine_pairs(vec: DataFrame, least: float = COSINE, of: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine) of the pairs (of the pairs (a, b) in ``of``) that share weighted features, a < b."""
    # products in units of 1e-12: sums that do not depend on their order, and less to shuffle
    left = vec.select("feature", F.col("id").alias("a"), F.col("w").alias("wa"))
    right = vec.select("feature", F.col("id").alias("b"), F.col("w").alias("wb"))
    met = left.join(of.select("a", "b"), "a").join(right, ["b", "feature"]) if of else left.join(right, "feature")
    return (
        met.where("a < b")
        .groupBy("a", "b").agg(F.sum(F.round(F.col("wa") * F.col("wb") * 1e12).cast("long")).alias("dot"))
        .select("a", "b", (F.col("dot") / 1e12).alias("cosine")).where(F.col("cosine") >= least)
    )


def frequent_words(names: DataFrame) -> tuple[frozenset, list[str]]:
    """Common given names (or words of bodies' names), and the family names whose features weigh nothing.

    A frequent word is a family name if it mostly stands first or last, and last
    more often than first; where both are as frequent, if no list has it as a given name.
    Both numbers are bounded by words per name over ``GIVEN`` and ``COMMON``.
    """
    n = names.count()
    at = names.where("size(words) > 1").select(F.posexplode("words").alias("i", "w"), F.size("words").alias("k"))
    lone = names.where("size(words) = 1").select(F.lit(-1).alias("i"), F.col("words")[0].alias("w"), F.lit(1).alias("k"))
    words = at.unionByName(lone).groupBy("w").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") == 0).alias("first"), F.count_if(F.col("i") == F.col("k") - 1).alias("last"))
    known = words.where(F.col("n") > min(max(8, GIVEN * n), max(LEAST, COMMON * n))).collect()
    family = {r["w"] for r in known if len(r["w"]) > 2 and 2 * (r["first"] + r["last"]) > r["n"]
              and (r["last"] > r["first"] or r["last"] == r["first"] and r["w"] not in GIVEN_NAMES)}
    given = frozenset(r["w"] for r in known if r["n"] > max(8, GIVEN * n) and r["w"] not in family)
    return given, sorted(r["w"] for r in known if r["n"] > max(LEAST, COMMON * n) and r["w"] in family)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("whole", T.BooleanType())])))
def _given_keys(words: pa.Array) -> pa.Array:
    return pa.array([[{"key": k, "whole": w} for k, w in given_keys(x)] for x in words.to_pylist()],
                    pa.list_(pa.struct([("key", pa.string()), ("whole", pa.bool_())])))


_ENDS = "array(struct(words[size(words) - 1] AS f, words[0] AS g), struct(words[0] AS f, words[1] AS g))"
_LESS = "array_union(array({0}), if(length({0}) < 5, array(), transform(sequence(1, length({0})), i -> concat(substring({0}, 1, i - 1), substring({0}, i + 1)))))"
#: One edit at most, a swap of neighbours counting as one.
_EDIT = """(levenshtein({0}, {1}, 1) >= 0 OR length({0}) = length({1}) AND levenshtein({0}, {1}, 2) = 2
    AND array_sort(split({0}, '')) = array_sort(split({1}, '')) AND exists(sequence(1, length({0}) - 1),
      i -> concat(substring({0}, 1, i - 1), substring({0}, i + 1, 1), substring({0}, i, 1), substring({0}, i + 2)) = {1}))"""
#: Holds for any two first given names that ``given_likeness`` finds alike with one edit; x and y are (g, forms, odd, common).
_AGREE = f"""arrays_overlap(x.forms, y.forms)
    OR length(x.g) = 1 AND exists(y.forms, t -> startswith(t, x.g)) OR length(y.g) = 1 AND exists(x.forms, t -> startswith(t, y.g))
    OR NOT (x.common AND y.common) AND (x.odd OR y.odd OR startswith(x.g, y.g) OR startswith(y.g, x.g)
      OR exists(x.forms, s -> exists(y.forms, t -> {_EDIT.format("s", "t")})))"""


def _ends(names: DataFrame) -> DataFrame:
    """(id, f, g): each outer word of a name that can be its family name, with the first given name then."""
    return names.where("size(words) > 1").select("id", F.explode(F.expr(_ENDS)).alias("e")).select("id", "e.f", "e.g")


def rule_pairs(names: DataFrame, common: frozenset, heavy: list[str]) -> DataFrame:
    """(a, b), a < b, of all names the rules can accept, but for those of the ``heavy`` family names that ``family_pairs`` has.

    Names meet by the family word, give or take one edit, and only those whose
    first given names agree leave the join; how often letters repeat in names does not matter.
    """
    spark = names.sparkSession
    known = spark.createDataFrame([(g, sorted(full_forms(g)), any(z != g and edits(z, g, 1) <= 1 for z in full_forms(g))) for g in sorted(GIVEN_NAMES | set(SHORT_FORMS))], "g string, forms array<string>, odd boolean")
    usual = F.broadcast(spark.createDataFrame([(w,) for w in sorted(common)], "w string"))
    ends = _ends(names).where("length(f) >= 3").join(usual, F.col("f") == F.col("w"), "left_anti")
    named = ends.join(F.broadcast(known), "g", "left").join(usual, F.col("g") == F.col("w"), "left").select(
        "id", "f", F.struct("g", F.coalesce("forms", F.array("g")).alias("forms"), F.coalesce("odd", F.lit(False)).alias("odd"), F.col("w").isNotNull().alias("common")).alias("n"))
    rows = cut(named, "outer-words")
    less = rows.select("f").distinct().where("length(f) >= 5").select("f", F.explode(F.expr(_LESS.format("f"))).alias("v"))
    near = less.join(less.withColumnRenamed("f", "h"), "v").where(f"f < h AND {_EDIT.format('f', 'h')}").select("f", "h").distinct()
    few = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "f string"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = left.select("f", F.col("id").alias("i"), F.col("n").alias("x")).join(right.select(F.col("h").alias("f"), F.col("id").alias("j"), F.col("n").alias("y")), "f")
        return pairs.where(f"i <> j AND ({_AGREE})").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))

    # each row comes to its own word and to those one edit before it
    near = cut(near, "near-words")
    moved = rows.join(near.select(F.col("f").alias("h"), F.col("h").alias("f")), "f").select("h", "f", "id", "n")
    comes = rows.select(F.col("f").alias("h"), "f", "id", "n").unionByName(moved)
    if not heavy:
        return met(rows, comes).distinct()
    light = comes.join(few, "f", "left_anti")
    odd = "n.odd"
    every = met(rows.join(few, "f", "left_anti"), light).unionByName(met(rows.where(odd), comes)).unionByName(met(rows, comes.where(odd)))
    return every.distinct()


def family_pairs(names: DataFrame, heavy: list[str]) -> DataFrame:
    """(a, b), a < b, of all names the rules can accept by one of the ``heavy`` family names or a word one edit from it."""
    near = F.broadcast(names.sparkSession.createDataFrame([(h, v) for h in heavy for v in deletions(h)], "h string, v string"))
    ends = _ends(names)
    kin = ends.select("f").distinct().select("f", F.explode(F.expr(_LESS.format("f"))).alias("v")).join(near, "v").select("f", "h").distinct()
    rows = cut(ends.join(kin, "f").select("h", "g", "id").distinct(), "family-names")
    keyed = rows.select("h", "g").distinct().select("h", "g", F.explode(_given_keys("g")).alias("k")).select("h", "g", "k.key", "k.whole")
    met = keyed.where("whole").select("h", "key", F.col("g").alias("ga")).join(keyed.select("h", "key", F.col("g").alias("gb")), ["h", "key"])
    met = met.select("h", F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct()
    pairs = met.join(rows.select("h", F.col("g").alias("ga"), F.col("id").alias("x")), ["h", "ga"]).join(
        rows.select("h", F.col("g").alias("gb"), F.col("id").alias("y")), ["h", "gb"])
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def accept(pairs: DataFrame, common: frozenset, most: int = 1, least: float = LINKED) -> DataFrame:
    """Pairs (a, b, na, nb) whose names are alike by ``least`` with ``most`` edits a word, with ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            score = [likeness(x.split(), y.split(), common, most) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = [i for i, s in enumerate(score) if s >= least]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()),
                                              pa.array([score[i] for i in keep], pa.float64())], ["a", "b", "score"])

    return pairs.select("a", "b", "na", "nb").mapInArrow(run, "a long, b long, score double")


def components(links: DataFrame) -> DataFrame:
    """(id, root): smallest id reachable over the links, by repeated minimum with shortcuts."""
    both = cut(links.select("a", "b").union(links.select("b", "a")), "links")
    roots = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root"))
    roots, seen = cut(roots, "roots"), None
    while True:
        near = both.join(roots, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("m"))
        step = roots.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"))
        hop = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        roots = cut(step.join(hop, "root", "left").select("id", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
        total = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == seen:
            return roots
        seen = total


def average_linkage(n: int, sim: dict[tuple[int, int], float], least: float) -> list[int]:
    """Cluster of each of ``n`` items; missing pairs count as 0, the closest pair merges first."""
    size = {i: 1 for i in range(n)}
    total: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for (i, j), s in sim.items():
        total[i][j] = total[j][i] = s
    into = list(range(n))

    def closest(i: int) -> tuple[float, int]:
        return max(((t / (size[i] * size[j]), -j) for j, t in total[i].items() if j > i), default=(-1.0, 0))

    near = {i: closest(i) for i in range(n)}
    while near:
        mean, ni, nj = max((v[0], -i, v[1]) for i, v in near.items())
        i, j = -ni, -nj
        if mean < least:
            break
        near.pop(j)
        for k, t in total.pop(j).items():
            total[k].pop(j)
            if k != i:
                total[i][k] = total[k][i] = total[i].get(k, 0.0) + t
        size[i] += size.pop(j)
        into[j] = i
        for k in (i, *total[i]):
            near[k] = closest(k)
    for i in range(n):
        into[i] = into[into[i]]
    return into


def _clusters(rows: list[tuple], common: frozenset) -> list[int]:
    """Cluster label of each (id, name, alike) row of one component; ``alike`` where the pairs were compared before."""
    if len(rows) == 2:
        return [0, 0]
    if any(r[2] for r in rows):
        at = {r[0]: i for i, r in enumerate(rows)}
        sim = {(i, at[x["b"]]): x["score"] for i, r in enumerate(rows) for x in r[2] or ()}
    else:
        words = [r[1].split() for r in rows]
        sim = {(i, j): s for i in range(len(rows)) for j in range(i + 1, len(rows)) if (s := likeness(words[i], words[j], common, 2)) > 0}
    return average_linkage(len(rows), sim, LINKED)


def alike_pairs(members: DataFrame, common: frozenset, most: int = ALL_PAIRS) -> DataFrame:
    """(id, alike): the names b > id of any likeness, of each name in components of more than ``most``.

    The same likeness of all pairs as in small components, a block of names
    against the component's rest at a time. Words of two edits, a swap counting as one, are
    within four by ``levenshtein``; pairs without such outer words have no likeness.
    """
    large = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("root", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    rows = cut(members.join(large, "root").withColumn("w", F.split("name", " ")), "large-components")
    left = rows.select("root", F.expr("cast(pmod(xxhash64(id), blocks) AS int)").alias("block"), F.col("id").alias("a"), F.col("name").alias("na"), F.col("w").alias("wa"))
    right = rows.select("root", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("id").alias("b"), F.col("name").alias("nb"), F.col("w").alias("wb"))
    near = " OR ".join(f"levenshtein(element_at(wa, {i}), element_at(wb, {j}), 4) >= 0" for i in (1, -1) for j in (1, -1))
    pairs = left.join(right, ["root", "block"]).where(f"a < b AND ({near})")
    scored = accept(pairs, common, 2, 1e-9)
    return scored.groupBy(F.col("a").alias("id")).agg(F.collect_list(F.struct("b", "score")).alias("alike"))


def cluster(members: DataFrame, common: frozenset, most: int = ALL_PAIRS) -> DataFrame:
    """(id, author): the author cluster of each name of the components.

    Components come as runs of sorted rows, several to a task, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple]) -> tuple[list, list]:
            ids = [r[0] for r in rows]
            return ids, [ids[c] for c in _clusters(rows, common)]

        root, rows = None, []
        for batch in batches:
            ids, authors = [], []
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r[0] != root:
                    x, y = close(rows)
                    ids, authors, root, rows = ids + x, authors + y, r[0], []
                rows.append(r[1:])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(authors, pa.int64())], ["id", "author"])
        x, y = close(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["id", "author"])

    tied = alike_pairs(members, common, most)
    sorted_rows = members.join(tied, "id", "left").select("root", "id", "name", "alike").repartition("root").sortWithinPartitions("root", "name", "id")
    return sorted_rows.mapInArrow(run, "id long, author long")


def link_names(names: DataFrame) -> DataFrame:
    """(id, author) of every name that has a variant; ``names`` has id (long) and name (folded words)."""
    known = names.withColumn("words", F.split("name", " "))
    common, heavy = frequent_words(known)
    pairs = rule_pairs(known, common, heavy).withColumn("met", F.lit(False))
    if heavy:
        pairs = pairs.union(family_pairs(known, heavy).withColumn("met", F.lit(True))).groupBy("a", "b").agg(F.max("met").alias("met"))
    pairs = cut(pairs, "pairs")
    named = (
        pairs.join(known.select(F.col("id").alias("a"), F.col("name").alias("na")), "a")
        .join(known.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
    )
    ruled = cut(accept(named, common), "ruled").select("a", "b")
    # the rules come first: of the pairs that share letters they leave few
    ids = cut(ruled.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ruled-names")
    links = cosine_pairs(cut(vectors(known, ids), "vectors"), of=ruled).select("a", "b")
    if heavy:
        links = links.union(ruled.join(pairs.where("met"), ["a", "b"], "left_semi")).distinct()
    links = cut(links, "name-links")
    roots = components(links)
    members = cut(roots.join(known.select("id", "name"), "id"), "members")
    return cluster(members, common)
