import random

from pyspark.sql import functions as F

from folioforge.llm.name_rules import edits, full_forms as full, given_keys, given_likeness, likeness
from folioforge.llm.name_variants import LINKED, average_linkage, cosine_pairs, frequent_words, link_names, rule_pairs, vectors


def test_frequent_families_are_linked(spark):
    rng = random.Random(7)
    fill = sorted({"".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)})
    pairs = [("olek kowalski", "aleksander kowalski"), ("kit kowalski", "christopher kowalski"), ("gosia kowalski", "malgorzata kowalski"), ("zenobiusz kowalski", "zenobiusz kowalksi")]
    names = [n for p in pairs for n in p] + [f"{w} kowalski" for w in fill] + [f"zenobiusz {w}x" for w in fill[:30]]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    given, heavy = frequent_words(df.withColumn("words", F.split("name", " ")))
    assert given == {"zenobiusz"} and heavy == ["kowalski"]
    by = {r["id"]: r["author"] for r in link_names(df).collect()}
    at = {n: by.get(i, i) for i, n in enumerate(names)}
    assert all(at[a] == at[b] for a, b in pairs) and len({at[a] for a, _ in pairs}) == len(pairs)


def test_given_keys_meet_where_names_agree():
    rng = random.Random(8)
    some = ["jan", "janek", "jas", "j", "olek", "aleksander", "alex", "sandy", "teddy", "edward", "gosia", "malgorzata", "malgorzta", "ewa", "ed", "e", "wiktro", "wiktor", "wiktorek"]
    some += ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    for x in some:
        for y in some:
            # a name one edit from its own full form is alike to every name by the rules, which is no agreement of the two
            own = any(f not in (x, y) and edits(f, z, 1) <= 1 for z in (x, y) for f in {z} ^ full(z))
            if given_likeness(x, y, frozenset(), 1) and not own:
                kx, ky = dict(sorted(given_keys(x))), dict(sorted(given_keys(y)))
                assert any(kx[k] or ky[k] for k in kx.keys() & ky.keys()), (x, y)


def greedy(n, sim, least):
    """Average linkage as defined: over all pairs of clusters, at each step."""
    label = list(range(n))
    while True:
        total, size = {}, {c: label.count(c) for c in label}
        for (i, j), s in sim.items():
            if label[i] != label[j]:
                k = (min(label[i], label[j]), max(label[i], label[j]))
                total[k] = total.get(k, 0.0) + s
        best = max(((t / (size[i] * size[j]), -i, -j) for (i, j), t in total.items()), default=(-1, 0, 0))
        if best[0] < least:
            return label
        label = [-best[1] if c == -best[2] else c for c in label]


def test_average_linkage_equals_its_definition():
    rng = random.Random(9)
    for n in (1, 2, 5, 12, 25):
        for _ in range(12):
            sim = {(i, j): rng.choice([0.25, 0.5, 0.75, 1.0]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
            assert average_linkage(n, sim, LINKED) == greedy(n, sim, LINKED)


def test_large_components_use_the_same_likeness(spark):
    rng = random.Random(10)
    few = {"j kowalski"}
    while len(few) < 330:
        few.add("j" + "".join(rng.choice("bcdfghklm") + rng.choice("aeiou") for _ in range(4)) + " kowalski")
    base = sorted(few)[1:7]
    names = sorted(few) + [w for b in base for w in (b[:3] + "xq" + b[5:], b[:3] + "xq" + b[5:9] + " kowalski", b[:4] + "x" + b[5:])]
    names = sorted(set(names))
    got = {r["id"]: r["author"] for r in link_names(spark.createDataFrame(list(enumerate(names)), "id long, name string")).collect()}
    words = [n.split() for n in names]
    inside = sorted(got)
    assert len(inside) > 300
    common = frozenset()
    sim = {(x, y): s for x in range(len(inside)) for y in range(x + 1, len(inside)) if (s := likeness(words[inside[x]], words[inside[y]], common, 2)) > 0}
    want = average_linkage(len(inside), sim, LINKED)
    assert [got[i] for i in inside] == [inside[c] for c in want]


def test_names_that_only_share_letters_never_meet(spark):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("bdgk") + rng.choice("aei") for _ in range(k))
    families = [word(4) for _ in range(150)]
    given = ["jan", "janek", "j", "ewa", "ewka", "olek", "aleksander", "wiktor", "wiktro", "zofia"]
    names = set()
    for f in families:
        typo = f[:-2] + f[-1] if rng.random() < 0.5 else f[:2] + f[3] + f[2] + f[4:]
        for g in rng.sample(given, 4):
            names |= {f"{g} {f}", f"{rng.choice([f, typo])} {g}", f"{g} {rng.choice(given)} {typo}"}
    names = sorted(names)
    words = [n.split() for n in names]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    known = df.withColumn("words", F.split("name", " "))
    common, heavy = frequent_words(known)
    assert not heavy
    met = {(r["a"], r["b"]) for r in rule_pairs(known, common, heavy).collect()}
    alike = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if likeness(words[i], words[j], common) >= LINKED}
    every = {(r["a"], r["b"]): r["cosine"] for r in cosine_pairs(vectors(known), 0.0).collect()}
    assert alike <= met and len(every) > 4 * len(met)
    few = spark.createDataFrame(sorted(alike), "a long, b long")
    ids = few.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    assert {(r["a"], r["b"]): r["cosine"] for r in cosine_pairs(vectors(known, ids), 0.0, few).collect()} == {k: v for k, v in every.items() if k in alike}


def test_rule_pairs_of_heavy_families(spark):
    fill = [f"{a}{b}{c} kowalski" for a in "bdgkl" for b in "aei" for c in ("nd", "rd", "tm")]
    names = fill + ["ewka kowalski", "zen kowalski", "zen kowalksi", "ewka nowak", "zen nowak"]
    known = spark.createDataFrame(list(enumerate(names)), "id long, name string").withColumn("words", F.split("name", " "))
    met = {tuple(sorted((names[r["a"]], names[r["b"]]))) for r in rule_pairs(known, frozenset({"zen"}), ["kowalski"]).collect()}
    # a name one edit from its own full form is alike to any by the rules; the others of a heavy family are met by family_pairs
    assert {p for p in met if "ewka kowalski" not in p} == {("ewka nowak", "zen nowak")} and len(met) == len(fill) + 3
