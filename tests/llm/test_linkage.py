"""Matching without keys: the label model alone, planted works, defined results."""

import random

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm.linkage import _block_keys, _families, _packed, blocked, learn, link_works, matches
from folioforge.llm.name_rules import edits
from folioforge.llm.work_features import FUNCTIONS, book_claims, code_votes, online_claims, stem_claims, title_claims, unpacked, vote_code, votes

VOL = "struct<major:int,minor:string>"
BOOKS = f"book_id string, stem string, title string, creators array<string>, identifiers array<string>, meta_series string, meta_volume {VOL}, note string"
ONLINE = f"online_id long, title string, authors array<string>, identifiers array<string>, series string, volume {VOL}, note string"


def test_label_model_finds_the_matches():
    rng = np.random.default_rng(1)
    at = FUNCTIONS.index
    y = rng.random(6000) < 0.3
    v = np.where(rng.random((6000, len(FUNCTIONS))) < 0.9, 1, -1) * np.where(y[:, None], 1, -1)
    v[y, at("author")], v[y, at("volume")] = 1, 0
    v[rng.random(v.shape) < 0.1] = 0
    pats, inv, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post = learn(pats, n.astype(float))[inv.ravel()]
    assert ((post > 0.5) == y).mean() > 0.98
    assert len(learn(np.zeros((0, len(FUNCTIONS)), int), np.zeros(0))) == 0


def test_claims():
    assert title_claims("Cykl Lasu 2: Zima (ebook)") == (["zima"], "lasu", 2)
    assert stem_claims("Zima -- Kot, Jan -- Las #2, 2020 -- Dom", [])[3] == ["kot jan"]
    assert stem_claims("[2] Zima_Kot", []) == (["zima"], "", -1, ["kot"])
    assert book_claims("Zima", "Kot Jan - Zima", None, None, None, None)["persons"] == ["kot jan"]
    assert book_claims(None, None, None, [None], None, None)["titles"] == []
    book, found = book_claims("Zima", "Kot Jan - Zima", [], [], "", None), online_claims("Zima", ["Ewa Lis"], None, None, None)
    assert votes(book, found, [], [])[FUNCTIONS.index("author")] == -1


def works(n, seed=3):
    """``n`` works with namesakes, volumes of one series written into both titles and no series field; the true pairs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdgklmnprstwz") + rng.choice("aeiou") for _ in range(rng.randint(3, 4)))
    given = ["Jan", "Ewa", "Adam", "Zofia", "Karol", "Irena", "Piotr", "Marta"]
    books, online, true = [], [], []
    titles = [f"{word()} {word()}" for _ in range(n * 2 // 3)]
    for a in range(n // 4):
        who, series = (rng.choice(given), word() + word()), f"{word()} {word()}"
        for k in range(4):
            i, title = a * 4 + k, rng.choice(titles)
            shown = f"{series.title()}: {title.title()}" if k < 2 else title.title()
            typo = shown[:-3] + shown[-2:] if rng.random() < 0.2 else shown
            creators = [] if rng.random() < 0.1 else [f"{who[1].title()}, {who[0]}"]
            books.append((f"b{i}", f"{title.title()} - {who[0]} {who[1].title()}", shown if rng.random() > 0.1 else None, creators, None, None, None, "x"))
            online.append((i, typo, [f"{who[0]} {who[1].title()}" if rng.random() < 0.7 else f"{who[0][0]}. {who[1].title()}"], [], None, None, "y"))
            true.append((f"b{i}", i))
    return books, online, set(true)


def test_planted_works(spark):
    books, online, true = works(1200)
    guesses = spark.createDataFrame([("b1", None)], "book_id string, series string")
    scored = link_works(spark.createDataFrame(books, BOOKS), guesses, spark.createDataFrame(online, ONLINE))
    found = {(r[0], r[1]) for r in matches(scored).select("book_id", "online_id").collect()}
    recall, precision = len(found & true) / len(true), len(found & true) / len(found)
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.95 and precision >= 0.95


def test_defined_results(spark):
    books = spark.createDataFrame([("b1", "x", "Lekki złłodziej", ["G. Gatulalal"], None, "Jasny", (4, "00"), ""), ("b2", "Lekki sklep - Jan Kot", None, None, [None], None, None, ""),
                                   ("b3", "y", "Szkola 1", ["Ewa Lis"], None, "Szkola", (1, "00"), ""), ("b4", None, "x" * 20000, [], [], "", None, None), ("b4", None, "x" * 20000, [], [], "", None, None)], BOOKS)
    online = spark.createDataFrame([(1, "Jasny 4: Lekki złodziej", ["Gustaw Gatulalal"], None, "Jasny", (4, "00"), ""), (2, "Szkola 2", ["Ewa Lis"], [], "Szkola", (2, "00"), ""), (3, "", [], None, None, None, ""), (4, None, None, None, None, None, None)], ONLINE)
    guesses = spark.createDataFrame([("b1", None)], "book_id string, series string")
    scored = {(r["book_id"], r["online_id"]): r["confidence"] for r in link_works(books, guesses, online).collect()}
    assert scored[("b1", 1)] > 0.5 and scored.get(("b3", 2), 0.0) < 0.5
    assert link_works(books.limit(0), guesses, online).count() == 0


def table_of_edits(x, y):
    """Edits by the whole table, a swap of neighbours counting as one."""
    rows = [list(range(len(y) + 1))]
    for i, a in enumerate(x, 1):
        row = [i]
        for j, b in enumerate(y, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a != b))
            row.append(min(v, rows[i - 2][j - 2] + 1) if i > 1 and j > 1 and a == y[j - 2] and x[i - 2] == b else v)
        rows.append(row)
    return rows[-1][-1]


def test_edits_equal_the_table():
    rng = random.Random(4)
    for _ in range(6000):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in "xy")
        assert all(edits(x, y, most) == min(table_of_edits(x, y), most + 1) for most in (1, 2, 4, 9)), (x, y)


def test_pairs_by_joint_keys_and_votes_by_texts(spark):
    rng = random.Random(6)
    word = ["las", "dom", "kot", "zima", "rzeka", "miasto", "most", "ogien"]
    title = lambda: " ".join(rng.sample(word, rng.choice([2, 3, 3, 3, 4])))
    who = lambda: rng.choice(["Jan Kosunebon", "Ewa Lapotaru", "Adam Mirudelsk", "Zofia Wetogala"])
    books = [(f"b{i}", "x" if rng.random() < 0.7 else title(), title(), [who()] if rng.random() < 0.8 else [], None, None, None, "") for i in range(60)]
    online = [(i, title() if rng.random() < 0.8 else f"{title()}: {title()}", [who()] if rng.random() < 0.8 else [], [], None, None, "") for i in range(60)]
    guesses = spark.createDataFrame([("b1", "Las")], "book_id string, series string")
    b, o, pairs = blocked(spark.createDataFrame(books, BOOKS), guesses, spark.createDataFrame(online, ONLINE))
    got = {(r[0], r[1]) for r in pairs.collect()}
    df = b.select("c.titles").union(o.select("c.titles")).select(F.explode(F.array_distinct(F.split(F.array_join("titles", " "), " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    sides = [_block_keys(x, df, f).collect() for x, f in zip((b, o), _families(b, o))]
    left, right = ({}, {})
    for side, rows in zip((left, right), sides):
        for r in rows:
            if not r["key"].startswith("&"):
                side.setdefault(r["id"], {})[r["key"]] = (r["need"], r["nameless"])
    want = set()
    for i, x in left.items():
        for j, y in right.items():
            if met := x.keys() & y.keys():
                need = min(min(x[k][0], y[k][0]) for k in met)
                if need == 0 or sum(x[k][0] > 0 for k in met) >= need or any(x[k][1] or y[k][1] for k in met):
                    want.add((i, j))
    assert got == want and len(want) > 100
    # two rows of one title each meet by the joint key alone
    assert all(any(r["joint"] for r in rows) and any(r["key"].startswith("&") for r in rows) for rows in sides)
    claims = [r.asDict(recursive=True) for r in b.select("c", "g").collect()], [r.asDict(recursive=True) for r in o.select("c").collect()]
    carried = F.array(F.lit("las dom"), F.lit("zima"))
    texts = [r[0] for r in b.withColumn("t", carried).select(_packed(guesses="g", carried="t")).collect()]
    other = [r[0] for r in o.select(_packed(guesses="", carried="")).collect()]
    for x, tx in zip(claims[0], texts):
        for y, ty in zip(claims[1], other):
            assert code_votes(vote_code(unpacked(tx), unpacked(ty))) == votes(x["c"], y["c"], x["g"] or [], ["las dom", "zima"])
