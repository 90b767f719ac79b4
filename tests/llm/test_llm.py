import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import layout_copies as lc
from folioforge.llm.canonical_list import map_to_list
from folioforge.llm.containers import fill_containers, pack
from folioforge.llm.lookalikes import clean_cells
from folioforge.llm.mixture import draw_mixture, mixture_shares, poisson_cdf, settle_rates, uniform
from folioforge.llm.name_rules import edits, likeness
from folioforge.llm.name_variants import average_linkage, components, cosine_pairs, link_names, vectors
from folioforge.llm.page_stats import NAMES, page_stats
from folioforge.llm.quality import page_quality
from folioforge.llm.survivors import ranked_values, survivors
from folioforge.llm.tokens import count_tokens, encoding, TOKENIZER

ROWS = "row_id long, group_key string, author_raw string, source_rank int, confidence_rank int, author_len int, seen_at timestamp, _key string, value string"


def author_rows(spark, values):
    return spark.createDataFrame([(*v, None, "clash", "clash") for v in values], ROWS)


def test_survivor_order_ties_and_missing(spark):
    df = author_rows(spark, [(1, "k", "...", 0, 2, 9), (2, "k", "Jan", 1, None, 9), (3, "k", "Jan B", 1, 0, 5), (4, "k", "Jan C", 1, 0, 5), (5, "one", "X", 0, 0, 1), (6, "", "Y", 0, 0, 1), (7, None, "Z", 0, 0, 1), (8, "no", "?", 0, 0, 1), (9, "no", None, 0, 0, 1)])
    order = [F.col("source_rank"), F.col("confidence_rank").isNull().cast("int"), -F.col("confidence_rank"), -F.col("author_len")]
    got = ranked_values(df, "group_key", "row_id", ["author_raw"], order).collect()
    assert [(r["group_key"], r["row_id"]) for r in got] == [("k", 3)]
    assert ranked_values(df.limit(0), "group_key", "row_id", ["author_raw"], order).count() == 0


def test_votes_add_up(spark):
    df = author_rows(spark, [(1, "k", "Jan  Kot", 1, 0, 1), (2, "k", "JAN KOT", 1, 0, 1), (3, "k", "Jan Pies", 0, 0, 1)])
    rec = survivors(df, "group_key", "row_id", ["author_raw"], F.lit(2.0) - F.col("source_rank") * 0.9, "seen_at").collect()
    assert [(r["group_key"], r["n_rows"], r["author_raw"]) for r in rec] == [("k", 3, "Jan  Kot")]


@pytest.mark.parametrize("capacity", [3, 50, 10_000])
def test_copies_equal_brute_force(spark, capacity):
    rng = random.Random(capacity)
    words = ["kot", "Kot", "KOT,", "pies", "a1", "a1 a1", "źdźbło", "x" * 300]
    rows = [(i, rng.choice(["big"] * 8 + ["k1", "k2", "", None]), rng.choice([" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), "Stały Tekst", None, "..."]), 0, 0, 0) for i in range(600)]
    sets = defaultdict(list)
    for i, k, raw, *_ in rows:
        if k and raw and any(c.isalpha() for c in raw):
            sets[k, tuple(sorted("".join(c if c.isalnum() else " " for c in raw.lower()).split()))].append(i)
    want = {(min(v), i, len(v)) for v in sets.values() for i in v}
    got = lc.layout_copies(author_rows(spark, rows), "group_key", "row_id", "author_raw", capacity).collect()
    assert {(r["kept_row_id"], r["row_id"], r["copies"]) for r in got} == want and len(got) == len(want)


def test_copies_of_nothing(spark):
    assert lc.layout_copies(author_rows(spark, []), "group_key", "row_id", "author_raw").count() == 0


def test_canonical_list(spark):
    entries = spark.createDataFrame([(1, "powieść gotycka", "gothic novel"), (2, "western", "frontier adventure"), (3, "moda i ubiór", None)], "entry_id int, label string, label_en string")
    cases = {"gotycka, powieść": 1, "powie. gotycka": 1, "POWIESC_GOTYCKA - nowości": 1, "gothicnovel": 1, "poiweść gotycka (e-book)": 1, "westtern": 2, "ubiór, moda i": 3,
             "Książki / gothic novel": 1, "numizmatyka": 0, "do przeczytania": 0, "x" * 5000: 0}
    plain = ["powieść gotycka", "western", None, "", " 12 "]
    cells = spark.createDataFrame([(i, v) for i, v in enumerate([*cases, *cases, *plain])], "entry int, cell string")
    got = map_to_list(cells, entries).select("cell", "entry_id").collect()
    assert len(got) == 2 * len(cases) and dict(map(tuple, got)) == cases
    assert map_to_list(cells.limit(0), entries).count() == 0


def test_lookalikes(spark):
    cases = {"Rеdakcja X": "Redakcja X", "Ｊａｎ": "Jan", "Leo‌p­old": "Leopold", "Piśedewo": "Piśedewo", "Zoﬁa": "Zofia", "Филихoюшин": "Филихоюшин", "Α. Kot": "A. Kot", "ΟЅА Kot": "OSA Kot"}
    plain = ["Żółć", "Жидося Ляшареляк", "część “nowa” — №3 ½ m²", "σοφία", None, "", "Kot и Пёс"]
    cells = spark.createDataFrame([(i, v) for i, v in enumerate([*cases, *plain])], "m int, cell string")
    got = {r["cell"]: r["clean_text"] for r in clean_cells(cells).collect()}
    assert got == cases


def test_name_rules():
    none = frozenset()
    assert edits("gorta", "grota", 1) == 1 and edits("abc", "abc", 1) == 0 and edits("abcd", "badc", 1) == 2
    assert likeness("jan kowalski".split(), "kowalski j".split(), none) > 0.5
    assert likeness("edek rezemanart".split(), "edward hubert rezemanart".split(), none) > 0.5
    assert likeness("anna kowalski".split(), "jan kowalski".split(), frozenset({"anna", "jan"})) == 0
    assert likeness(["jan"], ["jan"], none) == 0


def test_linkage_keeps_rivals_apart():
    sim = {(0, 1): 0.9, (1, 2): 0.7, (2, 3): 0.9}
    label = average_linkage(4, sim, 0.45)
    assert label[0] == label[1] and label[2] == label[3] and label[0] != label[2]


def test_cosine_equals_brute_force(spark):
    rng = random.Random(3)
    names = [" ".join(sorted(rng.choice(["jan", "ewa", "ola"]) if k else "".join(rng.choice("kotapi") for _ in range(6)) for k in range(2))) for _ in range(60)]
    df = spark.createDataFrame([(i, n, n.split()) for i, n in enumerate(sorted(set(names)))], "id long, name string, words array<string>")
    vec = vectors(df).collect()
    by = defaultdict(dict)
    for r in vec:
        by[r["id"]][r["feature"]] = r["w"]
    want = {(a, b): s for a in by for b in by if a < b and (s := sum(w * by[b].get(f, 0) for f, w in by[a].items())) >= 0.25}
    got = {(r["a"], r["b"]): r["cosine"] for r in cosine_pairs(vectors(df)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_names_are_linked(spark):
    names = ["jan wikunobo", "j wikunobo", "jan wikunbo", "anna kelaporu", "piotr kelaporu", "", "sam"]
    got = link_names(spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    groups = Counter(r["author"] for r in got.collect())
    assert sorted(groups.values()) == [3]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21)], "a long, b long")
    assert {r["id"]: r["root"] for r in components(links).collect()} == {**{i: 1 for i in range(1, 10)}, 20: 20, 21: 20}


def test_pack_places_every_token_once():
    rng = random.Random(5)
    for cap in (1, 7, 100):
        lengths = [rng.choice([0, 1, 3, 50, 99, 100, 101, 350]) for _ in range(300)]
        bins = pack(lengths, cap)
        assert all(sum(x[3] for x in b) <= cap for b in bins)
        got = Counter()
        for b in bins:
            for i, _, _, n in b:
                got[i] += n
        assert all(got[i] == n for i, n in enumerate(lengths))
        assert all(len(b) == 1 or lengths[x[0]] <= cap or x[3] < cap for b in bins for x in b)
    lengths = [rng.randint(1, 100) for _ in range(2000)]
    assert sum(lengths) / (100 * len(pack(lengths, 100))) > 0.97
    assert pack([], 5) == []


def test_containers(spark):
    sized = spark.createDataFrame([(i, i % 40) for i in range(500)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("s", 50), ("m", 200)], "container string, capacity_tokens int")
    got = fill_containers(sized, kinds, shard_docs=200)
    assert got.groupBy("container").agg(F.sum("tokens").alias("t"), F.countDistinct("doc_id").alias("n")).count() == 2
    assert {(r["container"], r["t"], r["n"]) for r in got.groupBy("container").agg(F.sum("tokens").alias("t"), F.countDistinct("doc_id").alias("n")).collect()} == {("s", sum(i % 40 for i in range(500)), 500), ("m", sum(i % 40 for i in range(500)), 500)}
    assert got.groupBy("bin").agg(F.sum("tokens").alias("t"), F.first("capacity").alias("c")).where("t > c").count() == 0
    assert fill_containers(sized.limit(0), kinds).count() == 0


def test_mixture_meets_targets(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else "c", 50 + i % 100) for i in range(6000)] + [(None, "a", 5), (-1, None, 5), (-2, "a", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 4)], "source string, target_share double, max_repeats int")
    mix = draw_mixture(sized, targets)
    for r in mixture_shares(mix, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01 and r["most_repeats"] <= r["max_repeats"]
    assert mix.where("doc_id is null").count() == 0 and draw_mixture(sized.limit(0), targets).count() == 0
    one = sized.where("source = 'a' and tokens > 0 and doc_id is not null").select("source", uniform("doc_id", 17).alias("u"), "tokens")
    assert abs(settle_rates(one, {"a": 1e5}, {"a": 1})["a"]) > 0 and poisson_cdf(0, np.array([0.0]))[0] == 1


def test_token_pieces_change_no_count():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdeż \n") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    assert count_tokens(text) == len(encoding(TOKENIZER).encode_ordinary(text))
    assert count_tokens(None) == count_tokens("") == 0


def test_pages(spark):
    rng = random.Random(4)
    nouns = "mleko teatr kupiec młyn wełna szkoła pociąg rynek".split()
    prose = lambda: "\n".join(" ".join(rng.choice(["nad", "i", "że", "jest", *nouns, *nouns]) for _ in range(rng.randint(6, 9))) + rng.choice([".", "", ",", "-"]) for _ in range(rng.randint(8, 20)))
    pages = {i: prose() for i in range(400)}
    pages |= {900: "\n".join(f"- {rng.choice(nouns)}, {rng.choice(nouns)}" for _ in range(20)), 901: "\n".join(f"{rng.choice(nouns)} | {i} | 2,{i} | 77" for i in range(20)),
              902: "\n".join("%& {] ¦ §- °1 \\" for _ in range(12)), 903: "to jest to jest to jest\n" * 30, 904: "", 905: None}
    docs = spark.createDataFrame([(k, v, "pl", "x") for k, v in pages.items()], "doc_id long, text string, lang string, kind string")
    words = spark.createDataFrame([("pl", w) for w in ("nad", "i", "że", "jest", "to")], "lang string, word string")
    got = {r["doc_id"]: r for r in page_quality(docs, words).collect()}
    assert [got[k]["kind"] for k in range(900, 906)] == ["list", "table", "junk", "junk", "junk", "junk"]
    assert sum(got[k]["kind"] == "prose" for k in range(400)) >= 396
    r = got[902]
    assert abs(sum(r["parts"]) - r["distance"] ** 2) < 1e-6 * r["distance"] ** 2 and got[905]["distance"] is None
    assert len(page_stats("a b", {"pl": frozenset({"a"})})[1]) == len(NAMES)
