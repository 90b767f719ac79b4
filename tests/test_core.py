import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioforge.functions import text as t, titles
from folioforge.functions.folding import author_key, author_key_exact
from folioforge.operators import authors, records
from folioforge.operators.packed import BAD_BRACKET, BAD_QUOTE, CODES, PEOPLE, split_cell, unpack


def one(spark, expr, *values):
    """Value of a column expression over one row of texts."""
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def items(text, dialect):
    return [a for a, _ in split_cell(text, dialect)]


def test_scalars(spark):
    assert one(spark, t.match_text, "Żmijewski") == "zmijewski"
    assert one(spark, t.key_of, "Łukasz Żmijewski") == "lukaszzmijewski"
    assert one(spark, t.clean, "Księżycowe Miasto-03.Dom płomienia i cienia") == "Księżycowe Miasto 03 Dom płomienia i cienia"
    assert tuple(one(spark, t.parse_volume, "IV")) == (4, "00")
    assert tuple(one(spark, t.parse_volume, "2.5")) == (2, "05")
    assert tuple(one(spark, t.parse_volume, "1.50")) == (1, "50")
    assert one(spark, t.parse_volume, "i") is None
    assert one(spark, t.strip_html, "<b>Królewska</b> &amp; <i>klatka</i>") == "Królewska & klatka"
    assert tuple(one(spark, t.genre_suffix, "Title [fantasy]")) == ("Title", "fantasy")
    assert one(spark, t.last_first, "Eric van Lustbader") == "van Lustbader Eric"
    assert one(spark, t.last_first, "Krout, Dakota") == "Krout Dakota"
    assert one(spark, titles.split_authors, "Centkiewiczowie Alina i Czesław") == ["Alina Centkiewicz", "Czesław Centkiewicz"]
    assert one(spark, t.sanitize_component, "con") == "_con"
    assert one(spark, t.sanitize_component, " .. ") == "Brak"


def test_volume_label(spark):
    df = spark.sql("select cast(null as struct<major:int,minor:string>) v union all select named_struct('major', 0, 'minor', '00') union all select named_struct('major', 12, 'minor', '5')")
    assert sorted(r[0] for r in df.select(t.format_volume(F.col("v"))).collect()) == ["Tom 00.00", "Tom 00.00", "Tom 12.05"]


def test_similarity_keeps_argument_order(spark):
    assert one(spark, t.similarity, "tide", "diet") == 0.25 and one(spark, t.similarity, "diet", "tide") == 0.5
    assert one(spark, t.similarity, "", "x") == 0.0


def test_keys_equal_plain_python(spark):
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(32, 0x250), *range(0x300, 0x340), *range(0x400, 0x460), 0xFB01, 0x2116, 0xBD, 0xFF21, 0x1E9E, 0x2163)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", author_key(F.col("x")).alias("k"))
    assert all(r["k"] == author_key_exact(r["x"]) for r in df.collect())


def test_packed_values():
    assert items('"ol dump, 2" | lc;ol', CODES) == ["ol dump, 2", "lc", "ol"]
    assert items("lc || ol |", CODES) == ["lc", "ol"]
    assert items("Kowal, Jan & Nowak, Ewa", PEOPLE) == ["Kowal, Jan", "Nowak, Ewa"]
    assert items("Kowal, Jan Maria", PEOPLE) == ["Kowal, Jan Maria"]
    assert items("Jan Kowal, Ewa Nowak & Ola Lis", PEOPLE) == ["Jan Kowal", "Ewa Nowak", "Ola Lis"]
    assert items('"Jan ""Janek"" Kowal"; "Nowak, Ewa"', PEOPLE) == ['Jan "Janek" Kowal', "Nowak, Ewa"]
    assert items("Jan I Kowal", PEOPLE) == ["Jan I Kowal"]
    assert items("[a; b]; c", CODES) == ["[a; b]", "c"]
    assert split_cell('"lc | ol', CODES) == [('"lc', BAD_QUOTE), ("ol", "")]
    assert split_cell("(a | b", CODES)[0] == ("(a", BAD_BRACKET)
    assert items(None, CODES) == [] and items("  ", CODES) == []
    assert len(items("a," * 50_000, CODES)) == 50_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='abc ",;|', min_size=1).filter(lambda x: x.strip()), min_size=1, max_size=6))
def test_quoted_values_survive_a_round_trip(values):
    cell = " | ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert items(cell, CODES) == [v.strip() for v in values]


def test_unpack_keeps_positions_and_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, "a|b|b", "x"), (2, None, "y"), (3, "a", "z")], "id int, cell string, pos string")
    rows = unpack(df, "cell", CODES, ["id"], 2).collect()
    assert [(r["id"], r["pos"], r["item"]) for r in rows] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "b")]
    assert unpack(df.limit(0), "cell", CODES, ["id"]).count() == 0


def test_author_merge(spark):
    rows = spark.createDataFrame(
        [(1, "akeholmberg", "ol", None, "Åke 1907 Holmberg", None, 1, 2, 17), (2, "akeholmberg", "lc", "Ake Holmberg", "Ake Holmberg", "Holmberg Ake", 0, 1, 12), (3, "", "ol", "?", None, None, 1, 0, 0)],
        "row_id long, group_key string, source string, author_raw string, author_first_last string, author_last_first string, source_rank int, confidence_rank int, author_len int")
    got = authors.merge_authors(rows).collect()
    assert got[0]["source"] == "lc | ol"
    assert len(got) == 1 and got[0]["author_first_last"] == "Ake Holmberg" and got[0]["author_raw"] == "" and got[0]["n_rows"] == 2
    assert authors.ungrouped(rows).count() == 1
    cat = authors.catalog(authors.merge_authors(rows))
    found = authors.resolve(spark.createDataFrame([("Holmberg, Ake",), ("Nikt Inny",)], "a string"), "a", cat)
    assert dict(found.collect()) == {"Holmberg, Ake": "Ake Holmberg", "Nikt Inny": None}


def test_natural_order(spark):
    df = spark.createDataFrame([("[10] a",), ("A",), ("[2] a",), ("(03) a",)], "n string")
    assert [r["n"] for r in df.orderBy(records.natural_key(F.col("n"))).collect()] == ["(03) a", "[2] a", "[10] a", "A"]
    long = spark.createDataFrame([("a 1234567890123",), ("a 1234567890124",), ("a 99",), ("a 007",)], "n string")
    assert [r["n"] for r in long.orderBy(records.natural_key(F.col("n"))).collect()] == ["a 007", "a 99", "a 1234567890123", "a 1234567890124"]


def test_numbers_beyond_an_int_are_no_volume(spark):
    assert one(spark, t.parse_volume, "9781234567890 Dom") is None
    assert tuple(one(spark, t.parse_volume, "Tom 3")) == (3, "00") and one(spark, t.roman_value, "I") is None


def test_packed_prefilter_sees_all_blanks(spark):
    cells = spark.createDataFrame([(1, "Jan Kot\u00a0i\u00a0Ewa Lis")], "id int, cell string")
    assert [r["item"] for r in unpack(cells, "cell", PEOPLE, ["id"], 2).collect()] == ["Jan Kot", "Ewa Lis"]
