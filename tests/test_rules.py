"""Fixed cases of titles, rules, catalog, online ranking and plans."""

import re

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as t, titles
from folioforge.operators import authors, candidates, existing_names, local_names, online
from folioforge.plans import destinations as plans

V = "struct<major:int,minor:string>"
BOOK = f"book_id int, stem string, segments array<string>, core string, title string, creators array<string>, identifiers array<string>, subjects array<string>, meta_series string, meta_volume {V}, note string"


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {V if isinstance(v, tuple) or v is None else 'string'}" for i, v in enumerate(values)))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def book(i, stem, title="", creators=(), subjects=()):
    segments = [x.strip() for x in re.split(r"\s*--\s*", stem) if x.strip()]
    return (i, stem, segments, segments[0] if segments else stem, title, list(creators), [], list(subjects), "", None, None)


@pytest.mark.parametrize("title, series, volume, want", [
    ("Chronicle (Tom IV)", "Cykl", (4, "00"), "Chronicle"),
    ("Past's Price The Resonance Cycle, Book 3 [Isekai, LitRPG]", "The Resonance Cycle", (3, "00"), "Past's Price"),
    ("Bagdadzie Spotkanie w", "", None, "Spotkanie w Bagdadzie"), ("litosci Nie ma", "", None, "Nie ma litosci"),
    ("The Cycle 3", "The Cycle", (3, "00"), ""), ("", "x", (1, "00"), ""), ("Odd (.*) $1", "(.*)", (1, "00"), "Odd (.*) $1")])
def test_sanitize_title(spark, title, series, volume, want):
    assert one(spark, titles.sanitize_title, title, series, volume) == want


def test_title_parts(spark):
    assert one(spark, titles.clean_author, "Dakota Krout -, 1, 2018") == "Dakota Krout"
    assert one(spark, titles.split_authors, "Jan Kot; Ewa Lis and Al B") == ["Jan Kot", "Ewa Lis", "Al B"]
    assert one(spark, lambda c: titles.keyword_genre(F.array(c)), "Young Adult Fiction / Fantasy / Dark Fantasy") == "fantasy"
    assert one(spark, titles.strip_artifacts, "Tytul (2) Anna’s Archive") == "Tytul"
    assert one(spark, titles.strip_author, "Agatha Christie - Poirot", "Christie Agatha") == "Poirot"
    assert one(spark, titles.strip_leading_index, "03. Dom") == "Dom"
    assert one(spark, t.with_genre, "Title [fantasy]", "sci-fi") == "Title [sci-fi]"


def test_rule_candidates(spark):
    rows = [(1, "The Eldritch Artisan: Father of Constructs: Book 3 (LitRPG)", "x", ["a", "b"], None, None), (2, "Wolfman", "Completionist Chronicles 01 Bibliomancer", ["c", "Hunter, James", "Wolfman Warlock #1, 2019"], "", None),
            (3, "[Cykl Las 2] Zima", "x", None, None, None), (4, "Great Title The Long Series, Book 4", "c", [], "Opf Press", (1, "00")), (5, None, None, None, None, None),
            (6, "2. Las. Zima", "Blessed Time The Complete Series (A Box Set)", [], "Ser", (1, "00")), (7, "x" * 20000, "y" * 20000, [], None, None)]
    b = spark.createDataFrame(rows, f"book_id int, title string, core string, segments array<string>, meta_series string, meta_volume {V}")
    got = candidates.rule_candidates(b, "book_id", "title", "core")
    seen = {(r["book_id"], r["source"]): (r["score"], r["series"], r["title_override"]) for r in got.collect()}
    assert seen[1, "title:double-colon-book"] == (98, "Father of Constructs", "The Eldritch Artisan")
    assert seen[2, "core:spaced"] == (80, "Completionist Chronicles", "Bibliomancer") and seen[2, "segment:hash"] == (74, "Wolfman Warlock", "")
    assert seen[3, "title:square-bracket-series-book"] == (96, "Las", "Zima") and seen[4, "title:trailing-series-book"] == (95, "The Long Series", "Great Title")
    assert seen[6, "opf"] == (100, "Ser", "") and seen[6, "title:leading-index-dotted"] == (89, "Las", "Zima") and seen[6, "core:box-set"][2] == "The Complete Series"
    assert not any(k[0] in (5, 7) or k == (4, "opf") for k in seen)
    best = {r["book_id"]: r["series"] for r in candidates.top_series(got, "book_id").collect()}
    assert best[6] == "Ser" and best[2] == "Wolfman Warlock"
    assert candidates.rule_candidates(b.limit(0), "book_id").count() == 0


def test_series_priority_beats_score(spark):
    rows = [("b", 0, 98, "A", None, "t", "title:double-colon-book"), ("b", 1, 93, "B", None, "t", "title:series-book")]
    g = spark.createDataFrame(rows, f"book_id string, pos int, score int, series string, volume {V}, title_override string, source string")
    assert candidates.top_series(g, "book_id").first()["series"] == "B" and candidates.top_title(g, "book_id").first()["series"] == "A"


def test_existing_names(spark):
    stems = ["Author - Series - Tom 01.00 - Title [fantasy]", "1  Ake Holmberg - Ture Sventon - Tom 01.00 - Latajacy detektyw", "Christie Agatha - Poirota Wczesne sprawy - Standalone",
             "Hitchcock Alfred - Standalone - Tom 00.00 - Nowe przygody trzech detektywow (04) -Jak w komiksie", "(03) - Burzowe Kocie - Maja Lidia Kossakowska", None, ""]
    got = {r["i"]: (r["author"], r["series"], r["volume"] and tuple(r["volume"]), r["title"], r["genre"]) for r in existing_names.existing_names(spark.createDataFrame(list(enumerate(stems)), "i int, stem string"), "i").collect()}
    assert got == {0: ("Author", "Series", (1, "00"), "Title", "fantasy"), 1: ("Ake Holmberg", "Ture Sventon", (1, "00"), "Latajacy detektyw", ""),
                   2: ("Christie Agatha", "Standalone", None, "Poirota Wczesne sprawy", ""), 3: ("Hitchcock Alfred", "Nowe przygody trzech detektywow", (4, "00"), "Jak w komiksie", "")}


def test_local_records(spark):
    books = [book(1, "Completionist Chronicles 01_ Bibliomancer -- Hunter, James & Krout, Dakota -- Wolfman Warlock #1, 2019 -- Mountaindale Press -- 68b670c535b8be0930e8d69b0f45fe89 -- Anna’s Archive"),
             book(2, "Father of Constructs 03 x", "The Eldritch Artisan: Father of Constructs: Book 3 (LitRPG)", ["Renfroe, Aaron"]),
             book(3, "Blessed Time_ The Complete Series_ (A LitRPG Adventure Box Set) -- Cale Plamann -- x", "", ["Cale Plamann"]), book(4, "Ksiezycowe Miasto-01.Dom Ziemi - Sarah J. Maas"),
             book(5, "Agatha Christie - Poirota Wczesne sprawy"), book(6, "Aguirre Ann Enklawa"), book(7, "")]
    got = {r["book_id"]: r for r in local_names.local_records(spark.createDataFrame(books, BOOK)).collect()}
    says = lambda i: (got[i]["author"], got[i]["series"], got[i]["title"])
    assert says(1) == ("Hunter James & Krout Dakota", "Wolfman Warlock", "Bibliomancer") and tuple(got[1]["volume"]) == (1, "00")
    assert says(2) == ("Renfroe Aaron", "Father of Constructs", "The Eldritch Artisan") and says(3) == ("Plamann Cale", "Blessed Time", "The Complete Series")
    assert says(4) == ("Maas Sarah J.", "Ksiezycowe Miasto", "Dom Ziemi") and says(5) == ("Christie Agatha", "Standalone", "Poirota Wczesne sprawy")
    assert got[5]["source"] == "hybrid:delimited-author-title" and says(6) == ("Aguirre Ann", "Standalone", "Enklawa") and got[6]["source"] == "hybrid:compact-author-title"
    assert len(got) == 7


def catalog(spark, *names):
    rows = [("ol", n, n, "") for n in names]
    return authors.build_catalog(spark.createDataFrame(rows, "source string, author_raw string, author_first_last string, author_last_first string"))


def test_catalog(spark):
    known = catalog(spark, "Ann Aguirre", "Alfred Hitch Cock", "Robert Ludlum", "Eric van Lustbader")
    texts = spark.createDataFrame([(1, "Aguirre Ann"), (2, "Hitchcock Alfred"), (3, "Nikt"), (4, None), (5, "Aguirre Ann")], "i int, a string")
    assert {r["i"]: r["canonical"] for r in authors.resolve(texts, "a", known.aliases).collect()} == {1: "Ann Aguirre", 2: "Alfred Hitchcock", 3: None, 4: None, 5: "Ann Aguirre"}
    cores = spark.createDataFrame([(1, "Aguirre Ann Enklawa"), (2, "Enklawa Ann Aguirre"), (3, "x")], "i int, core string")
    assert [tuple(r) for r in authors.known_ends(cores, "i", "core", known).collect()] == [(1, "Ann Aguirre", "Enklawa")]
    assert [tuple(r) for r in authors.known_ends(cores, "i", "core", known, suffix=True).collect()] == [(2, "Ann Aguirre", "Enklawa")]
    mixed = spark.createDataFrame([(1, "Bourne'a Ludlum Robert Van Lustbader Eric"), (2, "Ann Aguirre & Robert Ludlum"), (3, "Nic tu nie ma"), (4, None)], "i int, a string")
    got = {r["i"]: r["authors"] for r in authors.known_authors(mixed, "i", "a", known).collect()}
    assert got == {1: ["Robert Ludlum", "Eric van Lustbader"], 2: ["Ann Aguirre", "Robert Ludlum"], 3: [], 4: []}


def test_best_path_is_the_best_of_all():
    spans = [{"start": 0, "stop": 2, "author": "a"}, {"start": 1, "stop": 4, "author": "b"}, {"start": 2, "stop": 4, "author": "c"}, {"start": 4, "stop": 6, "author": "d"}]
    assert authors.best_path(spans) == ["a", "c", "d"] and authors.best_path(spans, 1) == ["b"] and authors.best_path([]) == []


def test_ingest_and_merge(spark):
    cols = "id long, source string, author_raw string, author_first_last string, author_last_first string, confidence string"
    raw = spark.createDataFrame([(1, "ol", "Åke 1907-1991 Holmberg", "Åke 1907-1991 Holmberg", "Holmberg Åke", "low"), (2, "lubimyczytac", "Ake Holmberg", "Ake Holmberg", "Holmberg Ake", "high"), (3, "ol", "0870005719", "", None, None),
                                 (4, "ol", "Jane Doe", "Jane Doe", "Doe Jane", "medium"), (5, "ol", "Goodale Steam Car Brake Manufacturing Company", "", "", "")], cols)
    kept = authors.ingest_patterns(raw, "id")
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4]
    merged = {r["group_key"]: r for r in authors.merge_authors(kept.withColumnRenamed("id", "row_id")).collect()}
    assert len(merged) == 2 and merged["akeholmberg"]["author_first_last"] == "Ake Holmberg" and merged["akeholmberg"]["source"] == "lc | ol" and merged["akeholmberg"]["author_raw"] == ""
    assert one(spark, authors.strip_noise, "-1834 (Samuel E. Smith )") == "Samuel E Smith"


ONLINE = f"book_id int, online_id long, provider string, source string, title string, authors array<string>, identifiers array<string>, score int, reason string, series string, volume {V}, genre string, cycle_source string"


def test_best_online(spark):
    books = spark.createDataFrame([book(1, "Right Book", "Right Book", ["Test Author"]), book(2, "Some Book", "Some Book"), book(3, "Tom 1 Czerwona Krolowa", "Tom 1 Czerwona Krolowa")], BOOK)
    row = lambda b, i, p, title, s, who=("Test Author",), ids=(): (b, i, p, p, title, list(who), list(ids), s, "title-exact", None, None, None, None)
    rows = spark.createDataFrame([row(1, 1, "google-books", "Right Book", 300), row(1, 2, "open-library", "Right Book Deluxe", 284), row(2, 3, "lubimyczytac", "Some Book", 320), row(3, 4, "lubimyczytac", "Czerwona Krolowa", 320),
                                  row(3, 5, "google-books", "Czerwona Krolowa Deluxe", 300)], ONLINE)
    got = {r["book_id"]: r for r in online.best_online(online.consensus(rows, "online_id", "book_id"), books).collect()}
    assert got[1]["reason"] == "title-exact+ambiguous" and got[1]["score"] == 290
    assert got[2]["reason"].endswith("best-effort") and got[2]["score"] == 305 and "best-effort" not in got[3]["reason"] and got[3]["providers"] == ["lubimyczytac"]
    two = online.consensus(spark.createDataFrame([row(1, 1, "google-books", "A", 300, ids=["9781234567897"]), row(1, 2, "lubimyczytac", "A", 320), row(1, 3, "crossref", "A", 100)], ONLINE), "online_id", "book_id").collect()
    assert sorted((tuple(r["providers"]), r["score"], r["reason"]) for r in two) == [(("google-books",), 300, "title-exact"), (("lubimyczytac", "crossref"), 345, "title-exact+consensus")]
    close = spark.createDataFrame([(1, 1, 450), (1, 2, 449), (2, 3, 5), (2, 4, 1)], "g int, i int, score int")
    assert {r["g"]: (r["score"], r["ambiguous"]) for r in online.ambiguity(close, "g", "i").collect()} == {1: (450, False), 2: (0, True)}


def test_providers_asked(spark):
    rows = spark.createDataFrame([(1, 1, "lubimyczytac", "title-author-exact", 300), (1, 2, "google-books", "approx", 90), (1, 3, "crossref", "isbn-exact", 420), (1, 4, "hathitrust", "approx", 1)], "book_id int, i int, provider string, reason string, score int")
    asked = lambda mode: sorted(r["i"] for r in online.providers_asked(rows, mode).collect())
    assert asked("PL") == [1] and asked("PL+") == [1] and asked("EN") == [2, 3]


def test_names_without_collisions(spark):
    rows = spark.createDataFrame([(1, "f", "Book", "epub", 90), (2, "f", "book", "epub", 90), (3, "f", "Book (1)", "epub", 90), (4, "f", "Old", "epub", 90), (5, "f", "OLD", "epub", 2), (6, "g", "Book", "epub", 90)],
                                 "id int, folder string, stem string, ext string, confidence int")
    held = spark.createDataFrame([("f", "old", "EPUB"), ("f/dubel", "Old", "epub")], "folder string, stem string, ext string")
    got = {r["id"]: (r["folder"], r["final_stem"], r["confidence"]) for r in plans.assign_names(rows, held, "f", "id").collect()}
    assert got == {1: ("f", "Book", 90), 2: ("f", "book (2)", 80), 3: ("f", "Book (1)", 90), 4: ("f/dubel", "Old (1)", 82), 5: ("f/dubel", "OLD (2)", 0), 6: ("g", "Book", 90)}


def test_undo_and_manifest(spark):
    log = spark.createDataFrame([(1, "a.txt", "b.txt", "s", "t", "apply", "copied", "copy", "", ""), (2, "c.txt", "d.txt", "s", "t", "apply", "copied+archived", "copy+archive", "c.txt", "z"),
                                 (3, "e", "f", "s", "t", "dry-run", "planned", "rename", "", ""), (4, "g", "h", "s", "t", "apply", "failed", "rename", "", "")],
                                "id int, source_name string, target_name string, source_folder string, target_folder string, mode string, execution_status string, operation string, archive_source_name string, archive_source_folder string")
    got = sorted((r["id"], r["step"], r["operation"], r["source"], r["destination"]) for r in plans.undo_plan(log, "id").collect())
    assert got == [(1, 1, "delete", "t/b.txt", "s/a.txt"), (2, 1, "move", "z/c.txt", "s/c.txt"), (2, 2, "delete", "t/d.txt", "s/c.txt")]
    with pytest.raises(ValueError):
        plans.undo_plan(log.drop("mode"), "id")
    held = plans.read_manifest(spark.createDataFrame([('{"version":1,"entries":{"/x/Old.epub":{"status":"copied","size":3,"mtime_ns":5},"b":null}}',), ("broken",)], "value string"))
    assert [tuple(r)[:2] for r in held.select("key", "source_name").collect()] == [("old.epub", "Old.epub")]
    files = spark.createDataFrame([("OLD.epub", 3, 5), ("Old.epub", 4, 5), ("new", 1, 1)], "name string, size long, mtime_ns long")
    assert sorted(r["size"] for r in plans.skip_processed(files, held).collect()) == [1, 4]
    best = plans.conversion_source(spark.createDataFrame([("f", "Book", "f/Book.txt", 9), ("f", "book", "f/book.azw3", 1)], "folder string, stem string, path string, size long"), "folder", "stem").first()
    assert best["path"] == "f/book.azw3" and best["action"] == "convert"


def test_verification(spark):
    from folioforge.operators import verify

    books = spark.createDataFrame([book(1, "Dom", "Dom", ["Jan Kot"]), book(2, "Las", "Las")], BOOK)
    records = spark.createDataFrame([(1, "Kot Jan", "Cykl", (2, "00"), "Dom"), (2, "Nieznany Autor", "Standalone", None, "Las")], f"book_id int, author string, series string, volume {V}, title string")
    rows = [(1, 1, "google-books", 320, "title-author-exact", "Dom", ["J. Kot", "Jan Kot"], None, None, None), (1, 2, "lubimyczytac", 300, "title-exact", "Dom", ["Jan Kot"], "Cykl", (2, "00"), "detail"),
            (1, 3, "crossref", 300, "title-exact", "Dom", ["Jan Kot"], None, None, None), (2, 4, "open-library", 200, "title-exact", "Las", ["Ewa Lis"], "Gora", (1, "00"), "search"), (2, 5, "crossref", 100, "approx", "Inny tytul", None, None, None, None)]
    found = spark.createDataFrame(rows, f"book_id int, pos int, provider string, score int, reason string, title string, authors array<string>, series string, volume {V}, cycle_source string")
    pairs = verify.with_support(verify.pair_up(records, books, found))
    assert {r["pos"]: r["supports"] for r in pairs.collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}
    got = {r["book_id"]: tuple(r)[1:] for r in verify.verification(pairs).collect()}
    assert got == {1: (True, True, True, True, ["google-books", "lubimyczytac"]), 2: (False, True, False, False, ["open-library", "crossref"])}
    said = {(r["book_id"], r["role"], r["label"]) for r in verify.role_evidence(pairs).collect()}
    assert (1, "series", "Cykl") in said and (1, "volume", "2.00") in said and (2, "author", "Lis Ewa") in said and not any(x[1] == "series" and x[0] == 2 for x in said)
    assert verify.verification(pairs.limit(0)).count() == 0


def test_arbitration(spark):
    from folioforge.operators import arbitration

    cols = f"i int, author string, series string, volume {V}, title string, genre string, source string, confidence int, notes array<string>, review_reasons array<string>, decision_reasons array<string>, own_title string"
    records = spark.createDataFrame([(1, "Nieznany Autor", "Standalone", None, "Dom", "", "fallback", 40, [], ["nieznany-autor", "inne"], None, "Dom"), (2, "Kot Jan", "Cykl", (1, "00"), "Las", "", "opf", 90, None, None, None, None),
                                     (3, "Kot Jan", "Cykl", None, "Las", "", "opf", 90, [], ["seria-bez-tomu"], [], "Las"), (4, "A B", "S", None, "", "", "x", 10, [], [], [], "")], cols)
    replies = spark.createDataFrame([(1, '```json\n{"author":"Lis Ewa","series":"Cykl","volume":[2,"5"],"title":"Dom","confidence":95,"decision_reasons":["x"]}\n```'), (3, '{"author":"Kot Jan","title":"kot jan","confidence":99}'), (4, "nic")], "i int, response_text string")
    got = {r["i"]: r for r in arbitration.arbitrate(records, replies, "i", "AUTO").collect()}
    assert got[1]["arbitration"] == "applied" and got[1]["author"] == "Lis Ewa" and tuple(got[1]["volume"]) == (2, "05") and got[1]["review_reasons"] == ["inne"] and got[1]["decision_reasons"] == ["x", "ai-local:auto-applied"]
    assert got[2]["arbitration"] is None and got[3]["arbitration"] == "error" and got[4]["arbitration"] == "error"
    assert {r["i"]: r["arbitration"] for r in arbitration.arbitrate(records, replies, "i", "ASSIST").collect()} == {1: "suggested", 2: None, 3: "error", 4: "error"}
    assert arbitration.requests(records, "i").count() == 3 and {r["i"]: r["error"] for r in arbitration.answers(replies, "i").collect()} == {1: None, 3: "title equals author", 4: "no object"}


def test_searches_and_updates(spark):
    from folioforge.operators import searches

    rows = [(1, "Kot Jan", "Cykl", (2, "00"), "Dom", "Dom wielki", "Kot Jan - Dom nad rzeka", ["Jan Kot"]), (2, "Nieznany Autor", "Standalone", None, "Las", None, "Las", None), (3, None, None, None, None, None, None, None)]
    r = spark.createDataFrame(rows, f"i int, author string, series string, volume {V}, title string, own_title string, core string, creators array<string>")
    got = {(x["i"], x["pos"]): (x["title"], x["creators"]) for x in searches.search_variants(r, "i").collect()}
    assert got[1, 0] == ("Dom", ["Jan Kot", "Kot Jan"]) and got[1, 1][0] == "Cykl Dom" and got[1, 2] == ("Dom nad rzeka", []) and got[1, 3][0] == "Dom wielki" and got[2, 0] == ("Las", []) and not any(k[0] == 3 for k in got)
    b = spark.createDataFrame([(1, 'Dom. Las "x" (y)', "c", ["Jan van Kot"]), (2, None, None, None)], "i int, title string, core string, creators array<string>")
    terms = [x["term"] for x in searches.local_terms(b, "i").orderBy("pos").collect()]
    assert terms[-1] == "Dom" and any(x.startswith("Kot ") for x in terms) and len(set(terms)) == len(terms)
    rec = spark.createDataFrame([(1, "Kot Jan & Lis Ewa", "Cykl", (2, "5"), "Dom", "fantasy", ["isbn:9781234567897", "goodreads:12"], "Fantasy, magia;x"), (2, None, "Standalone", (1, "00"), None, None, None, None)],
                                f"i int, author string, series string, volume {V}, title string, genre string, identifiers array<string>, tags string")
    u = {x["i"]: x for x in plans.metadata_updates(rec, "i", "tags").collect()}
    assert u[1]["creators"] == ["Kot Jan", "Lis Ewa"] and u[1]["series_index"] == "2.05" and u[1]["subjects"] == ["fantasy", "magia", "x"] and u[1]["isbns"] == ["9781234567897"] and u[1]["other_ids"] == ["goodreads:12"]
    assert u[2]["series"] is None and u[2]["creators"] == []
    assert one(spark, titles.distinct_labels, " Killim, Killim ;  Arka |  ") == ["Killim", "Arka"]


def test_stores_and_names(spark, tmp_path):
    from folioforge.sources import stores

    known = catalog(spark, "Ann Aguirre", "Robert Ludlum")
    assert stores.load_catalog(spark, str(tmp_path / "c"), "x") is None
    stores.save_catalog(known, str(tmp_path / "c"), "x")
    again = stores.load_catalog(spark, str(tmp_path / "c"), "x")
    assert sorted(again.aliases.collect()) == sorted(known.aliases.collect()) and stores.load_catalog(spark, str(tmp_path / "c"), "y") is None
    rows = spark.createDataFrame([(1, "Ludlum Robert", ["Inny Tekst"]), (2, "Dom", ["Ann Aguirre"]), (3, None, None)], "i int, title string, creators array<string>")
    got = {r["i"]: (r["title"], r["creators"], r["swapped"]) for r in authors.swapped_back(rows, "i", known).collect()}
    assert got == {1: ("", ["Robert Ludlum"], True), 2: ("Dom", ["Ann Aguirre"], False), 3: (None, None, False)}
    (tmp_path / "cache.json").write_text('{"json:https://a.pl/x:1": "{}", "json:u": null, "text:https://b": "<html>"}')
    cache = stores.read_cache(spark, str(tmp_path / "cache.json"))
    assert sorted((r["kind"], r["url"]) for r in cache.collect()) == [("json", "https://a.pl/x:1"), ("json", "u")]
    assert stores.update_cache(cache, spark.createDataFrame([("json", "u", "{1}")], "kind string, url string, body string")).count() == 2
    hosts = spark.createDataFrame([("https://a.pl/x",), ("http://www.a.pl",), ("https://ba.pl",), ("junk",), (None,)], "u string")
    assert [r[0] for r in hosts.select(stores.is_host(F.col("u"), "a.pl")).collect()] == [True, True, False, False, False]
    report = plans.report(spark.createDataFrame([("a; b", "c", "s", "t", "Kot", "", None, "Dom", "", "x", ["1"], [], 90, [], [], True, False, None, None, None)], f"source_name string, target_name string, source_folder string, target_folder string, author string, series string, volume {V}, title string, genre string, source string, identifiers array<string>, notes array<string>, confidence int, review_reasons array<string>, decision_reasons array<string>, online_checked boolean, online_applied boolean, status string, metadata_status string, archive_source_path string"), "copy", True)
    assert len(report.columns) == 27
    plans.write_report(report, str(tmp_path / "r"))
    back = stores.read_report(spark, str(tmp_path / "r")).first()
    assert back["source_name"] == "a; b" and back["execution_status"] == "planned" and back["tom"] == "Tom 00.00"
    assert one(spark, titles.display_name, "van Lustbader Eric") == "Eric van Lustbader" and one(spark, titles.display_name, "Kot") == "Kot"
    assert one(spark, titles.keeps_authors, "Kot Jan & Lis Ewa", "Kot Jan") and not one(spark, titles.keeps_authors, "Kot Jan", "Lis Ewa")
    assert one(spark, titles.keeps_authors, "Kot Jan & Lis Ewa", "K J & Lis Ewa") and not one(spark, titles.keeps_authors, "Kot Jan & Lis Ewa", "Kot Janek & Lis Ewa")


def test_empty_titles_are_not_alike(spark):
    books = spark.createDataFrame([(1, "", "", None, None)], "book_id int, title string, core string, creators array<string>, identifiers array<string>")
    found = spark.createDataFrame([(5, "", None, None), (6, "Dom", None, None)], "online_id int, title string, authors array<string>, identifiers array<string>")
    got = online.rank_pairs(spark.createDataFrame([(1, 5), (1, 6)], "book_id int, online_id int"), books, found)
    assert sorted((r["online_id"], r["score"], r["reason"]) for r in got.collect()) == [(5, 100, "approx"), (6, 100, "approx")]
