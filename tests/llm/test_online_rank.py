import difflib

import __spark_entry__

VOLUME = "struct<major:int,minor:string>"


def test_every_plausible_pair_is_ranked(spark, tmp_path):
    books = [("b1", "x", "x", "Zielony mlyn", ["Jan Kotowski"], ["9781234567897"], None, None), ("b2", "y", "y", "Lekki zlodziej", ["Gustaw Gatulalal"], None, None, None),
             ("b3", "z", "z", "Srebrna latarnia", ["Ewa Lisowska i Olga Mrozik"], [], None, None), ("b4", "w", "Dawny ogrod polnocy", None, None, None, None, None)]
    found = [(1, "Calkiem inny napis", ["Ktos Obcy"], ["9781234567897"], None, None), (2, "Lekki zlodziej", ["G. Gatulalal"], None, None, None),
             (3, "Srebna latarnia", ["Olga Mrozk"], [], None, None), (4, "Dawny ogrod polnocy", ["Adam Wrona"], None, None, None), (5, "", [], None, None, None)]
    spark.createDataFrame(books, f"book_id string, stem string, core string, title string, creators array<string>, identifiers array<string>, meta_series string, meta_volume {VOLUME}").write.parquet(f"{tmp_path}/books.parquet")
    spark.createDataFrame(found, f"online_id long, title string, authors array<string>, identifiers array<string>, series string, volume {VOLUME}").write.parquet(f"{tmp_path}/online_candidates.parquet")
    spark.createDataFrame([("b1", None)], "book_id string, series string").write.parquet(f"{tmp_path}/candidates.parquet")
    got = {(r["book_id"], r["online_id"]): (r["score"], r["reason"]) for r in __spark_entry__.queries()["online_rank"](spark, str(tmp_path)).collect()}
    like = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    near = max(like(a, b) for a in ("gustaw gatulalal", "gatulalal gustaw") for b in ("g gatulalal", "gatulalal g"))
    close = max(like(a, b) for a in ("olga mrozik", "mrozik olga", "ewa lisowska", "lisowska ewa") for b in ("olga mrozk", "mrozk olga"))
    assert got["b1", 1] == (420, "isbn-exact")
    assert got["b2", 2] == (250 + int(near * 40), "title-exact")
    assert got["b3", 3] == (180 + int(like("srebrna latarnia", "srebna latarnia") * 100) + int(close * 35), "title-author-approx")
    assert got["b4", 4] == (250, "title-exact")
