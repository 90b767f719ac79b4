import zipfile

from pyspark.sql import functions as F

from folioforge.sources.catalogs import author_dump
from folioforge.sources.files import book_files, book_metadata, name_parts, read_epub
from folioforge.sources.pages import author_list, book_details, book_pages, crawl, link_last_first, link_name, provider_rows, search_results
from folioforge.streaming.incremental import requests_to_fetch, stream_counts

OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Dom</dc:title>
<dc:creator>Kot, Jan</dc:creator><dc:subject>western</dc:subject><meta name="calibre:series" content="Cykl"/><meta name="calibre:series_index" content="2"/></metadata></package>"""


def test_dump_lines(spark):
    lines = ['/type/author\t/authors/OL1A\t1\t2020\t{"name": "Åke Holmberg"}', '/type/author\t/authors/OL2A\t1\t2020\t{"personal_name": "Jan Kot"}', "/type/work\tx\t1\t2\t{}", "broken", '/type/author\t/authors/OL3A\t1\t2020\tnot json']
    got = {r["author_id"]: r["author_last_first"] for r in author_dump(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"OL1A": "Holmberg Åke", "OL2A": "Kot Jan"}


def test_author_list_and_crawl(spark):
    link = '<a class="authorAllBooks__singleTextAuthor" href="/autor/{0}/{1}">{2}</a>'
    page = link.format(7, "jan-kot", "Kot Jan") + link.format(8, "j-r-r-van-lis", "J. R. R. van L...")
    rows = author_list(spark.createDataFrame([(1, page)], "page int, html string")).orderBy("pos").collect()
    assert [(r["source_author_id"], r["author_first_last"], r["author_last_first"]) for r in rows] == [("7", "Jan Kot", "Kot Jan"), ("8", "J.R.R. van Lis", "van Lis J.R.R.")]
    same = spark.createDataFrame([(1, 200, page), (2, 200, page), (3, 200, page), (4, 200, link.format(9, "x-y", "Y X"))], "page int, status int, html string")
    found, stats = crawl(same, 2)
    assert found.count() == 2 and sorted(map(tuple, stats.select("page", "status", "rows", "new_rows").collect())) == [(1, 200, 2, 2), (2, 200, 2, 0), (3, 200, 2, 0)]
    gone = same.withColumn("status", F.when(F.col("page") == 2, 404).otherwise(200))
    assert [r["page"] for r in crawl(gone, None)[1].collect()] == [1] and crawl(same, None)[0].count() == 3
    d = spark.createDataFrame([("ludwig-van-beethoven",)], "s string").select(link_name(F.col("s")).alias("n")).select("n", link_last_first(F.col("n")).alias("l")).first()
    assert tuple(d) == ("Ludwig van Beethoven", "van Beethoven Ludwig")


def test_pages(spark):
    hit = """<nav/><a class="authorAllBooks__singleTextTitle x" href="/ksiazka/1/dom"> Dom &amp; las </a><div class="authorAllBooks__singleTextAuthor"><a href="#">Jan Kot</a>, <a>Ewa Lis</a></div>
      <div class="listLibrary__info--cycles">Cykl: <a href="/c">Las (tom 3)</a></div><a class="authorAllBooks__singleTextTitle" href="/b">Mróz</a>"""
    got = search_results(spark.createDataFrame([(1, hit), (2, None), (3, "")], "id int, html string"), "id").orderBy("pos").collect()
    assert [(r["title"], r["authors"], r["series"], r["volume"] and tuple(r["volume"]), r["cycle_source"]) for r in got] == [
        ("Dom & las", ["Jan Kot", "Ewa Lis"], "Las", (3, "00"), "search"), ("Mróz", [], "", None, "")]
    detail = '<a class="book__category d" href="/kategoria/x">fantasy</a> Cykl: <a href="x">Las (tom 2)</a> <footer><a href="/kategoria/y">inne</a></footer>'
    r = book_details(spark.createDataFrame([(1, detail)], "id int, html string"), "id").first()
    assert r["series"] == "Las" and tuple(r["volume"]) == (2, "00") and r["genres"] == ["fantasy"]
    page = '<h1 class="book__title">Dom - Lubimyczytac.pl</h1><a href="/autor/1/jan">Jan Kot</a><a href="/autor/1/jan">JAN KOT</a><a href="/autor/2/e">Ewa Lis</a>'
    assert tuple(book_pages(spark.createDataFrame([(1, page)], "id int, html string"), "id").first()) == (1, "Dom", ["Jan Kot", "Ewa Lis"])
    bodies = [(1, '{"items":[{"fromRecord":"9"}],"records":{"9":{"title":"Dom","authors":["Kot"]}}}'), (2, "not json"), (3, '{"records":{"1":{"title":"Las"}}}')]
    got = provider_rows(spark.createDataFrame(bodies, "id int, body string"), "id", "hathitrust").collect()
    assert sorted((r["id"], r["title"], r["authors"]) for r in got) == [(1, "Dom", ["Kot"]), (3, "Las", [])]


def test_epub_and_listing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "A.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="x"><rootfile full-path="p.opf"/></c>')
        z.writestr("p.opf", OPF)
    (tmp_path / "b.epub").write_bytes(b"junk")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "d.jpg").write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in book_files(spark, str(tmp_path)).collect()] == ["A.epub", "b.epub", "c.txt"]
    got = {r["path"].rsplit("/", 1)[1]: r for r in book_metadata(spark, str(tmp_path)).collect()}
    assert got["A.epub"]["title"] == "Dom" and got["A.epub"]["creators"] == ["Kot, Jan"] and tuple(got["A.epub"]["meta_volume"]) == (2, "00") and got["A.epub"]["errors"] == []
    assert got["b.epub"]["errors"][0].startswith("epub-read:") and got["c.txt"]["core"] == "c" and read_epub(None)["error"]
    assert book_files(spark, str(tmp_path), with_epub=False).count() == 1
    parts = spark.createDataFrame([("/x/Core one -- Kot, Jan -- 2019.epub",)], "p string").select(name_parts(F.col("p")).alias("n")).first()["n"]
    assert parts["core"] == "Core one" and parts["segments"] == ["Core one", "Kot, Jan", "2019"]


def test_stream_reads_only_new_files(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").coalesce(1).write.parquet(str(folder))
    run = lambda: {tuple(r) for r in stream_counts(spark, str(folder), "*.parquet", ["k"], state).collect()}
    assert run() == {("a", 2), ("b", 1)} and run() == {("a", 2), ("b", 1)}
    spark.createDataFrame([("a",)], "k string").coalesce(1).write.mode("append").parquet(str(folder))
    assert run() == {("a", 3), ("b", 1)}


def test_failures_are_remembered_from_the_last_fetch(spark):
    at = lambda *s: [(i + 1, "u", f"2020-01-01 00:{x // 60:02d}:{x % 60:02d}", True) for i, x in enumerate(s)]
    rows = at(0, 30, 70, 100, 131) + [(9, None, "2020-01-01 00:00:00", True), (20, "v", "2020-01-01 00:00:00", False), (21, "v", "2020-01-01 09:00:00", False)]
    ev = spark.createDataFrame(rows, "event_id long, url string, ts string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["event_id"] for r in requests_to_fetch(ev, "url", "ts", "event_id", "failed", 60).collect()) == [1, 3, 5, 20]
    assert requests_to_fetch(ev.limit(0), "url", "ts", "event_id", "failed", 60).count() == 0
