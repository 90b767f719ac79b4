from pyspark.sql import functions as F

from folioforge.llm.mixture import REACH, default_size, draw_mixture, mixture_shares

TARGETS = [("a", 0.57, 2), ("b", 0.4, 2), ("tiny", 0.03, 3), ("none", 0.1, 2)]


def test_a_tiny_source_stops_at_its_cap(spark):
    rows = [(i, "a" if i % 2 else "b", 50 + i % 100) for i in range(4000)] + [(-1, "tiny", 70)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    allowed = min(REACH * 2 * sum(t for _, s, t in rows if s == x) / share for x, share in (("a", 0.57), ("b", 0.4)))
    for docs, copies in ((sized, 3), (sized.where("source <> 'tiny'"), 0)):
        got = {r["source"]: r for r in mixture_shares(draw_mixture(docs, targets), targets).collect()}
        assert got["tiny"]["copies"] == copies and got["none"]["copies"] == 0
        assert all(abs(got[s]["tokens"] / (allowed * share) - 1) < 0.01 for s, share in (("a", 0.57), ("b", 0.4)))
        assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9 and got["tiny"]["actual_share"] == copies * 70 / sum(r["tokens"] for r in got.values())


def test_a_given_size(spark):
    sized = spark.createDataFrame([(i, "a" if i % 2 else "b", 50) for i in range(4000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    assert abs(draw_mixture(sized, targets, size=60_000.0).agg(F.sum("tokens")).first()[0] / 60_000 - 1) < 0.01
    full = draw_mixture(sized, targets, size=1e9).groupBy("doc_id").count()
    assert full.count() == 4000 and full.where("count <> 2").count() == 0


def test_default_size():
    want = {"a": (0.5, 1), "b": (0.5, 1)}
    assert default_size({}, want) == 0 and default_size({"a": 10.0}, want) == REACH * 20
    assert default_size({"a": 10.0, "b": 9.0}, want) == REACH * 18
