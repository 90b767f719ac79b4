import pytest
from pyspark.sql import functions as F

from folioforge.llm.containers import fill_containers
from folioforge.llm.quality import statistics


def test_too_many_container_kinds_are_an_error(spark):
    sized = spark.createDataFrame([(1, 5)], "doc_id long, tokens long")
    kinds = spark.range(1001).select(F.col("id").cast("string").alias("container"), F.lit(9).alias("capacity_tokens"))
    with pytest.raises(ValueError, match="container kinds"):
        fill_containers(sized, kinds)
    assert fill_containers(sized, kinds.where("container < 3")).select("container").distinct().count() == 3


def test_too_many_function_words_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    words = spark.range(100_001).select(F.lit("pl").alias("lang"), F.col("id").cast("string").alias("word"))
    with pytest.raises(ValueError, match="function words"):
        statistics(docs, words)


def test_configurations_are_optimal():
    """Sizes 6 and 4 in containers of 10, 7 and 5 of which nothing fits with another: the programme pairs what fits."""
    from folioforge.llm.containers import configurations, pack

    got = configurations([6, 4], [10, 10], 10)
    assert abs(sum(u for _, u in got) - 10) < 1e-6
    used = sum(c * u for c, u in got)
    assert all(abs(used - 10) < 1e-6) or (used >= 10 - 1e-6).all()
    assert configurations([5], [0], 10) == [] and abs(sum(u for _, u in configurations([7], [3], 10)) - 3) < 1e-6
    thirds = [34] * 30 + [33] * 60
    assert len(pack(sorted(thirds), 100)) == 30
