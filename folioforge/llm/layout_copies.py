"""Duplicates hidden by layout: radix partitioning on canonical bytes, then tries.

Each row becomes canonical bytes: its key and its words, lower-case and sorted.
Buckets are byte prefixes. A bucket with more rows than ``capacity`` is split by
further bytes, beyond the longest prefix all its rows share, until every bucket
fits; the split nodes of a level (at most rows / capacity) are a table. A bucket
that is too large because one value fills it cannot be split and need not be: its
node knows its count and smallest row, so its rows are answered where they lie. All other buckets go to one task each, where a trie over
the words counts copies in its terminal nodes.

Defined results: a text without a letter is missing and takes no part, as do rows
without a key; word order, case, blanks and punctuation never matter, the number
of times a word occurs does. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from folioforge.runtime import cut

CAPACITY = 50_000
FIRST, MORE = 2, 2


def canonical(rows: DataFrame, key: str, row_id: str, text: str) -> DataFrame:
    """(row_id, b): canonical bytes of each row that has a key and a letter."""
    words = F.array_sort(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    return rows.where((F.col(key) != "") & F.col(text).rlike(r"\p{L}")).select(
        F.col(row_id).cast("long").alias("row_id"), F.encode(F.concat_ws(" ", F.concat(F.col(key), F.lit("\n")), words), "utf-8").alias("b"))


@F.arrow_udf(T.IntegerType())
def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bytes that two values share at their start."""
    return pa.array([next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q))) for p, q in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def radix_buckets(canon: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(rows with their bucket ``p``, rows of values that alone exceed ``capacity`` with smallest row and copies).

    The split nodes of a level are a table, joined to the rows that are still in
    too large buckets; only these rows are written again for the next level. The
    driver sees one count per level.
    """
    at, level = canon.select("row_id", "b", F.substring("b", 1, FIRST).alias("p")), 0
    fit, whole = [], []
    while True:
        spans = at.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"), F.min("row_id").alias("first")).where(F.col("n") > capacity)
        nodes = cut(spans.select("p", "n", "first", (F.col("lo") == F.col("hi")).alias("one"), (_shared("lo", "hi") + MORE).alias("w")), "radix-nodes")
        tag = F.concat(F.lit(f"{level}:").cast("binary"), F.col("p"))
        if not nodes.limit(1).count():
            fit.append(at.select("row_id", "b", tag.alias("p")))
            break
        fit.append(at.join(nodes.select("p"), "p", "left_anti").select("row_id", "b", tag.alias("p")))
        whole.append(at.join(nodes.where("one").select("p", "n", "first"), "p").select("row_id", F.col("first").alias("kept_row_id"), F.col("n").alias("copies")))
        deeper = at.join(nodes.where("NOT one").select("p", "w"), "p").select("row_id", "b", F.expr("substring(b, 1, w)").alias("p"))
        at, level = cut(deeper, "radix-level"), level + 1
    empty = canon.select("row_id", F.col("row_id").alias("kept_row_id"), F.col("row_id").alias("copies")).where("false")
    return reduce(DataFrame.unionByName, fit), reduce(DataFrame.unionByName, whole, empty)


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Trie over one bucket: each terminal holds [copies, smallest row]."""
    root: dict = {}
    ends = []
    for row, b in zip(pdf["row_id"].tolist(), pdf["b"].tolist()):
        node = root
        for word in bytes(b).split(b" "):
            node = node.setdefault(word, {})
        end = node.get(None)
        if end is None:
            end = node[None] = [1, row]
        else:
            end[0] += 1
            if row < end[1]:
                end[1] = row
        ends.append(end)
    return pd.DataFrame({"row_id": pdf["row_id"], "kept_row_id": [e[1] for e in ends], "copies": [e[0] for e in ends]})


def layout_copies(rows: DataFrame, key: str, row_id: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(row_id, kept_row_id, copies) of every row that takes part."""
    canon = cut(canonical(rows, key, row_id, text), "canonical")
    fit, whole = radix_buckets(canon, capacity)
    # rows of one bucket travel together; a bucket never exceeds the capacity
    return fit.groupBy("p").applyInPandas(_count, "row_id long, kept_row_id long, copies long").unionByName(whole)
