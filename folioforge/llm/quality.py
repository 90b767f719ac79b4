"""Text quality: robust Mahalanobis distance from the prose of a page's language.

One pass computes the statistics of every whole text. Per language, mean and
covariance of prose come from concentration steps: start at medians and scaled
absolute deviations, then twice keep the pages within the chi-square bound and
recompute. Only sums, one small row per language, ever reach the driver.
The distance splits exactly into one contribution per statistic,
``(x - m)_i * [S^-1 (x - m)]_i``.

Defined results: a page of NULL or blank text has statistics 0, no language,
kind ``junk`` and a NULL distance. Repeated rows each get their own result.
A language with fewer pages than ``LEAST`` uses the pooled model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioforge.llm.page_stats import NAMES, page_stats
from folioforge.runtime import cut, short_list

K = len(NAMES)
#: 0.999 quantile of chi-square with as many degrees as statistics (16).
BOUND = 39.25
LEAST = 20 * K
FLOOR = 0.01
STATS = ", ".join(f"{n} double" for n in NAMES)
AT = {n: i for i, n in enumerate(NAMES)}


def statistics(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, statistics...) of each page; ``words`` is the fixed list of function words."""
    stop: dict[str, set] = {}
    for lang, word in short_list(words.where("word is not null and lang is not null").select("lang", "word"), 100_000, "function words"):
        stop.setdefault(lang, set()).add(word.lower())
    frozen = {k: frozenset(v) for k, v in stop.items()}
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = [], []
            for text in batch.column(1).to_pylist():
                lang, vals = page_stats(text, frozen)
                langs.append(lang)
                rows.append(vals)
            m = np.array(rows, float).reshape(-1, K)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), *[pa.array(m[:, i]) for i in range(K)]],
                ["id", "language", *NAMES])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type.simpleString()}, language string, {STATS}")


def _start(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Medians and diagonal scale per language, and pooled under ''."""
    both = stats.where("log_words > 0").select(F.explode(F.array_distinct(F.array(F.col("language"), F.lit("")))).alias("lang"), *NAMES)
    med = [F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(n) for n in NAMES]
    out = {}
    for r in both.groupBy("lang").agg(F.count("*").alias("n"), *med).collect():
        q = np.array([r[n] for n in NAMES])
        if r["n"] >= LEAST or r["lang"] == "":
            out[r["lang"]] = (q[:, 1], np.diag(1 / np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR) ** 2))
    return out


def _squared(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    d = x - model[0]
    return d * (d @ model[1])


def _pick(models: dict, lang: str):
    return models.get(lang) or models[""]


def _concentrate(stats: DataFrame, models: dict) -> dict:
    """Mean and inverse covariance of the pages within the bound of ``models``."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            x = np.column_stack([batch.column(i + 1).to_numpy() for i in range(K)])
            for lang in set(langs):
                own = x[langs == lang]
                own = own[_squared(own, _pick(models, lang)).sum(1) <= BOUND]
                one = np.column_stack([np.ones(len(own)), own])
                for key in {lang if lang in models else "", ""}:
                    sums[key] = sums.get(key, 0) + one.T @ one
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([sums[k].ravel().tolist() for k in keys], pa.list_(pa.float64()))], ["lang", "m"])

    parts = stats.where("log_words > 0").select("language", *NAMES).mapInArrow(moments, "lang string, m array<double>")
    rows = parts.select("lang", F.posexplode("m")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()
    out = {}
    for lang in {r["lang"] for r in rows}:
        m = np.zeros((K + 1) ** 2)
        for r in rows:
            if r["lang"] == lang:
                m[r["pos"]] = r["v"]
        m = m.reshape(K + 1, K + 1)
        n = max(m[0, 0], 1.0)
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean) + np.eye(K) * FLOOR**2
        out[lang] = (mean, np.linalg.inv(cov))
    return out if "" in out else models


def prose_models(stats: DataFrame, steps: int = 2) -> dict:
    """Mean and inverse covariance of prose by language, '' for all pages."""
    models = _start(stats)
    if not models:
        return {"": (np.zeros(K), np.eye(K))}
    for _ in range(steps):
        models = _concentrate(stats, models)
    return models


#: The statistics whose excess over prose tells each kind.
SIGNS = {
    "junk": ("noise_line_share", "symbol_share", "loop_share", "odd_word_share", "stop_share"),
    "table": ("cell_line_share", "digit_share"),
    "list": ("item_line_share", "shape_share"),
}


def page_kind(x: np.ndarray, parts: np.ndarray, excess: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Kind of each page, ``prose`` if it is not outlying.

    Of the kinds that a page is mostly made of, the one whose statistics contribute
    most to its distance, counting those above prose only. ``parts`` are the
    contributions, ``excess`` the statistics less those of prose.
    """
    g = lambda n: x[:, AT[n]]
    mostly = {
        "junk": (g("noise_line_share") > 0.4) | (g("symbol_share") > 0.4) | (g("loop_share") > 0.4)
        | (g("odd_word_share") > 0.06) | ((g("stop_share") > 0.7) & (g("symbol_share") > 0.1)) | (g("stop_share") > 0.8),
        "table": g("cell_line_share") >= 0.5,
        "list": (g("item_line_share") >= 0.5) | (g("shape_share") + g("item_line_share") * (g("shape_share") < 0.5) >= 0.56),
    }
    above = np.where(excess > 0, np.maximum(parts, 0.0), 0.0)
    share = np.column_stack([np.where(mostly[k], above[:, [AT[n] for n in names]].sum(1), -1.0) for k, names in SIGNS.items()])
    kind = np.array(list(SIGNS), object)[share.argmax(1)]
    kind[(share.max(1) < 0) | ~far] = "prose"
    kind[g("log_words") + g("digit_share") + g("symbol_share") == 0] = "junk"
    return kind


def judge(stats: DataFrame, models: dict) -> DataFrame:
    """(id, language, distance, contributions, kind) of each page."""
    id_type = stats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            x = np.column_stack([batch.column(i + 2).to_numpy() for i in range(K)]).reshape(-1, K)
            parts, excess = np.zeros_like(x), np.zeros_like(x)
            for lang in set(langs):
                parts[langs == lang] = _squared(x[langs == lang], _pick(models, lang))
                excess[langs == lang] = x[langs == lang] - _pick(models, lang)[0]
            d2 = parts.sum(1)
            blank = ~x.any(1)
            dist = [None if b else float(np.sqrt(max(v, 0.0))) for b, v in zip(blank, d2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dist, pa.float64()),
                 pa.array(list(parts), pa.list_(pa.float64())), pa.array(list(page_kind(x, parts, excess, d2 > BOUND)), pa.string())],
                ["id", "language", "distance", "parts", "kind"])

    return stats.mapInArrow(run, f"id {id_type}, language string, distance double, parts array<double>, kind string")


def page_quality(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics' verdict on every page; the statistics are written once and read three times."""
    stats = cut(statistics(docs, words, id_col, text_col), "page-stats")
    return judge(stats, prose_models(stats)).withColumnRenamed("id", id_col)
