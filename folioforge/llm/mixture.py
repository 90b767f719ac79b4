"""Mixing sources to target token shares by Poisson replication.

Each document gets a number u in (0, 1) from a seeded hash of its id; its count
is the Poisson quantile at u for its source's rate, capped at the source's
``max_repeats``. The rate starts from the target repetition rate and is settled
on the data: the count of every document grows with the rate, so a histogram of
tokens over rates (a few thousand sums per source, refined twice) shows the rate
at which the source's tokens meet their target. The mixture's size is given, or
the largest at which every well-stocked source meets its share at ``REACH`` of
its capped tokens. A source that can't reach its share stops at ``max_repeats``
of each document, and ``mixture_shares`` has its actual share.

Defined results: documents of a source without a target, with NULL source or id
or without tokens are left out; a target source without documents has actual
share 0 and does not bind the size; equal ids in one source share their u.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

REACH = 0.95
#: A source is well-stocked if it allows this part at least of the size that sources of half the target shares allow.
STOCKED = 0.1
BINS = 2048
LOW, HIGH = 1e-4, 80.0


def uniform(id_col: str, seed: int):
    """Number in (0, 1) from the seeded hash of an id."""
    return (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 12).cast("double") + 0.5) / float(2**52)


def poisson_cdf(k: int, rate: np.ndarray) -> np.ndarray:
    """P(count <= k) for each rate."""
    term, total = np.exp(-rate), np.exp(-rate)
    for j in range(1, k + 1):
        term = term * rate / j
        total = total + term
    return total


def _histogram(docs: DataFrame, grids: dict[str, np.ndarray], caps: dict[str, int]) -> dict[str, np.ndarray]:
    """Tokens that the copies switching on up to each rate of the grid bring, per source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            src = np.array(b.column(0).to_pylist(), object)
            u, tok = b.column(1).to_numpy(), b.column(2).to_numpy().astype(float)
            for s in set(src):
                own = src == s
                grid, bins = grids[s], sums.setdefault(s, np.zeros(len(grids[s]) + 1))
                for k in range(caps[s]):
                    # a document has more than k copies from the first rate with P(count <= k) < u
                    at = np.searchsorted(-poisson_cdf(k, grid), -u[own], side="right")
                    bins += np.bincount(at, weights=tok[own], minlength=len(bins))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["source", "h"])

    parts = docs.select("source", "u", "tokens").mapInArrow(run, "source string, h array<double>")
    out = {s: np.zeros(len(g) + 1) for s, g in grids.items()}
    for r in parts.select("source", F.posexplode("h")).groupBy("source", "pos").agg(F.sum("col").alias("v")).collect():
        out[r["source"]][r["pos"]] = r["v"]
    return out


def settle_rates(docs: DataFrame, targets: dict[str, float], caps: dict[str, int]) -> dict[str, float]:
    """Rate per source at which its tokens meet ``targets``, by two histograms."""
    grids = {s: np.geomspace(LOW, HIGH, BINS) for s in targets}
    rates: dict[str, float] = {}
    for _ in range(2):
        hist = _histogram(docs, grids, caps)
        for s, want in targets.items():
            reached = np.cumsum(hist[s])[:-1]
            at = int(np.searchsorted(reached, want))
            hi, lo = min(at, BINS - 1), max(0, min(at, BINS - 1) - 1)
            near = hi if abs(reached[hi] - want) <= abs(reached[lo] - want) else lo
            rates[s] = float(grids[s][near])
            grids[s] = np.linspace(grids[s][lo], grids[s][hi] * (1 + 1e-9), BINS)
    return rates


def default_size(have: dict[str, float], want: dict[str, tuple[float, int]]) -> float:
    """Tokens of the mixture from the well-stocked of the sources ``want`` (share, cap), given the tokens they ``have``."""
    allows = sorted((REACH * cap * have.get(s, 0.0) / share, share) for s, (share, cap) in want.items())
    some = [x for x, _ in allows if x > 0]
    if not some:
        return 0.0
    half, usual = sum(share for _, share in allows) / 2, 0.0
    for x, share in allows:
        usual, half = x, half - share
        if half <= 0:
            break
    return min(x for x in some if x >= STOCKED * usual)


def draw_mixture(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 17, size: float | None = None) -> DataFrame:
    """(id_col, source, tokens, copy_no, mix_key), in global random order by ``mix_key``.

    ``sized`` has the id, ``source`` and ``tokens``; ``targets`` is the short list
    (source, target_share, max_repeats); ``size`` is the tokens of the mixture
    that the shares are of, ``default_size`` if not given.
    """
    spark = sized.sparkSession
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where(
        "source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").collect()}
    docs = sized.where(F.col("source").isin(list(want)) & F.col(id_col).isNotNull() & (F.col("tokens") > 0)).select(
        id_col, "source", F.col("tokens").cast("long").alias("tokens"), uniform(id_col, seed).alias("u"))
    have = {r["source"]: float(r["t"]) for r in docs.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = default_size(have, want) if size is None else size
    caps = {s: want[s][1] for s in have}
    short = [s for s in have if total * want[s][0] >= caps[s] * have[s]]
    enough = docs.where(~F.col("source").isin(short)) if short else docs
    rates = settle_rates(enough, {s: total * want[s][0] for s in have if s not in short}, caps) if len(short) < len(have) else {}
    steps = [(s, [float(poisson_cdf(k, np.array([rates[s]]))[0]) for k in range(caps[s])]) for s in rates]
    steps += [(s, [0.0] * caps[s]) for s in short]
    known = F.broadcast(spark.createDataFrame(steps, "source string, steps array<double>"))
    counted = docs.join(known, "source").withColumn("n", F.size(F.filter("steps", lambda p: p < F.col("u")))).where("n > 0")
    copies = counted.select(id_col, "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    return copies.withColumn("mix_key", F.xxhash64(F.col(id_col), F.col("copy_no"), F.lit(seed + 1))).orderBy("mix_key", id_col, "copy_no")


def mixture_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual token share of each target source."""
    by = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.max("copy_no").alias("most_repeats"))
    rows = F.broadcast(targets).join(by, "source", "left").na.fill(0, ["tokens", "copies", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over the short list of sources only
    return rows.select(
        "source", "target_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), "max_repeats", "most_repeats", "copies", "tokens")
