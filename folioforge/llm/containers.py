"""Filling fixed-capacity containers by linear grouping.

Documents are hashed into shards of bounded size, each packed on its own:
lengths above a share of the capacity are sorted, cut into groups of equal
cardinality and rounded up to the largest of their group; configurations of
those few sizes are optimised over the whole stock by a linear programme with
columns made on demand, used as often as its whole numbers say, and for the rest
chosen one at a time as the fullest the stock allows. Actual documents replace the rounded
sizes, the last of a container by the space really free, and what then stays
free is filled best-fit by the small documents, the longest first. Every document is placed once per container kind.

Defined results: a document longer than the capacity gives full containers of
its own and one rest piece (``piece`` counts from 1, ``from_token`` from 0);
documents of 0 tokens take place 0 tokens wide; repeated ids are packed as rows
of their own; NULL ids get shard 0; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioforge.runtime import short_list

SHARD_DOCS = 20_000
GROUPS = 18
LARGE = 1 / 8
OUT = ("container string, capacity int, doc_id {0}, piece int, from_token long, tokens int, bin string, place int, bin_tokens int")


def _fullest(sizes: list[int], left: list[int], cap: int) -> list[int]:
    """Subset of the stock with the largest total within ``cap``, holding the largest size left."""
    first = max((g for g in range(len(sizes)) if left[g]), key=lambda g: sizes[g])
    room = cap - sizes[first]
    reach: dict[int, tuple[int, int] | None] = {0: None}
    for g in sorted(range(len(sizes)), key=lambda g: -sizes[g]):
        have = left[g] - (g == first)
        if not have or sizes[g] > room:
            continue
        for total in list(reach):
            at = total
            for _ in range(min(have, (room - total) // sizes[g])):
                at += sizes[g]
                if at in reach:
                    break
                reach[at] = (g, at - sizes[g])
    at, picked = max(reach), [first]
    while reach[at] is not None:
        g, at = reach[at]
        picked.append(g)
    return picked


def _best_configuration(sizes: list[int], price: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Worth and counts of the configuration within ``cap`` worth most at the prices.

    Large sizes leave room for few items, so one pass per item over all fills is enough.
    """
    best, steps = np.zeros(cap + 1), []
    for _ in range(cap // min(sizes)):
        worth, pick = best.copy(), np.full(cap + 1, -1)
        for g, size in enumerate(sizes):
            more = best[: cap + 1 - size] + price[g]
            better = more > worth[size:] + 1e-12
            worth[size:][better], pick[size:][better] = more[better], g
        if (pick < 0).all():
            break
        steps.append(pick)
        best = worth
    counts, at = np.zeros(len(sizes), int), int(best.argmax())
    for pick in reversed(steps):
        if pick[at] >= 0:
            counts[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(best.max()), counts


def configurations(sizes: list[int], stock: list[int], cap: int, most: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in the cheapest fractional filling of the whole stock.

    The linear programme has one row per size and a column for every configuration
    there could be; columns are made as their price asks for them. The basis starts
    with containers of one size each.
    """
    keep = [g for g in range(len(sizes)) if stock[g] > 0]
    if not keep:
        return []
    own, need = [sizes[g] for g in keep], np.array([stock[g] for g in keep], float)
    basis = np.diag([float(cap // x) for x in own])
    for _ in range(most):
        inverse = np.linalg.inv(basis)
        used, price = inverse @ need, np.ones(len(own)) @ inverse
        worth, column = _best_configuration(own, np.maximum(price, 0.0), cap)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1.0), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = column
    used = np.linalg.inv(basis) @ need
    out = []
    for j in range(len(own)):
        counts = np.zeros(len(sizes), int)
        counts[keep] = np.rint(basis[:, j]).astype(int)
        out.append((counts, max(0.0, float(used[j]))))
    return sorted(out, key=lambda x: (-int(x[0] @ np.array(sizes)), tuple(-x[0])))


def pack(lengths: list[int], cap: int, groups: int = GROUPS, large: float = LARGE) -> list[list[tuple[int, int, int, int]]]:
    """Containers as lists of (item, piece, from_token, tokens).

    Both ways are packed, the optimised configurations and the fullest one at a
    time, which leaves fewer odd gaps where small documents abound; the fewer containers count.
    """
    return min((_pack(lengths, cap, groups, large, best) for best in (True, False)), key=len)


def _pack(lengths: list[int], cap: int, groups: int, large: float, optimised: bool) -> list[list[tuple[int, int, int, int]]]:
    bins: list[list[tuple[int, int, int, int]]] = []
    items: list[tuple[int, int, int, int]] = []
    for i, n in enumerate(lengths):
        full, rest = divmod(n, cap)
        if n > cap:
            bins += [[(i, k + 1, k * cap, cap)] for k in range(full)]
            if rest:
                items.append((i, full + 1, full * cap, rest))
        else:
            items.append((i, 1, 0, n))
    items.sort(key=lambda x: (-x[3], x[0]))
    n_large = sum(1 for x in items if x[3] > cap * large)
    per = max(1, -(-n_large // groups))
    sizes = [items[a][3] for a in range(0, n_large, per)]
    left = [min(per, n_large - a) for a in range(0, n_large, per)]
    pool = [(x[3], -k) for k, x in reversed(list(enumerate(items[:n_large])))]
    gaps: list[tuple[int, int]] = []

    def open_bin(content: list) -> None:
        bins.append(content)
        free = cap - sum(x[3] for x in content)
        if free:
            insort(gaps, (free, len(bins) - 1))

    def take(most: int) -> tuple | None:
        """The longest document of the pool within ``most``."""
        at = bisect_left(pool, (most + 1, -n_large - 1)) - 1
        if at < 0:
            return None
        k = -pool.pop(at)[1]
        left[k // per] -= 1
        return items[k]

    def fill(config: list[int]) -> None:
        """One container: of each slot the longest document its rounded size allows, the last by what is really free."""
        content, free = [], cap
        for g in config[:-1]:
            if got := take(min(sizes[g], free)):
                content.append(got)
                free -= got[3]
        while got := take(free):
            content.append(got)
            free -= got[3]
        open_bin(content)

    for counts, used in configurations(sizes, left, cap) if optimised else ():
        config = [g for g in range(len(sizes)) for _ in range(counts[g])]
        for _ in range(int(used)):
            if not pool or any(left[g] < counts[g] for g in set(config)):
                break
            fill(config)
    while pool:  # what whole numbers of the programme leave over
        config = _fullest(sizes, left, cap)
        need = np.bincount(config, minlength=len(sizes))
        while pool and all(left[g] >= need[g] for g in set(config)):
            fill(config)
    for x in items[n_large:]:
        at = bisect_left(gaps, (x[3], -1))
        if at == len(gaps):
            open_bin([x])
            continue
        free, b = gaps.pop(at)
        bins[b].append(x)
        if free > x[3]:
            insort(gaps, (free - x[3], b))
    return bins


def fill_containers(sized: DataFrame, kinds: DataFrame, id_col: str = "doc_id", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Place of every document in each kind of container.

    ``sized`` has ``id_col`` and ``tokens``; ``kinds`` (container, capacity_tokens)
    is a short list. The number of shards follows the number of documents.
    """
    n = sized.count()
    shards = max(1, -(-n // shard_docs))
    id_type = sized.schema[id_col].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        container, cap, shard = key
        pdf = pdf.sort_values(["tokens", "doc_id"], kind="stable")
        ids = pdf["doc_id"].tolist()
        cols: list[list] = [[] for _ in range(7)]
        for b, content in enumerate(pack(pdf["tokens"].tolist(), int(cap))):
            total = sum(x[3] for x in content)
            for place, (i, piece, at, size) in enumerate(content, 1):
                for c, v in zip(cols, (ids[i], piece, at, size, f"{container}-{shard}-{b}", place, total)):
                    c.append(v)
        out = pd.DataFrame(dict(zip(["doc_id", "piece", "from_token", "tokens", "bin", "place", "bin_tokens"], cols)))
        out.insert(0, "container", container)
        out.insert(1, "capacity", int(cap))
        return out

    listed = short_list(kinds.where("capacity_tokens > 0").select("container", "capacity_tokens"), 1000, "container kinds")
    caps = F.array(*[F.struct(F.lit(r[0]).alias("container"), F.lit(int(r[1])).alias("capacity")) for r in listed])
    rows = sized.select(F.col(id_col).alias("doc_id"), F.col("tokens").cast("long"),
                        F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(shards)), F.lit(0)).cast("int").alias("shard"))
    every = rows.select("*", F.inline(caps)) if listed else rows.selectExpr("*", "'' AS container", "0 AS capacity").where("false")
    parts = max(8, min(3 * shards, 100_000))
    return every.repartition(parts, "container", "shard").groupBy("container", "capacity", "shard").applyInPandas(run, OUT.format(id_type))
