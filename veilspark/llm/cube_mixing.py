"""Operator 6: mixing sources to target weights by balanced sampling (cube method).

Targets: the sources, in code point order with null last, weigh ``WEIGHTS`` in turn and share the words of
the corpus; no target exceeds ``MOST`` times its source, the excess goes to the others by weight. The ratio of
target and size is split into whole repeats of every document and a fractional inclusion probability.

The fractions are rounded by the cube method, balanced on documents and on words of each source. Flight: three
documents at a time, probabilities move along the null space of the constraints (1, size) until one is 0 or 1,
which then leaves; both totals stay exact. A source is split by a hash of each row (doc_id and size; also its place in the order of doc_id and text, where
ids repeat or are null) into blocks of about ``BLOCK``
documents, so a source with a third of all rows is many tasks; a block leaves at most two documents
undecided, which meet again in blocks of the next level, until a source has one block. Landing: its last two
documents take the rounding with the smallest error in words, and one exchange within the last block takes up most
of what is left of it. So a source misses its target by a few words, and by less than one document at worst.

Levels are written to the shared folder; random moves come from a hash of the block, so reruns agree.

Defined cases: null text has size 0; size 0 documents are sampled but add nothing; empty table gives an empty result; a
corpus without words has targets 0; repeated doc_ids are separate rows; null source is a source of its own, null doc_id a row.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.util import WORD, materialize, numbered

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 2000
EPS = 1e-9
#: Sources whose sizes the driver shares out; more are refused.
MOST_SOURCES = 200_000


def targets(sizes: np.ndarray, weights: np.ndarray, most: int = MOST) -> np.ndarray:
    """Share the total by weight; who is above ``most`` times its size stops there, the rest is shared anew."""
    sizes, weights = sizes.astype(float), weights.astype(float)
    cap, total = sizes * most, sizes.sum()
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        left = total - out[~open_].sum()
        share = left * weights / weights[open_].sum()
        over = open_ & (share > cap)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap[over]
        open_ &= ~over
    return out


def flight(sizes: list[float], pi: list[float], rng: random.Random) -> list[float]:
    """Move probabilities, keeping their sum and that of size * probability, until at most two are fractional."""
    p = list(pi)
    active: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            active.append(k)
        else:
            p[k] = float(round(p[k]))
        while len(active) == 3 or (len(active) == 2 and sizes[active[0]] == sizes[active[1]]):
            if len(active) == 2:
                u = (1.0, -1.0)
            else:
                a, b, c = (sizes[i] for i in active)
                u = (c - b, a - c, b - a)  # null space of the rows (1, 1, 1) and (a, b, c)
                if u == (0, 0, 0):
                    u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if x)
            move = up if rng.random() * (up + down) < down else -down
            for i, x in zip(active, u):
                p[i] += move * x
                if p[i] < EPS:
                    p[i] = 0.0
                elif p[i] > 1 - EPS:
                    p[i] = 1.0
            active = [i for i in active if 0 < p[i] < 1]
    return p


def landing(sizes: list[float], p: list[float]) -> list[float]:
    """Round the last fractional ones to the least error in words, then in documents."""
    rest = [i for i, x in enumerate(p) if 0 < x < 1]
    want, docs = sum(sizes[i] * p[i] for i in rest), sum(p[i] for i in rest)

    def error(mask: int) -> tuple[float, float]:
        on = [i for j, i in enumerate(rest) if mask >> j & 1]
        return abs(sum(sizes[i] for i in on) - want), abs(len(on) - docs)

    best = min(range(1 << len(rest)), key=error) if rest else 0
    out = list(p)
    for j, i in enumerate(rest):
        out[i] = float(best >> j & 1)
    return out


def swap(sizes: list[float], pi: list[float], p: list[float]) -> list[float]:
    """Exchange one taken and one left-out document of the block if that brings the words nearer to their expectation."""
    s, loose, on = np.array(sizes), np.array([EPS < x < 1 - EPS for x in pi], bool), np.array(p) == 1
    excess = float(s @ np.array(p) - s @ np.array(pi))
    inside, outside = np.flatnonzero(loose & on), np.flatnonzero(loose & ~on)
    if not len(inside) or not len(outside):
        return p
    outside = outside[np.argsort(s[outside], kind="stable")]
    want = s[inside] - excess
    at = np.searchsorted(s[outside], want)
    tries = [(abs(s[j] - w), i, j) for i, w, k in zip(inside, want, at) for j in outside[max(0, k - 1) : k + 1]]
    error, i, j = min(tries)
    out = list(p)
    if error < abs(excess):
        out[i], out[j] = 0.0, 1.0
    return out


def _round_block(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "rank", "doc_id", "p"], ascending=[False, True, True, True], kind="stable", na_position="last")
        first = pdf.iloc[0]
        rng = random.Random(f"{first['source_rank']}:{first['block']}:{first['level']}")
        sizes = pdf["size"].astype(float).tolist()
        pi = pdf["p"].tolist()
        p = flight(sizes, pi, rng)
        pdf["p"] = swap(sizes, pi, landing(sizes, p)) if last else p
        return pdf

    return run


def with_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source_rank, size, source_size, source_docs, target of every row; the text goes no further."""
    spark = docs.sparkSession
    rows, key = numbered(docs.select("doc_id", "source", "text"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = materialize(rows.select("doc_id", "source", size, F.col(key).alias("row")), "sizes")
    sized = sized.withColumn("rank", F.xxhash64("doc_id", "size")) if key == "doc_id" else _places(sized).withColumn("rank", F.xxhash64("doc_id", "size", "row"))
    # one row per source, not per document
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix over a coarser column")
    rows = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode()))
    share = targets(np.array([r.source_size for r in rows]), np.array([weights[i % len(weights)] for i in range(len(rows))]), most) if rows else []
    stats = spark.createDataFrame([(r.source, i, r.source_size, r.source_docs, float(t)) for i, (r, t) in enumerate(zip(rows, share))], "s string, source_rank int, source_size long, source_docs long, target double")
    return sized.join(stats, sized.source.eqNullSafe(stats.s), "left").select("doc_id", "source", "source_rank", "size", "rank", "source_size", "source_docs", "target")


def _places(sized: DataFrame) -> DataFrame:
    """``row`` of a sorted numbering as the place in the sort: wherever partitions were cut, a rerun gives equal rows equal places."""
    part = F.shiftright("row", 33)
    counts = sized.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each partition of the sort
    earlier = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    placed = sized.withColumn("part", part).join(F.broadcast(earlier), "part")
    return placed.withColumn("row", F.col("row") - F.shiftleft("part", 33) + F.col("earlier")).drop("part", "earlier")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    rows = with_targets(docs, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + EPS).cast("int")).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumns({"level": F.lit(0), "left": F.col("source_docs")})
    done = None
    while True:
        blocks = F.ceil(F.col("left") / block)
        level = rows.withColumn("block", F.pmod(F.xxhash64("rank", "level"), blocks).cast("long")).withColumn("final", blocks <= 1)
        parts = []
        for last in (False, True):
            chosen = level.where(F.col("final") == last)
            parts.append(chosen.groupBy("source_rank", "block").applyInPandas(_round_block(last), chosen.schema))
        rounded = materialize(parts[0].unionByName(parts[1]), "mix")
        settled = rounded.where((F.col("p") == 0) | (F.col("p") == 1))
        done = settled if done is None else done.unionByName(settled)
        rows = rounded.where((F.col("p") > 0) & (F.col("p") < 1)).drop("block", "final")
        if rows.isEmpty():
            break
        # a block leaves two documents at most
        rows = rows.withColumns({"left": F.greatest(F.lit(1), 2 * F.ceil(F.col("left") / block)).cast("long"), "level": F.col("level") + 1})
    copies = F.col("whole") + F.col("p").cast("int")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op6(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
