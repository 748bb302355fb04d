"""Operator 13: how five filters interact, in every order.

A document fails some of five conditions; which ones is a mask of five bits, by native expressions and one grouping of the texts (for the smallest doc_id with
the same text). Counts by part and mask, at most 32 cells for each part, hold all there is to know: what a filter keeps and removes at any place of any order
follows from the cells alone, so the 120 orders cost nothing in data.

Rows travel as (part, doc_id, mask, SHA-256 of the text). Texts that repeat get their smallest doc_id by a join in which texts of more than a thousandth of
all rows are broadcast (:func:`veilspark.llm.util.with_groups`).

Defined cases: null text counts as empty; an empty text fails only condition A, and E if a smaller doc_id has an empty text too. A null doc_id is neither
smaller nor larger than another and has no label; rows with one doc_id are not copies of each other. Several labels of a doc_id count as their maximum; null
labels as 0. A null source is the part with the empty name, together with an empty source. Further columns do not matter. No documents, no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.util import materialize, with_groups

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_SPACES = r"[\x20\x09-\x0D]+"
_MARKS = "[#$%&*|]"


def bit(filters: str) -> int:
    return sum(1 << FILTERS.index(f) for f in filters)


def _flag(filter_: str, failed: Column) -> Column:
    return F.when(failed, bit(filter_)).otherwise(0)


def text_mask(text: Column) -> Column:
    """Bits of the conditions that a text fails by itself: A to D."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n = F.size(words)
    return (
        _flag("A", n < 50)
        + _flag("B", 100 * F.size(F.array_distinct(words)) < 65 * n)
        + _flag("C", 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"))
        + _flag("D", text.rlike(_MARKS))
    )


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").alias("id"), text_mask(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("hash"))
    rows = materialize(rows, "masks")
    repeated = materialize(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).where("size > 1"), "repeated")
    seen = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    out = with_groups(rows, repeated, ["hash"], rows.count(), "left").select("part", "id", (F.col("own") + _flag("E", seen)).alias("mask"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("good or toxic")
    # rows without an id would all meet in one task
    labelled = out.where("id is not null").join(marks, "id", "left").select("part", "mask", "good", "toxic")
    nobody = F.lit(False)
    return labelled.unionByName(out.where("id is null").select("part", "mask", nobody.alias("good"), nobody.alias("toxic")))


def histogram(rows: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: at most 32 rows for each part."""
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))


def audit(cells: DataFrame) -> DataFrame:
    """What each filter does at each place of each order, from the cells of each part.

    A document that fails k filters is removed by each of them in 120 / k orders; that gives ``shapley`` without a sum over orders.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))
    steps = parts.select("part", "cells", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    here, before = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    steps = steps.select("*", F.lit(1).alias("one"), F.instr(F.lit(FILTERS), here).alias("at"), sum(_flag(f, before.contains(f)) for f in FILTERS).alias("earlier"))
    steps = steps.select("*", F.expr("shiftleft(one, at - 1)").alias("bit"))

    def total(test, of=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda a, c: a + of(c))

    def fails(c: Column) -> Column:
        return c["mask"].bitwiseAND(F.col("bit")) != 0

    def passed(c: Column) -> Column:
        return c["mask"].bitwiseAND(F.col("earlier")) == 0

    removed = lambda c: fails(c) & passed(c)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c) & passed(c)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: fails(c) & ~passed(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(removed, lambda c: c["n_good"]).alias("good_lost"),
        total(removed, lambda c: c["n_toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (F.lit(len(ORDERS)) / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step."""
    return audit(histogram(masked(docs, labels)))


ORACLE_SQL = r"""WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
  100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS mask FROM f),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
orders AS (SELECT p.v || q.v || r.v || s.v || u.v AS o FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.v, q.v, r.v, s.v, u.v])) = 5),
steps AS (SELECT o, k, substr(o, k, 1) AS here, substr(o, 1, k - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
hits AS (SELECT part, o, k, here, n, g, x, mask, contains(mask, here) AS fails, len(mask) > 0 AND earlier <> '' AND regexp_matches(mask, '[' || CASE WHEN earlier = '' THEN '_' ELSE earlier END || ']') AS gone FROM cells, steps),
sums AS (SELECT part, o AS filter_order, k AS step, here, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
  sum(n) FILTER (mask = here) AS unique_fails, sum(g) FILTER (fails AND NOT gone) AS good_lost, sum(x) FILTER (fails AND NOT gone) AS toxic_lost FROM hits GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, here) AS BIGINT) AS shapley FROM sums"""
