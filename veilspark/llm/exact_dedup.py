"""Operator 12: exact duplicates by progressive refinement.

Texts are equal when they are identical without white space (space, tab, LF, VT, FF, CR). Rows are refined in three steps, each only over what the one before
left in a group of two or more:

1. the length of the normalised text;
2. a hash of its first ``HEAD`` code points;
3. SHA-256 of all of it.

The first scan of the texts writes a narrow table of lengths and hashes of heads, on which the first two steps work. The third reads the texts again. Where
the surviving groups are few enough to be broadcast (``MOST_GROUPS``, counted first), it hashes the rows of those groups only; beyond that it hashes each row
where it is read and joins by row, since moving texts to where their group is would cost more than hashing them.

No group is gathered anywhere: sizes and the row that stays are aggregates with partial sums, and rows get them back by a join in which groups of more than a
thousandth of all rows are broadcast (:func:`veilspark.llm.util.with_groups`).

Defined cases: null text counts as empty, and all texts without a visible character are equal. Of equal texts, the row with the most code points in the
original text stays, then the one with the smallest doc_id, null last; of rows that agree in both, any one, but exactly one. Rows are told apart by doc_id, or
by a number of their own where ids repeat or are null. An empty table gives an empty result. Further columns, whatever their names, are handed on by
:func:`drop_copies` and do not matter to :func:`op12`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.util import discard, fresh, materialize, numbered, with_groups

SPACE = r"[\x20\x09-\x0D]+"
#: Code points of the normalised text that the second step hashes.
HEAD = 256
#: Groups that the third step may broadcast: 16 bytes each.
MOST_GROUPS = 500_000


def original(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def normalised(text: Column) -> Column:
    return F.regexp_replace(original(text), SPACE, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _shared(rows: DataFrame, keys: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """The rows that share ``keys`` with another one, and the groups: keys and size."""
    groups = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"same-{keys[-1]}")
    return with_groups(rows, groups, keys, total).drop("size"), groups


def copies(rows: DataFrame, key: str, most_groups: int = MOST_GROUPS) -> DataFrame:
    """key, keep_key, keep_id, group_size of every row of ``rows`` (key, doc_id, text) that has a copy. ``key`` tells rows apart and may be doc_id itself."""
    text = F.col("text")
    length, head = F.length(normalised(text)).alias("length"), F.xxhash64(F.substring(normalised(text), 1, HEAD)).alias("head")
    signs = materialize(rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), F.length(original(text)).alias("n"), length, head), "signs")
    total = signs.count()
    same_length, lengths = _shared(signs, ["length"], total)
    same_head, heads = _shared(same_length, ["length", "head"], total)
    alive = materialize(same_head, "alive")
    if heads.count() <= most_groups:
        again = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), F.length(original(text)).alias("n"), length, head, "text")
        hashed = again.join(F.broadcast(heads), ["length", "head"], "left_semi").select("key", "id", "n", digest(text).alias("hash"))
    else:
        hashed = rows.select(F.col(key).alias("key"), digest(text).alias("hash")).join(alive.select("key", "id", "n"), "key")
    hashed = materialize(hashed, "hashed")
    best = F.min(F.struct((-F.col("n")).alias("shorter"), F.col("id").isNull().alias("without"), "id", "key")).alias("best")
    groups = materialize(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), best).where("size > 1"), "same-text")
    out = with_groups(hashed.select("key", "hash"), groups, ["hash"], total)
    out = materialize(out.select("key", F.col("best.key").alias("keep_key"), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size")), "copies")
    discard(signs, lengths, heads, alive, hashed, groups)
    return out


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, key = numbered(docs)
    mark = fresh(rows, "copy_of_another")
    gone = copies(rows, key).where("key != keep_key").select(F.col("key").alias(mark))
    return rows.join(gone, F.col(key) == F.col(mark), "left_anti").select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def op12(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, key = numbered(docs.select("doc_id", "text"))
    found = copies(rows, key)
    every = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("hash"))
    out = every.join(found, "key", "left")
    alone = F.col("keep_key").isNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("key") == F.col("keep_key"))).alias("kept"),
        F.lower(F.hex("hash")).alias("text_sha256"),
    )


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, len(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, row_number() OVER w = 1 AS kept, sha256(s) AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST)"""
