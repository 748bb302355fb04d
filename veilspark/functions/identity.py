"""What tells rows apart, and joins in which null equals null.

doc_ids may be null or repeat, so they do not name a row. :func:`with_row_key` gives each row a key made of its id and text, the same wherever and however
often it is computed; rows that agree in both share it, and whatever is derived from them is equal too, so that does no harm. The key is hashed with a salt
that each call draws anew: a key alone does not confirm a guessed text.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_KEY = "row_key"


def key_of(*parts: Column) -> Column:
    """A hash of the parts; null differs from every value."""
    salt = os.urandom(16).hex()
    marked = lambda p: F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-"))
    return F.sha2(F.concat(F.lit(salt), *(marked(p.cast("string")) for p in parts)), 256)


def with_row_key(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with ``row_key``, unless it has one already."""
    return docs if ROW_KEY in docs.columns else docs.withColumn(ROW_KEY, key_of(*(F.col(c) for c in columns)))


def identity_columns(*frames: DataFrame) -> list[str]:
    """By what rows of the frames meet: their row keys if all have them, else their ids."""
    return [ROW_KEY] if all(ROW_KEY in f.columns for f in frames) else ["doc_id"]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which null equals null; ``keys`` come from ``left``, the other columns of ``right`` have names that ``left`` lacks."""
    own = {k: f"_vs_key_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(own)
    condition = None
    for k, r in own.items():
        same = left[k].eqNullSafe(renamed[r])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*own.values())


def others(docs: DataFrame, *made: str) -> list[Column]:
    """The columns of ``docs``, whatever their names, but those that a result makes itself."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in made]
