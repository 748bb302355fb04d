"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of documents; the last one adds to them how much the mix takes of a row. Columns besides those of documents are
handed on as they are, whatever their names: they pass under names of the pipeline's own.

Defined cases, the same for every stage: an empty table gives an empty result; rows, not ids, are judged, so rows with equal or null doc_ids
stay or go by themselves; a text is judged whole, however long. What happens to rows without text, to repeated rows and to ties is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import cube_mixing, decontamination, jaccard_join, language_id, line_templates
from veilspark.llm.util import discard, fresh, materialize, numbered, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that are not of documents under names that no operator makes, and what gives them their own names back."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    inner = [c if c in COLUMNS else f"carried_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*(F.col(q).alias(n) for q, n in zip(quoted, inner))), [F.col(n).alias(c) for n, c in zip(inner, docs.columns)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough (operator 8).

    Texts that are null or have no letter go; repeated rows fare alike; a tie between languages is a low score and goes.
    """
    rows, own = sheltered(docs)
    return language_id.identify(rows, language_id.fit(rows)).where(~F.col("rejected")).select(*own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines (operator 5); a document of which nothing is left goes.

    Texts that are null or blank from the start stay as they are. Of repeated rows the first in the order of doc_id and text keeps a recurring line.
    """
    rows, own = sheltered(docs)
    cleaned = line_templates.drop_lines(rows)
    left = cleaned.where((F.col("n_dropped") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones (operator 7): the smallest doc_id, null last; among equal ids the first text.

    Texts that are null or blank are like nothing and stay; of repeated rows one stays.
    """
    rows, own = sheltered(docs)
    return jaccard_join.keep_one(rows).select(*own)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 3). Texts that are null or blank hold none; repeated rows fare alike."""
    rows, own = sheltered(docs)
    return decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark")).select(*own)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes (operator 6), with ``copies``, how often, and size, source_size, target and taken as words.

    Null text has size 0, adds nothing and is drawn like any other row; null source is a source; repeated rows are drawn one by one. A column of the
    input that has one of the five names keeps it, and the mix's gets an underscore in front.
    """
    rows, own = sheltered(docs)
    rows, key = numbered(rows)
    mixed = cube_mixing.mix(rows.select(F.col(key).alias("doc_id"), "source", "text")).where(F.col("copies") > 0)
    made = {c: fresh(docs, c) for c in ("size", "source_size", "target", "copies", "taken")}
    drawn = mixed.select(F.col("doc_id").alias("mix_row"), *(F.col(c).alias(f"mix_{c}") for c in made))
    return rows.join(drawn, F.col(key) == F.col("mix_row")).select(*own, *(F.col(f"mix_{c}").alias(n) for c, n in made.items()))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

#: A trained language model decides in the first stage, and the last one draws at random.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
