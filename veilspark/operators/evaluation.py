"""What an evaluation corpus says of the engine: expected values and values that have to stay, held against what was found.

Cases and documents meet by file, null-safely; occurrences and findings meet in an equi-join on the row and on a bucket of their place, with containment as
condition, so a document with many of both is no product of the two. Results are one row for each value of a case, and totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.identity import ROW_KEY, key_of, null_safe
from veilspark.functions.written import written
from veilspark.operators import engine, report
from veilspark.operators.recognizers import Dictionaries

#: Characters of a bucket.
BUCKET = 256


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Pairs of spans (start, end) of ``inner`` and of ``outer`` that hold them: the columns of ``inner``, and those of ``outer`` but keys, start and end.

    An outer span stands in every bucket that it touches, an inner one in that of its start. Keys are not null.
    """
    at = lambda c: F.floor(c / bucket)
    wide = outer.select(*keys, F.col("start").alias("_vs_from"), F.col("end").alias("_vs_to"), *[c for c in outer.columns if c not in (*keys, "start", "end")], F.explode(F.sequence(at(F.col("start")), at(F.greatest(F.col("end") - 1, F.col("start"))))).alias("_vs_bucket"))
    narrow = inner.withColumn("_vs_bucket", at(F.col("start")))
    met = narrow.join(wide, [*keys, "_vs_bucket"]).where((F.col("_vs_from") <= F.col("start")) & (F.col("end") <= F.col("_vs_to")))
    return met.drop("_vs_bucket", "_vs_from", "_vs_to")


def evaluate(docs: DataFrame, cases: DataFrame, words: Dictionaries | None = None, **options) -> DataFrame:
    """id, file, kind (expected_remove or must_remain), entity_type, value, status.

    ``docs``: file, text; ``cases``: id, file, expected_remove (entity_type, value), must_remain, as :func:`veilspark.sources.documents.read_manifest` gives
    them. An expected value is ``detected`` if findings cover all its occurrences, in any case, and one of them has its type; ``wrong_type_or_span`` if none has;
    ``leaked`` if an occurrence is not covered; ``not_extracted`` if the text does not hold it. A value that has to stay is ``preserved``, ``false_positive`` or
    ``not_extracted``. A case without a document has no text, so nothing of it is extracted. Several documents of one file are judged together: the worst counts.
    """
    keyed = docs.select("file", "text", key_of(F.col("file"), F.col("text")).alias(ROW_KEY))
    masked = engine.anonymize(keyed, "maximum", words, **options)
    own = cases.select("id", F.col("file").alias("case_file"), "expected_remove", "must_remain").withColumn("file", F.col("case_file"))
    met = null_safe(own, masked.withColumn("here", F.lit(True)), ["file"], "left")
    text = F.coalesce("text", F.lit(""))
    expected = F.transform("expected_remove", lambda e: F.struct(e["entity_type"].alias("entity_type"), e["value"].alias("value"), report.occurrences(text, e["value"]).alias("places")))
    remaining = F.transform("must_remain", lambda v: F.struct(v.alias("value"), report.remain_status(text, F.coalesce("anonymized", F.lit("")), v).alias("status")))
    plain = F.transform("findings", lambda f: F.struct(f["entity_type"].alias("found_type"), f["start"].alias("start"), f["end"].alias("end")))
    # the text is not needed any more
    work = written(met.select("id", F.col("case_file").alias("file"), F.coalesce(ROW_KEY, F.lit("")).alias(ROW_KEY), expected.alias("expected"), remaining.alias("remaining"), plain.alias("found")), "evaluation")
    of = ["id", "file", ROW_KEY]
    value = ["entity_type", "value"]
    wanted = work.select(*of, F.explode("expected").alias("e")).select(*of, "e.*")
    places = wanted.select(*of, *value, F.explode("places").alias("p")).select(*of, *value, "p.*")
    found = work.select(ROW_KEY, F.explode("found").alias("f")).select(ROW_KEY, "f.*").distinct()
    held = contained(places.select(ROW_KEY, "start", "end").distinct(), found, [ROW_KEY]).groupBy(ROW_KEY, "start", "end").agg(F.collect_set("found_type").alias("types"))
    judged = places.join(held, [ROW_KEY, "start", "end"], "left").groupBy(*of, *value).agg(F.bool_and(F.col("types").isNotNull()).alias("covered"), F.bool_or(F.coalesce(F.array_contains("types", F.col("entity_type")), F.lit(False))).alias("typed"))
    status = F.when(F.col("covered").isNull(), "not_extracted").when(~F.col("covered"), "leaked").when(F.col("typed"), "detected").otherwise("wrong_type_or_span")
    removed = null_safe(wanted.select(*of, *value).distinct(), judged, [*of, *value], "left").select("id", "file", F.lit("expected_remove").alias("kind"), *value, status.alias("status"))
    kept = work.select("id", "file", F.explode("remaining").alias("r")).select("id", "file", F.lit("must_remain").alias("kind"), F.lit(None).cast("string").alias("entity_type"), "r.value", "r.status")
    return removed.unionByName(kept).groupBy("id", "file", "kind", *value).agg(_worst(F.col("status")).alias("status"))


def _worst(status: Column) -> Column:
    order = F.array(*(F.lit(s) for s in ("leaked", "false_positive", "wrong_type_or_span", "detected", "preserved", "not_extracted")))
    return F.min(F.struct(F.array_position(order, status), status.alias("status")))["status"]


def metrics(results: DataFrame) -> DataFrame:
    """Totals of :func:`evaluate`, with removal and preservation in per cent."""
    return report.corpus_metrics(results)


def by_sector(results: DataFrame, cases: DataFrame) -> DataFrame:
    """sector, status, n."""
    return null_safe(results, cases.select("id", "sector").distinct(), ["id"], "left").groupBy("sector", "status").agg(F.count("*").alias("n"))
