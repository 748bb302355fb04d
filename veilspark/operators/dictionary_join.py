"""Places of a dictionary of any size, by an n-gram join.

:func:`veilspark.operators.recognizers.dictionary_places` looks words up in a table that stands in the plan, which suits national gazetteers. A table that is
larger than that is a DataFrame, and the look-up an equi-join: runs of words of a text, as long as the longest place has words, meet the places; of those that
begin at a word the longest counts, and from left to right words are used up. Spark broadcasts the places if they are small by its own threshold and shuffles
both sides otherwise. What travels are words, not texts. Texts meet their places again by row key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import checks, fixed
from veilspark.functions.identity import ROW_KEY, with_row_key
from veilspark.functions.spans import FINDINGS, apart, clean, finding, let, spans
from veilspark.operators.recognizers import place_context, place_shape, standalone_field


def phrases(docs: DataFrame, longest: int) -> DataFrame:
    """row_key, at, words, start, end, phrase: every run of 1 to ``longest`` words with nothing but blanks between them, normalised; ``at`` is its first word's place.

    ``docs``: row_key, text. Rows with one key are one.
    """
    texts = docs.select(ROW_KEY, clean(F.col("text")).alias("_vs_text"))

    def of_tokens(tokens):
        def gap(i):
            between = F.substring("_vs_text", F.get(tokens, i - 1)["end"] + 1, F.get(tokens, i)["start"] - F.get(tokens, i - 1)["end"])
            return F.when(i == 0, True).otherwise(F.regexp_replace(between, r"(?U)\s+", "") != "")

        return F.transform(tokens, lambda s, i: F.struct(i.alias("at"), s["start"].alias("start"), s["end"].alias("end"), checks.normal_token(s["value"]).alias("word"), F.coalesce(gap(i), F.lit(True)).alias("breaks")))

    words = texts.select(ROW_KEY, let(spans("_vs_text", fixed.PLACE_TOKEN), of_tokens).alias("w"))
    width = F.sequence(F.lit(1), F.lit(longest))

    def runs(w, i):
        run = lambda n: F.slice(w, i + 1, n)
        whole = lambda n: (i + n <= F.size(w)) & ~F.exists(F.slice(w, i + 2, n - 1), lambda x: x["breaks"])
        made = lambda n: F.struct(i.alias("at"), n.alias("words"), w[i]["start"].alias("start"), F.get(w, i + n - 1)["end"].alias("end"), F.array_join(F.transform(run(n), lambda x: x["word"]), " ").alias("phrase"))
        return F.transform(F.filter(width, whole), made)

    every = words.select(ROW_KEY, F.explode(F.flatten(F.transform("w", lambda x, i: runs(F.col("w"), i)))).alias("p"))
    return every.select(ROW_KEY, "p.*").distinct()


def place_spans(docs: DataFrame, places: DataFrame) -> DataFrame:
    """row_key, spans (start, end, by start) of the texts that hold a place. ``places``: name, normalised."""
    names = places.select(F.col("name").alias("phrase")).where("phrase <> ''").distinct()
    longest = names.agg(F.max(F.size(F.split("phrase", " ")))).first()[0]
    if longest is None:
        return docs.sparkSession.createDataFrame([], f"{ROW_KEY} string, spans array<struct<start:int,end:int>>")
    hits = phrases(docs, longest).join(names, "phrase")
    # the longest at each word
    best = hits.groupBy(ROW_KEY, "at").agg(F.max(F.struct("words", "start", "end")).alias("b"))
    listed = best.groupBy(ROW_KEY).agg(F.array_sort(F.collect_list(F.struct("b.start", "b.end"))).alias("spans"))
    return listed.select(ROW_KEY, apart(F.col("spans"), "array<struct<start:int,end:int>>").alias("spans"))


def place_findings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``docs`` with ``row_key`` and ``places_found``, findings for ``extra`` of :func:`veilspark.operators.engine.detect`.

    ``docs``: doc_id, text and others; ``places``: name, normalised, and region (boolean). A place counts if it is a region, stands in a context of places or
    alone in its field, as with the dictionary in the plan.
    """
    keyed = with_row_key(docs, "doc_id", "text")
    found = place_spans(keyed, places)
    regions = places.where("region").select("name").distinct()
    text = F.col("_vs_text")
    valued = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    good = F.filter("spans", lambda s: place_shape(valued(s)))
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), checks.normal_place(valued(s)).alias("name"), (place_context(text, s["start"]) | standalone_field(text, s["start"], s["end"])).alias("placed"))
    here = keyed.withColumn("_vs_text", clean(F.col("text"))).join(found, ROW_KEY, "left").withColumn("_vs_good", F.transform(good, one)).drop("spans")
    # which names of a text are regions, by another small join
    named = here.where(F.size("_vs_good") > 0).select(ROW_KEY, F.explode(F.array_distinct(F.transform("_vs_good", lambda s: s["name"]))).alias("name")).distinct()
    known = named.join(regions, "name").groupBy(ROW_KEY).agg(F.collect_set("name").alias("_vs_regions"))
    region = lambda s: F.coalesce(F.array_contains("_vs_regions", s["name"]), F.lit(False))
    kept = F.filter("_vs_good", lambda s: s["placed"] | region(s))
    made = F.transform(kept, lambda s: finding("LOCATION", s["start"], s["end"], F.when(region(s), 0.9).otherwise(0.82), "location_dictionary"))
    out = here.join(known, ROW_KEY, "left").withColumn("places_found", F.coalesce(made, F.array().cast(FINDINGS)))
    return out.drop("_vs_text", "_vs_good", "_vs_regions")
