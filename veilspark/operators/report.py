"""Counts, summaries, review tables and corpus metrics over findings in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.spans import gathered, let
from veilspark.operators.resolve import lookup
from veilspark.operators.rewrite import check_mode

#: Findings of a document beyond which a review groups them by value, and from which it offers a search.
GROUPED_ABOVE, SEARCH_FROM = 30, 8


def label(entity: Column, count: Column) -> Column:
    one, many = ({e[0]: e[k] for e in fixed.ENTITIES} for k in (2, 3))
    return F.when(count == 1, lookup(one, entity, entity)).otherwise(lookup(many, entity, entity))


def category(entity: Column) -> Column:
    return lookup({e[0]: e[4] for e in fixed.ENTITIES}, entity, F.lit(fixed.OTHER_CATEGORY))


def checksum(entity: Column) -> Column:
    return entity.isin([e[0] for e in fixed.ENTITIES if e[6]])


def source_label(source: Column) -> Column:
    return lookup(fixed.SOURCE_LABELS, source, source)


def reliability(score: Column) -> Column:
    return F.when(score >= 0.9, "Alta").when(score >= 0.8, "Buona").otherwise("Da verificare")


def counts(long: DataFrame, *keys: str) -> DataFrame:
    return long.groupBy(*keys, "entity_type").agg(F.count("*").alias("n"))


def summary(found: Column) -> Column:
    """"2 email, 1 persona": by plural label; a fixed phrase for none."""
    types = F.transform(found, lambda f: f["entity_type"])

    def parts(ts: Column) -> Column:
        each = F.transform(F.array_distinct(ts), lambda t: let(F.size(F.filter(ts, lambda x: x == t)), lambda n: F.struct(label(t, F.lit(2)).alias("order"), F.concat_ws(" ", n.cast("string"), label(t, n)).alias("text"))))
        return F.array_join(F.transform(F.array_sort(each), lambda s: s["text"]), ", ")

    return F.when(F.size(found) > 0, let(types, parts)).otherwise(fixed.NOTHING_FOUND)


def report(detected: DataFrame, mode: str) -> DataFrame:
    """doc_id, total, summary, checklist of every document with ``findings``."""
    check_mode(mode)
    total = F.size("findings")
    item = F.when(total == 1, "dato riconosciuto").otherwise("dati riconosciuti")
    text = F.concat(F.lit(f"Modalità {fixed.MODE_LABELS[mode]}: "), total.cast("string"), F.lit(" "), item, F.lit(" ("), summary(F.col("findings")), F.lit(f"). {fixed.MODE_NOTES[mode]} {fixed.REVIEW_NOTE}"))
    checklist = F.array(F.lit(fixed.CHECKLIST_BY_MODE[mode]), F.when(total > 0, fixed.CHECKLIST_FOUND).otherwise(fixed.CHECKLIST_EMPTY), F.lit(fixed.REVIEW_NOTE))
    return detected.select("doc_id", F.lit(mode).alias("mode"), total.alias("total"), text.alias("summary"), checklist.alias("checklist"))


def by_category(long: DataFrame) -> DataFrame:
    """category, n; the row of all is named Tutti."""
    return long.withColumn("category", category(F.col("entity_type"))).rollup("category").agg(F.count("*").alias("n")).select(F.coalesce("category", F.lit("Tutti")).alias("category"), "n")


def grouped_review(reviewed: DataFrame) -> DataFrame:
    """Per type: occurrences, distinct values, excluded; most frequent first, then by plural label."""
    out = reviewed.groupBy("entity_type").agg(F.count("*").alias("occurrences"), F.count_distinct("value").alias("n_values"), F.count_if(~F.coalesce("included", F.lit(True))).alias("excluded"))
    return out.withColumn("label", label(F.col("entity_type"), F.lit(2))).orderBy(F.desc("occurrences"), "label")


def value_rows(reviewed: DataFrame) -> DataFrame:
    """Per (type, value): occurrences, best score, all or any included, its source or Multipli; most frequent first, then by value."""
    sources = F.collect_set("source")
    out = reviewed.groupBy("entity_type", "value").agg(
        F.count("*").alias("occurrences"), F.max("score").alias("score"), F.bool_and(F.coalesce("included", F.lit(True))).alias("all_included"), F.bool_or(F.coalesce("included", F.lit(True))).alias("any_included"),
        F.when(F.size(sources) == 1, sources[0]).otherwise("Multipli").alias("source"),
    )
    return out.withColumn("reliability", reliability(F.col("score"))).orderBy(F.desc("occurrences"), F.lower("value"))


def search(reviewed: DataFrame, category_name: str | None = None, part: str = "") -> DataFrame:
    """Rows of one category whose value holds ``part``, in any case, line ends read as spaces."""
    out = reviewed if category_name in (None, "Tutti") else reviewed.where(category(F.col("entity_type")) == category_name)
    return out.where(F.contains(F.lower(F.translate("value", "\n", " ")), F.lower(F.lit(part))))


def occurrences(text: Column, value: Column) -> Column:
    """array<struct<start, end>> of a value in any case, one after the other; closing punctuation stays outside."""
    quoted = F.concat(F.lit(r"(?iU)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    bare = F.length(F.rtrim(value, F.lit(".,;:")))

    def of_pieces(pieces: Column) -> Column:
        def step(a: Column, piece: Column) -> tuple[dict[str, Column], Column]:
            start = a["at"] + F.length(piece)
            return {"at": start + F.length(value)}, F.array(F.struct(start.alias("start"), (start + bare).alias("end")))

        return gathered(F.slice(pieces, 1, F.size(pieces) - 1), {"at": F.lit(0)}, "array<struct<start:int,end:int>>", step)["out"]

    return F.when(F.length(value) > 0, let(F.split(text, quoted, -1), of_pieces)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def expected_status(text: Column, found: Column, value: Column, entity: Column) -> Column:
    """not_extracted, leaked, detected or wrong_type_or_span over all occurrences in any case; closing punctuation may stay outside."""

    def of_spans(ss: Column) -> Column:
        inside = lambda s, f: (f["start"] <= s["start"]) & (s["end"] <= f["end"])
        covered = F.forall(ss, lambda s: F.exists(found, lambda f: inside(s, f)))
        typed = F.exists(ss, lambda s: F.exists(found, lambda f: inside(s, f) & (f["entity_type"] == entity)))
        return F.when(F.size(ss) == 0, "not_extracted").when(~covered, "leaked").when(typed, "detected").otherwise("wrong_type_or_span")

    return let(occurrences(text, value), of_spans)


def remain_status(text: Column, anonymized: Column, value: Column) -> Column:
    """Of a value that has to stay, in any case: not_extracted, preserved or false_positive."""
    held = lambda t: F.size(occurrences(t, value)) > 0
    return F.when(~held(text), "not_extracted").when(held(anonymized), "preserved").otherwise("false_positive")


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def corpus_metrics(statuses: DataFrame) -> DataFrame:
    """One row from (status): totals, removal and preservation in per cent."""
    n = lambda s: F.count_if(F.col("status") == s)
    totals = statuses.agg(*(n(s).alias(s) for s in ("detected", "wrong_type_or_span", "leaked", "not_extracted", "preserved", "false_positive")))
    removed = F.col("detected") + F.col("wrong_type_or_span")
    return totals.withColumn("removal", rate(removed, removed + F.col("leaked"))).withColumn("preservation", rate(F.col("preserved"), F.col("preserved") + F.col("false_positive")))


def model_benchmark(found: DataFrame, required: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Per profile: required (type, value) pairs that were found, all required ones, forbidden ones that were found."""
    hit = found.select("profile", "entity_type", "value").distinct()
    ok = required.join(hit.withColumn("hit", F.lit(1)), ["profile", "entity_type", "value"], "left").groupBy("profile").agg(F.count("hit").alias("hits"), F.count("*").alias("required"))
    bad = forbidden.join(hit, ["profile", "entity_type", "value"], "left_semi").groupBy("profile").agg(F.count("*").alias("forbidden_hits"))
    return ok.join(bad, "profile", "left").fillna(0, ["forbidden_hits"])


def fingerprints(detected: DataFrame) -> DataFrame:
    """doc_id, text_sha256, selection_sha256: of the text, and of type, start, end, source and choice of the findings as JSON.

    The choice is that of ``included`` (an array beside ``findings``), where there is such a column; what it does not reach is included.
    """
    chosen = (lambda i: F.coalesce(F.get("included", i), F.lit(True))) if "included" in detected.columns else (lambda i: F.lit(True))
    rows = F.to_json(F.transform("findings", lambda f, i: F.struct(f["entity_type"].alias("type"), f["start"].alias("start"), f["end"].alias("end"), f["source"].alias("source"), chosen(i).alias("included"))))
    return detected.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.sha2(rows.cast("binary"), 256).alias("selection_sha256"))


def provenance(detected: DataFrame, mode: str, output_format: str, revision: int = 1, used_ocr: bool = False) -> DataFrame:
    """Where an output comes from: doc_id, revision, mode, both fingerprints, findings in all, included and excluded, format, and whether a restore map belongs to it."""
    total = F.size("findings")
    left_out = F.size(F.filter("included", lambda x: ~x)) if "included" in detected.columns else F.lit(0)
    sums = detected.select("doc_id", total.alias("total_findings"), F.greatest(total - left_out, F.lit(0)).alias("included_findings"), left_out.alias("excluded_findings"))
    fixed_parts = {"revision": revision, "mode": check_mode(mode), "output_format": output_format, "used_ocr": used_ocr, "map_required": mode == "reversible", "kind": "anonymized"}
    return sums.join(fingerprints(detected), "doc_id").withColumns({k: F.lit(v) for k, v in fixed_parts.items()})


def serialized(long: DataFrame) -> DataFrame:
    """Findings in long form as a display takes them: labels beside codes, score to four digits, the value as preview."""
    return long.select(
        "doc_id", "entity_type", label(F.col("entity_type"), F.lit(1)).alias("label"), "start", "end", F.round("score", 4).alias("score"), "source", source_label(F.col("source")).alias("source_label"),
        F.col("value").alias("preview"),
    )


def review_form(reviewed: DataFrame, grouped_above: int = GROUPED_ABOVE, search_from: int = SEARCH_FROM) -> DataFrame:
    """doc_id, n, grouped, searchable: whether a document's findings are shown by value, and with a search field."""
    return reviewed.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", "n", (F.col("n") > grouped_above).alias("grouped"), (F.col("n") >= search_from).alias("searchable"))
