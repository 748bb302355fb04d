"""The detection and rewriting API over DataFrames of documents."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.clues import Clues, has_digit, stems_of, words_of
from veilspark.functions.identity import ROW_KEY, identity_columns, key_of, null_safe, others, with_row_key
from veilspark.functions.spans import FINDINGS, clean, cut, let, wide
from veilspark.operators import resolve, rewrite
from veilspark.operators.recognizers import RULES, WITH_WORDS, Dictionaries
from veilspark.operators.rewrite import check_mode

#: Longest text of one interactive request.
MOST_CHARACTERS = 100_000


_built: dict[tuple, Column] = {}


def built(key: tuple, make: Callable[[], Column]) -> Column:
    """A column expression made once for each JVM: it names its inputs, so it serves any frame that has them.

    Putting the large expressions together call by call costs more than planning them.
    """
    key = (id(SparkContext._gateway), *key)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def _key(words: Dictionaries) -> tuple:
    return tuple(words.first_names), tuple(words.regions), tuple(words.places)


def rule_column(name: str, rule: Callable, words: Dictionaries) -> Column:
    seen = Clues("_vs_clean", F.col("_vs_digit"), F.col("_vs_words"), F.col("_vs_stems"))
    if name not in WITH_WORDS:
        return built((name,), lambda: rule(F.col("_vs_clean"), seen).alias(f"_vs_rule_{name}"))
    return built((name, *_key(words)), lambda: rule(F.col("_vs_clean"), seen, words).alias(f"_vs_rule_{name}"))


def candidates(docs: DataFrame, mode: str = "standard", words: Dictionaries | None = None, only: set[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` and one array column ``_vs_rule_<rule>`` per recognizer, in several projections, so that generated code stays small.

    What the gates of the rules ask (:mod:`veilspark.functions.clues`) is worked out in the projections before them.
    """
    check_mode(mode)
    words = words or Dictionaries()
    if any(c.lower().startswith("_vs_") for c in docs.columns):
        raise ValueError("names of columns that begin with _vs_ are kept for the engine")
    out = docs.withColumn("_vs_clean", clean(F.col(text)))
    out = out.select("*", has_digit(F.col("_vs_clean")).alias("_vs_digit"), words_of(F.col("_vs_clean")).alias("_vs_words"))
    out = out.withColumn("_vs_stems", stems_of(F.col("_vs_words")))
    rules = [(n, f) for n, f in RULES if (mode != "standard" or n != "dates") and (only is None or n in only)]
    for at in range(0, len(rules), 7):
        out = out.select("*", *(rule_column(n, f, words) for n, f in rules[at : at + 7]))
    return out


def detect(
    docs: DataFrame,
    mode: str = "standard",
    words: Dictionaries | None = None,
    text: str = "text",
    extra: str | None = None,
    detector: Callable[[Column], Column] | None = None,
    coreference: bool = True,
    only: set[str] | None = None,
) -> DataFrame:
    """``docs`` with ``findings``: typed, scored spans that do not overlap, by start.

    ``extra`` names a column of further findings; ``detector`` is any function of the text column that returns
    findings, a vectorised UDF for instance. Null text has no findings. A column ``findings`` of the input gives way to the new one.
    """
    found = candidates(docs, mode, words, only, text)
    rules = [c for c in found.columns if c.startswith("_vs_rule_")]
    out = found.withColumn("findings", built(("dedupe", *rules), lambda: resolve.dedupe(F.concat(*(F.col(c) for c in rules)))))
    if extra is not None:
        out = out.withColumn("findings", resolve.merge(F.col("findings"), F.col(extra)))
    if detector is not None:
        out = out.withColumn("findings", resolve.merge(F.col("findings"), detector(F.col(text))))
    if coreference:
        out = out.withColumn("findings", built(("coreferences",), lambda: resolve.coreferences(F.col("_vs_clean"), F.col("findings"))))
    return out.select(*others(docs, "findings"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out to all cores if it is smaller than one file split for each of them.

    A file of few row groups is read by few tasks, and a projection stays in them; rules cost far more than moving so little. Larger inputs stay as they are.
    """
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if size < split * cores else docs


def explode(detected: DataFrame, *keep: str) -> DataFrame:
    """Long form: doc_id, entity_type, start, end, score, source, value.

    ``explode_outer`` with a filter behind it: a plain explode would push a size test through the projection and detect twice.
    """
    text = F.col("text")
    valued = lambda codes: F.transform("findings", lambda f: F.struct(f.alias("f"), cut(text, codes, f["start"], f["end"]).alias("value")))
    long = detected.select("doc_id", *keep, F.explode_outer(let(wide(text, F.size("findings")), valued)).alias("v")).where(F.col("v").isNotNull())
    return long.select("doc_id", *keep, "v.f.*", "v.value")


def findings(docs: DataFrame, mode: str = "standard", words: Dictionaries | None = None, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Findings of ``docs`` in long form."""
    return explode(detect(docs.select("doc_id", *keep, "text"), mode, words, **options), *keep)


def anonymize(docs: DataFrame, mode: str = "standard", words: Dictionaries | None = None, **options) -> DataFrame:
    """``docs`` with ``findings``, ``anonymized`` and ``preview`` (spans of the replacements). Reversible mode: :func:`pseudonymize`."""
    if check_mode(mode) == "reversible":
        raise ValueError("reversible mode numbers its placeholders: use pseudonymize")
    out = detect(docs, mode, words, **options).withColumn("_vs_r", rewrite.anonymized(F.col("text"), F.col("findings"), mode))
    return out.select(*others(docs, "findings", "anonymized", "preview"), "findings", F.col("_vs_r.text").alias("anonymized"), F.col("_vs_r.spans").alias("preview"))


def pseudonymize(docs: DataFrame, words: Dictionaries | None = None, known: DataFrame | None = None, scope: str = "document", **options) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``row_key`` and ``anonymized``, mapping): numbered placeholders that :func:`restore` puts back.

    Rows are judged, not ids: null and repeated doc_ids are as good as others, and ``row_key`` ties a row to its part of the mapping
    (:mod:`veilspark.functions.identity`). ``known`` (entity_type, value, placeholder) are entries to go on with: with doc_id or row_key those of a document,
    with neither those of the corpus. ``scope`` "document" numbers each row by itself, in the row, without a join; its mapping is row_key, doc_id, entity_type,
    value, placeholder. "corpus" numbers over all documents; its mapping is entity_type, value, placeholder.
    """
    if scope not in ("document", "corpus"):
        raise ValueError(f"unknown scope {scope!r}: document or corpus")
    detected = with_row_key(detect(docs, "reversible", words, **options), "doc_id", "text")
    columns = others(detected, "findings", "anonymized")
    if scope == "document":
        entries = None
        if known is not None:
            of = identity_columns(detected, known)
            same = known.groupBy(*of, "entity_type", "value").agg(F.min("placeholder").alias("placeholder"))
            old = same.groupBy(*of).agg(F.collect_list(F.struct("entity_type", "value", "placeholder")).alias("_vs_known"))
            detected, entries = null_safe(detected, old, of, "left"), F.col("_vs_known")
        made = detected.withColumn("_vs_made", rewrite.numbered_in_row(F.col("text"), F.col("findings"), entries))
        out = made.select(*columns, rewrite.with_placeholders(F.col("text"), F.col("_vs_made.named"))["text"].alias("anonymized"))
        listed = made.select(ROW_KEY, "doc_id", F.explode_outer("_vs_made.entries").alias("e")).where(F.col("e").isNotNull())
        return out, listed.select(ROW_KEY, "doc_id", "e.*").distinct()
    long = explode(detected, ROW_KEY)
    mapping = rewrite.numbered_corpus(detected, long, known)
    # rows that agree in id and text have one key and the same spans
    spans = long.select(ROW_KEY, "entity_type", "start", "end", "value").distinct().join(mapping, ["entity_type", "value"])
    named = spans.groupBy(ROW_KEY).agg(F.collect_list(F.struct("entity_type", "start", "end", "placeholder")).alias("_vs_named"))
    placed = detected.join(named, ROW_KEY, "left")
    anonymized = F.when(F.col("_vs_named").isNull(), F.col("text")).otherwise(rewrite.with_placeholders(F.col("text"), F.col("_vs_named"))["text"])
    return placed.select(*columns, anonymized.alias("anonymized")), mapping


def restore(docs: DataFrame, mapping: DataFrame, text: str = "anonymized") -> DataFrame:
    """``docs`` with ``restored`` and ``status`` by a mapping of :func:`pseudonymize`.

    Rows meet their entries by row_key where both sides have it. Without it they meet by doc_id; a placeholder that stands for different values under one
    doc_id is then no entry, so it is left in the text and counts as unknown: nobody's value is put into another row. A mapping with neither is one of the
    corpus, and texts meet it by the placeholders that they hold.
    """
    entry = F.struct("placeholder", "entity_type", "value")
    if ROW_KEY in mapping.columns or "doc_id" in mapping.columns:
        of = identity_columns(docs, mapping)
        one = mapping.groupBy(*of, "placeholder").agg(F.min(F.struct("entity_type", "value")).alias("e"), F.max(F.struct("entity_type", "value")).alias("other"))
        one = one.where(F.col("e") == F.col("other")).select(*of, "placeholder", "e.*")
        source = docs
    else:
        # the key is of the anonymized text: equal texts hold equal placeholders
        of = ["_vs_text"]
        source = docs.withColumn("_vs_text", key_of(F.col(text)))
        held = source.select("_vs_text", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.NUMBERED), F.lit(0)))).alias("placeholder")).distinct()
        one = held.join(mapping, "placeholder")
    entries = one.groupBy(*of).agg(F.array_sort(F.collect_list(entry)).alias("_vs_entries"))
    none = F.array().cast("array<struct<placeholder:string,entity_type:string,value:string>>")
    out = null_safe(source, entries, of, "left").withColumn("_vs_entries", F.coalesce("_vs_entries", none))
    return out.withColumn("restored", rewrite.restored(F.col(text), F.col("_vs_entries"))).withColumn("status", rewrite.placeholder_status(F.col(text), F.col("_vs_entries"))).drop("_vs_entries", "_vs_text")


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[Callable[[], None]]:
    """Jobs started in the block, by this thread, form a group; the value, called from any thread, cancels those that run.

    How far they are: :func:`progress`.
    """
    context = spark.sparkContext
    context.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield lambda: context.cancelJobGroup(name)
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)


@contextmanager
def progress(spark: SparkSession, name: str, tell: Callable[[int, int], None], every: float = 0.2) -> Iterator[Callable[[], None]]:
    """:func:`cancellable`, and ``tell(done, total)`` is called with the finished tasks and all tasks so far of the jobs in the block; ``done`` never falls.

    ``total`` grows when a job is submitted; both are told a last time when the block ends.
    """
    tracker, stages, last, over = spark.sparkContext.statusTracker(), {}, [0, 0], threading.Event()

    def look() -> None:
        for job in tracker.getJobIdsForGroup(name):
            for stage in (info.stageIds if (info := tracker.getJobInfo(job)) else ()):
                if seen := tracker.getStageInfo(stage):
                    done, _ = stages.get(stage, (0, 0))
                    stages[stage] = max(done, seen.numCompletedTasks), seen.numTasks
        now = [sum(d for d, _ in stages.values()), sum(n for _, n in stages.values())]
        if now != last:
            last[:] = now
            tell(*now)

    def watch() -> None:
        while not over.wait(every):
            look()

    thread = threading.Thread(target=watch, daemon=True)
    with cancellable(spark, name) as cancel:
        thread.start()
        try:
            yield cancel
        finally:
            over.set()
            thread.join()
            look()


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows`` and what is counted while they are written: rows, errors (rows with an ``error``) and bytes (of ``content``, or of ``text``)."""
    seen = Observation(name)
    size = next((F.octet_length(c).cast("long") for c in ("content", "anonymized", "text") if c in rows.columns), F.lit(0).cast("long"))
    errors = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(errors).alias("errors"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), seen


def accepted(docs: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """Texts that one request may hold: not blank and not too long."""
    return docs.where((F.length("text") <= most) & (F.trim("text") != ""))
