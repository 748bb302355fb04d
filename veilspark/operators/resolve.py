"""From overlapping findings to one clean list: dedupe, merge, coreference, review choices, manual values.

All in-row; joins only where choices come as tables.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veilspark.functions import checks, fixed
from veilspark.functions.identity import ROW_KEY, identity_columns, null_safe
from veilspark.functions.spans import FINDINGS, apart, cut, finding, let, wide


def lookup(pairs: dict[str, object], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key), default)


def priority(entity: Column) -> Column:
    return lookup({e[0]: e[5] for e in fixed.ENTITIES}, entity, F.lit(0))


def dedupe(found: Column) -> Column:
    """Earliest first; among equal starts the longest, then priority, then score, then list order. Overlaps with a kept one go."""
    keyed = F.transform(
        found,
        lambda f, i: F.struct(
            f["start"].alias("start"), (f["start"] - f["end"]).alias("shorter"), (-priority(f["entity_type"])).alias("rank"), (-f["score"]).alias("worse"), i.alias("at"), f.alias("f")
        ),
    )
    return apart(F.transform(F.array_sort(keyed), lambda k: k["f"]), FINDINGS)


def overlaps(f: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (f["start"] < o["end"]) & (o["start"] < f["end"]))


def _places_of(text: Column, literal: Column) -> Column:
    """Whole-word places of a literal that differs from row to row."""
    none = F.array().cast("array<int>")
    at = let(F.split(text, F.concat(F.lit(r"(?U)\b\Q"), literal, F.lit(r"\E\b")), -1), lambda pieces: F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, p: F.struct((a["at"] + F.length(p) + F.length(literal)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out")),
        lambda a: a["out"],
    ))
    return F.transform(at, lambda s: F.struct(s.alias("start"), (s + F.length(literal)).alias("end")))


def coreferences(text: Column, found: Column) -> Column:
    """Persons of two or more words are found again by full name and by surname, where nothing was found; then deduped."""
    of_type = F.filter(found, lambda f: f["entity_type"] == "PERSON")
    named = lambda codes: F.transform(of_type, lambda f: F.struct(f["source"].alias("source"), F.trim(cut(text, codes, f["start"], f["end"])).alias("name")))
    persons = let(wide(text, F.size(of_type)), named)
    many = F.filter(persons, lambda p: F.size(checks.words(p["name"])) >= 2)

    def surname(p: Column) -> Column:
        def upper(parts: Column) -> Column:
            lead = F.aggregate(parts, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda a, w: let(a["on"] & checks.all_upper(F.trim(w, F.lit(" .'’"))), lambda on: F.struct(on.alias("on"), (a["n"] + on.cast("int")).alias("n"))), lambda a: a["n"])
            return F.array_join(F.transform(F.slice(parts, F.lit(1), lead), lambda w: F.trim(w, F.lit(" ."))), " ")

        return let(checks.words(p["name"]), lambda parts: F.when(p["source"] == "surname_first_rule", upper(parts)).otherwise(F.trim(F.element_at(parts, -1), F.lit(" ."))))

    def spread(people: Column) -> Column:
        surnames = F.filter(F.transform(people, surname), lambda s: (F.length(s) >= 3) & s.rlike(r"^\p{Lu}") & checks.surname_spreads(s))
        literals = F.array_distinct(F.concat(F.transform(people, lambda p: p["name"]), surnames))
        again = F.flatten(F.transform(literals, lambda x: _places_of(text, x)))
        new = F.transform(F.filter(again, lambda s: ~overlaps(s, found)), lambda s: finding("PERSON", s["start"], s["end"], 0.75, "coreference"))
        return dedupe(F.concat(found, new))

    return F.when(F.exists(found, lambda f: f["entity_type"] == "PERSON"), let(many, spread)).otherwise(found)


def merge(found: Column, extra: Column) -> Column:
    """Findings of rules and of another detector."""
    return dedupe(F.concat(found, F.coalesce(extra.cast(FINDINGS), F.array().cast(FINDINGS))))


def excluded_pairs(reviewed: DataFrame) -> DataFrame:
    """doc_id (or row_key, where ``reviewed`` has it), entity_type, value of pairs of which every occurrence is unchecked.

    ``reviewed``: doc_id, entity_type, value, included; null counts as included.
    """
    return reviewed.groupBy(*identity_columns(reviewed), "entity_type", "value").agg(F.bool_or(F.coalesce("included", F.lit(True))).alias("any")).where(~F.col("any")).drop("any")


def exclude(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings in long form without excluded (type, exact value) pairs; what does not match exactly stays protected."""
    of = identity_columns(long, pairs) if {"doc_id", ROW_KEY} & set(pairs.columns) else []
    keys = [*of, "entity_type", "value"]
    return null_safe(long, pairs.select(*keys).distinct(), keys, "left_anti")


def same_value(long: DataFrame, picked: DataFrame) -> DataFrame:
    """All findings with the type and value of a picked one, within its document."""
    keys = [*identity_columns(long, picked), "entity_type", "value"]
    return null_safe(long, picked.select(*keys).distinct(), keys, "left_semi")


_EXTRA = ArrayType(StructType([StructField("entity_type", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


_MARKED = StructType([StructField("places", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))), StructField("extra", _EXTRA)])


def literal_spans(text: str, value: str) -> list[tuple[int, int]]:
    """Places (start, end) where ``value`` stands in ``text`` but for letter case; they may overlap.

    Case folding can turn one character into several. Each folded character knows the one it came from; an occurrence counts if it begins with the first and
    ends with the last of the characters that came from one.
    """
    wanted = value.casefold()
    if not wanted:
        return []
    folded = text.casefold()
    if len(folded) == len(text):
        source = np.arange(len(text))
    else:
        source = np.repeat(np.arange(len(text)), [len(c.casefold()) for c in text])
    begin = np.array([m.start() for m in re.finditer(f"(?={re.escape(wanted)})", folded)], np.int64)
    edge = np.ones(len(source) + 1, bool)  # between characters of different origin
    edge[1:-1] = source[1:] != source[:-1]
    begin = begin[edge[begin] & edge[begin + len(wanted)]]
    return list(zip(source[begin].tolist(), (source[begin + len(wanted) - 1] + 1).tolist()))


def _free_places(text: str, values, taken: list[tuple[int, int]]) -> list[dict]:
    """Places of the values, longest first, that touch nothing that is taken."""
    busy = np.zeros(len(text), bool)
    for start, end in taken:
        busy[start:end] = True
    found, seen = [], set()
    for v in sorted(values, key=lambda v: (-len(v["value"] or ""), v["entity_type"], v["value"] or "")):
        if not v["value"] or (v["entity_type"], v["value"].casefold()) in seen:
            continue
        seen.add((v["entity_type"], v["value"].casefold()))
        for a, b in literal_spans(text, v["value"]):
            if not busy[a:b].any():
                busy[a:b] = True
                found.append({"entity_type": v["entity_type"], "start": a, "end": b})
    return found


@F.pandas_udf(_EXTRA)
def _manual(text: pd.Series, values: pd.Series, taken: pd.Series) -> pd.Series:
    # Unicode case folding with offsets has no built-in function
    rows = zip(text, values, taken)
    return pd.Series([_free_places(t or "", vs if vs is not None else [], [(s["start"], s["end"]) for s in (spans if spans is not None else [])]) for t, vs, spans in rows])


@F.pandas_udf(_MARKED)
def _marked(text: pd.Series, values: pd.Series, taken: pd.Series) -> pd.DataFrame:
    places, extra = [], []
    for t, vs, spans in zip(text, values, taken):
        t, vs = t or "", list(vs) if vs is not None else []
        given = {p for v in vs for p in literal_spans(t, v["value"])}
        places.append([{"start": a, "end": b} for a, b in sorted(given)])
        extra.append(_free_places(t, vs, [s for s in ((s["start"], s["end"]) for s in (spans if spans is not None else [])) if s not in given]))
    return pd.DataFrame({"places": places, "extra": extra})


def add_manual(docs: DataFrame, values: DataFrame) -> DataFrame:
    """Add findings of caller-given values (doc_id or row_key, entity_type, value): longest first, so results do not depend on any order.

    Values of a doc_id, null included, hold for every row that has it.
    """
    of = identity_columns(docs, values)
    wanted = values.groupBy(*of).agg(F.collect_set(F.struct("entity_type", "value")).alias("_vs_values"))
    joined = null_safe(docs, wanted, of, "left")
    taken = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    extra = _manual(F.col("text"), F.col("_vs_values"), taken)
    added = F.transform(F.col("_vs_extra"), lambda s: finding(None, s["start"], s["end"], 1.0, "manual").withField("entity_type", s["entity_type"]))
    kept = joined.withColumn("_vs_extra", F.when(F.col("_vs_values").isNotNull(), extra))
    return kept.withColumn("findings", F.when(F.col("_vs_extra").isNull(), F.col("findings")).otherwise(F.array_sort(F.concat("findings", added.cast(FINDINGS)), lambda a, b: a["start"] - b["start"]))).drop("_vs_values", "_vs_extra")


def mark(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings of what a reviewer marked: ``marks`` are doc_id or row_key, entity_type, start, end.

    A marked value is taken wherever it stands, in any case. Findings on exactly those places give way to it, what else overlaps an occurrence keeps its place,
    and the whole is deduped. Marks outside the text or without a character are ignored; several in one call apply longest first.
    """
    of = identity_columns(docs, marks)
    wanted = marks.groupBy(*of).agg(F.collect_set(F.struct("entity_type", "start", "end")).alias("_vs_marks"))
    joined = null_safe(docs, wanted, of, "left")
    valid = F.filter("_vs_marks", lambda m: (m["start"] >= 0) & (m["start"] < m["end"]) & (m["end"] <= F.length("text")))
    values = F.transform(valid, lambda m: F.struct(m["entity_type"].alias("entity_type"), F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"]).alias("value")))
    valued = joined.withColumn("_vs_values", values)
    taken = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    found = valued.withColumn("_vs_marked", F.when(F.size("_vs_values") > 0, _marked(F.col("text"), F.col("_vs_values"), taken)))
    left = F.filter("findings", lambda f: ~F.exists("_vs_marked.places", lambda p: (p["start"] == f["start"]) & (p["end"] == f["end"])))
    added = F.transform("_vs_marked.extra", lambda s: finding(None, s["start"], s["end"], 1.0, "manual").withField("entity_type", s["entity_type"]))
    out = found.withColumn("findings", F.when(F.col("_vs_marked").isNull(), F.col("findings")).otherwise(dedupe(F.concat(left, added.cast(FINDINGS)))))
    return out.drop("_vs_marks", "_vs_values", "_vs_marked")


def replace_manually(long: DataFrame, spans: DataFrame) -> DataFrame:
    """Drop automatic findings on exactly the spans a reviewer marked anew."""
    keys = [*identity_columns(long, spans), "start", "end"]
    return null_safe(long, spans.select(*keys).distinct(), keys, "left_anti")
