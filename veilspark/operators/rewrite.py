"""Rewriting: replacement of findings, initials, numbered placeholders, restoring, preview spans."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.spans import cut, gathered, let, wide
from veilspark.functions.written import written
from veilspark.operators.resolve import lookup

MODES = ("standard", "maximum", "reversible")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    return mode


def placeholder_base(entity: Column) -> Column:
    return lookup({e[0]: e[1] for e in fixed.ENTITIES}, entity, entity)


def placeholder(entity: Column) -> Column:
    return F.concat(F.lit("<"), placeholder_base(entity), F.lit(">"))


def initials(value: Column) -> Column:
    runs = F.filter(F.regexp_extract_all(value, F.lit(f"[{fixed.LETTERS}0-9]+"), F.lit(0)), lambda w: ~w.rlike("^[0-9]+$"))
    joined = F.array_join(F.transform(runs, lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(fixed.NO_INITIALS))


def _whole(pattern: str) -> str:
    return pattern.replace(r"(?U)\b", r"(?Ud)^", 1) + r"\z"


def institution(value: Column, pattern: str) -> Column:
    """Descriptor and link as they are, initials of the name; null unless the pattern takes all of the value."""
    p = _whole(pattern)
    part = lambda k: F.regexp_extract(value, p, k)
    return F.when(value.rlike(p), F.concat(part(1), part(2), initials(part(3))))


def company(value: Column) -> Column:
    p = _whole(fixed.FIRM_BROKEN)
    return F.when(value.rlike(p), F.concat(initials(F.regexp_extract(value, p, 1)), F.lit(" S. r. l"), F.when(value.endswith("."), ".").otherwise("")))


def replacement(value: Column, entity: Column, mode: str) -> Column:
    if check_mode(mode) != "standard":
        return placeholder(entity)
    return (
        F.when(entity == "TERRITORIAL_BODY", F.coalesce(institution(value, fixed.BODY), initials(value)))
        .when(entity == "ORGANIZATION", F.coalesce(company(value), institution(value, fixed.ACADEMIC), initials(value)))
        .when(entity.isin("PERSON", "LOCATION", "ADDRESS"), initials(value))
        .otherwise(placeholder(entity))
    )


def _rewritten(text: Column, found: Column, new: callable, swallow: bool) -> Column:
    """struct<text, spans>: ``text`` with each finding replaced, and where the replacements stand. Findings that overlap an earlier one are left out.

    The pieces between findings are cut, replaced and joined; lengths add up to places. No string grows match by match.
    """
    edit = "array<struct<start:int,at:int,new:string>>"

    def of_codes(codes: Column) -> Column:
        value = lambda f: cut(text, codes, f["start"], f["end"])
        made = F.transform(F.array_sort(found, lambda a, b: a["start"] - b["start"]), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), let(value(f), lambda v: new(f, v)).alias("new")))

        def keep(a: Column, f: Column) -> tuple[dict[str, Column], Column]:
            dot = F.lit(swallow) & f["new"].endswith(".") & (cut(text, codes, f["end"], f["end"] + 1) == ".")
            end = f["end"] + F.when(dot, 1).otherwise(0)
            free = f["start"] >= a["at"]
            one = F.struct(f["start"].alias("start"), end.alias("at"), f["new"].alias("new"))
            return {"at": F.when(free, end).otherwise(a["at"])}, F.filter(F.array(one), lambda _: free)

        return let(gathered(made, {"at": F.lit(0)}, edit, keep)["out"], lambda edits: of_edits(edits, codes))

    def of_edits(edits: Column, codes: Column) -> Column:
        done = lambda i: F.coalesce(F.get(edits, i - 1)["at"], F.lit(0))
        pieces = F.transform(edits, lambda e, i: F.concat(cut(text, codes, done(i), e["start"]), e["new"]))
        rest = let(F.coalesce(F.get(edits, F.size(edits) - 1)["at"], F.lit(0)), lambda at: cut(text, codes, at, F.length(text)))
        # a replacement ends where the text before it was, moved by what all replacements so far have changed
        moved = gathered(edits, {"by": F.lit(0)}, "array<struct<start:int,end:int>>", lambda a, e: (
            {"by": a["by"] + F.length(e["new"]) - e["at"] + e["start"]},
            F.array(F.struct((e["start"] + a["by"]).alias("start"), (e["start"] + a["by"] + F.length(e["new"])).alias("end"))),
        ))["out"]
        return F.struct(F.concat(F.array_join(pieces, ""), rest).alias("text"), moved.alias("spans"))

    return let(wide(text, F.size(found)), of_codes)


def anonymized(text: Column, found: Column, mode: str) -> Column:
    """struct<text, spans>; a full stop behind a replacement that ends with one is swallowed."""
    return _rewritten(text, found, lambda f, v: replacement(v, f["entity_type"], mode), True)


def with_placeholders(text: Column, found: Column) -> Column:
    """struct<text, spans> from findings that carry their ``placeholder``."""
    return _rewritten(text, found, lambda f, v: f["placeholder"], False)


def _number(token: Column) -> Column:
    return F.regexp_extract(token, fixed.NUMBERED, 2).cast("long")


def numbered_in_row(text: Column, found: Column, known: Column | None = None) -> Column:
    """struct<entries, named>: the placeholders of a text's own values, and its findings with their placeholder.

    ``entries``: entity_type, value, placeholder of each value, numbered by type in order of first occurrence, behind the largest number in the text or in
    ``known`` (array of the same struct); a known value keeps its placeholder and takes no number. Everything stays in the row, so neither null nor repeated
    doc_ids matter. Findings are sorted by value; equal ones then stand together and share an entry.
    """
    held = F.regexp_extract_all(text, F.lit(fixed.NUMBERED), F.lit(0))
    nothing = F.array().cast("array<struct<entity_type:string,value:string,placeholder:string>>")
    known = nothing if known is None else F.coalesce(known, nothing)
    key = lambda e: F.concat(e["entity_type"], F.lit("\u0001"), e["value"])

    def of_codes(codes: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda f: F.struct(f["entity_type"].alias("entity_type"), cut(text, codes, f["start"], f["end"]).alias("value"), f["start"].alias("start"), f["end"].alias("end"))))
        return let(ordered, of_ordered)

    def of_ordered(s: Column) -> Column:
        def first(x: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            return (i == 0) | (before["entity_type"] != x["entity_type"]) | (before["value"] != x["value"])

        heads = F.filter(F.transform(s, lambda x, i: F.struct(first(x, i).alias("head"), x["entity_type"].alias("entity_type"), x["start"].alias("start"), x["value"].alias("value"), i.alias("at"))), lambda x: x["head"])
        ranged = let(heads, lambda hs: F.transform(hs, lambda h, j: F.struct(h["entity_type"].alias("entity_type"), h["start"].alias("start"), h["value"].alias("value"), h["at"].alias("at"), F.coalesce(F.get(hs, j + 1)["at"], F.size(s)).alias("upto"))))
        return let(F.array_sort(ranged), lambda firsts: let(F.map_from_entries(F.transform(known, lambda e: F.struct(key(e), e["placeholder"]))), lambda old: of_firsts(s, firsts, old)))

    def of_firsts(s: Column, firsts: Column, old: Column) -> Column:
        entry = lambda h, p: F.struct(h["entity_type"].alias("entity_type"), h["value"].alias("value"), p.alias("placeholder"), h["at"].alias("at"), h["upto"].alias("upto"))

        def of_type(t: Column) -> Column:
            own = lambda numbers, kind: F.filter(numbers, lambda p: kind(p))
            in_text = F.transform(own(held, lambda p: F.regexp_extract(p, fixed.NUMBERED, 1) == placeholder_base(t)), _number)
            in_known = F.transform(own(known, lambda e: e["entity_type"] == t), lambda e: _number(e["placeholder"]))
            base = F.coalesce(F.array_max(F.concat(in_text, in_known)), F.lit(0).cast("long"))
            mine = F.transform(F.filter(firsts, lambda h: h["entity_type"] == t), lambda h: F.struct(h.alias("h"), F.try_element_at(old, key(h)).alias("old")))
            kept = F.transform(F.filter(mine, lambda x: x["old"].isNotNull()), lambda x: entry(x["h"], x["old"]))
            made = let(base, lambda b: F.transform(F.filter(mine, lambda x: x["old"].isNull()), lambda x, i: entry(x["h"], F.concat(F.lit("<"), placeholder_base(t), F.lit("_"), (b + i + 1).cast("string"), F.lit(">")))))
            return F.concat(kept, made)

        entries = F.flatten(F.transform(F.array_distinct(F.transform(firsts, lambda h: h["entity_type"])), of_type))
        span = lambda x, e: F.struct(x["entity_type"].alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), e["placeholder"].alias("placeholder"))
        spread = lambda es: F.flatten(F.transform(es, lambda e: F.transform(F.slice(s, e["at"] + 1, e["upto"] - e["at"]), lambda x: span(x, e))))
        plain = lambda es: F.transform(es, lambda e: F.struct(e["entity_type"].alias("entity_type"), e["value"].alias("value"), e["placeholder"].alias("placeholder")))
        return let(entries, lambda es: F.struct(plain(es).alias("entries"), spread(es).alias("named")))

    return let(wide(text, F.size(found)), of_codes)


def reserved(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys``, entity_type, highest: numbered placeholders that the texts already hold."""
    base_to_type = {e[1]: e[0] for e in fixed.ENTITIES}
    held = F.regexp_extract_all("text", F.lit(fixed.NUMBERED), F.lit(0))
    named = F.regexp_extract("p", fixed.NUMBERED, 1)
    return docs.select(*keys, F.explode(held).alias("p")).select(*keys, lookup(base_to_type, named, named).alias("entity_type"), _number(F.col("p")).alias("n")).groupBy(*keys, "entity_type").agg(F.max("n").alias("highest"))


def _bases(docs: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """``keys``, entity_type, highest number that is taken, in the texts or in ``known``."""
    bases = reserved(docs, *keys)
    if known is None:
        return bases
    taken = known.groupBy(*keys, "entity_type").agg(F.max(_number(F.col("placeholder"))).alias("highest"))
    return bases.unionByName(taken).groupBy(*keys, "entity_type").agg(F.max("highest").alias("highest"))


def _made(rank: Column) -> Column:
    return F.concat(F.lit("<"), placeholder_base(F.col("entity_type")), F.lit("_"), (rank + F.coalesce("highest", F.lit(0))).cast("string"), F.lit(">"))


def numbered(docs: DataFrame, long: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, entity_type, value, placeholder: values numbered within each ``key`` by type, in order of first occurrence.

    For documents whose findings come in several rows; ``key`` is not null and names a document. One that stands in one row is numbered by :func:`numbered_in_row`.
    """
    first = long.groupBy(key, "entity_type", "value").agg(F.min("start").alias("first")).join(_bases(docs, None, [key]), [key, "entity_type"], "left")
    return first.select(key, "entity_type", "value", _made(F.row_number().over(Window.partitionBy(key, "entity_type").orderBy("first", "value"))).alias("placeholder"))


def numbered_corpus(docs: DataFrame, long: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """entity_type, value, placeholder over all documents: numbered by type in order of first occurrence (doc_id, null last, then place, then value).

    A dense rank without a task that sees all values of a type: values are dealt out by range and written, each part numbers its own, and the counts of the
    parts before it (one row for each part and type) are added.
    """
    first = long.groupBy("entity_type", "value").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "start")).alias("first"))
    kept = None
    if known is not None:
        first = first.join(known.groupBy("entity_type", "value").agg(F.min("placeholder").alias("placeholder")), ["entity_type", "value"], "left")
        kept = first.where(F.col("placeholder").isNotNull()).select("entity_type", "value", "placeholder")
        first = first.where(F.col("placeholder").isNull()).drop("placeholder")
    order = ["first.nameless", "first.doc_id", "first.start", "value"]
    parts = written(first.repartitionByRange("entity_type", *order).withColumn("part", F.spark_partition_id()), "ranged-values")
    sizes = parts.groupBy("entity_type", "part").agg(F.count("*").alias("n"))
    earlier = sizes.select("entity_type", "part", F.coalesce(F.sum("n").over(Window.partitionBy("entity_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    local = parts.withColumn("n", F.row_number().over(Window.partitionBy("entity_type", "part").orderBy(*order)))
    placed = local.join(F.broadcast(earlier), ["entity_type", "part"]).join(F.broadcast(_bases(docs, known, [])), "entity_type", "left")
    made = placed.select("entity_type", "value", _made(F.col("n") + F.col("earlier")).alias("placeholder"))
    return made if kept is None else made.unionByName(kept)


def restored(text: Column, entries: Column) -> Column:
    """Put values back, longest placeholder first, one after the other (so a restored value is searched as well)."""
    ordered = F.array_sort(entries, lambda a, b: F.length(b["placeholder"]) - F.length(a["placeholder"]))
    return F.aggregate(ordered, text, lambda t, e: F.replace(t, e["placeholder"], e["value"]))


def placeholder_status(text: Column, entries: Column) -> Column:
    """struct<matched, missing, unknown, restorable>: known tokens against those in the text."""
    present = F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.NUMBERED), F.lit(0)))
    known = F.transform(entries, lambda e: e["placeholder"])
    matched = F.array_sort(F.array_intersect(known, present))
    unknown = F.array_sort(F.array_except(present, known))
    return F.struct(matched.alias("matched"), F.array_sort(F.array_except(known, present)).alias("missing"), unknown.alias("unknown"), ((F.size(matched) > 0) & (F.size(unknown) == 0)).alias("restorable"))


