"""Match positions as array columns.

One ``regexp_replace`` puts marks around every match and its groups; splitting at the marks and summing lengths gives
code-point offsets. So each pattern runs once over a text, inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, FIELD = "\u0001", "\u0002"
#: Matches of a text are gathered by so many, as appending to an array copies it.
CHUNK = 256
FINDING = "struct<entity_type:string,start:int,end:int,score:double,source:string>"
FINDINGS = f"array<{FINDING}>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda variable; expressions used twice in lambdas would run twice."""
    return F.transform(F.array(value), body)[0]


def gathered(items: Column, zero: dict[str, Column], kind: str, step) -> Column:
    """A fold that gathers an array of type ``kind``: struct<..., out>, with the fields of ``zero`` carried along.

    ``step(state, item)`` returns (new fields, array to append). Appending copies an array, so items are gathered by ``CHUNK`` and chunks are joined.
    """
    none = F.array().cast(kind)
    named = lambda fields: [c.alias(n) for n, c in fields.items()]

    def one(acc: Column, item: Column) -> Column:
        fields, more = step(acc, item)
        return F.struct(*named(fields), F.concat(acc["out"], more).alias("out"))

    def fold(all_: Column) -> Column:
        def of_chunk(acc: Column, k: Column) -> Column:
            some = F.aggregate(F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)), F.struct(*(acc[n].alias(n) for n in zero), none.alias("out")), one)
            return let(some, lambda got: F.struct(*(got[n].alias(n) for n in zero), F.concat(acc["out"], got["out"]).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.struct(*named(zero), none.alias("out")), of_chunk)

    return let(items, fold)


def apart(ordered: Column, kind: str) -> Column:
    """Of spans in order, those that start no earlier than the last kept one ends."""
    some = lambda f, keep: F.filter(F.array(f), lambda _: keep)
    return gathered(ordered, {"at": F.lit(0)}, kind, lambda a, f: ({"at": F.when(f["start"] >= a["at"], f["end"]).otherwise(a["at"])}, some(f, f["start"] >= a["at"])))["out"]


#: Texts with more spans than this are cut by way of UTF-32, where a character has a place of its own.
MANY = 64


def wide(text: Column, n: Column) -> Column:
    """What :func:`cut` takes beside the text: UTF-32 of texts with many spans, else null."""
    return F.when((n > MANY) & F.is_valid_utf8(text), F.encode(text, "UTF-32"))


def cut(text: Column, codes: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end``. With ``codes`` of :func:`wide` that costs no walk from the beginning of the text.

    The letter in front keeps a byte order mark at the start of a piece from being taken for one.
    """
    lead = F.lit("x").cast("binary")
    piece = F.decode(F.concat(F.lit(bytearray(b"\0\0\0")), lead, F.substring(codes, start * 4 + 1, (end - start) * 4)), "UTF-32")
    return F.when(codes.isNotNull(), F.substring(piece, F.lit(2), end - start)).otherwise(F.substring(text, start + 1, end - start))


def clean(text: Column) -> Column:
    """Text of the same length without the two marks; null is empty."""
    marked = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(FIELD))
    return F.coalesce(F.when(marked, F.translate(text, OPEN + FIELD, "\u0003\u0003")).otherwise(text), F.lit(""))


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str, groups: tuple[int, ...] = (), value: int = 0) -> str:
    """:func:`spans` as SQL; ``text`` is SQL too. Text is put together at no cost, while a column expression costs a call to the JVM for every node."""
    taken = [value, *groups]
    marks = OPEN + "$0" + "".join(f"{FIELD}${g}" for g in taken) + FIELD
    names = ["start:int", "end:int", "value:string", "from:int", "to:int", *(f"g{g}:string" for g in groups)]
    none = "cast(array() as array<struct<" + ",".join("`" + n.replace(":", "`:") for n in names) + ">>)"
    own = "".join(f", 'g{g}', f[{2 + i}]" for i, g in enumerate(groups))
    span = f"named_struct('start', ends - length(f[1]), 'end', ends, 'value', f[1], 'from', a.at, 'to', ends{own})"
    step = f"""transform(array(split(piece, '{FIELD}', {len(taken) + 2})), f ->
        transform(array(a.at + length(f[0])), ends -> named_struct('at', ends + length(f[{len(taken) + 1}]), 'out', concat(a.out, array({span}))))[0])[0]"""
    chunk = f"aggregate(slice(pieces, k * {CHUNK} + 2, {CHUNK}), named_struct('at', acc.at, 'out', {none}), (a, piece) -> {step})"
    return f"""transform(array(split(regexp_replace({text}, {sql_string(pattern)}, {sql_string(marks)}), '{OPEN}')), pieces -> aggregate(
        sequence(0, cast(floor(greatest(size(pieces) - 2, 0) / {CHUNK}) as int)), named_struct('at', length(pieces[0]), 'out', {none}),
        (acc, k) -> transform(array({chunk}), got -> named_struct('at', got.at, 'out', concat(acc.out, got.out)))[0], acc -> acc.out))[0]"""


def spans(text: str | Column, pattern: str, groups: tuple[int, ...] = (), value: int = 0) -> Column:
    """array<struct<start, end, value, from, to, g<i>...>> of all matches in ``text``, SQL or a column of :func:`clean` text.

    ``start`` and ``end`` are of group ``value``, which has to end the match; ``from`` and ``to`` are of
    the match.
    """
    if isinstance(text, str):
        return F.expr(spans_sql(text, pattern, groups, value))
    # the same as expressions, for a text that has no name
    taken = [value, *groups]
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(OPEN + "$0" + "".join(f"{FIELD}${g}" for g in taken) + FIELD))
    names = ", ".join(["start:int", "end:int", "value:string", "from:int", "to:int", *(f"g{g}:string" for g in groups)])

    def step(a: Column, piece: Column) -> tuple[dict[str, Column], Column]:
        f = F.split(piece, FIELD, len(taken) + 2)
        end = a["at"] + F.length(f[0])
        own = (f[2 + i].alias(f"g{g}") for i, g in enumerate(groups))
        span = F.struct((end - F.length(f[1])).alias("start"), end.alias("end"), f[1].alias("value"), a["at"].alias("from"), end.alias("to"), *own)
        return {"at": end + F.length(f[len(taken) + 1])}, F.array(span)

    return let(F.split(marked, OPEN), lambda pieces: gathered(F.slice(pieces, F.lit(2), F.size(pieces) - 1), {"at": F.length(pieces[0])}, f"array<struct<{names}>>", step)["out"])


def plain_words(pattern: str) -> str:
    """``pattern`` with the word characters of the grammars: letters, numbers and the underscore.

    Java's ``\\w`` takes combining marks and joiners for such too, but not all numbers.
    """
    return pattern.replace(r"\w", r"[\p{L}\p{N}_]")


def extract_at(text: Column, start: Column, pattern: str, seen: str, window: int = 1000) -> Column:
    """What an anchored ``pattern`` matches in ``text`` from ``start`` on, however long.

    The next ``window`` characters are tried first, so that long texts are not copied for each place. That decides the match only if they reach the end of
    the text, or if what follows it in them matches ``seen``: enough to know that nothing further on can change it. Else all the rest is tried.
    """

    def of_near(near: Column) -> Column:
        def of_match(m: Column) -> Column:
            decided = (F.length(near) < window) | F.substring(near, F.length(m) + 1, F.length(near)).rlike(seen)
            return F.when(decided, m).otherwise(F.regexp_extract(F.substring(text, start + 1, F.length(text)), pattern, 0))

        return let(F.regexp_extract(near, pattern, 0), of_match)

    return let(F.substring(text, start + 1, F.lit(window)), of_near)


def gated(gate: Column, found: Column, kind: str = FINDINGS) -> Column:
    """``found`` where the cheap necessary condition holds, else an empty array."""
    return F.when(gate, found).otherwise(F.array().cast(kind))


def finding(entity: str, start: Column, end: Column, score: float | Column, source: str = "italian_rules") -> Column:
    score = F.lit(float(score)) if not isinstance(score, Column) else score
    return F.struct(F.lit(entity).alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.alias("score"), F.lit(source).alias("source"))


def trimmed(value: Column, period: bool = True) -> Column:
    """Value without trailing punctuation."""
    return F.rtrim(value, F.lit(" ,;:." if period else " ,;:"))


def before(text: Column, start: Column, width: int) -> Column:
    """The ``width`` characters in front of ``start``."""
    return F.substring(text, F.greatest(start - width + 1, F.lit(1)), F.least(start, F.lit(width)))


def any_of(value: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (value.rlike(p) for p in patterns))
