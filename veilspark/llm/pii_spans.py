"""Operator 4 [native]: personal data by pattern, checksum and context.

Each kind has a pattern that proposes leftmost non-overlapping spans, a validator that drops failing
ones (Luhn, mod 97, ranges, digit counts) and context words that raise the score of a span when one
stands within ``CONTEXT_CHARS`` before it or after it. Everything is Catalyst expressions over one
row: no shuffle, no Python worker. Offsets are recovered by zipping ``regexp_extract_all`` with
``split`` over the same pattern; lengths are code points.

The patterns are the contract's with possessive quantifiers, and with a look-behind where a failed
start inside a run of characters could only fail again; matches are the same and matching stays linear in very long
runs. IBANs are tried at every head, as one may stand behind or inside a candidate that fails; a candidate is cut to its
country's length, and one of a country without a known length reaches as far as the pattern does. ``\\G`` lets a match begin right behind the one before it.

Defined cases: null text = no spans (counts 0, hash of the empty string); repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed

CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a text without a match of this cheap pattern has no span
    score: int  # in hundredths
    context: str
    base: bool = True


CONTEXT_BONUS = 15
#: Where an IBAN may begin; :func:`ibans` finds its end.
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 80, "mail|contact|write|kontakt|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 60, "address|server|host|client|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 70, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 50, "phone|call|mobile|fax|telef"),
    Kind("iban", IBAN_HEAD, "", 85, "iban|bank|account|konto|compte|cuenta", base=False),
)


def proposals(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, by one fold over gaps and matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _iban_whole() -> str:
    by_length: dict[int, list[str]] = {}
    for country, n in sorted(fixed.IBAN_LENGTHS.items()):
        by_length.setdefault(n, []).append(country)
    arms = [rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())]
    arms.append(rf"(?!{'|'.join(sorted(fixed.IBAN_LENGTHS))})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}")
    return rf"^(?:{'|'.join(arms)})(?![A-Za-z0-9])"


IBAN_WHOLE = _iban_whole()
#: An IBAN of 34 characters with a blank before each, and what may not follow.
IBAN_REACH = 70


def ibans(text: Column) -> Column:
    """Valid IBANs from left to right without overlaps."""

    def candidate(s: Column) -> Column:
        value = F.regexp_extract(F.substring(text, s["start"] + 1, F.lit(IBAN_REACH)), IBAN_WHOLE, 0)
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(value)).alias("end"), value.alias("value"))

    tried = F.filter(F.transform(proposals(text, IBAN_HEAD), candidate), lambda s: (s["value"] != "") & valid("iban", s["value"]))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a)
    return F.aggregate(tried, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """ISO 7064 remainder of an IBAN: first four characters last, letters as 10 to 35."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(compact, 5, 99), F.substring(compact, 1, 4))
    characters = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(characters, F.lit(0), step)


def valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(p == "", 0).otherwise(p.try_cast("int")), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(value) == 1
    return F.lit(True)


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind with their scores in hundredths."""
    confirmed = ibans(text) if kind.name == "iban" else F.filter(proposals(text, kind.pattern), lambda s: valid(kind.name, s["value"]))

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT_CHARS)))
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT_CHARS))
        near = F.concat(before, F.lit(" "), after).rlike(f"(?i){kind.context}")
        score = F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:int>>")
    found = F.transform(confirmed, scored)
    gate = F.contains(text, F.lit(kind.gate)) if kind.gate else text.rlike("[0-9][0-9 -]{6}" if kind.base else "[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}")
    return F.when(gate, found).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` plus one array of spans for each kind, named ``pii_<kind>``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("*", *(spans_of(text, k).alias(f"pii_{k.name}") for k in KINDS))


def mask_pii(docs: DataFrame, least: int = 50) -> DataFrame:
    """Replace every span of at least ``least`` hundredths by its kind in brackets; overlapping spans fall to the first."""
    found = find_pii(docs)
    merged = F.array_sort(F.filter(F.concat(*(F.col(f"pii_{k.name}") for k in KINDS)), lambda s: s["score"] >= least), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.when(skip, acc["at"]).otherwise(s["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).alias("out"))

    whole = F.aggregate(merged, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size(merged) > 0, whole).otherwise(F.col("text"))).drop(*(f"pii_{k.name}" for k in KINDS))


def _joined(kinds: tuple[Kind, ...], part: str) -> Column:
    keyed = [F.transform(F.col(f"pii_{k.name}"), lambda s, i=i: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["kind"].alias("kind"), s[part].alias("part"))) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*keyed)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["part"])), ",")


def op4(docs: DataFrame) -> DataFrame:
    base = tuple(k for k in KINDS if k.base)
    counts = [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS]
    return find_pii(docs.select("doc_id", "text")).select(
        "doc_id", *counts, F.sha2(_joined(base, "end").cast("binary"), 256).alias("base_sha256"), _joined(KINDS, "end").alias("spans"), _joined(KINDS, "score").alias("scores")
    )


def _oracle() -> str:
    """The same result in DuckDB, from the contract's plain patterns."""
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0"),
        "card": (r"[0-9](?:[ -]?[0-9])+", "len(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(len(digits)), lambda i: CASE WHEN i % 2 = 0 THEN d(digits, i) WHEN d(digits, i) * 2 > 9 THEN d(digits, i) * 2 - 9 ELSE d(digits, i) * 2 END)) % 10 = 0"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "len(digits) BETWEEN 9 AND 15"),
    }
    arms = []
    for i, k in enumerate(k for k in KINDS if k.base):
        pattern, test = plain[k.name]
        test = test.replace("d(digits, i)", "CAST(substr(digits, len(digits) - i, 1) AS INT)")
        arms.append(
            f"""SELECT doc_id, '{k.name}' AS kind, {i} AS rank, s, s + len(v) AS e, {k.score} AS score, '{k.context}' AS context, t FROM (
  SELECT doc_id, t, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
    CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, t, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, string_split_regex(coalesce(text, ''), '{pattern}') AS p FROM documents))
) WHERE {test}"""
        )
    return (
        "WITH found AS (\n" + "\nUNION ALL\n".join(arms) + f"""
), scored AS (
  SELECT *, score + CASE WHEN regexp_matches(substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, least(s, {CONTEXT_CHARS})) || ' ' || substr(t, e + 1, {CONTEXT_CHARS}), '(?i)(' || context || ')') THEN {CONTEXT_BONUS} ELSE 0 END AS total FROM found
), per AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || total, ',' ORDER BY s, rank) AS scores
  FROM scored GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, CAST(0 AS BIGINT) AS n_iban,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM documents LEFT JOIN per USING (doc_id)"""
    )


#: The tables hold no IBAN; tests cover that kind.
ORACLE_SQL = _oracle()
