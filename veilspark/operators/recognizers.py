"""Recognizers: from a text column to an array of scored findings, as Catalyst expressions.

Every recognizer takes ``clean`` text (:func:`veilspark.functions.spans.clean`) and returns a column of type ``FINDINGS``.
Gates in front are conditions that a match implies, so that texts without a candidate pay little.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checks, fixed
from veilspark.functions.clues import Clues, WordTable, first_words
from veilspark.functions.spans import FINDINGS, any_of, apart, before, extract_at, finding, gated, let, plain_words, spans, spans_sql, trimmed

#: Most entries of a dictionary: they stand in the plan, as one string, so they have to be a dimension table.
MOST_WORDS = 200_000
#: Behind a match, what shows that words further on cannot belong to it: two more words and a blank.
WORDS_SEEN = r"(?U)^\s*\S+\s+\S+\s"
#: The same for codes: a sign that no code holds.
CODE_SEEN = r"(?U)^[\s\w-]*+[^\s\w-]"


@dataclass
class Dictionaries:
    """First names (lower case) and places (normalised): dimension tables of bounded size, given at run time."""

    first_names: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)  # regions included

    def __post_init__(self) -> None:
        if max(len(self.first_names), len(self.places)) > MOST_WORDS:
            raise ValueError(f"a dictionary has more than {MOST_WORDS} entries")

    @property
    def longest(self) -> int:
        """Words of the longest place."""
        return max((len(p.split()) for p in self.places), default=0)


def _labelled(seen: Clues, entity: str, pattern: str, score: float, valid: Callable[[Column], Column] | None = None) -> Column:
    found = spans(seen.text, pattern, value=1)
    if valid is not None:
        found = F.filter(found, lambda s: valid(s["value"]))
    return F.transform(found, lambda s: finding(entity, s["start"], s["end"], score))


def _trimmed(seen: Clues, entity: str, pattern: str, score: float, period: bool = True) -> Column:
    ends = F.transform(spans(seen.text, pattern), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(trimmed(s["value"], period))).alias("end")))
    return F.transform(F.filter(ends, lambda s: s["end"] > s["start"]), lambda s: finding(entity, s["start"], s["end"], score))


def emails(t: Column, seen: Clues) -> Column:
    return gated(F.contains(t, F.lit("@")), _trimmed(seen, "EMAIL_ADDRESS", fixed.EMAIL, 0.98))


def pec(t: Column, seen: Clues) -> Column:
    by_label = _labelled(seen, "PEC_ADDRESS", fixed.PEC_LABELLED, 0.98)
    by_domain = F.transform(F.filter(spans(seen.text, fixed.EMAIL), lambda s: checks.pec_domain(s["value"])), lambda s: finding("PEC_ADDRESS", s["start"], s["end"], 0.97))
    return gated(F.contains(t, F.lit("@")), F.concat(by_label, by_domain))


def phones(t: Column, seen: Clues) -> Column:
    return gated(seen.digit, _trimmed(seen, "PHONE_NUMBER", fixed.PHONE, 0.94))


def foreign_phones(t: Column, seen: Clues) -> Column:
    count = lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)
    return gated(F.contains(t, F.lit("+")), F.transform(F.filter(spans(seen.text, plain_words(fixed.FOREIGN_PHONE)), lambda s: count(s["value"])), lambda s: finding("PHONE_NUMBER", s["start"], s["end"], 0.92)))


def fiscal_codes(t: Column, seen: Clues) -> Column:
    found = F.filter(spans(seen.text, fixed.FISCAL), lambda s: checks.fiscal_code(F.upper(s["value"])))
    return gated(seen.digit, F.transform(found, lambda s: finding("CODICE_FISCALE", s["start"], s["end"], 0.96)))


def labelled_fiscal_codes(t: Column, seen: Clues) -> Column:
    return gated(t.rlike(r"(?i)c\.?\s*f|fisc"), _labelled(seen, "CODICE_FISCALE", fixed.FISCAL_LABELLED, 0.9))


def tabular_fiscal_codes(t: Column, seen: Clues) -> Column:
    """Upper-case codes in the columns that a header row names, down to the first empty row.

    Lines with offsets come from one fold; the first header decides alone.
    """
    line = spans(f"concat({seen.text}, '\\n')", f"(?s)(.*?)({fixed.PYTHON_LINES})", (1,))
    lines = F.transform(line, lambda s: F.struct(s["from"].alias("at"), F.regexp_replace(s["g1"], "[\r\n]+$", "").alias("row")))
    count = lambda row, d: F.length(row) - F.length(F.replace(row, F.lit(d), F.lit("")))

    def delimiter(row: Column) -> Column:
        comma, semi, tab = (count(row, d) for d in ",;\t")
        return F.when(F.greatest(comma, semi, tab) == 0, F.lit(None).cast("string")).when((comma >= semi) & (comma >= tab), ",").when(semi >= tab, ";").otherwise("\t")

    def cells(row: Column, d: Column) -> Column:
        return F.when(d == ",", F.split(row, ",", -1)).when(d == ";", F.split(row, ";", -1)).otherwise(F.split(row, "\t", -1))

    bare = lambda cell: F.trim(cell, F.lit(" \t\"'"))
    def is_head(row: Column) -> Column:
        return let(delimiter(row), lambda d: d.isNotNull() & F.coalesce(F.exists(cells(row, d), lambda c: bare(c).rlike(f"^{fixed.FISCAL_HEADER}$")), F.lit(False)))

    def below(header: Column, d: Column, after: Column) -> Column:
        empty = F.array_position(F.transform(after, lambda x: x["row"]), "").cast("int")
        rows = F.when(empty > 0, F.slice(after, 1, empty - 1)).otherwise(after)
        columns = F.filter(F.transform(cells(header, d), lambda c, i: F.when(bare(c).rlike(f"^{fixed.FISCAL_HEADER}$"), i)), lambda i: i.isNotNull())
        return let(columns, lambda at: F.flatten(F.transform(rows, lambda x: let(cells(x["row"], d), lambda parts: of_row(x["at"], parts, at)))))

    def of_row(offset: Column, parts: Column, columns: Column) -> Column:
        def of_cell(i: Column) -> Column:
            def of_raw(raw: Column) -> Column:
                value = bare(raw)
                start = offset + F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, c: a + F.length(c) + 1) + F.length(raw) - F.length(F.ltrim(raw, F.lit(" \t\"'")))
                return F.when(F.coalesce(value.rlike(f"^{fixed.FISCAL_SHAPE}$"), F.lit(False)), finding("CODICE_FISCALE", start, start + F.length(value), 0.9))

            return let(F.get(parts, i), of_raw)

        return F.filter(F.transform(columns, of_cell), lambda f: f.isNotNull())

    def of_lines(lines: Column) -> Column:
        # place of the header among all lines but the last
        def of_place(where: Column) -> Column:
            header = F.get(lines, where - 1)["row"]
            found = let(header, lambda h: let(delimiter(h), lambda d: let(F.slice(lines, where + 1, F.size(lines) - where), lambda after: below(h, d, after))))
            return F.when((where > 0) & (where < F.size(lines)), found)

        return let(F.array_position(F.transform(lines, lambda x: is_head(x["row"])), True).cast("int"), of_place)

    found = F.coalesce(let(lines, of_lines), F.array().cast(FINDINGS))
    return gated(seen.digit & t.rlike(fixed.FISCAL_SHAPE) & t.rlike("[,;\t]") & t.rlike(r"(?i)c\.?[ \t]*f|fiscale"), found)


def vat_numbers(t: Column, seen: Clues) -> Column:
    found = F.filter(spans(seen.text, fixed.VAT, (1,)), lambda s: checks.vat(s["g1"]))
    return gated(seen.digit & t.rlike("[0-9]{11}"), F.transform(found, lambda s: finding("PARTITA_IVA", s["start"], s["end"], 0.96)))


def ibans(t: Column, seen: Clues) -> Column:
    """Every head is tried, since one may stand inside a candidate that fails; accepted spans then go left to right.

    A candidate is cut to its country's length, counted without blanks and hyphens.
    """
    def candidate(s: Column) -> Column:
        def of_whole(whole: Column) -> Column:
            def of_code(code: Column) -> Column:
                def of_length(n: Column) -> Column:
                    # as many characters as hold n letters or digits
                    marks = F.transform(F.filter(F.split(whole, ""), lambda c: c != ""), lambda c: F.when(c.rlike(r"(?U)[\s-]"), 0).otherwise(1))
                    end = F.aggregate(marks, F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at")), lambda a, m: F.when(a["seen"] < n, F.struct((a["seen"] + m).alias("seen"), (a["at"] + 1).alias("at"))).otherwise(a), lambda a: a["at"])
                    ok = F.coalesce((F.length(code) >= n) & checks.iban(F.substring(code, F.lit(1), n)), F.lit(False))
                    return F.struct(s["start"].alias("start"), F.when(ok, s["start"] + end).alias("end"))

                return let(checks.iban_length(code), of_length)

            return let(F.upper(checks.compact(whole, r"[\s-]")), of_code)

        return let(extract_at(t, s["start"], fixed.IBAN_WHOLE, CODE_SEEN, 300), of_whole)

    tried = F.filter(F.transform(spans(seen.text, fixed.IBAN_HEAD), candidate), lambda s: s["end"].isNotNull())
    kept = F.transform(apart(tried, "array<struct<start:int,end:int>>"), lambda s: finding("IBAN", s["start"], s["end"], 0.97))
    return gated(seen.digit & t.rlike(r"(?i)[A-Z]{2}[\s-]*[0-9]{2}[\s-]*[A-Z0-9]"), kept)


def sdi_codes(t: Column, seen: Clues) -> Column:
    return gated(seen.begins("sdi dest univ cod") & t.rlike("(?iu)sdi|destinatario|univoco"), _labelled(seen, "SDI_CODE", fixed.SDI, 0.9, checks.sdi))


def health_cards(t: Column, seen: Clues) -> Column:
    return gated(seen.digit & t.rlike("(?iu)tessera|cns|nazionale"), _labelled(seen, "HEALTH_CARD", fixed.HEALTH_CARD, 0.9, checks.health_card))


def identity_documents(t: Column, seen: Clues) -> Column:
    return gated(seen.digit, _labelled(seen, "IDENTITY_DOCUMENT", fixed.IDENTITY, 0.92, checks.contextual_code))


def plates(t: Column, seen: Clues) -> Column:
    return gated(seen.digit & seen.any_of("targ"), _labelled(seen, "VEHICLE_PLATE", fixed.PLATE, 0.91, checks.contextual_code))


def protocols(t: Column, seen: Clues) -> Column:
    return gated(seen.digit, _labelled(seen, "PROTOCOL_CASE_NUMBER", fixed.PROTOCOL, 0.88, checks.protocol))


def cadastral(t: Column, seen: Clues) -> Column:
    """A strong label stands alone; a weak one needs a domain word or a strong label within 100 characters."""
    strong = lambda label: F.lower(F.regexp_replace(label, r"(?U)[\s.]", "")).rlike(fixed.CADASTRE_STRONG)
    found = F.transform(spans(seen.text, fixed.CADASTRE, (1,), 2), lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["start"].alias("start"), s["end"].alias("end"), strong(s["g1"]).alias("strong")))

    def accepted(s: Column, all_: Column) -> Column:
        lo, hi = F.greatest(s["from"] - 100, F.lit(0)), s["to"] + 100
        domain = F.substring(t, lo + 1, hi - lo).rlike(fixed.CADASTRE_DOMAIN)
        near = F.exists(all_, lambda o: (o["from"] != s["from"]) & o["strong"] & (o["from"] < F.least(hi, F.length(t))) & (lo < o["to"]))
        return s["strong"] | domain | near

    kept = let(found, lambda all_: F.filter(all_, lambda s: accepted(s, all_)))
    return gated(seen.any_of("fogl fgl fg part p plla mapp suba sub sezi sez cate cat catc"), F.transform(kept, lambda s: finding("CATASTO", s["start"], s["end"], 0.9)))


def cards(t: Column, seen: Clues) -> Column:
    digits = lambda v: F.regexp_replace(v, "[ -]", "")
    ok = lambda v: F.length(digits(v)).between(13, 19) & F.coalesce(checks.luhn(digits(v)), F.lit(False))
    return gated(seen.digit & t.rlike("[0-9](?:[ -]?[0-9]){12}"), F.transform(F.filter(spans(seen.text, plain_words(fixed.CARD)), lambda s: ok(s["value"])), lambda s: finding("CREDIT_CARD", s["start"], s["end"], 0.95)))


def addresses(t: Column, seen: Clues) -> Column:
    ends = F.transform(spans(seen.text, fixed.ADDRESS), lambda s: F.struct(s["start"].alias("start"), trimmed(s["value"]).alias("value")))
    no = lambda v: v.rlike(fixed.ADDRESS_NOT_VIA) | v.rlike(fixed.ADDRESS_NOT_CORSO) | (v.rlike(fixed.ADDRESS_HAMLET) & ~v.rlike(r"(?U)\d"))
    kept = F.filter(ends, lambda s: (F.length(s["value"]) > 0) & ~no(s["value"]))
    return gated(seen.any_of("via v vial piaz p cors c vico larg stra cont loca loc fraz"), F.transform(kept, lambda s: finding("ADDRESS", s["start"], s["start"] + F.length(s["value"]), 0.86)))


def lower_addresses(t: Column, seen: Clues) -> Column:
    found = F.filter(spans(seen.text, fixed.LOWER_ADDRESS, (1,)), lambda s: ~F.exists(checks.words(s["g1"]), lambda w: w.isin(fixed.LOWER_STREET_STOP)))
    return gated(seen.digit & seen.any_of("via vial piaz cors vico larg stra cont fraz loca"), F.transform(found, lambda s: finding("ADDRESS", s["start"], s["end"], 0.78)))


def postcode_cities(t: Column, seen: Clues) -> Column:
    stop = [*fixed.PERSON_STOP, *(m.capitalize() for m in fixed.MONTHS), *fixed.CITY_STOP]
    ok = lambda s: ~before(t, s["start"], 80).rlike(fixed.POSTCODE_REGISTER) & ~checks.words(s["g1"])[0].isin(stop)
    return gated(seen.digit & t.rlike("[0-9]{5}[ \t]"), F.transform(F.filter(spans(seen.text, fixed.POSTCODE_CITY, (1,)), ok), lambda s: finding("ADDRESS", s["start"], s["end"], 0.8)))


def labelled_postcodes(t: Column, seen: Clues) -> Column:
    return gated(seen.digit & t.rlike("[0-9]{5}"), _labelled(seen, "POSTAL_CODE", fixed.POSTCODE_LABELLED, 0.94))


#: Legal forms behind a blank or hyphen.
_FORMS = r"[ \t-]s\.?[ \t]*(?:r\.?[ \t]*l|p\.?[ \t]*a|n\.?[ \t]*c|a\.?[ \t]*s|s)(?!\w)|soc\.?[ \t]*coop|onlus|[ \t](?:aps|ets)(?!\w)"


def organizations(t: Column, seen: Clues) -> Column:
    """Legal forms, business keywords, forms broken by a hyphen (which outrank what they overlap), and academic bodies."""
    broken = _trimmed(seen, "ORGANIZATION", fixed.FIRM_BROKEN, 0.94, period=False)
    plain = F.concat(_trimmed(seen, "ORGANIZATION", fixed.FIRM_SUFFIX, 0.9, period=False), _trimmed(seen, "ORGANIZATION", fixed.FIRM_PREFIX, 0.88, period=False))
    joined = let(broken, lambda bs: F.concat(F.filter(plain, lambda f: ~F.exists(bs, lambda b: (f["start"] < b["end"]) & (b["start"] < f["end"]))), bs))
    found = F.concat(joined, _trimmed(seen, "ORGANIZATION", fixed.ACADEMIC, 0.9))
    stems = "s sr sp sn sa srl spa snc sas ss soc socc coop onlu aps ets ditt soci impr azie ragi deno univ dipa"
    gate = seen.any_of(stems) & t.rlike(rf"(?iu){_FORMS}|cooperativa|ditta|societ|impresa|azienda|ragione|denominazione|universit|dipartimento")
    return gated(gate, F.filter(found, lambda f: checks.organization(F.substring(t, f["start"] + 1, f["end"] - f["start"]))))


def territorial_bodies(t: Column, seen: Clues) -> Column:
    gate = seen.any_of("prov regi comu citt muni unio ammi pref ques proc trib came")
    return gated(gate, _trimmed(seen, "TERRITORIAL_BODY", fixed.BODY, 0.88))


def _person_value(value: Column) -> Column:
    return F.split(trimmed(value), fixed.PERSON_CUT, 2)[0]


_TITLE_STEMS = "sig sigr sign dott avv ing geom rag prof nota sott clie refe rapp tito nato nata inte bene"


def persons(t: Column, seen: Clues) -> Column:
    none = "array<struct<start:int,end:int,value:string,from:int,to:int>>"
    titled = gated(seen.any_of(_TITLE_STEMS) & t.rlike(r"(?i)(?<![a-z])(?:sig|dott|avv|ing[.\s]|geom|rag[.\s]|prof|notai|sottoscritt|client|referent|rappresentant|titolar|nat[oa]\s|intestat|beneficiari)"), spans(seen.text, fixed.PERSON_TITLED, value=1), none)
    behind = r"(?i)[^a-z0-9](?:nat[oa]|residente|domiciliat[oa]|codice\s+fiscale|c\.?\s*f|e-?mail|pec|tel|telefono|cell|cellulare)(?![a-z])"
    found = F.concat(titled, gated(seen.any_of("nato nata resi domi codi c cf emai e pec tel tele cell") & t.rlike(behind), spans(seen.text, fixed.PERSON_BEFORE), none))
    cut = F.transform(found, lambda s: F.struct(s["start"].alias("start"), _person_value(s["value"]).alias("value")))
    return F.transform(F.filter(cut, lambda s: checks.person(F.trim(s["value"]))), lambda s: finding("PERSON", s["start"], s["start"] + F.length(s["value"]), 0.84))


def mentions(seen: Clues, phrases: list[str]) -> Column:
    """Whether the text has a word that begins one of the phrases: a gate for the rules that look dictionary words up."""
    first = first_words(phrases)
    return F.lit(True) if first is None else seen.has_word(first)


def dictionary_persons(t: Column, seen: Clues, words: Dictionaries) -> Column:
    """From each known first name on, up to four capitalised words; not behind a street word; no start inside a person."""
    if not words.first_names:
        return F.array().cast(FINDINGS)
    known = mentions(seen, words.first_names)
    names = WordTable(words.first_names)
    tokens = F.filter(spans(seen.text, fixed.NAME_TOKEN), lambda s: checks.is_first_name(s["value"], names))
    runs = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), _person_value(extract_at(t, s["start"], fixed.NAME_RUN, WORDS_SEEN)).alias("value")))
    good = F.filter(runs, lambda s: (s["value"] != "") & checks.person(s["value"]) & ~before(t, s["start"], 16).rlike(fixed.AFTER_STREET))

    ends = F.transform(good, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end")))
    return gated(known, F.transform(apart(ends, "array<struct<start:int,end:int>>"), lambda s: finding("PERSON", s["start"], s["end"], 0.72, "name_dictionary")))


def surname_first(t: Column, seen: Clues, words: Dictionaries) -> Column:
    """SURNAME Given, or Surname Given in a roster or alone on its line; the given name is a known one."""
    if not words.first_names:
        return F.array().cast(FINDINGS)
    known, names = mentions(seen, words.first_names), WordTable(words.first_names)

    def alone(s: Column) -> Column:
        line = F.concat(F.substring_index(F.substring(t, F.lit(1), s["start"]), "\n", -1), s["value"], F.substring_index(F.substring(t, s["end"] + 1, F.length(t)), "\n", 1))
        return F.trim(line, F.lit(" \t.;:()[]{}")) == s["value"]

    def ok(s: Column) -> Column:
        listed = checks.all_upper(s["g1"]) | before(t, s["start"], 80).rlike(fixed.ROSTER_BEFORE) | alone(s)
        return checks.is_first_name(checks.words(s["g2"])[0], names) & ~s["g1"].isin(fixed.SURNAME_STOP) & listed

    found = F.concat(F.filter(spans(seen.text, fixed.SURNAME_FIRST, (1, 2)), ok), F.filter(spans(seen.text, fixed.SURNAME_ROSTER, (1, 2)), ok))
    return gated(known, F.transform(found, lambda s: finding("PERSON", s["start"], s["end"], 0.8, "surname_first_rule")))


def place_context(t: Column, start: Column) -> Column:
    return any_of(before(t, start, 100), fixed.PLACE_BEFORE)


def standalone_field(t: Column, start: Column, end: Column) -> Column:
    left = F.regexp_extract(F.substring(t, F.lit(1), start), r"[^\n\r\t,;|]*\z", 0)
    right = F.regexp_extract(F.substring(t, end + 1, F.length(t)), r"^[^\n\r\t,;|]*", 0)
    value = F.substring(t, start + 1, end - start)
    return checks.normal_place(F.trim(F.concat(left, value, right), F.lit(" \t\"'()[]{}.:"))) == checks.normal_place(value)


def place_shape(value: Column) -> Column:
    v = F.trim(value)
    return (v != "") & ~((v == F.lower(v)) & (v != F.upper(v))) & v.rlike(fixed.PLACE_TEXT) & v.rlike(fixed.PLACE_TOKEN)


def dictionary_places(t: Column, seen: Clues, words: Dictionaries) -> Column:
    """Longest run of words that the place dictionary knows; words are used up before context is asked for."""
    if not words.places:
        return F.array().cast(FINDINGS)
    known = mentions(seen, words.places)
    begin, places = WordTable(p.split()[0] for p in words.places), WordTable(words.places)
    tokens = F.filter(spans(seen.text, fixed.PLACE_TOKEN), lambda s: begin.has(checks.normal_token(s["value"])))
    run = rf"(?U)^{fixed.PLACE_TOKEN}(?:\s+{fixed.PLACE_TOKEN}){{0,{words.longest - 1}}}"

    def longest(s: Column) -> Column:
        """As many words of the run as the dictionary knows as one place: the last such number decides."""

        def of_run(phrase: Column) -> Column:
            def of_words(parts: Column) -> Column:
                counts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: places.has(F.array_join(F.slice(parts, F.lit(1), k), " ")))
                return let(F.element_at(F.concat(F.array(F.lit(0)), counts), -1), of_count)

            def of_count(k: Column) -> Column:
                exactly = F.concat(F.lit(rf"(?U)^{fixed.PLACE_TOKEN}(?:\s+{fixed.PLACE_TOKEN}){{"), (k - 1).cast("string"), F.lit("}"))
                value = F.call_function("regexp_extract", phrase, exactly, F.lit(0))
                return F.when(k > 0, F.struct(s["start"].alias("start"), (s["start"] + F.length(value)).alias("end")))

            return let(F.transform(F.regexp_extract_all(phrase, F.lit(fixed.PLACE_TOKEN), F.lit(0)), checks.normal_token), of_words)

        return let(extract_at(t, s["start"], run, WORDS_SEEN), of_run)

    kept = apart(F.filter(F.transform(tokens, longest), lambda s: s.isNotNull()), "array<struct<start:int,end:int>>")
    named = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(t, s["start"] + 1, s["end"] - s["start"]).alias("value")))
    region = lambda s: checks.normal_place(s["value"]).isin(words.regions) if words.regions else F.lit(False)
    good = F.filter(named, lambda s: place_shape(s["value"]) & (region(s) | place_context(t, s["start"]) | standalone_field(t, s["start"], s["end"])))
    return gated(known, F.transform(good, lambda s: finding("LOCATION", s["start"], s["end"], F.when(region(s), 0.9).otherwise(0.82), "location_dictionary")))


def never_a_place(value: Column, words: Dictionaries) -> Column:
    """Words of legal prose that are no place unless the dictionary says so."""
    v = F.regexp_replace(checks.normal_place(value), "^(?:localita|località|frazione) ", "")
    return v.isin([x for x in fixed.NEVER_A_PLACE if x not in words.places]) if any(x not in words.places for x in fixed.NEVER_A_PLACE) else F.lit(False)


def listed_places(t: Column, seen: Clues, words: Dictionaries) -> Column:
    both = f"concat({spans_sql(seen.text, fixed.HAMLETS, value=1)}, {spans_sql(seen.text, fixed.MUNICIPALITIES, value=1)})"
    parts = spans_sql("concat(s.value, '\\n')", rf"(?is)(.+?)(?:{fixed.PLACE_GAP}|\n)", (1,))

    def part(s: Column, p: Column) -> Column:
        raw = p["g1"]
        value = F.trim(raw, F.lit(" \t.;:"))
        start = s["start"] + p["from"] + F.length(raw) - F.length(F.ltrim(raw, F.lit(" \t.;:")))
        return F.when((value != "") & ~never_a_place(value, words), finding("LOCATION", start, start + F.length(value), 0.86))

    found = F.flatten(F.transform(F.expr(f"transform({both}, s -> named_struct('start', s.start, 'parts', {parts}))"), lambda s: F.transform(s["parts"], lambda p: part(s, p))))
    return gated(seen.any_of("loca fraz comu"), F.filter(found, lambda f: f.isNotNull()))


def dates(t: Column, seen: Clues) -> Column:
    return gated(seen.digit, _trimmed(seen, "DATE", fixed.DATE, 0.82))


def accept_model_place(t: Column, start: Column, end: Column, words: Dictionaries) -> Column:
    """Which places of an outside model count."""
    value = F.substring(t, start + 1, end - start)
    plain = checks.normal_place(value)
    marks = any_of(value, (fixed.ADDRESS_MARK, fixed.INSTITUTION_MARK, fixed.NOT_PLACE_MARK, fixed.TITLE_MARK, r"\n[ \t]*\n"))
    rejected = ~place_shape(value) | marks | before(t, start, 40).rlike(fixed.TITLE_BEFORE) | plain.isin(*fixed.MODEL_PLACE_REJECTS) | plain.rlike(fixed.LEGAL_PHRASE) | never_a_place(value, words)
    context = place_context(t, start)
    ambiguous = (plain == "potenza") & F.substring(t, end + 1, F.length(t)).rlike(fixed.POTENZA_AFTER) & ~context & ~standalone_field(t, start, end)
    known = WordTable(words.places).has(plain)
    return ~rejected & ~ambiguous & (known | context | (F.size(F.split(plain, " ")) >= 2))


def accept_model_person(value: Column) -> Column:
    """Two or more name-like words, no address mark, no legal phrase."""
    parts = checks.words(value)
    like = lambda w: F.regexp_replace(w, "['’-]", "").rlike(r"(?U)^\p{L}+$") & w.rlike(r"^\p{Lu}")
    return (F.size(parts) >= 2) & F.forall(parts, like) & ~value.rlike(fixed.ADDRESS_MARK) & ~checks.normal_place(value).rlike(fixed.LEGAL_PHRASE)


#: In the order in which findings are listed; a stable sort keeps it among equals.
RULES: list[tuple[str, Callable]] = [
    ("emails", emails), ("pec", pec), ("phones", phones), ("foreign_phones", foreign_phones), ("fiscal_codes", fiscal_codes), ("labelled_fiscal_codes", labelled_fiscal_codes),
    ("tabular_fiscal_codes", tabular_fiscal_codes), ("vat_numbers", vat_numbers), ("ibans", ibans), ("sdi_codes", sdi_codes), ("health_cards", health_cards),
    ("identity_documents", identity_documents), ("plates", plates), ("protocols", protocols), ("cadastral", cadastral), ("cards", cards), ("addresses", addresses),
    ("lower_addresses", lower_addresses), ("postcode_cities", postcode_cities), ("labelled_postcodes", labelled_postcodes), ("organizations", organizations),
    ("territorial_bodies", territorial_bodies), ("dictionary_places", dictionary_places), ("listed_places", listed_places), ("persons", persons),
    ("dictionary_persons", dictionary_persons), ("surname_first", surname_first), ("dates", dates),
]
WITH_WORDS = {"dictionary_places", "listed_places", "dictionary_persons", "surname_first"}
