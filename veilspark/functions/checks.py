"""Validators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.clues import WordTable
from veilspark.functions.spans import let


def compact(value: Column, dropped: str = r"[\s.-]") -> Column:
    return F.regexp_replace(value, "(?U)" + dropped, "")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _weighted(value: Column, length: int, weight) -> Column:
    """Sum over the first ``length`` characters of ``weight(character, zero-based place)``; null where a weight is null."""
    places = F.sequence(F.lit(0), F.lit(length - 1))
    return F.aggregate(F.transform(places, lambda i: weight(F.substring(value, i + 1, F.lit(1)), i)), F.lit(0), lambda a, x: a + x)


def iban_length(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in fixed.IBAN_LENGTHS.items() for x in pair))
    return F.try_element_at(table, F.substring(code, 1, 2))


def iban(code: Column) -> Column:
    """ISO 13616: moved to the front, letters as two digits, remainder 1 modulo 97."""
    def remainder(moved: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            c = F.ascii(F.substring(moved, i, F.lit(1)))
            return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)

    return let(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4)), remainder) == 1


def vat(digits: Column) -> Column:
    """Eleven digits; those at even places count double, less nine above nine."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return (F.length(digits) == 11) & ((10 - _weighted(digits, 10, weight) % 10) % 10 == F.substring(digits, 11, 1).cast("int"))


def fiscal_code(value: Column) -> Column:
    """Check letter of an upper-case fiscal code; false for characters without a weight."""
    odd_digit, odd_letter = (F.array(*(F.lit(x) for x in xs)) for xs in (fixed.FISCAL_ODD_DIGITS, fixed.FISCAL_ODD_LETTERS))

    def weight(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        digit, letter = code.between(48, 57), code.between(65, 90)
        odd = F.when(digit, F.get(odd_digit, code - 48)).when(letter, F.get(odd_letter, code - 65))
        even = F.when(digit, code - 48).when(letter, code - 65)
        return F.when(i % 2 == 0, odd).otherwise(even)

    return F.coalesce(F.length(value) == 16, F.lit(False)) & F.coalesce(F.ascii(F.substring(value, 16, 1)) == 65 + _weighted(value, 15, weight) % 26, F.lit(False))


def contextual_code(value: Column) -> Column:
    c = compact(value)
    return F.length(c).between(5, 12) & c.rlike("[0-9]")


def sdi(value: Column) -> Column:
    return value.rlike("(?U)^[A-Za-z0-9]{6,7}$")


def health_card(value: Column) -> Column:
    return compact(value).rlike(r"^\d{20}$")


def pec_domain(mail: Column) -> Column:
    domain = F.lower(F.substring_index(mail, "@", -1))
    tail = domain.endswith(fixed.PEC_SUFFIXES[0]) | domain.endswith(fixed.PEC_SUFFIXES[1])
    return domain.isin(fixed.PEC_DOMAINS) | tail | F.array_contains(F.split(domain, r"\."), "pec")


def protocol(value: Column) -> Column:
    shown = F.upper(compact(value, r"\s"))
    c = F.regexp_replace(shown, "[./-]", "")
    date = shown.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$")
    return F.length(c).between(4, 24) & c.rlike("[0-9]") & ~date & ~c.rlike(r"^(?:19|20)\d{2}$")


def organization(value: Column) -> Column:
    """A legal form anywhere, a business keyword in front, or a university or department; a bare keyword is none."""
    academic = value.rlike(fixed.ACADEMIC.replace(r"(?U)\b", r"(?U)^", 1) + "$")
    marked = lambda plain: ~plain.isin(fixed.BARE_COMPANY_WORDS) & (academic | plain.rlike(fixed.FIRM_MARK) | plain.rlike(fixed.FIRM_START))
    return let(F.lower(F.regexp_replace(F.trim(value), r"(?U)\s+", " ")), marked)


def words(value: Column) -> Column:
    return F.filter(F.split(value, r"(?U)\s+"), lambda w: w != "")


def person(value: Column) -> Column:
    return let(words(value), lambda parts: (F.size(parts) >= 2) & ~F.exists(parts, lambda w: F.trim(w, F.lit(" .")).isin(fixed.PERSON_STOP))) & ~organization(value)


def surname_spreads(surname: Column) -> Column:
    return ~surname.isin(fixed.PERSON_STOP) & ~F.lower(F.regexp_replace(surname, "[.'’]", "")).isin(fixed.NOT_A_SURNAME)


def all_upper(value: Column) -> Column:
    return (value == F.upper(value)) & (value != F.lower(value))


def normal_token(word: Column) -> Column:
    """A word of a place name for comparison. Of the letters that place words have, case folding differs from lower case for one only."""
    return F.replace(F.lower(F.translate(word, "’‐‑–—", "'----")), F.lit("ß"), F.lit("ss"))


def normal_place(value: Column) -> Column:
    """Place name for comparison: words in lower case, joined by spaces. (Dictionaries get their compatibility forms unified when they are read.)"""
    unified = F.translate(value, "’‐‑–—", "'----")
    return normal_token(F.array_join(F.regexp_extract_all(unified, F.lit(fixed.PLACE_TOKEN), F.lit(0)), " "))


def is_first_name(word: Column, names: WordTable) -> Column:
    punctuation = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\r"
    return names.has(F.lower(F.trim(word, F.lit(punctuation))))
