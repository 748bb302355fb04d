"""Letters with planted values, derived from table keys, and where each value has to be found.

A letter is a list of segments, each an SQL expression over a key ``k``; a segment may name the entity that
must be reported for exactly its extent. Spark concatenates the segments into texts; the oracle adds up segment lengths. Check
digits are computed by the expressions themselves, not by the validators under test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import fixed


def digits(n: int, factor: int) -> str:
    return f"lpad(CAST((k * {factor}) % {10**n} AS STRING), {n}, '0')"


def digit(x: str, i: int) -> str:
    return f"CAST(substr({x}, {i + 1}, 1) AS INT)"


def doubled(d: str) -> str:
    return f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"


def vat(wrong: int = 0, factor: int = 7919) -> str:
    x = digits(10, factor)
    total = " + ".join(digit(x, i) if i % 2 == 0 else doubled(digit(x, i)) for i in range(10))
    return f"{x} || CAST((10 - ({total}) % 10 + {wrong}) % 10 AS STRING)"


def card(wrong: int = 0) -> str:
    x = f"'4' || {digits(14, 104729)}"
    total = " + ".join(doubled(digit(f"({x})", i)) if i % 2 == 0 else digit(f"({x})", i) for i in range(15))
    return f"{x} || CAST((10 - ({total}) % 10 + {wrong}) % 10 AS STRING)"


def iban(wrong: int = 0) -> str:
    body = digits(10, 7919)
    # X is 33; twelve zeros and ten digits of the account; IT is 1829; 00 for the check digits
    remainder = f"({33 * 10**12 % 97 * (10**16 % 97)} + CAST({body} || '182900' AS BIGINT)) % 97"
    return f"'IT' || lpad(CAST((98 - {remainder} + {wrong} - 1) % 97 + 1 AS STRING), 2, '0') || 'X000000000000' || {body}"


def fiscal(wrong: int = 0) -> str:
    letter = lambda f: f"chr(65 + CAST((k * {f}) % 26 AS INT))"
    d = lambda f, n: digits(n, f)
    x = "(" + " || ".join([letter(1), letter(3), letter(5), letter(7), letter(9), letter(11), d(3, 2), letter(17), d(7, 2), letter(19), d(11, 3)]) + ")"

    def code(i: int) -> str:
        c = f"ascii(substr({x}, {i + 1}, 1))"
        return f"(CASE WHEN {c} < 65 THEN {c} - 48 ELSE {c} - 65 END)"

    # digits and the first ten letters share their weights
    weights = "".join(f"{w:02d}" for w in fixed.FISCAL_ODD_LETTERS)
    odd = lambda i: f"CAST(substr('{weights}', 1 + 2 * {code(i)}, 2) AS INT)"
    total = " + ".join(odd(i) if i % 2 == 0 else code(i) for i in range(15))
    return f"{x} || chr(65 + CAST(({total} + {wrong}) % 26 AS INT))"


@dataclass
class Letter:
    rules: set[str]
    segments: list[tuple[str | None, str]]
    mode: str = "maximum"
    coreference: bool = False
    table: str = "customer"
    key: str = "c_custkey"

    def texts(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").select(F.col(self.key).alias("k"))
        return keys.select(F.col("k").alias("doc_id"), F.expr("concat(" + ", ".join(e for _, e in self.segments) + ")").alias("text"))

    def oracle(self) -> str:
        arms = []
        for i, (entity, expr) in enumerate(self.segments):
            if entity:
                before = " + ".join(f"length({e})" for _, e in self.segments[:i]) or "0"
                arms.append(f"SELECT k AS doc_id, '{entity}' AS entity_type, CAST({before} AS INT) AS start_at, CAST({before} + length({expr}) AS INT) AS end_at, {expr} AS value FROM keys")
        return f"WITH keys AS (SELECT {self.key} AS k FROM {self.table})\n" + "\nUNION ALL\n".join(arms)


K = "CAST(k AS STRING)"
N3 = "CAST(k % 899 + 100 AS STRING)"
N5 = "CAST(k % 89999 + 10000 AS STRING)"
WORDS_NAMES = ["mario", "anna", "luigi", "giulia"]
WORDS_REGIONS = ["toscana"]
WORDS_PLACES = ["toscana", "firenze", "san marino"]

LETTERS: dict[str, Letter] = {
    "vat_valid": Letter({"vat_numbers"}, [(None, "'Fattura del fornitore '"), ("PARTITA_IVA", vat()), (None, f"' e non ' || {vat(3)} || ', ma '"), ("PARTITA_IVA", f"'IT' || {vat(0, 6007)}"), (None, "' sì.'")]),
    "iban_valid": Letter({"ibans"}, [(None, "'🙂 Versare su '"), ("IBAN", iban()), (None, f"', non su ' || {iban(1)} || '; grazie'")]),
    "fiscal_code_valid": Letter({"fiscal_codes"}, [(None, "'Il codice è '"), ("CODICE_FISCALE", fiscal()), (None, f"' e non ' || {fiscal(1)} || ' né altro'")]),
    "fiscal_code_labelled": Letter({"labelled_fiscal_codes", "fiscal_codes"}, [(None, "'C.F.: '"), ("CODICE_FISCALE", fiscal(1)), (None, "' presente; altrove '"), (None, fiscal(2)), (None, "' senza nome.'")]),
    "fiscal_code_tabular": Letter({"tabular_fiscal_codes"}, [(None, f"'Nome;Codice fiscale;Nota' || chr(10) || 'Riga ' || {K} || ';'"), ("CODICE_FISCALE", fiscal(1)), (None, "';ok' || chr(10) || chr(10) || 'x;' || " + fiscal(2) + " || ';y'")]),
    "luhn_valid": Letter({"cards"}, [(None, "'Carta '"), ("CREDIT_CARD", card()), (None, f"' ma non ' || {card(4)} || '.'")]),
    "italian_phones": Letter({"phones"}, [(None, "'Chiamare '"), ("PHONE_NUMBER", f"'+39 347 ' || {N3} || ' ' || {digits(4, 31)}"), (None, "' oppure '"), ("PHONE_NUMBER", f"'055/' || {N3} || {digits(4, 17)}"), (None, "' entro sera; codice X' || " + digits(9, 13))]),
    "intl_phone_letters": Letter({"foreign_phones"}, [(None, "'Phone '"), ("PHONE_NUMBER", f"'+44 20 ' || {digits(4, 37)} || ' ' || {digits(4, 41)}"), (None, "' but +39 ' || " + N3 + " || ' no'")]),
    "pec_vs_email": Letter({"emails", "pec"}, [(None, "'PEC: '"), ("PEC_ADDRESS", f"'studio' || {K} || '@example.it'"), (None, "' e poi '"), ("EMAIL_ADDRESS", f"'utente.' || {K} || '@example.it'"), (None, "', infine '"), ("PEC_ADDRESS", f"'u' || {K} || '@ufficio.pec.example.it'"), (None, "' fine'")]),
    "labelled_codes": Letter({"sdi_codes", "health_cards", "identity_documents", "plates"}, [(None, "'Codice destinatario: '"), ("SDI_CODE", f"'AB' || {N5}"), (None, "'; tessera sanitaria '"), ("HEALTH_CARD", f"'80380' || {digits(15, 7)}"), (None, "'; passaporto n. '"), ("IDENTITY_DOCUMENT", f"'YA' || {digits(7, 3)}"), (None, "'; targa '"), ("VEHICLE_PLATE", f"'AB ' || {N3} || ' CD'"), (None, "'; sigla ZZ ' || " + N5)]),
    "protocol_codes": Letter({"protocols"}, [(None, "'Prot. n. '"), ("PROTOCOL_CASE_NUMBER", f"{N5} || '/2024'"), (None, "'; domanda 12/03/2024, istanza 2024; fascicolo '"), ("PROTOCOL_CASE_NUMBER", f"'AB ' || {N5}"), (None, "'; testo'")]),
    "cadastral_context": Letter({"cadastral"}, [(None, "'Dati: foglio '"), ("CATASTO", N3), (None, "', particella '"), ("CATASTO", N5), (None, "', sub '"), ("CATASTO", "'7'"), (None, "'. ' || repeat('parola ', 30) || 'foglio 9 del quaderno.'")]),
    "postal_codes": Letter({"labelled_postcodes", "postcode_cities"}, [(None, "'Città con CAP '"), ("POSTAL_CODE", N5), (None, "'; sede '"), ("ADDRESS", f"{N5} || ' Milano'"), (None, "'; repertorio n. ' || " + N5 + " || ' Raccolta; ' || " + N5 + " || ' Euro'")]),
    "addresses": Letter({"addresses", "lower_addresses"}, [(None, "'Abita in '"), ("ADDRESS", "'Via Garibaldi ' || CAST(k % 99 + 1 AS STRING)"), (None, "'; scrive via email per via preliminare; oppure in '"), ("ADDRESS", "'piazza della repubblica ' || CAST(k % 99 + 1 AS STRING)"), (None, "'; segue il corso di laurea.'")]),
    "organizations": Letter({"organizations"}, [(None, "'spett.le '"), ("ORGANIZATION", f"'Alfa' || {K} || ' Costruzioni S.r.l.'"), (None, "' e la '"), ("ORGANIZATION", "'Ditta Bianchi'"), (None, "'; poi '"), ("ORGANIZATION", "'Università degli Studi di Pavia'"), (None, "'; la società è attiva.'")]),
    "territorial_bodies": Letter({"territorial_bodies"}, [(None, "'sentito il '"), ("TERRITORIAL_BODY", "'Comune di Castel Nuovo'"), (None, "' e la '"), ("TERRITORIAL_BODY", "'Provincia di Lucca'"), (None, "', nel comune interesse ' || " + K)]),
    "persons_titled": Letter({"persons"}, [(None, "'presente '"), (None, "'sig. '"), ("PERSON", "'Mario Rossi'"), (None, "', con '"), ("PERSON", "'Carla Neri'"), (None, "' nata altrove; Premesso Che ' || " + K)]),
    "persons_dictionary": Letter({"dictionary_persons"}, [(None, f"'ieri ' || {K} || ' con '"), ("PERSON", "'Anna Verdi'"), (None, "' e in Via Mario Bianchi; invece '"), ("PERSON", "'Luigi Gallo'"), (None, "' parte; Sergio Fonte no.'")]),
    "surname_first": Letter({"surname_first"}, [(None, f"'elenco ' || {K} || ': '"), ("PERSON", "'ROSSI Mario'"), (None, "'; dipendente '"), ("PERSON", "'Bianchi Anna'"), (None, "'; testo con Fonte Luigi qui.'")]),
    "locations_dictionary": Letter({"dictionary_places"}, [(None, f"'lettera ' || {K} || ' scritta a '"), ("LOCATION", "'Firenze'"), (None, "' in '"), ("LOCATION", "'Toscana'"), (None, "'; la Firenze altrui e presso '"), ("LOCATION", "'San Marino'"), (None, "' fine'")]),
    "labelled_localities": Letter({"listed_places"}, [(None, f"'nota ' || {K} || ': Comuni vigilati: '"), ("LOCATION", "'Poggio'"), (None, "', '"), ("LOCATION", "'Rocca Alta'"), (None, "' e '"), ("LOCATION", "'Valle'"), (None, "'.'")]),
    "dates_found": Letter({"dates"}, [(None, "'dal '"), ("DATE", "lpad(CAST(k % 28 + 1 AS STRING), 2, '0') || '/03/2021'"), (None, "' al '"), ("DATE", "'2022-05-' || lpad(CAST(k % 28 + 1 AS STRING), 2, '0')"), (None, "' o '"), ("DATE", "CAST(k % 28 + 1 AS STRING) || ' marzo 2023'"), (None, "' non 45/2021.'")]),
    "coreference": Letter({"persons"}, [(None, f"'atto ' || {K} || ': sig. '"), ("PERSON", "'Mario Rossi'"), (None, "' firma. Poi '"), ("PERSON", "'Rossi'"), (None, "' paga e Rossini no; '"), ("PERSON", "'Mario Rossi'"), (None, "' esce.'")], coreference=True),
    "dedupe_overlaps": Letter({"emails", "pec", "addresses", "postcode_cities", "cards", "phones"}, [(None, "'sede '"), ("ADDRESS", f"'Via Roma ' || CAST(k % 99 + 1 AS STRING) || ', ' || {N5} || ' Lecco'"), (None, "', posta '"), ("PEC_ADDRESS", f"'a' || {K} || '@legalmail.it'"), (None, "' ok'")]),
}
