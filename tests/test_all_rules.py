"""The whole detector against a plain-Python run of the same grammars, over whole documents and over letters."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.operators import engine
from veilspark.plans import catalog
from veilspark.plans.letters import LETTERS

SF = "/root/testdata/sf0.001"


def python_pattern(pattern):
    """The grammar in Python's dialect: classes are Unicode there from the start."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    return re.compile(re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern), re.IGNORECASE if flags and "i" in flags[1] else 0)


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def vat(digits):
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[:10]))
    return (10 - total % 10) % 10 == int(digits[10])


def fiscal(code):
    weight = lambda i, c: (fixed.FISCAL_ODD_DIGITS[int(c)] if c.isdigit() else fixed.FISCAL_ODD_LETTERS[ord(c) - 65]) if i % 2 == 0 else (int(c) if c.isdigit() else ord(c) - 65)
    return sum(weight(i, c) for i, c in enumerate(code.upper()[:15])) % 26 == ord(code.upper()[15]) - 65


def pec(mail):
    domain = mail.rsplit("@", 1)[1].lower()
    return domain in fixed.PEC_DOMAINS or domain.endswith(fixed.PEC_SUFFIXES) or "pec" in domain.split(".")


def compact(v):
    return re.sub(r"[\s.-]", "", v)


#: rule: entity, grammar, value group, score, trailing signs cut off, test of the value
PLAIN = {
    "emails": ("EMAIL_ADDRESS", fixed.EMAIL, 0, 0.98, " ,;:.", None),
    "pec": ("PEC_ADDRESS", fixed.EMAIL, 0, 0.97, "", pec),
    "phones": ("PHONE_NUMBER", fixed.PHONE, 0, 0.94, " ,;:.", None),
    "foreign_phones": ("PHONE_NUMBER", fixed.FOREIGN_PHONE, 0, 0.92, "", lambda v: 8 <= sum(c.isdecimal() for c in v) <= 15),
    "fiscal_codes": ("CODICE_FISCALE", fixed.FISCAL, 0, 0.96, "", fiscal),
    "vat_numbers": ("PARTITA_IVA", fixed.VAT, 0, 0.96, "", lambda v: vat(v[-11:])),
    "sdi_codes": ("SDI_CODE", fixed.SDI, 1, 0.9, "", None),
    "health_cards": ("HEALTH_CARD", fixed.HEALTH_CARD, 1, 0.9, "", lambda v: len(compact(v)) == 20),
    "identity_documents": ("IDENTITY_DOCUMENT", fixed.IDENTITY, 1, 0.92, "", lambda v: 5 <= len(compact(v)) <= 12),
    "plates": ("VEHICLE_PLATE", fixed.PLATE, 1, 0.91, "", lambda v: 5 <= len(compact(v)) <= 12),
    "cards": ("CREDIT_CARD", fixed.CARD, 0, 0.95, "", lambda v: luhn(re.sub("[ -]", "", v)) and 13 <= len(re.sub("[ -]", "", v)) <= 19),
    "labelled_postcodes": ("POSTAL_CODE", fixed.POSTCODE_LABELLED, 1, 0.94, "", None),
    "territorial_bodies": ("TERRITORIAL_BODY", fixed.BODY, 0, 0.88, " ,;:.", None),
    "dates": ("DATE", fixed.DATE, 0, 0.82, " ,;:.", None),
}
PRIORITY = {e[0]: e[5] for e in fixed.ENTITIES}


def plain_findings(text):
    found = []
    for at, (entity, grammar, group, score, cut, test) in enumerate(PLAIN.values()):
        for m in python_pattern(grammar).finditer(text):
            value = m[group].rstrip(cut)
            if value and (test is None or test(value)):
                found.append((m.start(group), -len(value), -PRIORITY[entity], -score, at, entity, value))
        if entity == "PEC_ADDRESS":
            found += [(m.start(1), -len(m[1]), -PRIORITY[entity], -0.98, at, entity, m[1]) for m in python_pattern(fixed.PEC_LABELLED).finditer(text)]
    out, end = [], 0
    for start, length, *_, entity, value in sorted(found):
        if start >= end:
            out.append((entity, start, value))
            end = start - length
    return out


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = F.array(*(F.expr("concat(" + ", ".join(e for _, e in letter.segments) + ")") for letter in LETTERS.values()))
    letters = spark.range(1, 4).withColumnRenamed("id", "k").select("k", F.posexplode(texts).alias("i", "text"))
    # written once: rules over a union would be planned for each of its parts
    path = str(tmp_path_factory.mktemp("rules") / "documents")
    docs.unionByName(letters.select((F.col("k") + 1_000_000 * (F.col("i") + 1)).alias("doc_id"), "text")).coalesce(4).write.parquet(path)
    return spark.read.parquet(path)


def test_grammars_against_plain_python(documents):
    got = collections.defaultdict(list)
    for r in engine.findings(documents, "maximum", only=set(PLAIN), coreference=False).collect():
        got[r.doc_id].append((r.entity_type, r.start, r.value))
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(got) > 40
    for d, text in texts.items():
        assert sorted(got[d], key=lambda x: x[1]) == plain_findings(text or ""), d


def test_all_rules_are_the_union_of_single_ones(documents):
    """All rules at once give what a plain merge of each rule's own findings gives."""
    words = catalog.WORDS
    each = collections.defaultdict(list)
    for row in engine.candidates(documents, "maximum", words).select("doc_id", *(F.col(f"_vs_rule_{rule}") for rule, _ in engine.RULES)).collect():
        for at, found in enumerate(row[1:]):
            each[row.doc_id] += [(f.start, f.start - f.end, -PRIORITY[f.entity_type], -f.score, at, f.entity_type, f.end) for f in found or []]
    got = collections.defaultdict(list)
    for r in engine.findings(documents, "maximum", words, coreference=False).collect():
        got[r.doc_id].append((r.entity_type, r.start, r.end))
    for d in {r.doc_id for r in documents.select("doc_id").collect()}:
        want, last = [], 0
        for start, _, _, _, _, entity, end in sorted(each[d]):
            if start >= last:
                want.append((entity, start, end))
                last = end
        assert sorted(got[d], key=lambda x: x[1]) == want


def test_masked_documents_hold_no_found_value(documents):
    detected = engine.detect(documents, "maximum", catalog.WORDS)
    masked = {r.doc_id: r.anonymized for r in engine.anonymize(documents, "maximum", catalog.WORDS).collect()}
    for r in detected.collect():
        pieces, at = [], 0
        for f in r.findings:
            pieces += [r.text[at : f.start], "<" + {e[0]: e[1] for e in fixed.ENTITIES}[f.entity_type] + ">"]
            at = f.end
        assert masked[r.doc_id] == (None if r.text is None else "".join([*pieces, r.text[at:]]))


def test_counts_of_all_rules(spark):
    q = catalog.queries()
    total = sum(r.n for r in q["all_rules_by_type"](spark, SF).collect())
    by_category = {r.category: r.n for r in q["all_rules_by_category"](spark, SF).collect()}
    assert by_category.pop("Tutti") == total == sum(by_category.values()) == sum(r.total for r in q["all_rules_reports"](spark, SF).collect())
