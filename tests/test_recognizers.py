"""Recognizers, resolution and rewriting on short texts of our own."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import checks, fixed
from veilspark.functions.spans import clean, spans
from veilspark.operators import engine, report, resolve, rewrite
from veilspark.operators.recognizers import Dictionaries

WORDS = Dictionaries(["mario", "anna", "luigi", "giulia"], ["toscana"], ["toscana", "firenze", "san marino", "potenza"])


def found(spark, text, mode="maximum", **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.entity_type, r.value) for r in engine.findings(df, mode, WORDS, **options).orderBy("start").collect()]


@pytest.mark.parametrize("pattern", [r"(?U)\w+", r"(?U)\b\d{2,}\b", fixed.EMAIL, fixed.PHONE, fixed.NAME_TOKEN, fixed.PLACE_TOKEN])
def test_offsets_equal_python(spark, pattern):
    texts = ["Città 🙂 perché 12 34, a.b@è.it già", "", "☎ +39 347 123 4567; Élan L’Aquila-Nord 055 1234567", "x" * 300 + " Mario Rossi"]
    own = re.compile(re.sub(r"\(\?i?U\)", "", pattern), re.IGNORECASE if "iU" in pattern else 0)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(s.start, s.end, s.value) for s in r[0]] for r in df.select(spans(clean(F.col("t")), pattern)).collect()]
    assert got == [[(m.start(), m.end(), m.group()) for m in own.finditer(t)] for t in texts]


def test_marks_in_text_do_not_disturb(spark):
    text = "a\u0001b\u0002 x@y.it"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = engine.findings(df, "maximum", WORDS, only={"emails"}).collect()
    assert (r.start, r.end, r.value) == (5, 11, "x@y.it")


def test_earliest_then_longest_wins(spark):
    f = lambda t, a, b, s: F.struct(F.lit(t).alias("entity_type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("score"), F.lit("x").alias("source"))
    out = spark.range(1).select(resolve.dedupe(F.array(f("DATE", 5, 9, 0.9), f("ADDRESS", 0, 6, 0.1), f("IBAN", 9, 12, 0.5), f("PEC_ADDRESS", 9, 12, 0.4), f("PERSON", 9, 11, 0.99)))).first()[0]
    assert [(x.entity_type, x.start) for x in out] == [("ADDRESS", 0), ("PEC_ADDRESS", 9)]


def test_iban_inside_a_failing_candidate(spark):
    assert found(spark, "AB12 CD34 IT60X0542811101000000123456 fine", only={"ibans"}) == [("IBAN", "IT60X0542811101000000123456")]


def test_checks(spark):
    row = spark.range(1).select(
        checks.vat(F.lit("12345678903")), checks.vat(F.lit("12345678904")), checks.fiscal_code(F.lit("RSSMRA80A01H501U")), checks.fiscal_code(F.lit("RSSMRA80A01H501X")),
        checks.iban(F.lit("GB82WEST12345698765432")), checks.protocol(F.lit("12/03/2024")), checks.protocol(F.lit("AB/2024")), checks.organization(F.lit("Società")), checks.organization(F.lit("Rossi S.p.A.")),
        checks.pec_domain(F.lit("a@b.pec.it")), checks.pec_domain(F.lit("a@pecore.it")),
    ).first()
    assert list(row) == [True, False, True, False, True, False, True, False, True, True, False]


def test_modes(spark):
    text = "Il sig. Mario Rossi il 3 marzo 2020"
    assert ("DATE", "3 marzo 2020") in found(spark, text) and "DATE" not in dict(found(spark, text, "standard"))
    with pytest.raises(ValueError):
        found(spark, text, "other")
    with pytest.raises(ValueError):
        engine.anonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), "reversible")


def test_standard_mode_keeps_initials(spark):
    cases = {"PERSON": ("Mario Rossi", "M. R."), "ADDRESS": ("Via Roma 45B", "V. R. 4."), "ORGANIZATION": ("Alfa Beta - S.r.l.", "A. B. S. r. l."), "TERRITORIAL_BODY": ("Comune di San Marino", "Comune di S. M."), "EMAIL_ADDRESS": ("a@b.it", "<EMAIL>"), "LOCATION": ("123", "<ANONIMIZZATO>")}
    for entity, (value, want) in cases.items():
        assert spark.range(1).select(rewrite.replacement(F.lit(value), F.lit(entity), "standard")).first()[0] == want
    df = spark.createDataFrame([(1, "firma sig. Mario Rossi. poi altro")], "doc_id long, text string")
    r = engine.anonymize(df, "standard", WORDS, only={"persons"}).first()
    assert r.anonymized == "firma sig. M. R. poi altro" and [tuple(x) for x in r.preview] == [(11, 16)]


def test_restore_is_sequential(spark):
    entries = F.array(*(F.struct(F.lit(p).alias("placeholder"), F.lit("X").alias("entity_type"), F.lit(v).alias("value")) for p, v in (("<PERSONA_1>", "Anna"), ("<PERSONA_10>", "<PERSONA_1>"))))
    assert spark.range(1).select(rewrite.restored(F.lit("<PERSONA_10> e <PERSONA_1>"), entries)).first()[0] == "Anna e Anna"


def test_known_values_keep_their_placeholder(spark):
    df = spark.createDataFrame([(1, "scrivi a a@b.it e c@d.it")], "doc_id long, text string")
    known = spark.createDataFrame([(1, "EMAIL_ADDRESS", "c@d.it", "<EMAIL_7>")], "doc_id long, entity_type string, value string, placeholder string")
    out, mapping = engine.pseudonymize(df, WORDS, known, only={"emails"})
    assert out.first().anonymized == "scrivi a <EMAIL_8> e <EMAIL_7>" and mapping.count() == 2
    both = spark.createDataFrame([(1, "x@y.it"), (2, "z@y.it x@y.it")], "doc_id long, text string")
    corpus = {r.value: r.placeholder for r in engine.pseudonymize(both, WORDS, scope="corpus", only={"emails"})[1].collect()}
    assert corpus == {"x@y.it": "<EMAIL_1>", "z@y.it": "<EMAIL_2>"}


def test_case_folded_literals():
    assert resolve.literal_spans("Straße STRASSE", "strasse") == [(0, 6), (7, 14)]
    assert resolve.literal_spans("ß", "s") == [] and resolve.literal_spans("x", "") == []


def test_expected_statuses(spark):
    df = spark.createDataFrame([("a@b.it poi A@B.IT", "a@b.it", "EMAIL_ADDRESS")], "text string, value string, t string")
    f = lambda a, b, t="EMAIL_ADDRESS": F.struct(F.lit(t).alias("entity_type"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    status = lambda *fs: df.select(report.expected_status(F.col("text"), F.array(*fs), F.col("value"), F.col("t"))).first()[0]
    assert status(f(0, 6), f(11, 17)) == "detected" and status(f(0, 6)) == "leaked" and status(f(0, 17, "DATE")) == "wrong_type_or_span"
    assert df.select(report.expected_status(F.lit("zzz"), F.array(f(0, 1)), F.col("value"), F.col("t"))).first()[0] == "not_extracted"


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    out = engine.anonymize(df, "maximum", WORDS, only={"emails", "persons"}).orderBy("doc_id").collect()
    assert [r.findings for r in out] == [[], []] and [r.anonymized for r in out] == [None, ""]


def test_injected_findings_and_model_filters(spark):
    df = spark.createDataFrame([(1, "vive a Potenza di notte; sede Roma Nord")], "doc_id long, text string")
    at = lambda a, b: F.struct(F.lit("LOCATION").alias("entity_type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(0.78).alias("score"), F.lit("ner_local").alias("source"))
    out = engine.detect(df.withColumn("more", F.array(at(30, 39))), "maximum", WORDS, extra="more", only={"emails"})
    assert [x.source for x in out.first().findings] == ["ner_local"]
    from veilspark.operators.recognizers import accept_model_person, accept_model_place

    row = df.select(accept_model_place(F.col("text"), F.lit(7), F.lit(14), WORDS), accept_model_place(F.col("text"), F.lit(30), F.lit(39), WORDS), accept_model_person(F.lit("Mario Rossi")), accept_model_person(F.lit("via Rossi"))).first()
    assert list(row) == [True, True, True, False]


def test_detector_runs_once_in_long_form(spark):
    df = spark.createDataFrame([(1, "a@b.it")], "doc_id long, text string")
    plan = engine.findings(df, "maximum", WORDS, only={"emails"}, coreference=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(fixed.MAIL[:20]) == 1


def test_no_cap_on_places(spark):
    long = "san pietro in valle di sopra e di sotto"
    words = Dictionaries([], [], [long, "san pietro", "san"])
    text = f"abita a {long.title()} e a San {' ' * 1200} Pietro, poi a San Giorgio; \n San Pietro in Valle;"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.entity_type, r.value) for r in engine.findings(df, "maximum", words, only={"dictionary_places"}).orderBy("start").collect()]
    assert got == [("LOCATION", long.title()), ("LOCATION", f"San {' ' * 1200} Pietro"), ("LOCATION", "San")]


def test_no_cap_on_names_and_ibans(spark):
    name = f"Mario{' ' * 1100}Rossi"
    iban = "IT 60 " + " ".join("X0542811101000000123456").replace("0 5 4", "0" + "\n" * 400 + "5 4")
    assert found(spark, f"con {name} e {iban}.", only={"dictionary_persons", "ibans"}, coreference=False) == [("PERSON", name), ("IBAN", iban)]
    assert found(spark, f"con Mario{' ' * 985}Rossi Bianchi", only={"dictionary_persons"}, coreference=False) == [("PERSON", f"Mario{' ' * 985}Rossi Bianchi")]


def test_dictionaries_are_bounded():
    with pytest.raises(ValueError):
        Dictionaries([str(i) for i in range(200_001)])


def test_literals_in_any_case():
    spans_of = resolve.literal_spans
    assert spans_of("Straße e STRASSE", "strasse") == [(0, 6), (9, 16)]
    assert spans_of("aaaa", "AA") == [(0, 2), (1, 3), (2, 4)]
    assert spans_of("ß", "s") == [] and spans_of("", "a") == [] and spans_of("a", "") == []
    assert spans_of("xﬁy FI", "fi") == [(1, 2), (4, 6)]


def test_display_and_state(spark):
    df = spark.createDataFrame([(1, "scrivi a a@b.it e c@d.it", [True, False])], "doc_id long, text string, included array<boolean>")
    detected = engine.detect(df, "maximum", WORDS, only={"emails"}, coreference=False)
    shown = report.serialized(engine.explode(detected)).orderBy("start").first()
    assert (shown.label, shown.source_label, shown.preview, shown.score) == ("email", "Regole italiane locali", "a@b.it", 0.98)
    (p,) = report.provenance(detected, "reversible", ".txt", 2).collect()
    assert (p.total_findings, p.included_findings, p.excluded_findings, p.map_required, p.revision, p.kind) == (2, 1, 1, True, 2, "anonymized")
    other = report.fingerprints(detected.withColumn("included", F.array(F.lit(True)))).first()
    assert other.text_sha256 == p.text_sha256 and other.selection_sha256 != p.selection_sha256
    assert other.selection_sha256 == report.fingerprints(detected.drop("included")).first().selection_sha256
    (form,) = report.review_form(engine.explode(detected), grouped_above=1, search_from=3).collect()
    assert (form.n, form.grouped, form.searchable) == (2, True, False)
