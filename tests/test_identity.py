"""Row identity in reversible work: null and repeated ids, equal rows, and the text as it was."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.identity import ROW_KEY
from veilspark.operators import engine, resolve
from veilspark.operators.recognizers import Dictionaries

WORDS = Dictionaries([], [], [])
ROWS = [
    (None, "Scrivi a mario@x.it oggi"), (None, "Scrivi a lucia@y.it oggi"), (None, "Scrivi a lucia@y.it oggi"), (1, "Scrivi a anna@x.it oggi"), (1, "Un altro, paolo@z.it, assai più lungo: anna@x.it"),
    (1, "Scrivi a anna@x.it oggi"), (2, None), (3, ""), (None, None), (4, "niente"), (5, "già <EMAIL_4> e b@b.it, a@a.it, b@b.it; <EMAIL_7x> 🙂 c@c.it"),
]
OPTIONS = {"only": {"emails"}, "coreference": False}


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def values(rows):
    return {m for _, t in rows for m in re.findall(r"[\w.]+@[\w.]+\w", t or "")}


@pytest.mark.parametrize("scope", ["document", "corpus"])
def test_no_value_in_clear_and_round_trip(spark, scope):
    docs = frame(spark)
    out, mapping = engine.pseudonymize(docs, WORDS, scope=scope, **OPTIONS)
    got = out.collect()
    assert len(got) == len(ROWS)
    assert not any(v in (r.anonymized or "") for r in got for v in values(ROWS))
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(ROWS, key=str)
    back = engine.restore(out, mapping).collect()
    assert len(back) == len(ROWS) and all(r.restored == r.text for r in back)


def test_numbers_of_a_row(spark):
    out, mapping = engine.pseudonymize(frame(spark), WORDS, **OPTIONS)
    by_text = {r.text: r for r in out.collect()}
    assert by_text[ROWS[0][1]].anonymized == "Scrivi a <EMAIL_1> oggi"
    assert by_text[ROWS[4][1]].anonymized == "Un altro, <EMAIL_1>, assai più lungo: <EMAIL_2>"
    assert by_text[ROWS[10][1]].anonymized == "già <EMAIL_4> e <EMAIL_5>, <EMAIL_6>, <EMAIL_5>; <EMAIL_7x> 🙂 <EMAIL_7>"
    entries = mapping.collect()
    # rows that agree in id and text share a key and its entries
    assert len(entries) == len(set(entries)) == 1 + 1 + 1 + 2 + 3
    assert {r[ROW_KEY] for r in entries if r.value == "paolo@z.it"} == {by_text[ROWS[4][1]][ROW_KEY]}


def test_corpus_numbers_equal_one_window(spark):
    rows = [(i % 50 if i % 7 else None, " ".join(f"u{(i * k) % 90}@x.it" for k in range(1, 6))) for i in range(300)] + [(0, "già <EMAIL_30>")]
    docs = frame(spark, rows)
    _, mapping = engine.pseudonymize(docs, WORDS, scope="corpus", **OPTIONS)
    first = {}
    for i, t in rows:
        for m in re.finditer(r"\S+@\S+", t):
            place = (i is None, i or 0, m.start(), m[0])
            first[m[0]] = min(first.get(m[0], place), place)
    want = {v: f"<EMAIL_{31 + k}>" for k, v in enumerate(sorted(first, key=lambda v: first[v]))}
    assert {r.value: r.placeholder for r in mapping.collect()} == want


def test_known_entries_of_rows_and_corpus(spark):
    schema = "doc_id long, entity_type string, value string, placeholder string"
    known = spark.createDataFrame([(None, "EMAIL_ADDRESS", "mario@x.it", "<EMAIL_9>"), (1, "EMAIL_ADDRESS", "anna@x.it", "<EMAIL_3>")], schema)
    out, mapping = engine.pseudonymize(frame(spark), WORDS, known, **OPTIONS)
    got = {r.text: r.anonymized for r in out.collect()}
    assert got[ROWS[0][1]] == "Scrivi a <EMAIL_9> oggi" and got[ROWS[1][1]] == "Scrivi a <EMAIL_10> oggi"
    assert got[ROWS[4][1]] == "Un altro, <EMAIL_4>, assai più lungo: <EMAIL_3>"
    assert all(r.restored == r.text for r in engine.restore(out, mapping).collect())
    _, whole = engine.pseudonymize(frame(spark), WORDS, known.drop("doc_id"), "corpus", **OPTIONS)
    numbers = {r.value: r.placeholder for r in whole.collect()}
    assert numbers["mario@x.it"] == "<EMAIL_9>" and numbers["anna@x.it"] == "<EMAIL_3>" and numbers["paolo@z.it"] == "<EMAIL_10>"


def test_restore_by_id_alone_never_mixes_rows(spark):
    out, mapping = engine.pseudonymize(frame(spark), WORDS, **OPTIONS)
    back = {r.text: r for r in engine.restore(out.drop(ROW_KEY), mapping).collect()}
    assert back[ROWS[10][1]].restored == ROWS[10][1]
    # <EMAIL_1> means two values under id 1 and under no id: it stays
    assert back[ROWS[0][1]].restored == "Scrivi a <EMAIL_1> oggi" and back[ROWS[0][1]].status.unknown == ["<EMAIL_1>"] and not back[ROWS[0][1]].status.restorable
    assert back[ROWS[4][1]].restored == "Un altro, <EMAIL_1>, assai più lungo: anna@x.it"


def test_manual_values_of_null_ids(spark):
    found = engine.detect(frame(spark), "maximum", WORDS, **OPTIONS)
    wanted = spark.createDataFrame([(None, "PERSON", "SCRIVI"), (1, "PERSON", "altro"), (9, "PERSON", "niente")], "doc_id long, entity_type string, value string")
    got = {(r.doc_id, r.text): [(f.entity_type, f.start) for f in r.findings] for r in resolve.add_manual(found, wanted).collect()}
    assert got[ROWS[0]] == [("PERSON", 0), ("EMAIL_ADDRESS", 9)] and got[ROWS[3]] == [("EMAIL_ADDRESS", 9)] and got[ROWS[4]][0] == ("PERSON", 3) and got[ROWS[9]] == []


def test_choices_of_null_ids_and_rows(spark):
    long = engine.findings(frame(spark), "maximum", WORDS, **OPTIONS).withColumn("included", F.col("value") != "lucia@y.it")
    pairs = resolve.excluded_pairs(long)
    assert [tuple(r) for r in pairs.collect()] == [(None, "EMAIL_ADDRESS", "lucia@y.it")]
    left = resolve.exclude(long, pairs)
    assert left.count() == long.count() - 2 and left.where("value = 'lucia@y.it'").isEmpty()
    assert resolve.same_value(long, long.where("value = 'lucia@y.it'").limit(1)).count() == 2
    assert resolve.exclude(long, pairs.drop("doc_id")).where("value = 'lucia@y.it'").isEmpty()
    spans = long.where("value = 'lucia@y.it'").select("doc_id", "start", "end").limit(1)
    assert resolve.replace_manually(long, spans).where("doc_id is null").count() == 0


def test_clashing_columns(spark):
    docs = frame(spark).withColumns({"findings": F.lit("mine"), "anonymized": F.lit("mine"), "_clean": F.lit("mine"), "_emails": F.lit(1), "_r": F.lit(2), "a`b": F.lit(3)})
    out = engine.detect(docs, "maximum", WORDS, **OPTIONS)
    assert out.columns == ["doc_id", "text", "anonymized", "_clean", "_emails", "_r", "a`b", "findings"] and {r._clean for r in out.collect()} == {"mine"}
    masked = engine.anonymize(docs, "maximum", WORDS, **OPTIONS)
    assert masked.columns[-3:] == ["findings", "anonymized", "preview"] and len(set(masked.columns)) == len(masked.columns)
    named, _ = engine.pseudonymize(docs, WORDS, **OPTIONS)
    assert named.columns.count("anonymized") == 1 and {r._r for r in named.collect()} == {2}
    with pytest.raises(ValueError):
        engine.detect(docs.withColumn("_vs_clean", F.lit(1)), "maximum", WORDS)
