"""Dictionaries of real size: look-ups in the plan and by join against a plain trie; gates; texts with very many findings."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions.clues import WordTable, first_words
from veilspark.functions.spans import apart, cut, wide
from veilspark.operators import dictionary_join, engine, rewrite
from veilspark.operators.recognizers import Dictionaries


def word(rng):
    return "".join(rng.choice("abcdeilmnoprstuvzàèù") for _ in range(rng.randint(3, 7)))


@pytest.fixture(scope="module")
def gazetteer():
    rng = random.Random(2)
    stems = [word(rng) for _ in range(3000)]
    places = {" ".join(rng.choice(stems) for _ in range(rng.choice([1, 1, 1, 2, 2, 3]))) for _ in range(8000)}
    return sorted(places), sorted({word(rng) for _ in range(9000)})


@pytest.fixture(scope="module")
def letters(spark, gazetteer):
    rng = random.Random(3)
    places, _ = gazetteer
    parts = [w for p in places[:400] for w in p.split()]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 40)):
            name = rng.choice(places) if rng.random() < 0.5 else " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
            text += rng.choice(["vive a ", "con ", "a ", ", ", "; "]) + name.title().replace(" ", rng.choice([" ", "\t", "  ", " "])) + rng.choice([" ", ", ", ". "])
        rows.append((i if i % 7 else None, text))
    return spark.createDataFrame([*rows, rows[3], (70, None), (71, "")], "doc_id long, text string")


def plain_places(text, places):
    """Longest match by a trie over words, words used up from left to right; then only what stands behind "a" counts."""
    import re

    tokens = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’/-][A-Za-zÀ-ÖØ-öø-ÿ]+)*", text)]
    trie = {}
    for p in places:
        node = trie
        for w in p.split():
            node = node.setdefault(w, {})
        node[""] = {}
    out, i = [], 0
    while i < len(tokens):
        node, best, j = trie, None, i
        while j < len(tokens) and tokens[j][2] in node and (j == i or not text[tokens[j - 1][1] : tokens[j][0]].strip()):
            node = node[tokens[j][2]]
            j += 1
            if "" in node:
                best = j
        if best is None:
            i += 1
            continue
        out.append((tokens[i][0], tokens[best - 1][1]))
        i = best
    return [s for s in out if re.search(r"\b(?:a|ad|in|da|dal|dalla|dai|dalle|presso|verso)\s+$", text[max(0, s[0] - 100) : s[0]], re.I)]


def test_places_equal_a_plain_trie_and_plan_fast(spark, gazetteer, letters):
    places, names = gazetteer
    began = time.time()
    found = engine.detect(letters, "maximum", Dictionaries(names, [], places), only={"dictionary_places"}, coreference=False)
    found._jdf.queryExecution().executedPlan()
    assert time.time() - began < 30
    n = 0
    for r in found.collect():
        want = plain_places(r.text or "", set(places))
        # alone in its field: another way to count
        got = [(f.start, f.end) for f in r.findings]
        assert set(want) <= set(got)
        for s in set(got) - set(want):
            assert (r.text[: s[0]].rstrip(" .:")[-1:] or ",") in ",;\t" and (r.text[s[1] :].lstrip(" .:")[:1] or ",") in ",;\t", (r.text, s)
        n += len(want)
    assert n > 100


def test_places_by_join_equal_places_in_the_plan(spark, gazetteer, letters):
    places, _ = gazetteer
    regions = places[::50]
    table = spark.createDataFrame([(p, p in set(regions)) for p in places], "name string, region boolean").repartition(3)
    joined = engine.detect(dictionary_join.place_findings(letters, table), "maximum", extra="places_found", only={"emails"}, coreference=False)
    inside = engine.detect(letters, "maximum", Dictionaries([], regions, places), only={"dictionary_places"}, coreference=False)
    rows = lambda df: sorted(((r.doc_id, r.text, tuple(map(tuple, r.findings))) for r in df.select("doc_id", "text", "findings").collect()), key=str)
    assert rows(joined) == rows(inside)
    none = dictionary_join.place_findings(letters, table.limit(0)).collect()
    assert len(none) == letters.count() and all(r.places_found == [] for r in none)


def test_word_tables(spark):
    rng = random.Random(5)
    words = {word(rng) for _ in range(5000)} | {"l'aquila", "san pietro in valle"}
    table = WordTable([*words, "bad\tword", ""])
    asked = sorted(words)[::7] + [w + "x" for w in sorted(words)[::7]] + ["", "bad\tword", "san pietro"]
    got = spark.createDataFrame([(w,) for w in asked], "w string").select("w", table.has(F.col("w")).alias("h")).collect()
    assert {r.w for r in got if r.h} == {w for w in asked if w in words}
    assert spark.range(1).select(WordTable([]).has(F.lit("x"))).first()[0] is False
    assert first_words(["Forlì-Cesena", "èvoli", "straße"]) == {"forl", "voli", "strasse"} and first_words(["ò"]) is None


def test_gates_let_odd_letters_through(spark):
    cases = {
        "territorial_bodies": "la amministrazione regionale Lazio decide", "cadastral": "catasto: ſub. 12 e foglio 3", "addresses": "abita in vİa Roma 3", "organizations": "la ragione sociale Alfa Beta",
        "sdi_codes": "codsdi: ABC1234", "identity_documents": "CIAX12345", "health_cards": "ts-cns 12345678901234567890",
    }
    for rule, text in cases.items():
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert engine.detect(df, "maximum", only={rule}, coreference=False).first().findings, rule


def test_small_inputs_are_dealt_out(spark):
    one = spark.range(100).coalesce(1).selectExpr("id as doc_id", "'a@b.it' as text")
    assert engine.spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pieces_of_long_texts(spark):
    text = "﻿a🙂é" * 400
    df = spark.createDataFrame([(text,)], "t string")
    codes = wide(F.col("t"), F.lit(1000))
    pieces = df.select(F.transform(F.sequence(F.lit(0), F.lit(1590)), lambda i: cut(F.col("t"), codes, i, i + 7)).alias("p")).first().p
    assert pieces == [text[i : i + 7] for i in range(1591)]


def test_spans_apart(spark):
    rng = random.Random(6)
    spans = sorted((a, a + rng.randint(1, 6)) for a in (rng.randint(0, 3000) for _ in range(1500)))
    df = spark.createDataFrame([([{"start": a, "end": b} for a, b in spans],)], "s array<struct<start:int,end:int>>")
    want, last = [], 0
    for a, b in spans:
        if a >= last:
            want.append((a, b))
            last = b
    assert [tuple(x) for x in df.select(apart(F.col("s"), "array<struct<start:int,end:int>>")).first()[0]] == want


def test_very_many_findings_take_linear_time(spark):
    """Twice the matches take about twice the time, in detecting, masking and numbering."""
    def took(n):
        text = " ".join(f"u{i % (n // 2)}@é.it" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        masked = engine.anonymize(df, "maximum", only={"emails"}, coreference=False).select(F.length("anonymized"), F.size("preview")).first()
        assert tuple(masked) == (8 * n - 1, n)
        out, mapping = engine.pseudonymize(df, only={"emails"}, coreference=False)
        assert mapping.count() == n // 2 and out.first().anonymized.startswith("<EMAIL_1> <EMAIL_2> ")
        return time.time() - began

    took(2000)
    small, large = took(25_000), took(50_000)
    assert large < 4 * small + 5, (small, large)


def test_rewritten_pieces_and_places(spark):
    df = spark.createDataFrame([("abcdefghij", [("X", 1, 3), ("Y", 2, 5), ("Z", 5, 6), ("X", 9, 10)])], "t string, f array<struct<entity_type:string,start:int,end:int>>")
    r = df.select(rewrite._rewritten(F.col("t"), F.col("f"), lambda f, v: F.concat(F.lit("<"), f["entity_type"], v, F.lit(">")), False).alias("r")).first().r
    assert r.text == "a<Xbc>de<Zf>ghi<Xj>" and [tuple(x) for x in r.spans] == [(1, 6), (8, 12), (15, 19)]


@pytest.mark.parametrize("groups", [(), (1,), (1, 2)])
def test_spans_of_a_name_and_of_an_expression(spark, groups):
    rng = random.Random(7)
    texts = ["", "a b " * 400, "'", "\\", "x", *("".join(rng.choice("ab'\\ \n🙂1é") for _ in range(rng.randint(1, 900))) for _ in range(40))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from veilspark.functions.spans import spans

    pattern = r"(?U)([a'\\])(\w*)"
    both = df.select(spans("t", pattern, groups).alias("n"), spans(F.col("t"), pattern, groups).alias("e"))
    assert all(r.n == r.e for r in both.collect()) and both.where("size(n) > 256").count() > 0
