"""All registered queries over the reference operators and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.operators import engine, evaluation, report, resolve, rewrite
from veilspark.operators.recognizers import Dictionaries
from veilspark.plans.letters import LETTERS, WORDS_NAMES, WORDS_PLACES, WORDS_REGIONS, Letter
from veilspark.functions.written import shared_folder
from veilspark.sources import activity_log, documents
from veilspark.streaming import log_sink

WORDS = Dictionaries(WORDS_NAMES, WORDS_REGIONS, WORDS_PLACES)
#: Rules whose values occur in the documents table, and which SQL can follow there: for the oracle's sake, beside the queries with all rules.
NATURAL = {"emails", "foreign_phones", "cards"}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _placed(long: DataFrame) -> DataFrame:
    return long.select("doc_id", "entity_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "value")


def _letter(letter: Letter) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _placed(engine.findings(letter.texts(spark, sf_dir), letter.mode, WORDS, only=letter.rules, coreference=letter.coreference))

    return query


def _natural(spark: SparkSession, sf_dir: str, rules: set[str], *keep: str) -> DataFrame:
    return engine.findings(_documents(spark, sf_dir), "maximum", WORDS, keep=keep, only=rules, coreference=False)


def email_findings(spark, sf_dir):
    return _placed(_natural(spark, sf_dir, {"emails"}))


def card_findings(spark, sf_dir):
    return _placed(_natural(spark, sf_dir, {"cards"}))


def intl_phone_findings(spark, sf_dir):
    return _placed(_natural(spark, sf_dir, {"foreign_phones"}))


def findings_by_type(spark, sf_dir):
    """Findings of the rules that SQL can follow on these documents, per language and type."""
    return report.counts(_natural(spark, sf_dir, NATURAL, "lang"), "lang")


def findings_by_category(spark, sf_dir):
    return report.by_category(_natural(spark, sf_dir, NATURAL))


def mask_maximum(spark, sf_dir):
    out = engine.anonymize(_documents(spark, sf_dir).select("doc_id", "text"), "maximum", WORDS, only=NATURAL, coreference=False)
    return out.select("doc_id", "anonymized")


def detect_all_rules(spark, sf_dir):
    """Every rule with coreference over whole documents; no SQL equivalent."""
    return engine.detect(_documents(spark, sf_dir).select("doc_id", "text"), "maximum", WORDS).select("doc_id", F.size("findings").alias("n_findings"), report.summary(F.col("findings")).alias("summary"))


def _every_rule(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return engine.detect(_documents(spark, sf_dir).select("doc_id", *keep, "text"), "maximum", WORDS)


def all_rules_by_type(spark, sf_dir):
    """Flagship: findings per language and type over all documents, by every rule, with coreference."""
    return report.counts(engine.explode(_every_rule(spark, sf_dir, "lang"), "lang"), "lang")


def all_rules_by_category(spark, sf_dir):
    return report.by_category(engine.explode(_every_rule(spark, sf_dir)))


def all_rules_masked(spark, sf_dir):
    return engine.anonymize(_documents(spark, sf_dir).select("doc_id", "text"), "maximum", WORDS).select("doc_id", "anonymized")


def all_rules_standard(spark, sf_dir):
    return engine.anonymize(_documents(spark, sf_dir).select("doc_id", "text"), "standard", WORDS).select("doc_id", "anonymized")


def all_rules_reports(spark, sf_dir):
    return report.report(_every_rule(spark, sf_dir), "maximum").select("doc_id", "total", "summary")


def reports(spark, sf_dir):
    out = engine.detect(_documents(spark, sf_dir).select("doc_id", "text"), "maximum", WORDS, only=NATURAL, coreference=False)
    return report.report(out, "maximum").select("doc_id", "total", "summary")


def reliability_levels(spark, sf_dir):
    return _natural(spark, sf_dir, NATURAL).groupBy(report.reliability(F.col("score")).alias("reliability"), report.checksum(F.col("entity_type")).alias("checked")).agg(F.count("*").alias("n"))


def initials(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    return names.select("id", rewrite.initials(F.col("value")).alias("initials"))


MAILS = Letter({"emails"}, [(None, "'Da '"), ("EMAIL_ADDRESS", "'b' || CAST(k AS STRING) || '@example.it'"), (None, "' a '"), ("EMAIL_ADDRESS", "'a' || CAST(k AS STRING) || '@example.it'"), (None, "', copia '"), ("EMAIL_ADDRESS", "'b' || CAST(k AS STRING) || '@example.it'"), (None, "'; già <EMAIL_4>.'")])


def numbered_placeholders(spark, sf_dir):
    _, mapping = engine.pseudonymize(MAILS.texts(spark, sf_dir), WORDS, only=MAILS.rules, coreference=False)
    return mapping.select("doc_id", "entity_type", "value", "placeholder")


def pseudonymized(spark, sf_dir):
    out, _ = engine.pseudonymize(MAILS.texts(spark, sf_dir), WORDS, only=MAILS.rules, coreference=False)
    return out.select("doc_id", "anonymized")


def restore_roundtrip(spark, sf_dir):
    texts = MAILS.texts(spark, sf_dir)
    out, mapping = engine.pseudonymize(texts, WORDS, only=MAILS.rules, coreference=False)
    return engine.restore(out, mapping).select("doc_id", "restored", (F.col("restored") == F.col("text")).alias("same"))


def placeholder_status(spark, sf_dir):
    texts = MAILS.texts(spark, sf_dir)
    out, mapping = engine.pseudonymize(texts, WORDS, only=MAILS.rules, coreference=False)
    back = engine.restore(out.withColumn("anonymized", F.replace("anonymized", F.lit("<EMAIL_6>"), F.lit("(tolto)"))), mapping)
    return back.select("doc_id", F.array_join("status.matched", ",").alias("matched"), F.array_join("status.missing", ",").alias("missing"), F.array_join("status.unknown", ",").alias("unknown"), F.col("status.restorable").alias("restorable"))


def _nameless_mails(spark, sf_dir) -> DataFrame:
    """The mail letters under null ids and ids that repeat; every fourth letter stands twice."""
    texts = MAILS.texts(spark, sf_dir)
    again = texts.where("doc_id % 4 = 0").unionByName(texts)
    return again.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") - F.col("doc_id") % 2))


def pseudonymized_rows(spark, sf_dir):
    """Reversible work on rows without usable ids: rewritten, then restored."""
    out, mapping = engine.pseudonymize(_nameless_mails(spark, sf_dir), WORDS, only=MAILS.rules, coreference=False)
    return engine.restore(out, mapping).select("doc_id", "text", "anonymized", "restored", F.col("status.restorable").alias("restorable"))


def corpus_placeholders(spark, sf_dir):
    """Values numbered over the whole corpus, and the letters rewritten with those numbers."""
    out, mapping = engine.pseudonymize(_nameless_mails(spark, sf_dir), WORDS, scope="corpus", only=MAILS.rules, coreference=False)
    return engine.restore(out, mapping).select("doc_id", "anonymized", "restored")


def _reviewed(spark, sf_dir) -> DataFrame:
    long = engine.findings(MAILS.texts(spark, sf_dir), "maximum", WORDS, only=MAILS.rules, coreference=False)
    # the reviewer unchecks what starts with a, and one of two occurrences of the other value
    return long.withColumn("included", ~(F.col("value").startswith("a") | (F.col("start") < 4)))


def excluded_pairs(spark, sf_dir):
    return resolve.excluded_pairs(_reviewed(spark, sf_dir))


def exclude_by_value(spark, sf_dir):
    reviewed = _reviewed(spark, sf_dir)
    return _placed(resolve.exclude(reviewed.drop("included"), resolve.excluded_pairs(reviewed)))


def same_value_toggle(spark, sf_dir):
    reviewed = _reviewed(spark, sf_dir)
    return _placed(resolve.same_value(reviewed, reviewed.where(F.col("start") < 4)))


def review_groups(spark, sf_dir):
    return report.grouped_review(_reviewed(spark, sf_dir)).select("entity_type", "occurrences", "n_values", "excluded", "label")


def value_rows(spark, sf_dir):
    return report.value_rows(_reviewed(spark, sf_dir)).select("entity_type", "value", "occurrences", "all_included", "any_included", "source", "reliability")


def search_values(spark, sf_dir):
    return _placed(report.search(_reviewed(spark, sf_dir), "Contatti", "A1"))


def extra_values(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("Straße "), F.col("s_name"), F.lit(" e STRASSE "), F.upper("s_name")).alias("text"))
    detected = engine.detect(texts, "maximum", WORDS, only={"emails"}, coreference=False)
    values = texts.select("doc_id", F.lit("ADDRESS").alias("entity_type"), F.lit("strasse").alias("value"))
    return _placed(engine.explode(resolve.add_manual(detected, values)))


def corpus_metrics(spark, sf_dir):
    """Planted letters as the corpus: every planted value is expected, the label words have to stay."""
    letter = LETTERS["pec_vs_email"]
    out = engine.anonymize(letter.texts(spark, sf_dir), "maximum", WORDS, only=letter.rules, coreference=False)
    expected = F.array(*(F.struct(F.lit(t).alias("entity_type"), F.expr(e.replace("k AS STRING", "doc_id AS STRING")).alias("value")) for t, e in letter.segments if t))
    removed = out.select("text", "findings", F.explode(expected).alias("x")).select(report.expected_status(F.col("text"), F.col("findings"), F.col("x.value"), F.col("x.entity_type")).alias("status"))
    kept = out.select(report.remain_status(F.col("text"), F.col("anonymized"), F.lit("infine")).alias("status"))
    return report.corpus_metrics(removed.unionByName(kept))


def _cases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A document for each customer, and its case: expected values that are found, found as something else, left or absent, and values that have to stay."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    mail = F.concat(F.lit("b"), F.col("k").cast("string"), F.lit("@example.it"))
    file = F.concat(F.lit("/casi/"), F.col("k").cast("string"), F.lit(".txt"))
    text = F.concat(F.lit("Resoconto: scrivere a "), mail, F.lit(" o "), F.upper(mail), F.lit(". Referente interno Zeta"), F.col("k").cast("string"), F.lit("; fine."))
    expected = F.array(
        F.struct(F.lit("EMAIL_ADDRESS").alias("entity_type"), F.concat(mail, F.when(F.col("k") % 2 == 0, ".").otherwise("")).alias("value")), F.struct(F.lit("PHONE_NUMBER").alias("entity_type"), mail.alias("value")),
        F.struct(F.lit("PERSON").alias("entity_type"), F.concat(F.lit("zeta"), F.col("k").cast("string")).alias("value")), F.struct(F.lit("IBAN").alias("entity_type"), F.lit("IT00").alias("value")),
    )
    stay = F.array(F.lit("RESOCONTO"), F.lit("example.it"), F.lit("assente"))
    sector = F.when(F.col("k") % 3 == 0, "sanità").otherwise("scuola")
    return rows.select(file.alias("file"), text.alias("text")), rows.select(F.col("k").cast("string").alias("id"), sector.alias("sector"), file.alias("file"), expected.alias("expected_remove"), stay.alias("must_remain"))


def corpus_evaluation(spark, sf_dir):
    """Every status of every value of an evaluation corpus."""
    docs, cases = _cases(spark, sf_dir)
    return evaluation.evaluate(docs, cases, only={"emails"}, coreference=False)


def corpus_evaluation_metrics(spark, sf_dir):
    docs, cases = _cases(spark, sf_dir)
    return evaluation.metrics(evaluation.evaluate(docs, cases, only={"emails"}, coreference=False))


def ocr_words(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("text"), F.lit("1").alias("left"), F.lit("2").alias("top"),
        F.when(F.col("o_orderstatus") == "F", "0").otherwise("30.0").alias("width"), F.lit("10").alias("height"),
    )
    return documents.ocr_words(pages).select("doc_id", "seq", "text", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "right", "bottom")


def output_names(spark, sf_dir):
    exts = F.array(*(F.lit(x) for x in (".txt", ".CSV", ".pdf", ".doc", ".docx", ".md")))
    paths = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("/in/"), F.replace("s_name", F.lit("#"), F.lit("-")), F.get(exts, (F.col("s_suppkey") % 6).cast("int"))).alias("path"))
    return paths.select("path", documents.output_name(F.col("path")).alias("name"))


def activity_log_tail(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(1).alias("schema_version"), F.concat(F.lit("T"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("timestamp"), F.col("event_type").alias("action"))
    return activity_log.trim(rows, activity_log.Settings(True, 50))


def activity_log_stream(spark, sf_dir):
    """The log that a stream's sink leaves: batches of events, some of them replayed, compacted in between to what retention allows."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit(1).alias("schema_version"), F.concat(F.lit("T"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("timestamp"), F.col("event_type").alias("action"))
    path, settings = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", activity_log.Settings(True, 70)
    write = log_sink.sink(path, settings, compact_every=2)
    for k in (0, 1, 1, 2, 3, 3, 2, 4):
        write(rows.where(F.col("event_id") % 5 == k).drop("event_id"), k)
    log_sink.compact(spark, path, settings)
    return log_sink.read(spark, path).select("schema_version", "timestamp", "action")


def fingerprints(spark, sf_dir):
    out = engine.detect(_documents(spark, sf_dir).select("doc_id", "text"), "maximum", WORDS, only={"emails"}, coreference=False)
    return report.fingerprints(out).select("doc_id", "text_sha256")


def accepted_requests(spark, sf_dir):
    return engine.accepted(_documents(spark, sf_dir).select("doc_id", "text"), 5000).select("doc_id")


_PLAIN = [
    email_findings, card_findings, intl_phone_findings, findings_by_type, findings_by_category, mask_maximum, detect_all_rules, all_rules_by_type, all_rules_by_category, all_rules_masked, all_rules_standard, all_rules_reports, reports, reliability_levels, initials, numbered_placeholders, pseudonymized,
    restore_roundtrip, pseudonymized_rows, corpus_placeholders, placeholder_status, excluded_pairs, exclude_by_value, same_value_toggle, review_groups, value_rows, search_values, extra_values, corpus_metrics, corpus_evaluation, corpus_evaluation_metrics, ocr_words, output_names,
    activity_log_tail, activity_log_stream, fingerprints, accepted_requests,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _letter(x) for name, x in LETTERS.items()} | {f.__name__: f for f in _PLAIN}


# The oracles state the patterns in RE2's dialect: word characters spelled out, look-around as checks of neighbours.
_W = r"[\p{L}\p{N}_]"
_MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
# The sign behind a card is matched and cut off again, so that the engine gives digits back until the end fits.
_CARD = r"[1-9](?:[ -]?[0-9]){12,18}(?:$|[^\p{L}\p{N}_-])"
_PHONE = r"\+[1-9][0-9]{0,2}(?:[\s./-]?\(?[0-9]{1,4}\)?){2,5}"


def _matches(entity: str, pattern: str, test: str, score: float, cut: str = "m[i]") -> str:
    return f"""SELECT doc_id, lang, '{entity}' AS entity_type, s AS start_at, CAST(s + len(v) AS INT) AS end_at, v AS value, {score} AS score FROM (
  SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS ds, substr(t, s, 1) AS prev, substr(t, s + len(v) + 1, 1) AS next FROM (
    SELECT doc_id, lang, t, {cut} AS v, CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS INT) AS s
    FROM (SELECT doc_id, lang, t, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, lang, text AS t, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents))))
WHERE {test}"""


_LUHN = "list_sum(list_transform(range(len(ds)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(ds, len(ds) - i, 1) AS INT) WHEN CAST(substr(ds, len(ds) - i, 1) AS INT) > 4 THEN CAST(substr(ds, len(ds) - i, 1) AS INT) * 2 - 9 ELSE CAST(substr(ds, len(ds) - i, 1) AS INT) * 2 END)) % 10 = 0"
_FOUND = {
    "email_findings": _matches("EMAIL_ADDRESS", _MAIL, "true", 0.98),
    "card_findings": _matches("CREDIT_CARD", _CARD, f"len(ds) BETWEEN 13 AND 19 AND {_LUHN} AND NOT regexp_matches(prev, '{_W}|-')", 0.95, "regexp_replace(m[i], '[^0-9]$', '')"),
    "intl_phone_findings": _matches("PHONE_NUMBER", _PHONE, "len(ds) BETWEEN 8 AND 15 AND substr(ds, 1, 2) <> '39'", 0.92),
}
_ALL = "WITH found AS (\n" + "\nUNION ALL\n".join(_FOUND.values()) + "\n)"
_CATEGORY = "CASE entity_type WHEN 'CREDIT_CARD' THEN 'Finanziari' ELSE 'Contatti' END"
_TAG = "CASE entity_type WHEN 'CREDIT_CARD' THEN '<CARTA_PAGAMENTO>' WHEN 'EMAIL_ADDRESS' THEN '<EMAIL>' ELSE '<TELEFONO>' END"
_KEYS = "WITH keys AS (SELECT c_custkey AS k, 'b' || CAST(c_custkey AS STRING) || '@example.it' AS b, 'a' || CAST(c_custkey AS STRING) || '@example.it' AS a FROM customer)"
_REVIEW = _KEYS + """, r AS (
  SELECT k AS doc_id, 'EMAIL_ADDRESS' AS entity_type, 3 AS start_at, 3 + len(b) AS end_at, b AS value, false AS included FROM keys
  UNION ALL SELECT k, 'EMAIL_ADDRESS', 6 + len(b), 6 + len(b) + len(a), a, false FROM keys
  UNION ALL SELECT k, 'EMAIL_ADDRESS', 14 + len(b) + len(a), 14 + 2 * len(b) + len(a), b, true FROM keys)"""
_COLUMNS = "doc_id, entity_type, CAST(start_at AS INT) AS start_at, CAST(end_at AS INT) AS end_at, value"


def oracle_sql() -> dict[str, str]:
    out = {name: x.oracle() for name, x in LETTERS.items()}
    out |= {name: f"SELECT doc_id, entity_type, start_at, end_at, value FROM ({sql})" for name, sql in _FOUND.items()}
    out["findings_by_type"] = f"{_ALL} SELECT lang, entity_type, count(*) AS n FROM found GROUP BY ALL"
    out["findings_by_category"] = f"{_ALL} SELECT {_CATEGORY} AS category, count(*) AS n FROM found GROUP BY 1 UNION ALL SELECT 'Tutti', count(*) FROM found"
    out["reliability_levels"] = f"{_ALL} SELECT 'Alta' AS reliability, entity_type = 'CREDIT_CARD' AS checked, count(*) AS n FROM found GROUP BY ALL"
    out["mask_maximum"] = f"""{_ALL}, parts AS (
  SELECT f.doc_id, f.start_at, substr(d.text, coalesce(lag(f.end_at) OVER w, 0) + 1, f.start_at - coalesce(lag(f.end_at) OVER w, 0)) || {_TAG} AS piece, f.end_at
  FROM found f JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY f.doc_id ORDER BY f.start_at)
), heads AS (SELECT doc_id, string_agg(piece, '' ORDER BY start_at) AS head, max(end_at) AS last FROM parts GROUP BY doc_id)
SELECT doc_id, coalesce(head, '') || substr(text, coalesce(last, 0) + 1) AS anonymized FROM documents LEFT JOIN heads USING (doc_id)"""
    note = f"{fixed.MODE_NOTES['maximum']} {fixed.REVIEW_NOTE}".replace("'", "''")
    out["reports"] = f"""{_ALL}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (entity_type = 'CREDIT_CARD') AS c, count(*) FILTER (entity_type = 'EMAIL_ADDRESS') AS e, count(*) FILTER (entity_type = 'PHONE_NUMBER') AS p FROM found GROUP BY 1),
t AS (SELECT doc_id, coalesce(n, 0) AS n, concat_ws(', ', CASE WHEN c = 1 THEN '1 carta di pagamento' WHEN c > 1 THEN c || ' carte di pagamento' END, CASE WHEN e > 0 THEN e || ' email' END, CASE WHEN p = 1 THEN '1 telefono' WHEN p > 1 THEN p || ' telefoni' END) AS s FROM documents LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS INT) AS total, 'Modalità Massima protezione: ' || n || CASE WHEN n = 1 THEN ' dato riconosciuto (' ELSE ' dati riconosciuti (' END || CASE WHEN n = 0 THEN 'nessun dato riconosciuto' ELSE s END || '). {note}' AS summary FROM t"""
    out["initials"] = r"""SELECT p_partkey AS id, CASE WHEN len(w) = 0 THEN '<ANONIMIZZATO>' ELSE array_to_string(list_transform(w, lambda x: substr(x, 1, 1) || '.'), ' ') END AS initials
FROM (SELECT p_partkey, list_filter(regexp_extract_all(p_name, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+'), lambda x: NOT regexp_full_match(x, '[0-9]+')) AS w FROM part)"""
    out["numbered_placeholders"] = f"{_KEYS} SELECT k AS doc_id, 'EMAIL_ADDRESS' AS entity_type, b AS value, '<EMAIL_5>' AS placeholder FROM keys UNION ALL SELECT k, 'EMAIL_ADDRESS', a, '<EMAIL_6>' FROM keys"
    out["pseudonymized"] = "SELECT c_custkey AS doc_id, 'Da <EMAIL_5> a <EMAIL_6>, copia <EMAIL_5>; già <EMAIL_4>.' AS anonymized FROM customer"
    out["restore_roundtrip"] = f"{_KEYS} SELECT k AS doc_id, 'Da ' || b || ' a ' || a || ', copia ' || b || '; già <EMAIL_4>.' AS restored, true AS same FROM keys"
    nameless = f"""{_KEYS}, l AS (SELECT k, a, b FROM keys UNION ALL SELECT k, a, b FROM keys WHERE k % 4 = 0),
r AS (SELECT CASE WHEN k % 3 <> 0 THEN k - k % 2 END AS doc_id, a, b, 'Da ' || b || ' a ' || a || ', copia ' || b || '; già <EMAIL_4>.' AS text FROM l)"""
    out["pseudonymized_rows"] = f"{nameless} SELECT doc_id, text, 'Da <EMAIL_5> a <EMAIL_6>, copia <EMAIL_5>; già <EMAIL_4>.' AS anonymized, text AS restored, false AS restorable FROM r"
    out["corpus_placeholders"] = f"""{nameless}, v AS (SELECT doc_id, b AS value, 3 AS s FROM r UNION ALL SELECT doc_id, a, 6 + len(b) FROM r),
f AS (SELECT value, doc_id, s FROM v QUALIFY row_number() OVER (PARTITION BY value ORDER BY doc_id NULLS LAST, s) = 1),
n AS (SELECT value, '<EMAIL_' || (4 + row_number() OVER (ORDER BY doc_id NULLS LAST, s, value)) || '>' AS p FROM f)
SELECT doc_id, 'Da ' || nb.p || ' a ' || na.p || ', copia ' || nb.p || '; già <EMAIL_4>.' AS anonymized, CASE WHEN h.value IS NULL THEN text ELSE replace(text, '<EMAIL_4>', h.value) END AS restored FROM r JOIN n nb ON nb.value = b JOIN n na ON na.value = a LEFT JOIN n h ON h.p = '<EMAIL_4>'"""
    out["placeholder_status"] = "SELECT c_custkey AS doc_id, '<EMAIL_5>' AS matched, '<EMAIL_6>' AS missing, '<EMAIL_4>' AS unknown, false AS restorable FROM customer"
    out["excluded_pairs"] = f"{_REVIEW} SELECT doc_id, entity_type, value FROM r GROUP BY ALL HAVING NOT bool_or(included)"
    out["exclude_by_value"] = f"{_REVIEW} SELECT {_COLUMNS} FROM r WHERE value LIKE 'b%'"
    out["same_value_toggle"] = out["exclude_by_value"]
    out["review_groups"] = f"{_REVIEW} SELECT entity_type, count(*) AS occurrences, count(DISTINCT value) AS n_values, count(*) FILTER (NOT included) AS excluded, 'email' AS label FROM r GROUP BY 1"
    out["value_rows"] = f"{_REVIEW} SELECT entity_type, value, count(*) AS occurrences, bool_and(included) AS all_included, bool_or(included) AS any_included, 'italian_rules' AS source, 'Alta' AS reliability FROM r GROUP BY 1, 2"
    out["search_values"] = f"{_REVIEW} SELECT {_COLUMNS} FROM r WHERE value LIKE '%a1%'"
    out["extra_values"] = """SELECT s_suppkey AS doc_id, 'ADDRESS' AS entity_type, 0 AS start_at, 6 AS end_at, 'Straße' AS value FROM supplier
UNION ALL SELECT s_suppkey, 'ADDRESS', CAST(10 + len(s_name) AS INT), CAST(17 + len(s_name) AS INT), 'STRASSE' FROM supplier"""
    out["corpus_metrics"] = "SELECT 3 * count(*) AS detected, CAST(0 AS BIGINT) AS wrong_type_or_span, CAST(0 AS BIGINT) AS leaked, CAST(0 AS BIGINT) AS not_extracted, count(*) AS preserved, CAST(0 AS BIGINT) AS false_positive, CAST(100 AS DOUBLE) AS removal, CAST(100 AS DOUBLE) AS preservation FROM customer"
    cases = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_custkey % 2 = 0 AS even, 'b' || c_custkey || '@example.it' AS mail FROM customer),
v AS (SELECT k, 'expected_remove' AS kind, 'EMAIL_ADDRESS' AS entity_type, mail || CASE WHEN even THEN '.' ELSE '' END AS value, 'detected' AS status FROM c
  UNION ALL SELECT k, 'expected_remove', 'PHONE_NUMBER', mail, 'wrong_type_or_span' FROM c
  UNION ALL SELECT k, 'expected_remove', 'PERSON', 'zeta' || k, 'leaked' FROM c
  UNION ALL SELECT k, 'expected_remove', 'IBAN', 'IT00', 'not_extracted' FROM c
  UNION ALL SELECT k, 'must_remain', NULL, 'RESOCONTO', 'preserved' FROM c
  UNION ALL SELECT k, 'must_remain', NULL, 'example.it', 'false_positive' FROM c
  UNION ALL SELECT k, 'must_remain', NULL, 'assente', 'not_extracted' FROM c)"""
    out["corpus_evaluation"] = f"{cases} SELECT k AS id, '/casi/' || k || '.txt' AS file, kind, entity_type, value, status FROM v"
    n = ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("detected", "wrong_type_or_span", "leaked", "not_extracted", "preserved", "false_positive"))
    out["corpus_evaluation_metrics"] = f"{cases} SELECT {n}, CAST(round(200.0 / 3, 2) AS DOUBLE) AS removal, CAST(50 AS DOUBLE) AS preservation FROM v"
    out["ocr_words"] = """WITH w AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, trim(o_orderpriority) AS text FROM orders WHERE o_orderstatus <> 'F' AND trim(o_orderpriority) <> ''),
s AS (SELECT *, coalesce(sum(len(text) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w)
SELECT doc_id, seq, text, CAST(pos AS INT) AS start_at, CAST(pos + len(text) AS INT) AS end_at, 31 AS "right", 12 AS bottom FROM s"""
    out["output_names"] = """WITH p AS (SELECT replace(s_name, '#', '-') AS stem, ['.txt', '.CSV', '.pdf', '.doc', '.docx', '.md'][1 + s_suppkey % 6] AS e, ['.txt', '.csv', '.pdf', '.docx', '.docx', '.txt'][1 + s_suppkey % 6] AS o FROM supplier)
SELECT '/in/' || stem || e AS path, stem || '_anonimizzato' || o AS name FROM p"""
    out["activity_log_tail"] = "SELECT 1 AS schema_version, 'T' || lpad(CAST(event_id AS STRING), 12, '0') AS timestamp, event_type AS action FROM events ORDER BY event_id DESC LIMIT 50"
    out["activity_log_stream"] = out["activity_log_tail"].replace("LIMIT 50", "LIMIT 70")
    out["fingerprints"] = "SELECT doc_id, sha256(text) AS text_sha256 FROM documents"
    out["accepted_requests"] = "SELECT doc_id FROM documents WHERE len(text) <= 5000 AND trim(text) <> ''"
    return out
