"""Operator 5 [native]: line deduplication by a fixed-depth log-template tree.

Lines (split at LF) go down a tree: first level the token count, then ``DEPTH`` leading tokens. Tokens
with a digit are variable (``<*>``) from the start. In each leaf, token variants are generalised: at a position,
a token that fewer than ``MIN_DOCS`` (document, distinct line) pairs of the leaf share becomes
``<*>``. A line whose template keeps at least ``MIN_CONSTANT`` of its tokens belongs to that
template. Templates seen in at least ``MIN_DOCS`` documents recur: every line of theirs is dropped but the very
first (smallest doc_id, then line number), so that no content is lost altogether.

All of it is DataFrame operations. One pass over the texts writes a row for each line: its leaf, the hash of its masked
form, and that form. What follows reads only the columns that it needs; masked lines travel only towards leaves that
``MIN_DOCS`` documents reach. Counts are summed in partial aggregates before each shuffle, and both sides of every join with hot keys
(a leaf, line or template that a third of all documents hold) are written tables or plain exchanges, so that adaptive
execution can split such a key. A line is named by two hashes, of its leaf and of itself, 128 bits in all; a template likewise.

A document is a row, not an id: where doc_ids repeat or are null, rows get numbers of their own.

Defined cases: null text = no line, text stays null; blank lines belong to no template and always stay;
empty text stays empty; rows with equal doc_ids, with null doc_ids, and repeated rows are documents of their own, in the order of
doc_id (null last), then text; other columns are kept, whatever their names, but for the two that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.util import discard, fresh, materialize, numbered

DEPTH = 3
MIN_DOCS = 3
MIN_CONSTANT = 0.6
VARIABLE = "<*>"


def masked(text: Column) -> Column:
    """A text with its white space but line ends squeezed to single spaces, and tokens with a digit made variable.

    Both patterns move forward only: a token is looked at from its start, once.
    """
    squeezed = F.regexp_replace(text, r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+|\x20[\x20\x09\x0B-\x0D]++", " ")
    return F.regexp_replace(squeezed, r"(?<![^\x20\n])[^\x20\n0-9]*+[0-9][^\x20\n]*+", VARIABLE)


def lines_of(rows: DataFrame, key: str) -> DataFrame:
    """row, line_no, leaf, line_id, line (masked) of every line with a token.

    The outer form of explode with a test behind it: for the plain form the optimiser would test the size of the split text first, and split twice.
    """
    parts = rows.select(F.col(key).alias("row"), F.posexplode_outer(F.split(masked(F.col("text")), "\n")).alias("line_no", "raw"))
    lines = parts.select("row", "line_no", F.trim("raw").alias("line")).where(F.col("line") != "")
    tokens = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return lines.select("row", "line_no", F.xxhash64(tokens, F.substring_index("line", " ", DEPTH)).alias("leaf"), F.xxhash64("line").alias("line_id"), "line")


def recurring(rows: DataFrame, key: str, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """Lines of recurring templates but the first of each: row, line_no. ``key`` numbers the rows; its order says which is first."""
    lines = materialize(lines_of(rows, key), "lines")
    reached = materialize(lines.select("leaf", "row").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    kept = materialize(lines.join(reached, "leaf").select("leaf", "line_id", "row", "line_no", "line"), "kept")
    discard(lines, reached)
    docs = kept.select("leaf", "line_id", "row").distinct().groupBy("leaf", "line_id").agg(F.count("*").alias("docs"))
    distinct = materialize(docs.join(kept.groupBy("leaf", "line_id").agg(F.min("line").alias("line")), ["leaf", "line_id"]), "distinct-lines")
    tokens = distinct.select("leaf", "line_id", "docs", F.posexplode_outer(F.split("line", " ")).alias("pos", "token"))
    constant = (F.col("support") >= min_docs) & (F.col("token") != VARIABLE)
    common = materialize(tokens.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("support")).where(constant).select("leaf", "pos", "token", F.lit(1).alias("constant")), "constants")
    spelled = (
        tokens.join(common, ["leaf", "pos", "token"], "left")
        .groupBy("leaf", "line_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("constant") == 1, F.col("token")).otherwise(VARIABLE).alias("token")))).alias("spelled"),
            F.count("constant").alias("constants"),
            F.count("*").alias("n"),
        )
        .where(F.col("constants") >= F.col("n") * F.lit(min_constant))
        .select("leaf", "line_id", F.xxhash64(F.array_join(F.col("spelled.token"), " ")).alias("template"))
    )
    spelled = materialize(spelled, "spelled")
    of_lines = materialize(kept.select("leaf", "line_id", "row", "line_no").join(spelled, ["leaf", "line_id"]).drop("line_id"), "spelled-lines")
    per_row = of_lines.groupBy("leaf", "template", "row").agg(F.min("line_no").alias("line_no"))
    stats = per_row.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min(F.struct("row", "line_no")).alias("first")).where(F.col("docs") >= min_docs)
    stats = materialize(stats.select("leaf", "template", F.col("first.row").alias("r0"), F.col("first.line_no").alias("l0")), "recurring")
    discard(kept, distinct, common, spelled)
    found = of_lines.join(stats, ["leaf", "template"])
    return found.where((F.col("row") != F.col("r0")) | (F.col("line_no") != F.col("l0"))).select("row", "line_no")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and two columns: lines of a row, and lines dropped.

    ``counts`` names these two; input columns of the same names are replaced.
    """
    columns = [c for c in docs.columns if c not in counts]
    rows, key = numbered(docs)
    gone = fresh(docs, "gone")
    drops = recurring(rows.select(key, "text"), key, min_docs, min_constant).groupBy(F.col("row").alias(key)).agg(F.collect_set("line_no").alias(gone))
    joined = rows.join(drops, key, "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    return joined.select(
        *(F.when(F.col(gone).isNotNull(), left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(counts[1]),
    )


def op5(docs: DataFrame) -> DataFrame:
    return drop_lines(docs.select("doc_id", "text"))


ORACLE_SQL = f"""
WITH parts AS (
  SELECT doc_id, line_no - 1 AS line_no, raw FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
), lines AS (
  SELECT doc_id, line_no, list_transform(list_filter(string_split_regex(raw, '[ \\t-\\r]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{VARIABLE}' ELSE x END) AS toks FROM parts
), keyed AS (
  SELECT doc_id, line_no, toks, len(toks) AS n, toks[1:{DEPTH}] AS lead FROM lines WHERE len(toks) > 0
), per_line AS (
  SELECT n, lead, toks, count(DISTINCT doc_id) AS docs FROM keyed GROUP BY ALL
), tokens AS (
  SELECT n, lead, toks, docs, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM per_line
), common AS (
  SELECT n, lead, pos, token FROM tokens WHERE token <> '{VARIABLE}' GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}
), spelled AS (
  SELECT t.n, t.lead, t.toks, list(CASE WHEN c.token IS NULL THEN '{VARIABLE}' ELSE t.token END ORDER BY t.pos) AS template, count(c.token) AS constants
  FROM tokens t LEFT JOIN common c USING (n, lead, pos, token) GROUP BY ALL
), of_lines AS (
  SELECT k.doc_id, k.line_no, k.n, k.lead, s.template FROM keyed k JOIN spelled s USING (n, lead, toks) WHERE s.constants >= s.n * {MIN_CONSTANT}
), stats AS (
  SELECT n, lead, template, count(DISTINCT doc_id) AS docs, min(doc_id) AS d0, arg_min(line_no, doc_id * 1000000 + line_no) AS l0 FROM of_lines GROUP BY ALL
), drops AS (
  SELECT doc_id, line_no FROM of_lines JOIN stats USING (n, lead, template) WHERE docs >= {MIN_DOCS} AND NOT (doc_id = d0 AND line_no = l0)
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(kept.n_lines, 0) AS n_lines, coalesce(kept.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN (
  SELECT p.doc_id, string_agg(p.raw, chr(10) ORDER BY p.line_no) FILTER (x.doc_id IS NULL) AS text, count(*) AS n_lines, count(x.doc_id) AS n_dropped
  FROM parts p LEFT JOIN drops x USING (doc_id, line_no) GROUP BY p.doc_id) kept USING (doc_id)
"""
