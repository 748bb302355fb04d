"""Operator 11: spelling variants of words, by rare-first bigram prefixes.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. One edit destroys at most two bigrams of a word, so of any three
bigrams one survives: two near words share one of the bigrams that come first in a global order, three in each word, at positions that differ by at most one.
The order is by frequency, rare first. (Bigrams that repeat within a word count as one in the order: if the third is a repeated one, all its places are taken.
So whichever word's prefix ends first, its surviving bigram lies in the other's prefix.)

The edit lies wholly in front of or behind a surviving bigram. So words do not meet by the bigram alone but by the bigram together with all that stands in
front of it, or together with all that stands behind it; both are joined on, as hashes. Every pair that meets is verified: first by length and by which letters
stand an odd number of times, then by its edit distance.

Words of more than ``LONG`` code points may hold one bigram thousands of times. One edit leaves their first or their last ``LONG`` // 2 code points as they are,
so they are joined on those; words of about that length on both, so that no pair falls between.

What grows with the corpus is shuffled: occurrences are summed before they travel, then the join works on distinct words. Broadcast are only the frequencies
of bigrams: at most 90 * 90, as the alphabet has 90 letters.

Chains of forms end, as each form occurs at least ``RATIO`` times as often as its word; roots are found by doubling, one written table a round, at most
log2(log5 n) rounds.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the checksum of :func:`op11`; repeated rows count as often as they
stand; of near words with equal counts the smallest in code-point order is the form; an empty table gives an empty result. Further columns do not matter.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from veilspark.llm.util import discard, materialize

#: Code points of the shortest word, occurrences of the rarest word, and how much more often a form occurs than its word.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Bigrams of a word that are joined: one more than an edit can destroy.
PREFIX = 3
LETTERS = "A-Za-zÀ-ÿ"
#: Words of more code points than this, runs without a blank rather than words, meet by their first or last half of so many instead of by bigrams.
LONG = 63
#: One run in so many of a document loses a code point in :func:`op11`.
SLIP = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, run: maximal runs of letters of at least ``shortest`` code points, A to Z lower-cased."""
    long = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    return long.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))


def counted(words: DataFrame) -> DataFrame:
    """word, n of the words (one column, ``word``) that are long and frequent enough."""
    return words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _bigrams(word: Column) -> Column:
    # the letters are bound once, not split anew for each bigram
    pairs = lambda letters: F.transform(F.sequence(F.lit(0), F.length(word) - 2), lambda i: F.concat(F.get(letters, i), F.get(letters, i + 1)))
    return F.transform(F.array(F.split(word, "")), pairs)[0]


def _parity(word: Column) -> Column:
    """A bit for each letter (modulo 64) that stands in the word an odd number of times. One edit turns two bits at most."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def prefixes(words: DataFrame) -> DataFrame:
    """word, n, length, parity, key, at: for each of the rarest bigrams of a word two keys, the bigram with what stands in front of it and with what stands behind it."""
    placed = words.select("word", "n", F.posexplode(_bigrams(F.col("word"))).alias("at", "bigram"))
    frequency = placed.groupBy("bigram").agg(F.count(F.lit(1)).alias("f"))
    ranked = placed.join(F.broadcast(frequency), "bigram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("f", "bigram", "at"))).alias("b"))
    last = F.element_at("b", PREFIX)
    first = F.filter("b", lambda x: F.struct(x["f"], x["bigram"]) <= F.struct(last["f"], last["bigram"]))
    front = lambda x: F.struct(F.xxhash64(F.lit("front"), F.substring("word", F.lit(1), x["at"] + 2)).alias("key"), x["at"].alias("at"))
    back = lambda x: F.struct(F.xxhash64(F.lit("back"), F.substring("word", x["at"] + 1, F.length("word"))).alias("key"), x["at"].alias("at"))
    shape = (F.length("word").alias("length"), _parity(F.col("word")).alias("parity"))
    return ranked.select("word", "n", *shape, F.explode(F.flatten(F.transform(first, lambda x: F.array(front(x), back(x))))).alias("k")).select("word", "n", "length", "parity", "k.*")


@F.pandas_udf(BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    def near(x: str, y: str) -> bool:
        p = len(os.path.commonprefix((x, y)))
        return x != y and (x[p + 1 :] == y[p + 1 :] or x[p:] == y[p + 1 :] or x[p + 1 :] == y[p:])

    return pd.Series([near(x, y) for x, y in zip(a, b)], dtype=bool)


def _met(keys: DataFrame, *columns: str) -> DataFrame:
    """Pairs of rows with one key: ``columns`` of both, with _a and _b behind their names."""
    a, b = (keys.select(F.col("key").alias(f"key_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab")
    # cheap tests first: of the pairs that meet, few are near
    close = (F.abs(F.col("length_a") - F.col("length_b")) <= 1) & (F.col("word_a") < F.col("word_b"))
    if "parity" in columns:
        close = (F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= 2) & (F.abs(F.col("at_a") - F.col("at_b")) <= 1) & close & (F.levenshtein("word_a", "word_b", 1) == 1)
    return a.join(b, (F.col("key_a") == F.col("key_b")) & close)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b with a before b: every pair of near words once. ``words``: word, n; distinct words of at least four code points."""
    keys = materialize(prefixes(words.where(F.length("word") <= LONG + 1)), "prefixes")
    shown = [F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b"]
    short = _met(keys, "word", "n", "length", "parity", "at").select(*shown)
    half = LONG // 2
    ends = F.array(F.xxhash64(F.lit("first"), F.substring("word", 1, half)), F.xxhash64(F.lit("last"), F.substring("word", -half, half)))
    long = words.where(F.length("word") >= LONG).select("word", "n", F.length("word").alias("length"), F.explode(ends).alias("key"))
    met = _met(long, "word", "n", "length").where(_one_edit("word_a", "word_b")).select(*shown)
    pairs = materialize(short.unionByName(met).distinct(), "near-words")
    discard(keys)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form (word, form), by doubling."""
    up = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not up.where("moved").isEmpty():
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        higher = up.select("word", "root").join(above, "root", "left")
        before, up = up, materialize(higher.select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        discard(before)
    return up.select("word", "root")


def group_words(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a written table of distinct words (word, n) of at least four code points."""
    pairs = near_pairs(words)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.struct((-F.col(f"n_{y}")).alias("fewer"), F.col(y).alias("word")).alias("other"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    is_form = -F.col("best.fewer") >= RATIO * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.fewer")).alias("form_n")), "forms")
    discard(pairs)
    out = words.join(best, "word", "left").join(roots(best.where("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (doc_id, text) with their near words, forms and roots."""
    return group_words(materialize(counted(runs(docs, MIN_LENGTH).select(F.col("run").alias("word"))), "words"))


def slipped(run: Column, doc_id: Column) -> Column:
    """``run``, without one code point where ``SLIP`` divides the checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    k = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.length(run)))).otherwise(run)


def op11(docs: DataFrame) -> DataFrame:
    """Spelling groups of the words of ``docs``, some of which lose a code point."""
    words = runs(docs, MIN_LENGTH).select(slipped(F.col("run"), F.col("doc_id")).alias("word"))
    return group_words(materialize(counted(words), "words"))


# CRC-32 by table over the bytes of each run of a document; near words meet by what is left of them without one code point.
ORACLE_SQL = r"""WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{6,}'), lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents),
r AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM d GROUP BY id, run),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT))) AS h FROM r, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE len(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS top, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN top END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.next = f.word)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word AND up.next IS NULL"""
