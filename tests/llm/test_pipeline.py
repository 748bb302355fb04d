"""Stages on the given tables, and on rows made to trouble them."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from veilspark.llm.util import materialize

SF = "/root/testdata/sf0.001"
CLASHING = "lang_pred score rejected n_lines n_dropped dropped_lines gone row row_number rank key comp group n part copies taken size target source_size block level p label".split()
LINES = "the river runs past the old stone bridge and the mill|a winter market opens under yellow lamps near the church|nobody in the village remembers who built the first wall".split("|")


def rows_of(df):
    return df.collect()


def prose(rng, n):
    words = "river stone bridge mill winter market yellow lamp church village wall morning letter garden silver paper window".split()
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "ward"]) for _ in range(n))


@pytest.fixture(scope="module")
def troubled(spark):
    """Null, empty, blank, long and repeated texts; repeated and null ids; ties; columns with the names that operators use."""
    rng = random.Random(3)
    texts = [prose(rng, 80) for _ in range(20)]
    texts += [texts[0], texts[0], " ".join([*texts[1].split()[:40], "changed", *texts[1].split()[41:]])]
    texts += [f"{prose(rng, 60)}\n{LINES[0]}\n{prose(rng, 60)}" for _ in range(5)]
    texts += [LINES[0]] * 3 + [None, None, "", " \n ", "...", prose(rng, 30_000)]
    ids = [None if i % 6 == 0 else i // 2 for i in range(len(texts))]
    rows = [(d, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), *(f"{c}{i}" for c in CLASHING)) for i, (d, t) in enumerate(zip(ids, texts))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return materialize(spark.createDataFrame(rows, kinds), "troubled")


def extras(rows):
    return collections.Counter(tuple(r[c] for c in CLASHING) for r in rows)


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert before * 0.7 < docs.count() <= before
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    texts = {r.doc_id: r.text for r in rows_of(docs)}
    got = rows_of(mixed)
    assert got and all(r.copies >= 1 and r.taken <= 3 * r.size and r.text == texts[r.doc_id] and r.taken == r.copies * r.size for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_other_columns_pass_unchanged(spark, troubled, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, troubled, SF)
    got = rows_of(out)
    assert out.columns == troubled.columns and not extras(got) - extras(rows_of(troubled))


def test_language_rejects_what_has_no_letters(spark, troubled):
    got = rows_of(corpus_pipeline.language(spark, troubled, SF))
    assert all(r.text and any(c.isalpha() for c in r.text) for r in got)


def test_line_dedup_judges_rows(spark, troubled):
    got = rows_of(corpus_pipeline.line_dedup(spark, troubled, SF))
    assert sum(LINES[0] in (r.text or "") for r in got) == 1
    own = {r["row"]: r.text for r in rows_of(troubled)}
    for r in got:
        kept = collections.Counter((r.text or "").split("\n"))
        assert not kept - collections.Counter((own[r["row"]] or "").split("\n"))
    gone = set(own) - {r["row"] for r in got}
    # documents that were the line alone, and whole copies of a line that three documents hold
    assert all(LINES[0] == own[x] or sum(own[x] == t for t in own.values()) >= 3 for x in gone)
    assert sum(r.text is None for r in got) == 2 and sum(r.text in ("", " \n ", "...") for r in got) == 3
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_near_duplicates_keep_one_row_of_each_class(spark, troubled):
    got = rows_of(corpus_pipeline.near_duplicates(spark, troubled, SF))
    texts = [r.text for r in got]
    own = {r["row"]: r.text for r in rows_of(troubled)}
    every = [own[f"row{i}"] for i in range(len(own))]
    assert texts.count(every[0]) == 1 and texts.count(LINES[0]) == 1 and texts.count(None) == 2
    assert (every[1] in texts) != (every[22] in texts) and every[-1] in texts
    assert all(t in texts for t in every[2:20])


def test_benchmark_leaks_go(spark, troubled):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leaky = troubled.limit(1).withColumn("text", F.lit(f"Before it. {item} And behind it."))
    got = rows_of(corpus_pipeline.benchmark_leaks(spark, troubled.unionByName(leaky), SF))
    assert extras(got) == extras(rows_of(troubled))


def test_mixture_keeps_own_columns(spark, troubled):
    out = corpus_pipeline.mixture(spark, troubled, SF)
    assert out.columns == [*troubled.columns, "_size", "_source_size", "_target", "_copies", "_taken"]
    got, own = rows_of(out), {r["row"]: r for r in rows_of(troubled)}
    assert len(got) == len({r["row"] for r in got})
    for r in got:
        assert r.text == own[r["row"]].text and r["size"] == own[r["row"]]["size"] and r._taken == r._copies * len((r.text or "").split())
    sums = collections.Counter()
    for r in got:
        sums[r.source] += r._taken
    target = {r.source: r._target for r in got}
    most = {s: max(len((r.text or "").split()) for r in own.values() if r.source == s) for s in target}
    assert all(abs(sums[s] - target[s]) <= most[s] for s in target)
