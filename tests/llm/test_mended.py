"""Insertions and deletions within benchmark items, hot rows in the mix, bounded samples."""

import random

import pytest

from veilspark.llm import cube_mixing, decontamination, quality_mil, util

WORDS = [a + b + c for a in ("ba", "ce", "di", "fo", "gu") for b in ("la", "me", "ni", "ro", "su") for c in ("p", "st", "ng", "")]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def longest_chain(item, text):
    """Windows of the item that stand in the text in the same order: the plain form of the rule, for words without slots."""
    w = decontamination.WINDOW
    a, b = ([tuple(x[i : i + w]) for i in range(len(x) - w + 1)] for x in (item, text))
    best = [0] * (len(b) + 1)
    for x in a:
        before = best[:]
        for j, y in enumerate(b):
            best[j + 1] = max(best[j], before[j + 1], before[j] + 1 if x == y else 0)
    return best[-1], len(a)


@pytest.mark.parametrize("kind", ["insert", "delete", "both"])
def test_op3_survives_insertions_and_deletions(spark, kind):
    rng = random.Random(hash(kind) % 97)
    items, docs = [], []
    for k, size in enumerate([24, 30, 60, 120, 260]):
        items.append(words(rng, size))
        for moved in (4, 5, 10, 100):
            body, at = list(items[k]), size // 2 + rng.randint(-2, 2)
            if kind != "delete":
                body[at:at] = words(rng, moved)
            if kind != "insert":
                cut = min(moved, size // 4)
                start = rng.randint(0, 3)
                del body[start : start + cut]
            docs.append((k, [*words(rng, 80), *body, *words(rng, 40)]))
    docs += [(None, words(rng, 300)) for _ in range(20)]
    # half of one item and half of another are neither
    docs.append((None, items[3][:55] + items[4][:110]))
    frame = spark.createDataFrame([(i, " ".join(t)) for i, (_, t) in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.op3(frame, bench).collect()}
    chains = {(i, k): longest_chain(item, text) for i, (_, text) in enumerate(docs) for k, item in enumerate(items)}
    assert got == {pair for pair, (n, of) in chains.items() if n >= decontamination.COVERAGE * of}
    assert kind == "both" or {(i, k) for i, (k, _) in enumerate(docs) if k is not None} <= got
    assert decontamination.decontaminate(frame, bench).count() == len(docs) - len({d for d, _ in got})


def test_op3_short_items_anywhere(spark):
    docs = spark.createDataFrame([(1, " ".join(words(random.Random(1), 200)) + " capital of peru is lima"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "Capital of Peru is Lima")], "item_id long, text string")
    assert decontamination.leaks(docs, bench).count() == 0
    assert [tuple(r)[:2] for r in decontamination.leaks(docs, bench, short_share=0.0).collect()] == [(1, 5)]
    assert decontamination.decontaminate(docs, bench, short_share=0.0).count() == 1


def test_op6_deals_equal_rows_evenly(spark, monkeypatch):
    """Rows that agree in id and size are as many blocks as others."""
    rows = spark.range(20_000).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "'a' source")
    rows = rows.unionByName(spark.range(6_000).selectExpr("id % 3 as doc_id", "'one two three' text", "'b' source"))
    seen = cube_mixing.with_targets(rows)
    for name, n in (("a", 20_000), ("b", 6_000)):
        blocks = seen.where(seen.source == name).selectExpr(f"pmod(xxhash64(rank, 0), {-(-n // cube_mixing.BLOCK)}) as block").groupBy("block").count().collect()
        assert sum(r["count"] for r in blocks) == n and max(r["count"] for r in blocks) <= 2 * cube_mixing.BLOCK
    again = cube_mixing.with_targets(rows.repartition(7))
    assert sorted(map(tuple, seen.select("source", "rank").collect())) == sorted(map(tuple, again.select("source", "rank").collect()))


def test_op6_balances_documents_too(corpus):
    """Of each source, the share of documents taken is near the ratio of target and size, not only the share of words."""
    for r in cube_mixing.mix(corpus).where("source_size > 0").groupBy("source").agg({"copies": "sum", "*": "count", "target": "max", "source_size": "max"}).collect():
        assert abs(r["sum(copies)"] - r["count(1)"] * r["max(target)"] / r["max(source_size)"]) <= 3


def test_op2_sample_is_bounded_by_labels(spark, monkeypatch):
    docs = spark.range(4_000).selectExpr("id % 4 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    taken = []
    monkeypatch.setattr(quality_mil.GatedAttention, "gradients", lambda self, X, owner, n, *a: taken.append(n) or {})
    quality_mil.fit(docs, labels, epochs=1)
    assert sum(taken) <= 4 and util.held_out() is not None
