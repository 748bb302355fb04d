"""What op7 moves and leaves on disk: rows of lists without a partner, shuffle files, intermediate tables."""

import os
import random
import re
import time

import numpy as np

from tests.llm.test_text_operators import brute_sets
from veilspark.llm import jaccard_join


def lists(rng, sizes):
    """Rows of inverted lists (places within the prefix) and of subsets (no place), some of them twice."""
    rows = []
    for token in range(60):
        for key in rng.sample(range(10_000), rng.choice([1, 2, 2, 3, 5, 40])):
            n = rng.choice(sizes)
            row = (token, key, n, rng.choice([-1, 0, rng.randrange(jaccard_join.prefix_length(n)), rng.randrange(jaccard_join.prefix_length(n))]))
            rows += [row] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


def may_link(a, b):
    """The filters of a pair as the scan has them: by size in subsets, by size and place in lists."""
    if a[0] != b[0] or a[1] == b[1] or (a[3] < 0) != (b[3] < 0):
        return False
    least = jaccard_join.need(a[2], b[2])
    return least <= min(a[2] - max(a[3], 0), b[2] - max(b[3], 0))


def test_op7_lists_keep_rows_with_a_partner_only():
    rng = random.Random(3)
    for sizes in ([4, 5, 6, 7, 9, 12], [50, 55, 60, 63, 70, 90], [1, 2, 3, 5, 200, 240, 251, 1000]):
        rows = lists(rng, sizes)
        table = np.array(rows, jaccard_join.ROW)
        got = {tuple(r.values()) for b in jaccard_join._shared(table, np.zeros(0, np.uint64)) for r in b.to_pylist()}
        want = {r for r in rows if any(may_link(r, other) for other in rows)}
        assert got == want and 0 < len(want) < len(set(rows))


def test_op7_leaves_no_shuffle_files_or_large_tables(spark, corpus, monkeypatch):
    blocks = lambda: set(re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString()))
    made, materialize = [], jaccard_join.materialize

    def noted(df, what):
        made.append((what, out := materialize(df, what)))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = blocks(), spark.conf.get(name, None)
    result = jaccard_join.op7(corpus)
    assert spark.conf.get(name, None) == setting
    end = time.time() + 10
    while len(blocks() - before) > 2 and time.time() < end:  # those of two small aggregates may still be there
        time.sleep(0.2)
    assert len(blocks() - before) <= 2
    assert {"sets", "reps", "lists", "signs", "texts"} <= {what for what, _ in made}
    there = [what for what, t in made if os.path.exists(t.written_to.removeprefix("file:").replace("//", "/"))]
    assert not {"sets", "reps", "lists", "signs", "texts"} & set(there) and "keys" in there
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result.collect()} == brute_sets([(r.doc_id, r.text) for r in corpus.collect()])


def test_op7_sizes_and_places_at_the_border(spark):
    """Sets just at, over and below 0.8, of equal and of different sizes, with what differs at any place."""
    rng = random.Random(8)
    texts = []
    for group, n in enumerate([9, 14, 30, 44, 84, 140, 300]):
        base = [f"g{group}w{i}" for i in range(n)]
        texts.append(base)
        for _ in range(6):
            texts.append(base[: round(n * rng.choice([0.78, 0.8, 0.81, 0.82, 0.9]))])
            texts.append(base + [f"new{rng.random()}" for _ in range(round(n * rng.choice([0.1, 0.23, 0.25, 0.26])))])
            changed = list(base)
            for at in rng.sample(range(n), max(1, round(n * rng.choice([0.01, 0.02, 0.025, 0.03])))):
                changed[at] = f"new{rng.random()}"
            texts.append(changed)
    docs = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op7(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_sets(sorted(docs))
