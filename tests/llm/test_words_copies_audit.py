"""Operators 11 to 13 against plain Python; null, empty, long, repeated and clashing input; whole tables against their SQL."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from veilspark.llm import exact_dedup, filter_audit, queries, spelling_groups

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_spelling", "op12_exact_dedup", "op13_filter_audit"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    mine = queries.queries()[name](spark, SF)
    assert sorted(mine.columns) == sorted(columns)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(mine.select(*columns).collect()) == key(result.fetchall())


# operator 11


def near(a, b):
    """One inserted, deleted or replaced character."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def brute_groups(n):
    """{word: (form, root, n, n_near, form_n)} of counted words."""
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None)
    return out


def brute_words(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def grouped(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_op11_equals_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdéÀßo") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(stems).replace("o", "O", rng.randint(0, 1)) + rng.choice(["", "", "s", "'", "9", "é"]) for _ in range(400)) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1), (3, texts[0], 1), (3, texts[0], 1), (70, None, 1), (71, "", 1), (72, "straße" * 40_000, 1)]
    want = brute_groups(brute_words([r[:2] for r in rows]))
    got = grouped(spelling_groups.op11(spark.createDataFrame(rows, "doc_id long, text string, word int")))
    assert got == want and sum(v[0] is not None for v in want.values()) > 5 and len(want) > 100


def test_op11_dense_words_and_chains(spark):
    """All words of six letters over two, where bigrams repeat within words and a pair survives only in one of them; and long chains of forms."""
    rng = random.Random(4)
    words = {"".join(w) for k in (6, 7) for w in itertools.product("ab", repeat=k)}
    n = {w: rng.choice([5, 6, 30, 31, 200, 5000]) for w in sorted(words)}
    chain = ["mmmmmm" + "nopqrstuv"[:k] for k in range(9)]
    n |= {w: 5 * 5**k for k, w in enumerate(chain)}
    n |= {"zwölfzig": 10, "zwölfzug": 50, "zwölfzag": 50, "×÷×÷×÷": 7, "×÷×÷××": 7}
    words = spelling_groups.materialize(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    got = grouped(spelling_groups.group_words(words))
    assert got == brute_groups(n)
    assert got[chain[0]][1] == chain[-1] and got["zwölfzig"][0] == "zwölfzag"


def test_op11_words_about_the_long_ones(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcde") for _ in range(64))
    words = {base[:k] for k in range(60, 65)} | {base + x for x in ("", "a", "ab", "ba")} | {"z" + base, "z" + base[1:], base[:40] + "z" + base[40:], base[:63] + "z", "ab" * 31 + "a", "ab" * 32, "ab" * 31 + "b", "ba" * 31}
    n = {w: rng.choice([5, 30, 200]) for w in sorted(words)}
    table = spelling_groups.materialize(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    assert grouped(spelling_groups.group_words(table)) == brute_groups(n)


def test_op11_long_words_and_nothing(spark, empty):
    long = "ab" * 150_000
    df = spark.createDataFrame([(i, f"{long}c {long}d") for i in range(5)], "doc_id long, text string")
    got = {w[-1]: v[3] for w, v in grouped(spelling_groups.spelling_groups(df)).items()}
    assert got == {"c": 1, "d": 1}
    assert grouped(spelling_groups.op11(empty)) == {}


# operator 12


def brute_copies(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) of (doc_id, text)."""
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for s, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    head = "same beginning " * 40
    texts = ["one two", "o n e\ttwo", "onetwo", "one  two\n", None, "", " \x0b\x0c\r", "é🙂 x", "é🙂x", "éx", "éx", "x y", "xy"]
    texts += [head + "a b", head + "c d", head + "ab", head + "a  b", "z" * 300_000, "z" * 299_999 + " z", "y" * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, "one two"), (None, "one two"), (3, "one two"), (3, "one  two\n"), (0, "only once here"), (None, "nobody's")]


@pytest.mark.parametrize("most_groups", [exact_dedup.MOST_GROUPS, 0])
def test_op12_equals_brute_force(spark, monkeypatch, most_groups):
    copies = exact_dedup.copies
    monkeypatch.setattr(exact_dedup, "copies", lambda rows, key: copies(rows, key, most_groups))
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, keep_id string, hash string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op12(df).collect()), key=str)
    assert got == brute_copies(rows)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in kept_rows(rows)), key=str)


def kept_rows(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i, t))
    return [min(m, key=lambda x: x[:3])[3:] for m in groups.values()]


def test_op12_hot_groups_and_unique_ids(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"pair {i // 2 * 2}" if i % 3 == 1 else f"alone {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op12(df).collect()), key=str)
    assert got == brute_copies(rows)


def test_op12_and_op13_are_native(spark, corpus):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (exact_dedup.op12(corpus), filter_audit.op13(corpus, labels)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_op12_of_nothing(empty):
    assert exact_dedup.op12(empty).collect() == [] and exact_dedup.drop_copies(empty).collect() == []


# operator 13


def brute_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failing = collections.defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])) if x}
        mine = [x for x in labels if x[0] == i and i is not None]
        failing[source or ""].append((fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, collections.Counter()
    for part, rows in failing.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                out[part, order, k] = (len(stay), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
                shapley[part, f] += len(gone)
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_op13_equals_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(70):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, rng.choice([5, 500]))) for _ in range(rng.randint(30, 90))]
        t = " ".join(w) + rng.choice(["", "", " # "])
        texts.append(t.upper() if rng.random() < 0.2 else t)
    docs = [(i, rng.choice(texts), rng.choice(["s1", "s2", "s2", "s2", None, ""])) for i in range(150)]
    docs += [(None, texts[0], "s1"), (7, texts[1], "s1"), (7, texts[1], "s1"), (200, None, "s1"), (201, "", "s1"), (202, " \n\x0b", None), (203, "A" * 100_000, "s1"), (204, "Ab cd " * 30_000, "s9")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(i, t, s, 5, "x") for i, t, s in docs], "doc_id long, text string, source string, mask int, hash string").repartition(3)
    got = audited(filter_audit.op13(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(docs, labels)
    assert len(got) == 4 * 600


def test_op13_of_nothing(spark, empty):
    assert filter_audit.op13(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
