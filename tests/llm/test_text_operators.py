"""Operators on texts against plain-Python versions; null, empty, repeated and clashing input."""

import collections
import fractions
import hashlib
import random
import re

import numpy as np

from veilspark.llm import cube_mixing, decontamination, jaccard_join, language_id, line_templates, pii_spans, quality_mil, quality_rules, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return df.collect()


def brute_substrings(docs):
    seen, out = set(), {}
    for doc_id, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def test_op1_equals_brute_force(corpus):
    want = brute_substrings([(r.doc_id, r.text) for r in sorted(rows_of(corpus), key=lambda r: r.doc_id)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(suffix_dedup.op1(corpus))}
    assert got == want


def test_op1_split_by_offset(corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 1)
    want = brute_substrings([(r.doc_id, r.text) for r in sorted(rows_of(corpus), key=lambda r: r.doc_id)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(suffix_dedup.op1(corpus))}
    assert got == want


def test_op1_repeated_and_null_ids(spark):
    text = "abcdefghij" * 5 + "klmnopqrst" * 6
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in rows_of(suffix_dedup.op1(df)))
    removed = sorted(x[2] for x in got)
    assert removed[:2] == [0, 0] and removed[2:] == [len(text)] * 2
    assert [x[2] for x in got if x[0]] == [len(text)]


def test_levels_stay_logarithmic():
    family, rng = suffix_dedup.Levels(), np.random.default_rng(0)
    seen = set()
    for _ in range(40):
        keys = rng.integers(0, 5000, 200).astype(np.uint64)
        want = []
        for k in keys.tolist():
            want.append(k in seen)
            seen.add(k)
        assert family.add(keys).tolist() == want
    assert len(family.levels) <= 10 and len(family) == len(seen)


def test_levels_of_two_halves():
    family, rng, seen = suffix_dedup.Levels(), np.random.default_rng(1), set()
    for _ in range(40):
        keys, more = rng.integers(0, 40, 200).astype(np.uint64), rng.integers(0, 90, 200).astype(np.uint64)
        want = []
        for k in zip(keys.tolist(), more.tolist()):
            want.append(k in seen)
            seen.add(k)
        assert family.add(keys, more).tolist() == want
    assert len(family) == len(seen)


def test_op1_split_by_window(corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 1)
    monkeypatch.setattr(suffix_dedup, "SPAN", 2)  # in the driver only: contexts of three and more are cut to windows
    want = brute_substrings([(r.doc_id, r.text) for r in sorted(rows_of(corpus), key=lambda r: r.doc_id)])
    rows = suffix_dedup.ranked(corpus).where("text is not null").selectExpr("rank", "text", "array(named_struct('anchor', 1L, 'salts', 99, 'lo', 0, 'width', 5, 'lead', 0S)) noted").where("length(text) > 200")
    cut = list(suffix_dedup._cut_contexts(iter(rows.toArrow().to_batches())))
    assert all(b.num_rows == 6 and set(b.column(2).to_pylist()) == {1} for b in cut) and len({x for b in cut for x in b.column(1).to_pylist()}) > 6
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(suffix_dedup.op1(corpus))}
    assert got == want


def brute_sets(docs):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for i, t in docs:
        w = WORD.findall(fold(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_op7_equals_brute_force(corpus):
    want = brute_sets([(r.doc_id, r.text) for r in rows_of(corpus)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows_of(jaccard_join.op7(corpus))} == want


def test_op7_light_sets_meet_by_subsets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "boundary", lambda sketch: 10)
    base = "a b c d e f g h i j k l".split()
    texts = [" ".join(base), " ".join(base + ["m"]), " ".join(["z"] + base), " ".join(base[:9]), " ".join(base + ["m", "n", "o"]), "q r s t u v w"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows_of(jaccard_join.op7(df))} == brute_sets(list(enumerate(texts)))


def test_op7_keep_one(corpus):
    want = brute_sets([(r.doc_id, r.text) for r in rows_of(corpus)])
    kept = jaccard_join.keep_one(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in rows_of(kept)) == sorted(i for i, (_, c) in want.items() if c == i)


def test_op7_keep_one_judges_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "changed")
    clean, lone, nameless = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(5, text), (5, text), (None, text), (7, near), (7, clean), (8, lone), (None, nameless), (None, nameless), (None, None), (None, "")]
    got = sorted(((r.doc_id, r.text) for r in rows_of(jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")))), key=str)
    assert got == sorted([(5, text), (7, clean), (8, lone), (None, nameless), (None, None), (None, "")], key=str)


def test_op5_drops_recurring_templates(spark):
    texts = [f"Title number {i}\nShared header line of the site\nown words {'abcdefgh'[i]} {'ijklmnop'[i]} here {'qrstuvwx'[i]}\n\nPosted by user{i} on day {i}" for i in range(5)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9, None, "x"), (10, "", "x")], "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in rows_of(line_templates.op5(df))}
    assert got[0].text == texts[0] and got[0].n_dropped == 0
    for i in range(1, 5):
        assert got[i].text == "own words {} {} here {}\n".format("abcdefgh"[i], "ijklmnop"[i], "qrstuvwx"[i]) and got[i].n_dropped == 3
    assert got[9].text is None and got[9].n_lines == 0 and got[10].text == "" and got[10].n_lines == 1


def test_op5_judges_rows(spark):
    same = "header of the whole site here"
    rows = [(1, f"{same}\nunique words"), (1, f"another unique opening\n{same}\nclosing text"), (None, f"x y\n{same}"), (None, f"z w\n{same}"), (None, None), (3, same), (3, same)]
    df = spark.createDataFrame([(d, t, "kept") for d, t in rows], "doc_id long, text string, dropped_lines string")
    got = rows_of(line_templates.drop_lines(df))
    texts = sorted(((r.doc_id, r.text) for r in got), key=str)
    # in the order of doc_id, then text, the first row keeps the line
    assert texts == sorted([(1, "another unique opening\nheader of the whole site here\nclosing text"), (1, "unique words"), (None, "x y"), (None, "z w"), (None, None), (3, ""), (3, "")], key=str)
    assert {r.dropped_lines for r in got} == {"kept"} and sum(r.n_dropped for r in got) == 5


def test_op5_odd_lines(spark):
    long = "z" * 200_000
    rows = [(i, f"  page\t{i}  of \x0b the   book  \n{long}\n{' ' * 100_000}\nown {'abcdef'[i]}") for i in range(4)]
    got = {r.doc_id: r for r in rows_of(line_templates.op5(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[0].text == rows[0][1] and all(got[i].text == f"{' ' * 100_000}\nown {'abcdef'[i]}" for i in (1, 2, 3))


def test_op5_is_native(spark, corpus):
    for df in (line_templates.op5(corpus), pii_spans.op4(corpus)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_op4_spans_and_scores(spark):
    text = "🙂 mail a.b@c.org, server 10.0.0.255 or 10.0.0.256; card 4111 1111 1111 1111 call +44 20 7946 0958; IBAN GB82 WEST 1234 5698 7654 32"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "9" * 100_000 + " a@b.c_d@e.f")], "doc_id long, text string")
    got = {r.doc_id: r for r in rows_of(pii_spans.op4(df))}
    r = got[1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_iban) == (1, 1, 1, 1, 1)
    at = lambda v: f"{text.index(v)}:{text.index(v) + len(v)}"
    base = [f"email:{at('a.b@c.org')}", f"ip:{at('10.0.0.255')}", f"card:{at('4111 1111 1111 1111')}", f"phone:{at('+44 20 7946 0958')}"]
    assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert r.spans == ",".join([*base, f"iban:{at('GB82 WEST 1234 5698 7654 32')}"])
    assert "card:" in r.scores and r.scores.split(",")[2].endswith(":85")
    assert got[2].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].n_email == 2
    masked = {r.doc_id: r.text for r in rows_of(pii_spans.mask_pii(df))}
    assert masked[1].startswith("🙂 mail [email], server [ip] or 10.0.0.256; card [card] call [phone]") and masked[2] is None


def test_op4_cuts_ibans_to_their_length(spark):
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    cases = [(f"{gb} BIC ABCD", [gb]), ("GB82WEST12345698765432 20 EUR", ["GB82WEST12345698765432"]), (f"{de} IBAN", [de]), (f"{gb} {de} EUR", [gb, de]), (f"IT12 {de} X", [de]), (f"AB12 {gb}", [gb]), (f"GB82 WEST 1234 5698 7654 33 {de}", [de]), (f"{gb}A", []), ("AB12 CD", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in rows_of(pii_spans.find_pii(df)):
        text, want = cases[r.doc_id]
        assert [(s.start, s.end, s.value) for s in r.pii_iban] == [(text.index(v), text.index(v) + len(v), v) for v in want]


def brute_rules(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_op10_counts_and_bands(corpus):
    got = rows_of(quality_rules.op10(corpus))
    texts = {r.doc_id: r.text for r in rows_of(corpus)}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert (r.log_perplexity is None) == (not texts[r.doc_id])
    assert sum(r.kept for r in got) > 0


def test_op10_rejects_at_both_ends(spark):
    rng = random.Random(11)
    syllables = ("ba", "ce", "di", "fo", "gu", "lan", "mer", "nis", "tor", "vul")
    words = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(2, 3))) for _ in range(600)})
    after = {w: rng.sample(words, 8) for w in words}  # prose: each word has eight successors

    def prose(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    def shuffled(n):
        out = prose(n).split()
        rng.shuffle(out)
        return " ".join(out)

    boilerplate = prose(150)
    rows = [("clean", prose(rng.randint(60, 500))) for _ in range(300)]
    rows += [("part", f"{prose(300)}\n{boilerplate}") for _ in range(60)]
    rows += [("shuffled", shuffled(300)) for _ in range(10)]
    rows += [("letters", " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(200))) for _ in range(10)]
    rows += [("boilerplate", f"{boilerplate}\n{i}") for i in range(10)]
    docs = spark.createDataFrame([(i, "en", t) for i, (_, t) in enumerate(rows)], "doc_id long, lang string, text string")
    got, kinds = rows_of(quality_rules.op10(docs)), [k for k, _ in rows]
    assert not any(r.base_failed for r in got)
    share = collections.Counter(kinds[r.doc_id] for r in got if r.kept)
    assert share["clean"] >= 290 and share["shuffled"] + share["letters"] + share["boilerplate"] == 0, share
    (share_of,) = rows_of(quality_rules.rejected_shares(quality_rules.judge(docs)))
    assert (share_of.documents, share_of.passed_rules) == (len(rows), len(rows)) and 0.02 < share_of.too_plain < 0.1 and 0.04 < share_of.too_strange < 0.1
    for kind, high in (("shuffled", True), ("letters", True), ("boilerplate", False)):
        assert all(r.log_perplexity > r.high if high else r.log_perplexity < r.low for r in got if kinds[r.doc_id] == kind)


def test_op10_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "en", "abracadabra " * 9), (2, "en", "a cab and a crab"), (3, None, "zz")], "doc_id long, lang string, text string")
    model = quality_rules.KneserNey(*quality_rules.build(docs))
    for context in (b"abra", b"zzzz", b" cab"):
        code = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert abs(np.exp(model.log_probability(code, model.languages["en"]).astype(float)).sum() - 1) < 1e-3


def test_op3_finds_renumbered_questions(spark):
    item = "A train leaves Turin at 10 km per hour and Mario counts 25 wagons while Anna waits at the old station for 3 hours."
    other = item.replace("Mario", "Luigi").replace("10", "42").replace("25", "17").replace("Anna", "Carla")
    torn = item.replace("Mario", "Luigi").replace("Turin", "Anna")
    docs = spark.createDataFrame([(1, f"Intro words here. {item} And more."), (2, f"Before that. {other} End."), (3, "Nothing of the kind at all in this text."), (4, None), (5, ""), (6, f"So. {torn}"), (7, item.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "Too short"), (9, "Too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in rows_of(decontamination.op3(docs, bench))}
    assert {(1, 7), (2, 7)} <= got and not any(d in (3, 4, 5) for d, _ in got)
    small = {(r.doc_id, r.item_id) for r in rows_of(decontamination.leaks(docs, bench, block=1))}
    assert small == got
    bad = {d for d, _ in got}
    nameless = docs.selectExpr("cast(null as long) as doc_id", "text").unionByName(docs)
    for block in (1, 1 << 20):
        kept = decontamination.decontaminate(nameless, bench, block=block)
        assert sorted(r.doc_id for r in rows_of(kept.where("doc_id is not null"))) == sorted(set(range(1, 8)) - bad)
        assert kept.where("doc_id is null").count() == 7 - len(bad)


def test_op3_finds_copies_in_other_letter_case(spark):
    item = "A train leaves Turin at 10 km per hour and Mario counts 25 wagons while Anna waits at the old station for 3 hours."
    german = "Der Zug aus Turin bringt 25 Wagen mit Kohle und Holz in die Stadt, wo Anna am alten Bahnhof mit Kindern und Hunden wartet."
    texts = [item.upper(), item.lower(), german.upper(), f"Davor. {german.lower()} Danach.", "the train and the station of another town are old and nobody waits for it there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, german)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in rows_of(decontamination.op3(docs, bench))} == {(0, 7), (1, 7), (2, 8), (3, 8)}


def test_op3_finds_runs_of_slots(spark):
    ten = "Continue the sequence of numbers 2 3 5 7 11 13 17 19 23 29 and say which rule the next one follows."
    seven = "The results of the week were 12 15 11 19 14 18 13 as the old clerk wrote them down in the book."
    bare = "41 7 93 12 58 6 77 31 20 85"
    texts = [f"Before. {ten} After.", seven, seven.replace("19", "90").replace("12", "21"), f"Row {bare} end", "Row 5 6 8 9 10 21 22 24 25 26 27 28 end"]
    texts.append(ten.replace(" 11", " 11 12"))  # one number more
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, ten), (2, seven), (3, bare)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in rows_of(decontamination.op3(docs, bench))}
    assert set(got) == {(0, 1), (1, 2), (2, 2), (3, 3), (5, 1)}
    assert got[0, 1].slot_consistency == got[1, 2].slot_consistency == 1.0 and got[0, 1].matched_windows == got[0, 1].item_windows


def plain_tokens(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+(?:(?<=[0-9])[.,](?=[0-9])[0-9A-Za-z\u0080-\U0010ffff]+)*", text or "")


def test_op3_against_plain_windows(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    items = {r.item_id: plain_tokens(r.text) for r in bench.collect()}
    texts = {r.doc_id: plain_tokens(r.text) for r in docs.collect()}
    got = {(r.doc_id, r.item_id) for r in rows_of(decontamination.op3(docs, bench))}
    width = decontamination.WINDOW
    low = lambda tokens: [x.lower() for x in tokens]
    windows = lambda tokens: [tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1)]
    held = {i: windows(low(t)) for i, t in items.items()}
    plain = {(d, i) for d, t in texts.items() for own in [set(windows(low(t)))] for i, ws in held.items() if ws and all(w in own for w in ws)}
    assert plain and plain <= got
    # what else is found fits at least half of the item's windows if numbers, capitalised words and words behind numbers may be anything
    for d, i in got - plain:
        free = [x[0].isdigit() or x[0].isupper() or (k > 0 and items[i][k - 1][0].isdigit()) for k, x in enumerate(items[i])]
        own, item = low(texts[d]), low(items[i])
        fits = sum(any(all(free[k + j] or own[p + j] == item[k + j] for j in range(width)) for p in range(len(own) - width + 1)) for k in range(len(item) - width + 1))
        assert fits >= decontamination.COVERAGE * (len(item) - width + 1)


def test_op3_short_items_and_long_texts(spark):
    item = "The keeper of the northern lighthouse counted nineteen ships before the fog rolled in from the open sea."
    long = "some plain words of a very long text without end " * 20_000
    docs = spark.createDataFrame([(1, "Well yes indeed they came"), (2, "Yes."), (3, f"{long} {item} {long}"), (4, long)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Yes"), (2, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in rows_of(decontamination.op3(docs, bench))} == {(2, 1), (3, 2)}


def test_op2_and_op8_on_rows_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    held = [r for r in rows_of(quality_mil.op2(docs, labels)) if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    lang = {r.doc_id: r.lang for r in docs.where("lang is not null").collect()}
    held = [r for r in rows_of(language_id.op8(docs)) if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(held) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_op2_and_op8_repeated_and_long_rows(spark):
    text = "the house of the morning and the winter light over the river "
    rows = [(1, text, "en"), (1, text, "en"), (None, text, "en"), (2, text * 5000, "en"), (4, "le matin de la maison et la lumière", "fr"), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for got in (rows_of(quality_mil.op2(docs, labels)), rows_of(language_id.op8(docs))):
        assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 1}) == 1


def test_op6_meets_targets(corpus):
    got = rows_of(cube_mixing.op6(corpus))
    again = rows_of(cube_mixing.op6(corpus))
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    texts = {r.doc_id: (r.text, r.source) for r in rows_of(corpus)}
    per = collections.defaultdict(lambda: [0, 0, 0, 0.0])
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id][0] or "")) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        x = per[texts[r.doc_id][1]]
        x[0] += r.size
        x[1] += r.taken
        x[2] = max(x[2], r.size)
        x[3] = r.target
    assert len(got) == len(texts)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    want = cube_mixing.targets(np.array([per[n][0] for n in names]), np.array([(5, 2, 1)[i % 3] for i in range(len(names))]))
    for n, t in zip(names, want):
        assert abs(per[n][3] - t) < 1e-6 and abs(per[n][1] - t) <= per[n][2]


def plain_targets(sizes):
    """Shares by weight, found by trying which sources stop at three times their size (exact fractions)."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: fractions.Fraction((5, 2, 1)[i % 3]) for i, n in enumerate(names)}
    # sources stop in the order of size per weight
    order = sorted(names, key=lambda n: sizes[n] / weight[n])
    total = sum(sizes.values())
    for k in range(len(order) + 1):
        left = total - sum(3 * sizes[n] for n in order[:k])
        open_ = order[k:]
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        if all(share[n] <= 3 * sizes[n] for n in open_):
            return {n: float(share.get(n, 3 * sizes[n])) for n in names}


def test_op6_targets_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, largest = collections.Counter(), collections.Counter()
    for r in docs.collect():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    want = plain_targets(sizes)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = collections.Counter()
    for r in rows_of(cube_mixing.op6(docs)):
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)


def test_op6_repeated_and_null_rows(spark):
    rows = [(1, "a b c", "x")] * 4 + [(None, "d e", None)] * 3 + [(2, None, "x"), (2, "", "y"), (3, "f " * 9, "y")]
    got = rows_of(cube_mixing.op6(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    assert {r.doc_id for r in got if r.size == 0} == {2}


def test_op6_targets_share_out():
    assert np.allclose(cube_mixing.targets(np.array([10, 100, 100]), np.array([5, 2, 1])), [30, 120, 60])
    assert np.allclose(cube_mixing.targets(np.array([0, 0]), np.array([5, 2])), [0, 0])


def test_op6_small_blocks(corpus):
    rows = rows_of(cube_mixing.mix(corpus, block=4))
    assert len(rows) == corpus.count()


def test_op8_learns_languages(spark, corpus):
    en = ["the house of the morning and the winter light over the river", "there is nothing in the letter that they were thinking of"]
    fr = ["la maison du matin et la lumière de l'hiver sur la rivière", "il n'y a rien dans la lettre à laquelle ils pensaient"]
    rows = [(i, (en if i % 2 else fr)[i % 4 // 2] + f" {i}", "en" if i % 2 else "fr") for i in range(80)] + [(100, None, "en"), (101, "12 34", "fr"), (102, "the light", None), (103, "A.", None)]
    got = {r.doc_id: r for r in rows_of(language_id.op8(spark.createDataFrame(rows, "doc_id long, text string, lang string")))}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(80))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "en" and got[103].lang_pred in ("en", "fr")
    assert len(rows_of(language_id.op8(corpus))) == corpus.count()


def test_op2_learns_quality(spark):
    good = "Plain sentences of ordinary words go on here, with commas, and end well. "
    bad = "BUY!! NOW!! ### $$$ CLICK!! "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 7)) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(500, None, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_mil.op2(docs, labels))
    assert len(got) == 122 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 120)
    none = rows_of(quality_mil.op2(docs, labels.where("false")))
    assert {r.score for r in none} == {0.5}


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (suffix_dedup.op1(empty), quality_mil.op2(empty, labels), decontamination.op3(empty, bench), pii_spans.op4(empty), line_templates.op5(empty), cube_mixing.op6(empty), jaccard_join.op7(empty), language_id.op8(empty), quality_rules.op10(empty)):
        assert df.count() == 0
