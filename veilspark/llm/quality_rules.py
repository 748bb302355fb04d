"""Operator 10: quality rules and n-gram perplexity bands.

Rules count words, symbols, repeated lines and repeated three-word windows of each whole text. A
language model then judges what the rules let through: a modified Kneser-Ney model of byte ``ORDER``-grams for
each language, counted by Spark over all documents. (Byte grams, because word grams of a corpus do not fit
the disk that this operator may use: almost every word trigram is new. Counts are summed in each task first, so what is shuffled
is each task's distinct grams.)

Discounts, continuation counts, probabilities and back-off weights are computed by joins, order by order; nothing of
it goes to the driver but the counts of counts. The finished entries are hashed, sorted by hash and stored as
plain arrays, range-partitioned, in the shared folder. A worker reads them once and looks a gram up by the
top bits of its hash and a short scan.

No document is judged by its own counts: a hash of the text puts it into one of two halves, each half of a language has a
model, and a document is scored by that of the other half. Equal texts are in one half.

Each model has its own band of log perplexity about the median of what it scores and what passes the rules. The mean over n bytes
strays as 1 / sqrt(n), so the band of a text of n bytes is ``BAND`` robust deviations of (log perplexity - median) * sqrt(n)
wide on either side, divided by sqrt(n). Both come from histograms; documents outside either end are rejected.

Defined cases: null text = empty (no words, fails the rules, perplexity null); null lang is a language of its own; models
whose deviation is 0 have the width ``LEAST_WIDTH`` (so has a language with texts in one half only: nothing is known of it);
repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.util import PrefixHash, chunked, lean, materialize, mix64, new_path, open_uri, rename_uri, shuffle_parts, small_batches, text_bytes, word_bounds

ORDER = 5
BAND = 4.0
LEAST_WIDTH = 0.2  # in nats of log perplexity, on either side of the median, where the deviation is 0
MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of words
#: A task hands on its counts beyond so many distinct grams.
FLUSH = 400_000
#: Bytes of text scored at a time; look-ups take some hundred bytes each.
SCORE_BYTES = 1 << 18
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HASH = PrefixHash(5)


def grams(buf: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed gram that ends at each byte; a document begins behind ``order - 1`` line ends."""
    n = len(off) - 1
    pad = order - 1
    shifted = np.full(len(buf) + pad * n, 10, np.uint64)
    where = np.arange(len(buf)) + pad * (np.repeat(np.arange(n), np.diff(off)) + 1)
    shifted[where] = buf
    code = np.zeros(len(buf), np.uint64)
    for k in range(order):
        code = (code << np.uint64(8)) | shifted[where - pad + k]
    return code


def _count(languages_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            g, c = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(c)], ["lang", "gram", "c"])

        for batch in batches:
            buf, off = text_bytes(batch.column(text_at))
            names = np.array([x or "" for x in batch.column(languages_at).to_pylist()], object)
            for lo, hi in chunked(off):
                code = grams(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                owner = np.repeat(np.arange(lo, hi), np.diff(off[lo : hi + 1]))
                for lang in sorted(set(names[lo:hi])):
                    g, c = np.unique(code[(names == lang)[owner]], return_counts=True)
                    if lang in held:
                        g = np.concatenate([held[lang][0], g])
                        c = np.concatenate([held[lang][1], c])
                        g, at = np.unique(g, return_inverse=True)
                        c = np.bincount(at, c, minlength=len(g)).astype(np.int64)
                    held[lang] = g, c.astype(np.int64)
                    if len(g) > FLUSH:
                        yield rows(lang)
        for lang in sorted(held):
            yield rows(lang)

    return run


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram (packed bytes), c: over every byte of every text."""
    small_batches(docs.sparkSession)
    told = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").where(F.length("text") > 0)
    return told.mapInArrow(lean(_count(0, 1)), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the counts of counts."""
    n = [counts.get(k, 0) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


def entry_hash(gram: np.ndarray, lang: int, order: int, context: bool) -> np.ndarray:
    return mix64(gram.astype(np.uint64) * np.uint64(64) + np.uint64(order * 2 + context) + np.uint64(lang * 0xC2B2AE3D27D4EB4F % 2**64))


def build(docs: DataFrame) -> tuple[str, list[str]]:
    """Count, smooth and store the model; returns its folder and its languages (their order is part of the hashes)."""
    spark = docs.sparkSession
    top = materialize(count_grams(docs), "grams")
    languages = sorted(r.lang for r in top.select("lang").distinct().collect())
    tables = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer grams with this ending
        tables[n] = materialize(tables[n + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * n) - 1).alias("gram")).agg(F.count("*").alias("c")), f"grams{n}")
    stats: dict[tuple[str, int], dict[int, int]] = {}
    for n, t in tables.items():
        for r in t.where(F.col("c") <= 4).groupBy("lang", "c").count().collect():
            stats.setdefault((r.lang, n), {})[r.c] = r["count"]
    lower, entries = None, None
    for n in range(1, ORDER + 1):
        d = [(lang, *discounts(stats.get((lang, n), {}))) for lang in languages]
        # one row a language
        dd = F.broadcast(spark.createDataFrame(d, "lang string, d1 double, d2 double, d3 double"))
        rows = tables[n].join(dd, "lang").withColumn("context", F.shiftright("gram", 8)).withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        rows = rows.select("lang", "gram", "context", (F.col("c") - F.col("d")).alias("mass")).join(contexts, ["lang", "context"])
        if n == 1:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (n - 1)) - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        lower = materialize(rows.select("lang", "gram", (F.col("mass") / F.col("total") + F.col("gamma") * F.col("below")).alias("p")), f"p{n}")
        made = lower.select("lang", F.lit(n).alias("n"), F.lit(False).alias("context"), "gram", F.log("p").cast("float").alias("value")).unionByName(
            contexts.select("lang", F.lit(n).alias("n"), F.lit(True).alias("context"), F.col("context").alias("gram"), F.log("gamma").cast("float").alias("value"))
        )
        entries = made if entries is None else entries.unionByName(made)
    uri = new_path(spark, "kneser-ney")
    number = {lang: i for i, lang in enumerate(languages)}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([number[x] for x in b.column(0).to_pylist()], np.uint64)
            g, n, c = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 1, 2))
            h = mix64(g.astype(np.uint64) * np.uint64(64) + (n * 2 + c).astype(np.uint64) + lang * np.uint64(0xC2B2AE3D27D4EB4F))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(4)], ["h", "value"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            h, v = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h)
            name = f"{uri}/{uuid4().hex}"
            with open_uri(name + ".open", "wb") as f:
                f.write(len(h).to_bytes(8, "little") + h[order].tobytes() + v[order].astype(np.float32).tobytes())
            rename_uri(name + ".open", name + ".kn")
            yield pa.RecordBatch.from_pydict({"path": [name + ".kn"], "first": pa.array([int(h[order][0] >> np.uint64(1))], pa.int64())})

    sharded = entries.mapInArrow(lean(hashed), "h long, value float").repartition(shuffle_parts(spark), F.shiftrightunsigned("h", 40))
    files = materialize(sharded.mapInArrow(lean(store), "path string, first long"), "kneser-ney-files")
    return ",".join(r.path for r in files.orderBy("path").collect()), languages


class KneserNey:
    """Sorted hash arrays with an index over the top bits."""

    loaded: dict[str, KneserNey] = {}

    def __init__(self, paths: str, languages: list[str]) -> None:
        self.languages = {x: i for i, x in enumerate(languages)}
        keys, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        for path in filter(None, paths.split(",")):
            with open_uri(path, "rb") as f:
                data = f.read()
            n = int.from_bytes(data[:8], "little")
            keys.append(np.frombuffer(data, np.uint64, n, 8))
            values.append(np.frombuffer(data, np.float32, n, 8 + 8 * n))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.uint64(2**64 - 1)), np.append(values[order], np.float32(0))
        self.bits = max(1, int(np.log2(max(2, len(keys)))))
        self.starts = np.searchsorted(self.keys[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)

    @classmethod
    def open(cls, paths: str, languages: list[str]) -> KneserNey:
        if paths not in cls.loaded:
            cls.loaded.clear()
            cls.loaded[paths] = cls(paths, languages)
        return cls.loaded[paths]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values by hash, NaN where there is none."""
        out = np.full(len(h), np.nan, np.float32)
        at = self.starts[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        todo = np.arange(len(h))
        while len(todo):
            k = self.keys[at]
            same = k == h[todo]
            out[todo[same]] = self.values[at[same]]
            go = k < h[todo]
            todo, at = todo[go], at[go] + 1
        return out

    def log_probability(self, code: np.ndarray, lang: int) -> np.ndarray:
        """Natural logarithm of each gram's last byte given the bytes before."""
        total, todo = np.zeros(len(code), np.float32), np.arange(len(code))
        for n in range(ORDER, 0, -1):
            g = code[todo] & np.uint64((1 << 8 * n) - 1)
            v = self.find(entry_hash(g, lang, n, False))
            hit = ~np.isnan(v)
            total[todo[hit]] += v[hit]
            todo, g = todo[~hit], g[~hit]
            if not len(todo):
                return total
            w = self.find(entry_hash(g >> np.uint64(8), lang, n, True))
            total[todo] += np.nan_to_num(w)
        total[todo] += np.float32(np.log(1 / 256))
        return total


def rule_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    n = len(off) - 1
    s, e, before = word_bounds(buf, off)
    row = np.repeat(np.arange(n), np.diff(before))
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    inside = np.zeros(len(buf) + 1, np.int64)
    np.add.at(inside, s, 1)
    np.add.at(inside, e, -1)
    in_word = np.cumsum(inside)[:-1] > 0
    h = _HASH.load(buf)
    out = {"n_words": np.diff(before), "word_chars": total(in_word & ((buf & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[buf])}

    ends = np.sort(np.concatenate([np.flatnonzero(buf == 10), off[1:]]))
    # a line begins behind a line end or at a row's start
    starts = np.sort(np.concatenate([np.flatnonzero(buf == 10) + 1, off[:-1]]))
    line_row = np.searchsorted(off[1:], np.minimum(starts, ends), side="right")
    word_before = np.concatenate([[0], np.cumsum(in_word)])
    full = np.flatnonzero((ends > starts) & (word_before[np.maximum(ends, starts)] > word_before[starts]))
    lh, lr = h.of(starts[full], ends[full]), line_row[full]
    order = np.lexsort((lh, lr))
    again = (lh[order[1:]] == lh[order[:-1]]) & (lr[order[1:]] == lr[order[:-1]]) if len(full) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(lr[order[1:]][again], minlength=n) if len(full) else np.zeros(n, np.int64)

    covered = np.zeros(len(s) + 3, bool)
    if len(s) >= 3:
        w = h.of(s, e)
        w3 = mix64(w[:-2] * np.uint64(3) + mix64(w[1:-1] * np.uint64(5) + mix64(w[2:])))
        ok = np.flatnonzero(row[:-2] == row[2:])
        order = ok[np.lexsort((w3[ok], row[ok]))]
        same = (w3[order[1:]] == w3[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        hits = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        for k in range(3):
            covered[hits + k] = True
    out["n_repeat_words"] = np.bincount(row[covered[: len(s)]], minlength=n) if len(s) else np.zeros(n, np.int64)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def folded(docs: DataFrame, other: bool) -> DataFrame:
    """``docs`` with ``model``: language and half of the row, or the ``other`` half. Equal texts are in one half."""
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    return docs.withColumn("model", F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), (1 - half if other else half).cast("string")))


def score(docs: DataFrame, model: tuple[str, list[str]]) -> DataFrame:
    """doc_id, lang, the rule counts, base_failed, log_perplexity (of a byte, by the model of the other half; null without text)."""
    small_batches(docs.sparkSession)
    paths, languages = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kn = KneserNey.open(paths, languages)
        for batch in batches:
            buf, off = text_bytes(batch.column(2))
            names = np.array(batch.column(3).to_pylist(), object)
            cols, ppl = {k: [] for k in COUNTS}, []
            for lo, hi in chunked(off, SCORE_BYTES):
                part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                for k, v in rule_counts(part, o).items():
                    cols[k].append(v)
                owner = np.repeat(np.arange(hi - lo), np.diff(o))
                code, logp = grams(part, o), np.zeros(len(part), np.float32)
                for lang in sorted(set(names[lo:hi])):
                    own = np.flatnonzero((names[lo:hi] == lang)[owner])
                    logp[own] = kn.log_probability(code[own], kn.languages.get(lang, len(languages)))
                ppl.append(-np.bincount(owner, logp, minlength=hi - lo) / np.maximum(1, np.diff(o)))
            if batch.num_rows:
                ppl = np.concatenate(ppl)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.concatenate(cols[k]).astype(np.int64)) for k in COUNTS), pa.array(ppl, mask=np.diff(off) == 0), pa.array(np.diff(off)), batch.column(3)], ["doc_id", "lang", *COUNTS, "log_perplexity", "n_bytes", "model"])

    out = folded(docs, other=True).select("doc_id", "lang", "text", "model").mapInArrow(lean(run), f"doc_id long, lang string, {', '.join(f'{k} long' for k in COUNTS)}, log_perplexity double, n_bytes long, model string")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _middles(bins: DataFrame) -> dict[str, int]:
    """The median bin of each model from rows of model and bin."""
    rows, out = bins.groupBy("model", "bin").count().collect(), {}
    for model in sorted({r.model for r in rows}):
        b = np.array(sorted((r.bin, r["count"]) for r in rows if r.model == model))
        out[model] = int(b[np.searchsorted(np.cumsum(b[:, 1]), b[:, 1].sum() / 2), 0])
    return out


def bands(scored: DataFrame) -> DataFrame:
    """band_model, median, deviation (of a text of one byte): from histograms, at most some thousand bins a model."""
    spark = scored.sparkSession
    passed = scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    median = {m: x / 1000 for m, x in _middles(passed.select("model", F.round(F.col("log_perplexity") * 1000).cast("int").alias("bin"))).items()}
    about = F.broadcast(spark.createDataFrame(list(median.items()), "model string, median double"))  # one row a model
    strays = F.abs(F.col("log_perplexity") - F.col("median")) * F.sqrt("n_bytes")
    # steps of a hundredth part; what lies within the rounding of the median counts as no deviation
    bins = F.when(strays > 0.001 * F.sqrt("n_bytes"), F.round(F.log(strays) * 100).cast("int")).otherwise(-10_000)
    away = _middles(passed.join(about, "model").select("model", bins.alias("bin")))
    rows = [(m, median[m], 1.4826 * float(np.exp(away[m] / 100)) if away[m] > -10_000 else 0.0) for m in sorted(median)]
    return spark.createDataFrame(rows, "band_model string, median double, deviation double")


def judge(docs: DataFrame) -> DataFrame:
    """Rule counts, perplexity, the language's band, and ``kept``."""
    model = build(folded(docs, other=False).select(F.col("model").alias("lang"), "text"))
    scored = materialize(score(docs, model), "scored")
    limits = F.broadcast(bands(scored))  # one row a model
    reach = F.when(F.col("deviation") > 0, BAND * F.col("deviation") / F.sqrt(F.greatest("n_bytes", F.lit(1)))).otherwise(LEAST_WIDTH)
    judged = scored.join(limits, F.col("model") == F.col("band_model"), "left").withColumns({"low": F.col("median") - reach, "high": F.col("median") + reach})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & inside)


def rejected_shares(judged: DataFrame) -> DataFrame:
    """Per language: documents, those that pass the word rules, and the shares of these that lie below and above the band."""
    passed = ~F.col("base_failed")
    share = lambda outside: F.count_if(passed & outside) / F.nullif(F.count_if(passed), F.lit(0))
    return judged.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(passed).alias("passed_rules"), share(F.col("log_perplexity") < F.col("low")).alias("too_plain"), share(F.col("log_perplexity") > F.col("high")).alias("too_strange"),
    )


def op10(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "lang", "text")).select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity", "low", "high")
