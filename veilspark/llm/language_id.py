"""Operator 8: language identification by averaged hashed subword embeddings.

Every letter run of a text is read as ``<run>``; its byte 2-, 3- and 4-grams are hashed into
``BUCKETS`` rows of an embedding matrix. The mean row, times a linear softmax, gives language
probabilities. Both matrices are trained by stochastic gradient descent in numpy on the driver, on at
most ``TRAIN_DOCS`` labelled documents (a bound that no corpus size moves); counts of whole texts are
made on the executors. Since mean and softmax layer are linear, scoring needs only the product of the
two matrices: one gather and one segmented sum per n-gram, in bounded memory.

Calibration: a fifth of the sample never enters training. On it a temperature is fitted, and the
rejection threshold is the confidence that all but ``REJECT_SHARE`` of the correct answers reach.

Defined cases: null text, or no letter at all -> ``und``, score 0, rejected. No usable label anywhere
-> every row ``und``. Null ``lang`` is never learned. Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.util import ascii_lower, bounded_sample, chunked, held_out, lean, small_batches, text_bytes

BUCKETS = 1 << 15
DIM = 16
TRAIN_DOCS = 3000
EPOCHS = 12
REJECT_SHARE = 0.001
#: A rejection needs a confidence below this as well, whatever calibration says.
REJECT_BELOW = 0.5
UNKNOWN = "und"
GRAMS = (2, 3, 4)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = _LETTER[0x80:0xC0] = True
#: Multi-byte characters that are no letters begin with these bytes (U+0080..U+00BF, general punctuation, symbols, emoji).
_NOT_LETTER_LEAD = {0xC2: 2, 0xE2: 3, 0xF0: 4}


def letter_mask(buf: np.ndarray) -> np.ndarray:
    """True on each byte of a letter; ASCII by table, others by leading byte."""
    mask = _LETTER[buf]
    if len(buf) and buf.max() >= 0x80:
        for lead, width in _NOT_LETTER_LEAD.items():
            at = np.flatnonzero(buf == lead)
            if lead == 0xC2:  # feminine and masculine ordinals and the micro sign are letters
                at = at[~np.isin(buf[np.minimum(at + 1, len(buf) - 1)], (0xAA, 0xB5, 0xBA))]
            for k in range(width):
                mask[np.minimum(at + k, len(buf) - 1)] = False
        at = np.flatnonzero(buf == 0xC3)  # multiplication and division signs
        at = at[np.isin(buf[np.minimum(at + 1, len(buf) - 1)], (0x97, 0xB7))]
        mask[at] = False
        mask[np.minimum(at + 1, len(buf) - 1)] = False
    return mask


def gram_buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every subword n-gram, and the row it belongs to (ascending)."""
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    letters = letter_mask(buf)
    low = np.where(letters, ascii_lower(buf), 0).astype(np.uint32)
    # row ends and non-letters become one separator byte; a gram holds one at an end only
    joined = np.zeros(len(buf) + len(off), np.uint32)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    joined[np.arange(len(buf)) + rows + 1] = low
    row_at = np.zeros(len(joined), np.int64)
    row_at[np.arange(len(buf)) + rows + 1] = rows
    sep = joined == 0
    buckets, owners = [], []
    for n in GRAMS:
        size = len(joined) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        bad = np.zeros(size, bool)
        for k in range(n):
            h = (h ^ joined[k : k + size]) * np.uint32(0x01000193)
            if 0 < k < n - 1:
                bad |= sep[k : k + size]
        if n == 2:
            bad |= sep[:size] | sep[1:]
        elif n > 3:
            bad |= sep[:size] & sep[n - 1 :]
        else:  # <a> is the only gram of a one-letter word
            bad |= sep[1 : 1 + size]
        keep = np.flatnonzero(~bad)
        h = h[keep]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        buckets.append((h >> np.uint32(32 - 15)).astype(np.int32))
        owners.append(row_at[keep + 1 if n > 1 else keep])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    @staticmethod
    def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Exact by Unicode: rows without an ASCII letter but with other bytes are decoded."""
        plain = np.concatenate([[0], np.cumsum((ascii_lower(buf) >= 97) & (ascii_lower(buf) <= 122))])
        seen = plain[off[1:]] > plain[off[:-1]]
        wide = np.concatenate([[0], np.cumsum(buf >= 0x80)])
        for i in np.flatnonzero(~seen & (wide[off[1:]] > wide[off[:-1]])):
            seen[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
        return seen

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best class, its probability, and whether the row has any letter."""
        n, k = len(off) - 1, len(self.languages)
        total, count = np.zeros((n, k)), np.zeros(n)
        buckets, owners = gram_buckets(buf, off)
        if len(buckets):
            count = np.bincount(owners, minlength=n).astype(float)
            for j in range(k):
                total[:, j] = np.bincount(owners, self.table[buckets, j], minlength=n)
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(n), best], self.has_letter(buf, off)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = text_bytes(batch.column("text"))
        out = []
        for i in range(batch.num_rows):
            b, _ = gram_buckets(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
            u, c = np.unique(b, return_counts=True)
            out.append((u.astype(np.int32).tobytes(), c.astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "lang", "buckets", "counts"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, epochs: int = EPOCHS, seed: int = 7) -> LanguageModel | None:
    """Train on rows that are not held out and have a language; None if there are none."""
    small_batches(docs.sparkSession, 256)
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = bounded_sample(usable, train_docs).mapInArrow(lean(_counts), "doc_id long, lang string, buckets binary, counts binary").collect()
    rows = sorted((r for r in rows if r.buckets), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang))
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    label = np.array([languages.index(r.lang) for r in rows])
    sparse = [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.float32)) for r in rows]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    calibration, train = (order[: len(rows) // 5], order[len(rows) // 5 :]) if len(rows) >= 50 else (order, order)
    E = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    W = rng.normal(0, 0.3, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, size = 0, 64
    total_steps = max(1, epochs * -(-len(train) // size))

    def dense(ids: np.ndarray) -> np.ndarray:
        X = np.zeros((len(ids), BUCKETS), np.float32)
        for i, d in enumerate(ids):
            b, c = sparse[d]
            X[i, b] = c / c.sum()
        return X

    for _ in range(epochs):
        mixed = rng.permutation(train)
        for at in range(0, len(mixed), size):
            ids = mixed[at : at + size]
            X = dense(ids)
            used = np.flatnonzero(X.any(0))
            X = X[:, used]
            H = X @ E[used]
            z = H @ W + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), label[ids]] -= 1
            p /= len(ids)
            rate = 1.0 * (1 - steps / total_steps) + 0.02
            gE = X.T @ (p @ W.T)
            gW, gb = H.T @ p, p.sum(0)
            # the mean of many rows is small: embeddings learn at a higher rate
            E[used] -= 50 * rate * gE
            W -= rate * gW
            bias -= rate * gb
            steps += 1
    table = (E @ W).astype(np.float32)
    logits = np.array([(table[b] * (c / c.sum())[:, None]).sum(0) + bias for b, c in (sparse[d] for d in calibration)])
    truth = label[calibration]

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=loss)
    z = logits / temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == truth
    floor = float(np.quantile(p.max(1)[right], REJECT_SHARE)) if right.any() else 0.0
    return LanguageModel(languages, table, bias, temperature, min(REJECT_BELOW, floor))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Every column of ``docs`` and ``lang_pred``, ``score``, ``rejected``."""
    small_batches(docs.sparkSession)
    plain = docs.drop("lang_pred", "score", "rejected")
    names = plain.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            if model is not None:
                buf, off = text_bytes(batch.column(at))
                for lo, hi in chunked(off):
                    best, p, seen = model.score(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    pred[lo:hi] = np.where(seen, np.array(model.languages, object)[best], UNKNOWN)
                    score[lo:hi] = np.where(seen, p, 0.0)
                    rejected[lo:hi] = ~seen | (p < model.reject_below)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(lean(run), f"{schema}, lang_pred string, score double, rejected boolean")


def op8(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    scored = identify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
