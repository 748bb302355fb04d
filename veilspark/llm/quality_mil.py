"""Operator 2: document quality by attention-based multiple-instance learning.

A document is a bag of equal passages of at most ``PASSAGE_BYTES`` bytes that cover the whole text. Each
passage is described by the relative counts of neighbouring byte classes and a few rates (repeated
words, word length), encoded as ``h = tanh(W x)``. Gated attention weighs passages,
``a = softmax(w . (tanh(V h) * sigmoid(U h)))``; the weighted sum of the encodings goes through a
logistic layer. Only document labels are known; all matrices are learned from them together, with Adam
in numpy, on at most ``TRAIN_DOCS`` labelled documents, and long bags train whole.

Scoring reads every passage of every text, in blocks. An empty text is one passage of zeros.

Defined cases: null text = empty text; both get a score. No labelled document, or labels of one class
only -> the share of label 1 (0.5 without any label) for all. Null labels are not learned; a doc_id labelled twice
counts twice. Ties at 0.5 predict 1. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.util import PrefixHash, bounded_sample, chunked, held_out, lean, small_batches, text_bytes, word_bounds

PASSAGE_BYTES = 512
TRAIN_DOCS = 2500
EPOCHS = 30
HIDDEN, GATE = 24, 12

#: Byte classes, one per line: lower vowels, lower consonants, capitals, digits, white space, line ends,
#: full stops, other sentence marks, quotes and hyphens, brackets, table marks, other symbols,
#: control bytes, continuation bytes, two-byte leads, longer leads.
_CLASSES = [
    b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r",
    b".", b",;:?", b"'\"-", b"()[]{}", b"|", b"#$%&*!<>=+/\\@^_`~",
]
_CLASS = np.full(256, 12, np.int64)
for _i, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _i
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:] = 13, 14, 15
N_CLASSES = 16
N_FEATURES = N_CLASSES * N_CLASSES + 4
_WORDS = PrefixHash(3)


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage (rows x N_FEATURES) and the document of each."""
    n = len(off) - 1
    per = np.maximum(1, -(-np.diff(off) // PASSAGE_BYTES))
    first = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(n), per)
    X = np.zeros((first[-1], N_FEATURES), np.float32)
    if len(buf):
        doc = np.repeat(np.arange(n), np.diff(off))
        where = first[doc] + (np.arange(len(buf)) - off[doc]) * per[doc] // np.diff(off)[doc]
        code = _CLASS[buf]
        pair = code[:-1] * N_CLASSES + code[1:]
        pair_at = where[:-1][doc[:-1] == doc[1:]]
        pair = pair[doc[:-1] == doc[1:]]
        counts = np.bincount(pair_at * N_CLASSES**2 + pair, minlength=first[-1] * N_CLASSES**2)
        X[:, : N_CLASSES**2] = counts.reshape(first[-1], -1)
        X[:, : N_CLASSES**2] = np.sqrt(X[:, : N_CLASSES**2] / np.maximum(1, X.sum(1, keepdims=True)))
        s, e, _ = word_bounds(buf, off)
        if len(s):
            at = where[s]
            words = np.bincount(at, minlength=first[-1])
            length = np.bincount(at, e - s, minlength=first[-1]) / np.maximum(1, words)
            h = _WORDS.load(buf).of(s, e)
            order = np.lexsort((s, h, doc[s]))
            again = np.zeros(len(s), bool)
            again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[s[order[1:]]] == doc[s[order[:-1]]])
            repeated = np.bincount(at, again & (e - s > 4), minlength=first[-1]) / np.maximum(1, words)
            X[:, -4], X[:, -3], X[:, -2] = np.minimum(length / 10, 3), repeated, np.minimum(words / 100, 2)
        X[:, -1] = np.minimum(np.log1p(np.diff(off))[owner] / 10, 2)
    return X, owner


class GatedAttention:
    """Encoder, gated attention and logistic layer; softmax runs within each bag."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "W": rng.normal(0, 1 / 8, (N_FEATURES, HIDDEN)), "c": np.zeros(HIDDEN),
            "V": rng.normal(0, 1 / 5, (HIDDEN, GATE)), "U": rng.normal(0, 1 / 5, (HIDDEN, GATE)), "w": rng.normal(0, 1 / 4, GATE),
            "o": rng.normal(0, 1 / 5, HIDDEN), "b": np.zeros(1),
        }
        self.constant: float | None = None

    def forward(self, X: np.ndarray, owner: np.ndarray, n: int) -> tuple:
        p = self.p
        H = np.tanh(X @ p["W"] + p["c"])
        T, S = np.tanh(H @ p["V"]), 1 / (1 + np.exp(-(H @ p["U"])))
        e = (T * S) @ p["w"]  # bounded by |w|, so exp() is safe without a shift
        a = np.exp(e)
        a /= np.bincount(owner, a, minlength=n)[owner]
        first = np.searchsorted(owner, np.arange(n))
        Z = np.add.reduceat(H * a[:, None], first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(Z @ p["o"] + p["b"][0], -30, 30)))
        return H, T, S, a, Z, y

    def score(self, X: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.full(n, self.constant) if self.constant is not None else self.forward(X, owner, n)[-1]

    def gradients(self, X: np.ndarray, owner: np.ndarray, n: int, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        H, T, S, a, Z, y = self.forward(X, owner, n)
        dz = (y - target) * weight / n
        dZ = np.outer(dz, p["o"])
        dH = a[:, None] * dZ[owner]
        da = (H * dZ[owner]).sum(1)
        de = a * (da - np.bincount(owner, a * da, minlength=n)[owner])
        dG = np.outer(de, p["w"])
        dT, dS = dG * S * (1 - T * T), dG * T * S * (1 - S)
        dH += dT @ p["V"].T + dS @ p["U"].T
        dA = dH * (1 - H * H)
        g = {"W": X.T @ dA, "c": dA.sum(0), "V": H.T @ dT, "U": H.T @ dS, "w": (T * S).T @ de, "o": Z.T @ dz, "b": np.array([dz.sum()])}
        return {k: v + 1e-4 * p[k] for k, v in g.items()}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = text_bytes(batch.column("text"))
        packed = []
        for i in range(batch.num_rows):
            X, _ = passages(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
            packed.append(X.astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, epochs: int = EPOCHS, seed: int = 11) -> GatedAttention:
    """Train on labelled rows that are not held out.

    Both classes get half the total weight in the loss as long as the share of the rarer one is small; the
    output is moved back to the true base rate, so that 0.5 stays the better guess.
    """
    small_batches(docs.sparkSession, 256)
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = bounded_sample(known, train_docs)
    # one text for each label, the first where ids repeat: so the sample is bounded whatever the documents are
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "text", "quality").mapInArrow(lean(_features), "doc_id long, quality int, x binary").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.quality, r.x))
    model = GatedAttention(seed)
    y = np.array([r.quality for r in rows], float)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    bags = [np.frombuffer(r.x, np.float16).reshape(-1, N_FEATURES) for r in rows]
    rng = np.random.default_rng(seed)
    moment, square, step, size = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0, 64
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            ids = order[at : at + size]
            X = np.concatenate([bags[i] for i in ids]).astype(np.float32)
            owner = np.repeat(np.arange(len(ids)), [len(bags[i]) for i in ids])
            step += 1
            for k, g in model.gradients(X, owner, len(ids), y[ids], weight[ids]).items():
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                model.p[k] = model.p[k] - 0.004 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    model.p["b"] = model.p["b"] + np.log(share / (1 - share))
    return model


def classify(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """Every column of ``docs`` and ``score``, ``predicted``."""
    small_batches(docs.sparkSession)
    plain = docs.drop("score", "predicted")
    names = plain.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column(at))
            score = np.zeros(batch.num_rows)
            for lo, hi in chunked(off):
                X, owner = passages(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                score[lo:hi] = model.score(X, owner, hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(lean(run), f"{schema}, score double, predicted int")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
