"""Operator 3: benchmark decontamination by template canonicalisation.

Text becomes typed tokens: numbers (``<num>``), units behind a number (``<unit>``), names, that is capitalised words within a
sentence (``<name>``), and plain words in lower case without punctuation. Windows of ``WINDOW`` typed tokens, and the same
windows with names as plain words (so that a copy in other letter case is found), are hashed and joined with those of the benchmark items, so a question asked again with other numbers, names or
units gives the same windows. One monotone alignment of document and item is chosen, the one that covers most windows with
fewest changes of shift, equal tokens first; however much is inserted between or deleted, the rest of an item counts together. An alignment of nothing but slots is held against the exact tokens, as any
numbers in a row would fit it. Slots then have to agree: along the alignment, equal slot
values of the item must stay equal in the document, and different ones different, for at least ``CONSISTENT``
of the slots. An item leaks into a document if aligned windows cover ``COVERAGE`` of its windows.

The benchmark is the stated query set: its windows go to the workers in blocks of at most ``BLOCK_WINDOWS``
(a fixed size), each block against all documents; nothing of the documents is shuffled but the matches.
Items shorter than a window are one window of their own length; as a few words may stand anywhere, they leak only into
documents of which they are at least ``short_share`` of the tokens (0: anywhere).

Defined cases: null or empty text or item matches nothing, nor does an item without a word; repeated rows match alike (results
are distinct pairs); ties in alignment take the smallest shift; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.util import PrefixHash, ascii_lower, chunked, lean, mix64, small_batches, text_bytes

WINDOW = 6
COVERAGE = 0.5
CONSISTENT = 0.8
#: The part of a document's tokens that an item shorter than a window has to be.
SHORT_SHARE = 0.5
#: What a change of shift costs an alignment, in windows.
SWITCH = 0.75
BLOCK_WINDOWS = 1 << 20
#: Units that count as such behind a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles mg g kg t oz lb lbs gram grams pound pounds ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents "
    "percent pct mph kmh km/h hz khz mhz ghz kb mb gb tb w kw v a c f k degree degrees"
).split()
NUM, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))
_HASH = PrefixHash(17)
_WORDCHAR = np.zeros(256, bool)
_WORDCHAR[48:58] = _WORDCHAR[65:91] = _WORDCHAR[97:123] = _WORDCHAR[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n\r\"'")] = True


def _unit_hashes() -> np.ndarray:
    joined = "".join(UNITS).encode()
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(_HASH.load(np.frombuffer(joined, np.uint8)).of(ends - [len(u) for u in UNITS], ends))


_UNIT_HASHES = _unit_hashes()


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(type or word hash, exact hash, row) of each token.

    A token is a run of letters and digits; ``.`` and ``,`` between digits belong to a number.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = ascii_lower(buf)
    # capital Latin letters with accents are C3 80 to C3 9E but for the multiplication sign
    accented = np.zeros(n, bool)
    accented[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[accented] += 32
    capital = _UPPER[buf]
    capital[:-1] |= accented[1:]
    inside = _WORDCHAR[buf]
    digit = _DIGIT[buf]
    glue = np.zeros(n, bool)
    glue[1:-1] = ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
    inside = inside | glue
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(off, s, side="right") - 1
    exact = _HASH.load(low).of(s, e)
    kind = exact.copy()
    number = digit[s]
    # a sentence begins at the row's start or behind a mark; look back over blanks and brackets
    before = s - 1
    for _ in range(3):
        blank = (before >= 0) & np.isin(buf[np.maximum(before, 0)], (32, 9, 40, 41, 91))
        before = np.where(blank, before - 1, before)
    opens = (before < off[row]) | _STOP[buf[np.maximum(before, 0)]]
    # in writing that is all capitals, or mostly, capitals do not make names
    behind = s + 1 + (buf[s] >= 0xC0)
    second_upper = (behind < e) & capital[np.minimum(behind, n - 1)]
    name = capital[s] & ~opens & ~second_upper
    after_number = np.zeros(len(s), bool)
    after_number[1:] = number[:-1] & (row[1:] == row[:-1])
    unit = after_number & _is_in(exact, _UNIT_HASHES)
    kind[name] = NAME
    kind[number] = NUM
    kind[unit] = UNIT
    return kind, exact, row


def untyped_names(kind: np.ndarray, exact: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`window_hashes` of the windows that hold a name, with names as plain words; the others hash as before."""
    name = kind == NAME
    held = np.concatenate([[0], np.cumsum(name)])
    h, at = window_hashes(np.where(name, exact, kind), row, width)
    own = held[at + width] > held[at]
    return h[own], at[own]


def window_hashes(kind: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` tokens within a row, and its first token."""
    m = len(kind) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + kind[k : k + m]
    at = np.flatnonzero(row[:m] == row[width - 1 :])
    return mix64(h[at]), at


class Templates:
    """The windows of a block of benchmark items, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str], window: int = WINDOW) -> None:
        buf, off = text_bytes(pa.array(texts, pa.large_string()))
        kind, exact, row = tokens(buf, off)
        self.ids, self.exact, self.kind, self.window = np.array(ids, np.int64), exact, kind, window
        self.first = np.searchsorted(row, np.arange(len(ids)))
        size = np.diff(np.append(self.first, len(row)))
        self.size = size
        hashes, places = [], []
        for width in sorted({min(window, int(x)) for x in size if x}):
            for h, at in (window_hashes(kind, row, width), untyped_names(kind, exact, row, width)):
                own = np.minimum(window, size[row[at]]) == width
                hashes.append(h[own])
                places.append(at[own])
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.at = self.hashes[order], places[order]
        self.item = row[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.offset = self.at - self.first[self.item] if len(self.at) else self.at
        self.widths = sorted({min(window, int(x)) for x in size if x})
        self.windows = np.maximum(1, size - window + 1)

    def match(self, buf: np.ndarray, off: np.ndarray, coverage: float, consistent: float, short_share: float = SHORT_SHARE) -> list[tuple[int, int, int, int, float]]:
        """(row, item index, aligned windows, windows, share of consistent slots) of each leak."""
        kind, exact, row = tokens(buf, off)
        docs, items, shifts, offsets = [], [], [], []
        for width in self.widths:
            h, at = (np.concatenate(x) for x in zip(window_hashes(kind, row, width), untyped_names(kind, exact, row, width)))
            hit = np.flatnonzero(_is_in(h, self.hashes))
            if not len(hit):
                continue
            lo, hi = np.searchsorted(self.hashes, h[hit]), np.searchsorted(self.hashes, h[hit], side="right")
            many = np.repeat(hit, hi - lo)
            k = np.arange(len(many)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            docs.append(row[at[many]])
            items.append(self.item[k])
            offsets.append(self.offset[k])
            shifts.append(at[many] - self.offset[k])
        if not docs:
            return []
        docs, items, shifts, offsets = (np.concatenate(x) for x in (docs, items, shifts, offsets))
        short = self.size[items] < self.window
        fits = ~short | (self.size[items] >= short_share * np.bincount(row)[docs])
        docs, items, shifts, offsets = docs[fits], items[fits], shifts[fits], offsets[fits]
        # whatever is inserted or deleted moves the rest of an item: all its hits in a document are aligned together
        order = np.lexsort((offsets, shifts, items, docs))
        docs, items, shifts, offsets = docs[order], items[order], shifts[order], offsets[order]
        # a window that hits in both typings is one
        once = np.ones(len(docs), bool)
        once[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1]) | (shifts[1:] != shifts[:-1]) | (offsets[1:] != offsets[:-1])
        docs, items, shifts, offsets = docs[once], items[once], shifts[once], offsets[once]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1])
        group = np.cumsum(new) - 1
        best: dict[tuple[int, int], tuple[int, float]] = {}
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(docs)))
        for a, c in zip(starts[count >= coverage * self.windows[items[starts]] - 1e-9], count[count >= coverage * self.windows[items[starts]] - 1e-9]):
            d, i = int(docs[a]), int(items[a])
            if len(np.unique(offsets[a : a + c])) < coverage * self.windows[i] - 1e-9:
                continue
            here, there, covered = self.alignment(i, shifts[a : a + c], offsets[a : a + c], exact)
            if covered < coverage * self.windows[i] - 1e-9:
                continue
            share = self.slot_share(here, there, exact)
            if share >= consistent and (covered, share) > best.get((d, i), (0, 0.0)):
                best[d, i] = covered, share
        del group
        return [(d, i, c, int(self.windows[i]), s) for (d, i), (c, s) in sorted(best.items())]

    def alignment(self, item: int, shifts: np.ndarray, offsets: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Aligned tokens of item and document, each at most once and both in order, and the number of windows aligned."""
        width = min(self.window, int(self.size[item]))
        order = np.lexsort((shifts, offsets))
        shifts, offsets = shifts[order], offsets[order]
        here = self.first[item] + offsets[:, None] + np.arange(width)
        equal = self.exact[here] == exact[(shifts + offsets)[:, None] + np.arange(width)]
        # equal tokens decide among as many windows
        gain = 1 + equal.mean(1) / 2
        place, at = np.unique(shifts + offsets, return_inverse=True)
        kinds, lane = np.unique(shifts, return_inverse=True)
        back = np.full(len(shifts), -1)
        top, top_of = np.zeros(len(place) + 1), np.full(len(place) + 1, -1)
        last, last_of = np.zeros(len(kinds)), np.full(len(kinds), -1)
        cuts = np.append(np.flatnonzero(np.diff(offsets, prepend=-1)), len(offsets))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            p, k = at[lo:hi], lane[lo:hi]
            # the best chain that ends before each place
            upto = np.maximum.accumulate(top)
            which = np.maximum.accumulate(np.where(top >= upto, np.arange(len(top)), 0))
            moved, stayed = upto[p] - SWITCH, last[k]
            stay = stayed >= moved
            base = np.where(stay, stayed, moved)
            back[lo:hi] = np.where(base > 0, np.where(stay, last_of[k], top_of[which[p]]), -1)
            score = gain[lo:hi] + np.maximum(base, 0)
            last[k], last_of[k] = score, np.arange(lo, hi)
            better = score > top[p + 1]
            top[p[better] + 1], top_of[p[better] + 1] = score[better], np.arange(lo, hi)[better]
        x, chain = int(top_of[np.argmax(top)]), []
        while x >= 0:
            chain.append(x)
            x = int(back[x])
        chain = np.array(chain[::-1])
        if (self.kind[here[chain]] <= UNIT).all():
            chain = chain[equal[chain].all(1)]
        pairs: list[tuple[int, int]] = []
        for x in chain.tolist():
            for h in here[x].tolist():
                t = h - int(self.first[item]) + int(shifts[x])
                if not pairs or (h > pairs[-1][0] and t > pairs[-1][1]):
                    pairs.append((h, t))
        aligned = np.array(pairs, np.int64).reshape(-1, 2)
        return aligned[:, 0], aligned[:, 1], len(chain)

    def slot_share(self, here: np.ndarray, there: np.ndarray, exact: np.ndarray) -> float:
        """Share of slots whose filling follows a one-to-one renaming of the item's."""
        slot = self.kind[here] <= UNIT
        pairs = list(zip(here[slot].tolist(), there[slot].tolist()))
        if not pairs:
            return 1.0
        votes: dict[tuple[int, int], int] = {}
        for h, t in pairs:
            key = int(self.exact[h]), int(exact[t])
            votes[key] = votes.get(key, 0) + 1
        left, right, agreed = set(), set(), 0
        for (x, y), v in sorted(votes.items(), key=lambda kv: (-kv[1], kv[0])):
            if x not in left and y not in right:
                agreed += v
                left.add(x)
                right.add(y)
        return agreed / len(pairs)


def blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Templates]:
    """The benchmark in blocks of a bounded number of windows, streamed to the driver one at a time."""
    ids, texts, held = [], [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct().orderBy("item_id", "text").toLocalIterator():
        size = r.text.count(" ") + r.text.count("\n") + 1
        if held and held + size > most:
            yield Templates(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += size
    if ids:
        yield Templates(ids, texts, window)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT, block: int = BLOCK_WINDOWS, short_share: float = SHORT_SHARE) -> DataFrame:
    """Pairs doc_id, item_id with matched_windows, item_windows, slot_consistency."""
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for templates in blocks(benchmark, window, block):
        sent = spark.sparkContext.broadcast(templates)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            t = sent.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                buf, off = text_bytes(batch.column(1))
                for lo, hi in chunked(off):
                    for d, i, c, w, s in t.match(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], coverage, consistent, short_share):
                        rows.append((ids[lo + d], int(t.ids[i]), c, w, s))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "matched_windows", "item_windows", "slot_consistency"])

        part = docs.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(lean(run), "doc_id long, item_id long, matched_windows long, item_windows long, slot_consistency double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, matched_windows long, item_windows long, slot_consistency double")
    return out.groupBy("doc_id", "item_id").agg(F.max("matched_windows").alias("matched_windows"), F.max("item_windows").alias("item_windows"), F.max("slot_consistency").alias("slot_consistency"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT, block: int = BLOCK_WINDOWS, short_share: float = SHORT_SHARE) -> DataFrame:
    """``docs`` without the rows that hold an item; each row is judged by its own text, so ids may repeat or be null."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    for templates in blocks(benchmark, window, block):
        sent = spark.sparkContext.broadcast(templates)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                buf, off = text_bytes(batch.column(at))
                for lo, hi in chunked(off):
                    for d, *_ in sent.value.match(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], coverage, consistent, short_share):
                        clean[lo + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
