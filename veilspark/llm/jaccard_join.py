"""Operator 7: exact n-gram Jaccard join by a size-aware heavy-light join, and its components.

Sets are the distinct 5-word shingles of a document. Equal sets collapse first, to one key: 64 bits of the set, told apart by 64
more where two sets share them. Then candidates come in two ways:

* light sets, of at most ``boundary`` shingles, enumerate their subsets of every size a partner could force
  (``ceil(0.8 n)`` to ``n``): two light sets link only if they share such a subset;
* heavy sets scan inverted lists. Shingles have one global order, rare ones first, and linked sets share one
  among the first ``n - ceil(0.8 n) + 1`` of each; light sets stand in these lists for their heavy partners.

The boundary is the largest size at which enumerating costs less than scanning lists, whose mean length comes from a
count sketch of all shingles. The sketch has a fixed size (2 MB) whatever the corpus; it also gives the order. Any order is
exact: a coarse sketch costs time only. Size and position filters drop pairs that cannot link, and so does a parity
sketch of each set, a bit or two for each shingle: 64 bytes of it or more in the lists, 256 or more where pairs are looked at.
Rows of lists that size and position leave without any partner go before parities travel with the lists.

No group is expanded into all its pairs. A scan of the lists gives, of the pairs in a list that may link and are in different
components, a spanning forest: at most one pair less than the list has rows, however many pairs there are. These are
verified on whole shingle sets, links are contracted to components, and the lists are scanned anew. When a scan brings no
further link, or after ``FORESTS`` scans, a last one gives all pairs that are still open: pairs that may link, are in different components and
have not been tested. So no link between different texts is lost, and what is tested pair by pair is what did not link at first.
Sets that have no such pair in the first scan leave it at once.

Defined cases: null, empty or blank text = empty set, linked with nothing; fewer than five words = one shingle, the whole
sequence; equal sets link, also under repeated or null doc_ids; rows, not ids, are linked, so rows that share a doc_id may be
in different classes; the component of a row is the smallest doc_id of its class, null only where all are null; an empty set's is
its own doc_id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.util import PrefixHash, ascii_lower, chunked, discard, lean, materialize, mix64, numbered, ranges_concat, shuffle_parts, small_batches, text_bytes, word_bounds

SHINGLE = 5
#: The similarity as a fraction, so that comparisons stay in whole numbers.
NUM, DEN = 4, 5
SKETCH_BITS = 19
SKETCH_PARTS = 16
MOST_LIGHT = 14
#: Pairs that are verified together against one text, about.
PIVOT_SPLIT = 200
#: Scans that give spanning forests, before the one that gives what is left.
FORESTS = 2
#: Pairs of a list that are looked at together.
BLOCK = 1 << 16
#: Fewest cells of the large and the small parity; sets with more shingles have more cells.
PARITY_BITS = 2048
FOLD_BITS = 512
#: Bytes of parities compared at a time.
COMPARE_BYTES = 16 << 20
_WORDS = PrefixHash(29)


def shingles(buf: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every shingle occurrence, and the number of them before each row."""
    s, e, before = word_bounds(buf, off)
    w = _WORDS.load(ascii_lower(buf)).of(s, e)
    count = np.diff(before)
    m = len(w) - width + 1
    h = np.full(max(0, m), width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + max(0, m)]
    row = np.repeat(np.arange(len(count)), count)
    keep = np.flatnonzero(row[: max(0, m)] == row[width - 1 :]) if m > 0 else np.zeros(0, np.int64)
    h, owner = mix64(h[keep]), row[keep]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = []
        for r in short:
            x = np.uint64(0)
            for v in w[before[r] : before[r + 1]]:
                x = mix64(np.array([x ^ v], np.uint64))[0]
            extra.append(mix64(np.array([x ^ np.uint64(int(count[r]))], np.uint64))[0])
        h, owner = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.searchsorted(owner, np.arange(len(count) + 1))


def set_key(unique: np.ndarray) -> tuple[int, int]:
    """Two numbers for a set of shingles: its key, and what tells it from another set of the same key."""
    a = np.add.reduce(mix64(unique + np.uint64(1)))
    b = np.bitwise_xor.reduce(mix64(unique ^ np.uint64(0x5851F42D4C957F2D)))
    both = np.array([a ^ mix64(np.array([b + np.uint64(len(unique))], np.uint64))[0], b ^ mix64(np.array([a + np.uint64(len(unique))], np.uint64))[0]], np.uint64)
    key, more = mix64(both).view(np.int64).tolist()
    return key, more


def named(unique: np.ndarray, shared: frozenset[int]) -> int:
    """The name of a set: its key, or both numbers where another set has the same key."""
    key, more = set_key(unique)
    return key ^ more if key in shared else key


def cells_for(n: int, least: int) -> int:
    """The power of two that is at least ``n`` and ``least``."""
    return max(least, 1 << max(0, int(n) - 1).bit_length())


def parity(unique: np.ndarray) -> bytes:
    """Parity of the number of the set's hashes in each of some cells, at least twice as many as hashes.

    Two sets differ in at least as many shingles as cells, if cells are as many; a larger parity folds to a smaller one.
    """
    cells = cells_for(2 * len(unique), PARITY_BITS)
    return np.packbits((np.bincount((unique & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(bool)).tobytes()


def folded(large: bytes, n: int) -> bytes:
    """The small parity of a set of ``n``, from the large one."""
    return np.bitwise_xor.reduce(np.frombuffer(large, np.uint8).reshape(-1, cells_for(n, FOLD_BITS) // 8), axis=0).tobytes()


class Signs:
    """Parities of sets, of several widths: ``words`` 64-bit words from place ``at`` of ``flat`` each."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, words: np.ndarray) -> None:
        self.flat, self.at, self.words = flat, at, words
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The parities of this width, and those of twice the width folded, as rows; and the row of each set."""
        if width not in self.tables:
            own, wide = np.flatnonzero(self.words == width), np.flatnonzero(self.words == 2 * width)
            place = np.full(len(self.at), -1)
            place[own], place[wide] = np.arange(len(own)), len(own) + np.arange(len(wide))
            made = self.flat[self.at[own][:, None] + np.arange(width)]
            if len(wide):
                both = self.flat[self.at[wide][:, None] + np.arange(2 * width)]
                made = np.concatenate([made, both[:, :width] ^ both[:, width:]])
            self.tables[width] = made, place
        return self.tables[width]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many cells the parities of sets i and j differ. Sets that may link by size have widths a factor of two apart at most."""
        out = np.zeros(len(i), np.int64)
        narrow = np.minimum(self.words[i], self.words[j])
        for width in np.unique(narrow).tolist():
            made, place = self.table(width)
            pairs = np.flatnonzero(narrow == width)
            step = max(1, COMPARE_BYTES // (8 * width))
            for k in range(0, len(pairs), step):
                some = pairs[k : k + step]
                out[some] = np.bitwise_count(made[place[i[some]]] ^ made[place[j[some]]]).sum(1, dtype=np.int64)
        return out


def written(df: DataFrame, what: str) -> DataFrame:
    """:func:`materialize`, and the shuffle files of the plan go when it is written, not when the driver happens to collect garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialize(df, what)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def signs_of(*columns: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of binary columns, one column behind the other, and place and number of words of each value."""
    flat, at, words, base = [], [], [], 0
    for c in columns:
        buf, off = text_bytes(c)
        flat.append(buf.view(np.uint64))
        at.append(base + off[:-1] // 8)
        words.append(np.diff(off) // 8)
        base += len(flat[-1])
    return np.concatenate(flat), np.concatenate(at), np.concatenate(words)


def need(a: int, b: int) -> int:
    """Smallest intersection that links sets of these sizes: DEN * x >= NUM * (a + b - x)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def subsets(n: int) -> int:
    return sum(math.comb(n, k) for k in range(-(-NUM * n // DEN), n + 1))


def boundary(sketch: np.ndarray) -> int:
    """Largest light size: enumeration against prefix lists of the mean length that the sketch shows."""
    total = float(sketch.sum())
    if not total:
        return 0
    mean_list = max(1.0, float((sketch.astype(float) ** 2).sum()) / total - total / len(sketch))
    light = [n for n in range(1, MOST_LIGHT + 1) if subsets(n) <= prefix_length(n) * mean_list + 2]
    return max(light, default=0)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and key of each set; at the end this task's sketch in parts."""
    schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("more", pa.int64()), ("parity", pa.binary()), ("part", pa.int32()), ("sketch", pa.binary())])
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        n, key, more, cells = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
        for lo, hi in chunked(off):
            h, first = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            sketch += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            for i in range(hi - lo):
                if first[i + 1] > first[i]:
                    u = np.unique(h[first[i] : first[i + 1]])
                    n[lo + i], cells[lo + i] = len(u), parity(u)
                    key[lo + i], more[lo + i] = set_key(u)
        none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(key, mask=n == 0), pa.array(more, mask=n == 0), pa.array(cells, pa.binary()), *none], schema=schema)
    if sketch.any():
        pieces = np.split(np.minimum(sketch, 2**31 - 1).astype(np.int32), SKETCH_PARTS)
        k = len(pieces)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], schema=schema)


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(data, np.int32).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "sketch": [v.tobytes() for v in sums.values()]})


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n, parity: the small parity instead of the large one."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folded(c, n) for n, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.binary())], ["key", "parity"])


def folds_of(signs: DataFrame) -> DataFrame:
    """key and small parity."""
    return signs.select("key", "n", "parity").mapInArrow(lean(_fold), "key long, parity binary")


def describe(rows: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """row, n, key, more, parity of every row (row, text), the written table that they are read from, and the summed sketch."""
    small_batches(rows.sparkSession)
    made = written(rows.mapInArrow(lean(_describe), "row long, n long, key long, more long, parity binary, part int, sketch binary"), "sets")
    parts = written(made.where(F.col("part").isNotNull()).select("part", "sketch").repartition(SKETCH_PARTS, "part").mapInArrow(lean(_add_sketches), "part int, sketch binary"), "sketch").collect()
    sketch = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in parts:  # of fixed size
        sketch[r.part] = np.frombuffer(r.sketch, np.int64)
    return made.where(F.col("part").isNull()).select("row", "n", "key", "more", "parity"), made, sketch.ravel()


def classes_of(sketch: np.ndarray) -> np.ndarray:
    """Frequency class of each cell: 0 for what noise explains, then by powers of two."""
    floor = 4 * sketch.mean() + 32
    return np.where(sketch > floor, np.minimum(63, 1 + np.log2(np.maximum(sketch, 1) / floor)), 0).astype(np.uint64)


def _postings(classes, light: int, shared: frozenset[int]):
    """Rows of inverted lists and subsets: token, key, n, pos (-1 marks a subset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = classes.value
        seen: set[int] = set()  # copies that this task has met
        for batch in batches:
            buf, off = text_bytes(batch.column(0))
            if len(seen) > 1 << 18:
                seen = set()
            for lo, hi in chunked(off):
                h, first = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                # class first, then hash: the global order; 58 bits of hash name a token
                ordered = (rank[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(58)) | (h >> np.uint64(6))
                tokens, keys, sizes, places = [], [], [], []
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    if a == b:
                        continue
                    u = np.unique(h[a:b])
                    key = named(u, shared)
                    if key in seen:
                        continue
                    seen.add(key)
                    n = len(u)
                    o = np.unique(ordered[a:b])[: prefix_length(n)]
                    tokens.append(o)
                    places.append(np.arange(len(o)))
                    if n <= light:
                        chosen = [mix64(np.array([np.bitwise_xor.reduce(mix64(np.array(c, np.uint64))) + np.uint64(k)], np.uint64))[0] for k in range(-(-NUM * n // DEN), n + 1) for c in combinations(u.tolist(), k)]
                        tokens.append(np.array(chosen, np.uint64))
                        places.append(np.full(len(chosen), -1))
                    made = sum(map(len, tokens[-2:])) if n <= light else len(o)
                    keys.append(np.full(made, key, np.int64))
                    sizes.append(np.full(made, n, np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places).astype(np.int32))], ["token", "key", "n", "pos"])

    return run


ROW = [("token", np.int64), ("key", np.int64), ("n", np.int32), ("pos", np.int32)]
SIGNED = [*ROW, ("comp", np.int64), ("at", np.int64), ("words", np.int64)]


def in_lists(work, signed: bool) -> object:
    """A function for mapInArrow over rows sorted by token: ``work`` gets whole lists, as many as a few batches hold, and the words of their parities.

    Rows are token, key, n, pos; if ``signed``, comp and parity as well.
    """

    def table(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        t, flat = np.zeros(b.num_rows, SIGNED if signed else ROW), np.zeros(0, np.uint64)
        for i in range(5 if signed else 4):
            t[t.dtype.names[i]] = b.column(i).to_numpy(zero_copy_only=False)
        if signed:
            flat, t["at"], t["words"] = signs_of(b.column(5))
        return t, flat

    def joined_up(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        base, rows = 0, []
        for t, flat in held:
            if signed:
                t = t.copy()
                t["at"] += base
            rows.append(t)
            base += len(flat)
        return work(np.concatenate(rows), np.concatenate([flat for _, flat in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            t, flat = table(b)
            cut = int(np.searchsorted(t["token"], t["token"][-1]))
            if cut or (held and held[-1][0]["token"][-1] != t["token"][0]):
                yield from joined_up([*held, (t[:cut], flat)])
                held, t = [], t[cut:]
            held.append((t, flat))
        if held:
            yield from joined_up(held)

    return run


def in_order(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by list (subsets apart from shingles), size and key, each once; the list of each row, and where lists begin."""
    t = t[np.lexsort((t["key"], t["n"], t["pos"] >= 0, t["token"]))]
    subset = t["pos"] < 0
    new = np.ones(len(t), bool)
    new[1:] = (t["token"][1:] != t["token"][:-1]) | (subset[1:] != subset[:-1])
    once = new.copy()
    once[1:] |= t["key"][1:] != t["key"][:-1]
    t, new = t[once], new[once]
    return t, np.cumsum(new) - 1, np.flatnonzero(new)


def partnered(n: np.ndarray, most: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which rows have another one in their list so that neither is larger than the other's ``most``. Rows are in order of list and size."""
    wide = int(max(n.max(), most.max())) + 2
    code, limit = owner * wide + n, owner * wide + np.maximum(most, 0)
    at = np.arange(len(n))
    end = np.searchsorted(code, limit, side="right")  # rows of this list from here on are too large
    # in front; limits of other lists in front are below every code of this one
    found = np.concatenate([[-1], np.maximum.accumulate(limit)])[np.minimum(end, at)] >= code
    # behind: the largest limit of each stretch, of two that overlap and are as long as a power of two
    look = np.flatnonzero(~found & (end > at + 1))
    begin, stop, code = at[look] + 1, end[look], code[look]
    power = np.frexp((stop - begin).astype(float))[1] - 1
    for k in range(int(power.max(initial=-1)) + 1):
        now = power == k
        found[look[now]] = np.maximum(limit[begin[now]], limit[stop[now] - (1 << k)]) >= code[now]
        limit = np.maximum(limit[: -(1 << k)], limit[1 << k :])
    return found


def _shared(t: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of lists that have another set of a size and at a place that may link."""
    t, owner, _ = in_order(t)
    n = t["n"].astype(np.int64)
    # a set can share no more than what is left of it from this place on, so its partner has a largest size
    keep = partnered(n, (NUM + DEN) * (n - np.maximum(t["pos"], 0)) // NUM - n, owner)
    if keep.any():
        t = t[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t[f])) for f in ("token", "key", "n", "pos")], ["token", "key", "n", "pos"])


def joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the edges (i, j) make a spanning forest; ``labels`` (roots that are places) are moved along.

    Each root takes at most one edge to a smaller root at a time, so no cycle can close.
    """
    chosen = []
    parent = np.arange(len(labels))
    open_ = np.arange(len(i))
    a, b = labels[i], labels[j]
    while True:
        differ = np.flatnonzero(a != b)
        if not len(differ):
            break
        open_, a, b = open_[differ], a[differ], b[differ]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        chosen.append(open_[first])
        parent[high] = np.minimum(a, b)[first]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
    labels[:] = parent[labels]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _open_pairs(light: int, forest: int | None):
    """Pairs of sets of a list in different components that may link by size, position and parity: all, or a spanning forest.

    ``forest`` is the number of the scan, none for all pairs. The first one prefers pairs in order of size and key, so that the lists of a group choose
    alike; later ones prefer by a hash of pair and number, so that a pair that failed does not stand in the way of others.
    Within a list the largest component comes first; only pairs with a row outside it are looked at.
    """

    def work(t: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, owner, starts = in_order(t)
        at = np.arange(len(t))
        # labels: the first row of the list with this component
        order = np.lexsort((at, t["comp"], owner))
        new = np.ones(len(t), bool)
        new[1:] = (t["comp"][order][1:] != t["comp"][order][:-1]) | (owner[order][1:] != owner[order][:-1])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        size = np.diff(np.append(first, len(t)))
        labels = np.empty(len(t), np.int64)
        labels[order] = order[first][run]
        held = np.empty(len(t), np.int64)
        held[order] = size[run]
        # the largest component of each list in front, by size and key as before
        most = np.maximum.reduceat(held, starts)
        lead = np.full(len(starts), len(t))
        np.minimum.at(lead, owner[held == most[owner]], labels[held == most[owner]])
        inside = labels == lead[owner]
        order = np.lexsort((at, ~inside, owner))
        place = np.empty(len(t), np.int64)
        place[order] = at
        t, labels, inside = t[order], place[labels[order]], inside[order]
        n, subset = t["n"].astype(np.int64), t["pos"] < 0
        signs = Signs(flat, t["at"], t["words"])
        # two sorted stretches a list: who is behind a row and not too large; who of the largest component may link
        half = 2 * owner + ~inside
        wide = int(n.max()) * DEN // NUM + 2
        code = half * wide + n
        up = np.searchsorted(code, code - n + n * DEN // NUM, side="right")
        base = 2 * owner * wide
        lo = np.searchsorted(code, base + -(-n * NUM // DEN), side="left")
        hi = np.searchsorted(code, base + n * DEN // NUM, side="right")
        begin = np.concatenate([at + 1, lo])
        count = np.concatenate([np.where(inside, 0, up - at - 1), np.where(inside, 0, hi - lo)])
        row = np.concatenate([at, at])
        ends = np.append(starts[1:], len(t))
        order = np.argsort(row, kind="stable")
        row, begin, count = row[order], begin[order], count[order]
        used = count > 0
        row, begin, count = row[used], begin[used], count[used]
        cuts = np.append(0, np.cumsum(count))
        k = 0
        while k < len(row):
            stop = max(k + 1, int(np.searchsorted(cuts, cuts[k] + BLOCK, side="right")) - 1)
            done, total = 0, int(cuts[stop] - cuts[k])
            while done < total:  # one row with many partners is cut as well
                if stop == k + 1:
                    take = min(BLOCK, total - done)
                    i, j = np.full(take, row[k]), begin[k] + done + np.arange(take)
                else:
                    take = total
                    i, j = np.repeat(row[k:stop], count[k:stop]), ranges_concat(begin[k:stop], count[k:stop])
                done += take
                ok = labels[i] != labels[j]
                i, j = i[ok], j[ok]
                least = -(-NUM * (n[i] + n[j]) // (NUM + DEN))
                fits = (np.minimum(n[i] - t["pos"][i], n[j] - t["pos"][j]) >= least) & (np.maximum(n[i], n[j]) > light)  # two light sets meet by their subsets
                fits |= subset[i]
                i, j, least = i[fits], j[fits], least[fits]
                # sets that link differ in few cells of their parities
                near = signs.differ(i, j) <= n[i] + n[j] - 2 * least
                i, j = i[near], j[near]
                if forest and len(i):
                    both = mix64(t["key"][i].view(np.uint64) ^ np.uint64(forest)) + mix64(t["key"][j].view(np.uint64) ^ np.uint64(forest))
                    order = np.argsort(mix64(both), kind="stable")
                    i, j = i[order], j[order]
                if forest is not None and len(i):
                    kept = joined(labels, i, j)
                    i, j = i[kept], j[kept]
                if len(i):
                    x, y = t["key"][i], t["key"][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            k = stop
            if forest is not None and k < len(row):
                # a long list that hangs together already is left
                own = owner[row[k]]
                if row[k - 1] >= starts[own] and (labels[starts[own] : ends[own]] == labels[starts[own]]).all():
                    k = int(np.searchsorted(row, ends[own]))

    return in_lists(work, True)


def _verify(shared: frozenset[int]):
    """Rows sorted by (pivot, salt, member first?): a pivot's text, then its members'; links come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, pivot_key = None, None
        for batch in batches:
            p, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buf, off = text_bytes(batch.column(2))
            a, b = [], []
            for lo, hi in chunked(off):
                h, first = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for i in range(hi - lo):
                    u = np.unique(h[first[i] : first[i + 1]])
                    if m[lo + i] == p[lo + i]:
                        pivot, pivot_key = u, p[lo + i]
                    elif pivot_key == p[lo + i]:
                        both = len(np.intersect1d(u, pivot, assume_unique=True))
                        if DEN * both >= NUM * (len(u) + len(pivot) - both):
                            a.append(p[lo + i])
                            b.append(m[lo + i])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities differ in no more cells than linked sets of their sizes may differ in shingles."""
    for b in batches:
        if b.num_rows:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            least = -(-NUM * (n + m) // (NUM + DEN))
            at = np.arange(b.num_rows)
            may = np.flatnonzero(np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM)
            ok = np.zeros(b.num_rows, bool)
            ok[may] = Signs(*signs_of(b.column(3), b.column(5))).differ(at[may], b.num_rows + at[may]) <= (n + m - 2 * least)[may]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))


def near_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """An exact filter of pairs (a, b): no link is lost, and almost all that share only common shingles go."""
    one = reps.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    two = reps.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(lean(_near), "a long, b long")


def texts_of(keys: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """key, text of the sets in ``keys``, written."""
    spark = rows.sparkSession
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    # lets the optimiser drop, before the shuffle, texts that nobody asks for
    spark.conf.set(name, "0")
    wanted = written(reps.select("key", "row").join(keys, "key", "left_semi"), "wanted")
    out = written(rows.join(wanted.where(F.col("row") >= F.lit(-(2**63))), "row").select("key", "text"), "texts")
    spark.conf.set(name, before)
    return out


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()


def verify(pairs: DataFrame, texts: DataFrame, shared: frozenset[int]) -> DataFrame:
    """Pairs (a, b) of a written table that link, written.

    Pairs with one a meet its text once for some ``PIVOT_SPLIT`` of them at most: they are split by b, into as many parts as the busiest a could need.
    """
    spark = pairs.sparkSession
    small_batches(spark)
    salt = F.pmod(F.xxhash64("b"), F.lit(pairs.count() // PIVOT_SPLIT + 1))
    split = pairs.select(F.col("a").alias("pivot"), salt.alias("salt"), F.col("b").alias("member"))
    members = split.join(texts, F.col("member") == F.col("key")).select("pivot", "member", "text", "salt")
    pivots = split.select("pivot", "salt").distinct().join(texts, F.col("pivot") == F.col("key")).select("pivot", F.col("pivot").alias("member"), "text", "salt")
    dealt = members.unionByName(pivots).repartition(shuffle_parts(spark), "pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("member") != F.col("pivot"), "member")
    return written(dealt.mapInArrow(lean(_verify(shared)), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """key, comp (smallest key reachable) of every linked key: least neighbour labels with pointer jumping."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("least")).select("key", F.least("key", "least").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.key).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.key == near.a).select("key", F.least("comp", "near").alias("next"), "comp")
        jump = step.select(F.col("key").alias("at"), F.col("next").alias("jumped"))
        moved = written(step.join(jump, step.next == jump["at"], "left").select("key", F.least("next", F.coalesce("jumped", "next")).alias("next"), "comp"), "labels")
        labels = moved.select("key", F.col("next").alias("comp"))
        if moved.where(F.col("next") != F.col("comp")).isEmpty():
            return labels


def open_pairs(lists: DataFrame, comps: DataFrame | None, signs: DataFrame, light: int, forest: int | None) -> DataFrame:
    """Pairs (a, b), each once, that :func:`_open_pairs` gives of ``lists``; ``signs``: key, n and parity of its sets."""
    spark = lists.sparkSession
    signed = lists.join(folds_of(signs), "key")
    tagged = signed.withColumn("comp", F.col("key")) if comps is None else signed.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    small_batches(spark, 8192)
    dealt = tagged.select("token", "key", "n", "pos", "comp", "parity").repartition(shuffle_parts(spark), "token").sortWithinPartitions("token")
    return dealt.mapInArrow(lean(_open_pairs(light, forest)), "a long, b long").distinct()


def in_shared_lists(postings: DataFrame) -> DataFrame:
    """Of token, key, n, pos the rows of :func:`_shared`, written."""
    spark = postings.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    dealt = postings.select("token", "key", "n", "pos").repartition(shuffle_parts(spark), "token").sortWithinPartitions("token")
    out = written(dealt.mapInArrow(lean(in_lists(_shared, False)), "token long, key long, n int, pos int"), "lists")
    small_batches(spark)
    return out


def links_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (row, text): (row, n, key), and the components (key, comp) of the keys that have links."""
    spark: SparkSession = rows.sparkSession
    sets, described, sketch = describe(rows)
    light = boundary(sketch)
    classes = spark.sparkContext.broadcast(classes_of(sketch))
    # keys that different sets share: by chance only, N**2 / 2**65 of N sets
    clashing = sets.where(F.col("n") > 0).groupBy("key").agg(F.min("more").alias("x"), F.max("more").alias("y")).where(F.col("x") != F.col("y"))
    shared = frozenset(r.key for r in clashing.select("key").collect())
    if shared:
        sets = sets.withColumn("key", F.when(F.col("key").isin(*shared), F.col("key").bitwiseXOR(F.col("more"))).otherwise(F.col("key")))
    reps = written(sets.where(F.col("n") > 0).groupBy("key").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("parity").alias("parity")), "reps")
    sets = written(sets.select("row", "n", "key"), "keys")
    discard(described)
    small_batches(spark)
    made = rows.select("text").where(F.length("text") > 0).mapInArrow(lean(_postings(classes, light, shared)), "token long, key long, n int, pos int")
    lists = in_shared_lists(made)
    # all rows with the small parities: who has a pair at all
    first = written(open_pairs(lists, None, reps, light, 0), "open")
    alive = written(both_ends(first), "alive")
    signs = written(reps.join(alive, "key", "left_semi").select("key", "n", "parity"), "signs")
    # what is left of the lists: rows that still have another one that may link
    short = in_shared_lists(lists.join(alive, "key", "left_semi"))
    discard(lists)
    texts = texts_of(alive, rows, reps)
    discard(reps)
    # links, scan by scan
    pairs = written(near_pairs(first, signs), "near")
    links = verify(pairs, texts, shared)
    tested, comps, brought = pairs, components(links), True
    for turn in range(1, FORESTS + 1):
        last = turn == FORESTS or not brought
        pairs = written(near_pairs(open_pairs(short, comps, signs, light, None if last else turn).join(tested, ["a", "b"], "left_anti"), signs), "open")
        found = verify(pairs, texts, shared)
        brought = not found.isEmpty()
        if brought:
            links = links.unionByName(found)
            comps = components(links)
        if last:
            break
        tested = tested.unionByName(pairs)
    discard(short, signs, texts)
    return sets, comps


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, key = numbered(docs.select("doc_id", "text"))
    sets, comps = links_of(rows.select(F.col(key).alias("row"), "text"))
    labelled = sets.join(comps, "key", "left").withColumn("group", F.coalesce("comp", "key"))
    if key == "doc_id":
        labelled = labelled.withColumn("doc_id", F.col("row"))
    else:
        labelled = labelled.join(rows.select(F.col(key).alias("row"), "doc_id"), "row")
    labelled = labelled.select("doc_id", "n", "group")
    classes = labelled.where(F.col("n") > 0).groupBy("group").agg(F.min("doc_id").alias("component"))
    return labelled.join(classes, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the smallest doc_id, null last, and among equal ids the first text; rows of empty sets all stay."""
    rows, key = numbered(docs)
    sets, comps = links_of(rows.select(F.col(key).alias("row"), "text"))
    labelled = sets.join(comps, "key", "left")
    firsts = labelled.where(F.col("n") > 0).groupBy(F.coalesce("comp", "key").alias("class")).agg(F.min("row").alias(key))
    stay = firsts.select(key).unionByName(sets.where(F.col("n") == 0).select(F.col("row").alias(key)))
    return rows.join(stay, key, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op7(docs: DataFrame) -> DataFrame:
    return cluster(docs.select("doc_id", "text"))


ORACLE_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= {SHINGLE} THEN list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE {DEN} * k >= {NUM} * (p.n + q.n - k)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x
), least AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
"""
