"""Operator 1: exact substring deduplication with a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts earlier in the corpus (smaller doc_id, or
earlier in the same document). Texts are UTF-8 bytes and matches never cross documents.

Suffixes are sampled where content says so: of every window of ``LENGTH`` bytes, the ``GRAM``-byte gram
with the smallest hash (the rightmost among equal ones) is its anchor. Equal windows choose equal anchors,
so all matches survive although only one suffix in thirty or so is indexed. The windows of one anchor are
consecutive and make up its context, at most ``2 * LENGTH - GRAM`` bytes.

Sampled suffixes go to shards by anchor. A shard takes them in corpus order, in batches. Each batch is sorted
into a suffix array, merge-scanned against every existing level for suffixes met before, and becomes a level; two
levels of equal size merge, so there are logarithmically many. It happens twice:

1. over whole contexts (by fingerprint): a context met before is removed whole, and anchors with two or more different
   contexts are noted;
2. over the windows of those contexts only, now with their bytes: each level is a sorted array of
   ``LENGTH``-byte strings, and a string met before is a removal. That finds matches that end inside a context.

Contexts that a map task has met before are settled there and joined to runs, so a copy or a hot passage costs one row a
document and no shard sees it again; anchors with many contexts are split by window offset in the second pass, those with even more by window.
A context is named by 128 bits: a hash of its anchor and one of itself, so contexts of one anchor are told apart by 64.

Defined cases: null text = empty; texts shorter than ``LENGTH`` stay; rows with equal doc_ids count one after the other, in the order of
their texts; null doc_ids come last; repeated rows are removed as copies of the first; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.util import PrefixHash, chunked, lean, materialize, mix64, numbered, ranges_concat, shuffle_parts, small_batches, text_bytes

LENGTH = 100
GRAM = 20
BATCH = 1 << 17
#: Windows that can hold one anchor, by their offset to it.
SPAN = LENGTH - GRAM + 1
#: Contexts of one anchor beyond so many are split by window offset, beyond ``SPAN`` times so many by what the windows say.
SPLIT = 20_000
#: Bytes of text whose contexts one shard takes.
SHARD_BYTES = 64 << 20
_A, _B = PrefixHash(41), PrefixHash(43)


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, context fingerprint, first window start, last window start, anchor place of every sampled suffix.

    Places are bytes of the buffer.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    span = SPAN
    m = len(buf) - LENGTH + 1
    if m <= 0:
        return none
    a = _A.load(buf)
    grams = len(buf) - GRAM + 1
    at = np.arange(grams)
    h = a.of(at, at + GRAM)
    # 32 bits of the hash, then the place, later ones smaller: the least value is the rightmost least hash
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    # sliding minimum by prefix and suffix minima of blocks
    pad = -grams % span
    blocks = np.concatenate([packed, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:m], left[span - 1 : span - 1 + m])
    ends = np.repeat(off[1:], np.diff(off))[:m]
    start = np.flatnonzero(np.arange(LENGTH, LENGTH + m) <= ends)
    if not len(start):
        return none
    place = (np.uint64(0xFFFFFFFF) - (least[start] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    # a new context where the anchor changes or windows are not consecutive (a row ended)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, place = start[first], start[np.append(first[1:], len(start)) - 1], place[first]
    b = _B.load(buf)
    shape = ((place - lo) * 256 + (hi - place + LENGTH)).astype(np.uint64)
    print_ = mix64(b.of(lo, hi + LENGTH) + shape * np.uint64(0x9E3779B97F4A7C15))
    return np.searchsorted(off, lo, side="right") - 1, h[place], print_, lo, hi, place


def sorting(keys: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """A stable order by key, then by what tells equal keys apart."""
    order = np.argsort(keys, kind="stable")
    if more is not None:
        k, m = keys[order], more[order]
        if ((k[1:] == k[:-1]) & (m[1:] != m[:-1])).any():
            order = np.lexsort((more, keys))
    return order


class Levels:
    """Sorted arrays of suffix keys, the number of them logarithmic in what was added.

    ``keys`` is any sortable one-dimensional array; ``more``, if given, is a second half of each key. :meth:`add` tells for each of a
    batch's keys whether an equal one came earlier, in the batch or in a level.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray | None]] = []

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.levels)

    def add(self, keys: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        order = sorting(keys, more)  # the batch's suffix array
        ranked, rest = keys[order], None if more is None else more[order]
        first = np.ones(len(keys), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        if rest is not None:
            first[1:] |= rest[1:] != rest[:-1]
        seen = np.empty(len(keys), bool)
        seen[order] = ~first
        fresh, other = ranked[first], None if rest is None else rest[first]
        met = np.zeros(len(fresh), bool)
        for level, second in self.levels:  # merge-scan
            at = np.searchsorted(level, fresh)
            todo = np.flatnonzero(at < len(level))
            while len(todo := todo[level[at[todo]] == fresh[todo]]):
                if second is None:
                    met[todo] = True
                    break
                same = second[at[todo]] == other[todo]
                met[todo[same]] = True
                todo = todo[~same]  # equal first halves: rare
                at[todo] += 1
                todo = todo[at[todo] < len(level)]
        group = np.cumsum(first) - 1
        seen[order] |= met[group]
        self.insert(fresh[~met], None if other is None else other[~met])
        return seen

    def insert(self, level: np.ndarray, second: np.ndarray | None = None) -> None:
        """Levels are ordered by size; the new one merges with all that are not larger than it, doubling as it goes."""
        while len(level) and self.levels and len(self.levels[-1][0]) <= 2 * len(level):
            k, m = self.levels.pop()
            level = np.concatenate([k, level])
            second = None if second is None else np.concatenate([m, second])
            order = sorting(level, second)
            level, second = level[order], None if second is None else second[order]
        if len(level):
            self.levels.append((level, second))


def halves(anchor: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and fingerprint of contexts as a key in two halves, the first of them evenly spread. The second half and the first give the anchor back."""
    return mix64(anchor + mix64(mark)), mark


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled suffixes of each document; runs of contexts that this task has met before are settled."""
    known, last = Levels(), None
    for batch in batches:
        ranks = batch.column(0).to_numpy()
        if not len(ranks):
            continue
        order = np.argsort(ranks, kind="stable")
        batch = batch.take(pa.array(order))
        ranks = ranks[order]
        if last is not None and ranks[0] <= last:
            known = Levels()  # only what comes earlier in the corpus settles anything
        last = ranks[-1]
        buf, off = text_bytes(batch.column(1))
        for a, b in chunked(off):
            row, anchor, mark, lo, hi, place = anchors(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            if not len(row):
                continue
            met = known.add(*halves(anchor, mark))
            if len(known) > 1 << 20:
                known = Levels()
            begin = np.ones(len(row), bool)  # of a run: settled neighbours of one document are one row
            begin[1:] = ~(met[1:] & met[:-1] & (row[1:] == row[:-1]))
            first = np.flatnonzero(begin)
            final = np.append(first[1:], len(row)) - 1
            rank = ranks[a + row[first]]
            shift = off[a + row[first]] - off[a]
            shard = np.where(met[first], mix64(rank.astype(np.uint64)), anchor[first])
            columns = (rank, shard.view(np.int64), mark[first].view(np.int64), (lo[first] - shift).astype(np.int32), (hi[final] - lo[first]).astype(np.int32), (place[first] - lo[first]).astype(np.int16), met[first])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["rank", "anchor", "mark", "lo", "width", "lead", "met"])


def _scan_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's suffixes in corpus order. kind 1: met before, a removal; kind 2: the first of its context, and its anchor has others."""
    contexts, firsts = Levels(), []
    names = ["rank", "anchor", "lo", "width", "lead", "kind"]

    def batch_of(t: list[np.ndarray], keep: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(t[i][keep]) for i in (0, 1, 3, 4, 5)), pa.array(np.full(int(keep.sum()), kind, np.int8))], names)

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(7)]
        remove = t[6].astype(bool)
        open_ = np.flatnonzero(~remove)
        met = contexts.add(*halves(t[1][open_].view(np.uint64), t[2][open_].view(np.uint64)))
        remove[open_[met]] = True
        if remove.any():
            yield batch_of(t, remove, 1)
        if not remove.all():
            firsts.append([t[i][~remove] for i in range(6)])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BATCH:
            yield from work(held)
            held, rows = [], 0
    if held:
        yield from work(held)
    if firsts:
        t = [np.concatenate(x) for x in zip(*firsts)]
        order = np.argsort(t[1], kind="stable")
        ranked = t[1][order]
        twin = np.zeros(len(ranked), bool)
        twin[1:] = ranked[1:] == ranked[:-1]
        twin[:-1] |= twin[1:]
        several = np.zeros(len(ranked), bool)
        several[order] = twin
        if several.any():
            yield batch_of(t, several, 2)


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their noted contexts in; the contexts' bytes out.

    A context of an anchor that has more than all splits by offset can take goes as its single windows, dealt by what they say.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.binary())
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        for i, noted in enumerate(batch.column(2).to_pylist()):
            if not noted:
                continue
            own = buf[off[i] : off[i + 1]]
            text = own.tobytes()
            rank = batch.column(0)[i].as_py()
            rows = [(rank, c["anchor"], c["salts"], c["lo"], c["lead"], text[c["lo"] : c["lo"] + c["width"] + LENGTH]) for c in noted if c["salts"] <= SPAN]
            if len(rows) < len(noted):
                hashes = _B.load(own)
                for c in noted:
                    if c["salts"] > SPAN:
                        at = np.arange(c["lo"], c["lo"] + c["width"] + 1)
                        rows += [(rank, h, 1, k, 0, text[k : k + LENGTH]) for h, k in zip(hashes.of(at, at + LENGTH).view(np.int64).tolist(), at.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["rank", "anchor", "salts", "lo", "lead", "bytes"])


def _scan_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's contexts in corpus order: every window that an earlier context holds is a removal."""
    levels = Levels()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            buf, off = text_bytes(part.column(5))
            count = np.diff(off) - LENGTH + 1
            owner = np.repeat(np.arange(part.num_rows), count)
            start = ranges_concat(off[:-1], count)
            offset = start - off[owner]
            salts, salt = part.column(2).to_numpy(), part.column(1).to_numpy()
            lead = part.column(6).to_numpy()
            mine = np.flatnonzero((lead[owner] - offset) % salts[owner] == salt[owner])
            owner, start, offset = owner[mine], start[mine], offset[mine]
            strings = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[start]
            met = levels.add(np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel())
            hit = np.flatnonzero(met)
            if len(hit):
                own, at_ = owner[hit], offset[hit]
                new = np.ones(len(hit), bool)
                new[1:] = (own[1:] != own[:-1]) | (at_[1:] != at_[:-1] + 1)
                first = np.flatnonzero(new)
                final = np.append(first[1:], len(hit)) - 1
                lo = part.column(4).to_numpy()[own[first]] + at_[first]
                yield pa.RecordBatch.from_arrays([pa.array(part.column(3).to_numpy()[own[first]]), pa.array(lo.astype(np.int32)), pa.array((at_[final] - at_[first]).astype(np.int32))], ["rank", "lo", "width"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        removed, spans, digest, kept = [], [], [], []
        for i, ranges in enumerate(batch.column(2)):
            text = buf[off[i] : off[i + 1]]
            edge = np.zeros(len(text) + 1, np.int32)
            if ranges.is_valid and len(ranges):
                lo = np.array([x["lo"].as_py() for x in ranges.values])
                width = np.array([x["width"].as_py() for x in ranges.values])
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + width + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum())))
            left = text[~gone].tobytes()
            kept.append(left)
            digest.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def ranked(docs: DataFrame) -> DataFrame:
    """doc_id, text, rank: the doc_id itself, unless some repeat or are null; then the place in a global sort."""
    rows, key = numbered(docs.select("doc_id", "text"))
    return rows.select("doc_id", "text", F.col(key).alias("rank"))


def removals(rows: DataFrame) -> DataFrame:
    """rank, lo, width of removed byte ranges [lo, lo + width + LENGTH); they may overlap."""
    spark = rows.sparkSession
    small_batches(spark)
    texts = rows.where(F.length("text") > 0)
    sampled = texts.select("rank", "text").mapInArrow(lean(_sample), "rank long, anchor long, mark long, lo int, width int, lead short, met boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    # a shard holds its contexts: as many shards as the texts need
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = sampled.repartition(max(shuffle_parts(spark), size // SHARD_BYTES + 1), "anchor").sortWithinPartitions("rank", "lo")
    found = materialize(dealt.mapInArrow(lean(_scan_contexts), "rank long, anchor long, lo int, width int, lead short, kind byte"), "contexts")
    small_batches(spark)
    noted = found.where(F.col("kind") == 2)
    busy = materialize(noted.groupBy("anchor").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("salts")).where(F.col("salts") > 1), "busy-anchors")
    salted = noted.join(busy, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    per_text = materialize(salted.groupBy("rank").agg(F.collect_list(F.struct("anchor", "salts", "lo", "width", "lead")).alias("noted")), "noted")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    cut = texts.select("rank", "text").join(per_text.where(F.size("noted") > 0), "rank").mapInArrow(lean(_cut_contexts), "rank long, anchor long, salts int, lo int, lead short, bytes binary")
    spread = cut.select("anchor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "salts", "rank", "lo", "bytes", "lead")
    shards = max(shuffle_parts(spark), noted.count() // SPLIT + 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")
    windows = spread.repartition(shards, "anchor", "salt").sortWithinPartitions("rank", "lo").mapInArrow(lean(_scan_windows), "rank long, lo int, width int")
    windows = materialize(windows, "windows")
    small_batches(spark)
    return found.where(F.col("kind") == 1).select("rank", "lo", "width").unionByName(windows)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row."""
    rows = ranked(docs)
    ranges = removals(rows).groupBy("rank").agg(F.collect_list(F.struct("lo", "width")).alias("ranges"))
    return rows.join(ranges, "rank", "left").select("doc_id", "text", "ranges").mapInArrow(lean(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = f"""
WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT doc_id, b, unnest(range(octet_length(b) - {LENGTH - 1})) AS i FROM bytes
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(b[i + 1 : i + {LENGTH}]) ORDER BY doc_id, i) AS n FROM starts) WHERE n > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + {LENGTH} THEN 1 ELSE 0 END AS new FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, min(i) AS lo, max(i) + {LENGTH} AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs
), cut AS (
  SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS last, string_agg(hex(b[before + 1 : lo]), '' ORDER BY lo) AS head FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(from_hex(coalesce(head, '') || hex(b[coalesce(last, 0) + 1 :]))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""
