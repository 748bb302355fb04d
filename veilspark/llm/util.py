"""Shared helpers of the training-data operators.

* where intermediate tables go (:func:`materialize`): the folder that the cluster names in
  ``spark.checkpoint.dir``; a temporary one only if that setting is absent (tests);
* zero-copy views of Arrow text columns as UTF-8 bytes (:func:`text_bytes`, :func:`chunked`);
* vectorised word boundaries and content hashes over those bytes.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all contracts: maximal runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass works on; longer documents go alone.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. A temporary one serves only a session of one machine that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``tables``. Only for tables that every later result has a written copy of."""
    for t in tables:
        place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with leading underscores where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart, in the order of doc_id (null last), then text.

    That is doc_id itself, unless some repeat or are null; then rows get the place in a global sort, written once.
    """
    if docs.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
        return docs, "doc_id"
    key, tie = fresh(docs, "row_number"), fresh(docs, "row_tie")
    ordered = docs.withColumn(tie, F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "text", tie)
    return materialize(ordered.drop(tie).withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _store(uri: str) -> tuple[object | None, str]:
    """(filesystem or None for plain files, path)."""
    if uri.startswith("file:") or ":/" not in uri:
        return None, unquote(urlparse(uri).path) if uri.startswith("file:") else uri
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


def open_uri(uri: str, mode: str):
    """A file of the shared folder, on driver or executor."""
    store, path = _store(uri)
    if store is None:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    return store.open_output_stream(path) if mode == "wb" else store.open_input_file(path)


def rename_uri(a: str, b: str) -> None:
    store, source = _store(a)
    if store is None:
        os.replace(source, _store(b)[1])
    else:
        store.move(source, _store(b)[1])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches handed to Python workers by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving freed memory back when its task ends: workers live on and share an executor's limit."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the third of rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, concatenated, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def chunked(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row (n + 1 entries).

    A row boundary ends a word, although no white space stands there.
    """
    inside = ~_IS_SPACE[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off[(off < len(buf))]] = True
    edge[len(buf)] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class PrefixHash:
    """Polynomial hashes modulo 2**64 of any substring of a buffer, from one prefix sum.

    Bytes are replaced by random 64-bit letters first; ``seed`` gives independent families.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**62, 2**63)) * 8 % 2**64 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def load(self, buf: np.ndarray) -> PrefixHash:
        self._grow(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.letters[buf] * self.powers[: len(buf)], out=self.sums[1:])
        return self

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes [start, end): equal strings have equal hashes wherever they stand."""
        raw = (self.sums[end] - self.sums[start]) * self.inverses[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ranges_concat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[s0, s0+1, ..., s0+l0-1, s1, ...] without a loop."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def bounded_sample(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows chosen by a hash of ``key``: the same rows on every run.

    A hash threshold from the row count cuts first, so that only about ``most`` rows travel; an
    exact limit in hash order follows. For fitting models only.
    """
    total = df.count()
    order = F.xxhash64(F.col(key), F.lit(20))
    if total > most:
        share = min(1.0, 1.3 * most / total + 50 / total)
        df = df.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return df.orderBy(order, key).limit(most)


#: A group is hot if it holds more than one in so many of all rows; so there are never more hot groups than this.
HOT_SHARE = 1000


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``: ``keys``, ``size`` (how many of the ``total`` rows have them) and what else it has, one row for each group.

    Groups of more than ``total`` / ``HOT_SHARE`` rows are broadcast, at most ``HOT_SHARE`` of them, so that no task gets all rows of one; the others meet
    their rows in a shuffle. ``how`` is "inner" or "left". Keys are not null.
    """
    hot = F.col("size") * HOT_SHARE > total
    tried = rows.join(F.broadcast(groups.where(hot)), keys, "left")
    rest = tried.where(F.col("size").isNull()).select(*rows.columns).join(groups.where(~hot), keys, how)
    return tried.where(F.col("size").isNotNull()).unionByName(rest)
