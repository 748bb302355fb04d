"""The activity log as a sink of a stream: each batch counts once, and the log stays as short as its retention.

A stream's log is a folder with one folder for each batch. A batch that runs again, after a failure of the driver or of the checkpoint, writes its own folder
again, so nothing is counted twice. Compaction writes the newest entries of all batches up to one into ``through-<batch>``; what that folder covers is ignored
from then on, whether or not it has been deleted yet, and a batch that it covers is not taken again. So a failure at any point leaves the log as it was or as it
should be.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources import activity_log
from veilspark.sources.activity_log import Settings

_FOLDER = re.compile(r"(batch|through)-(\d{20})$")


def _parts(spark: SparkSession, path: str) -> tuple[int, dict[int, str], list[str]]:
    """(batch that compaction has reached, or -1; complete folders that count, by batch; complete folders that it covers)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in store.listStatus(place) if store.exists(place) else []:
        name = _FOLDER.search(s.getPath().getName())
        if name and store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append((name[1], int(name[2]), s.getPath().toString()))
    reached = max((k for kind, k, _ in found if kind == "through"), default=-1)
    counts = {k: p for kind, k, p in found if (kind == "through" and k == reached) or (kind == "batch" and k > reached)}
    return reached, counts, [p for _, _, p in found if p not in counts.values()]


def read(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Well-formed entries of the log; ``last`` keeps the newest by timestamp."""
    _, counts, _ = _parts(spark, path)
    rows = spark.read.schema(activity_log.SCHEMA).option("mode", "DROPMALFORMED").json(list(counts.values())) if counts else spark.createDataFrame([], activity_log.SCHEMA)
    rows = rows.where(F.col("timestamp").isNotNull())
    return rows if last is None else rows.orderBy(F.desc("timestamp")).limit(last)


def compact(spark: SparkSession, path: str, settings: Settings = Settings()) -> None:
    """Keep the newest entries that retention allows, in one folder, and delete what it covers. Without new batches nothing is written."""
    reached, counts, _ = _parts(spark, path)
    if max(counts, default=-1) > reached:
        activity_log.trim(read(spark, path), settings).write.mode("overwrite").json(f"{path}/through-{max(counts):020d}")
    _, _, covered = _parts(spark, path)
    for p in covered:
        old = spark._jvm.org.apache.hadoop.fs.Path(p)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def sink(path: str, settings: Settings = Settings(), compact_every: int = 100) -> Callable[[DataFrame, int], None]:
    """What ``writeStream.foreachBatch`` takes for a stream of entries (:func:`veilspark.sources.activity_log.entries`); one path for each stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reached, counts, _ = _parts(spark, path)
        if not settings.enabled or batch_id <= reached:
            return
        batch.write.mode("overwrite").json(f"{path}/batch-{batch_id:020d}")
        if len(counts.keys() | {batch_id}) > compact_every:
            compact(spark, path, settings)

    return write
