"""Activity log: entries without any text or value, append-only JSON lines, retention, CSV export."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import fixed

SCHEMA = (
    "schema_version int, timestamp string, action string, action_label string, source_kind string, source_label string, mode string, mode_label string, total_findings int, "
    "finding_counts map<string,int>, source_extension string, source_size_bytes bigint, source_sha256 string, output_extension string, output_size_bytes bigint, output_sha256 string, app_version string"
)
EXPORTED = "timestamp action_label source_label mode_label total_findings finding_counts source_extension source_size_bytes source_sha256 output_extension output_size_bytes output_sha256 app_version".split()
LEAST, MOST = 50, 10_000


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    retention: int = 1000

    @classmethod
    def of(cls, text: str | None) -> Settings:
        """From JSON; defaults where it cannot be read; retention between ``LEAST`` and ``MOST``."""
        try:
            raw = json.loads(text or "")
            return cls(bool(raw.get("enabled", True)), max(LEAST, min(MOST, int(raw.get("retention_entries", 1000)))))
        except (ValueError, TypeError, AttributeError):
            return cls()


def entries(detected: DataFrame, action: str, source_kind: str, mode: str, version: str) -> DataFrame:
    """One entry a document with ``findings``; ``extension``, ``size_bytes``, ``sha256`` and ``anonymized`` are used where present."""
    types = F.transform("findings", lambda f: f["entity_type"])
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)))))
    has = lambda c, kind: F.col(c) if c in detected.columns else F.lit(None).cast(kind)
    out = has("anonymized", "string").cast("binary")
    return detected.select(
        F.lit(1).alias("schema_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit(action).alias("action"), F.lit(fixed.LOG_ACTIONS.get(action, action)).alias("action_label"),
        F.lit(source_kind).alias("source_kind"), F.lit(fixed.LOG_SOURCES.get(source_kind, source_kind)).alias("source_label"), F.lit(mode).alias("mode"), F.lit(fixed.MODE_LABELS[mode]).alias("mode_label"), F.size("findings").alias("total_findings"),
        counts.alias("finding_counts"), has("extension", "string").alias("source_extension"), has("size_bytes", "bigint").alias("source_size_bytes"), has("sha256", "string").alias("source_sha256"),
        F.lit(None).cast("string").alias("output_extension"), F.octet_length(out).cast("bigint").alias("output_size_bytes"), F.sha2(out, 256).alias("output_sha256"), F.lit(version).alias("app_version"),
    )


def append(rows: DataFrame, path: str, settings: Settings = Settings()) -> None:
    if settings.enabled:
        rows.write.mode("append").json(path)


def read(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Well-formed entries; ``last`` keeps the newest by timestamp."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where(F.col("timestamp").isNotNull())
    return rows if last is None else rows.orderBy(F.desc("timestamp")).limit(last)


def trim(rows: DataFrame, settings: Settings, order: str = "timestamp") -> DataFrame:
    """The newest entries that retention allows (a limit that is at most ``MOST``)."""
    return rows.orderBy(F.desc(order)).limit(settings.retention)


def exported(rows: DataFrame) -> DataFrame:
    """Columns of the CSV export; counts as JSON with sorted keys."""
    counts = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("finding_counts", F.create_map().cast("map<string,int>"))))))
    return rows.select(*(counts.alias(c) if c == "finding_counts" else F.col(c) for c in EXPORTED))


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").json(path)
