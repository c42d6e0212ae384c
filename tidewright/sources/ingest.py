"""Taking in events: the rows of the log, and batches appended to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most events of one append.
MAX_BATCH = 1000
LOG = "_event_id binary, _event_type string, _occurred_at timestamp, payload binary, compression string, _schema_id long, metadata array<struct<key:string,value:binary>>, _ingested_at timestamp, _lsn long, _ordinal long"


def to_log(events: DataFrame, lsn: int) -> DataFrame:
    """Events as rows of the log.  ``occurred_at`` counts microseconds; 0 and null mean now.  All fields are kept."""
    at = F.col("occurred_at")
    cols = set(events.columns)
    or_null = lambda name, kind: F.col(name).cast(kind) if name in cols else F.lit(None).cast(kind)
    return events.select(
        F.col("event_id").cast("binary").alias("_event_id"),
        F.col("event_type").alias("_event_type"),
        F.when(at.isNull() | (at == 0), F.current_timestamp()).otherwise(F.timestamp_micros(at.cast("long"))).alias("_occurred_at"),
        F.col("payload").cast("binary").alias("payload"),
        or_null("compression", "string").alias("compression"),
        F.col("schema_id").cast("long").alias("_schema_id"),
        or_null("metadata", "array<struct<key:string,value:binary>>").alias("metadata"),
        F.current_timestamp().alias("_ingested_at"),
        F.lit(lsn).cast("long").alias("_lsn"),
        F.monotonically_increasing_id().alias("_ordinal"),
    )


class BatchTooLarge(ValueError):
    pass


def append(events: DataFrame, folder: str, lsn: int, limit: int | None = MAX_BATCH) -> dict:
    """Writes one batch to the landing folder under its number; the same number again replaces it, so a retry
    changes nothing.  An empty batch writes nothing."""
    if limit is not None and len(events.limit(limit + 1).select(F.lit(1)).collect()) > limit:
        raise BatchTooLarge(f"more than {limit} events")
    rows = to_log(events, lsn)
    if events.isEmpty():
        return {"success": True, "count": 0, "committed_lsn": 0}
    rows.write.mode("overwrite").parquet(f"{folder}/lsn={lsn:020d}")
    written = events.sparkSession.read.schema(LOG).parquet(f"{folder}/lsn={lsn:020d}").count()
    return {"success": True, "count": written, "committed_lsn": lsn}


def log(spark, folder: str) -> DataFrame:
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(folder)


def record_at(rows: DataFrame, lsn: int) -> DataFrame:
    return rows.where(F.col("_lsn") == lsn)


def scan_from(rows: DataFrame, lsn: int, strictly_after: bool = False) -> DataFrame:
    return rows.where(F.col("_lsn") > lsn if strictly_after else F.col("_lsn") >= lsn)


def truncated(rows: DataFrame, lsn: int) -> DataFrame:
    """The log up to a number; 0 means the empty log."""
    return rows.where(F.col("_lsn") <= lsn) if lsn else rows.limit(0)


def without_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where(~F.col("_lsn").between(low, high))


def health(is_leader: bool, leader: str | None) -> str:
    return "healthy" if is_leader or leader else "degraded"
