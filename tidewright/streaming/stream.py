"""The same pipeline over a stream: one query for a topic, from landing files to a partitioned table.

Each micro-batch is one segment.  Its output goes to a folder of its own number, which a repeated batch
replaces, so a restart after a failure neither loses nor doubles rows.  A control table has a row for each
segment and its counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import OK, Pipeline, counters
from ..sources import sink
from ..sources.ingest import LOG, append
from ..sources.registry import Registered


def landing(spark: SparkSession, folder: str, max_files: int = 100, schema: str = LOG) -> DataFrame:
    """New files of the landing folder; no new files make no batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(folder)


def ok_stream(rows: DataFrame, pipeline: Pipeline) -> DataFrame:
    """Rows that pass: a stateless query, append mode."""
    return pipeline.ok_rows(rows)


def run(rows: DataFrame, pipeline: Pipeline, table: str, checkpoint: str, schema: Registered | None = None, on_segment: Callable[[dict], None] | None = None, node: str = "node-1", available_now: bool = True) -> StreamingQuery:
    """Starts the query. ``schema``: decodes payloads first; else rows hold the event already.
    ``on_segment`` is called once for each finished batch with its row of the control table."""
    from ..sources.decode import decode

    def batch(df: DataFrame, number: int) -> None:
        decoded = df if schema is None else decode(df, schema)
        out = pipeline.classify(decoded, keep=("_decode_error",) if schema is not None else ())
        if schema is not None:
            # An event that can't be decoded is an error before any rule.
            failed = F.col("_decode_error").isNotNull()
            out = out.withColumns({"_status": F.when(failed, F.lit("error")).otherwise(F.col("_status")), "_location": F.when(failed, F.lit("decode")).otherwise(F.col("_location")), "_error": F.coalesce("_decode_error", "_error")}).drop("_decode_error")
        out = out.persist()
        try:
            sink.write(out.where(F.col("_status") == OK).select(*pipeline.column_names), pipeline, f"{table}/data/batch={number}", mode="overwrite")
            out.where(F.col("_status").isin("rejected", "error")).select("_status", "_location", "_error").write.mode("overwrite").parquet(f"{table}/faults/batch={number}")
            segment = counters(out).select(F.lit(number).cast("long").alias("segment_id"), F.lit(2).alias("state"), F.lit(node).alias("assigned_to"), "ok", "filtered", "rejected", "error", "total")
            segment.coalesce(1).write.mode("overwrite").parquet(f"{table}/segments/batch={number}")
            if on_segment is not None:
                on_segment(segment.first().asDict())
        finally:
            out.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_stream(events: DataFrame, folder: str, checkpoint: str, first_lsn: int = 1) -> StreamingQuery:
    """Each micro-batch of events is one append, whose number follows from the batch's."""
    return events.writeStream.foreachBatch(lambda df, n: append(df, folder, first_lsn + n, limit=None)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def segments(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{table}/segments")


def status(query: StreamingQuery) -> dict:
    return {"active": query.isActive, "message": query.status["message"], "last": query.lastProgress}
