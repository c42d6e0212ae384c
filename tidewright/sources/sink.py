"""Tables out: partitioned, sorted Parquet with field ids, and a manifest of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import partitioning
from ..plans.pipeline import Pipeline


def laid_out(rows: DataFrame, pipeline: Pipeline, files_for_each: int = 1) -> tuple[DataFrame, list[str]]:
    """Rows with their partition columns, dealt by them and sorted, ready to write; and those columns' names.

    ``files_for_each``: tasks that a partition's rows are spread over, so that one large partition isn't one
    task.  Void fields make no column."""
    parts = [(name, text) for (name, text, _), spec in zip(pipeline.partition_values(), pipeline.config.partition_spec, strict=True) if spec.transform != "void"]
    taken = {n.lower() for n in rows.columns}
    renamed = [(name if name.lower() not in taken else f"{name}_part", text) for name, text in parts]
    out = rows.withColumns({name: F.when(text != "", text) for name, text in renamed}) if renamed else rows
    names = [name for name, _ in renamed]
    if names:
        spread = [F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pipeline.column_names]), F.lit(files_for_each))] if files_for_each > 1 else []
        out = out.repartition(*[F.col(f"`{n}`") for n in names], *spread)
    keys = [*[F.col(f"`{n}`") for n in names], *pipeline.sort_keys()]
    return (out.sortWithinPartitions(*keys) if keys else out), names


def write(rows: DataFrame, pipeline: Pipeline, folder: str, mode: str = "append", files_for_each: int = 1, compression: str = "zstd", max_rows: int = 0) -> None:
    out, names = laid_out(rows, pipeline, files_for_each)
    writer = out.write.mode(mode).option("compression", compression)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if names:
        writer = writer.partitionBy(*names)
    writer.parquet(folder)
    path, files = _file(rows.sparkSession, folder)
    stream = files.create(path, True)
    stream.write(pipeline.iceberg_schema().encode())
    stream.close()


#: Holds the table's schema with its field ids as JSON; readers of the data pass over names that begin like this.
SCHEMA_FILE = "_iceberg.schema"


def _file(spark, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, SCHEMA_FILE)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_schema(spark, folder: str) -> str | None:
    """The schema that was written with a table, or None where there is none."""
    path, files = _file(spark, folder)
    if not files.exists(path):
        return None
    stream = files.open(path)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def with_paths(rows: DataFrame, pipeline: Pipeline) -> DataFrame:
    """Adds ``_partition_path`` and ``_partition`` (the tuple of internal values)."""
    parts = pipeline.partition_values()
    if not parts:
        return rows.withColumns({"_partition_path": F.lit("")})
    return rows.withColumns({"_partition_path": partitioning.path(parts), "_partition": partitioning.tuple_of(parts)})


def manifest(spark, folder: str, schema_id: int, checksums: bool = False) -> DataFrame:
    """One row for each file: schema_id, object_key, file_size and row_count, from the file listing and a count
    that reads no column.  With ``checksums`` also each file's SHA-256, for which every file is read as a whole, one in a
    task's memory at a time: ``write`` bounds their size by ``max_rows``."""
    read = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    files = read.groupBy(F.col("_metadata.file_path").alias("object_key"), F.col("_metadata.file_size").alias("file_size")).agg(F.count(F.lit(1)).alias("row_count")).withColumn("schema_id", F.lit(schema_id).cast("long"))
    if not checksums:
        return files
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.join(whole.select(F.col("_metadata.file_path").alias("object_key"), F.sha2("content", 256).alias("checksum")), "object_key", "left")


def file_index(spark, folder: str) -> DataFrame:
    """Where each row is: file and place in it."""
    return spark.read.option("recursiveFileLookup", "true").parquet(folder).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_slot"))
