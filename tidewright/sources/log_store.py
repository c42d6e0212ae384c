"""The log's store as a table: entries by index, appended in order, truncated, backed up and restored.

``entries``: index, term, type, appended_at, data.  A table is a set of immutable batches, each in a folder
named by its first index; readers see the newest entry of each index up to the last one appended.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "index long, term long, type string, appended_at timestamp, data binary"


class LogGap(ValueError):
    """A batch that doesn't follow on what the log holds, or isn't contiguous itself."""


def first_last(entries: DataFrame) -> DataFrame:
    """One row: the first and the last index; 0 and 0 for an empty log."""
    return entries.agg(F.coalesce(F.min("index"), F.lit(0)).cast("long").alias("first_index"), F.coalesce(F.max("index"), F.lit(0)).cast("long").alias("last_index"))


def get(entries: DataFrame, index: int) -> DataFrame:
    return entries.where(F.col("index") == index)


def gaps(entries: DataFrame) -> DataFrame:
    """Where the indices break off: the last index before each gap, and the next one after it.

    A join with the successors finds the ends; no order of all entries is needed for that."""
    ends = entries.select("index").join(entries.select((F.col("index") - 1).alias("index")), "index", "left_anti")
    starts = entries.select("index").join(entries.select((F.col("index") + 1).alias("index")), "index", "left_anti")
    from pyspark.sql.window import Window

    # Ends and starts are as few as there are gaps.
    marks = ends.select("index", F.lit(0).alias("start")).unionByName(starts.select("index", F.lit(1).alias("start")))
    after = F.lead("index").over(Window.orderBy("index", F.desc("start")))
    return marks.withColumn("next_index", after).where("start = 0 AND next_index IS NOT NULL").select(F.col("index").alias("last_index"), "next_index")


def truncate_to(entries: DataFrame, index: int) -> DataFrame:
    """Entries up to an index; 0 resets the log."""
    return entries.where(F.col("index") <= index) if index else entries.limit(0)


def delete_range(entries: DataFrame, low: int, high: int) -> DataFrame:
    """A prefix or a suffix goes; a range in the middle is refused."""
    ends = first_last(entries).first()
    if ends.last_index and low > ends.first_index and high < ends.last_index:
        raise ValueError(f"[{low}, {high}] is in the middle of [{ends.first_index}, {ends.last_index}]")
    return entries.where(~F.col("index").between(low, high))


def merged(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The log after a batch: contiguous, following on the log or overlapping its end, which it replaces."""
    b = batch.agg(F.min("index").alias("low"), F.max("index").alias("high"), F.count_distinct("index").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if not b.rows:
        return held
    if b.n != b.rows or b.high - b.low + 1 != b.n:
        raise LogGap(f"the batch from {b.low} to {b.high} is not contiguous")
    ends = first_last(held).first()
    check_start(b.low, ends.first_index, ends.last_index)
    return held.where(F.col("index") < b.low).unionByName(batch)


def check_start(start: int, first: int, last: int) -> None:
    """A batch follows on the log or replaces its end; 0 and 0 stand for an empty log."""
    if last and start > last + 1:
        raise LogGap(f"the log ends at {last}, the batch starts at {start}")
    if last and start < first:
        raise LogGap(f"the log starts at {first}, the batch at {start}")


class LogTable:
    """Batches are folders ``seq=…/first=…/last=…``, so that what each holds is read from names, and never from entries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[tuple[int, int, int]]:
        """(seq, first, last) of each batch, by seq: one short tuple for each append."""
        path, files = self._path("seq=*", "first=*", "last=*")
        found = [re.search(r"seq=(\d+)/first=(\d+)/last=(\d+)$", x.getPath().toString()) for x in files.globStatus(path) or []]
        return sorted((int(m[1]), int(m[2]), int(m[3])) for m in found if m and files.exists(self._path(f"seq={m[1]}", f"first={m[2]}", f"last={m[3]}", "_SUCCESS")[0]))

    @staticmethod
    def live(batches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(seq, first, last, end): a batch's entries from first to end count, as later batches that start at or before an
        index replace it.  One pass from the newest to the oldest."""
        out, cut = [], None
        for seq, first, last in reversed(batches):
            end = last if cut is None else min(last, cut - 1)
            if end >= first:
                out.append((seq, first, last, end))
            cut = first if cut is None else min(cut, first)
        return out[::-1]

    def read(self) -> DataFrame:
        """Batches that are whole are read as they are; of those whose end is replaced, the rest."""
        live = self.live(self.batches())
        path = lambda x: f"{self.folder}/seq={x[0]}/first={x[1]}/last={x[2]}"
        whole, cut = [x for x in live if x[3] == x[2]], [x for x in live if x[3] < x[2]]
        out = self.spark.read.schema(ENTRIES).parquet(*map(path, whole)) if whole else self.spark.createDataFrame([], ENTRIES)
        if cut:
            ends = self.spark.createDataFrame([(x[0], x[3]) for x in cut], "seq long, end long")
            rest = self.spark.read.option("basePath", self.folder).schema(f"{ENTRIES}, seq long").parquet(*map(path, cut))
            out = out.unionByName(rest.join(ends, "seq").where("index <= end").select(out.columns))
        return out

    def ends(self, without: int | None = None) -> tuple[int, int]:
        """The first and the last index, 0 and 0 for an empty log; no entry is read."""
        live = self.live([x for x in self.batches() if x[0] != without])
        return (min(x[1] for x in live), max(x[3] for x in live)) if live else (0, 0)

    def append(self, batch: DataFrame, seq: int) -> None:
        """``seq``: the batch's own number; the newest one's again replaces it, so a retry changes nothing."""
        b = batch.agg(F.min("index").alias("low"), F.max("index").alias("high"), F.count_distinct("index").alias("n"), F.count(F.lit(1)).alias("rows")).first()
        if not b.rows:
            return
        if b.n != b.rows or b.high - b.low + 1 != b.n:
            raise LogGap(f"the batch from {b.low} to {b.high} is not contiguous")
        held = self.batches()
        if held and seq < held[-1][0]:
            raise LogGap(f"batch {seq} comes after batch {held[-1][0]}")
        check_start(b.low, *self.ends(without=seq))
        batch.select(*[n.split()[0] for n in ENTRIES.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/seq={seq}/first={b.low}/last={b.high}")
        for old in held:  # what an earlier try wrote under this number
            if old[0] == seq and old[1:] != (b.low, b.high):
                path, files = self._path(f"seq={seq}", f"first={old[1]}", f"last={old[2]}")
                files.delete(path, True)

    def backup_after(self, index: int, target: str) -> None:
        """Copies entries after an index."""
        self.read().where(F.col("index") > index).write.mode("overwrite").parquet(target)


def snapshot(segments: DataFrame, folder: str) -> None:
    segments.write.mode("overwrite").parquet(folder)


def restore(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
