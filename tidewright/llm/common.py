"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words (space, and tab to carriage return), as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir`` is used as it is; only where there is none (tests on
    one machine) a temporary folder is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "tidewright-checkpoints")
    sc.setCheckpointDir(named)


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns the copy, which has no lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_one(many: DataFrame, one: DataFrame, key: str, hot: int = 512, least: int = 1024) -> DataFrame:
    """``many`` (written already) joined with ``one``, which has a row for each of its keys.  The ``hot`` keys with most rows, if
    more than ``least``, are broadcast, and their rows stay where they are.  The others, none with over 1 / ``hot`` of the rows, are shuffled."""
    kind = many.schema[key].dataType.simpleString()
    found = many.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), "key").limit(hot).select("key").collect()
    if not found:
        return many.join(one, key)
    keys = F.broadcast(many.sparkSession.createDataFrame(found, f"key {kind}").withColumnRenamed("key", key))
    return many.join(F.broadcast(one.join(keys, key)), key).unionByName(many.join(keys, key, "left_anti").join(one, key))


#: Seconds for which a worker without a task keeps what ``borrowed`` lent it.
REST = 2.0
_resting: dict[object, threading.Timer] = {}
_turn = threading.Lock()


@contextlib.contextmanager
def borrowed(cached, rest: float = REST) -> Iterator[None]:
    """Around a task's use of ``cached``, an lru_cache of what is dear to build: tasks that follow each other in a process share it.

    Spark keeps a worker for as long as any Python runs, whatever its next task is.  One that hasn't come back to ``cached`` for
    ``rest`` seconds forgets it, and gives the memory back.  A task that still uses an object keeps that object."""
    with _turn:
        if cached in _resting:
            _resting.pop(cached).cancel()
    try:
        yield
    finally:
        timer = threading.Timer(rest, _forget, [cached])
        timer.daemon = True
        with _turn:
            if cached in _resting:
                _resting.pop(cached).cancel()
            _resting[cached] = timer
        timer.start()


def _forget(cached) -> None:
    with _turn:
        if _resting.get(cached) is not threading.current_thread():
            return  # a task came, or ended, in the meantime
        del _resting[cached]
        cached.cache_clear()
    with contextlib.suppress(OSError, AttributeError):  # the C library has it, or there is nothing to do
        ctypes.CDLL(None).malloc_trim(0)


def words_column(text: Column) -> Column:
    """The words of a text as an array of strings; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[float]:
    """Up to ``buckets - 1`` cut points that split ``key`` into ranges of about equally many rows.

    Only the key column is read; what comes to the driver is as many numbers as there are buckets."""
    if buckets < 2:
        return []
    cuts = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(key).cast("double"), cuts, F.lit(max(10_000, 4 * buckets))).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_bucket(df: DataFrame, key: str, bounds: list[float], out: str) -> DataFrame:
    """Adds the number of the range that ``key`` falls in, as an integer; null keys get the last
    number of all.  The search is binary and runs in the JVM."""
    from pyspark.ml.feature import Bucketizer

    if not bounds:
        return df.withColumn(out, F.when(F.col(key).isNull(), F.lit(1)).otherwise(F.lit(0)))
    as_double = f"{out}_key"
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=as_double, outputCol=out, handleInvalid="keep")
    return cut.transform(df.withColumn(as_double, F.col(key).cast("double"))).drop(as_double).withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(len(bounds) + 1)))


def bucket_of(bounds: list[float], value: int | None) -> int:
    """The number that range_bucket gives ``value``."""
    return len(bounds) + 1 if value is None else bisect_right(bounds, float(value))
