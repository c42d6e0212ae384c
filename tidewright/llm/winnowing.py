"""Document fingerprints by winnowing.

Every k consecutive characters are hashed; in each window of w such hashes the smallest is chosen, the
rightmost of equal ones, and the chosen hashes with their positions are the fingerprint.  Any passage of
w + k - 1 characters that two texts share is then found: both choose the same hash from it.  Texts shorter
than k characters have the hash of what they are; texts with fewer than w hashes are one window.

Hashes are computed for a whole text at once by doubling: the hash of 2m characters is put together from two
of m, as are minima over windows.  Likeness is the Jaccard index of the chosen hashes.

The document next to each is found by ranges of the key: rows meet once by range, sorted, and a range gets a
copy of the largest key of the one before it, so that each range is read in order without the others.  Where one
key (or null) has more rows than a range should hold, its rows are dealt by ranges of their texts; of a row that it
repeats as often, one is dealt so, and the others, which are followed by their like, need no order.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, and two empty ones have
likeness 1; null keys come before all others (in descending order) and rows with equal keys follow their text;
repeated rows are next to each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, range_bounds, range_bucket, settle, shuffle_partitions

#: Parts that the rows of one range of keys may have.
PARTS = 1 << 20


@dataclass(frozen=True)
class Winnow:
    gram: int = 8
    window: int = 8  # 15 characters that two texts share are found, half of a text of 30


_ONE = np.uint64(1)


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hashes of all runs of ``k`` codes, well mixed; exact for equal runs."""
    base = 0x9E3779B97F4A7C15
    h = (codes.astype(np.uint64) + _ONE) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    n, done, out = len(h), 0, None
    power, size = h, 1  # the hashes of ``size`` codes, for doubling
    while True:
        if k & size:
            count = n - (done + size) + 1
            out = power[:count] if out is None else out[:count] * _power(base, size) + power[done : done + count]
            done += size
        if done == k:
            break
        power = power[:-size] * _power(base, size) + power[size:]
        size *= 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def choose(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of each window of ``w``, the rightmost of equal ones; ascending.

    Hashes are compared by their upper half; the lower half of what is compared is the position, from the right."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    last = np.uint64(0xFFFFFFFF)
    low = (hashes & ~last) | (last - np.arange(n, dtype=np.uint64))
    w, size = min(w, n), 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    m = n - w + 1
    low = np.minimum(low[:m], low[w - size : w - size + m])
    at = (last - (low & last)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def fingerprint(text: str, s: Winnow) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (the upper halves, which are compared) and their positions, by position."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(codes) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = gram_hashes(codes, min(s.gram, len(codes)))
    at = choose(hashes, s.window)
    return hashes[at] >> np.uint64(32), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    """``position:hash`` in hexadecimal, joined by commas."""
    return ",".join([f"{p:x}:{h:08x}" for p, h in zip(at.tolist(), hashes.tolist(), strict=True)])


def _crowded(keys: DataFrame, least: int) -> tuple[list[float], int, list[tuple]]:
    """Cut points of the keys, how many rows a range may have, and the keys (null as well) that have more: (key, rows)."""
    ranges = 4 * shuffle_partitions(keys.sparkSession)
    bounds = range_bounds(keys, "key", ranges)
    ranged = range_bucket(keys, "key", bounds, "rank")
    sizes = ranged.groupBy("rank").count().collect()
    most = max(least, 2 * sum(r["count"] for r in sizes) // ranges)
    full = [r["rank"] for r in sizes if r["count"] > most]
    found = ranged.where(F.col("rank").isin(full)).groupBy("key").count().where(F.col("count") > most).collect() if full else []
    hot = [(r["key"], r["count"]) for r in found]
    doubles = {float(k) for k, _ in hot if k is not None}
    return sorted({*bounds, *doubles, *(math.nextafter(d, math.inf) for d in doubles)}), most, hot


def _repeated(rows: DataFrame, hot: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows in which what a hot key repeats more than ``most`` times is once, and those rows with their number."""
    print_of = F.xxhash64("text").alias("print")
    often = _of(rows, hot, "left_semi").groupBy("key", print_of).count().where(F.col("count") > most).drop("count").collect()
    if not often:
        return rows, None
    # At most one row for each ``most`` rows of the table.
    told = F.broadcast(rows.sparkSession.createDataFrame(often, f"key {rows.schema['key'].dataType.simpleString()}, print long"))
    r, t = rows.withColumn("print", print_of).alias("r"), told.alias("t")
    same = F.expr("r.key <=> t.key AND r.print = t.print")
    once = settle(r.join(t, same, "left_semi").groupBy("key", "text").agg(F.count(F.lit(1)).alias("n")))
    return r.join(t, same, "left_anti").select("key", "text").unionByName(once.select("key", "text")), once


def _of(rows: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    return rows.alias("r").join(F.broadcast(hot.select("key")).alias("t"), F.expr("r.key <=> t.key"), how)


def _cut_by_text(rows: DataFrame, hot: DataFrame, most: int, each: int = 8, long: int = 128) -> DataFrame:
    """``hot`` (rank, key, n) with ``cuts``, the beginnings of texts that split the rows of the key. They come from about ``each``
    texts for a part and say only how evenly rows are dealt."""
    scale = 1 << 20
    some = F.pmod(F.xxhash64(F.lit(9), F.col("text")), F.lit(scale)) < F.lit(max(1, min(scale, each * scale // most)))
    r, t = rows.where(some).select("key", F.substring("text", 1, long).alias("cut")).alias("r"), F.broadcast(hot).alias("t")
    found = r.join(t, F.expr("r.key <=> t.key")).groupBy("t.rank", "t.n").agg(F.sort_array(F.collect_list("cut")).alias("all"))
    cuts = f"transform(sequence(1, ceil(n / {most})), i -> all[cast(i * size(all) div (ceil(n / {most}) + 1) as int)])"
    return hot.join(settle(found.select("rank", F.expr(cuts).alias("cuts"))), "rank", "left")


def _largest_texts(rows: DataFrame, room: int = 1 << 24) -> DataFrame:
    """``rows``: bucket, key, text.  For each bucket the hash of its largest text.  ``room``: characters that a task keeps."""
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [list(best), [k for k, _ in best.values()], [t for _, t in best.values()]]
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], key_type), pa.array(columns[2], pa.string())], names=["bucket", "key", "text"])
            best.clear()
            return out

        for batch in batches:
            key_type = batch.schema.field(1).type
            for bucket, k, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                had = best.get(bucket)
                if had is None or t > had[1]:  # by code point, as the bytes of UTF-8 are ordered
                    held += len(t) - (len(had[1]) if had else 0)
                    best[bucket] = (k, t)
                if held > room:
                    yield flush()
                    held = 0
        if best:
            yield flush()

    tops = rows.select("bucket", "key", "text").mapInArrow(run, f"bucket long, key {kind.simpleString()}, text string")
    return tops.groupBy("bucket").agg(F.first("key").alias("most"), F.max_by(F.xxhash64("text"), "text").alias("print"))


def with_next(df: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows dealt by ranges of the key and sorted in them.  ``own`` is false for copies of the first row of the next lower range,
    which the last row of a range looks at.  A key with more rows than a range should hold, or more than ``least``, is dealt by
    ranges of its texts.  Also rows that such a key repeats (key, text, n), of which only one is dealt, and the most of a range."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keys, once = rows.select("key"), None
    bounds, limit, crowded = _crowded(keys, least)
    place = lambda d: range_bucket(d, "key", bounds, "rank").withColumn("bucket", F.col("rank").cast("long") * F.lit(PARTS))
    by_key = lambda d: d.groupBy("bucket").agg(F.max("key").alias("most"), F.lit(None).cast("long").alias("print"))
    if not crowded:
        ends, ranged = by_key(place(keys)).collect(), place(rows)
    else:
        # Numbers so large that several share a double may share a range; the one with most rows is split.
        one = {}
        for k, n in sorted(crowded, key=lambda x: x[1]):
            one[bucket_of(bounds, k)] = (bucket_of(bounds, k), k, n)
        hot = spark.createDataFrame(list(one.values()), f"rank int, key {kind}, n long")
        rows, once = _repeated(rows, hot, limit)
        cut = _cut_by_text(rows, hot, limit).select("rank", F.col("key").alias("split"), F.coalesce("cuts", F.array().cast("array<string>")).alias("cuts"), F.lit(True).alias("is_hot"))
        by_text = lambda d: place(d).join(F.broadcast(cut), "rank", "left")
        whole, here = F.col("is_hot").isNull(), F.col("is_hot") & F.col("key").eqNullSafe(F.col("split"))
        part = F.lit(1) + F.size(F.filter("cuts", lambda x: x <= F.col("text")))
        side = F.when(whole | (F.col("key") < F.col("split")), F.lit(0)).otherwise(F.lit(PARTS - 1))
        rest = by_text(keys).where(whole | ~here).withColumn("bucket", F.col("bucket") + side)
        split = by_text(rows).withColumn("bucket", F.col("bucket") + F.when(here, part).otherwise(side))
        ends = by_key(rest).unionByName(_largest_texts(split.where(here))).collect()
        ranged = split.select("key", "text", "bucket")
    # One row for each range that has rows: bounded by the number of ranges.
    ends = sorted(ends, key=lambda r: r["bucket"])
    above = [(r["bucket"], r["most"], r["print"], ends[(i + 1) % len(ends)]["bucket"]) for i, r in enumerate(ends)]
    tops = spark.createDataFrame(above, f"bucket long, most {kind}, print long, above long")
    first = F.col("key").eqNullSafe(F.col("most")) & (F.col("print").isNull() | (F.col("print") == F.xxhash64("text")))
    to = lambda bucket, own: F.struct(bucket.alias("bucket"), F.lit(own).alias("own"))
    places = F.when(first, F.array(to(F.col("bucket"), True), to(F.col("above"), False))).otherwise(F.array(to(F.col("bucket"), True)))
    dealt = ranged.join(F.broadcast(tops), "bucket").withColumn("p", F.explode(places)).select("key", "text", "p.bucket", "p.own")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_first("key"), F.desc("text")), once, limit


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, s: Winnow = Winnow(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, n_chars and fingerprint.  No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([written(*fingerprint(t, s)) for t in texts], pa.string())], names=["key", "n_chars", "fingerprint"])

    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def compare_with_next(df: DataFrame, s: Winnow = Winnow(), key: str = "doc_id", text: str = "text", batch_rows: int = 256, least: int = 1024) -> DataFrame:
    """One row for each input row: its fingerprint, that of its edited text, and their likeness, and its
    likeness to the next document in descending order of the key (after the last: the first).  ``least``: rows of
    one key that stay together in any case."""
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        rows.clear()
        return out

    def compared(one: tuple, following: str, chosen: tuple) -> tuple:
        doc, own_text, (hashes, at) = one
        changed = edited(own_text, following)
        other = fingerprint(changed, s)
        return doc, len(own_text), hashlib.sha256(changed.encode()).hexdigest(), written(hashes, at), written(*other), likeness(hashes, other[0]), likeness(hashes, chosen[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last, at_bucket = None, None  # the row that waits for the next one
        for batch in batches:
            key_type = batch.schema.field(0).type
            for doc, t, bucket, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not own and (last is None or bucket != at_bucket):
                    continue  # a further copy with the same key
                chosen = fingerprint(t, s)
                if last is not None:
                    rows.append(compared(last, t, chosen))
                last, at_bucket = ((doc, t, chosen), bucket) if own else (None, None)
                if len(rows) >= batch_rows:
                    yield result(rows, key_type)
        if rows:
            yield result(rows, key_type)

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                chosen = fingerprint(t, s)
                row = compared((doc, t, chosen), t, chosen)
                for done in range(0, times, batch_rows):
                    yield result([row] * min(batch_rows, times - done), batch.schema.field(0).type)

    dealt, once, most = with_next(df, key, text, least)
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.mapInArrow(run, schema)
    if once is not None:
        # Each of the others is followed by its like.
        lots = once.where("n > 1").select("key", "text", "n", F.expr(f"explode(sequence(1L, n - 1, {most}L))").alias("start")).withColumn("times", F.least(F.lit(most), F.col("n") - F.col("start")))
        out = out.unionByName(lots.repartition("key", "start").select("key", "text", "times").mapInArrow(repeat, schema))
    return out.withColumnRenamed("key", key)
