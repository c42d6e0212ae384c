"""Substring dedup by level-wise doubling.

Windows that are repeated at one length alone are extended to twice that length, until none survives or the
wanted length is reached.  A range of documents that has no candidate left does nothing more.

Before the wanted length, levels are sampled without losing any repeat: of the runs of a level's length inside each
wanted window the one with the smallest hash is its anchor, so equal windows have equal anchors.  Only windows
whose anchor is repeated are looked at in the next level.

Documents are dealt by ranges of their key, once; each range is one batch that first settles its own repeats.  There
are as many ranges as their bytes ask for.  Between ranges only hashes travel, each once for a range however often
it occurs there, so a line that a third of all documents hold is one row for each range.  Ranges ascend with the key, so the
smallest range that holds a hash holds its first document.  What comes back to a range are the hashes that
lower ranges hold; the range then marks the words.  The deal of documents is one exchange that all passes
reuse.  Rows of one key don't remove from each other, so null keys, and a key with more rows than a range should hold,
are dealt to several parts of one rank, and parts of a rank don't look at each other.

Hashes have 64 bits.  Defined results: a null text has no words; documents shorter than a window lose nothing;
a null key counts as larger than all others; rows with equal keys don't remove from each other, as neither is
smaller; repeated windows inside one document stay; very long texts are one document like any other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_bounds, range_bucket, shuffle_partitions

#: Bytes of text of a range, and the parts that a rank may have.
RANGE_BYTES, PARTS = 128 << 20, 1 << 20


@dataclass
class Batch:
    """The documents of one range. ``words``: of all documents together; ``starts``: where each begins."""

    keys: np.ndarray
    words: list[list[bytes]]
    hashes: np.ndarray
    starts: np.ndarray


def read_batch(keys: list[int], texts: list[bytes | None]) -> Batch:
    words = [(t or b"").split() for t in texts]  # for bytes: ASCII white space only
    flat = [w for one in words for w in one]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(flat)}
    hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    return Batch(np.array(keys, np.int64), words, hashes, starts)


_BASE = 0x9E3779B97F4A7C15


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, put together by doubling."""
    n, done, out = len(words), 0, None
    if n < length:
        return np.zeros(0, np.uint64)
    power, size = words, 1
    while True:
        if length & size:
            count = n - (done + size) + 1
            factor = np.uint64(pow(_BASE, size, 1 << 64))
            out = power[:count] if out is None else out[:count] * factor + power[done : done + count]
            done += size
        if done == length:
            break
        power = power[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:]
        size *= 2
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def positions(batch: Batch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie within one document, and the document of each."""
    sizes = np.diff(batch.starts)
    counts = np.maximum(0, sizes - length + 1)
    doc = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(batch.starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(counts.sum()), doc


def anchors(batch: Batch, window: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its start, its document, and the hash of its anchor."""
    at, doc = positions(batch, window)
    if not len(at):
        return at, doc, np.zeros(0, np.uint64)
    low, size, span = window_hashes(batch.hashes, base), 1, window - base + 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return at, doc, np.minimum(low[at], low[at + span - size])


def first_keys(batch: Batch, at: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct window hashes, each one's place among them, the windows' own keys, and each hash's smallest key."""
    every = window_hashes(batch.hashes, window)[at]
    distinct, place = np.unique(every, return_inverse=True)
    keys = batch.keys[doc]
    least = np.full(len(distinct), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(least, place, keys)
    return distinct, place, keys, least


def lengths(window: int, first: int) -> list[int]:
    """The levels: doubled from the first one, up to the window."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def dealt(df: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with the number of their part: ``PARTS`` times their rank, in which keys ascend, and a number among the
    parts of the rank, above 0 only for rows of one key."""
    slim = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    size = slim.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("key").isNull().cast("long")).alias("nulls")).first()
    ranges = max(3 * shuffle_partitions(df.sparkSession), -(-(size.bytes or 0) // RANGE_BYTES))
    rows = max(1, size.n // ranges)
    bounds = range_bounds(df.select(F.col(f"`{key}`").alias("key")), "key", ranges)
    # A key with more rows than a range should hold stands at a bound; the bounds bound how many are looked at.
    hot = [] if not bounds else slim.join(F.broadcast(df.sparkSession.createDataFrame([(int(b),) for b in bounds if abs(b) < 2**53], "key long")), "key").groupBy("key").count().where(F.col("count") > 2 * rows).collect()
    parts = lambda n: min(PARTS, -(-n // rows))
    part = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("text"), F.lit(parts(size.nulls or 1))))
    for r in hot:
        part = part.when(F.col("key") == r["key"], F.pmod(F.xxhash64("text"), F.lit(parts(r["count"]))))
        bounds = sorted({*bounds, float(r["key"]), float(r["key"] + 1)})
    return range_bucket(slim, "key", bounds, "rank").withColumn("bucket", (F.col("rank").cast("long") * F.lit(PARTS) + F.coalesce(part, F.lit(0))).cast("long")).drop("rank")


def _between(hashes: DataFrame, lower_only: bool) -> DataFrame:
    """``hashes``: h, bucket, distinct.  Rows whose hash is in another part too, or in one of a lower rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        h, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((bucket, h))
        h, bucket = h[order], bucket[order]
        starts = np.concatenate([[True], h[1:] != h[:-1]])
        if lower_only:
            lowest = bucket[np.maximum.accumulate(np.where(starts, np.arange(len(h)), 0))]
            kept = lowest // PARTS < bucket // PARTS
        else:
            kept = ~(starts & np.concatenate([starts[1:], [True]]))
        h, bucket = h[kept], bucket[kept]
        for a in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000]), pa.array(bucket[a : a + 100_000])], names=["h", "bucket"])

    return hashes.repartition("h").mapInArrow(run, "h long, bucket long")


def _as_batch(frame: pd.DataFrame) -> Batch:
    # Null keys have parts of their own, in which all keys are equal.
    return read_batch([0] * len(frame) if frame["key"].isna().any() else frame["key"].tolist(), frame["text"].tolist())


def _frame(hashes: np.ndarray, bucket: int) -> pd.DataFrame:
    return pd.DataFrame({"h": hashes.view(np.int64), "bucket": np.full(len(hashes), bucket, np.int64)})


def remove_repeats(df: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", first: int | None = None, texts: bool = True) -> DataFrame:
    """One row for each input row: key, n_words, n_removed, kept_sha256, and kept_text if ``texts``.  ``first``: the length of
    the first level, about half the window if none is given."""
    docs, levels = dealt(df, key, text), lengths(window, first or max(1, (window + 1) // 2))

    def first_level(k: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        _, _, anchor = anchors(_as_batch(docs), window, levels[0])
        return _frame(np.unique(anchor), k[0])

    def next_level(length: int, before: int):
        def run(k: tuple, docs: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
            if not len(repeated) or not len(docs):
                return _frame(np.zeros(0, np.uint64), 0)  # no candidate survives here
            batch = _as_batch(docs)
            at, _, anchor = anchors(batch, window, before)
            again = np.isin(anchor, repeated["h"].to_numpy().view(np.uint64))
            found = window_hashes(batch.hashes, window)[at[again]] if length == window else anchors(batch, window, length)[2][again]
            return _frame(np.unique(found), k[0])

        return run

    def remove(k: tuple, docs: pd.DataFrame, lower: pd.DataFrame) -> pd.DataFrame:
        batch = _as_batch(docs)
        gone = np.zeros(len(batch.hashes) + 1, np.int64)
        at, doc = positions(batch, window)
        if len(at):
            distinct, place, keys, least = first_keys(batch, at, doc, window)
            below = np.isin(distinct, lower["h"].to_numpy().view(np.uint64))
            hit = at[below[place] | (keys > least[place])]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        rows, unnamed = [], bool(docs["key"].isna().any())
        for i, words in enumerate(batch.words):
            mask = covered[batch.starts[i] : batch.starts[i + 1]]
            kept = b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g] if mask.any() else words)
            rows.append((None if unnamed else int(batch.keys[i]), len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts else [])))
        return pd.DataFrame(rows, columns=["key", "n_words", "n_removed", "kept_sha256", *["kept_text"][: int(texts)]]).astype({"key": "Int64"})

    by_part, lower = docs.groupBy("bucket"), None
    found = by_part.applyInPandas(first_level, "h long, bucket long")
    for before, length in zip(levels, levels[1:], strict=False):
        repeated = _between(found, lower_only=False)
        found = by_part.cogroup(repeated.groupBy("bucket")).applyInPandas(next_level(length, before), "h long, bucket long")
    lower = _between(found, lower_only=True)
    out = by_part.cogroup(lower.groupBy("bucket")).applyInPandas(remove, "key long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    return out.withColumnRenamed("key", key)
