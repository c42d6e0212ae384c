"""Segment files of a binary log as a table.

Files are read whole by Spark's own reader of binary files, from any store it knows; a segment's size is bounded
by the log's configuration.  Each file is decoded by one task, record by record until the first that is torn or
damaged.  A record that is whole again after it is not trusted, as the order of the log has broken off.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format, little-endian throughout.
HEADER_SIZE = 64
HEADER = "<4xIqqqqIQ"  # after the magic number: version, created, modified, write offset, entries, flags, first index
HEADER_SUM_AT = 56  # CRC-32C of all bytes before it
RECORD_HEADER_SIZE = 8  # CRC-32C of length and data; length
TRAILER = bytes.fromhex("deadbeeffeedface")
ALIGNMENT = 8
ENTRY = "<QQBq"  # term, index, type, nanoseconds; then two byte strings, each after its varint length
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_CRC = _table()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings, one byte of all of them at a time."""
    lengths = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    raw = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    sorted_lengths, sums = lengths[order], np.full(len(parts), 0xFFFFFFFF, np.uint32)
    active = len(parts)
    for at in range(int(lengths.max(initial=0))):
        while active and sorted_lengths[active - 1] <= at:
            active -= 1
        now = sums[:active]
        sums[:active] = _CRC[(now ^ raw[starts[:active] + at]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty_like(sums)
    out[order] = sums ^ np.uint32(0xFFFFFFFF)
    return out


@dataclass(frozen=True)
class Header:
    version: int
    created_at: int
    modified_at: int
    write_offset: int
    entries: int
    flags: int
    first_index: int


def header(raw: bytes) -> Header | None:
    """None if the header is cut short or its sum is wrong."""
    if len(raw) < HEADER_SIZE or crc32c([raw[:HEADER_SUM_AT]])[0] != struct.unpack_from("<I", raw, HEADER_SUM_AT)[0]:
        return None
    return Header(*struct.unpack_from(HEADER, raw, 0))


def records(raw: bytes) -> list[tuple[int, bytes]]:
    """Offsets and data of the whole records before the first that isn't."""
    found, at = [], HEADER_SIZE
    while at + RECORD_HEADER_SIZE <= len(raw):
        saved, length = struct.unpack_from("<II", raw, at)
        end = at + RECORD_HEADER_SIZE + length
        if not saved or end + len(TRAILER) > len(raw) or raw[end : end + len(TRAILER)] != TRAILER:
            break
        found.append((at, saved, raw[at + 4 : end]))
        at = -(-(end + len(TRAILER)) // ALIGNMENT) * ALIGNMENT
    right = crc32c([r for _, _, r in found]) == np.array([s for _, s, _ in found], np.uint32)
    whole = len(found) if right.all() else int(np.flatnonzero(~right)[0])
    return [(offset, r[4:]) for offset, _, r in found[:whole]]


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            break
        shift += 7
    if at + n > len(raw):
        raise IndexError("cut short")
    return raw[at : at + n], at + n


def entry(data: bytes) -> dict | None:
    """A log entry, or None if the record holds something else."""
    try:
        term, index, kind, nanos = struct.unpack_from(ENTRY, data, 0)
        body, at = _string(data, struct.calcsize(ENTRY))
        extra, _ = _string(data, at)
    except (struct.error, IndexError):
        return None
    return {"term": term, "index": index, "type": kind, "appended_nanos": nanos, "data": body, "extensions": extra}


SCHEMA = "path string, first_index long, slot long, offset long, length long, record binary, term long, index long, type int, appended_nanos long, data binary, extensions binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each whole record of the segment files under a path, with its entry if it decodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("path", pa.string()), *((n, pa.int64()) for n in ("first_index", "slot", "offset", "length")), ("record", pa.binary()), ("term", pa.int64()), ("index", pa.int64()), ("type", pa.int32()), ("appended_nanos", pa.int64()), ("data", pa.binary()), ("extensions", pa.binary())]
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                about = header(raw)
                rows = [{"path": name, "first_index": about.first_index if about else None, "slot": i, "offset": at, "length": len(r), "record": r, **(entry(r) or {})} for i, (at, r) in enumerate(records(raw))]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def newest(rows: DataFrame) -> DataFrame:
    """Of entries that were written again, the last: later segments and offsets replace earlier ones."""
    from pyspark.sql import functions as F

    cells = F.struct("term", "type", "appended_nanos", "data", "extensions", "path", "offset")
    return rows.where("index IS NOT NULL").groupBy("index").agg(F.max_by(cells, F.struct("path", "offset")).alias("e")).select("index", "e.*")
