"""Vector bin packing of token sequences.

Examples have a size in three dimensions: tokens, segments (one for each piece) and loss-bearing tokens.
A sequence is a bin with a limit in each.  The next piece for the open sequence is the one, of a bounded
pool, with the largest dot product of its size and the room that is left (each as a share of the limit)
among those that fit in all three; when none fits, the piece that needs most tokens is cut to fill the
room.  Pieces that alone fill a sequence never enter the pool.  At the end of a partition the rest of the
last sequence is split into sequences whose lengths are powers of two, which need no padding.

Each task packs the rows that it reads, in their order, so that no token is shuffled and no group of rows
meets in one task; the memory of a task is the pool.  Sequence ids hold the partition's number in their
upper bits.  A task that is run again reads the same rows and gives the same result.

Defined results: a null text is an empty document, which still has its separator token; a document of any
length is cut into pieces, each of its ids in exactly one; repeated rows and null ids are packed like any
other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import borrowed


@dataclass(frozen=True)
class Limits:
    """Of one sequence. ``pool``: pieces that are considered for the open sequence at a time."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    pool: int = 256


class ByteTokenizer:
    """Ids of a byte-level BPE file as little-endian 32-bit numbers.

    Between two characters that are not white space, a single space always starts a new pre-token of this
    kind of model, so that texts are cut there and each distinct stretch is merged once and kept in a
    bounded memory.  Texts with special strings or other runs of spaces go to the library whole."""

    def __init__(self, path: str, separator: int = 0, remember: int = 1_000_000, longest: int = 100):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.separator = np.array([separator], "<u4").tobytes()
        self.remember, self.longest, self.known = remember, longest, {}
        self.fast = self._fast_merges(path)

    def _fast_merges(self, path: str):
        """The same vocabulary in tiktoken, which merges faster; None if the file isn't plain byte BPE."""
        import json

        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model.get("pre_tokenizer") or {}
        if model["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer") or model["model"].get("dropout"):
            return None
        letters = sorted(ByteLevel.alphabet())
        # The printable stand-ins: bytes that print as themselves, and the others from U+0100 on in order.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        if sorted(to_byte) != letters:
            return None
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, stretch: str) -> bytes:
        # Letters of rarer scripts may be classed by another Unicode version; the library decides those.
        if self.fast is None or not (stretch.isascii() or max(stretch) < "\u0250"):
            return self._whole(stretch)
        return array("I", self.fast.encode_ordinary(stretch)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` and the separator."""
        if not text:
            return self.separator
        if any(s in text for s in self.special):
            return self._whole(text) + self.separator
        if text[0] == " " or text[-1] == " " or _RUN.search(text):
            return self._merge(text) + self.separator
        first, *rest = text.split(" ")
        known = self.known
        try:
            return self._bare(first) + b"".join(map(known.__getitem__, rest)) + self.separator
        except KeyError:
            pass
        if len(known) >= self.remember:
            known.clear()
        return self._bare(first) + b"".join([known.get(r) or self._spaced(r) for r in rest]) + self.separator

    def _spaced(self, word: str) -> bytes:
        """The ids of a space and ``word``, which has no space and doesn't start with white space."""
        head, *lines = word.split("\n")
        if lines and head and all(lines) and not _SPACE.search(word.replace("\n", "")):
            # A lone line break between other characters is a pre-token of its own.
            ids = self._spaced(head) + b"".join([self._bare("\n") + self._bare(x) for x in lines])
        else:
            ids = self.known.get(word)
            if ids is not None:
                return ids
            tail = _TAIL.search(word)
            if tail and word[: tail.start()].isalpha():  # letters, and then a pre-token of punctuation
                ids = self._spaced(word[: tail.start()]) + self._bare(tail[0])
            else:
                ids = self._merge(f" {word}")
        if len(word) <= self.longest:
            self.known[word] = ids
        return ids

    def _bare(self, word: str) -> bytes:
        """The ids of ``word`` where no space comes before it."""
        ids = self.known.get(f"\n{word}")
        if ids is None:
            ids = self._merge(word) if word else b""
            if len(word) <= self.longest:
                self.known[f"\n{word}"] = ids
        return ids


#: White space, with what some regular-expression engines count as such.
_SPACE = re.compile("[\\s\\x1c-\\x1f\\x85\u180e\u200b\u2060\ufeff]")
#: White space next to a space.
_RUN = re.compile(f" {_SPACE.pattern}|{_SPACE.pattern} ")
#: Punctuation that words often end with (no apostrophe, which may start a contraction).
_TAIL = re.compile(r"[.,;:!?)\]]+\Z")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, separator: int = 0) -> ByteTokenizer:
    """Built once in each process that packs, see ``borrowed``."""
    return ByteTokenizer(path, separator)


class Packer:
    """Places pieces of one partition; ``place`` gets (document, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, first_id: int, place: Callable[[object, int, int, int, int], None], loss_of: Callable[[int, int], int] = lambda start, length: length):
        self.limits, self.place, self.loss_of = limits, place, loss_of
        self.next_id = first_id
        self.full = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.sizes = np.zeros((limits.pool, 3))
        self.pieces: list[tuple[object, int, int]] = []
        self.open_id, self.used, self.content = -1, np.zeros(3), []

    def add(self, document: object, length: int) -> None:
        """All tokens of a document: full sequences at once, the rest to the pool."""
        start, most = 0, min(self.limits.tokens, self.limits.loss)
        while length - start >= most:
            size = most
            if size == self.limits.tokens:
                self.place(document, start, size, self.next_id, 0)
                self.next_id += 1
            else:
                self._pool(document, start, size)
            start += size
        if length > start:
            self._pool(document, start, length - start)

    def _pool(self, document: object, start: int, length: int) -> None:
        if len(self.pieces) == self.limits.pool:
            self._place_one()
        self.sizes[len(self.pieces)] = length, 1, self.loss_of(start, length)
        self.pieces.append((document, start, length))

    def _take(self, i: int) -> tuple[object, int, int]:
        piece, last = self.pieces[i], len(self.pieces) - 1
        self.pieces[i], self.sizes[i] = self.pieces[last], self.sizes[last]
        self.pieces.pop()
        return piece

    def _place_one(self) -> None:
        """Puts one piece of the pool, or the part of one that fits, into the open sequence."""
        while True:
            if self.open_id < 0:
                self.open_id, self.used, self.content, self.next_id = self.next_id, np.zeros(3), [], self.next_id + 1
            room, sizes = self.full - self.used, self.sizes[: len(self.pieces)]
            fits = (sizes <= room).all(axis=1)
            if fits.any():
                score = np.where(fits, (sizes / self.full) @ (room / self.full), -1.0)
                i = int(score.argmax())
                self._append(*self._take(i))
                return
            part = int(min(room[0], room[2])) if room[1] >= 1 else 0
            if part < 1:
                self._close()
                continue
            i = int(sizes[:, 0].argmax())
            document, start, length = self.pieces[i]
            part = min(part, length)
            while part > 1 and self.loss_of(start, part) > room[2]:
                part -= 1
            if self.loss_of(start, part) > room[2] or part == length:
                self._close()
                continue
            self._append(document, start, part)
            self.pieces[i] = (document, start + part, length - part)
            self.sizes[i] = length - part, 1, self.loss_of(start + part, length - part)

    def _append(self, document: object, start: int, length: int) -> None:
        self.content.append((document, start, length))
        self.used += (length, 1, self.loss_of(start, length))
        if self.used[0] >= self.limits.tokens:
            self._close()

    def _close(self) -> None:
        """A sequence that isn't full is split at powers of two, so that none of its parts is padded."""
        total = sum(length for _, _, length in self.content)
        lengths = [total] if total == self.limits.tokens else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        sequence, left, offset = self.open_id, list(reversed(self.content)), 0
        for n, size in enumerate(lengths):
            if n:
                sequence, offset, self.next_id = self.next_id, 0, self.next_id + 1
            while offset < size:
                document, start, length = left.pop()
                part = min(length, size - offset)
                self.place(document, start, part, sequence, offset)
                offset += part
                if part < length:
                    left.append((document, start + part, length - part))
        self.open_id = -1

    def finish(self) -> None:
        while self.pieces:
            self._place_one()
        if self.open_id >= 0 and self.content:
            self._close()


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(df: DataFrame, path: str, limits: Limits = Limits(), separator: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece.  The first token of a document has nothing before it that predicts it, so it
    bears no loss; the other tokens do."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with borrowed(tokenizer):
            yield from packed(batches)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = tokenizer(path, separator), []
        where = TaskContext.get()
        loss = lambda start, length: length - (start == 0)

        def place(document, start, length, sequence, offset):
            doc_id, ids = document
            rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset, loss(start, length)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])
            rows.clear()
            return out

        packer, key_type = Packer(limits, (where.partitionId() if where else 0) << 40, place, loss), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.encode(t)
                packer.add((doc_id, ids), len(ids) // 4)
                if len(rows) >= 8192:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
