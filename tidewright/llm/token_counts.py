"""Exact token counts with a whole-token shortcut.

The piece model never joins a symbol that is not white space to a following white-space symbol, and some
characters occur in no piece but their own.  Both facts are proved from the vocabulary when a counter is
built (see ``prove``): texts can then be cut into pre-tokens (white space and what follows it, or one such
character) that the model encodes independently.  Vocabulary strings of the form of a pre-token that encode
alone as one piece are proved offline too and counted directly; only other pre-tokens are merged by the
library, once for each process while they stay in a bounded memory.

Where the proof fails for a model, whole texts go to the library.  Nothing is shuffled.

Defined results: a null or an empty text has no tokens and no bytes; texts of any length are counted whole;
repeated rows and null ids keep their rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space in pieces


class PieceCounter:
    """Counts of one sentencepiece BPE model. ``remember``: most pre-tokens kept in memory; their counts are
    forgotten together beyond that, which changes no result."""

    def __init__(self, path: str, remember: int = 1_000_000, longest: int = 200):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remember, self.longest = remember, longest
        self.proved = self.prove()

    def prove(self) -> bool:
        """Checks that pre-tokens are independent, and finds the strings that encode alone as one token."""
        sp = self.model
        ordinary = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        marks_first = all(MARK not in p.lstrip(MARK) for p in ordinary)
        inside = {c for p in ordinary if len(p) > 1 for c in p}
        #: Neighbours within some piece; between any other two characters no merge can happen.
        self.joined = {p[i : i + 2] for p in ordinary for i in range(len(p) - 1)}
        spaces_kept = len(sp.encode("  a  b ", out_type=str)) and "".join(sp.encode("  a  b ", out_type=str)) == f"{MARK * 3}a{MARK * 2}b{MARK}"
        self.barrier = next((c for c in "\n\t\r" if c not in inside), None)
        plain = sp.encode("ÅﬁΩ x", out_type=str)  # a normaliser would change these
        if not (marks_first and spaces_kept and self.barrier and "".join(p for p in plain if not p.startswith("<0x")).lstrip(MARK).endswith(f"{MARK}x") and sp.decode(sp.encode("ÅﬁΩ x")) == "ÅﬁΩ x"):
            return False
        self.lone = len(sp.encode(self.barrier)) - 1  # the mark before it is a token of its own
        if self.lone != 1:
            return False
        self.barrier_id = sp.encode(self.barrier)[-1]
        self.single = {p[1:]: 1 for p in ordinary if len(p) > 1 and p[0] == MARK and MARK not in p[1:] and self._merge(p[1:]) == 1}
        self.counts = dict(self.single)
        return True

    def _between(self, ids: list[int]) -> list[int]:
        """How many ids stand between one barrier and the next."""
        at = [i for i, x in enumerate(ids) if x == self.barrier_id]
        return [b - a - 1 for a, b in zip(at, at[1:], strict=False)]

    def _merge(self, word: str) -> int:
        """Tokens of a space and ``word``, as they are within a text."""
        return len(self.model.encode(f"{self.barrier} {word}")) - 1 - self.lone

    def _bare(self, word: str) -> int:
        """Tokens of ``word`` after the barrier, where no space comes before it."""
        return len(self.model.encode(f"{self.barrier}{word}")) - 1 - self.lone

    def _run(self, spaced: str) -> int:
        """Tokens of a text that starts with a space (or MARK), in which runs of spaces may be longer."""
        total = 0
        for piece in re.findall(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+", spaced):
            total += self._merge(piece[1:]) if piece[0] in f" {MARK}" else self._bare(piece)
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.proved:
            return len(self.model.encode(text))
        counts, total, first = self.counts, 0, True
        for line in text.split(self.barrier):
            if not first:
                total += self.lone
            if not line and not first:
                continue
            # The library puts one space before the whole text; later lines have none.
            words = line.split(" ")
            if "" in words or MARK in line:
                total += self._run(f" {line}") if first else self._run(line)
            else:
                if not first:
                    words[0] = "\n" + words[0]
                try:
                    total += sum(map(counts.__getitem__, words))
                except KeyError:
                    total += self._learn(words)
            first = False
        return total

    def _learn(self, words: list[str]) -> int:
        """The tokens of ``words``, some of them new; a line break starts one with no space before it."""
        if len(self.counts) >= self.remember:
            self.counts.clear()
            self.counts.update(self.single)
        counts, merge = self.counts, {}
        for word in set(words).difference(counts):
            core = word
            tail = _TAIL.search(word)
            if tail and tail.start() > 1 and word[tail.start() - 1 : tail.start() + 1] not in self.joined:
                core = word[: tail.start()]  # what follows is counted apart
            merge[word] = core
        new = [c for c in {*merge.values(), *("\n" + w[len(c) :] for w, c in merge.items() if len(c) < len(w))} if c not in counts]
        # One call for all: each stands between two barriers, which no merge crosses.
        joined = "".join(f"{self.barrier}{c[1:]}" if c[:1] == "\n" else f"{self.barrier} {c}" for c in new)
        fresh = dict(zip(new, self._between(self.model.encode(f"{joined}{self.barrier}")), strict=True)) if new else {}
        of = lambda c: fresh[c] if c in fresh else counts[c]
        sums = {w: of(c) + (of("\n" + w[len(c) :]) if len(c) < len(w) else 0) for w, c in merge.items()}
        total = sum(sums[w] if w in sums else counts[w] for w in words)
        counts.update((k, v) for k, v in (*fresh.items(), *sums.items()) if len(k) <= self.longest)
        return total


#: Punctuation that words often end with.
_TAIL = re.compile(r"[.,;:!?\"')\]]+\Z")


class LibraryCounter:
    """Counts of a ``tokenizers`` file, by the library; for models without the proof above."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str | None) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids) if text else 0


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | LibraryCounter:
    """Built once in each process."""
    return PieceCounter(path) if path.endswith(".model") else LibraryCounter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, n_bytes, n_tokens and over_limit."""
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            tokens = [own.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["key", "n_bytes", "n_tokens", "over_limit"])

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = df.select(F.col(f"`{key}`").alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    return slim.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
