"""Secret scans with corpus-wide ownership frequency.

One pass over every whole text finds candidates: three base kinds, and further kinds with a recognisable
form.  A candidate's value is hashed, and the corpus is asked in how many repositories and by how many
owners each hash occurs.  Values that many owners have are copied examples (documentation, placeholders);
values of one owner, or of very few, with a varied alphabet look like live credentials.

The scan's result, without texts, is written to the checkpoint folder once and read for the counts and for
the verdicts.  Counts are partial sums by (hash, owner, repository), then by (hash, owner), then by hash, so
a value that a third of all rows holds is one row for each task before it is shuffled.  Verdicts come back by
a join on the hash; hashes with more than 1/512 of all candidates, fewer than 512, are broadcast, and their
candidates are not shuffled.  Nothing is collected.

Defined results: a null text counts as empty; a null owner or repository counts as one owner or repository
named null; repeated rows keep their rows, and count once as a repository if its column says so; ties don't
arise, as spans are sorted by start, kind and end; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_one, settle

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Further kinds, of which only live-looking values become spans: name, a string that every match has, pattern.
EXTRA = (
    ("hosting", "_", re.compile(r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("payment", "k_live_", re.compile(r"\b[sr]k_live_[A-Za-z0-9]{16,}")),
    ("cloud", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35,}")),
    ("signed", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", "PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")),
)
#: Of a text with a candidate, its lower-case form has one of these strings or it has a match of one of these patterns.
_NAMED = ("passw", "secret", "token", "api")
_SHAPED = ("[0-9a-f]{24}", "(?=[AgxkeP])(?:AKIA|gh[pousr]_|xox[abprs]-|k_live_|AIza|eyJ|PRIVATE KEY-----)")
KINDS = ("assign", "access", "hex", *(name for name, _, _ in EXTRA))
BASE = 3


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of all candidates, sorted."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    for k, (_, must, pattern) in enumerate(EXTRA, BASE):
        if must in text:
            found += [(m.start(), k, m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found)


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_CANDIDATE = "struct<start:bigint,kind:int,stop:bigint,hash:string,varied:boolean>"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", least_bits: float = 2.5) -> DataFrame:
    """One row for each input row: row, key, owner, repository, text_hash and the array of candidates.
    ``least_bits``: entropy of a character from which a value counts as varied."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("hash", pa.string()), ("varied", pa.bool_())]))
        for batch in batches:
            found = [[{"start": a, "kind": k, "stop": b, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "varied": bits_per_character(v) >= least_bits} for a, k, b, v in find(t)] for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(found, typed)], names=["key", "owner", "repository", "text_hash", "candidates"])

    c = lambda name: F.col(f"`{name}`")
    slim = df.select(c(key).alias("key"), c(owner).cast("string").alias("owner"), c(repository).cast("string").alias("repository"), F.xxhash64(c(text)).alias("text_hash"), c(text).alias("text"))
    out = slim.mapInArrow(run, f"key {kind}, owner string, repository string, text_hash long, candidates array<{_CANDIDATE}>")
    return out.withColumn("row", F.monotonically_increasing_id())


def possible(text: Column) -> Column:
    """Whether ``find`` can find anything in the text; cheap, in the JVM, and true for some texts without candidates."""
    named = F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [low.contains(w) for w in _NAMED]))  # lower-cased once
    return F.coalesce(reduce(or_, [text.rlike(p) for p in _SHAPED], named), F.lit(False))


def frequency(scanned: DataFrame) -> DataFrame:
    """For each hash: rows of distinct repositories (within an owner) and of distinct owners."""
    one = scanned.select("owner", "repository", F.explode(F.array_distinct("candidates.hash")).alias("hash")).groupBy("hash", "owner", "repository").agg(F.lit(1).alias("n"))
    by_owner = one.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def judged(scanned: DataFrame, most_owners: int = 2, most_repositories: int = 5) -> DataFrame:
    """One row for each candidate: row, key, text_hash, its fields, repositories, owners, and whether it is ``copied`` or looks
    ``live``.  ``most_owners`` and ``most_repositories``: up to so many a value is specific to its owners; a value with one owner is
    in any number of repositories.  A specific value whose characters vary little is neither copied nor live."""
    single = scanned.select("row", "key", "text_hash", F.explode("candidates").alias("c")).select("row", "key", "text_hash", "c.*")
    copied = (F.col("owners") > most_owners) | ((F.col("owners") > 1) & (F.col("repositories") > most_repositories))
    return join_one(single, frequency(scanned), "hash").withColumn("copied", copied).withColumn("live", F.col("varied") & ~copied)


def _of_kind(k: int):
    """A test with one argument only: a second one would be given the position."""
    return lambda x: x["kind"] == k


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row for each input row: counts and spans of the base kinds and of live-looking further ones, and
    how many candidates look live or are widely copied."""
    scanned = settle(scan(df, key, text, owner, repository))
    some = judged(scanned).groupBy("row", "key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "live", "copied"))).alias("found"))
    none = scanned.where(F.size("candidates") == 0).select("row", "key", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,live:boolean,copied:boolean>>").alias("found"))
    found, names = F.col("found"), F.array(*[F.lit(k) for k in KINDS])
    base = F.filter(found, lambda x: x["kind"] < BASE)
    kept = F.filter(found, lambda x: (x["kind"] < BASE) | x["live"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")
    count = lambda test: F.size(F.filter(found, test)).cast("long")
    return some.unionByName(none).select(
        F.col("key").alias(key),
        *[count(_of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(kept).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: x["copied"]).alias("n_copied"),
    )


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", mark: str = "[REDACTED]", count: str = "__n_redacted") -> DataFrame:
    """The rows of ``df`` with live-looking values replaced by ``mark``, and the column ``count``: how many.

    A span of an assignment goes as a whole, with its name; overlapping spans are replaced as one.  Texts that can hold no
    candidate pass by without a shuffle; only the others meet their spans."""
    c = lambda name: F.col(f"`{name}`")
    # The row travels as one struct, so that none of its names can clash with those used here.
    whole_rows = df.select(F.struct(*[c(n) for n in df.columns]).alias("whole_row"), c(key).alias("k"), c(owner).alias("o"), c(repository).alias("r"), c(text).alias("t"))
    asked = whole_rows.where(possible(F.col("t")))
    scanned = settle(scan(asked, "k", "t", "o", "r"))
    live = judged(scanned).where("live").select("key", "text_hash", "start", "stop").distinct()
    spans = live.groupBy("key", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    tagged = asked.select("whole_row", "k", F.xxhash64("t").alias("h"))
    both = tagged.join(spans, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("text_hash")), "left")
    both = both.select("whole_row", "spans").unionByName(whole_rows.where(~possible(F.col("t"))).select("whole_row", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans")))
    # Spans in order; each keeps what stands between it and the end of the one before.
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"))
    whole = F.col("whole_row").getField(text)
    step = lambda a, x: F.when(x["stop"] <= a["at"], a).otherwise(F.struct(F.concat(a["done"], F.when(x["start"] >= a["at"], F.concat(F.substring(whole, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("done"), x["stop"].alias("at"), (a["n"] + F.when(x["start"] >= a["at"], 1).otherwise(0)).alias("n")))
    done = F.aggregate("spans", start, step, lambda a: F.struct(F.concat(a["done"], F.substring(whole, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))).alias("text"), a["n"].alias("n")))
    both = both.withColumn("done", F.when(F.col("spans").isNotNull(), done))
    return both.select(*[F.coalesce(F.col("done.text"), whole).alias(n) if n == text else F.col("whole_row").getField(n).alias(n) for n in df.columns], F.coalesce(F.col("done.n"), F.lit(0)).alias(count))
