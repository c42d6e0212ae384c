"""Quality rules as a bitmask ledger.

Every rule is evaluated once over the whole text.  The ledger keeps the measurements and one bit for
each rule that failed.  A policy is a versioned mask over those bits, so that verdicts of any policy,
and ablations of its rules, are bitwise arithmetic over the ledger and never read a text again.

Only built-in column functions are used.  Defined results: a null text counts as empty (no words, so
the base rule of 50 words fails); other columns, null ids and repeated rows pass through untouched; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words_column

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


@dataclass(frozen=True)
class Rule:
    """``failed``: builds the Boolean failure condition from a function that gives a measure's column."""

    bit: int
    name: str
    failed: object


#: Bits are never reused for another rule, so that old ledgers stay readable.
RULES = (
    Rule(0, "few_words", lambda m: m("n_words") < 50),
    Rule(1, "repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule(2, "symbols", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    Rule(3, "shouting", lambda m: 2 * m("n_upper") > m("word_chars")),
    Rule(4, "exclamations", lambda m: 10 * m("n_bangs") > 3 * m("n_words")),
    Rule(5, "repeated_lines", lambda m: (10 * m("n_dup_lines") > 3 * m("n_lines")) & (m("n_dup_lines") > 2)),
    Rule(6, "word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    @property
    def mask(self) -> int:
        known = {r.name: r.bit for r in RULES}
        return sum(1 << known[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def _measured(df: DataFrame, text: str, p: str) -> DataFrame:
    """Adds the measures, and helper arrays, all named with the prefix ``p``."""
    c = lambda name: F.col(f"`{p}{name}`")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    # One pass over the text leaves the few characters that the counts below look at.
    special = F.regexp_replace(whole, r"[^\p{Lu}!#*$%&|<>]+", "")
    df = df.withColumns({f"{p}words": words_column(F.col(f"`{text}`")), f"{p}lines": lines, f"{p}special": special})
    triple = lambda i: F.xxhash64(F.get(c("words"), i), F.get(c("words"), i + 1), F.get(c("words"), i + 2))
    no_hashes = F.array().cast("array<bigint>")
    df = df.withColumn(f"{p}hashes", F.when(F.size(c("words")) >= 3, F.transform(F.sequence(F.lit(0), F.size(c("words")) - 3), triple)).otherwise(no_hashes))
    # Only texts that repeat a window at all sort (hash, position) to find where.
    pairs = F.sort_array(F.transform(c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes"))
    df = df.withColumn(f"{p}pairs", F.when(repeats, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, k: F.coalesce(F.get(c("pairs"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(c("pairs"), k + 1)["h"] == x["h"], F.lit(False))
    covered = F.array_distinct(F.flatten(F.transform(F.filter(c("pairs"), same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    left = lambda kind: F.length(F.regexp_replace(c("special"), f"[^{kind}]+", "")).cast("long")
    long = lambda x: x.cast("long")
    return df.withColumns({
        f"{p}n_words": long(F.size(c("words"))),
        f"{p}word_chars": long(F.length(F.array_join(c("words"), ""))),
        f"{p}n_symbols": left("#*$%&|<>"),
        f"{p}n_dup_lines": long(F.size(c("lines")) - F.size(F.array_distinct(c("lines")))),
        f"{p}n_repeat_words": long(F.size(covered)),
        f"{p}n_lines": long(F.size(c("lines"))),
        f"{p}n_upper": left(r"\p{Lu}"),
        f"{p}n_bangs": left("!"),
    })


def failure_bits(measure) -> Column:
    """One long with a bit for each failed rule; ``measure`` maps a measure's name to a column."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.failed(measure), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: the key, all measures and ``failed_bits``."""
    inner = _measured(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", "m_")
    out = inner.select(F.col("key").alias(key), *[F.col(f"m_{m}").alias(m) for m in MEASURES])
    return out.withColumn("failed_bits", failure_bits(F.col))


def apply_policy(entries: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Adds the verdict of ``policy``: true if none of its rules failed."""
    return entries.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of ``policy``: rows that fail it, rows that fail it alone (which leaving the
    rule out would keep), and rows kept without it.  One pass of partial sums over the ledger."""
    bits, sums = F.col("failed_bits"), []
    rules = [r for r in RULES if r.name in policy.rules]
    hits = lambda mask: bits.bitwiseAND(F.lit(mask))
    total = lambda condition: F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))
    for r in rules:
        own = 1 << r.bit
        sums += [total(hits(own) != 0).alias(f"f{r.bit}"), total(hits(policy.mask) == own).alias(f"a{r.bit}"), total(hits(policy.mask & ~own) == 0).alias(f"k{r.bit}")]
    one = entries.agg(*sums)
    rows = F.array(*[F.struct(F.lit(policy.version).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"a{r.bit}").alias("n_failed_alone"), F.col(f"k{r.bit}").alias("n_kept_without")) for r in rules])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def keep(df: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``policy`` keeps, with the columns of ``df``; no shuffle, and no join."""
    p = "__quality_"
    while any(name.startswith(p) for name in df.columns):
        p = f"_{p}"
    measured = _measured(df, text, p)
    bits = failure_bits(lambda name: F.col(f"`{p}{name}`"))
    # A filter would be pushed below the measures and copy them into itself many times over; it stays above a
    # projection that isn't deterministic.
    judged = measured.withColumn(f"{p}bits", F.when(F.monotonically_increasing_id() >= 0, bits).otherwise(F.lit(0).cast("long")))
    return judged.where(F.col(f"`{p}bits`").bitwiseAND(F.lit(policy.mask)) == 0).select(*[F.col(f"`{name}`") for name in df.columns])
