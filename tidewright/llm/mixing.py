"""Mixing sources to target weights by subset-sum budget fitting.

Sources, in the order of their names, weigh 1, 2, 3, 1, 2, 3, ... and share the words of the whole table by
weight; no source is taken more than three times over, and what it cannot use goes to the others by weight.
A source is first taken as often as it fits into its target as a whole.  What remains of the budget is fitted
with whole documents: for each exact length it is decided how many documents of that length are taken once
more.  An even share of every length comes first, so that long and short documents stay in proportion; the
little that is left then is filled by bounded-knapsack dynamic programming over the lengths.  Which documents
of a length are taken is decided by a seeded hash, so reruns agree.

What is planned on is the count of documents by (source, length, hash bucket), summed before it is shuffled.
A source is planned in one task from its distinct lengths, whose number is bounded by the longest text and
not by the rows.  Documents meet their plan by (source, length, bucket), so that a source or a group of
copies with a third of all rows is spread over the buckets.  Sources are a table too, however many there are: their
numbers come from a sort by ranges, and the driver sees the sums of a round of the shares, and a count for each range.

Defined results: a null text has size 0; a null source is a source of its own, after all others; documents
without words are taken with 0 words; repeated rows are separate documents, and equal hashes are told apart
by their number of row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, words_column

BUCKETS = 256


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Each source's share of the sum of ``sizes``, at most ``most`` times its own size."""
    total, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in sorted(free) if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
            free.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def numbered(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the place of each row in the order of ``column``, null last, from 0.  Ranges are sorted where they are; the driver
    sees how many rows each has."""
    ranged = settle(df.repartitionByRange(F.asc_nulls_last(column)).sortWithinPartitions(F.asc_nulls_last(column)).withColumn("id", F.monotonically_increasing_id()))
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["n"]
    first = df.sparkSession.createDataFrame(starts, "part long, first long")
    return ranged.withColumn("part", part).join(F.broadcast(first), "part").withColumn(out, F.col("first") + place).drop("part", "first", "id")


def shared(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sources``: source and words.  Adds ``target``, as ``targets`` does for a list.  Weights and sizes are whole numbers, so
    that their sums don't depend on their order."""
    if any(w != int(w) or w <= 0 for w in weights):
        raise ValueError("weights must be whole numbers above 0")
    weight = F.get(F.array(*[F.lit(int(w)).cast("long") for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    rows = settle(numbered(sources, "source", "place").select("source", "words", weight.alias("weight"), F.lit(False).alias("full")))
    total = rows.agg(F.sum("words")).first()[0] or 0
    while True:
        # What is left for the sources that aren't full, and their weights: two numbers.
        taken, heavy = rows.agg(F.sum(F.when(F.col("full"), F.col("words"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        if not heavy:
            break
        left = total - most * (taken or 0)
        over = ~F.col("full") & (F.lit(left).cast("decimal(38,0)") * F.col("weight") > F.col("words").cast("decimal(20,0)") * F.lit(most * heavy))
        again = settle(rows.withColumn("full", F.col("full") | over))
        if again.where("full").count() == rows.where("full").count():
            break
        rows = again
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(heavy)) if heavy else F.lit(0.0)
    return rows.select("source", "words", F.when(F.col("full"), (F.col("words") * F.lit(most)).cast("double")).otherwise(share).alias("target"))


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int, again: int = 1, window: int = 1 << 15, items: int = 4096) -> list[int]:
    """How often documents of each length are taken so that their words come near to ``budget``.

    First each document at most once.  Where that leaves over a thousandth of the budget, because long ones
    don't fit, further times up to ``again``; and at last one document may overshoot if that is nearer.
    ``window``: largest budget that dynamic programming is asked for; ``items``: most lengths it weighs up at a time.
    Both bound its memory; what is beyond the window is filled greedily by length, and where there are more
    lengths, each further lot of them is given what the one before has left."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total and again == 1:
        return list(counts)
    taken = [min(c, c * budget // total) if total else 0 for c in counts]
    left = _fill(lengths, counts, taken, budget, window, items)
    if left * 1000 > budget and again > 1:
        left = _fill(lengths, [c * again for c in counts], taken, budget, window, items)
    if left * 1000 > budget:
        over = [(n, i) for i, n in enumerate(lengths) if left < n < 2 * left and taken[i] < counts[i] * again]
        if over:
            taken[min(over)[1]] += 1
    return taken


def _fill(lengths: Sequence[int], most: Sequence[int], taken: list[int], budget: int, window: int, items: int) -> int:
    """Raises ``taken`` towards the budget, up to ``most`` of each length; what is left of it."""
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:  # the longest first, until what is left is small
        if left <= window:
            break
        more = min(most[i] - taken[i], max(0, left - window // 2) // lengths[i]) if lengths[i] else 0
        taken[i] += more
        left -= more * lengths[i]
    for i in order:  # and no more than it takes where the lengths are near to the window
        if left <= window:
            break
        more = min(most[i] - taken[i], left // lengths[i], -(-(left - window) // lengths[i])) if lengths[i] else 0
        taken[i] += more
        left -= more * lengths[i]
    free = [(lengths[i], most[i] - taken[i], i) for i in reversed(order) if 0 < lengths[i] <= left and most[i] > taken[i]]
    step = max(1, -(-len(free) // items))
    for k in range(step):  # every length is weighed up, as long as anything is left
        if left:
            left = _reach(free[k::step], taken, left)
    return left


def _reach(free: Sequence[tuple[int, int, int]], taken: list[int], left: int) -> int:
    """Raises ``taken`` by the largest sum of (length, times, place) up to ``left``; what is left then."""
    # Bit s of a state is set if the sum s can be reached; counts are split into powers of two.
    states, parts, mask = [1], [], (1 << (left + 1)) - 1
    for n, c, i in free:
        c, power = min(c, left // n), 1
        while c > 0 and not states[-1] >> left & 1:
            part = min(power, c)
            states.append((states[-1] | states[-1] << (part * n)) & mask)
            parts.append((part, n, i))
            c, power = c - part, power * 2
    at = states[-1].bit_length() - 1
    left -= at
    for (part, n, i), before in zip(reversed(parts), reversed(states[:-1]), strict=True):
        if not before >> at & 1:
            taken[i] += part
            at -= part * n
    return left


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 20, drawn_by: str | None = None) -> DataFrame:
    """One row for each input row: key, size, source_size, target and taken; also ``times``.  The hash that decides which
    documents of a length are taken is of the text and of ``drawn_by`` (the key, unless another column is named)."""
    c = lambda name: F.col(f"`{name}`")
    slim = df.select(c(key).alias("key"), c(drawn_by or key).alias("drawn_by"), c(source).cast("string").alias("source"), F.size(words_column(c(text))).cast("long").alias("size"), F.xxhash64(c(text)).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    luck = F.xxhash64(F.lit(seed), F.col("drawn_by"), F.col("text_hash"))
    rows = settle(slim.withColumn("luck", luck).withColumn("bucket", F.pmod(F.col("luck"), F.lit(BUCKETS)).cast("int")).drop("drawn_by"))
    return plan(rows, weights, most).withColumnRenamed("key", key)


def plan(rows: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``rows``: row, key, text_hash, source, size, luck, bucket."""
    by_bucket = settle(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    by_size = by_bucket.groupBy("source", "size").agg(F.sum("n").alias("n"))
    shares = shared(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), weights, most)

    def of_source(lengths: pd.DataFrame) -> pd.DataFrame:
        words, target = int(lengths["words"].iloc[0]), float(lengths["target"].iloc[0])
        lengths = lengths.sort_values("size", ignore_index=True)
        times = min(most, int(target // words)) if words else 1
        budget = 0 if times >= most or not words else round(target - times * words)
        n = lengths["n"].to_numpy("int64")
        more = np.asarray(fit(lengths["size"].tolist(), n.tolist(), budget, most - times) if budget else [0] * len(n), "int64")
        return pd.DataFrame({"source": lengths["source"], "size": lengths["size"], "times": times + more // n, "more": more % n, "source_size": words, "target": target})

    a, b = by_size.alias("a"), shares.alias("b")
    known = a.join(b, F.expr("a.source <=> b.source")).select("a.source", "a.size", "a.n", "b.words", "b.target")
    planned = known.groupBy("source").applyInPandas(of_source, "source string, size long, times long, more long, source_size long, target double")
    # Buckets are filled one after the other; in the last that is reached, the smallest hashes are taken.
    a, b = by_bucket.alias("a"), planned.alias("b")
    each = a.join(b, F.expr("a.source <=> b.source AND a.size = b.size")).select("a.source", "a.size", "a.bucket", "a.n", "b.times", "b.more", "b.source_size", "b.target")
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.coalesce(F.sum("n").over(before), F.lit(0))))).select("source", "size", "bucket", "times", "extra", "source_size", "target")
    both = rows.alias("a").join(each.alias("b"), F.expr("a.source <=> b.source AND a.size = b.size AND a.bucket = b.bucket")).select("a.row", "a.key", "a.text_hash", "a.source", "a.size", "a.bucket", "a.luck", "b.times", "b.extra", "b.source_size", "b.target")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("luck", "key", "row"))
    times = F.col("times") + F.when(rank <= F.col("extra"), 1).otherwise(0)
    return both.withColumn("times", times).select("key", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "times", "text_hash")
