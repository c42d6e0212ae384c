"""SimHash near-duplicates with BK-trees.

A fingerprint has a bit for each of 64: whether more than half of the hashes of a text's shingles have it.
Texts are linked if their fingerprints differ in few bits.

Distinct fingerprints are found first, so that copies cost one row.  Two fingerprints within the radius r are
equal in at least one of r + 1 blocks of their bits, so each fingerprint goes to one shard for each block: the
fingerprints that share it.  A shard's tree stands in one task: children are keyed by their integer distance
to the parent, and a search follows only edges within the radius of its own distance.  Trees are not sent
through the driver, because all of them together hold every fingerprint; a broadcast would have no bound.
Shards with more than ``crowd`` members are dealt again by the blocks of the bits that remain (again, one of
r + 1 must be equal) until they are bounded, which loses no pair.

A shard gives a spanning forest of its links, at most one row for each member, never all pairs.  Forests are
joined by star contraction (see graphs.py), whose rounds are written to the checkpoint folder.

Defined results: a null or a wordless text has the fingerprint zero and is linked like any other; a null key
is the largest of all, so it is a component's id only if there is no other; repeated rows keep their rows; an
empty table gives an empty result; other columns are not read.

Texts that are similar beyond a few bits (``similar``) have longer fingerprints and a wide radius, so that no block of
bits need be equal; their shards are bands of smallest hashes, and the sets are compared of what the trees find.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_one, settle
from .graphs import components

BITS = 64


def hashes(text: bytes | None, shingle: int = 3) -> list[int]:
    """XXH64 (seed 42) of each run of ``shingle`` words, lower-cased (A-Z) and joined by spaces."""
    words = (text or b"").lower().split()  # for bytes: ASCII letters and ASCII white space only
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    runs = zip(*(words[i:] for i in range(shingle)), strict=False)
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)))


def majority(values: list[int] | np.ndarray) -> int:
    """The bits that more than half of the values have, as a signed 64-bit number."""
    if not len(values):
        return 0
    counts = np.zeros(BITS, np.int64)
    whole = np.array(values, "<u8").view(np.uint8).reshape(len(values), 8)
    for a in range(0, len(values), 4096):
        counts += np.unpackbits(whole[a : a + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, text_hash and fingerprint (a signed long).  No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(hashes(t, shingle)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["key", "text_hash", "fingerprint"])

    slim = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").cast("binary").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, text_hash long, fingerprint long")


def distances(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits of rows of unsigned words (numbers with a sign would be counted by their absolute value)."""
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


class Tree:
    """A BK-tree over distinct fingerprints, each a row of unsigned words; many are looked up at a time."""

    def __init__(self, members: np.ndarray):
        self.members = members
        self.children: list[dict[int, int]] = [{} for _ in members]
        # All that hang below an edge are dealt to its subtree together, as one insert after the other would do.
        todo = [(0, np.arange(1, len(members)))] if len(members) else []
        while todo:
            node, below = todo.pop()
            if not len(below):
                continue
            distance = distances(members[below], members[node])
            for d in np.unique(distance).tolist():
                group = below[distance == d]
                self.children[node][d] = int(group[0])
                todo.append((int(group[0]), group[1:]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node with queries within the radius: the node, and their positions."""
        todo = [(0, np.arange(len(queries)))] if len(self.members) else []
        while todo:
            node, asked = todo.pop()
            distance = distances(queries[asked], self.members[node])
            near = asked[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                reach = asked[np.abs(distance - edge) <= radius]
                if len(reach):
                    todo.append((child, reach))


def forest(ids: np.ndarray, members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (id, smallest id of its component) of one shard; ids ascend, members are rows of unsigned words."""
    n = len(ids)
    if n == 2:
        return [(int(ids[1]), int(ids[0]))] if distances(members[1:], members[0])[0] <= radius else []
    root = np.arange(n)
    for _, near in Tree(members).search(members, radius):
        top = tops(root, near)
        least = top.min()
        if (top != least).any():
            root[top] = least
    root = tops(root, np.arange(n))
    return [(int(ids[i]), int(ids[root[i]])) for i in np.flatnonzero(root != np.arange(n))]


def tops(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots that ``at`` lead to; paths are shortened on the way."""
    top = root[at]
    while (top != (above := root[top])).any():
        top = above
    root[at] = top
    return top


def _shards(members: DataFrame, radius: int) -> DataFrame:
    """``members``: shard, fingerprint, and the ``width`` bits ``rest`` that its shard says nothing about.  A row for each of the
    radius + 1 blocks of those bits, as even as can be; one of them at least is equal in members within the radius."""
    edge = lambda i: F.floor(F.col("width") * F.lit(i) / F.lit(radius + 1)).cast("int")

    def low(bits):
        return F.when(bits < BITS, F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).otherwise(F.lit(-1).cast("long"))

    def block(i: int):
        first, end = edge(i), edge(i + 1)
        own = F.call_function("shiftrightunsigned", F.col("rest"), first).bitwiseAND(low(end - first))
        above = F.when(end < BITS, F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("rest"), end), first)).otherwise(F.lit(0).cast("long"))
        return F.struct(F.xxhash64("shard", F.lit(i), own).alias("shard"), above.bitwiseOR(F.col("rest").bitwiseAND(low(first))).alias("rest"), (F.col("width") - (end - first)).alias("width"))

    return members.select("fingerprint", F.explode(F.array(*[block(i) for i in range(radius + 1)])).alias("s")).select("s.shard", "fingerprint", "s.rest", "s.width")


def links(members: DataFrame, radius: int = 3, crowd: int = 1024) -> DataFrame:
    """``members``: distinct fingerprints.  Links a, b that connect all that are within the radius of each other.

    A shard with more than ``crowd`` members is dealt again by the bits that are left, as often as it takes; members of a
    shard differ in those bits only, so that when few are left there are few members."""
    todo = _shards(members.select(F.lit(0).cast("long").alias("shard"), "fingerprint", F.col("fingerprint").alias("rest"), F.lit(BITS).alias("width")), radius)
    dealt = None
    while True:
        crowded = settle(todo.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("width").alias("width")).where((F.col("n") > crowd) & (F.col("width") > 3 * radius)).select("shard"))
        full = not crowded.isEmpty()
        few = (todo.join(crowded, "shard", "left_anti") if full else todo).select("shard", "fingerprint")
        dealt = few if dealt is None else dealt.unionByName(few)
        if not full:
            break
        todo = settle(_shards(todo.join(crowded, "shard", "left_semi"), radius))
    return forests(dealt.select("shard", F.col("fingerprint").alias("id"), F.array("fingerprint").alias("words")), radius)


def forests(dealt: DataFrame, radius: int) -> DataFrame:
    """``dealt``: shard, id and words.  The links of each shard's forest, searched in its tree by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
            ids, words = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(ids) < 2:
                return []
            order = np.argsort(ids, kind="stable")
            return forest(ids[order], words[order], radius)

        def table(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

        shard, parts, out = None, [], []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(n, -1)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), n]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != shard:
                    if parts:
                        out += grown(parts)
                    shard, parts = keys[a], []
                parts.append((ids[a:b].copy(), words[a:b].copy()))
            if len(out) >= 10_000:
                yield table(out)
                out = []
        if parts:
            out += grown(parts)
        yield table(out)

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long").distinct()


def clusters(printed: DataFrame, radius: int = 3) -> DataFrame:
    """``printed``: key, text_hash and fingerprint.  Adds component_id, the smallest key that links reach."""
    classes = settle(printed.groupBy("fingerprint").agg(F.min("key").alias("least")))
    roots = components(links(classes.select("fingerprint"), radius))
    placed = settle(classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(join_one(placed, ids, "root").select("fingerprint", "component_id"))
    return join_one(printed, named, "fingerprint")


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, fingerprint (16 hexadecimal digits) and component_id."""
    found = clusters(settle(fingerprints(df, shingle, key, text)), radius)
    return found.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


# Similar texts, beyond a few bits: longer fingerprints in shards by smallest hashes, searched in trees; then sets of shingles.

#: 64-bit words of a set's fingerprint.
WORDS = 4


def wide(values: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of hashes: for each of its words the majority of the hashes as that word mixes them."""
    z = values[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.array([majority(z[:, i]) for i in range(WORDS)], np.int64).view(np.uint64)


def differing(common: int, left: int, right: int) -> float:
    """The probability that a bit differs between two sets which share so many hashes and have so many of their own."""
    halves = lambda n: [math.comb(n, i) / 2**n for i in range(n + 1)]
    total = common + left, common + right
    p = 0.0
    for k, weight in enumerate(halves(common)):
        one, other = (sum(x for i, x in enumerate(halves(own)) if 2 * (k + i) > n) for own, n in zip((left, right), total, strict=True))
        p += weight * (one * (1 - other) + other * (1 - one))
    return p


def radius_for(share: Fraction, miss: float) -> int:
    """The radius beyond which the fingerprints of two sets whose Jaccard index is ``share`` or more lie with a probability of
    ``miss`` at most, whatever their sizes.  The probability that a bit differs is largest in small sets, which are counted
    out; towards large ones it falls to the angle between them."""
    p = math.acos(2 * share / (1 + share)) / math.pi
    for common in range(1, 33):
        most = common * share.denominator // share.numerator - common
        p = max([p, *(differing(common, x, y) for x in range(most + 1) for y in range(x, most + 1 - x))])
    n, beyond = BITS * WORDS, 0.0
    for radius in range(n, -1, -1):  # from the far end, whose probabilities are the smallest
        beyond += math.comb(n, radius) * p**radius * (1 - p) ** (n - radius)
        if beyond > miss:
            return radius
    return 0


#: Orders in a band; all must have the same smallest hash for two texts to meet in it.
ROWS = 5


def bands_for(similarity: float, miss: float) -> int:
    """So many bands that a pair just at the similarity meets in none with a probability of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**ROWS)))


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """A signed number for each band, of the smallest of the distinct hashes in each of its orders."""
    if not len(values):
        return np.zeros(0, np.int64)
    factors = np.random.default_rng(7).integers(0, 1 << 63, bands * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(values), 64):
        np.minimum(least, (values[a : a + 64, None] * factors).min(axis=0), out=least)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(ROWS, bands):
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


#: Most members, and most shingles, of a block of a band that one task compares with others.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19


def alike(ids: np.ndarray, roots: np.ndarray, hubs: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], share: Fraction, radius: int) -> list[tuple[int, int]]:
    """Links of members with different roots of which one at least is a hub, whose fingerprints lie within the radius and whose
    sets have a Jaccard index of ``share`` or more.  All members are looked up in a tree of the hubs; only what it finds is
    compared.  Pairs that links connect already are left out."""
    sizes, n = np.array([len(s) for s in sets]), len(ids)
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    _, first, top = np.unique(roots, return_index=True, return_inverse=True)
    top, parent = first[top], np.arange(n)
    mark, out = np.zeros(len(words), np.int64), []
    _, same = np.unique(ids, return_inverse=True)
    filled = np.minimum(cuts[:-1], max(0, len(flat) - 1))
    at = np.flatnonzero(hubs)
    for node, found in Tree(prints[at]).search(prints, radius):
        h, tip = at[node], tops(parent, top)
        size, others = sizes[h], sizes[found]
        able = found[(tip[found] != tip[h]) & (same[found] != same[h]) & (np.minimum(size, others) * share.denominator >= np.maximum(size, others) * share.numerator)]
        if not len(able):
            continue
        own = flat[cuts[h] : cuts[h + 1]]
        mark[own] = 1
        common = np.where(sizes > 0, np.add.reduceat(mark[flat], filled), 0) if len(flat) else np.zeros(n, np.int64)
        mark[own] = 0
        near = able[common[able] * share.denominator >= (size + sizes[able] - common[able]) * share.numerator]
        for i in near.tolist():
            out.append((int(ids[i]), int(ids[h])))
        if len(near):
            joined = np.append(tip[near], tip[h])
            parent[joined] = joined.min()
    return out


def printed_sets(sets: DataFrame) -> DataFrame:
    """``sets``: id and shingles.  Adds words, the fingerprint of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [wide(s.view(np.uint64)).view(np.int64) for s in _rows_of(batch.column(1))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, WORDS * len(words) + 1, WORDS, dtype=np.int32)), pa.array(np.concatenate([*words, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(1)], names=["id", "words", "shingles"])

    return sets.select("id", "shingles").mapInArrow(run, "id long, words array<long>, shingles array<long>")


def compared(dealt: DataFrame, sets: DataFrame, share: Fraction, radius: int) -> DataFrame:
    """``dealt``: task, id, root, and whether it is a hub; ``sets``: id, words and shingles.  In each task all of its members are
    looked up in the tree of its hubs, and what lies within the radius is compared; the verified links a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

        def done(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
            ids, roots, hubs = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (1, 2, 3))
            prints = np.concatenate([p.column(4).flatten().to_numpy() for p in parts]).view(np.uint64).reshape(-1, WORDS)
            return alike(ids, roots, hubs, prints, [s for p in parts for s in _rows_of(p.column(5))], share, radius)

        task, parts, out = None, [], []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if parts and keys[a] != task:
                    out += done(parts)
                    parts = []
                task = keys[a]
                parts.append(batch.slice(a, b - a))
            if len(out) >= 10_000:
                yield table(out)
                out = []
        if parts:
            out += done(parts)
        yield table(out)

    rows = dealt.join(sets, "id").select("task", "id", "root", "hub", "words", "shingles")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").distinct()


def _rows_of(lists: pa.ListArray) -> list[np.ndarray]:
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (band, id, size, met, root) of the bands that hold more than one root."""
    placed = members.join(components(links), F.col("id") == F.col("node"), "left").select("band", "id", "size", "met", F.coalesce("root", "id").alias("root"))
    apart = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    return settle(placed.join(apart, "band", "left_semi"))


def _largest(left: DataFrame) -> DataFrame:
    """For each band: ``most``, the root with most members, and members and shingles of it and of the others."""
    by_root = left.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    return by_root.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("few"), F.sum("words").alias("words"))


def verified(members: DataFrame, sets: DataFrame, bands: DataFrame, share: Fraction, crowd: int = 4096, few: int = 3, rounds: int = 4, miss: float = 1e-8) -> DataFrame:
    """``members``: band, id, size and the band's number of members n, two or more; ``sets``: id and shingles; ``bands``: id and
    the array of its bands.  Verified links a, b that connect all ids that meet in a band and are alike, but for a pair whose
    fingerprints lie beyond the radius, with a probability of ``miss`` at most.

    A band is a shard of fingerprints.  To compare is to search the fingerprints in a tree of those they are compared with,
    and then, for those within the radius, to compare the sets.
    First each band's members are compared with one of them, the one that meets most others (the middle of a group):
    a row for each member.  In the bands that still hold more than one part, the members outside the largest part are
    compared with all, by blocks of members, in numbers that tasks have room for; there, only links become rows.  As
    long as that would be more than ``few`` rows for a member, another round comes first, in which they are
    compared with one of the largest part.  Bands with more than ``crowd`` members outside are dealt again by a second
    band that must be equal too.  A pair is left out only if links that hold connect it already, so that a
    rejected pair costs no other."""
    sets, radius = settle(printed_sets(sets)), radius_for(share, miss)
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    members = settle(members.join(met, "id").select("band", "id", "size", "met"))
    links, left = None, members.withColumn("root", F.col("id"))
    for turn in range(rounds):
        sizes = _largest(left)
        order = F.struct(F.xxhash64("band", "id", F.lit(turn)) if turn else -F.col("met"), "id", "size", "root")
        middle = left.join(sizes.select("band", "most"), "band").where("root = most") if turn else left
        middle = middle.groupBy("band").agg(F.min(order).alias("m")).join(sizes, "band").select("band", "m", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("words") / BLOCK_SHINGLES)).alias("parts"))
        pairs = left.join(middle, "band").where("root <> m.root").where(F.least("size", "m.size") * F.lit(share.denominator) >= F.greatest("size", "m.size") * F.lit(share.numerator))
        pairs = pairs.groupBy("id", F.col("m.id").alias("hub_id")).agg(F.first("root").alias("root"), F.first("m.root").alias("hub_root"), F.max("parts").alias("parts"))
        pairs = settle(pairs.withColumn("task", F.xxhash64("hub_id", "parts", F.pmod(F.xxhash64("id"), F.col("parts")))))
        dealt = pairs.select("task", "id", "root", F.lit(False).alias("hub")).unionByName(pairs.select("task", F.col("hub_id").alias("id"), F.col("hub_root").alias("root"), F.lit(True).alias("hub")).distinct())
        new = compared(dealt, sets, share, radius)
        links = settle(new if links is None else links.unionByName(new))
        left = _apart(members, links)
        n, rows = left.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("few")).agg(F.sum("n"), F.sum(F.col("few") * F.ceil(F.col("n") / BLOCK) + F.col("n") * F.ceil(F.col("few") / BLOCK))).first()
        if not n:
            return links
        if rows <= few * n:
            break
    for _ in range(2):
        many = settle(_largest(left).where(F.col("few") > crowd).select("band"))
        if many.isEmpty():
            break
        again = left.join(many, "band", "left_semi").join(bands, "id").withColumn("second", F.explode("bands")).where("second <> band").withColumn("band", F.xxhash64("band", "second")).select(left.columns)
        dealt = left.join(many, "band", "left_anti").unionByName(again)
        apart = dealt.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
        left = settle(dealt.join(apart, "band", "left_semi"))
    if left.isEmpty():
        return links
    blocks = _largest(left).withColumn("wide", F.greatest(F.lit(1.0), F.col("words") / F.col("n") * BLOCK / BLOCK_SHINGLES))
    blocks = blocks.select("band", "most", *[F.ceil(F.col(n) * F.col("wide") / BLOCK).cast("int").alias(parts) for n, parts in (("n", "all_parts"), ("few", "few_parts"))])
    placed = left.join(blocks, "band").withColumn("hub", F.col("root") != F.col("most"))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    task = F.xxhash64("band", "x", "y").alias("task")
    asked = placed.where("hub").select("band", "id", "root", "hub", part("few_parts").alias("x"), every("all_parts").alias("y"))
    rest = placed.select("band", "id", "root", F.lit(False).alias("hub"), every("few_parts").alias("x"), part("all_parts").alias("y"))
    dealt = asked.unionByName(rest).select(task, "id", "root", "hub")
    return settle(links.unionByName(compared(dealt, sets, share, radius)))


def similar(df: DataFrame, shingle: int = 5, similarity: float = 0.8, miss: float = 1e-6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: key, text_hash, component_id and component (one name for each component, also
    where keys are null or shared by unrelated texts), linking texts whose sets of shingles have at least this
    Jaccard index.

    Texts with the same set are one class, whose fingerprint goes to a shard for each band (the same smallest hashes in
    ``ROWS`` orders).  Trees of fingerprints are searched there, and pairs within the radius are compared by their sets
    before they are linked.  The number of bands and the radius come from the similarity alone, so a pair is found with a
    probability of 1 - ``miss`` or more whatever the size of the table."""
    kind = df.schema[key].dataType.simpleString()
    beyond = miss / 100  # the radius's part of what may be missed; the bands have the rest
    bands = bands_for(similarity, miss - beyond)
    c = lambda name: F.col(f"`{name}`")

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        return [np.unique(np.array(hashes(t, shingle), np.uint64)) for t in column.to_pylist()]

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        offsets = np.cumsum([0, *map(len, arrays)])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 1024) for a in range(0, whole.num_rows, 1024)):
                sets = sets_of(batch.column(2))
                prints = [xxhash.xxh128_digest(s.astype("<u8").tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), lists([band_keys(s, bands) for s in sets])], names=["key", "text_hash", "print", "size", "bands"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 1024) for a in range(0, whole.num_rows, 1024)):
                yield pa.RecordBatch.from_arrays([batch.column(0), lists([s.view(np.int64) for s in sets_of(batch.column(1))])], names=["id", "shingles"])

    slim = df.select(c(key).alias("key"), F.xxhash64(c(text)).alias("text_hash"), c(text).cast("binary").alias("text"))
    printed = settle(slim.mapInArrow(met, f"key {kind}, text_hash long, print binary, size long, bands array<long>"))
    classes = settle(printed.groupBy("print").agg(F.min("key").alias("least"), F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()))
    members = classes.select("id", "size", F.explode("bands").alias("band"))
    met_ids = settle(members.join(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"))
    needed = met_ids.select("id").distinct().join(classes.select("id", "text_hash"), "id")
    texts = slim.select("text_hash", "text").join(needed, "text_hash").groupBy("id").agg(F.first("text").alias("text"))
    sets = texts.mapInArrow(shingles, "id long, shingles array<long>")
    roots = components(verified(met_ids, sets, classes.select("id", "bands"), Fraction(str(similarity)), miss=beyond))
    placed = settle(classes.join(roots, F.col("id") == F.col("node"), "left").select("print", "least", F.coalesce("root", "id").alias("root")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.hex(F.min("print")).alias("component"))
    named = settle(join_one(placed, ids, "root").select("print", "component_id", "component"))
    return join_one(printed.select("key", "text_hash", "print"), named, "print").select(F.col("key").alias(key), "text_hash", "component_id", "component")
