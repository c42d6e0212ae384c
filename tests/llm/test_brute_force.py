"""Operators' inner parts against plain versions of the same."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import prose, table, vocabulary
from pyspark.sql import functions as F

from tidewright.llm import common, mixing, packing, secret_scans, simhash, toxicity, winnowing

M = 1 << 64


def plain_gram_hashes(text, k):
    """Each run's hash from its own characters: a polynomial over mixed codes, mixed again."""
    codes = [((ord(c) + 1) * 0xD6E8FEB86659FD93) % M for c in text]
    codes = [c ^ (c >> 32) for c in codes]
    out = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + c) % M
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) % M
        out.append(h ^ (h >> 32))
    return out


def plain_fingerprint(text, gram, window):
    if not text:
        return []
    hashes = [h >> 32 for h in plain_gram_hashes(text, min(gram, len(text)))]
    chosen = set()
    for i in range(max(1, len(hashes) - window + 1)):
        own = hashes[i : i + window]
        chosen.add(i + max(j for j, h in enumerate(own) if h == min(own)))
    return [(hashes[i], i) for i in sorted(chosen)]


def test_fingerprints_equal_a_plain_rolling_hash():
    r = random.Random(41)
    for _ in range(150):
        text = "".join(r.choice("ab é漢😀\n") for _ in range(r.randint(0, 60)))
        s = winnowing.Winnow(r.randint(1, 12), r.randint(1, 9))
        hashes, at = winnowing.fingerprint(text, s)
        assert list(zip(hashes.tolist(), at.tolist(), strict=True)) == plain_fingerprint(text, s.gram, s.window)
        other = "".join(r.choice("ab é") for _ in range(r.randint(0, 40)))
        x, y = ({h for h, _ in plain_fingerprint(t, s.gram, s.window)} for t in (text, other))
        assert winnowing.likeness(hashes, winnowing.fingerprint(other, s)[0]) == (len(x & y) / len(x | y) if x | y else 1.0)


@pytest.mark.parametrize("limits", [packing.Limits(64, 1000, 1000, 8), packing.Limits(64, 4, 40, 16), packing.Limits(100, 3, 100, 5)])
def test_the_packer_takes_the_largest_dot_product_that_fits(limits):
    chosen = []

    class Checked(packing.Packer):
        def _take(self, i):
            room = [f - u for f, u in zip(self.full.tolist(), self.used.tolist(), strict=True)]
            scores = [sum(a / f * b / f for a, b, f in zip(size, room, self.full.tolist(), strict=True)) if all(a <= b for a, b in zip(size, room, strict=True)) else -1 for size in self.sizes[: len(self.pieces)].tolist()]
            assert scores[i] >= max(scores) - 1e-12 and scores[i] >= 0
            chosen.append(len([x for x in scores if x >= 0]))
            return super()._take(i)

    r, placed = random.Random(42), defaultdict(int)
    # Of every third document only a quarter of the tokens bears loss, as answers in a conversation do.
    light = set(range(0, 300, 3))
    current = []
    packer = Checked(limits, 0, lambda d, start, length, sequence, offset: placed.__setitem__(d, placed[d] + length), lambda start, length: length // 4 if current[-1] in light else length)
    lengths = [r.randint(1, 90) for _ in range(300)]
    for i, n in enumerate(lengths):
        current.append(i)
        packer.add(i, n)
    packer.finish()
    assert dict(placed) == dict(enumerate(lengths)) and max(chosen) > 1


def plain_features(text, learned):
    """Some of the features, counted word by word."""
    words = [w.strip(toxicity._EDGE) for w in (text or "").lower().split()]
    raw = (text or "").split()
    n = max(1, len(raw))
    hits = [next((k for k in (w, f"{w[:5]}*" if len(w) > 5 else None, f"{w[:4]}*" if len(w) > 4 else None) if k in learned), None) for w in words]
    at = [i for i, (w, h) in enumerate(zip(words, hits, strict=True)) if h or w in toxicity.INSULTS]
    persons = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    return {
        "insults": sum(w in toxicity.INSULTS for w in words), "learned": sum(h is not None for h in hits), "learned_weight": sum(learned[h] for h in hits if h),
        "near_person": sum(any(abs(i - j) <= 5 for j in persons) for i in at), "person_density": 100 * len(persons) / n, "hit_spread": (at[-1] - at[0]) / n if at else 0.0,
        "exclamations": 100 * (text or "").count("!") / n, "questions": 100 * (text or "").count("?") / n, "log_words": float(np.log1p(len(raw))),
    }


def test_features_equal_a_count_by_words():
    r, vocab = random.Random(43), vocabulary(9, 200)
    learned = {w: r.random() for w in vocab[:20]} | {"grumb*": 1.5, "flim*": 0.5}
    extra = ["idiot", "You", "your!", "grumbles", "grumble?", "flimsy", "moron,", "MORON", "!!", "st4pid", "sooo"]
    for _ in range(200):
        text = " ".join(r.choice(vocab) if r.random() < 0.7 else r.choice(extra) for _ in range(r.randint(0, 40))) or None
        found = dict(zip(toxicity.FEATURES, toxicity.features(text, learned), strict=True))
        for name, value in plain_features(text, learned).items():
            assert found[name] == pytest.approx(value), (name, text)


def test_trees_and_calibration_equal_plain_versions():
    r = np.random.default_rng(44)
    x = np.round(r.normal(size=(400, 4)), 1)
    y = (x[:, 1] + 0.5 * x[:, 2] + 0.3 * r.normal(size=400) > 0).astype(float)
    s = toxicity.Settings(trees=6, depth=3)
    trees = toxicity.Trees(x, y, s)

    def walk(row):
        out = trees.start
        for levels, leaf in trees.trees:
            node = 0
            for on, at in levels:
                node = 2 * node + int(row[on[node]] > at[node])
            out += leaf[node]
        return out

    assert trees.raw(x) == pytest.approx([walk(row) for row in x])
    # The first split of the first tree is the best of all features and bounds.
    p = np.full(len(y), y.mean())
    g, h = p - y, p * (1 - p)

    def gain(j, cut):
        left = x[:, j] <= cut
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + 1)

    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(4)]
    best = max(gain(j, c) for j in range(4) for c in cuts[j] if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 0.5)
    on, at = trees.trees[0][0][0]
    assert gain(on[0], at[0]) == pytest.approx(best)
    # Isotonic regression by the largest of the least means.
    raw = r.normal(size=60)
    label = (r.random(60) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    ordered = label[np.argsort(raw)]
    plain = [max(min(ordered[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    at, share = toxicity.isotonic(raw, label)
    assert sorted(set(np.round(plain, 9))) == sorted(set(np.round(share, 9)))
    model = toxicity.Model({}, trees, at, share, s)
    texts = ["plain words here", "you idiot", None, "", "A! B? C"]
    rows = np.array([toxicity.features(t, {}) for t in texts])[:, :4]
    expected = []
    for row in rows:
        value = walk(row)
        level = float(np.interp(value, at, share))
        traced = 0.998 * level + 0.002 / (1 + np.exp(-value))
        expected.append(max(traced, 0.5) if level >= 0.5 else min(traced, np.nextafter(0.5, 0)))
    assert model.score(texts) == pytest.approx(expected)


def test_toxicity_ignores_other_columns(spark, documents, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 170)], "doc_id long, toxic int")
    a, b = (table(toxicity.score(d, toxicity.train(d, labels))) for d in (documents, clashing))
    assert a == b and len(a) == documents.count()


def test_shares_of_sources_equal_the_plain_ones(spark):
    r = random.Random(45)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i:02}é"[: r.randint(3, 4)]: r.choice([0, 1, 5, 100, 10_000]) for i in range(n)} | ({None: 50} if n > 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, words long")
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        plain = mixing.targets([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))])
        found = {x.source: x.target for x in mixing.shared(df, (1, 2, 3), 3).collect()}
        assert [found[s] for s in order] == pytest.approx(plain)


@pytest.mark.parametrize("least, hot", [(0, 2), (3, 512), (10**9, 512)])
def test_join_one_loses_no_row(spark, least, hot):
    many = common.settle(spark.createDataFrame([(k, i) for i in range(60) for k in (0, 0, 1, i)], "k long, i int"))
    one = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k long, v string")
    assert table(common.join_one(many, one, "k", hot, least), "k", "i", "v") == table(many.join(one, "k"), "k", "i", "v")


def test_verdicts_of_secrets_equal_a_plain_count(spark):
    r = random.Random(46)
    values = ["password=" + "".join(r.choice("aB3dE5gH7j") for _ in range(12)) for _ in range(8)] + ["passwd=aaaaaaaaaaaa", "xoxb-" + "1" * 12, "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"]
    rows = [(i, " and ".join(r.sample(values, r.randint(0, 4))), r.choice(["a", "b", None] if i % 2 else ["a"])) for i in range(70)]
    rows += [(100 + i, values[i], f"own{i}") for i in range(3)]
    owners, homes = defaultdict(set), defaultdict(set)
    for i, t, s in rows:
        for _, _, _, v in secret_scans.find(t):
            owners[v].add(s)
            homes[v].add((s, i))
    expected = []
    for i, t, _ in rows:
        spans, live, copied = [], 0, 0
        for a, k, b, v in secret_scans.find(t):
            wide = len(owners[v]) > 2 or len(owners[v]) == 2 and len(homes[v]) > 5
            alive = not wide and secret_scans.bits_per_character(v) >= 2.5
            live, copied = live + alive, copied + wide
            if k < secret_scans.BASE or alive:
                spans.append(f"{secret_scans.KINDS[k]}:{a}:{b}")
        expected.append((i, ",".join(spans), live, copied))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert table(secret_scans.scan_secrets(df), "doc_id", "spans", "n_live", "n_copied") == sorted(expected, key=repr)
    texts = spark.createDataFrame([(t,) for _, t, _ in rows] + [("TOKEN : 'abcdefg'",), ("api_KEY='xx'",), ("nothing",), (None,)], "t string")
    assert all(x.p or not secret_scans.find(x.t) for x in texts.select("t", secret_scans.possible(F.col("t")).alias("p")).collect())


def test_one_value_with_little_variety_is_neither_live_nor_copied(spark):
    x = secret_scans.scan_secrets(spark.createDataFrame([(1, "passwd=aaaaaaaaaaaa", "s")], "doc_id long, text string, source string")).first()
    assert (x.n_assign, x.n_live, x.n_copied) == (1, 0, 0)


def test_blocks_find_what_pairs_find(monkeypatch, spark):
    """Groups that no middle connects, in blocks of a few members and with crowded bands."""
    from fractions import Fraction

    r = random.Random(47)
    sets = {}
    for _ in range(6):
        base = [r.getrandbits(62) for _ in range(60)]
        for _ in range(14):
            own = {x for x in base if r.random() < 0.9} | {r.getrandbits(62) for _ in range(r.randint(0, 4))}
            sets[len(sets) + 1] = own
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(1, i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    from tidewright.llm.graphs import components

    monkeypatch.setattr(simhash, "BLOCK", 4)
    bands = {i: [b * 1000 + (i - 1) // 14 for b in range(3)] for i in sets}
    members = spark.createDataFrame([(b, i, len(sets[i]), 14) for i in sets for b in bands[i]], "band long, id long, size long, n long")
    held = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, shingles array<long>")
    lists = spark.createDataFrame(list(bands.items()), "id long, bands array<long>")
    for crowd, few in ((4096, 10**6), (3, 0)):
        found = {x.node: x.root for x in components(simhash.verified(members, held, lists, Fraction(4, 5), crowd=crowd, few=few)).collect()}
        assert {i: found.get(i, i) for i in sets} == {i: top(i) for i in sets}


def test_wide_fingerprints_lie_within_the_radius():
    from fractions import Fraction

    def mixed(h, i):
        m = 2**64 - 1
        z = (h + (i + 1) * 0x9E3779B97F4A7C15) & m
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
        z = (z ^ z >> 27) * 0x94D049BB133111EB & m
        return z ^ z >> 31

    def plain(values):
        return [sum(1 << b for b in range(64) if 2 * sum(mixed(h, i) >> b & 1 for h in values) > len(values)) for i in range(simhash.WORDS)]

    r = random.Random(48)
    draw = lambda n: [r.getrandbits(64) for _ in range(n)]
    array = lambda v: np.array(v, np.uint64)
    for n in (0, 1, 2, 5, 37):
        v = draw(n)
        assert simhash.wide(array(v)).tolist() == plain(v)
    radius, apart = simhash.radius_for(Fraction(4, 5), 1e-8), []
    for common, x, y in ((4, 0, 1), (12, 1, 2), (16, 0, 4), (178, 22, 22), (800, 0, 200)):
        for _ in range(60):
            v, a, b = draw(common), draw(x), draw(y)
            one, other, far = (simhash.wide(array(z)) for z in (v + a, v + b, draw(common)))
            assert simhash.distances(one[None], other)[0] <= radius
            apart.append(int(simhash.distances(one[None], far)[0]))
    assert min(apart) > radius
    # Where a bit differs is counted out: of 4 hashes and the same with one more, a tie of the 4 and the fifth.
    assert simhash.differing(4, 0, 1) == 6 / 16 / 2 and simhash.differing(0, 1, 1) == 0.5


def test_members_are_looked_up_in_a_tree_of_hubs(monkeypatch):
    """All links of hubs are found, through trees only, and nothing beyond the radius is linked."""
    from fractions import Fraction

    searched = []

    class Watched(simhash.Tree):
        def search(self, queries, radius):
            searched.append((len(self.members), len(queries), radius))
            return super().search(queries, radius)

    monkeypatch.setattr(simhash, "Tree", Watched)
    r = random.Random(49)
    sets = []
    for _ in range(5):
        base = [r.getrandbits(64) for _ in range(80)]
        sets += [np.unique(np.array([x for x in base if r.random() < 0.93], np.uint64)) for _ in range(12)]
    n = len(sets)
    ids, hubs = np.arange(n), np.array([i % 3 == 0 for i in range(n)])
    prints = np.stack([simhash.wide(x) for x in sets])
    share = Fraction(4, 5)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def close(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)

    def joined(links):
        root[:] = range(n)
        for a, b in links:
            x, y = sorted((top(a), top(b)))
            root[y] = x
        return [top(i) for i in range(n)]

    expected = joined([(i, j) for i in range(n) for j in range(n) if hubs[j] and i != j and close(i, j)])
    views = [x.view(np.int64) for x in sets]
    radius = simhash.radius_for(share, 1e-8)
    links = simhash.alike(ids, ids, hubs, prints, views, share, radius)
    assert all(hubs[b] and close(a, b) for a, b in links) and len({*expected}) < n
    assert joined(links) == expected and searched == [(int(hubs.sum()), n, radius)]
    assert simhash.alike(ids, ids, hubs, prints, views, share, -1) == []


@pytest.mark.parametrize("least", [1, 3, 1024])
def test_hot_keys_are_split_and_every_row_has_its_next(spark, least):
    r = random.Random(77)
    text = lambda: "".join(r.choice("ab é") for _ in range(r.randint(0, 30)))
    big = (1 << 60) + 1
    rows = [(None, text()) for _ in range(60)] + [(7, "a shared beginning " * 8 + text()) for _ in range(40)] + [(big, text()) for _ in range(20)] + [(big - 1, text()), (big + 1, text()), (big + 1, text())]
    rows += [(None, "the same")] * 30 + [(7, None)] * 9 + [(7, "")] * 4 + [(i, text()) for i in range(-20, 20)]
    r.shuffle(rows)
    order = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]), reverse=True)
    expected = []
    for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        own, other, following = ([h for h, _ in plain_fingerprint(x, 8, 8)] for x in (t, changed, after))
        likeness = [len(set(own) & set(x)) / len(set(own) | set(x)) if own or x else 1.0 for x in (other, following)]
        expected.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), *likeness))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt, once, _ = winnowing.with_next(df, "doc_id", "text", least)
    assert (once is not None) == (least < 1024) == (dealt.where("own AND key IS NULL").select("bucket").distinct().count() > 1)
    out = winnowing.compare_with_next(df, least=least)
    found = [tuple(x) for x in out.select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
