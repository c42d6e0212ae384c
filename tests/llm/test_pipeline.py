"""The pipeline's stages over odd rows, and against brute force."""

import random

import corpus_pipeline
import pytest
from llm_cases import CLASHES, DOCUMENTS, prose, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark):
    r, vocab = random.Random(21), vocabulary(4, 1500)
    rows = []
    for i in range(60):
        t = prose(r, r.randint(60, 200), vocab)
        rows.append((i, t, "en", f"src{i % 4}", len(t)))
    rows += [(100 + i, rows[i][1], "en", "src0", rows[i][4]) for i in range(10)]  # exact copies
    for i in range(10, 20):  # near copies
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((100 + i, " ".join(w), "en", "src1", 0))
    rows.append((200, rows[30][1] + " password=Zx81kQp7Lm", "en", "src2", 0))
    rows += [(201, "SHOUT!! " * 60, "en", "src3", 0), (202, "few words", "en", "src3", 9), (203, None, None, None, None), (None, prose(r, 90, vocab), None, None, None), rows[40], rows[40]]
    return spark.createDataFrame(rows, DOCUMENTS)


def test_stages(spark, corpus):
    good = corpus_pipeline.quality(spark, corpus, "")
    assert good.columns == COLUMNS and {r.doc_id for r in corpus.collect()} - {r.doc_id for r in good.collect()} == {201, 202, 203}
    unique = corpus_pipeline.near_dedup(spark, good, "")
    ids = [r.doc_id for r in unique.collect()]
    assert unique.columns == COLUMNS and len(ids) == len(set(ids))
    assert set(ids) == {*range(60), None}  # every copy went, and 200 repeats 30 with two words more
    clean = corpus_pipeline.secrets(spark, good, "")
    by = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == COLUMNS and by[200].text.endswith(" [REDACTED]") and by[200].n_chars == len(by[200].text)
    assert clean.count() == good.count() and by[5].text == {r.doc_id: r.text for r in good.collect()}[5]
    mixed = corpus_pipeline.mix(spark, unique, "")
    assert mixed.columns == COLUMNS
    words, taken = {}, {}
    for frame, out in ((unique, words), (mixed, taken)):
        for r in frame.collect():
            out[r.source] = out.get(r.source, 0) + len(r.text.split())
    from tidewright.llm.mixing import targets

    order = sorted(words, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, targets([words[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True):
        assert abs(taken.get(s, 0) - t) <= 0.1 * t + 2
    packed = corpus_pipeline.pack(spark, mixed, "")
    assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in packed.where("start = 0").collect())


def test_stages_with_clashing_names_and_no_rows(spark, corpus):
    extra = spark.sql("select 'x' key, 'y' words, 'z' fingerprint, 1 bucket, 2L row, 's' spans, 'w' whole_row, 'i' id, 7 n, 8 times, 1 label, 3L h")
    assert len(extra.columns) == len(CLASHES.split(", "))
    more, none = corpus.crossJoin(extra), corpus.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        a, b = stage(spark, corpus, ""), stage(spark, more, "")
        assert b.columns == more.columns and sorted(a.collect(), key=repr) == sorted(b.select(*COLUMNS).collect(), key=repr)
        assert {(r.key, r.row, r.n) for r in b.collect()} == {("x", 2, 7)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").collect() == []


def test_unrelated_texts_of_one_id_stay(spark):
    r, vocab = random.Random(22), vocabulary(5, 1500)
    texts = [prose(r, 100, vocab) for _ in range(8)]
    rows = [(None, t, "en", "a", 0) for t in texts[:4]] + [(7, t, "en", "a", 0) for t in texts[4:]]
    rows += [(None, texts[5], "en", "a", 0), (9, texts[0], "en", "a", 0), rows[1], rows[6]]  # copies
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()
    assert sorted(((x.doc_id, x.text) for x in kept), key=repr) == sorted([(9, texts[0]), *((None, t) for t in texts[1:4]), *((7, t) for t in texts[4:])], key=repr)


def test_near_copies_are_found_by_fingerprints_alone(monkeypatch, spark):
    """With a radius that no fingerprint lies within, near copies stay; exact copies still go."""
    from tidewright.llm import simhash

    r, vocab = random.Random(23), vocabulary(6, 1500)
    texts = [prose(r, 120, vocab) for _ in range(12)]
    near = [" ".join([*t.split(" ")[:-1], "changed"]) for t in texts]
    rows = [(i + n, t, "en", "a", 0) for n, of in ((0, texts), (100, near), (200, texts)) for i, t in enumerate(of)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    kept = lambda: sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept() == [*range(12)]
    monkeypatch.setattr(simhash, "radius_for", lambda share, miss: -1, raising=False)
    assert kept() == [*range(12), *range(100, 112)]


def test_workers_give_the_tokenizer_back(spark, corpus):
    """Spark lends the workers of the packing to the next stage; they come without its tokenizer and what it remembers."""
    import time

    import pyarrow as pa
    from tidewright.llm import packing

    def held(batches):
        n = sum(0 * b.num_rows for b in batches) + packing.tokenizer.cache_info().currsize
        time.sleep(0.2)  # so that all idle workers get a task
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    assert corpus_pipeline.pack(spark, corpus.repartition(4), "").count() > 0
    time.sleep(6)
    assert [r.n for r in spark.range(0, 32, 1, 32).mapInArrow(held, "n long").collect()] == [0] * 32


def test_what_a_task_borrowed_is_kept_until_the_process_rests():
    import functools
    import time

    from tidewright.llm.common import borrowed

    built = functools.lru_cache(lambda: [1])
    for _ in range(3):
        with borrowed(built, 0.3):
            mine = built()
            time.sleep(0.4)  # a task longer than the rest
        time.sleep(0.05)
    assert built.cache_info().misses == 1 and built.cache_info().currsize == 1
    time.sleep(1)
    assert built.cache_info().currsize == 0 and mine == [1]


def test_run(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
