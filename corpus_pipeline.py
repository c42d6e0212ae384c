"""A training corpus from ``documents``: quality rules, near-dedup, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last return
the columns of documents.  Between stages, the table is written as Parquet to the shared checkpoint folder.

Rows are told apart by the id and a hash of all their columns, so rows with null ids, and unrelated rows that share
an id or a text, are handled: of rows that are equal in every column one stands for all in the near-dedup.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm import mixing, packing, quality_rules, secret_scans, simhash
from tidewright.llm.common import ensure_checkpoint_dir

#: Stands for a null id in joins.
_NO_ID = -(2**63)


def _tagged(docs: DataFrame) -> DataFrame:
    """``row``: a whole row as one struct, so that none of its names can clash; ``key``, which puts null ids last and
    tells rows apart; ``id``, ``text`` and ``source``."""
    columns = [F.col(f"`{n}`") for n in docs.columns]
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*columns).alias("row_hash"))
    return docs.select(F.struct(*columns).alias("row"), key.alias("key"), F.col("doc_id").alias("id"), "text", "source")


def _identity(key: str) -> list[Column]:
    return [F.coalesce(F.col(f"{key}.id"), F.lit(_NO_ID)).alias("id"), F.col(f"{key}.row_hash").alias("row_hash")]


def _with_rows(tagged: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` (id, row_hash and more, once each) with ``row``; of equal rows one."""
    both = tagged.select("row", *_identity("key")).join(facts, ["id", "row_hash"])
    return both.withColumn("n", F.row_number().over(Window.partitionBy("id", "row_hash").orderBy(F.lit(1)))).where("n = 1")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go."""
    return quality_rules.keep(docs, quality_rules.STANDARD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word shingles of similarity 0.8 or more, the one of the smallest id stays.
    Fingerprints are searched in BK-trees; what these find is checked by the sets of shingles."""
    tagged = _tagged(docs)
    found = simhash.similar(tagged.select("key", "text"), shingle=5, similarity=0.8, key="key")
    return _with_rows(tagged, found.select(*_identity("component_id")).distinct()).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced; all documents stay."""
    count = "n_redacted" + "_" * max(map(len, docs.columns))  # longer than any other name
    clean = secret_scans.redact(docs, count=count)
    return clean.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(count)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice; one that it doesn't take is gone."""
    tagged = _tagged(docs)
    taken = mixing.mix(tagged, key="key", drawn_by="id").where("times > 0").select(*_identity("key"), "times")
    facts = taken.groupBy("id", "row_hash").agg(F.sum("times").cast("int").alias("times"))
    return _with_rows(tagged, facts).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Fingerprints, secrets and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            _remove(spark, f"{folder}/{n - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    """A stage's table goes as soon as the next one is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
