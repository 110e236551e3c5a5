"""A training corpus from ``documents``: accepted, without near copies, without secrets, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet, reads
it again for the next one and deletes what the stage before had written. All but the last return the
columns of ``documents``, whatever further columns those are. An empty table gives empty stages; a
null text is an empty one to every stage, and stays null where the stage keeps it. This module needs
the ``llm`` subpackage and cannot be imported without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, jaccard, mixing, quality, secrets
from tessera.llm.common import forget, written


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; those with a null text or id are scored like others."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked ones (five-word shingles, Jaccard 0.8), that with the smallest id.

    Null and empty texts and null ids are linked with nothing and stay; of rows that repeat an id and text one stays.
    """
    return jaccard.representatives(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind; null texts stay null."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their tempered weights; every document at least once, none more than four times.

    Null sources are a source; texts without a word cost nothing and come once.
    """
    return mixing.mix(docs, target=0.95, budget=None, limit=4.0).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the text's columns; a null text has none."""
    import public_tokenizers

    return bpe.encode_rows(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", accept),
    ("n-gram Jaccard join", deduplicate),
    ("secret scans", redact),
    ("temperature mixing", mix),
    ("byte-level BPE", tokenise),
]

#: SQL has no statistical classifier and no byte-level BPE; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
        if last is not None:
            forget(spark, last)
        last = docs
    return docs
