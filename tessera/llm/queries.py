"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, html, jaccard, merkle, mixing, quality, repeats, secrets, warc
from .oracles import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch's worth of tokens, at 95 % of the largest entropy, no source more than four times."""
    docs = table(spark, sf_dir, "documents")
    budget = float(docs.agg(F.sum(mixing.words(F.col("text")))).first()[0] or 0)
    out = mixing.mix(docs, target=0.95, budget=budget, limit=4.0, keep=("doc_id", "source"))
    return out.select("row.doc_id", "row.source", "tokens", "weight", "pass", "block", "mix_at", "slot")


def op3_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


def op6_jaccard_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_sentencepiece_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_co_training": op1_co_training,
    "op2_temperature_mix": op2_temperature_mix,
    "op3_avi_mjpeg": op3_avi_mjpeg,
    "op4_html_main_text": op4_html_main_text,
    "op5_merkle_tree": op5_merkle_tree,
    "op6_jaccard_heavy_light": op6_jaccard_heavy_light,
    "op7_warc_zstd": op7_warc_zstd,
    "op8_sentencepiece_byte_bpe": op8_sentencepiece_byte_bpe,
    "op9_secret_automaton": op9_secret_automaton,
    "op10_repeated_strings": op10_repeated_strings,
}
