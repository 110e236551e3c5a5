"""The pipeline's stages on small tables, each against plain Python on its own input."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_spans

SF = "/root/testdata/sf0.001"
BY = dict(corpus_pipeline.STAGES)
ACCEPT, DEDUPLICATE, REDACT, MIX, TOKENISE = (f for _, f in corpus_pipeline.STAGES)


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    import public_tokenizers as public
    import tiktoken

    from tessera.llm import bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(BY) == 5
    kept = ACCEPT(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    clean = [k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    have = by_id(kept)
    assert sum(k in have for k in clean) >= 0.95 * len(clean) and all(by_id(docs)[k] == t for k, t in have.items())
    single = DEDUPLICATE(spark, kept, SF).cache()
    want = {k for k, (_, c) in brute_components(have).items() if k == c}
    assert single.columns == docs.columns and set(by_id(single)) == want
    safe = REDACT(spark, single, SF).cache()
    assert safe.columns == docs.columns
    for k, t in by_id(safe).items():
        out, done, old = "", 0, have[k]
        for kind, a, b in brute_spans(old):
            out += (old[done:a] + f"[{kind}]") if a >= done else ""
            done = max(done, b)
        assert t == out + old[done:]
    mixed = MIX(spark, safe, SF).cache()
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) == want and max(times.values()) <= 4
    words, sources = collections.Counter(), {r["doc_id"]: r["source"] for r in safe.collect()}
    for k, t in by_id(safe).items():
        words[sources[k]] += len(re.findall(r"[^\x20\x09-\x0D]+", t)) * times[k]
    assert len(words) > 1
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = TOKENISE(spark, mixed, SF).collect()
    assert len(last) == sum(times.values())
    assert all(list(r["ids"]) == enc.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in last)


def folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, docs))
    assert {"doc_id", "text", "n_tokens", "ids"} <= set(out.columns) and out.count() == 0


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = docs.limit(4).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(4).withColumn("text", F.lit(None).cast("string")))
    names = ("quality", "accepted", "k0", "id", "gone", "twice", "block", "tokens", "t", "row", "n_tokens", "ids", "exact")
    wide = docs.unionByName(docs.limit(5)).unionByName(odd).select("*", *(F.lit("x").alias(n) for n in names))
    path = folder(spark, tmp_path, wide)
    table = spark.read.parquet(f"{path}/documents.parquet")
    for stage in (ACCEPT, DEDUPLICATE, REDACT, MIX):
        table = stage(spark, table, path).cache()
        assert table.columns == wide.columns and table.count() > 0
    assert TOKENISE(spark, table, path).count() == table.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0


if not all(map(callable, BY.values())):
    pytest.fail("stages are functions")
