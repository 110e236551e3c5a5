"""Semantic search: exact cosine search over vector columns, TF-IDF features, search-narrowed aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Engine

THRESHOLD, TOP = 1.0, 5


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in doubles; 1 where a vector is zero."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(1.0 - _dot(a, b) / norm)


def search(df: DataFrame, query: list[float], key: str, vector: str, k: int | None = TOP, threshold: float | None = None) -> DataFrame:
    """Rows with their distance, nearest first, ties by key; only those within the threshold.

    Exact over all rows: a scan with a bounded heap in each task. ``indexed`` is the approximate way.
    """
    out = df.withColumn("distance", cosine_distance(F.col(vector), F.array(*map(F.lit, query))))
    if threshold is not None:
        out = out.where(F.col("distance") <= threshold)
    out = out.orderBy("distance", key)
    return out.limit(k) if k is not None else out


def indexed(df: DataFrame, key: str, vector: str, tables: int = 8, width: float = 0.5, seed: int = 0):
    """S3: a random-projection index of unit vectors; its distances are monotone in the cosine."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    unit = Normalizer(inputCol="__v", outputCol="__unit").transform(df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__v")))
    model = BucketedRandomProjectionLSH(inputCol="__unit", outputCol="__hash", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    return model, model.transform(unit)


class TfIdf:
    """Term weights of a corpus, L2-normalised, optionally reduced by principal components (off by default).

    Search knows every term, by joins. Only vectors (``transform``, ``components``) hold a vocabulary of at
    most ``terms``; a corpus with more of them is an error there, not cut.
    """

    def __init__(self, corpus: DataFrame, text: str, components: int | None = None, terms: int = 1 << 16) -> None:
        self.text, self.components, self.terms = text, components, terms
        self.corpus = corpus.where(F.col(text).isNotNull())
        self.rows = self.corpus.count()
        found = self._words(self.corpus.select(text)).select(F.explode(F.array_distinct("__t")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        self.weights = found.select("term", F.log((F.lit(self.rows) + 1) / (F.col("n") + 1)).alias("idf")).persist()
        self._model = None

    def _words(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import RegexTokenizer, StopWordsRemover

        df = df.withColumn(self.text, F.coalesce(self.text, F.lit("")))
        df = RegexTokenizer(inputCol=self.text, outputCol="__w", pattern=r"[^\p{L}\p{N}]+").transform(df)
        return StopWordsRemover(inputCol="__w", outputCol="__t").transform(df).drop("__w")

    @property
    def model(self):
        if self._model is None:
            from pyspark.ml import Pipeline
            from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer

            if (n := self.weights.count()) > self.terms:
                raise ValueError(f"the corpus has {n} terms, vectors hold {self.terms}")
            stages = [CountVectorizer(inputCol="__t", outputCol="__c", vocabSize=self.terms), IDF(inputCol="__c", outputCol="__i")]
            last = "__i"
            if self.components:
                stages.append(PCA(k=self.components, inputCol="__i", outputCol="__p"))
                last = "__p"
            self._model = Pipeline(stages=[*stages, Normalizer(inputCol=last, outputCol="features")]).fit(self._words(self.corpus))
        return self._model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._words(df)).drop("__t", "__c", "__i", "__p")

    def search(self, df: DataFrame, query: str, key: str, k: int = TOP) -> DataFrame:
        """Rows nearest to a query text: (key, distance)."""
        asked = df.sparkSession.createDataFrame([(query,)], f"`{self.text}` string")
        if self.components:
            return self._reduced(df, asked, key, k)
        counts = self._words(asked).select(F.explode("__t").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
        probe = {r["term"]: r["tf"] * r["idf"] for r in self.weights.join(F.broadcast(counts), "term").collect()}  # the query's own terms
        if not probe:
            return df.select(key, F.lit(1.0).alias("distance")).limit(0)
        norm = sum(w * w for w in probe.values()) ** 0.5
        part = df.sparkSession.createDataFrame(sorted((t, w / norm if norm else 0.0) for t, w in probe.items()), "term string, probe double")
        rows = df.select(F.col(key).alias("__k"), F.coalesce(self.text, F.lit("")).alias(self.text)).withColumn("__m", F.sha2(self.text, 256))
        terms = self._words(rows.dropDuplicates(["__k", "__m"])).select("__k", "__m", F.explode("__t").alias("term")).groupBy("__k", "__m", "term").agg(F.count("*").alias("tf"))
        weighted = terms.join(self.weights, "term").join(F.broadcast(part), "term", "left").withColumn("w", F.col("tf") * F.col("idf"))
        dots = weighted.groupBy("__k", "__m").agg((F.sum(F.col("w") * F.coalesce("probe", F.lit(0.0))) / F.sqrt(F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0.0)))).alias("dot"))
        a, b = rows.select("__k", "__m").alias("a"), dots.alias("b")
        out = a.join(b, F.col("a.__k").eqNullSafe(F.col("b.__k")) & (F.col("a.__m") == F.col("b.__m")), "left")
        return out.select(F.col("a.__k").alias(key), F.round(1 - F.coalesce("b.dot", F.lit(0.0)), 9).alias("distance")).orderBy("distance", key).limit(k)

    def _reduced(self, df: DataFrame, asked: DataFrame, key: str, k: int) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        probe = self.transform(asked).first()["features"].toArray().tolist()
        if not any(probe):
            return df.select(key, F.lit(1.0).alias("distance")).limit(0)
        dot = _dot(vector_to_array("features"), F.array(*map(F.lit, probe)))
        return self.transform(df).select(key, F.round(1 - dot, 9).alias("distance")).orderBy("distance", key).limit(k)


def route(question: str) -> str:
    """``hybrid``, ``semantic`` or ``sql`` by the question's words."""
    likes = re.search(r"\b(?:similar to|like|described as|about|related to|resembl\w+|kind of|sort of)\b", question, re.I)
    figures = re.search(r"\b(?:how many|how much|total|revenue|average|sum|count|number of|sales|most|top)\b", question, re.I)
    return "hybrid" if likes and figures else "semantic" if likes else "sql"


def narrowed(fact: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """The fact rows whose key a search has matched."""
    return fact.join(matches.select(key), key, "left_semi")


class HybridAgent:
    """Routes a question to search, to search-narrowed SQL, or to the structured agent."""

    def __init__(self, engine: Engine, agent, table: str, key: str, text: str, top: int = TOP, threshold: float = THRESHOLD) -> None:
        self.engine, self.agent, self.table, self.key, self.text, self.top, self.threshold = engine, agent, table, key, text, top, threshold
        self.embedder = TfIdf(engine.frame(table), text)

    def semantic_search(self, question: str) -> DataFrame:
        return self.embedder.search(self.engine.frame(self.table), question, self.key, self.top).where(F.col("distance") <= self.threshold)

    def run(self, question: str):
        way = route(question)
        if way == "sql":
            return self.agent.run(question)
        found = self.semantic_search(question)
        if way == "semantic":
            return found.join(self.engine.frame(self.table).select(self.key, self.text), self.key).orderBy("distance", self.key)
        frames = dict(self.engine.frames)
        frames[self.table] = narrowed(frames[self.table], found, self.key)
        return self.agent.on(Engine(self.engine.spark, frames, self.engine.catalog)).run(question)
