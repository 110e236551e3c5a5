"""Connected components of an edge list, by tables: nothing is gathered on the driver but a count.

A vertex or label that very many rows share is never looked up in one task: rows of hot vertices are
dealt to ``SALTS`` tasks, and of labels only those that change are looked up, by distinct label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Rounds after which the labels must have settled; each at least halves the longest chain of labels.
MOST_ROUNDS = 64
#: Tasks that the rows of one hot vertex or label are dealt to, and neighbours from which a vertex is hot.
SALTS, HOT = 16, 128
#: Rows up to which changed labels are broadcast (counted first).
FEW = 20_000


def _salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """``labels`` (id, comp, ...) with the labels that ``moved`` (comp, to; written) has replaced; a label may have any number of rows."""
    if moved.count() <= FEW:
        rows = labels.join(F.broadcast(moved.select("comp", "to")), "comp", "left")
    else:  # a hot label's rows go to several tasks
        moved = moved.select("comp", "to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = labels.withColumn("salt", _salt("id")).join(moved.hint("merge"), ["comp", "salt"], "left")
    return rows.select(*(F.coalesce("to", "comp").alias("comp") if c == "comp" else F.col(c) for c in labels.columns))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each vertex of ``edges`` (u, v): comp is the smallest id reachable.

    Each round takes the smallest label among a vertex's neighbours and then that label's own
    label (pointer jumping). Loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    degree = written(both.groupBy(F.col("v").alias("id")).agg((F.count("*") >= HOT).alias("hot")), "degree")
    if not (hot := degree.where("hot").select(F.col("id").alias("v"), "hot")).isEmpty():
        dealt = both.join(hot, "v", "left")
    else:
        dealt = both.withColumn("hot", F.lit(None).cast("boolean"))
    dealt = written(dealt.select("u", "v", F.when(F.col("hot"), _salt("u")).otherwise(0).alias("salt")), "dealt")
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    labels = degree.select("id", F.col("id").alias("comp"), "hot")
    for turn in range(MOST_ROUNDS):
        near = dealt.join(labels.select(F.col("id").alias("v"), "comp", salts), ["v", "salt"]).groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id", "left").select("id", "hot", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # a label that shrinks takes the vertex that carried it along: labels are vertices too
        pull = step.groupBy(F.col("old").alias("id")).agg(F.min("comp").alias("pull"))
        step = written(step.join(pull, "id", "left").select("id", "hot", "old", F.least("comp", "pull").alias("comp")), "labels")
        if turn:
            forget(spark, labels)
        if step.where("old <> comp").isEmpty():
            forget(spark, both, degree, dealt)
            return step.select("id", "comp")
        # of the distinct labels, those whose own label is smaller
        own = step.select(F.col("id").alias("comp"), F.col("comp").alias("to")).where("to < comp")
        moved = written(step.select("comp").distinct().join(own, "comp"), "moved")
        labels = written(relabelled(step.select("id", "comp", "hot"), moved), "labels")
        forget(spark, step, moved)
    raise RuntimeError("labels have not settled")
