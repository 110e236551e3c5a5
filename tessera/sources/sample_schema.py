"""The declared key graph of the TPC-H-like driver tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .catalog import Engine, ForeignKey

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "embeddings": ("vec_id",),
}
REFERENCES = tuple(
    ForeignKey(t, (c,), p, (k,))
    for t, c, p, k in (
        ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
    )
)
STORED = {"orders": {"o_totalprice"}}


def open_tables(spark: SparkSession, path: str) -> Engine:
    return Engine.folder(spark, path, KEYS, REFERENCES, STORED, sales_root="orders")
