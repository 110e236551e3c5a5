"""Top N with ties at the boundary kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_with_ties(df: DataFrame, key: str, n: int, desc: bool = True) -> DataFrame:
    """Rows whose rank by ``key`` is at most ``n``; nulls come last.

    Spark puts a group limit under the ranking window, so that each task sends on only its own
    leading rows; the window's single partition gets those, not the whole input.
    """
    order = F.col(key).desc_nulls_last() if desc else F.col(key).asc_nulls_last()
    ranked = df.withColumn("__rnk", F.rank().over(Window.orderBy(order))).where(F.col("__rnk") <= n)
    rest = [c for c in df.columns if c != key]
    return ranked.orderBy("__rnk", *rest).drop("__rnk")
