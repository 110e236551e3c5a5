"""Stored totals and the line arithmetic they equal: learned only by proof per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Bin, Col, Lit, render
from ..sources.catalog import Engine

TOLERANCE, CHECK_TOLERANCE = 0.005, 0.01


def per_key(engine: Engine, detail: str, expr: object, parent: str, column: str) -> DataFrame:
    """(parents, with_lines, outside): how many parents differ from their own lines by more than the tolerance."""
    pairs = engine.catalog.edges(detail, parent)[0].pairs()
    lines = engine.frame(detail).groupBy(*(F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(pairs))).agg(F.sum(F.expr(render(expr))).alias("lines"))
    heads = engine.frame(parent).select(*(F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(pairs)), F.col(column).alias("total"))
    both = heads.join(lines, [f"k{i}" for i in range(len(pairs))], "left")
    off = F.abs(F.col("lines") - F.col("total")) > F.lit(TOLERANCE) * F.abs("total")
    return both.agg(F.count("*").alias("parents"), F.count("lines").alias("with_lines"), F.sum(F.when(off, 1).otherwise(0)).cast("long").alias("outside"))


def learn_equivalence(engine: Engine, detail: str, expr: object, parent: str, column: str) -> dict | None:
    """H2: the equivalence, if every parent with lines agrees with them."""
    r = per_key(engine, detail, expr, parent, column).first()
    if not r["with_lines"] or r["outside"]:
        return None
    return {"detail_table": detail, "expr": expr, "parent_table": parent, "parent_col": column, "childless": r["parents"] - r["with_lines"]}


def bare(expr: object) -> object:
    """The expression with columns by name alone."""
    if isinstance(expr, Bin):
        return Bin(expr.op, bare(expr.left), bare(expr.right))
    return Col(None, expr.name) if isinstance(expr, Col) else expr


def _listed(expr: object) -> list:
    if isinstance(expr, Bin):
        return ["bin", expr.op, _listed(expr.left), _listed(expr.right)]
    return ["col", expr.rel, expr.name] if isinstance(expr, Col) else ["lit", expr.value]


def _read(x: list) -> object:
    return Bin(x[1], _read(x[2]), _read(x[3])) if x[0] == "bin" else Col(x[1], x[2]) if x[0] == "col" else Lit(x[1])


def to_text(equivalence: dict) -> dict:
    """An equivalence as plain lists and texts, for a store."""
    return equivalence | {"expr": _listed(equivalence["expr"])}


def from_text(stored: dict) -> dict:
    return stored | {"expr": _read(stored["expr"])}


def cross_check(value: float, engine: Engine, equivalence: dict, filtered: bool = False) -> str | None:
    """H3: a warning where an unfiltered result is off the stored total by more than one per cent."""
    if filtered:
        return None
    total = engine.frame(equivalence["parent_table"]).agg(F.sum(equivalence["parent_col"]).cast("double")).first()[0]
    if total is None or abs(value - total) <= CHECK_TOLERANCE * abs(total):
        return None
    return f"the result {value} differs from the stored total {total}"
