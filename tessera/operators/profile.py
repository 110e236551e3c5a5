"""Statistical profile of tables, from one aggregation each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Failure, ValidationError
from ..plans.spec import Agg, Col, QuerySpec, Star
from ..sources.catalog import Catalog, Engine

#: The relative deviation of distinct counts where an estimate is asked for.
ERROR = 0.01
CONFIRMED = 1.5


def profile_columns(engine: Engine, table: str, exact: bool = True) -> DataFrame:
    """(table, column, n, min, max, avg, ndistinct, role) of each numeric column."""
    kinds, key = engine.catalog.columns(table), engine.catalog.table(table).key
    numeric = [c for c, f in kinds.items() if f in ("integer", "decimal")]
    df = engine.frame(table)
    count = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, ERROR)
    if not numeric:
        return df.sparkSession.createDataFrame([], "table string, column string, n long, min double, max double, avg double, ndistinct long, role string")
    got = df.agg(
        F.count("*").alias("n"),
        *(F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).cast("double").alias("avg"), count(F.col(c)).cast("long").alias("ndistinct")).alias(f"x{i}") for i, c in enumerate(numeric)),
    )
    rows = got.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(c in key).alias("key"), F.col(f"x{i}").alias("x")) for i, c in enumerate(numeric)))).alias("r"))
    rows = rows.select(F.lit(table).alias("table"), F.col("r.column").alias("column"), "n", "r.x.min", "r.x.max", "r.x.avg", "r.x.ndistinct", F.col("r.key").alias("key"))
    n = F.col("n")
    identifier = F.col("key") | (
        (F.col("ndistinct") >= F.greatest(F.lit(1), F.floor(n * 0.95))) & (F.abs("min") <= 1) & (F.col("max") <= F.greatest(n * 1.5, F.lit(10.0)))
    )
    return rows.withColumn("role", F.when(F.col("min").isNull() & ~F.col("key"), "empty").when(identifier, "identifier").otherwise("measure")).drop("key")


def edge_multiplicity(engine: Engine) -> DataFrame:
    """(child, parent, ratio, confirmed) by row counts, rounded to three digits."""
    counts = None
    for t in engine.catalog.list_tables():
        one = engine.frame(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n")
        counts = one if counts is None else counts.unionByName(one)
    edges = engine.spark.createDataFrame([(k.table, ",".join(k.columns), k.parent) for k in engine.catalog.foreign_keys], "child string, columns string, parent string")
    got = edges.join(counts.select(F.col("t").alias("child"), F.col("n").alias("c")), "child").join(counts.select(F.col("t").alias("parent"), F.col("n").alias("p")), "parent")
    got = got.withColumn("ratio", F.when(F.col("p") == 0, 0.0).otherwise(F.round(F.col("c") / F.col("p"), 3)))
    return got.select("child", "columns", "parent", "ratio", (F.col("ratio") >= CONFIRMED).alias("confirmed"))


def childless(engine: Engine, child: str, parent: str) -> DataFrame:
    """(childless, orphans): parents without a child, and children without a parent."""
    pairs = engine.catalog.edges(child, parent)[0].pairs()
    c = engine.frame(child).select(*(F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(pairs)))
    p = engine.frame(parent).select(*(F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(pairs)))
    keys = [f"k{i}" for i in range(len(pairs))]
    a = p.join(c, keys, "left_anti").agg(F.count("*").alias("childless"))
    return a.join(c.dropna(subset=keys).join(p, keys, "left_anti").agg(F.count("*").alias("orphans")))  # one row each


@dataclass
class Profile:
    """Column statistics and edges on the driver: as many entries as columns and references."""

    rows: dict[str, int] = field(default_factory=dict)
    columns: dict[tuple[str, str], dict] = field(default_factory=dict)
    edges: dict[tuple[str, str], tuple[float, bool]] = field(default_factory=dict)

    @classmethod
    def build(cls, engine: Engine, exact: bool = True) -> Profile:
        """Distinct counts are exact at every size; estimated only if asked for."""
        out = cls()
        for t in engine.catalog.list_tables():
            out.rows[t] = engine.frame(t).count()
            for r in profile_columns(engine, t, exact).collect():
                out.columns[t, r["column"]] = r.asDict()
        for k in engine.catalog.foreign_keys:
            ratio = round(out.rows[k.table] / out.rows[k.parent], 3) if out.rows[k.parent] else 0.0
            out.edges[k.table, k.parent] = ratio, ratio >= CONFIRMED
        return out

    def confirmed(self) -> set[tuple[str, str]]:
        return {e for e, (_, ok) in self.edges.items() if ok}

    def confirmed_children(self, table: str) -> list[str]:
        """P4"""
        return sorted(c for c, p in self.confirmed() if p == table)

    def event_depths(self) -> dict[str, int]:
        """P5: the longest confirmed chain above each table; cycles end at the number of tables."""
        depth = dict.fromkeys(self.rows, 0)
        for _ in self.rows:
            for c, p in self.confirmed():
                if c != p:
                    depth[c] = max(depth[c], min(depth[p] + 1, len(self.rows)))
        return depth

    def measures_in_subtree(self, catalog: Catalog, root: str) -> list[tuple[str, str]]:
        """P6"""
        below = catalog.descendants(root) | {root}
        return sorted(k for k, r in self.columns.items() if k[0] in below and r["role"] == "measure")

    def base_row_count(self, table: str) -> int | None:
        """P7"""
        return self.rows.get(table)

    def is_money_capable(self, catalog: Catalog, table: str, column: str) -> bool:
        """P8"""
        return catalog.columns(table).get(column) == "decimal"

    def money_in_subtree(self, catalog: Catalog, root: str) -> list[tuple[str, str]]:
        return sorted((t, c) for t in catalog.descendants(root) | {root} for c, f in catalog.columns(t).items() if f == "decimal")

    def range_note(self, table: str, column: str) -> str:
        """P9"""
        r = self.columns.get((table, column))
        return f"{table}.{column} in [{r['min']:g}, {r['max']:g}] over {r['n']} rows" if r and r["min"] is not None else ""

    def check_result(self, spec: QuerySpec, catalog: Catalog, rows: list[list]) -> None:
        """A single ungrouped aggregate lies where the columns' ranges allow; what can't be resolved passes."""
        if spec.group_by or len(spec.select) != 1 or len(rows) != 1 or not isinstance(spec.select[0][0], Agg):
            return
        agg, value = spec.select[0][0], rows[0][0]
        if value is None or isinstance(value, (str, bool)):
            return
        most = 1
        for _, t in spec.relations:
            most *= max(1, self.rows.get(t, 1)) if not spec.joins else 1
        most = most if not spec.joins else max(self.rows.get(t, 0) for _, t in spec.relations) * max(1, int(max((r for r, _ in self.edges.values()), default=1)))
        if agg.fn == "COUNT" and isinstance(agg.arg, (Col, Star)) and not 0 <= value <= most:
            raise ValidationError(Failure.IMPLAUSIBLE, f"a count of {value} of at most {most} rows")
        if not isinstance(agg.arg, Col):
            return
        from ..plans.validate import owner

        table = owner(spec, catalog, agg.arg)
        r = self.columns.get((table, agg.arg.name)) if table else None
        if not r or r["min"] is None:
            return
        if agg.fn == "SUM" and r["min"] >= 0 and value < 0:
            raise ValidationError(Failure.IMPLAUSIBLE, f"a negative sum of {agg.arg.name}, which is never negative")
        if agg.fn == "AVG" and not r["min"] - 1e-9 <= value <= r["max"] + 1e-9:
            raise ValidationError(Failure.IMPLAUSIBLE, f"a mean of {value} outside [{r['min']}, {r['max']}]")
