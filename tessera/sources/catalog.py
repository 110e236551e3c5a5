"""The catalog: tables, declared keys, and the graph of their references.

Keys live here because Spark's session catalog stores none for Parquet tables. Only declared
references are edges; values that happen to be contained in another column make none.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegralType, StringType, StructType

from ..errors import Failure, ValidationError


def family(kind: DataType) -> str:
    """``integer``, ``decimal`` (money-like), ``text`` or ``other``."""
    if isinstance(kind, IntegralType):
        return "integer"
    if isinstance(kind, (DecimalType, FloatType, DoubleType)):
        return "decimal"
    return "text" if isinstance(kind, StringType) else "other"


@dataclass(frozen=True)
class ForeignKey:
    """``table.columns`` refer to ``parent.parent_columns``; composite keys are one edge."""

    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    def pairs(self) -> tuple[tuple[str, str], ...]:
        return tuple(zip(self.columns, self.parent_columns, strict=True))

    def between(self, left: str) -> tuple[tuple[str, str], ...]:
        """Column pairs as (of ``left``, of the other table)."""
        return self.pairs() if left == self.table else tuple((b, a) for a, b in self.pairs())


@dataclass(frozen=True)
class Table:
    name: str
    schema: StructType
    key: tuple[str, ...] = ()
    stored_measures: frozenset[str] = frozenset()


@dataclass
class Catalog:
    """Tables by name, their references, and the table whose descendants count as sales."""

    tables: dict[str, Table] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    sales_root: str | None = None

    # --- C2-C4
    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def describe(self, table: str) -> list[dict]:
        t = self.table(table)
        return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "primary_key": f.name in t.key} for f in t.schema]

    def list_foreign_keys(self, table: str | None = None) -> list[ForeignKey]:
        return [k for k in self.foreign_keys if table is None or table in (k.table, k.parent)]

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise ValidationError(Failure.UNKNOWN_RELATION, f"no table {name!r}; there are {', '.join(self.list_tables())}")
        return self.tables[name]

    def columns(self, table: str) -> dict[str, str]:
        """Column -> type family."""
        return {f.name: family(f.dataType) for f in self.table(table).schema}

    def owners(self, column: str, among: Iterable[str] | None = None) -> list[str]:
        return [t for t in sorted(among if among is not None else self.tables) if column in self.columns(t)]

    # --- C7
    def subset(self, names: Iterable[str]) -> Catalog:
        keep = set(names)
        return Catalog({n: t for n, t in self.tables.items() if n in keep}, tuple(k for k in self.foreign_keys if {k.table, k.parent} <= keep), self.sales_root if self.sales_root in keep else None)

    def context(self) -> str:
        """The picked tables as text: columns, references among them, and which side of each reference is the fact."""
        lines = [f"{n}({', '.join(f'{c} {k}' for c, k in self.columns(n).items())})" for n in self.list_tables()]
        lines += [f"{k.table}.{','.join(k.columns)} -> {k.parent}.{','.join(k.parent_columns)}" for k in self.foreign_keys]
        facts, parents = {k.table for k in self.foreign_keys}, {k.parent for k in self.foreign_keys}
        lines += [f"{t}: {'fact' if t in facts - parents else 'dimension'}" for t in sorted(facts ^ parents)]
        return "\n".join(lines)

    # --- C9
    def edges(self, a: str, b: str) -> list[ForeignKey]:
        return [k for k in self.foreign_keys if {k.table, k.parent} == {a, b}]

    def is_pair(self, a: str, column_a: str, b: str, column_b: str) -> bool:
        """Whether two columns are equated by some declared reference."""
        return any((column_a, column_b) in k.between(a) for k in self.edges(a, b))

    def is_reference(self, a: str, b: str, pairs: Iterable[tuple[str, str]]) -> bool:
        """Whether equated column pairs (of ``a``, of ``b``) hold all columns of some declared reference."""
        have = set(pairs)
        return any(set(k.between(a)) <= have or (a == b and {(y, x) for x, y in k.pairs()} <= have) for k in self.edges(a, b))

    def children(self, table: str) -> list[str]:
        return sorted({k.table for k in self.foreign_keys if k.parent == table and k.table != table})

    def parents(self, table: str) -> list[str]:
        return sorted({k.parent for k in self.foreign_keys if k.table == table and k.parent != table})

    def _closure(self, table: str, step: Callable[[str], list[str]]) -> set[str]:
        seen, todo = set(), [table]
        while todo:
            for x in step(todo.pop()):
                if x not in seen and x != table:
                    seen.add(x)
                    todo.append(x)
        return seen

    def descendants(self, table: str) -> set[str]:
        return self._closure(table, self.children)

    def ancestors(self, table: str) -> set[str]:
        return self._closure(table, self.parents)

    def paths(self, start: str, goal: str) -> list[list[str]]:
        """All shortest table paths between two tables, in a fixed order."""
        found, best, todo = [], None, deque([[start]])
        while todo:
            path = todo.popleft()
            if best is not None and len(path) > best:
                break
            if path[-1] == goal:
                best = len(path)
                found.append(path)
                continue
            for x in sorted(set(self.children(path[-1])) | set(self.parents(path[-1]))):
                if x not in path:
                    todo.append([*path, x])
        return found

    def path(self, start: str, goal: str) -> list[str] | None:
        """The shortest path; an error if there are several, none if there is none."""
        found = self.paths(start, goal)
        if len(found) > 1:
            raise ValidationError(Failure.AMBIGUOUS, f"{start} and {goal} are joined equally well by " + " or ".join("-".join(p) for p in found))
        return found[0] if found else None

    # --- C8
    def bridge(self, seeds: Iterable[str]) -> list[str]:
        """The seeds and all tables on the shortest paths between each two of them."""
        seeds = sorted(set(seeds))
        got = set(seeds)
        for i, a in enumerate(seeds):
            for b in seeds[i + 1 :]:
                got.update(*(self.paths(a, b)[:1]))
        return sorted(got)


#: Schemas by file and when it was written, so that opening an unchanged folder again reads no footers.
_SCHEMAS: dict[str, tuple[tuple, StructType]] = {}


def _written(spark: SparkSession, file: str) -> tuple:
    """What changes when a table is written anew: the newest time, the number and the bytes of its files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return max((f.getModificationTime() for f in found), default=0), len(found), sum(f.getLen() for f in found)


def read_table(spark: SparkSession, file: str) -> DataFrame:
    now = _written(spark, file)
    if file not in _SCHEMAS or _SCHEMAS[file][0] != now:
        _SCHEMAS[file] = now, spark.read.parquet(file).schema
    return spark.read.schema(_SCHEMAS[file][1]).parquet(file)


class Engine:
    """A session with a folder of Parquet tables under one catalog."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], catalog: Catalog) -> None:
        self.spark, self.frames, self.catalog = spark, frames, catalog

    @classmethod
    def folder(cls, spark: SparkSession, path: str, keys: dict[str, tuple[str, ...]], foreign_keys: Iterable[ForeignKey], stored: dict[str, set[str]] | None = None, sales_root: str | None = None, only: Iterable[str] | None = None) -> Engine:
        names = list(only) if only is not None else sorted(set(keys) | {k.table for k in foreign_keys})
        frames = {n: read_table(spark, f"{path}/{n}.parquet") for n in names}
        tables = {n: Table(n, df.schema, keys.get(n, ()), frozenset((stored or {}).get(n, ()))) for n, df in frames.items()}
        return cls(spark, frames, Catalog(tables, tuple(k for k in foreign_keys if k.table in tables and k.parent in tables), sales_root))

    def frame(self, table: str) -> DataFrame:
        self.catalog.table(table)
        return self.frames[table]

    def sql(self, text: str) -> DataFrame:
        """A read-only statement over the catalog's tables, which it names as ``{table}`` or plainly."""
        from .gateway import check_read_only

        check_read_only(self.spark, text, self.catalog)
        views = {v.name for v in self.spark.catalog.listTables() if v.isTemporary}
        before = {n: self.spark.table(n) for n in self.frames if n.lower() in views}
        try:
            for name, df in self.frames.items():
                df.createOrReplaceTempView(name)
            out = self.spark.sql(text)
            out.schema  # analysed while the names are this engine's
            return out
        finally:  # the session's own views of these names come back
            for name in self.frames:
                if name in before:
                    before[name].createOrReplaceTempView(name)
                else:
                    self.spark.catalog.dropTempView(name)

    def run_query(self, text: str, most: int = 500) -> dict:
        """Columns and at most ``most`` rows, with whether there were more."""
        df = self.sql(text)
        rows = [list(r) for r in df.limit(most + 1).collect()]
        return {"columns": df.columns, "rows": rows[:most], "row_count": min(len(rows), most), "truncated": len(rows) > most}


class MetadataStore:
    """A JSON file of facts by table fingerprint, with version, age limit and atomic replacement."""

    VERSION = 1

    def __init__(self, path: str, ttl: float | None = 300.0, clock: Callable[[], float] = time.time) -> None:
        self.path, self.ttl, self.clock = path, ttl, clock
        self.data: dict = {}
        try:
            with open(path) as f:
                got = json.load(f)
            self.data = got["data"] if got.get("version") == self.VERSION else {}
        except (OSError, ValueError, KeyError):
            pass

    @staticmethod
    def fingerprint(catalog: Catalog) -> str:
        return hashlib.sha256(catalog.context().encode()).hexdigest()[:16]

    def get(self, owner: str, key: str, ttl: float | None = None):
        got = self.data.get(owner, {}).get(key)
        limit = self.ttl if ttl is None else ttl
        return None if got is None or (limit is not None and limit >= 0 and self.clock() - got["at"] > limit) else got["value"]

    def set(self, owner: str, key: str, value) -> None:
        self.data.setdefault(owner, {})[key] = {"at": self.clock(), "value": value}
        part = f"{self.path}.{os.getpid()}"
        with open(part, "w") as f:
            json.dump({"version": self.VERSION, "data": self.data}, f)
        os.replace(part, self.path)
