"""The query description: relations by alias, joins, expressions; printed as SQL for Catalyst."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..sources.catalog import Catalog, Engine

AGGREGATES = ("SUM", "AVG", "COUNT", "MIN", "MAX")


@dataclass(frozen=True)
class Col:
    rel: str | None
    name: str


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Agg:
    fn: str
    arg: object
    distinct: bool = False


@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Concat:
    parts: tuple


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple


@dataclass(frozen=True)
class Join:
    """Adds relation ``alias``; ``pairs`` equate columns, ``filters`` marks a join meant to drop unmatched rows."""

    alias: str
    pairs: tuple[tuple[Col, Col], ...] = ()
    how: str = "inner"
    filters: bool = False


@dataclass(frozen=True)
class QuerySpec:
    relations: tuple[tuple[str, str], ...]
    select: tuple[tuple[object, str], ...]
    joins: tuple[Join, ...] = ()
    where: tuple = ()
    group_by: tuple = ()
    having: tuple = ()
    order_by: tuple[tuple[object, bool], ...] = ()
    limit: int | None = None
    distinct: bool = False
    ties: bool = False
    notes: tuple[str, ...] = field(default=(), compare=False)

    # --- reading
    def table(self, alias: str) -> str | None:
        return dict(self.relations).get(alias)

    @property
    def root(self) -> str:
        return self.relations[0][0]

    def edges(self) -> list[tuple[Col, Col]]:
        """Column equalities of joins and of WHERE."""
        got = [p for j in self.joins for p in j.pairs]
        return got + [(w.left, w.right) for w in self.where if isinstance(w, Bin) and w.op == "=" and isinstance(w.left, Col) and isinstance(w.right, Col)]

    def expressions(self, joins: bool = True) -> Iterator[object]:
        yield from (e for e, _ in self.select)
        yield from self.where
        yield from self.group_by
        yield from self.having
        yield from (e for e, _ in self.order_by)
        if joins:
            for j in self.joins:
                for a, b in j.pairs:
                    yield a
                    yield b

    def columns(self, joins: bool = True) -> list[Col]:
        names = {n for _, n in self.select}
        return [c for e in self.expressions(joins) for c in columns(e) if not (c.rel is None and c.name in names)]

    def aggregates(self) -> list[Agg]:
        return [a for e in self.expressions() for a in walk(e) if isinstance(a, Agg)]

    def note(self, text: str) -> QuerySpec:
        return replace(self, notes=(*self.notes, text))

    # --- printing
    def sql(self) -> str:
        how = {"inner": "JOIN", "left": "LEFT JOIN", "full": "FULL JOIN", "right": "RIGHT JOIN", "semi": "LEFT SEMI JOIN", "anti": "LEFT ANTI JOIN", "cross": "CROSS JOIN"}
        tables = dict(self.relations)
        joined = {j.alias for j in self.joins}
        text = "SELECT " + ("DISTINCT " if self.distinct else "") + ", ".join(f"{render(e)} AS `{n}`" for e, n in self.select)
        text += "\nFROM " + ", ".join(f"{{{t}}} AS {a}" for a, t in self.relations if a not in joined)
        for j in self.joins:
            text += f"\n{how[j.how]} {{{tables[j.alias]}}} AS {j.alias}"
            if j.pairs:
                text += " ON " + " AND ".join(f"{render(a)} = {render(b)}" for a, b in j.pairs)
        for word, parts in (("WHERE", self.where), ("HAVING", self.having)):
            if word == "HAVING" and self.group_by:
                text += "\nGROUP BY " + ", ".join(map(render, self.group_by))
            if parts:
                text += f"\n{word} " + " AND ".join(map(render, parts))
        if self.ties and self.limit is not None and len(self.order_by) == 1:
            return text
        if self.order_by:
            text += "\nORDER BY " + ", ".join(f"{render(e)} {'DESC NULLS LAST' if d else 'ASC NULLS LAST'}" for e, d in self.order_by)
        return text + (f"\nLIMIT {self.limit}" if self.limit is not None else "")

    def frame(self, engine: Engine) -> DataFrame:
        """The query on the engine's tables."""
        used = {t for _, t in self.relations}
        df = engine.spark.sql(self.sql(), **{t: engine.frame(t) for t in used})
        if self.ties and self.limit is not None and len(self.order_by) == 1:
            from ..operators.topn import top_with_ties

            key, desc = self.order_by[0]
            names = {e: n for e, n in self.select}
            name = names.get(key) or (key.name if isinstance(key, Col) else None)
            return top_with_ties(df, name, self.limit, desc)
        return df


def walk(e: object) -> Iterator[object]:
    yield e
    if isinstance(e, Agg):
        yield from walk(e.arg)
    elif isinstance(e, Bin):
        yield from walk(e.left)
        yield from walk(e.right)
    elif isinstance(e, Concat):
        for x in e.parts:
            yield from walk(x)
    elif isinstance(e, Func):
        for x in e.args:
            yield from walk(x)


def columns(e: object) -> list[Col]:
    return [x for x in walk(e) if isinstance(x, Col)]


def mapped(e: object, f) -> object:
    """The expression with ``f`` applied to each node from the leaves up."""
    if isinstance(e, Agg):
        e = replace(e, arg=mapped(e.arg, f))
    elif isinstance(e, Bin):
        e = replace(e, left=mapped(e.left, f), right=mapped(e.right, f))
    elif isinstance(e, Concat):
        e = replace(e, parts=tuple(mapped(x, f) for x in e.parts))
    elif isinstance(e, Func):
        e = replace(e, args=tuple(mapped(x, f) for x in e.args))
    return f(e)


def rewritten(spec: QuerySpec, f) -> QuerySpec:
    """``f`` on every expression node, those of joins included."""
    go = lambda e: mapped(e, f)
    return replace(
        spec, select=tuple((go(e), n) for e, n in spec.select), where=tuple(map(go, spec.where)), group_by=tuple(map(go, spec.group_by)), having=tuple(map(go, spec.having)),
        order_by=tuple((go(e), d) for e, d in spec.order_by), joins=tuple(replace(j, pairs=tuple((go(a), go(b)) for a, b in j.pairs)) for j in spec.joins),
    )


def render(e: object) -> str:
    if isinstance(e, Col):
        return f"{e.rel}.`{e.name}`" if e.rel else f"`{e.name}`"
    if isinstance(e, Lit):
        if isinstance(e.value, str):
            return "'" + e.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "NULL" if e.value is None else str(e.value)
    if isinstance(e, Star):
        return "*"
    if isinstance(e, Agg):
        return f"{e.fn}({'DISTINCT ' if e.distinct else ''}{render(e.arg)})"
    if isinstance(e, Bin):
        return f"({render(e.left)} {e.op} {render(e.right)})"
    if isinstance(e, Concat):
        return "(" + " || ".join(map(render, e.parts)) + ")"
    if isinstance(e, Func):
        return f"{e.name}({', '.join(map(render, e.args))})"
    raise TypeError(f"no expression: {e!r}")


def join_along(spec: QuerySpec, catalog: Catalog, path: list[str]) -> QuerySpec:
    """Inner joins along a table path whose first table the query has; tables it has already are reused."""
    relations, joins = list(spec.relations), list(spec.joins)
    by_table = {t: a for a, t in reversed(relations)}
    for a, b in zip(path, path[1:], strict=False):
        if b in by_table:
            continue
        alias = b
        while alias in dict(relations):
            alias += "_"
        pairs = tuple((Col(by_table[a], x), Col(alias, y)) for x, y in catalog.edges(a, b)[0].between(a))
        relations.append((alias, b))
        joins.append(Join(alias, pairs))
        by_table[b] = alias
    return replace(spec, relations=tuple(relations), joins=tuple(joins))


def semantic_diff(a: QuerySpec, b: QuerySpec) -> list[str]:
    """H4: what differs in meaning, as tags in a fixed order; ``RENDER_ONLY`` for the same query, ``SYNTAX_ONLY`` for new names."""
    tables = lambda s: sorted(t for _, t in s.relations)
    shape = lambda s, xs: sorted(render(mapped(x, lambda e: Col(s.table(e.rel) or e.rel, e.name) if isinstance(e, Col) else e)) for x in xs)
    tags = []
    if set(tables(b)) - set(tables(a)):
        tags.append("JOIN_ADDED")
    if set(tables(a)) - set(tables(b)):
        tags.append("JOIN_DROPPED")
    if shape(a, a.aggregates()) != shape(b, b.aggregates()):
        tags.append("AGGREGATE_CHANGE")
    if shape(a, a.where) != shape(b, b.where) or shape(a, a.having) != shape(b, b.having):
        tags.append("FILTER_CHANGED")
    if shape(a, a.group_by) != shape(b, b.group_by):
        tags.append("GROUPING_CHANGED")
    if a.limit != b.limit:
        tags.append("LIMIT_CHANGED")
    if [(shape(a, [e]), d) for e, d in a.order_by] != [(shape(b, [e]), d) for e, d in b.order_by]:
        tags.append("ORDER_CHANGED")
    return tags or (["RENDER_ONLY"] if a == b else ["SYNTAX_ONLY"])
