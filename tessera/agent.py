"""The loop: plan, repair, validate, run, check, answer; at most three attempts."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field, replace
from typing import Protocol

from .errors import Failure, ValidationError, classify
from .functions import intent as words
from .functions import verify
from .functions.intent import Intent
from .operators import measures
from .operators.measures import cross_check
from .operators.profile import Profile
from .plans import validate as v
from .plans.grain import measure_source
from .plans.repair import repaired
from .plans.spec import Agg, Bin, Col, Join, QuerySpec, Star, columns, join_along, render, semantic_diff
from .sources.catalog import Catalog, Engine, MetadataStore

ATTEMPTS, MOST_ROWS = 3, 500


class Planner(Protocol):
    """Turns a question into an intent and a query; ``error`` is what was wrong with the last one."""

    def plan(self, question: str, catalog: Catalog, error: ValidationError | None = None) -> tuple[Intent, QuerySpec]: ...


class ScriptedPlanner:
    """Plans given in advance, one an attempt; the last is repeated."""

    def __init__(self, *plans: tuple[Intent, QuerySpec] | QuerySpec) -> None:
        self.plans = [p if isinstance(p, tuple) else (Intent(), p) for p in plans]

    def plan(self, question: str, catalog: Catalog, error: ValidationError | None = None) -> tuple[Intent, QuerySpec]:
        return self.plans.pop(0) if len(self.plans) > 1 else self.plans[0]


class LexiconPlanner:
    """A deterministic planner by vocabulary; a question it can't read is refused, never guessed at."""

    def plan(self, question: str, catalog: Catalog, error: ValidationError | None = None) -> tuple[Intent, QuerySpec]:
        low = words.re.findall(r"[a-z_]+", question.lower())
        first = lambda t: next((i for i, w in enumerate(low) if w in words.lexemes(t)), len(low))
        named = sorted((t for t in catalog.list_tables() if words.lexemes(t) & set(low)), key=lambda t: (first(t), t))
        groups = [t for g in words.grouping(question) for t in named if g in words.lexemes(t)]
        ranked = words.asks_ranking(question)
        metric = words.extreme(question) or ("COUNT" if words.asks_count(question) else "AVG" if words.re.search(r"\b(?:average|avg|mean)\b", question, words.re.I) else "SUM" if words.asks_money(question) else None)
        if metric is None and ranked and words.re.search(r"\bmost\b|\bfewest\b", question, words.re.I):
            metric = "COUNT"
        kind = words.measure_family(question)
        if metric is None and ranked and kind:
            metric = "SUM"
        entity = groups[0] if groups else named[0] if named else None
        others = [t for t in named if t != entity]
        if entity and others and words.says_none(question):
            return self._without(entity, others[0], catalog)
        if entity and metric is None and words.result_shape(question) == "list":
            return self._listing(entity, catalog)
        if entity is None and metric in ("SUM", "AVG") and catalog.sales_root:
            entity = catalog.sales_root  # a measure without a table is one of the sales
        if entity is None or metric is None:
            raise ValidationError(Failure.NO_PLAN, "the question names no table or no metric that is known here")
        if metric == "COUNT":
            target = next((t for t in others if t in catalog.descendants(entity)), entity)
            arg = Col(target, catalog.table(target).key[0]) if catalog.table(target).key else Star()
            column = None
        else:
            pool = others or [entity, *sorted(catalog.descendants(entity), key=lambda t: (len(catalog.paths(entity, t)[0]), t))]
            fits = [(t, c) for t in [*pool, entity] for c, f in catalog.columns(t).items() if f in ("decimal", "integer") and c not in catalog.table(t).key and words.in_family(c, kind or "money")]
            if not fits:
                fits = [(t, c) for t in pool for c in catalog.columns(t) if v.is_stored(catalog, t, c)]
            if not fits:
                raise ValidationError(Failure.NO_PLAN, f"no column of the {kind or 'money'} family")
            stored = [x for x in fits if v.is_stored(catalog, *x)]
            target, column = (stored or fits)[0]
            arg = Col(target, column)
        grouped = bool(groups) or (ranked and target != entity)
        spec = QuerySpec(relations=((entity, entity),), select=())
        if target != entity:
            path = catalog.path(entity, target)
            if path is None:
                raise ValidationError(Failure.NO_PLAN, f"nothing joins {entity} and {target}")
            spec = join_along(spec, catalog, path)
        name = f"{metric.lower()}_{column or target}"
        label = next((c for c, f in catalog.columns(entity).items() if f == "text"), None)
        keys = [Col(entity, k) for k in catalog.table(entity).key] + ([Col(entity, label)] if label else [])
        shown = tuple((k, k.name) for k in keys) if grouped else ()
        up = words.direction(question, "DESC") == "DESC"
        spec = replace(
            spec, select=(*shown, (Agg(metric, arg), name)), group_by=tuple(keys) if grouped else (),
            order_by=((Col(None, name), up),) if grouped and ranked else (), limit=words.number(question) if grouped and ranked else None,
        )
        plan = Intent(tables=tuple(t for _, t in spec.relations), metric=metric, column=column, entity=entity, ranked=(grouped and ranked) or None, direction="DESC" if up else "ASC", limit=spec.limit, grouping=tuple(groups))
        return words.gated(plan, question), spec


    @staticmethod
    def _shown(entity: str, catalog: Catalog) -> tuple:
        label = next((c for c, f in catalog.columns(entity).items() if f == "text"), None)
        return tuple((Col(entity, c), c) for c in dict.fromkeys([*catalog.table(entity).key, *([label] if label else [])]))

    def _listing(self, entity: str, catalog: Catalog) -> tuple[Intent, QuerySpec]:
        """All rows of a table: key and name."""
        return Intent(tables=(entity,), entity=entity, shape="list"), QuerySpec(((entity, entity),), self._shown(entity, catalog))

    def _without(self, entity: str, other: str, catalog: Catalog) -> tuple[Intent, QuerySpec]:
        """The rows of a table that no row of another refers to, or that refer to none."""
        between = catalog.edges(entity, other)
        if len(between) != 1:
            raise ValidationError(Failure.NO_PLAN, f"{len(between)} references between {entity} and {other}; one is needed")
        on = tuple((Col(entity, a), Col(other, b)) for a, b in between[0].between(entity))
        spec = QuerySpec(((entity, entity), (other, other)), self._shown(entity, catalog), (Join(other, on, how="anti"),))
        return Intent(tables=(entity, other), entity=entity, shape="list"), spec


@dataclass
class Metrics:
    """M8"""

    counts: Counter = field(default_factory=Counter)
    seconds: Counter = field(default_factory=Counter)

    def record(self, step: str, seconds: float) -> None:
        self.counts[step] += 1
        self.seconds[step] += seconds

    def summary(self) -> str:
        return "; ".join(f"{k}: {self.counts[k]} in {self.seconds[k]:.3f} s" for k in self.counts)


@dataclass
class Result:
    answer: str
    spec: QuerySpec | None
    columns: list[str] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    attempts: int = 1
    failures: list[Failure] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    diff: list[str] = field(default_factory=list)
    seconds: float = 0.0


def told(columns: list[str], rows: list[list], total: int) -> str:
    """A plain answer: a value, a listing, or a preview."""
    if total > verify.PREVIEW_OVER:
        return verify.preview(columns, rows, total)
    if len(rows) == 1 and len(columns) == 1:
        return f"{columns[0]}: {rows[0][0]}"
    return "\n".join("; ".join(f"{c}: {x}" for c, x in zip(columns, r, strict=True)) for r in rows) or "no rows"


class Agent:
    """A6 and the control loop over one engine."""

    def __init__(self, engine: Engine, planner: Planner | None = None, profile: Profile | None = None, equivalences: list[dict] | None = None, answer=told, mode: str = "drop", store: MetadataStore | None = None) -> None:
        self.engine, self.planner, self.profile, self.store = engine, planner or LexiconPlanner(), profile, store
        self.answer, self.mode, self.metrics = answer, mode, Metrics()
        self.equivalences = [*(equivalences or []), *(measures.from_text(x) for x in self._learnt().values() if x)]

    def on(self, engine: Engine) -> Agent:
        """The same agent over other frames."""
        return Agent(engine, self.planner, self.profile, self.equivalences, self.answer, self.mode)

    def _learnt(self) -> dict:
        """What the store knows of this catalog: by tried measure, the equivalence as text, or None where the proof failed."""
        return (self.store.get(MetadataStore.fingerprint(self.engine.catalog), "equivalences") or {}) if self.store else {}

    def learn(self, spec: QuerySpec) -> list[dict]:
        """H2 in the loop: the query's line arithmetic against the parents' stored totals, each tried once for a catalog."""
        catalog, found, known = self.engine.catalog, [], self._learnt()
        for a in spec.aggregates():
            owners = {v.owner(spec, catalog, c) for c in columns(a.arg)}
            detail = next(iter(owners)) if len(owners) == 1 else None
            if a.fn != "SUM" or not isinstance(a.arg, Bin) or detail is None:
                continue
            for parent in catalog.parents(detail):
                for column in sorted(catalog.table(parent).stored_measures):
                    plain = measures.bare(a.arg)
                    name = f"{detail}:{render(plain)}:{parent}.{column}"
                    if name not in known and len(catalog.edges(detail, parent)) == 1:
                        got = measures.learn_equivalence(self.engine, detail, plain, parent, column)
                        known[name] = measures.to_text(got) if got else None
                        found += [got] if got else []
        if self.store and known:
            self.store.set(MetadataStore.fingerprint(catalog), "equivalences", known)
        self.equivalences += found
        return found

    def _timed(self, step: str, f, *args):
        began = time.time()
        try:
            return f(*args)
        finally:
            self.metrics.record(step, time.time() - began)

    def checked(self, question: str, plan: Intent, spec: QuerySpec) -> QuerySpec:
        """The query, repaired and valid; what follows a repair is validated as well."""
        spec = self._timed("repair", lambda: repaired(spec, self.engine.catalog, question, plan, self.equivalences, mode=self.mode))
        self._timed("validate", lambda: v.validate(spec, self.engine.catalog, question, plan))
        return spec

    def run(self, question: str) -> Result:
        began, failures, error, first, before = time.time(), [], None, None, None
        for attempt in range(1, ATTEMPTS + 1):
            try:
                plan, raw = self._timed("plan", self.planner.plan, question, self.engine.catalog, error)
                first = first or raw
                repeated = error is not None and error.failure is Failure.OVERVALIDATION and str(error) == before
                try:
                    spec = self.checked(question, plan, raw)
                except ValidationError as e:
                    if not (e.failure is Failure.OVERVALIDATION and str(e) == before):
                        raise
                    repeated, spec = True, repaired(raw, self.engine.catalog, question, plan)
                df = spec.frame(self.engine)
                rows = self._timed("execute", lambda df=df: [list(r) for r in df.limit(MOST_ROWS + 1).collect()])
                total = len(rows) if len(rows) <= MOST_ROWS else df.count()
                if self.profile:
                    self.profile.check_result(spec, self.engine.catalog, rows)
                result = Result(self.answer(df.columns, rows[:MOST_ROWS], total), spec, df.columns, rows[:MOST_ROWS], attempt, failures, list(spec.notes), semantic_diff(first, spec))
                if repeated:
                    result.warnings.append("accepted although the planned table is not in it")
                for q in self.equivalences:
                    if len(rows) == 1 and len(rows[0]) == 1 and isinstance(rows[0][0], (int, float)) and any({c.name for c in columns(a.arg)} == {c.name for c in columns(q["expr"])} for a in spec.aggregates()):
                        warn = cross_check(float(rows[0][0]), self.engine, q, bool(spec.where))
                        result.warnings += [warn] if warn else []
                if self.store:
                    self._timed("learn", self.learn, spec)
                return self._verified(result, df.columns, total, began)
            except ValidationError as e:
                before, error = str(e), e
                failures.append(e.failure)
            except Exception as e:  # Spark's analysis and execution errors go back to the planner
                error = ValidationError(classify(e), str(e).splitlines()[0])
                failures.append(error.failure)
        return Result(f"no answer: {error}", None, attempts=ATTEMPTS, failures=failures, seconds=time.time() - began)

    def _verified(self, result: Result, names: list[str], total: int, began: float) -> Result:
        def findings() -> list[str]:
            """A2, A4, A5"""
            off = [] if not result.rows or verify.touches(result.answer, names, result.rows) else ["the answer says nothing of the result"]
            return off + verify.verify(result.answer, names, result.rows)

        if total <= verify.PREVIEW_OVER:
            issues = findings()
            if self.answer is told:  # printed from the rows: another try would say the same
                result.warnings += issues
                issues = []
            if issues:
                result.answer = self.answer(names, result.rows, total)
                issues = findings()
            if issues:
                result.failures = [*result.failures, Failure.UNGROUNDED]
                result.answer = "NOT VERIFIED: " + "; ".join(issues) + "\n" + result.answer
        result.seconds = time.time() - began
        return result


def source_of(question: str, engine: Engine, plan: Intent, profile: Profile) -> tuple[str | None, bool]:
    """G5 for a plan."""
    return measure_source(question, engine.catalog, set(plan.tables) or set(engine.catalog.tables), plan.entity, plan.metric or "SUM", plan.column, profile.confirmed())
