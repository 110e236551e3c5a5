"""The read-only gate: only plans made of known query nodes pass.

The one module that uses Spark's parser handle; it never analyses or runs the statement.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..errors import Failure, ValidationError
from .catalog import Catalog

#: Logical plan nodes of queries. Fixed values.
QUERY_NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Limit Distinct Union Intersect Except SubqueryAlias UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedWith UnresolvedInlineTable OneRowRelation Window WithWindowDefinition "
    "LateralJoin Generate Offset Deduplicate UnresolvedHint UnresolvedOrderBy UnresolvedTVFAliases Pivot Unpivot LocalRelation ResolvedInlineTable "
    "UnresolvedTableValuedFunction".split()
)
#: What the parser leaves to be resolved inside expressions. Fixed values.
QUERY_NAMES = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedFunction UnresolvedAlias UnresolvedExtractValue UnresolvedOrdinal "
    "UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedWindowExpression UnresolvedIdentifier UnresolvedRegex MultiAlias".split()
)
#: Table functions that only reshape their arguments. Fixed values.
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple range sequence".split())
#: Functions that reach outside the query. Fixed values.
DENIED = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length assert_true raise_error version current_user user session_user".split())


def parse(spark: SparkSession, text: str) -> list[dict]:
    """The unresolved plan as Spark's pre-order list of nodes."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValidationError(Failure.READ_ONLY, f"not one statement that parses: {next((x for x in str(e).splitlines() if x.strip()), '')}") from None
    return json.loads(plan.toJSON())


def _nodes(value):
    if isinstance(value, dict):
        if "class" in value:
            yield value
        for x in value.values():
            yield from _nodes(x)
    elif isinstance(value, list):
        for x in value:
            yield from _nodes(x)


def check_read_only(spark: SparkSession, text: str, catalog: Catalog | None = None) -> list[dict]:
    """The plan's nodes, if all are those of a query on known tables."""
    tree = parse(spark, text)
    named = {str(x).lower() for n in _nodes(tree) for x in _with_names(n)}
    for n in _nodes(tree):
        kind = n["class"].rpartition(".")[2]
        # whatever is no expression is a plan node or a command
        if ".expressions." not in n["class"] and kind not in QUERY_NODES and not (".analysis." in n["class"] and kind in QUERY_NAMES):
            raise ValidationError(Failure.READ_ONLY, f"{kind} is not part of a query")
        if kind in ("UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            name = n.get("functionName", n.get("name", ""))
            name = _words(name.get("funcName", "") if isinstance(name, dict) else name)
            if len(name) != 1 or name[0].lower() not in TABLE_FUNCTIONS:
                raise ValidationError(Failure.READ_ONLY, f"table function {' '.join(name)} is not allowed")
        if kind == "UnresolvedFunction":
            name = _words(n.get("nameParts", ""))[-1:]
            if name and name[0].lower() in DENIED:
                raise ValidationError(Failure.READ_ONLY, f"function {name[0]} is not allowed")
        if kind == "UnresolvedRelation" and catalog is not None:
            parts = _words(n.get("multipartIdentifier", ""))
            if len(parts) != 1 or (parts[0].lower() not in {t.lower() for t in catalog.tables} and parts[0].lower() not in named):
                raise ValidationError(Failure.UNKNOWN_RELATION, f"no table {'.'.join(parts)!r}")
    return tree


def _with_names(node: dict) -> list[str]:
    """Names that a WITH clause defines."""
    if not node["class"].endswith("UnresolvedWith"):
        return []
    got = node.get("cteRelations", [])
    return [x["_1"] for x in got if isinstance(x, dict) and "_1" in x] or [x["alias"] for x in _nodes(got) if isinstance(x.get("alias"), str)]


def _words(value) -> list[str]:
    if isinstance(value, list):
        return [str(x) for x in value]
    return [x.strip() for x in str(value).strip("[]").split(",") if x.strip()]
