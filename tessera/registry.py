"""Queries registered for the driver, with their independently written SQL.

Most start from a wrong or intent-level query that the engine repairs; the SQL is the right query,
written by hand, so that a comparison tests the repair.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .agent import Agent, LexiconPlanner, ScriptedPlanner
from .errors import Failure, ValidationError
from .functions.intent import Intent
from .functions.language import language_column
from .functions.verify import figure_column, preview, stated_column
from .operators import measures, profile, scoring, topn, vector
from .plans import repair, validate
from .plans.grain import classify_grains, question_grain
from .plans.spec import Agg, Bin, Col, Join, Lit, QuerySpec, Star, semantic_diff
from .sources.catalog import Engine
from .sources.gateway import check_read_only
from .sources.sample_schema import open_tables
from .streaming.windows import sessions, sliding, tumbling

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


C = Col
ORDERS_LINES = Join("l", ((C("o", "o_orderkey"), C("l", "l_orderkey")),))
CUSTOMER_ORDERS = Join("o", ((C("c", "c_custkey"), C("o", "o_custkey")),))


def fixed(engine: Engine, spec: QuerySpec, question: str | None = None, plan: Intent | None = None, mode: str = "drop") -> DataFrame:
    """The query repaired, validated and run."""
    spec = repair.repaired(spec, engine.catalog, question, plan, mode=mode)
    validate.validate(spec, engine.catalog, question, plan)
    return spec.frame(engine)


def _second(engine: Engine, question: str, bad, good, failure: Failure) -> DataFrame:
    """What the loop answers when the planner's first query has to be refused, and for that reason."""
    result = Agent(engine, ScriptedPlanner(bad, good)).run(question)
    if result.failures != [failure] or result.attempts != 2:
        raise AssertionError(f"expected one {failure.value}, got {result.failures} and {result.answer[:200]}")
    return result.spec.frame(engine)


def _asked(spark: SparkSession, sf_dir: str, question: str) -> DataFrame:
    """A question planned by vocabulary alone, run through the whole loop."""
    engine = open_tables(spark, sf_dir)
    result = Agent(engine).run(question)
    if result.spec is None:
        raise AssertionError(result.answer)
    return result.spec.frame(engine)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which 5 customers have the highest total order value, from a query that also joins the lines."""
    return fanout_top_customers(spark, sf_dir)


# --- fan-out


@query("""SELECT c_custkey, c_name, ROUND(total, 2) AS total FROM (SELECT c_custkey, c_name, SUM(o_totalprice) AS total,
RANK() OVER (ORDER BY SUM(o_totalprice) DESC) AS r FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name) WHERE r <= 5""")
def fanout_top_customers(spark, sf_dir):
    spec = QuerySpec(
        (("c", "customer"), ("o", "orders"), ("l", "lineitem")),
        ((C("c", "c_custkey"), "c_custkey"), (C("c", "c_name"), "c_name"), (Agg("SUM", C("o", "o_totalprice")), "total")),
        (CUSTOMER_ORDERS, ORDERS_LINES), group_by=(C("c", "c_custkey"), C("c", "c_name")), order_by=((C(None, "total"), True),), limit=5,
    )
    return fixed(open_tables(spark, sf_dir), spec, "Which 5 customers have the highest total order value?").withColumn("total", F.round("total", 2))


@query("SELECT ROUND(SUM(o_totalprice), 2) AS total FROM orders")
def fanout_scalar_total(spark, sf_dir):
    spec = QuerySpec((("o", "orders"), ("l", "lineitem")), ((Agg("SUM", C("o", "o_totalprice")), "total"),), (ORDERS_LINES,))
    return fixed(open_tables(spark, sf_dir), spec).withColumn("total", F.round("total", 2))


@query("SELECT ROUND(SUM(o_totalprice), 2) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def fanout_semi_total(spark, sf_dir):
    spec = QuerySpec((("o", "orders"), ("l", "lineitem")), ((Agg("SUM", C("o", "o_totalprice")), "total"),), (replace(ORDERS_LINES, filters=True),))
    return fixed(open_tables(spark, sf_dir), spec, mode="semi").withColumn("total", F.round("total", 2))


@query("SELECT c_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def fanout_root_customer(spark, sf_dir):
    spec = QuerySpec(
        (("c", "customer"), ("o", "orders"), ("l", "lineitem")), ((C("c", "c_custkey"), "c_custkey"), (Agg("SUM", C("o", "o_totalprice")), "total")),
        (CUSTOMER_ORDERS, ORDERS_LINES), group_by=(C("c", "c_custkey"),),
    )
    return fixed(open_tables(spark, sf_dir), spec).withColumn("total", F.round("total", 2))


@query("SELECT o_orderkey, ROUND(o_totalprice, 2) AS total FROM orders")
def fanout_group_by_parent_key(spark, sf_dir):
    spec = QuerySpec((("o", "orders"), ("l", "lineitem")), ((C("o", "o_orderkey"), "o_orderkey"), (Agg("SUM", C("o", "o_totalprice")), "total")), (ORDERS_LINES,), group_by=(C("o", "o_orderkey"),))
    return fixed(open_tables(spark, sf_dir), spec).withColumn("total", F.round("total", 2))


@query("SELECT c_mktsegment, ROUND(SUM(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def fanout_grouped_by_segment(spark, sf_dir):
    spec = QuerySpec(
        (("o", "orders"), ("c", "customer"), ("l", "lineitem")), ((C("c", "c_mktsegment"), "c_mktsegment"), (Agg("SUM", C("o", "o_totalprice")), "total")),
        (Join("c", CUSTOMER_ORDERS.pairs), ORDERS_LINES), group_by=(C("c", "c_mktsegment"),),
    )
    return fixed(open_tables(spark, sf_dir), spec).withColumn("total", F.round("total", 2))


LINE_VALUE = Bin("*", C("lineitem", "l_extendedprice"), Bin("-", Lit(1), C("lineitem", "l_discount")))


@query("""SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def line_revenue_by_nation(spark, sf_dir):
    spec = QuerySpec(
        (("lineitem", "lineitem"), ("orders", "orders"), ("customer", "customer")), ((C("nation", "n_name"), "n_name"), (Agg("SUM", LINE_VALUE), "revenue")),
        (Join("orders", ((C("lineitem", "l_orderkey"), C("orders", "o_orderkey")),)), Join("customer", ((C("orders", "o_custkey"), C("customer", "c_custkey")),))), group_by=(C("nation", "n_name"),),
    )
    engine = open_tables(spark, sf_dir)
    engine.catalog.tables.pop("supplier")  # else nation is reached equally well by two routes
    engine.catalog.foreign_keys = tuple(k for k in engine.catalog.foreign_keys if "supplier" not in (k.table, k.parent))
    return fixed(engine, spec).withColumn("revenue", F.round("revenue", 2))


# --- join repairs


@query("""SELECT r_name, CAST(COUNT(o_orderkey) AS BIGINT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey GROUP BY r_name""")
def path_repair_region_orders(spark, sf_dir):
    spec = QuerySpec((("r", "region"), ("o", "orders")), ((C("r", "r_name"), "r_name"), (Agg("COUNT", C("o", "o_orderkey")), "n")), (Join("o", ((C("r", "r_regionkey"), C("o", "o_custkey")),)),), group_by=(C("r", "r_name"),))
    engine = open_tables(spark, sf_dir)
    sub = Engine(spark, engine.frames, engine.catalog.subset(["region", "nation", "customer", "orders"]))
    return fixed(sub, spec)


@query("""SELECT n_name, ROUND(SUM(o_totalprice), 2) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def missing_join_nation_revenue(spark, sf_dir):
    spec = QuerySpec((("nation", "nation"),), ((C("nation", "n_name"), "n_name"), (Agg("SUM", C("orders", "o_totalprice")), "total")), group_by=(C("nation", "n_name"),))
    engine = open_tables(spark, sf_dir)
    sub = Engine(spark, engine.frames, engine.catalog.subset(engine.catalog.bridge(["nation", "customer", "orders"])))
    return fixed(sub, spec).withColumn("total", F.round("total", 2))


@query("SELECT c_mktsegment, CAST(COUNT(o_orderkey) AS BIGINT) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def connectivity_repair(spark, sf_dir):
    spec = QuerySpec((("c", "customer"), ("o", "orders")), ((C("c", "c_mktsegment"), "c_mktsegment"), (Agg("COUNT", C("o", "o_orderkey")), "n")), (Join("o", how="cross"),), group_by=(C("c", "c_mktsegment"),))
    return fixed(open_tables(spark, sf_dir), spec)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def alias_repair(spark, sf_dir):
    spec = QuerySpec((("customer", "customer"),), ((C("cu", "c_custkey"), "c_custkey"), (C("cu", "c_acctbal"), "c_acctbal")), where=(Bin(">", C("cu", "c_acctbal"), Lit(0)),))
    return fixed(open_tables(spark, sf_dir), spec)


@query("SELECT c_name, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def relocate_column(spark, sf_dir):
    spec = QuerySpec((("c", "customer"), ("o", "orders")), ((C("o", "c_name"), "c_name"), (C("c", "o_totalprice"), "o_totalprice")), (CUSTOMER_ORDERS,), where=(Bin(">", C("c", "o_totalprice"), Lit(400000)),))
    return fixed(open_tables(spark, sf_dir), spec)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def normalize_qualifiers(spark, sf_dir):
    spec = QuerySpec((("n", "nation"), ("r", "region")), ((C("nation", "n_name"), "n_name"), (C("region", "r_name"), "r_name")), (Join("r", ((C("nation", "n_regionkey"), C("r", "r_regionkey")),)),))
    return fixed(open_tables(spark, sf_dir), spec)


@query("SELECT s_suppkey, s_name, n_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE r_name IS NOT NULL")
def self_named_path(spark, sf_dir):
    """R3 from a present table through a bridge, keyed by alias."""
    spec = QuerySpec((("s", "supplier"), ("n", "nation")), ((C("s", "s_suppkey"), "s_suppkey"), (C("s", "s_name"), "s_name"), (C("n", "n_name"), "n_name")), (Join("n", ((C("s", "s_nationkey"), C("n", "n_nationkey")),)),), where=(Bin("IS NOT", C("region", "r_name"), Lit(None)),))
    return fixed(open_tables(spark, sf_dir), spec)


# --- ranking, grain, metric


@query("""SELECT c_custkey, n FROM (SELECT c_custkey, CAST(COUNT(*) AS BIGINT) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey) WHERE r <= 5""")
def topn_ties_by_count(spark, sf_dir):
    spec = QuerySpec((("c", "customer"), ("o", "orders")), ((C("c", "c_custkey"), "c_custkey"), (Agg("COUNT", Star()), "n")), (CUSTOMER_ORDERS,), group_by=(C("c", "c_custkey"),), order_by=((C(None, "n"), True),), limit=5)
    return fixed(open_tables(spark, sf_dir), spec)


@query("""SELECT side, p_size, n FROM (SELECT 'high' AS side, p_size, n, RANK() OVER (ORDER BY n DESC) AS r FROM (SELECT p_size, CAST(COUNT(*) AS BIGINT) AS n FROM part GROUP BY p_size)
UNION ALL SELECT 'low', p_size, n, RANK() OVER (ORDER BY n) FROM (SELECT p_size, CAST(COUNT(*) AS BIGINT) AS n FROM part GROUP BY p_size)) WHERE r <= 3""")
def topn_ties_desc_asc(spark, sf_dir):
    counts = open_tables(spark, sf_dir).frame("part").groupBy("p_size").agg(F.count("*").alias("n"))
    return topn.top_with_ties(counts, "n", 3).select(F.lit("high").alias("side"), "p_size", "n").unionByName(topn.top_with_ties(counts, "n", 3, desc=False).select(F.lit("low").alias("side"), "p_size", "n"))


@query("SELECT c_custkey, CAST(COUNT(o_orderkey) AS BIGINT) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def count_grain_orders_per_customer(spark, sf_dir):
    spec = QuerySpec(
        (("c", "customer"), ("o", "orders"), ("l", "lineitem")), ((C("c", "c_custkey"), "c_custkey"), (Agg("COUNT", C("l", "l_linenumber")), "n")),
        (CUSTOMER_ORDERS, ORDERS_LINES), group_by=(C("c", "c_custkey"),),
    )
    return fixed(open_tables(spark, sf_dir), spec, "How many orders per customer?", Intent(entity="customer", metric="COUNT"))


@query("SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def soft_order_listing(spark, sf_dir):
    spec = QuerySpec((("c", "customer"),), ((C("c", "c_mktsegment"), "c_mktsegment"), (Agg("SUM", C("c", "c_acctbal")), "total")), group_by=(C("c", "c_mktsegment"),))
    return fixed(open_tables(spark, sf_dir), spec, plan=Intent(metric="SUM", soft=True, direction="DESC")).withColumn("total", F.round("total", 2))


@query("SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def grouping_intent(spark, sf_dir):
    """V4: the ungrouped query is refused, the planner's next one runs."""
    bare = QuerySpec((("o", "orders"),), ((Agg("SUM", C("o", "o_totalprice")), "total"),))
    good = replace(bare, select=((C("o", "o_orderstatus"), "o_orderstatus"), *bare.select), group_by=(C("o", "o_orderstatus"),))
    return _second(open_tables(spark, sf_dir), "Total order value per status", bare, good, Failure.GROUPING).withColumn("total", F.round("total", 2))


@query("SELECT ROUND(AVG(p_retailprice), 6) AS mean FROM part")
def avg_part_price_grain(spark, sf_dir):
    """V7, V5: a mean over parts isn't weighted by their lines."""
    spec = QuerySpec((("p", "part"), ("l", "lineitem")), ((Agg("AVG", C("p", "p_retailprice")), "mean"),), (Join("l", ((C("p", "p_partkey"), C("l", "l_partkey")),)),))
    return fixed(open_tables(spark, sf_dir), spec, "What is the average price of a part?", Intent(entity="part", metric="AVG")).withColumn("mean", F.round("mean", 6))


@query("SELECT MAX(p_retailprice) AS price FROM part")
def max_price_extreme(spark, sf_dir):
    return fixed(open_tables(spark, sf_dir), QuerySpec((("p", "part"),), ((Agg("MAX", C("p", "p_retailprice")), "price"),)), "What is the most expensive part's price?")


@query("SELECT MIN(p_retailprice) AS price FROM part")
def min_price_extreme(spark, sf_dir):
    return fixed(open_tables(spark, sf_dir), QuerySpec((("p", "part"),), ((Agg("MIN", C("p", "p_retailprice")), "price"),)), "What is the price of the cheapest part?")


@query("SELECT ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem")
def metric_swap(spark, sf_dir):
    spec = QuerySpec((("l", "lineitem"),), ((Agg("SUM", C("l", "l_tax")), "total"),))
    return fixed(open_tables(spark, sf_dir), spec, plan=Intent(metric="SUM", column="l_extendedprice")).withColumn("total", F.round("total", 2))


@query("SELECT c_custkey, c_name || ' ' || c_mktsegment AS label FROM customer")
def concat_repair(spark, sf_dir):
    spec = QuerySpec((("c", "customer"),), ((C("c", "c_custkey"), "c_custkey"), (Bin("+", Bin("+", C("c", "c_name"), Lit(" ")), C("c", "c_mktsegment")), "label")))
    return fixed(open_tables(spark, sf_dir), spec)


@query("""SELECT n_name, n FROM (SELECT n_nationkey, n_name, CAST(COUNT(c_custkey) AS BIGINT) AS n, RANK() OVER (ORDER BY COUNT(c_custkey) DESC) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey
GROUP BY n_nationkey, n_name) WHERE r <= 3""")
def lexicon_question(spark, sf_dir):
    """A question planned by vocabulary alone, run through the whole loop."""
    engine, question = open_tables(spark, sf_dir), "Which top 3 nations have the most customers?"
    plan, spec = LexiconPlanner().plan(question, engine.catalog)
    out = Agent(engine).checked(question, plan, replace(spec, relations=spec.relations)).frame(engine)
    return out.select("n_name", F.col(out.columns[-1]).cast("long").alias("n"))


# --- questions


@query("SELECT s_suppkey, s_name FROM supplier")
def question_list_suppliers(spark, sf_dir):
    return _asked(spark, sf_dir, "List all suppliers")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def question_customers_without_orders(spark, sf_dir):
    return _asked(spark, sf_dir, "Which customers placed no orders?")


@query("SELECT ROUND(SUM(o_totalprice), 2) AS sum_o_totalprice FROM orders")
def question_total_revenue(spark, sf_dir):
    return _asked(spark, sf_dir, "What is the total revenue?").withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("""SELECT p_partkey, p_name, ROUND(q, 2) AS sum_l_quantity FROM (SELECT p_partkey, p_name, SUM(l_quantity) AS q, RANK() OVER (ORDER BY SUM(l_quantity) DESC) AS r
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name) WHERE r <= 3""")
def question_top_parts_by_quantity(spark, sf_dir):
    return _asked(spark, sf_dir, "Top 3 parts by quantity sold").withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@query("SELECT n_nationkey, n_name, COUNT(s_suppkey) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def question_suppliers_per_nation(spark, sf_dir):
    out = _asked(spark, sf_dir, "How many suppliers are there per nation?")
    return out.toDF(*out.columns[:-1], "n")


# --- queries that the loop refuses at first


@query("SELECT s_suppkey, s_name FROM supplier")
def loop_unsolicited_limit(spark, sf_dir):
    """V8"""
    good = QuerySpec((("s", "supplier"),), ((C("s", "s_suppkey"), "s_suppkey"), (C("s", "s_name"), "s_name")))
    return _second(open_tables(spark, sf_dir), "List the suppliers", replace(good, limit=20), good, Failure.SCOPE_DRIFT)


@query("SELECT ROUND(AVG(s_acctbal), 4) AS x FROM supplier")
def loop_wrong_metric(spark, sf_dir):
    """V9"""
    spec = lambda fn: QuerySpec((("s", "supplier"),), ((Agg(fn, C("s", "s_acctbal")), "x"),))
    plan = Intent(metric="AVG", entity="supplier")
    return _second(open_tables(spark, sf_dir), "What is the average balance of a supplier?", (plan, spec("SUM")), (plan, spec("AVG")), Failure.METRIC).withColumn("x", F.round("x", 4))


@query("SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def loop_stored_total_with_lines(spark, sf_dir):
    """V6: a stored total of the order times a discount of its lines is refused."""
    spec = lambda e: QuerySpec((("l", "lineitem"), ("o", "orders")), ((Agg("SUM", e), "revenue"),), (Join("o", ((C("l", "l_orderkey"), C("o", "o_orderkey")),)),))
    less = Bin("-", Lit(1), C("l", "l_discount"))
    bad, good = spec(Bin("*", C("o", "o_totalprice"), less)), spec(Bin("*", C("l", "l_extendedprice"), less))
    return _second(open_tables(spark, sf_dir), "What is the revenue after discounts?", bad, good, Failure.SEMANTIC).withColumn("revenue", F.round("revenue", 2))


# --- relational operators

@query("SELECT c_custkey, COUNT(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING COUNT(o_orderkey) > 12")
def having_busy_customers(spark, sf_dir):
    spec = QuerySpec((("c", "customer"), ("o", "orders")), ((C("c", "c_custkey"), "c_custkey"), (Agg("COUNT", C("o", "o_orderkey")), "n")), (CUSTOMER_ORDERS,), group_by=(C("c", "c_custkey"),), having=(Bin(">", Agg("COUNT", C("o", "o_orderkey")), Lit(12)),))
    return fixed(open_tables(spark, sf_dir), spec)


@query("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_order_counts(spark, sf_dir):
    spec = QuerySpec((("c", "customer"), ("o", "orders")), ((C("c", "c_custkey"), "c_custkey"), (Agg("COUNT", C("o", "o_orderkey")), "n")), (replace(CUSTOMER_ORDERS, how="left"),), group_by=(C("c", "c_custkey"),))
    return fixed(open_tables(spark, sf_dir), spec)


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 20")
def sql_full_join(spark, sf_dir):
    return open_tables(spark, sf_dir).sql("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 20")


_SELF_JOIN = "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"


@query(_SELF_JOIN)
def sql_self_join(spark, sf_dir):
    return open_tables(spark, sf_dir).sql(_SELF_JOIN)


_ABOVE_MEAN = "WITH t AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, ROUND(total, 2) AS total FROM t WHERE total > (SELECT AVG(total) FROM t)"


@query(_ABOVE_MEAN)
def sql_cte_scalar_subquery(spark, sf_dir):
    return open_tables(spark, sf_dir).sql(_ABOVE_MEAN)


_SETS = "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION SELECT r_regionkey FROM region"


@query(f"SELECT CAST(k AS BIGINT) AS k FROM ({_SETS})")
def sql_union_intersect(spark, sf_dir):
    return open_tables(spark, sf_dir).sql(f"SELECT CAST(k AS BIGINT) AS k FROM ({_SETS})")


_ROLLUP = "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"


@query(_ROLLUP)
def sql_rollup(spark, sf_dir):
    return open_tables(spark, sf_dir).sql(_ROLLUP)


@query("SELECT 500 AS row_count, TRUE AS truncated, MIN(l_orderkey) AS least, MAX(l_orderkey) AS most FROM (SELECT l_orderkey FROM lineitem ORDER BY l_orderkey LIMIT 500)")
def run_query_truncated(spark, sf_dir):
    """501 rows are read, 500 given."""
    got = open_tables(spark, sf_dir).run_query("SELECT l_orderkey FROM lineitem ORDER BY l_orderkey")
    rows = [r[0] for r in got["rows"]]
    return spark.createDataFrame([(got["row_count"], got["truncated"], min(rows), max(rows))], "row_count int, truncated boolean, least long, most long")


# --- profile, graph

_NUMERIC = {
    "customer": ("c_custkey", "c_nationkey", "c_acctbal"), "nation": ("n_nationkey", "n_regionkey"), "part": ("p_partkey", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_totalprice"), "supplier": ("s_suppkey", "s_nationkey", "s_acctbal"), "region": ("r_regionkey",),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "events": ("event_id", "user_id", "value"), "documents": ("doc_id", "n_chars"), "labels": ("doc_id", "quality", "toxic"), "embeddings": ("vec_id", "label"),
}
_KEYS = {"c_custkey", "n_nationkey", "p_partkey", "o_orderkey", "s_suppkey", "r_regionkey", "event_id", "doc_id", "vec_id"}
_STATS = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", COUNT(*) AS n, CAST(MIN({c}) AS DOUBLE) AS lo, CAST(MAX({c}) AS DOUBLE) AS hi, ROUND(AVG({c}), 6) AS mean, COUNT(DISTINCT {c}) AS ndistinct, {str(c in _KEYS).upper()} AS k FROM {t}"
    for t, cs in _NUMERIC.items() for c in cs
)


def _profiles(spark, sf_dir) -> DataFrame:
    engine = open_tables(spark, sf_dir)
    out = None
    for t in _NUMERIC:
        p = profile.profile_columns(engine, t)
        out = p if out is None else out.unionByName(p)
    return out


@query(f'SELECT "table", "column", n, lo, hi, mean, ndistinct FROM ({_STATS})')
def profile_numeric_columns(spark, sf_dir):
    return _profiles(spark, sf_dir).select("table", "column", "n", F.col("min").alias("lo"), F.col("max").alias("hi"), F.round("avg", 6).alias("mean"), "ndistinct")


@query(f"""SELECT "table", "column", CASE WHEN k OR (ndistinct >= GREATEST(1, FLOOR(n * 0.95)) AND ABS(lo) <= 1 AND hi <= GREATEST(n * 1.5, 10)) THEN 'identifier' ELSE 'measure' END AS role
FROM ({_STATS})""")
def profile_identifiers(spark, sf_dir):
    return _profiles(spark, sf_dir).select("table", "column", "role")


_EDGES = [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("labels", "doc_id", "documents")]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS child, '{k}' AS columns, '{p}' AS parent, ROUND((SELECT COUNT(*) FROM {c}) / CAST((SELECT COUNT(*) FROM {p}) AS DOUBLE), 3) AS ratio, (SELECT COUNT(*) FROM {c}) / CAST((SELECT COUNT(*) FROM {p}) AS DOUBLE) >= 1.5 AS confirmed"
    for c, k, p in _EDGES
))
def edge_multiplicity(spark, sf_dir):
    return profile.edge_multiplicity(open_tables(spark, sf_dir))


@query("SELECT (SELECT COUNT(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS childless, (SELECT COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans")
def edge_childless(spark, sf_dir):
    return profile.childless(open_tables(spark, sf_dir), "lineitem", "orders")


@query("""SELECT * FROM (VALUES ('region', 'dimension', 0), ('nation', 'event_root', 1), ('customer', 'event_root', 2), ('supplier', 'event_root', 2), ('part', 'dimension', 0), ('orders', 'event_root', 3),
('lineitem', 'detail', 4), ('events', 'standalone', 0), ('documents', 'dimension', 0), ('labels', 'detail', 1), ('embeddings', 'standalone', 0)) AS t(name, role, depth)""")
def grain_roles(spark, sf_dir):
    grains = classify_grains(open_tables(spark, sf_dir).catalog)
    return spark.createDataFrame([(t, g.role, g.depth) for t, g in grains.items()], "name string, role string, depth int")


@query("""SELECT * FROM (VALUES ('region', 'orders', 'region-nation-customer-orders'), ('nation', 'lineitem', 'nation-supplier-lineitem'), ('part', 'orders', 'part-lineitem-orders'),
('customer', 'supplier', 'customer-nation-supplier')) AS t(a, b, path)""")
def fk_paths(spark, sf_dir):
    catalog = open_tables(spark, sf_dir).catalog
    pairs = [("region", "orders"), ("nation", "lineitem"), ("part", "orders"), ("customer", "supplier")]
    return spark.createDataFrame([(a, b, "-".join(catalog.path(a, b))) for a, b in pairs], "a string, b string, path string")


@query("""SELECT * FROM (VALUES ('How many orders did each customer place?', 'orders'), ('How many lineitems per order?', 'lineitem'), ('How many nations are there?', 'nation'), ('How many purchases were made per customer?', 'orders'))
AS t(question, grain)""")
def question_grains(spark, sf_dir):
    catalog = open_tables(spark, sf_dir).catalog
    asked = ["How many orders did each customer place?", "How many lineitems per order?", "How many nations are there?", "How many purchases were made per customer?"]
    return spark.createDataFrame([(q, question_grain(q, catalog)) for q in asked], "question string, grain string")


# --- measures, diff, gate


@query("""WITH l AS (SELECT l_orderkey, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY l_orderkey)
SELECT COUNT(*) AS parents, COUNT(v) AS with_lines, CAST(SUM(CASE WHEN ABS(v - o_totalprice) > 0.005 * ABS(o_totalprice) THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def measure_equivalence_per_key(spark, sf_dir):
    expr = Bin("*", Bin("*", C(None, "l_extendedprice"), Bin("-", Lit(1), C(None, "l_discount"))), Bin("+", Lit(1), C(None, "l_tax")))
    return measures.per_key(open_tables(spark, sf_dir), "lineitem", expr, "orders", "o_totalprice")


@query("SELECT * FROM (VALUES ('same', 'RENDER_ONLY'), ('alias', 'SYNTAX_ONLY'), ('limit', 'LIMIT_CHANGED,ORDER_CHANGED'), ('join', 'JOIN_DROPPED'), ('sum', 'AGGREGATE_CHANGE'), ('group', 'GROUPING_CHANGED'), ('filter', 'FILTER_CHANGED')) AS t(name, tags)")
def semantic_diff_tags(spark, sf_dir):
    a = QuerySpec((("o", "orders"), ("l", "lineitem")), ((Agg("SUM", C("o", "o_totalprice")), "t"),), (ORDERS_LINES,))
    b = QuerySpec((("x", "orders"), ("l", "lineitem")), ((Agg("SUM", C("x", "o_totalprice")), "t"),), (Join("l", ((C("x", "o_orderkey"), C("l", "l_orderkey")),)),))
    pairs = [
        ("same", a), ("alias", b), ("limit", replace(a, limit=3, order_by=((C(None, "t"), True),))), ("join", replace(a, relations=a.relations[:1], joins=())),
        ("sum", replace(a, select=((Agg("AVG", C("o", "o_totalprice")), "t"),))), ("group", replace(a, group_by=(C("o", "o_custkey"),))), ("filter", replace(a, where=(Bin(">", C("o", "o_totalprice"), Lit(1)),))),
    ]
    return spark.createDataFrame([(n, ",".join(semantic_diff(a, x))) for n, x in pairs], "name string, tags string")


_GATE = {
    "select": "SELECT 1 AS a", "with": "WITH t AS (SELECT n_name FROM nation) SELECT * FROM t", "union": "SELECT n_name FROM nation UNION SELECT r_name FROM region",
    "drop": "DROP TABLE nation", "insert": "INSERT INTO nation SELECT * FROM nation", "two": "SELECT 1; SELECT 2", "file": "SELECT * FROM parquet.`/etc`", "java": "SELECT java_method('java.lang.System', 'exit', 1)", "set": "SET a = b",
}


@query("SELECT * FROM (VALUES ('select', TRUE), ('with', TRUE), ('union', TRUE), ('drop', FALSE), ('insert', FALSE), ('two', FALSE), ('file', FALSE), ('java', FALSE), ('set', FALSE)) AS t(name, allowed)")
def readonly_gate(spark, sf_dir):
    catalog, rows = open_tables(spark, sf_dir).catalog, []
    for name, text in _GATE.items():
        try:
            check_read_only(spark, text, catalog)
            rows.append((name, True))
        except ValidationError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, allowed boolean")


@query("SELECT COUNT(*) || ' rows' AS head, CAST(23 AS BIGINT) AS lines, '... and ' || (COUNT(*) - 20) || ' more' AS tail FROM customer")
def preview_of_listing(spark, sf_dir):
    df = open_tables(spark, sf_dir).frame("customer").select("c_custkey", "c_name").orderBy("c_custkey")
    text = preview(df.columns, [list(r) for r in df.limit(20).collect()], df.count()).split("\n")
    return spark.createDataFrame([(text[0], len(text), text[-1])], "head string, lines long, tail string")


# --- search, language, scoring, windows

_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COSINE = f"""SELECT vec_id, 1 - list_sum(list_transform(list_zip(embedding, q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))
/ SQRT(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS d
FROM (SELECT vec_id, embedding, {_QUERY_VECTOR} AS q FROM embeddings)"""


def _probe(engine: Engine) -> list[float]:
    return list(engine.frame("embeddings").where("vec_id = 0").first()["embedding"])


@query(f"SELECT vec_id, ROUND(d, 6) AS distance FROM ({_COSINE}) ORDER BY d, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    engine = open_tables(spark, sf_dir)
    return vector.search(engine.frame("embeddings"), _probe(engine), "vec_id", "embedding", 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, ROUND(d, 6) AS distance FROM ({_COSINE}) WHERE d <= 0.7")
def cosine_threshold(spark, sf_dir):
    engine = open_tables(spark, sf_dir)
    return vector.search(engine.frame("embeddings"), _probe(engine), "vec_id", "embedding", None, 0.7).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT label, CAST(COUNT(*) AS BIGINT) AS n FROM embeddings WHERE vec_id IN (SELECT vec_id FROM ({_COSINE}) ORDER BY d, vec_id LIMIT 50) GROUP BY label")
def hybrid_semantic_aggregate(spark, sf_dir):
    engine = open_tables(spark, sf_dir)
    found = vector.search(engine.frame("embeddings"), _probe(engine), "vec_id", "embedding", 50)
    return vector.narrowed(engine.frame("embeddings"), found, "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query()
def tfidf_topk(spark, sf_dir):
    parts = open_tables(spark, sf_dir).frame("part")
    words = parts.select(F.concat_ws(" ", "p_name", "p_type").alias("label"), "p_partkey")
    probe = words.where("p_partkey = 1").first()
    return vector.TfIdf(words, "label").search(words, probe["label"] if probe else "", "p_partkey", 10)


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '([0-9]+(?:[.][0-9]+)?)', 1)) AS BIGINT) AS n, COALESCE(array_to_string(regexp_extract_all(text, '([0-9]+(?:[.][0-9]+)?)', 1), ' '), '') AS found FROM documents""")
def figure_extraction(spark, sf_dir):
    docs = open_tables(spark, sf_dir).frame("documents")
    return docs.select("doc_id", figure_column(F.col("text")).alias("f")).select("doc_id", F.size("f").cast("long").alias("n"), F.array_join("f", " ").alias("found"))


@query()
def stated_figures(spark, sf_dir):
    docs = open_tables(spark, sf_dir).frame("documents")
    return docs.select("doc_id", stated_column(F.col("text")).alias("f")).select("doc_id", F.size("f").cast("long").alias("n"), F.array_join("f", " ").alias("found"))


@query()
def language_of_documents(spark, sf_dir):
    docs = open_tables(spark, sf_dir).frame("documents")
    return docs.groupBy("lang", language_column(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS "case", ABS(v - g) <= GREATEST(ABS(g) * 0.005, 0.005) AS ok FROM (SELECT n_nationkey, COALESCE((SELECT SUM(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey), 0) AS g,
COALESCE((SELECT SUM(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > -990), 0) AS v FROM nation) WHERE g <> 0""")
def bench_scores(spark, sf_dir):
    customers = open_tables(spark, sf_dir).frame("customer")
    by = customers.groupBy(F.col("c_nationkey").alias("case"))
    gold = by.agg(F.sum("c_acctbal").alias("gold")).where("gold <> 0")
    return scoring.score_table(by.agg(F.sum(F.when(F.col("c_acctbal") > -990, F.col("c_acctbal")).otherwise(0.0)).alias("value")), gold)


@query("SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    out = tumbling(open_tables(spark, sf_dir).frame("events"))
    return out.select(F.to_date("start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)""")
def cube_orders(spark, sf_dir):
    engine = open_tables(spark, sf_dir)
    both = engine.frame("orders").join(engine.frame("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.cube("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_name FROM nation EXCEPT SELECT r_name FROM region")
def sql_passthrough(spark, sf_dir):
    """Statements that are no single SELECT pass the gate and go to Catalyst as they are."""
    return open_tables(spark, sf_dir).sql("SELECT n_name FROM nation EXCEPT SELECT r_name FROM region")


@query("""SELECT CAST(CAST(w AS DATE) AS VARCHAR) AS day, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM
(SELECT date_trunc('day', ts) AS w, event_type, value FROM events UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY, event_type, value FROM events) GROUP BY 1, 2""")
def events_sliding(spark, sf_dir):
    out = sliding(open_tables(spark, sf_dir).frame("events"))
    return out.select(F.to_date("start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT user_id, ts, value, SUM(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM s GROUP BY user_id, run""")
def events_sessions(spark, sf_dir):
    out = sessions(open_tables(spark, sf_dir).frame("events"))
    run = F.row_number().over(Window.partitionBy("user_id").orderBy("start"))
    return out.select("user_id", run.cast("long").alias("run"), "n", F.round("total", 4).alias("total"))


@query("""SELECT t.name AS "table", c.name AS column_name FROM (VALUES ('nation'), ('orders')) AS t(name) JOIN
(SELECT table_name, column_name AS name FROM information_schema.columns) c ON c.table_name = t.name""")
def describe_tables(spark, sf_dir):
    """C3"""
    catalog = open_tables(spark, sf_dir).catalog
    return spark.createDataFrame([(t, c["name"]) for t in ("nation", "orders") for c in catalog.describe(t)], "table string, column_name string")
