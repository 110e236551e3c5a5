"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power of one exponent, normalised. The exponent is
bisected in [0, 1] to meet a target entropy (as a share of the largest, log of the number of
sources) and then raised, where that is given, until every source keeps within a repetition limit. Each source's budget is then spent in passes: whole passes over its documents
and a last one that stops at its budget. In each pass the source's hash blocks come in an order
of their own; only the block in which a budget ends is cut, document by document.

Tokens are words (runs without ASCII white space). Nulls: a null source is a source of its own,
a null text has no token. Documents of a source without any token cost nothing and are taken
once. Repeated rows are rows of their own. An empty table gives no rows. Columns of the input
are kept whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Tokens of a block, on average; blocks of a cell; sources that the driver's plan may hold.
BLOCK_TOKENS, CELL, MAX_SOURCES = 20_000, 1_024, 1_000_000
#: Sources up to which their plan (some 100 bytes each) is broadcast.
FEW_SOURCES = 50_000


@dataclass(frozen=True)
class Share:
    source: str | None
    tokens: int
    weight: float
    budget: float
    passes: int
    rest: float
    blocks: int


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[int], exponent: float) -> list[float]:
    """Normalised shares to the power of the exponent; no tokens, no weight."""
    top = max(tokens, default=0)
    raw = [(t / top) ** exponent if t else 0.0 for t in tokens]
    total = sum(raw)
    return [x / total for x in raw] if total else raw


def bisected(tokens: list[int], target: float, budget: float | None, limit: float | None, steps: int = 60) -> float:
    """The exponent: entropy falls as it grows, and so does the most repeated source's number of passes.

    The target entropy is met where it lies between those of exponents 1 and 0, else the nearer end is
    taken; then the exponent is raised, if need be, until no source exceeds ``limit`` passes of ``budget``
    (of as many tokens as give the least repeated source one pass, where ``budget`` is None).
    """
    own = [t for t in tokens if t]
    if len(own) < 2:
        return 1.0

    def root(ok) -> float:
        """The smallest exponent for which ``ok`` holds; 1 if none does."""
        if ok(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    found = root(lambda a: entropy(tempered(own, a)) <= target * math.log(len(own)))
    if limit is not None:
        def fits(a: float) -> bool:
            w = tempered(own, a)
            most = max(x / t for x, t in zip(w, own, strict=True))
            return most * (budget if budget is not None else 1 / min(x / t for x, t in zip(w, own, strict=True))) <= limit * (1 + 1e-12)

        found = max(found, root(fits))
    return found


def plan(counts: list[tuple[str | None, int]], target: float, budget: float | None, limit: float | None) -> list[Share]:
    """Each source's share, from its tokens. ``budget`` None: as many tokens as give every source one pass at least."""
    tokens = [n for _, n in counts]
    weights = tempered(tokens, bisected(tokens, target, budget, limit))
    if budget is None:
        budget = max((n / w for n, w in zip(tokens, weights, strict=True) if w), default=0.0)
    out = []
    for (source, n), w in zip(counts, weights, strict=True):
        own = w * budget
        times = own / n if n else 1.0
        whole = abs(times - round(times)) < 1e-9
        passes = round(times) if whole else int(times)
        out.append(Share(source, n, w, own, passes, 0.0 if whole else own - passes * n, max(1, -(-n // BLOCK_TOKENS))))
    return out


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _place(number: Column, seed: int) -> Column:
    """A block's place in a pass: its hash as a share of the pass, so that no ranking of all blocks is needed."""
    return F.pmod(F.xxhash64("block", number, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def mix(
    df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", target: float = 0.95, budget: float | None = None,
    limit: float | None = 4.0, seed: int = 0, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``row`` (a struct of ``keep``, by default all columns) with tokens, weight, pass, block, mix_at and slot.

    Rows come once for each pass that takes them. Reading in the order of (mix_at, source, slot) gives the
    mixture: mix_at runs from 0 to about 1 in every source, by blocks in their permuted order.
    """
    spark = df.sparkSession
    kept = df.columns if keep is None else list(keep)
    base = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(source).alias("src"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(text).alias("t"))
    slim = written(base.select("src", "h", words(F.col("t")).alias("tokens")), "tokens")
    counts = [(r["src"], r["n"]) for r in slim.groupBy("src").agg(F.sum("tokens").alias("n")).sort(F.col("src").asc_nulls_first()).limit(MAX_SOURCES + 1).collect()]
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    kind = df.schema[source].dataType.simpleString()
    found = [
        (s.source, s.weight, s.passes, s.rest, s.blocks, s.budget / s.tokens if s.tokens else 1.0) for s in plan(counts, target, budget, limit)
    ]
    schema = f"psrc {kind}, weight double, passes int, rest double, blocks long, times double"
    shares = spark.createDataFrame(found, schema)
    cuts = {r["csrc"]: r["cut"] for r in _cuts(slim, F.broadcast(shares) if len(found) <= FEW_SOURCES else shares, seed).collect()}  # one row a source
    forget(spark, slim)
    sources = spark.createDataFrame([(*x, cuts.get(x[0])) for x in found], schema + ", cut struct<place:double,block:long,left:double>")
    if len(found) <= FEW_SOURCES:  # else a join by source, whose skew Spark splits
        sources = F.broadcast(sources)
    rows = base.join(sources, F.col("src").eqNullSafe(F.col("psrc"))).drop("psrc").withColumn("block", F.pmod("h", "blocks")).withColumn("last", _place(F.col("passes"), seed))
    whole = (F.col("rest") > 0) & (F.col("cut").isNull() | (F.struct("last", "block") < F.struct("cut.place", "cut.block")))
    taken = rows.withColumn("whole", whole).where((F.col("passes") > 0) | F.col("whole")).withColumn("tokens", words(F.col("t"))).withColumn(
        "pass", F.explode(F.sequence(F.lit(0), F.col("passes") - F.when(F.col("whole"), 0).otherwise(1)))
    )
    # the one block of each source in which its budget ends, document by document; words are counted in those blocks alone
    upto = Window.partitionBy("src", "block").orderBy("h", "tokens", F.xxhash64("row"))
    cut = rows.where("rest > 0 and block = cut.block").withColumn("tokens", words(F.col("t"))).withColumn("upto", F.sum("tokens").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.where("upto <= cut.left").withColumn("pass", F.col("passes"))
    columns = ["row", "tokens", "weight", "pass", "block", "blocks", "times", "h", "src"]
    out = taken.select(*columns).unionByName(cut.select(*columns))
    return out.select("row", "tokens", "weight", "pass", "block", ((F.col("pass") + _place(F.col("pass"), seed)) / F.greatest("times", F.lit(1e-12))).alias("mix_at"), F.xxhash64("h", "pass").alias("slot"))


def _cuts(slim: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """(csrc, cut): where in its last pass a source's rest ends, the place and number of that block and the tokens left for it.

    Tokens before a block are summed at two levels, by cells of about ``CELL`` blocks and within a cell, so
    that no task sees all blocks of a source; a cell or block is aggregated before any exchange.
    """
    rows = slim.join(shares, F.col("src").eqNullSafe(F.col("psrc"))).where("rest > 0").withColumn("block", F.pmod("h", "blocks"))
    blocks = rows.groupBy("src", "block").agg(F.sum("tokens").alias("bt"), F.first("rest").alias("r"), F.first("passes").alias("passes"), F.first("blocks").alias("blocks"))
    blocks = blocks.withColumn("place", _place(F.col("passes"), seed)).withColumn("cell", F.floor(F.col("place") * F.ceil(F.col("blocks") / CELL)))
    cells = blocks.groupBy("src", "cell").agg(F.sum("bt").alias("ct"))
    before = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("src").alias("cell_src"), F.col("cell").alias("cell_no"), F.coalesce(F.sum("ct").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("src", "cell").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("own", F.coalesce(F.sum("bt").over(within), F.lit(0)))
    blocks = blocks.join(cells, F.col("src").eqNullSafe(F.col("cell_src")) & (F.col("cell") == F.col("cell_no"))).withColumn("left", F.col("r") - F.col("ahead") - F.col("own"))
    return blocks.where("bt > left").groupBy(F.col("src").alias("csrc")).agg(F.min(F.struct("place", "block", F.col("left").cast("double"))).alias("cut"))
