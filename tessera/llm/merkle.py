"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in DataFrame functions only.

A paragraph is a line; its node hashes the whole paragraph (128 bits of SHA-256), its leaves hash
pieces of it (32 bits). Pieces are cut by content, by one rule at every length: after ``LEAST`` code
points a piece ends behind the first mark or common word ending that a space follows, after ``MOST`` in
any case, so that an insertion changes the pieces around it and no others. A section ends after a
blank paragraph and where a paragraph's hash says so (one in eight), so that an edit moves no other
section. A section's node hashes its paragraphs (128 bits), the root hashes the sections (256 bits).

Written form: ``root|section:paragraph.leaf.leaf,paragraph.leaf,;section:...``. Equal texts have
equal fingerprints, roots test equality, differing nodes locate edits, and likeness is the
Dice similarity of the distinct leaves (shared ones over the mean number).

Nulls: a null text is empty; an empty text has a root and no leaf (likeness 1 to another empty
one, else 0). A null id sorts first (it takes the place of the smallest 64-bit id). Rows that repeat an id are fingerprinted one by one; all
of them precede the next id, of which the row with the smallest text head counts. The id has to be
an integer; an empty table gives no rows; long texts are whole; further columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, whole_key, written

LEAST, MOST, LEAF_HEX, NODE_HEX, SECTION = 16, 64, 8, 32, 8
#: A piece: up to a mark or common last letter before a space, or as long as may be.
PIECE = f"(?s).{{{LEAST},{MOST - 2}}}?[.,;:!?esnt][ ]|.{{1,{MOST}}}"
_FIRST = -(1 << 63)


def _node(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(NODE_HEX))


def _leaves(p: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.concat(F.lit("."), F.substring(F.hex(F.xxhash64(x)), -LEAF_HEX, LEAF_HEX))), "")


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` in column ``to``; columns of steps get names that ``df`` has not."""
    ends = lambda q: (~F.contains(q, F.lit("."))) | (F.pmod(F.xxhash64(q), F.lit(SECTION)) == 0)
    p, b, s = (fresh(x, [*df.columns, to]) for x in ("paragraphs", "body", "sections"))
    return (
        df.withColumn(p, F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.concat(_node(x), _leaves(x))))
        .withColumn(b, F.array_join(F.transform(p, lambda q: F.concat(q, F.when(ends(q), ";").otherwise(","))), ""))
        .withColumn(s, F.array_join(F.transform(F.split(b, ";", -1), lambda x: F.concat(_node(x), F.lit(":"), x)), ";"))
        .withColumn(to, F.concat(F.sha2(F.regexp_replace(s, ":[^;]*", ""), 256), F.lit("|"), F.col(s)))
        .drop(p, b, s)
    )


def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, "|", 1)


def likeness(a: Column, b: Column) -> Column:
    """Dice similarity of two fingerprints' distinct leaves; 1 where the roots are equal."""
    leaves = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("[.]([0-9A-F]+)"), F.lit(1)))
    pair = F.struct(leaves(a).alias("a"), leaves(b).alias("b"))
    found = F.transform(F.array(pair), lambda p: F.struct(F.size(F.array_intersect(p["a"], p["b"])).alias("n"), (F.size(p["a"]) + F.size(p["b"])).alias("m")))[0]
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(
        F.transform(F.array(found), lambda x: F.when(x["m"] == 0, F.lit(0.0)).otherwise(2 * x["n"] / x["m"]))[0].cast("double")
    )


def _nodes(fingerprint: Column, level: str) -> Column:
    sections = F.split(F.substring_index(fingerprint, "|", -1), ";", -1)
    if level == "section":
        return F.transform(sections, lambda s: F.substring_index(s, ":", 1))
    return F.flatten(
        F.transform(sections, lambda s: F.transform(F.filter(F.split(F.substring_index(s, ":", -1), ",", -1), lambda q: q != ""), lambda q: F.substring_index(q, ".", 1)))
    )


def edits(old: Column, new: Column, level: str = "paragraph") -> Column:
    """Positions (from 0) of the sections or paragraphs of ``new`` whose node ``old`` does not have."""
    return F.when(root(old) == root(new), F.array().cast("array<int>")).otherwise(
        F.filter(
            F.transform(_nodes(new, level), lambda x, i: F.when(~F.array_contains(_nodes(old, level), x), i).otherwise(-1)),
            lambda i: i >= 0,
        )
    )


def _before(ids: DataFrame) -> DataFrame:
    """(k, prev, prev_n) of distinct ids ``k`` with ``n``: the id before each, before the first the last one.

    Ids are dealt out by range; only one row a range meets in a single task.
    """
    dealt = written(ids.repartitionByRange("k").withColumn("pid", F.spark_partition_id()), "ids")
    own = Window.partitionBy("pid").orderBy("k")
    last = dealt.groupBy("pid").agg(F.max_by(F.struct("k", "n"), "k").alias("last"))
    end = last.agg(F.max_by("last", "pid").alias("end")).first()["end"]  # one row: the last id of all
    if end is None:
        return dealt.select("k", F.col("k").alias("prev"), F.col("n").alias("prev_n"))
    wrap = F.struct(F.lit(end["k"]).cast("long").alias("k"), F.lit(end["n"]).cast("long").alias("n"))
    edge = last.select("pid", F.coalesce(F.lag("last").over(Window.orderBy("pid")), wrap).alias("edge"))
    row = dealt.withColumn("p", F.lag(F.struct("k", "n")).over(own)).join(edge, "pid")
    row = row.withColumn("p", F.coalesce("p", "edge"))
    return row.select("k", F.col("p.k").alias("prev"), F.col("p.n").alias("prev_n"))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness to those and to the next text's.

    The edited text has its last quarter replaced by as many first code points of the next text.
    """
    # both branches below read these two columns, so that one exchange of the texts serves them
    rows = df.select(F.coalesce(whole_key(df, key), F.lit(_FIRST)).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    before = written(_before(rows.groupBy("k").agg(F.max(F.length("t").cast("long")).alias("n"))), "before")
    placed = rows.join(before, "k")
    heads = with_fingerprint(placed, "t", "fp").select(
        F.col("prev").alias("k"), F.struct(F.left("t", F.floor(F.col("prev_n") / 4).cast("int")).alias("head"), F.col("fp").alias("next_fp")).alias("v")
    )
    heads = heads.groupBy("k").agg(F.min("v").alias("v"))
    both = with_fingerprint(rows.join(heads, "k").withColumn("n", F.length("t")), "t", "fingerprint")
    quarter = F.floor(F.col("n") / 4).cast("int")
    both = both.select(
        "k", "n", "fingerprint", F.col("v.next_fp").alias("next_fp"), F.concat(F.left("t", F.col("n") - quarter), F.left("v.head", quarter)).alias("edited")
    )
    both = with_fingerprint(both, "edited", "edited_fingerprint")
    return both.select(
        F.nullif("k", F.lit(_FIRST)).cast(df.schema[key].dataType).alias(key), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )
