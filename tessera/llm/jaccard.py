"""Size-aware heavy-light join of word n-gram sets by Jaccard similarity, as classes.

Sets are distinct hashed shingles. Equal sets become one class first. A filter that is exact
then drops classes that cannot have a link: of the smallest hashes of a set (three in ten)
a linked set must share one in ten or so. What remains is joined by size:

* small sets (up to a boundary that a cost model picks) enumerate their subsets of each size
  that a link allows; sets under one subset key link by their sizes alone, and in such a bucket
  everything linked at all is linked to the smallest set, so a star of edges is enough;
* large sets post their rarest shingles to inverted lists. A list is scanned by hubs: all its
  sets are verified against its most central one, linked sets merge, and what still spans more
  than one component goes on; at last all pairs of different components are verified. Pairs
  within one component need no check, so a large group of near copies costs a star, not a square.

No pair of sets at or above the threshold is lost: components equal those of all links.

Words are runs without ASCII white space, A-Z lower-cased; with fewer than ``ngram`` words the
sequence is the one shingle. Nulls: a null text is empty, an empty set links with nothing; rows
with a null id are returned alone (component null) and link with nothing. Rows that repeat an id are
one document in several texts: what links with one of them links with all, and each row has its own
``n_shingles``. Very long texts are hashed in blocks. The id has to be an integer; an empty table
gives no rows. Further columns are left aside.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, forget, map_rows, settings, texts, whole_key, written
from .graph import components, relabelled

NGRAM, PER_CENT = 5, 80
#: Hub rounds before the remaining pairs of different components are enumerated.
HUB_ROUNDS = 3
#: Cost of a subset key, a posting and a verified shingle, in one unit; boundaries to choose from.
KEY_COST, POST_COST, TOKEN_COST, BOUNDARIES = 1.0, 4.0, 0.05, range(1, 25)

_CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, made on first use."""

    base = 0x2545F4914F6CDD1D
    ready: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def get(cls):
        if cls.ready is None:
            n = 2 * _CHUNK + 2
            make = lambda b: np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])
            cls.ready = make(np.uint64(cls.base)), make(np.uint64(pow(cls.base, -1, 1 << 64))), _mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))
        return cls.ready


def _chunk_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a buffer."""
    power, inverse, code = _Powers.get()
    b = np.frombuffer(data, np.uint8)
    gap = np.r_[True, _SPACE[b], True]
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(code[b] * power[: len(b)])]
    return start, _mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(np.uint64) << np.uint64(40))


def word_hashes(items: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text; buffers of about a megabyte are hashed at once."""
    out: list[np.ndarray] = []
    todo: list[bytes] = []

    def flush() -> None:
        if todo:
            start, h = _chunk_words(b" ".join(todo))
            ends = np.cumsum([len(x) + 1 for x in todo])
            out.extend(np.split(h, np.searchsorted(start, ends[:-1])))
            todo.clear()

    size = 0
    for x in items:
        x = x.translate(_FOLD)
        if size + len(x) > _CHUNK:
            flush()
            size = 0
        if len(x) <= _CHUNK:
            todo.append(x)
            size += len(x) + 1
            continue
        parts, at = [], 0
        while at < len(x):  # a long text, cut at white space
            end = min(len(x), at + _CHUNK)
            while end < len(x) and end - at <= 2 * _CHUNK and not _SPACE[x[end]]:
                end += 1
            if end - at > 2 * _CHUNK:  # a word of over a megabyte is hashed by itself
                cut = max((x.rfind(c, at, at + _CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")), default=-1)
                if cut > at:
                    end = cut
                else:
                    while end < len(x) and not _SPACE[x[end]]:
                        end += 1
                    word = x[at:end].strip(b" \t\n\v\f\r")
                    parts.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64))
                    at = end
                    continue
            parts.append(_chunk_words(x[at:end])[1])
            at = end
        flush()
        size = 0
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    flush()
    return out


def shingles(words: np.ndarray, ngram: int = NGRAM) -> np.ndarray:
    """The sorted distinct shingles of a word sequence."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(n, ngram)
    mult = [np.uint64(pow(0xD1342543DE82EF95, j + 1, 1 << 64)) for j in range(k)]
    s = words[: n - k + 1] * mult[0]
    for j in range(1, k):
        s = s + words[j : n - k + 1 + j] * mult[j]
    return np.unique(_mix(s + np.uint64(0 if k == ngram else 0x632BE59BD9B4E019 * k % (1 << 64))))


def sets_of(items: list[str], ngram: int = NGRAM) -> list[np.ndarray]:
    return [shingles(w, ngram) for w in word_hashes([x.encode("utf-8", "surrogatepass") for x in items])]


def missing(n, per_cent: int = PER_CENT):
    """How many of its ``n`` shingles a set may lack in a linked one."""
    return n * (100 - per_cent) // 100


def boundary(counts: dict[int, int], per_cent: int = PER_CENT) -> int:
    """The largest size that enumerates subsets, by cost: ``counts`` of sets by size, up to the last choice (larger ones never do)."""
    from math import comb

    def keys(s: int) -> float:
        return KEY_COST * sum(comb(s, d) for d in range(missing(s, per_cent) + 1))

    def lists(s: int) -> float:
        return (missing(s, per_cent) + 1) * POST_COST + s * TOKEN_COST * 2 + 1

    return min((0, *BOUNDARIES), key=lambda x: (sum(n * (keys(s) if s <= x else lists(s)) for s, n in counts.items()), x))


def _subset_keys(items: np.ndarray, per_cent: int) -> list[tuple[int, int]]:
    """(size, key) of each subset that lacks as few shingles as a link allows."""
    h = _mix(items)
    total, n = int(h.sum(dtype=np.uint64)), len(items)
    out = []
    for d in range(missing(n, per_cent) + 1):
        for gone in combinations(h.tolist(), d):
            key = (total - sum(gone)) % (1 << 64) ^ (n - d) * 0x9E3779B97F4A7C15 % (1 << 64)
            out.append((n - d, key - (1 << 64) if key >> 63 else key))
    return out


def _linked(a: str, b: str, shared: str, per_cent: int) -> str:
    return f"100 * ({shared}) >= {per_cent} * ({a} + {b} - ({shared}))"


def _small_links(sets: DataFrame, x: int, per_cent: int) -> DataFrame:
    """Edges among sets of up to ``x`` shingles."""

    def run(ids: list, sizes: list, arrays: list) -> list[tuple]:
        return [(i, n, c, k) for i, n, a in zip(ids, sizes, arrays, strict=True) for c, k in _subset_keys(np.array(a, np.int64).view(np.uint64), per_cent)]

    keys = map_rows(sets.where(F.col("n") <= x).select("id", "n", "items"), run, "id long, n int, c int, key long")
    hubs = keys.groupBy("c", "key").agg(F.min(F.struct("n", "id")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    found = keys.join(hubs, ["c", "key"]).where(f"id <> hub.id and {_linked('n', 'hub.n', 'c', per_cent)}")
    return found.select(F.col("hub.id").alias("u"), F.col("id").alias("v")).distinct()


def _postings(sets: DataFrame, per_cent: int) -> DataFrame:
    """(token, id, n, pos, score) of the rarest shingles of each set, as far as another set has them."""
    tokens = sets.select("id", "n", F.explode("items").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    by = tokens.join(df, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    by = by.withColumn("alone", F.col("n") - F.size("shared")).withColumn("upto", F.floor(F.col("n") * (100 - per_cent) / 100).cast("int") + 1 - F.col("alone"))
    by = by.where("upto > 0").withColumn("score", -F.aggregate("shared", F.lit(0.0), lambda a, x: a + F.log(x["df"])) / F.col("n"))
    return by.select("id", "n", "score", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("upto"))).alias("p", "t")).select(
        F.col("t.token").alias("token"), "id", "n", (F.col("alone") + F.col("p")).alias("pos"), "score"
    )


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (u, v) with whether they link, by their whole sets."""
    a = sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("items").alias("iu"))
    b = sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("items").alias("iv"))
    got = pairs.join(a, "u").join(b, "v").select("u", "v", "cu", "cv", "nu", "nv", F.size(F.array_intersect("iu", "iv")).alias("shared"))
    return got.select("u", "v", "cu", "cv", F.expr(_linked("nu", "nv", "shared", per_cent)).alias("link"))


def _fits(a: str, b: str, per_cent: int) -> str:
    return f"100 * least({a}, {b}) >= {per_cent} * greatest({a}, {b})"


def _large_links(sets: DataFrame, small: DataFrame, x: int, per_cent: int) -> DataFrame:
    """Edges that join all linked pairs of which one set at least has over ``x`` shingles. ``small``: edges found already."""
    spark = sets.sparkSession
    lists = written(_postings(sets.where(F.col("n") >= -(-(x + 1) * per_cent // 100)), per_cent), "postings")
    seen, comps = None, components(small)
    for step in range(HUB_ROUNDS + 1):
        last = step == HUB_ROUNDS
        now = lists.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        # the most central set first, then others: a hub is of use once
        now = now.withColumn("rank", F.col("score") if step == 0 else F.xxhash64("id", F.lit(step)).cast("double"))
        if last:
            size = now.groupBy("token", "comp").agg(F.count("*").alias("m"))
            main = size.groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
            left = now.join(main, "token").where("comp <> main").select("token", "main", *(F.col(c).alias(f"l{c}") for c in ("id", "n", "pos", "comp")))
            pairs = left.join(now, "token").where(
                f"lcomp <> comp and (comp = main or lid < id) and {_fits('ln', 'n', per_cent)} and greatest(ln, n) > {x}"
                f" and {_linked('ln', 'n', 'least(ln - lpos, n - pos)', per_cent)}"
            )
            other = ("lid", "lcomp")
        else:
            # lists of one component have nothing left to verify
            open_ = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("rank", "id", "n", "comp", "pos")).alias("hub")).where("lo <> hi")
            pairs = now.join(open_, "token").where(
                f"comp <> hub.comp and {_fits('n', 'hub.n', per_cent)} and greatest(n, hub.n) > {x} and {_linked('n', 'hub.n', 'least(n - pos, hub.n - hub.pos)', per_cent)}"
            )
            other = ("hub.id", "hub.comp")
        pairs = pairs.select(*(f(a, b).alias(c) for (a, b), names in ((("id", other[0]), "uv"), (("comp", other[1]), ("cu", "cv"))) for f, c in zip((F.least, F.greatest), names, strict=True)))
        pairs = pairs.distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["u", "v"], "left_anti")
        found = written(_verified(pairs, sets, per_cent), "verified")
        links = found.where("link")
        if not links.isEmpty():
            # components merge by their labels; sets that had no link so far are labels of their own
            merged = components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
            alone = links.select(F.explode(F.array("cu", "cv")).alias("id")).distinct().join(comps, "id", "left_anti")
            moved = written(merged.where("id <> comp").select(F.col("id").alias("comp"), F.col("comp").alias("to")), "moved")
            after = written(relabelled(comps.unionByName(alone.withColumn("comp", F.col("id"))), moved), "components")
            forget(spark, comps, merged, moved)
            comps = after
        if not last:
            seen = found.select("u", "v") if seen is None else seen.unionByName(found.select("u", "v"))
    forget(spark, lists)
    return comps


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = NGRAM, per_cent: int = PER_CENT) -> DataFrame:
    """(key, n_shingles, component_id) of each row: the smallest key reachable by links of ``per_cent`` or more."""
    spark = df.sparkSession
    # the second lets the scan of all texts drop rows before they are shuffled to the few that remain
    with batches(spark), settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
        base, moved = _classes(texts(df, whole_key(df, key).alias("id"), text=text), ngram, per_cent)
    own = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("comp", "id")).otherwise(F.col("id"))
    out = base.join(moved, "sig", "left").select(F.col("id").alias("row_id"), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
    return out.select(F.col("row_id").cast(df.schema[key].dataType).alias(key), "n_shingles", F.col("component_id").cast(df.schema[key].dataType).alias("component_id"))


def _classes(rows: DataFrame, ngram: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """(id, rid, n, sig) of all rows, and (sig, comp) of the sets whose component is not their own id; both written."""
    spark = rows.sparkSession

    def first(ids: list, items: list) -> list[tuple]:
        out = []
        for i, a in zip(ids, sets_of(items, ngram), strict=True):
            n = len(a)
            head = a[: missing(n, per_cent) + n // 10 + 1].view(np.int64)
            out.append((i, n, hashlib.blake2b(a.tobytes(), digest_size=16).digest(), head))
        return out

    hashed = map_rows(rows, first, "id long, n int, sig binary, head array<long>").withColumn("rid", F.monotonically_increasing_id())
    hashed = written(hashed, "sets")
    base = written(hashed.drop("head"), "base")
    known = base.where("n > 0 and id is not null")
    equal = written(known.groupBy("sig").agg(F.min(F.struct("id", "rid")).alias("rep"), F.count("*").alias("copies")), "equal")
    again = written(known.select("rid", "sig").join(equal.where("copies > 1"), "sig").where("rid <> rep.rid").select("rid"), "copies")
    heads = hashed.where("n > 0 and id is not null").join(again, "rid", "left_anti").select("id", "rid", "n", F.explode("head").alias("token"))
    shared = heads.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    # a linked set has at least per_cent of the shingles, so its own head shares as many with this one
    count = heads.join(shared, "token").groupBy("id", "n").agg(F.count("*").alias("shared"), F.max("rid").alias("rid"))
    count = written(count.withColumn("least", F.floor(F.ceil(F.col("n") * per_cent / 100) / 10) + 1), "shares")
    forget(spark, hashed)  # nothing reads the heads again
    alive = count.where("shared >= least")

    def whole(ids: list, items: list) -> list[tuple]:
        return [(i, len(a), hashlib.blake2b(a.tobytes(), digest_size=16).digest(), a.view(np.int64)) for i, a in zip(ids, sets_of(items, ngram), strict=True)]

    again_read = rows.join(alive.select("id"), "id", "left_semi")
    sets = map_rows(again_read, whole, "id long, n int, sig binary, items array<long>")
    sets = sets.join(equal.select("sig", F.col("rep.id").alias("id")), ["sig", "id"], "left_semi").dropDuplicates(["sig", "id"])
    sets = written(sets.select("id", "n", "items"), "candidates")

    sizes = sets.groupBy(F.least("n", F.lit(BOUNDARIES[-1] + 1)).alias("n")).count().collect()  # at most as many rows as the last boundary
    x = boundary({r["n"]: r["count"] for r in sizes if r["n"] <= BOUNDARIES[-1]}, per_cent)
    # an id with several texts is one vertex: their sets are in one component
    several = known.groupBy("id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("id")
    same = known.join(several, "id", "left_semi").select("sig", F.col("id").alias("v")).join(equal.select("sig", F.col("rep.id").alias("u")), "sig").where("u <> v").select("u", "v")
    small = written(_small_links(sets, x, per_cent).unionByName(same), "small")
    comps = _large_links(sets, small, x, per_cent)

    moved = equal.select("sig", "copies", F.col("rep.id").alias("id")).join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    moved = written(moved.where("copies > 1 or comp <> id").select("sig", "comp"), "moved")
    forget(spark, equal, again, count, sets, small, comps)
    return base, moved


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each class the row with the smallest key stays.

    An id goes if one of its rows has a linked smaller id; of rows that repeat an id and text one stays.
    """
    found = classes(df, key, text)
    gone = written(found.where(f"component_id <> `{key}`").select(F.col(key).alias("gone")).distinct(), "gone")
    kept = df.join(gone, df[key] == gone["gone"], "left_anti")
    twice = written(df.groupBy(F.col(key).alias("twice")).count().where("count > 1 and twice is not null").select("twice"), "twice")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, kept[key] == twice["twice"], "left_semi").dropDuplicates([key, text])
    return kept.join(twice, kept[key] == twice["twice"], "left_anti").unionByName(again)
