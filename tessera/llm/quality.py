"""Quality classifier by co-training of two views: text content and page metadata.

A text view (shares of character classes, word and line statistics, a lexicon of telling words)
and a metadata view (hashed source and language, the stated length) each get a logistic model of
the labelled rows; the views share no feature, and the metadata view never reads the text. In each round both score all unlabelled documents, and each hands the most confident
cases of them all, in the labels' proportion, to the other as pseudo-labels. A held-out fold of the labels then calibrates
both views together (one logistic model of their two log-odds), and all documents are scored.
Two heads are trained this way: ``quality`` and, where the labels have it, ``toxic``.

The models are fitted on at most ``LABELLED`` labelled rows that have a document, those with the
smallest hashed ids, and on at most ``HANDED`` pseudo-labels a round from each view; every other
document with an id is unlabelled, and all are scored. The features are computed once and written.

Nulls: a null text is empty; null sources, languages and lengths are values of their own; a label
is left out by itself where it is null, so that a row may teach one head only. Without labels (or
with one class) a head's score is the share of that class, or 0.5; a table of labels without a
``quality`` or ``toxic`` column leaves that score at 0.5 or 0. Rows that repeat an id are scored
by themselves; a label that an id has several of is the smallest. Empty texts and very long ones
are documents like others; of equally sure cases that with the smallest hash is handed over.
An empty table of documents gives no rows. Columns of any name pass through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, forget, map_rows, small_batches, written

#: Bounds of what the models are fitted on: labelled rows, and pseudo-labels that a view hands over in a round.
LABELLED, HANDED = 8_000, 800
ROUNDS, CONFIDENT, SHARE, LEXICON, LEAST_DF, HOLD_OUT = 4, 0.95, 0.1, 200, 5, 5
#: A document is accepted with at least this quality and less than this toxicity.
QUALITY_AT, TOXIC_AT = 0.5, 0.2
#: Lots in which the surest cases are chosen first.
LOTS = 64
#: Rows of a block in which a model is fitted: bounds the driver's memory.
_ROWS = 1024
_MARKS = "!*#$%&|.,;:?-()'\"<>{}[]/\\@^_~=+`"
_TRIM = ".,;:!?\"'()[]{}*#$%&|<>"


def text_features(text: str, lexicon: dict[str, int]) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words, lines = text.split(), text.split("\n")
    distinct, count = set(words), max(1, len(words))
    bare = {w.strip(_TRIM).lower() for w in distinct}
    repeats = sum(map(str.__eq__, words, words[1:]))
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    full = [x for x in lines if x]
    ended = sum(x[-1] in ".!?\"" for x in full)
    head = [
        upper / n, lower / n, hist[48:58].sum() / n, hist[32] / n, hist[128:].sum() / n, upper / max(1, upper + lower),
        len(text) / count, len(distinct) / count, len(bare) / count, repeats / count, len(full) / count,
        len(set(full)) / max(1, len(full)), ended / max(1, len(full)), float(not words),
    ]
    out = np.zeros(len(head) + len(_MARKS) + len(lexicon), np.float64)
    out[: len(head)] = head
    out[len(head) : len(head) + len(_MARKS)] = np.log1p(1000 * hist[[ord(c) for c in _MARKS]] / n)
    base = len(head) + len(_MARKS)
    if lexicon:
        for w in bare & lexicon.keys():
            out[base + lexicon[w]] = 1.0
    return out


def meta_features(values: list, length: float | None) -> np.ndarray:
    """One-hot hashes of the metadata values (64 cells each), and the stated length by powers of two (a null one by itself)."""
    out = np.zeros(64 * len(values) + 25)
    for i, v in enumerate(values):
        out[64 * i + zlib.crc32(repr(v).encode()) % 64] = 1.0
    chars = 0 if length is None else max(0, int(length))
    out[64 * len(values) + (23 if length is None else min(22, chars.bit_length()))] = 1.0
    out[-1] = math.log1p(chars)
    return out


@dataclass
class Logistic:
    """L2-regularised logistic regression by Newton steps."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 3.0) -> Logistic:
        """``x`` may be float32: sums and Newton steps go over it in blocks of ``_ROWS`` rows, in float64."""
        n, parts = len(x), [slice(a, a + _ROWS) for a in range(0, len(x), _ROWS)]
        self.mean = sum(x[p].sum(axis=0, dtype=np.float64) for p in parts) / n
        spread = np.sqrt(sum(((x[p] - self.mean) ** 2).sum(axis=0) for p in parts) / n)
        self.scale = np.where(spread > 1e-6, spread, np.inf)  # a constant column says nothing
        ridge = np.full(x.shape[1] + 1, penalty)
        ridge[0] = 1e-6
        w, c = np.zeros(len(ridge)), np.ones(n) if weight is None else weight
        for _ in range(25):
            g, h = -ridge * w, np.diag(ridge)
            for p in parts:
                z = np.empty((len(y[p]), len(w)))
                z[:, 0], z[:, 1:] = 1.0, (x[p] - self.mean) / self.scale
                q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                g += z.T @ (c[p] * (y[p] - q))
                h += (z * (c[p] * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ z
            step = np.linalg.solve(h, g)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-4:
                break
        self.w = w
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return np.clip(self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:], -30, 30)


def chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class Head:
    """The two views and their calibrated combination; ``constant`` where there was nothing to learn."""

    text: Logistic | None = None
    meta: Logistic | None = None
    both: Logistic | None = None
    constant: float = 0.5

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.both is None:
            same = np.full(len(text), self.constant)
            return same, same, same
        a, b = self.text.odds(text), self.meta.odds(meta)
        return chance(a), chance(b), chance(self.both.odds(np.stack([a, b], 1)))


class Pair:
    """Both views of one head, trained on the labelled rows outside ``fold`` 0 and on each other's confident cases; fold 0 calibrates."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> None:
        hold = fold == 0
        self.share = float(y.mean()) if len(y) else 0.5
        self.taught = not (min(y.sum(), len(y) - y.sum()) < 4 or len(set(y[hold])) < 2 or len(set(y[~hold])) < 2)
        if not self.taught:
            return
        self.base, self.prior, self.held_y = y[~hold], y[~hold].mean(), y[hold]
        self.views, self.held = [x[~hold] for x in views], [x[hold] for x in views]
        self.given: list[dict[tuple, float]] = [{}, {}]  # pseudo-labels each view has received
        self.models = [Logistic().fit(x, self.base) for x in self.views]

    def refit(self, features: list[dict[tuple, np.ndarray]]) -> None:
        for k, x in enumerate(self.views):
            if rows := list(self.given[k]):
                both = np.vstack([x, np.array([features[k][i] for i in rows], np.float32)])
                weight = np.r_[np.ones(len(x)), np.full(len(rows), 0.5)]
                self.models[k] = Logistic().fit(both, np.r_[self.base, [self.given[k][i] for i in rows]], weight)

    def head(self) -> Head:
        if not self.taught:
            return Head(constant=self.share)
        odds = np.stack([m.odds(x) for m, x in zip(self.models, self.held, strict=True)], 1)
        return Head(*self.models, Logistic().fit(odds, self.held_y, penalty=1.0), self.share)


def _confident(pool: DataFrame, pairs: list[Pair], most: int) -> list:
    """(pair, view, label, id, mark): of all rows of the pool, those that a view is surest of and has not handed over yet."""
    wanted = []  # (pair, view, model, marks handed over, how many of each label)
    for j, pair in enumerate(pairs):
        for k in (0, 1):
            seen = np.array([mark for _, mark in pair.given[1 - k]], np.int64)
            wanted.append((j, k, pair.models[k], seen, [max(1, int(most * part)) for part in (1 - pair.prior, pair.prior)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}  # of each kind the surest of this task
        for b in batches:
            if not b.num_rows:
                continue
            ids, marks = (b.column(c).to_numpy() for c in (0, 1))
            views = [np.frombuffer(b"".join(b.column(c).to_pylist()), "<f4").reshape(b.num_rows, -1).astype(np.float64) for c in (2, 3)]
            for j, k, model, seen, counts in wanted:
                p = chance(model.odds(views[k]))
                for label, sure in ((0, 1 - p), (1, p)):
                    at = np.flatnonzero(sure >= CONFIDENT)
                    at = at[~np.isin(marks[at], seen)]
                    if not len(at):
                        continue
                    own = (-sure[at], marks[at], ids[at])
                    if (j, k, label) in held:
                        own = tuple(map(np.concatenate, zip(held[j, k, label], own, strict=True)))
                    if len(own[0]) > 4 * counts[label]:
                        first = np.lexsort(own[::-1])[: counts[label]]
                        own = tuple(x[first] for x in own)
                    held[j, k, label] = own
        for key, own in held.items():
            same = [np.full(len(own[0]), x, np.int32) for x in key]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*same, *own)], names=["pair", "view", "label", "doubt", "mark", "id"])

    found = pool.mapInArrow(run, "pair int, view int, label int, doubt double, mark long, id long")
    limits = {(j, k, label): n for j, k, _, _, counts in wanted for label, n in enumerate(counts)}
    kinds = ["pair", "view", "label"]
    # first the surest of each lot, so that the task of one kind reads LOTS times what is handed over and no more
    for by in ([*kinds, F.pmod(F.xxhash64("mark", "id"), F.lit(LOTS))], kinds):
        found = found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("doubt", "mark", "id"))).where(F.col("place") <= max(limits.values()))
    found = found.orderBy("pair", "view", "label", "place").collect()  # as many as are handed over
    return [r for r in found if r["place"] <= limits[r["pair"], r["view"], r["label"]]]


def co_train(pool: DataFrame, pairs: list[Pair]) -> None:
    """Rounds in which the two views of each pair teach each other by their confident cases of the pool (id, mark, t, m)."""
    pairs = [p for p in pairs if p.taught]
    if not pairs:
        return
    most = min(HANDED, max(1, int(SHARE * pool.count())))
    features: list[dict[tuple, np.ndarray]] = [{}, {}]
    for _ in range(ROUNDS):
        handed = set()
        for r in _confident(pool, pairs, most):
            given, case = pairs[r["pair"]].given[1 - r["view"]], (r["id"], r["mark"])
            if case not in given:
                given[case] = float(r["label"])
                handed.add(case)
        if not handed:
            break
        new = pool.sparkSession.createDataFrame(sorted(handed), "id long, mark long")
        for r in pool.join(F.broadcast(new), ["id", "mark"]).dropDuplicates(["id", "mark"]).collect():  # the cases of one round
            for k, c in enumerate("tm"):
                features[k][r["id"], r["mark"]] = np.frombuffer(r[c], "<f4")
        for p in pairs:
            p.refit(features)


@dataclass
class Model:
    lexicon: dict[str, int]
    heads: dict[str, Head]
    meta: tuple[str, ...]
    length: str | None = None


def _bare(text: str = "text"):
    return F.array_distinct(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(_TRIM))))


def _lexicon(rows: DataFrame, heads: list[str]) -> dict[str, int]:
    """The words whose presence tells a label best (by z-score of their share in either class), over the labelled sample."""
    sums = [x for h in heads for x in (F.sum(F.col(h).cast("double")).alias(f"p_{h}"), F.count(h).alias(f"n_{h}"))]
    total = rows.agg(*sums).first()
    by = rows.select(F.explode("words").alias("w"), *heads).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= LEAST_DF)
    scores = []
    for h in heads:
        share = min(max((total[f"p_{h}"] or 0) / (total[f"n_{h}"] or 1), 1e-3), 1 - 1e-3)
        n = F.greatest(F.col(f"n_{h}"), F.lit(1))
        scores.append(F.abs(F.coalesce(f"p_{h}", F.lit(0.0)) - n * share) / F.sqrt(n * share * (1 - share)))
    found = by.select("w", F.greatest(*scores, F.lit(0.0), F.lit(0.0)).alias("z")).where("z > 4").orderBy(F.desc("z"), "w").limit(LEXICON).collect()
    return {r["w"]: i for i, r in enumerate(found)}


def _views(docs: DataFrame, key: str, text: str, meta: tuple[str, ...], length: str | None) -> list:
    """What both views read, under names of our own: id, text, m0, m1, ..., size."""
    size = F.col(length).cast("double") if length else F.lit(None).cast("double")
    return [F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"), *(F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(meta)), size.alias("size")]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("source", "lang"), length: str | None = "n_chars") -> Model:
    """Models of the documents whose ids ``labels`` has; the fold of a row comes from its hashed id. ``length``: a column with the stated length, or None."""
    spark = docs.sparkSession
    length = length if length in docs.columns else None
    heads = [h for h in ("quality", "toxic") if h in labels.columns]
    if not heads:
        return Model({}, {}, meta, length)
    ys = [f"y_{h}" for h in heads]
    known = labels.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(h).cast("int").alias(y) for h, y in zip(heads, ys, strict=True)))
    known = known.where(F.coalesce(*ys).isNotNull()).select(F.col(key).alias("id"), *ys)
    # ids without a document use up nothing of the sample
    known = known.join(docs.select(F.col(key).alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    metas = [f"m{i}" for i in range(len(meta))]
    with batches(spark):
        chosen = written(known, "labelled")
        rows = docs.where(F.col(key).isNotNull()).select(*_views(docs, key, text, meta, length))
        labelled = rows.join(F.broadcast(chosen), "id")  # at most LABELLED ids
        lexicon = _lexicon(labelled.select(_bare().alias("words"), *(F.col(y).alias(h) for h, y in zip(heads, ys, strict=True))), heads)

        def run(ids: list, marks: list, items: list, *rest: list) -> list[tuple]:
            m, sizes, own = rest[: len(meta)], rest[len(meta)], rest[len(meta) + 1 :]
            return [
                (i, mark, text_features(t, lexicon).astype("<f4").tobytes(), meta_features([c[j] for c in m], sizes[j]).astype("<f4").tobytes(), *(c[j] for c in own))
                for j, (i, mark, t) in enumerate(zip(ids, marks, items, strict=True))
            ]

        rows = rows.join(F.broadcast(chosen.withColumn("known", F.lit(1))), "id", "left").select("id", F.xxhash64("id", "text", *metas).alias("mark"), "text", *metas, "size", "known", *ys)
        features = written(map_rows(rows, run, "id long, mark long, t binary, m binary, known int" + "".join(f", {y} int" for y in ys)), "features")
        got = features.where("known = 1").orderBy("id", "mark").collect()  # as many rows as the sample has
        fold = np.array([zlib.crc32(str(r["id"]).encode()) % HOLD_OUT for r in got], int)
        views = [np.frombuffer(b"".join(r[c] for r in got), "<f4").reshape(len(got), -1 if got else 1) for c in "tm"]
        marks = {y: np.array([np.nan if r[y] is None else float(r[y] > 0) for r in got]) for y in ys}
        del got
        pairs = {}
        for h, y in zip(heads, ys, strict=True):
            own = ~np.isnan(marks[y])
            pairs[h] = Pair([x[own] for x in views], marks[y][own], fold[own])
        del views
        co_train(features.where("known is null").select("id", "mark", "t", "m"), list(pairs.values()))
        forget(spark, features, chosen)
    return Model(lexicon, {h: p.head() for h, p in pairs.items()}, meta, length)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns with text_score, meta_score, quality and toxic (calibrated), and ``accepted``."""
    keep = (key,) if keep is None else keep
    out = _scored(docs, model, key, text, keep)
    return out.toDF(*keep, *out.columns[len(keep) :])


def _scored(docs: DataFrame, model: Model, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """As ``score``, with the columns to keep named k0, k1, ...: names of the input cannot clash with it."""
    small_batches(docs.sparkSession)
    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(*cols: list) -> list[tuple]:
        own, items, metas, sizes = cols[: len(keep)], cols[len(keep) + 1], cols[len(keep) + 2 : -1], cols[-1]
        if not items:
            return []
        t = np.array([text_features(x, model.lexicon) for x in items])
        m = np.array([meta_features([c[j] for c in metas], sizes[j]) for j in range(len(items))])
        got = {h: head.scores(t, m) for h, head in model.heads.items()}
        a, b, q = got["quality"] if "quality" in got else Head().scores(t, m)
        bad = got["toxic"][2] if "toxic" in got else np.zeros(len(items))
        fine = (q >= QUALITY_AT) & (bad < TOXIC_AT)
        return list(zip(*own, a.tolist(), b.tolist(), q.tolist(), bad.tolist(), fine.tolist(), strict=True))

    rows = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), *_views(docs, key, text, model.meta, model.length))
    return map_rows(rows, run, f"{kinds}text_score double, meta_score double, quality double, toxic double, accepted boolean")


def accepted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the model accepts, with their own columns and no others."""
    kept = _scored(docs, model, key, text, tuple(docs.columns)).where("accepted")
    return kept.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
