"""Repeated byte strings, removed where a string of ``size`` bytes starts earlier as well.

Suffixes are compared by their first ``size`` (100) bytes in a distributed difference-cover
suffix sort (``suffix.py``). Suffixes that cannot have an equal neighbour there, and copies of whole
neighbourhoods, are set aside first, by anchors: a position is one where its ``GRAM``-byte gram has
the smallest hash among the grams of some window of ``size`` bytes, so that any two equal windows
have an anchor at the same offset. Then

1. anchors are named by the hashes of their grams; windows at a name that occurs once are unique
   (names are counted over all texts; a bitmap of bounded size carries the repeated ones);
2. anchors with equal names are compared by their whole context, all windows that the anchor
   stands for, through a 128-bit digest of its bytes: equal contexts form one class, whose earliest
   member alone goes on;
3. where a name has several contexts, the suffixes that start in them are sorted, and neighbours
   with an equal prefix of ``size`` bytes found.

Hot strings are aggregated per class before any join, and a class is never gathered in a task.
Strings never cross texts. "Earlier" is a smaller id, or the same id and a smaller start.

Nulls: a null text is empty; a null id comes before all others. Rows that repeat an id and a text
are one document, so that they lose the same bytes; rows that repeat an id with other texts are
documents of their own, in the order of their texts' hashes. Texts of under ``size`` bytes and an
empty table lose nothing; very long texts are hashed in blocks. Further columns are left aside. The
id has to be an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix
from .common import batches, forget, lists, map_batches, map_rows, settings, small_batches, whole_key, written
from .jaccard import _mix

SIZE, GRAM = 100, 50
#: Bits of a bitmap of names (powers of two, 32 and more for each name): a fuller bitmap only lets more suffixes through to the sort.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: Bits of a bitmap's block, and names that are gathered at once.
BLOCK, GATHER = 1 << 15, 1 << 20
#: Bytes that are hashed at once.
_CHUNK = 1 << 16
_LOW = (1 << 20) - 1
_FIRST = -(1 << 63)


class _Powers:
    ready = None

    @classmethod
    def get(cls):
        if cls.ready is None:
            base, n = 0x2545F4914F6CDD1D, 2 * _CHUNK + 8 * SIZE + 2
            make = lambda b: np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])
            cls.ready = make(np.uint64(base)), make(np.uint64(pow(base, -1, 1 << 64))), _mix(np.arange(256, dtype=np.uint64) + np.uint64(7 << 40))
        return cls.ready


class Samples:
    """The anchors of some pieces of texts: for each run of windows with one anchor, where it is and what it stands for.

    ``text`` is the text's number in ``items``; ``at``, ``first`` and ``last`` are positions in that text.
    """

    __slots__ = ("text", "at", "first", "last", "gram", "_items", "_size", "_span")

    def __init__(self, items: list[bytes], pieces: list[tuple[int, int, int, int, int]], size: int, gram: int) -> None:
        power, inverse, code = _Powers.get()
        span = size - gram + 1  # grams of a window
        text, begin, end, start, n = np.array(pieces, np.int64).T
        b = np.frombuffer(b"".join([items[d][a:z] for d, a, z, _, _ in pieces]), np.uint8)
        base = np.cumsum(end - begin) - (end - begin)  # where each piece starts in the buffer
        total = np.empty(len(b) + 1, np.uint64)
        total[0] = 0
        np.cumsum(code[b] * power[: len(b)], out=total[1:])
        grams = _mix((total[gram:] - total[:-gram]) * inverse[: len(b) - gram + 1])
        key = (grams & np.uint64(~_LOW & (1 << 64) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, most = 1, len(b) - size + 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[:most], key[span - width : span - width + most])
        piece = np.repeat(np.arange(len(pieces)), n)
        window = np.arange(len(piece)) + np.repeat(base + start - begin - (np.cumsum(n) - n), n)  # in the buffer
        at = (key[window] & np.uint64(_LOW)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])
        at, piece, shift = at[edge], piece[edge], (begin - base)[piece[edge]]
        self.text, self.gram = text[piece], grams[at]
        self.at = at + shift
        self.first = window[edge] + shift  # first and last window of the run
        self.last = window[np.r_[edge[1:], len(window)] - 1] + shift
        self._items, self._size, self._span = items, size, span

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """128-bit digests (two 64-bit numbers each) of all bytes of the windows that these anchors can stand for."""
        out, before, after = bytearray(), self._span - 1, self._size
        for d, at in zip(self.text[which].tolist(), self.at[which].tolist(), strict=True):
            left = before if at > before else at
            out += hashlib.blake2b(self._items[d][at - left : at + after] + bytes((left,)), digest_size=16).digest()
        return np.frombuffer(bytes(out), np.int64).reshape(-1, 2)


def samples(items: list[bytes], size: int = SIZE, gram: int = GRAM) -> Iterator[Samples]:
    """The anchors of these texts, in blocks; long texts are cut, with the bytes on both sides that their windows need."""
    span, pieces, held = size - gram + 1, [], 0
    for d, data in enumerate(items):
        for start in range(0, len(data) - size + 1, _CHUNK):
            begin, end = max(0, start - (span - 1)), min(len(data), start + _CHUNK + size - 1 + span)
            pieces.append((d, begin, end, start, min(start + _CHUNK, len(data) - size + 1) - start))
            held += end - begin
            if held >= _CHUNK:
                yield Samples(items, pieces, size, gram)
                pieces, held = [], 0
    if pieces:
        yield Samples(items, pieces, size, gram)


def _probes(names: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of each name, both in the block that the top of its hash picks."""
    h = _mix(names ^ np.uint64(0x5851F42D4C957F2D))
    base = (h >> np.uint64(64 - bits.bit_length() + 1)) & np.uint64(~(BLOCK - 1) & (1 << 64) - 1)
    return [(base | h >> np.uint64(shift) & np.uint64(BLOCK - 1)).astype(np.int64) for shift in (0, 15)]


def _has(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether both bits of each name are set."""
    a, b = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0 for bit in _probes(names, len(bitmap) * 8))
    return a & b


def _bitmap(df: DataFrame, names, least: int, expected: int) -> np.ndarray:
    """A bitmap of the 64-bit names that occur ``least`` (1 or 2) times in what ``names`` (columns as lists -> array) gives for the rows.

    Names are dealt out by hash, first counted within about ``GATHER`` of them, so that a hot name comes once from each such lot.
    """
    spark, parts = df.sparkSession, 1
    while parts * GATHER < expected:
        parts *= 2
    top = np.uint64(64 - parts.bit_length() + 1)

    def lot(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = np.sort(np.concatenate(held))
        new = np.r_[True, own[1:] != own[:-1]]
        start = np.flatnonzero(new)
        twice = np.diff(np.r_[start, len(own)]) > 1
        own = own[start]
        # only the part is taken from the hash: 0 where there is one part
        part = (_mix(own ^ np.uint64(0x5851F42D4C957F2D)) >> top).astype(np.int64) if parts > 1 else np.zeros(len(own), np.int64)
        order = np.argsort(part.astype(np.int16) if parts < 1 << 15 else part, kind="stable")
        own, twice, part = own[order], twice[order], part[order]
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        rows = [(int(part[a]), own[a:b].tobytes(), own[a:b][twice[a:b]].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["p", "names", "twice"])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches_:
            got = names(*[c.to_pylist() for c in b.columns])
            held.append(got)
            n += len(got)
            if n >= GATHER:
                yield from lot(held)
                held, n = [], 0
        if n:
            yield from lot(held)

    def count(t: pa.Table) -> pa.Table:
        own = np.sort(np.frombuffer(b"".join(t["names"].to_pylist()), np.uint64))
        if least == 1:
            own = own[np.r_[True, own[1:] != own[:-1]]]
        else:
            twice = np.frombuffer(b"".join(t["twice"].to_pylist()), np.uint64)
            own = np.unique(np.r_[own[1:][own[1:] == own[:-1]], twice])
        return pa.table({"p": pa.array([t["p"][0].as_py()], pa.int32()), "names": pa.array([own.tobytes()], pa.binary()), "n": pa.array([len(own)], pa.int64())})

    dealt = df.mapInArrow(run, "p int, names binary, twice binary").groupBy("p").applyInArrow(count, "p int, names binary, n long")
    found = written(dealt, "names")
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (32 * (found.agg(F.sum("n")).first()[0] or 0)).bit_length()))
    regions = min(parts, bits // BLOCK)  # of the bitmap, each of one or more parts
    share, each = bits // regions, parts // regions

    def fill(ps: list, lists: list) -> list[tuple]:
        rows = []
        for p, own in zip(ps, lists, strict=True):
            out = np.zeros(share, np.uint8)
            for bit in _probes(np.frombuffer(own, np.uint64), bits):
                out[bit - p // each * share] = 1
            rows.append((p // each, np.packbits(out, bitorder="little").tobytes()))
        return rows

    def either(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()])
        return pa.table({"p": t["p"][:1], "bits": pa.array([both.tobytes()], pa.binary())})

    filled = map_rows(found.select("p", "names"), fill, "p int, bits binary")
    if each > 1:
        filled = filled.groupBy("p").applyInArrow(either, "p int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in filled.toLocalIterator():  # MOST_BITS / 8 bytes in all, at most
        out[r["p"] * (share // 8) : (r["p"] + 1) * (share // 8)] = np.frombuffer(r["bits"], np.uint8)
    forget(spark, found)
    return out


def _place(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of (id, position)."""
    return _mix(_mix(ids.view(np.uint64)) + at.astype(np.uint64))


def _joined(text: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of strings that hold runs of windows (in order), those put together that are no further than ``size`` apart."""
    if not len(text):
        return text, first, last
    reach = np.maximum.accumulate(text << 34 | last + size)
    new = np.flatnonzero(np.concatenate([[True], (text[1:] << 34 | first[1:]) > reach[:-1]]))
    return text[new], first[new], np.maximum.reduceat(last, new) + size


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before, and the first row."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(id, mark, spans): of each text that loses bytes, the runs of starts of its repeated windows, as first * 2^32 + last. ``mark`` is the text's hash."""
    spark = df.sparkSession
    # every step is written: its exchanges are of no use afterwards
    with batches(spark), settings(
        spark, spark__sql__execution__arrow__maxBytesPerBatch="8m", spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
        spark__sql__parquet__compression__codec="zstd", parquet__compression__codec__zstd__level="1", parquet__enable__dictionary="false",
        spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold="32m",
    ):
        rows = _rows(df, key, text)
        repeats = not rows.groupBy("id").count().where("count > 1").isEmpty()  # reads the ids alone
        return _removed(rows.where(F.octet_length("data") >= size), size, gram, repeats)


def _removed(rows: DataFrame, size: int, gram: int, twice: bool) -> DataFrame:
    spark = rows.sparkSession
    # within a text the earlier start is known; between texts the id decides, and the text's hash where an id repeats (``twice``)
    earlier = F.struct("id", "mark") if twice else F.col("id")
    expected = _bytes(rows) // ((size - gram + 2) // 2)

    def named(items: list) -> np.ndarray:
        got = [(s.text, s.at, s.gram) for s in samples(items, size, gram)]
        if not got:
            return np.zeros(0, np.uint64)
        d, at, names = (np.concatenate(x) for x in zip(*got, strict=True))
        return names[_changes(d, at)]  # an anchor at a block's edge shows up in both

    repeated = spark.sparkContext.broadcast(_bitmap(rows.select("data"), named, 2, expected))

    def contexts(b: pa.RecordBatch) -> list | None:
        items, parts = b.column(2).to_pylist(), []
        for s in samples(items, size, gram):
            hit = np.flatnonzero(_has(repeated.value, s.gram))
            if len(hit):
                parts.append((s.text[hit], s.at[hit], s.first[hit], s.last[hit], s.gram[hit].view(np.int64), s.contexts(hit)))
        if not parts:
            return None
        text, at, first, last, names, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.flatnonzero(_changes(text, at))  # the run of an anchor at a block's edge is in two parts
        text, at, first, last, names, digest = text[new], at[new], first[new], np.maximum.reduceat(last, new), names[new], digest[new]
        of, start, end = _joined(text, first, last, size)
        data = pa.array([items[t][a:z] for t, a, z in zip(of.tolist(), start.tolist(), end.tolist(), strict=True)], pa.binary())
        order = np.lexsort((digest[:, 1], digest[:, 0], text))
        fresh = np.empty(len(text), bool)
        fresh[order] = _changes(text[order], digest[order, 0], digest[order, 1])
        rows_ = np.unique(text)
        own = lists(rows_, text[~fresh], first[~fresh] << 32 | last[~fresh])
        each = [lists(rows_, text[fresh], x[fresh]) for x in (names, digest[:, 0], digest[:, 1], at.astype(np.int32), first.astype(np.int32), last.astype(np.int32))]
        return [b.column(0).take(pa.array(rows_)), b.column(1).take(pa.array(rows_)), *each, own, lists(rows_, of, start.astype(np.int32)), lists(rows_, of, data)]

    columns = "names array<long>, c1 array<long>, c2 array<long>, at array<int>, first array<int>, last array<int>, own array<long>, starts array<int>, pieces array<binary>"
    found = written(map_batches(rows, contexts, f"id long, mark long, {columns}"), "contexts")
    flat = found.select("id", "mark", F.explode(F.arrays_zip("names", "c1", "c2", "at", "first", "last")).alias("x"))
    flat = flat.select("id", "mark", F.col("x.names").alias("name"), *(F.col(f"x.{c}").alias(c) for c in ("c1", "c2", "at", "first", "last")))
    classes = flat.groupBy("c1", "c2").agg(F.min(earlier).alias("head"), F.min_by("at", earlier).alias("at"), F.count("*").alias("members"), F.min("name").alias("name"))
    classes = written(classes, "classes")
    again = flat.drop("name", "at").join(classes.where("members > 1").select("c1", "c2", "head"), ["c1", "c2"]).where(earlier > F.col("head"))
    again = written(again.groupBy("id", "mark").agg(F.collect_list(F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")).alias("spans")), "again")  # one text's windows

    several = classes.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name")
    # the first member of each class that its name does not settle; the other members are marked already
    heads = classes.join(several, "name").select((F.col("head.id") if twice else F.col("head")).alias("id"), "at")
    places = _bitmap(heads, lambda ids, ats: _place(np.array(ids, np.int64), np.array(ats, np.int64)), 1, expected // 8)
    split = spark.sparkContext.broadcast(places)
    forget(spark, classes)

    def undecided(b: pa.RecordBatch) -> list | None:
        """The strings around such members, neighbours put together."""
        ids, n = b.column(0).to_numpy(), np.diff(b.column(2).offsets.to_numpy())
        at, first, last = (b.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3, 4))
        text = np.repeat(np.arange(len(ids)), n)
        chosen = _has(split.value, _place(ids[text], at))
        text, start, end = _joined(text[chosen], first[chosen], last[chosen], size)
        of = np.repeat(np.arange(len(ids)), np.diff(b.column(5).offsets.to_numpy()))
        begin, pieces = b.column(5).flatten().to_numpy().astype(np.int64), b.column(6).flatten()
        where = np.searchsorted(of << 32 | begin, text << 32 | start, side="right") - 1
        data = [pieces[p].as_py()[a:z] for p, a, z in zip(where.tolist(), (start - begin[where]).tolist(), (end - begin[where]).tolist(), strict=True)]
        return [b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), start.astype(np.int32), pa.array(data, pa.binary())]

    strings = written(map_batches(found.select("id", "mark", "at", "first", "last", "starts", "pieces"), undecided, "id long, mark long, at int, data binary"), "strings")
    own = written(found.where("size(own) > 0").select("id", "mark", F.col("own").alias("spans")), "own")
    forget(spark, found)
    packed = written(suffix.bundles(strings), "bundles")
    forget(spark, strings)
    ordered = suffix.repeated(packed, size, keep=False)
    spans = ordered.unionByName(again).unionByName(own).groupBy("id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = written(spans, "spans")
    forget(spark, again, own)
    return spans


def _bytes(rows: DataFrame) -> int:
    """About how many bytes the texts have; only the number of parts depends on it.

    Twice the size of the files where the optimiser knows it, else counted.
    """
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 2 * known if known < 1 << 55 else rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(whole_key(df, key), F.lit(_FIRST)).alias("id"), F.xxhash64(data).alias("mark"), data.cast("binary").alias("data"))


def _cuts(b: pa.RecordBatch, size: int) -> list[tuple[list[tuple[int, int]], bytes]]:
    """Of each row (id, mark, data, spans): the maximal removed byte runs [a, b), and the bytes that remain."""
    row, packed = np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy())), b.column(3).flatten().to_numpy()
    order = np.lexsort((packed, row))
    row, packed = row[order], packed[order]
    runs: list[list[tuple[int, int]]] = [[] for _ in range(b.num_rows)]
    for r, a, z in zip(*(x.tolist() for x in _joined(row, packed >> 32, packed & 0xFFFFFFFF, size)), strict=True):
        runs[r].append((a, z))
    out = []
    for data, own in zip(b.column(2).to_pylist(), runs, strict=True):
        at = [0, *chain.from_iterable(own), len(data)]
        out.append((own, b"".join([data[a:z] for a, z in zip(at[::2], at[1::2], strict=True)])))
    return out


def kept(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Of the texts that lose bytes: (id, mark, runs, kept) with the removed byte runs and the bytes that remain."""

    def cut(b: pa.RecordBatch) -> list:
        got = _cuts(b, size)
        return [b.column(0), b.column(1), [[{"start": a, "end": z} for a, z in runs] for runs, _ in got], [rest for _, rest in got]]

    small_batches(df.sparkSession)
    return map_batches(_rows(df, key, text).join(removed(df, key, text, size, gram), ["id", "mark"]), cut, "id long, mark long, runs array<struct<start:long,end:long>>, kept binary")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = df.sparkSession
    spans = removed(df, key, text)

    def cut(b: pa.RecordBatch) -> list:
        got = _cuts(b, SIZE)
        return [b.column(0), b.column(1), [len(rest) for _, rest in got], [len(runs) for runs, _ in got], [hashlib.sha256(rest).hexdigest() for _, rest in got]]

    # lets the scan of all texts drop rows before they are shuffled to those that lose bytes
    with batches(spark), settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"):
        less = map_batches(_rows(df, key, text).join(spans, ["id", "mark"]), cut, "id long, mark long, rest long, runs long, sha string")
        less = written(less.dropDuplicates(["id", "mark"]), "less")
    forget(spark, spans)
    rows = _rows(df, key, text).select("id", "mark", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("whole"))
    out = rows.join(less, ["id", "mark"], "left")
    return out.select(
        F.nullif("id", F.lit(_FIRST)).cast(df.schema[key].dataType).alias(key), "n_bytes", (F.col("n_bytes") - F.coalesce("rest", "n_bytes")).alias("n_removed"),
        F.coalesce("runs", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )
