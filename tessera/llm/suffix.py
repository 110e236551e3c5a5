"""Equal windows of many byte strings by a distributed difference-cover suffix sort (modulo 3).

Strings are packed, in the order of their places, into bundles of about ``BUNDLE`` bytes, set apart
by the symbol 0. At each level

1. the triples of symbols at positions 1 and 2 modulo 3 are sorted (distinct ones per bundle first,
   then over range partitions) and named by their rank;
2. the names of a bundle (those of residue 1, a 0, those of residue 2) are the string of the next
   level. It goes down until all names differ or a name stands for ``size`` bytes: names of level k
   stand for 3^k bytes, so that there are at most five levels for 100 bytes;
3. coming up, the suffixes of residue 0 are sorted by (symbol, rank of the next) and merged with the
   sampled ones, in range partitions whose bounds are suffixes of residue 1;
4. on the bytes' level the merged suffixes that start a whole window are compared with their
   neighbours: a run of equal prefixes has one earliest member, and the others are returned.

Bundles and range partitions have a size that does not depend on the data; a triple that is
everywhere comes once from each bundle, and equal windows with different bytes behind them have
different ranks, so that a range bound can fall between them. The driver holds one count and one
bound per range partition, and about 32 sampled keys to draw each bound from. Each step is written to
the shared folder. Neighbours' prefixes are compared by 128 bits of hash of their ``size`` bytes, which
travel with each suffix in place of the bytes. A suffix's place is its bundle and its position there.

A row holds what one bundle has in one range partition. These rows grow with the square of the
input, so Python reads and makes them by whole columns, and never one by one.

Nothing goes in: nothing comes out. Strings that repeat an (id, mark, at) count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, kinds, written
from .jaccard import _mix

#: Bytes of one bundle, and suffixes of one range partition.
BUNDLE, PART = 1 << 19, 1 << 19
#: Bytes that go from Python to Spark at once.
SENT = 1 << 22
#: Bounds are drawn from this many suffixes of each of at least this many bundles.
DRAW, DRAWN = 256, 32


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text))


def _stream(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` (row as dict -> lists of columns) over rows, with binary columns passed on as they are."""
    arrow = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                for columns in fn(b.slice(k, 1).to_pylist()[0]):
                    out = pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                    step = max(1, out.num_rows * SENT // max(1, out.nbytes))
                    for at in range(0, out.num_rows, step):
                        yield out.slice(at, step)

    return df.mapInArrow(run, schema)


def _grouped(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` (rows of one range partition -> columns)."""
    arrow = _schema(schema)
    return df.groupBy("p").applyInArrow(lambda t: pa.Table.from_arrays([_column(c, f.type) for c, f in zip(fn(t), arrow, strict=True)], schema=arrow), schema)


def _bundled(base: DataFrame, lists: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` (a bundle's row of ``base`` as dict, the bundle's rows of ``lists`` -> columns): no rows where it gives None."""
    arrow = _schema(schema)

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        columns = fn(own.to_pylist()[0], found) if own.num_rows else None
        return arrow.empty_table() if columns is None else pa.Table.from_arrays([_column(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return base.groupBy("bundle").cogroup(lists.groupBy("bundle")).applyInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def _values(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """What all rows of a column of packed numbers hold, in one array, and how many each row has; no row is touched by itself."""
    column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if edge[-1] > edge[0] else np.zeros(0, np.uint8)
    return values.view(dtype), np.diff(edge) // np.dtype(dtype).itemsize


def _packed(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """A binary column with ``values`` from each of ``edge`` to the next."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def bundles(strings: DataFrame) -> DataFrame:
    """Pack strings (id, mark, at, data), written, into bundles whose numbers rise with (id, mark, at).

    ``seg`` holds (id, mark, at, length) of each string, ``sym`` the bytes plus one with a 0 after each string.
    """
    schema = "bundle long, seg binary, sym binary"
    arrow = _schema(schema)

    def pack(number: int, held: list) -> pa.RecordBatch:
        seg = np.array([(i, m, a, len(d)) for i, m, a, d in held], np.int64)
        data = b"\0".join([d for *_, d in held]) + b"\0"
        sym = np.frombuffer(data, np.uint8).astype("<i2") + 1
        sym[np.cumsum(seg[:, 3] + 1) - 1] = 0
        return pa.RecordBatch.from_pylist([{"bundle": number, "seg": seg.tobytes(), "sym": sym.astype("<i2").tobytes()}], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, last = TaskContext.get().partitionId() << 32, [], 0, None
        for b in batches:
            for piece in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if piece[:3] == last:
                    continue
                last = piece[:3]
                held.append(piece)
                n += len(piece[3])
                if n >= BUNDLE:
                    yield pack(number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield pack(number, held)

    place = ("id", "mark", "at")
    return strings.select(*place, "data").repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(run, schema)


def _sampled(n: int) -> np.ndarray:
    return np.r_[np.arange(1, n, 3), np.arange(2, n, 3)]


def _padded(data: bytes, dtype: str) -> np.ndarray:
    return np.r_[np.frombuffer(data, dtype).astype(np.int64), np.zeros(3, np.int64)]


def _bits(key: np.ndarray) -> int:
    return int(key.max()).bit_length() if len(key) else 0


def _sorted(key: np.ndarray, bits: int) -> np.ndarray:
    """The order of one key of so many bits; equal keys keep their order where key and position fit one word."""
    places = len(key).bit_length()
    if bits + places <= 63:  # sorting plain words is several times faster than sorting positions
        return np.sort(key << places | np.arange(len(key))) & (1 << places) - 1
    return np.argsort(key)


def _order(*keys: np.ndarray) -> np.ndarray:
    """An order by these keys (none negative), the first one first; rows equal in all of them come in any order.

    Keys are packed into one word. What does not fit is packed behind the ranks of the part before it.
    """
    n, order = len(keys[0]), None
    word, width = np.zeros(n, np.int64), 0
    for key in keys:
        bits = _bits(key)
        while bits:
            take = min(bits, 62 - width)
            if take > 0:
                word, width, bits = word << take | key >> (bits - take) & (1 << take) - 1, width + take, bits - take
            if bits:  # full: on with the ranks
                order = _sorted(word, width)
                new = np.cumsum(np.r_[0, np.diff(word[order]) != 0][:n])
                word = np.empty(n, np.int64)
                word[order] = new
                width = _bits(new[-1:])
                if n and new[-1] == n - 1:
                    return order
    return _sorted(word, width)


def _below(have: list[np.ndarray], want: list[np.ndarray], equal: bool = False) -> np.ndarray:
    """For each of ``want`` how many of ``have`` are smaller (or equal); both are lists of key columns."""
    n, m = len(want[0]), len(have[0])
    later = np.r_[np.full(m, not equal), np.full(n, equal)].astype(np.int64)  # of equal keys these come second
    order = _order(*(np.r_[h, w] for h, w in zip(have, want, strict=True)), later)
    wanted = order >= m
    out = np.zeros(n, np.int64)
    out[order[wanted] - m] = np.cumsum(~wanted)[wanted]
    return out


def merged(rows: dict[int, dict[str, np.ndarray]]) -> np.ndarray:
    """The order of the suffixes of residues 0, 1, 2 (concatenated), by the ranks of the sampled ones."""
    x, y, z = rows[0], rows[1], rows[2]
    of0 = _order(x["t0"], x["ra"])
    sampled = _order(np.r_[y["ra"], z["ra"]])
    first = {k: v[of0] for k, v in x.items()}
    smaller = _below([y["t0"], y["rb"]], [first["t0"], first["ra"]]) + _below([z["t0"], z["t1"], z["rb"]], [first["t0"], first["t1"], first["rb"]])
    n = len(of0) + len(sampled)
    out, free = np.zeros(n, np.int64), np.ones(n, bool)
    place = np.maximum.accumulate(smaller) + np.arange(len(of0)) if len(of0) else smaller
    out[place], free[place] = of0, False
    out[free] = sampled + len(of0)
    return out


def _draw(rows: DataFrame, count: int, parts: int, fn) -> np.ndarray:
    """Keys of a sample of suffixes, sorted: where range partitions may begin (about 32 keys a partition)."""
    if parts < 2:
        return np.zeros((0, 3), np.int64)
    step = max(1, count // max(DRAWN, 32 * parts // DRAW))
    if step > 1:
        rows = rows.where(F.pmod(F.xxhash64("bundle"), F.lit(step)) == 0)
    got = _stream(rows, fn, "keys binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.int64).reshape(-1, 3) for r in got]) if got else np.zeros((0, 3), np.int64)
    return np.unique(keys, axis=0)


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    return keys[np.unique(np.linspace(0, len(keys) - 1, parts + 1).astype(int)[1:-1])] if len(keys) and parts > 1 else keys[:0]


def _offsets(df: DataFrame) -> tuple[dict[int, int], int]:
    """Where each range partition's ranks begin, and their number."""
    total, out = 0, {}
    for r in df.groupBy("p").agg(F.max("n").alias("n")).orderBy("p").collect():
        out[r["p"]] = total
        total += r["n"]
    return out, total


def _kind(total: int) -> str:
    return "<i4" if total < (1 << 31) - 2 else "<i8"


def _triples(data: bytes, dtype: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The bundle's distinct sampled triples in order, and which one each sample has."""
    sym = _padded(data, dtype)
    at = _sampled(len(sym) - 3)
    a, b, c = sym[at], sym[at + 1], sym[at + 2]
    order = _order(a, b, c)
    a, b, c = a[order], b[order], c[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])][: len(a)]
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return [a[new], b[new], c[new]], which


def _named(level: DataFrame, dtype: str, count: int, total: int) -> tuple[DataFrame, str, bool]:
    """The next level's strings (bundle, sym), their type, and whether all names differ."""

    def draw(r: dict) -> Iterator[dict]:
        sym = _padded(r["sym"], dtype)
        at = _sampled(len(sym) - 3)
        if len(at):
            at = at[np.linspace(0, len(at) - 1, DRAW).astype(int)]
            yield [[np.stack([sym[at], sym[at + 1], sym[at + 2]], axis=1).tobytes()]]

    parts = -(-total // PART)
    bounds = _bounds(_draw(level.select("bundle", "sym"), count, parts, draw), parts)

    def emit(r: dict) -> Iterator[list]:
        keys, _ = _triples(r["sym"], dtype)
        edge = np.r_[0, _below(keys, list(bounds.T)), len(keys[0])] if len(bounds) else np.array([0, len(keys[0])])
        own = np.flatnonzero(np.diff(edge))
        edge = np.r_[edge[own], len(keys[0])]  # range partitions without a triple take no room
        yield [own, np.full(len(own), r["bundle"]), *(_packed(k.astype(dtype), edge) for k in keys)]

    def rank(t: pa.Table) -> list:
        (a, n), (b, _), (c, _) = (_values(t[k], dtype) for k in "abc")
        a, b, c = (x.astype(np.int64) for x in (a, b, c))
        order = _order(a, b, c)
        a, b, c = a[order], b[order], c[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]
        name = np.empty(len(a), np.int32)
        name[order] = np.cumsum(new)
        return [t["p"], t["bundle"], _packed(name, np.r_[0, np.cumsum(n)]), np.full(len(n), new.sum())]

    ranks = written(_grouped(_stream(level.select("bundle", "sym"), emit, "p int, bundle long, a binary, b binary, c binary"), rank, "p int, bundle long, name binary, n long"), "names")
    offsets, distinct = _offsets(ranks)
    kind = _kind(distinct)

    def follow(r: dict, found: pa.Table) -> list:
        _, which = _triples(r["sym"], dtype)
        found = found.sort_by("p")
        names, n = _values(found["name"], "<i4")
        names = (names + np.repeat(np.array([offsets[p] for p in found["p"].to_pylist()], np.int64), n))[which]
        ones = len(range(1, len(r["sym"]) // np.dtype(dtype).itemsize, 3))
        return [[r["bundle"]], [np.r_[names[:ones], 0, names[ones:]].astype(kind).tobytes()], [len(names)]]

    out = written(_bundled(level.select("bundle", "sym"), ranks.select("bundle", "p", "name"), follow, "bundle long, sym binary, n long"), "level")
    forget(level.sparkSession, ranks)
    return out, kind, distinct == out.agg(F.sum("n")).first()[0]


def _suffixes(rows: DataFrame, dtype: str, kind: str, count: int, total: int, fn, extra: dict[str, str], more, schema: str) -> DataFrame:
    """Range partitions of all suffixes, each merged and given to ``fn`` (rows, suffixes of each, further columns, order -> columns).

    ``rows`` hold the ranks of the samples, as in ``_sampled``, with one more between the residues.
    ``more`` (row) gives further columns of the suffixes and which of them are needed.
    """
    def spread(r: dict) -> tuple[np.ndarray, np.ndarray]:
        sym = _padded(r["sym"], dtype)
        n = len(sym) - 3
        got, rank = np.frombuffer(r["rank"], kind).astype(np.int64), np.zeros(n + 3, np.int64)
        ones = len(range(1, n, 3))
        rank[1:n:3], rank[2:n:3] = got[:ones], got[ones + 1 :]
        return sym, rank

    def draw(r: dict) -> Iterator[dict]:
        sym, rank = spread(r)
        at = np.arange(1, len(sym) - 3, 3)
        if len(at):
            at = at[np.linspace(0, len(at) - 1, DRAW).astype(int)]
            yield [[np.stack([rank[at], sym[at], rank[at + 1]], axis=1).tobytes()]]

    parts = -(-total // PART)
    bounds = _bounds(_draw(rows.select("bundle", "sym", "rank"), count, parts, draw), parts)
    columns = {"t0": dtype, "t1": dtype, "ra": kind, "rb": kind} | extra

    def emit(r: dict) -> Iterator[list]:
        sym, rank = spread(r)
        added, needed = more(r)
        parts_, held = [], {k: [] for k in columns}
        for residue in range(3):
            at = np.arange(residue, len(sym) - 3, 3)
            at = at[needed[at]]
            own = {"t0": sym[at], "t1": sym[at + 1] if residue != 1 else at * 0, "ra": rank[at + (residue == 0)], "rb": rank[at + (1 if residue == 1 else 2)]}
            own |= {k: v[at] for k, v in added.items()}
            if residue:
                part = np.searchsorted(bounds[:, 0], own["ra"], side="right")
            else:
                part = _below([bounds[:, 1], bounds[:, 2]], [own["t0"], own["ra"]], equal=True)
            parts_.append(part * 3 + residue)
            for k, kind_ in columns.items():
                held[k].append(own[k].astype(kind_))
        part = np.concatenate(parts_)
        order, n = _order(part), np.bincount(part, minlength=3 * len(bounds) + 3).reshape(-1, 3)
        own = np.flatnonzero(n.sum(1))
        n = n[own].astype(np.int32)
        edge = np.r_[0, np.cumsum(n.sum(1))]
        yield [own, np.full(len(own), r["bundle"]), *n.T, *(_packed(np.concatenate(held.pop(k))[order], edge) for k in columns)]

    def merge(t: pa.Table) -> list:
        n = np.stack([t[f"n{q}"].to_numpy() for q in range(3)], axis=1)
        residue = np.repeat(np.tile(np.arange(3, dtype=np.int8), len(n)), n.ravel())
        held = {k: _values(t[k], kind_)[0] for k, kind_ in columns.items()}
        where = [np.flatnonzero(residue == q) for q in range(3)]
        order = merged({q: {k: held[k][w].astype(np.int64) for k in ("t0", "t1", "ra", "rb")} for q, w in enumerate(where)})
        return fn(t, n.sum(1), {k: held[k] for k in extra}, np.concatenate(where)[order])

    return _grouped(_stream(rows, emit, "p int, bundle long, n0 int, n1 int, n2 int, " + ", ".join(f"{k} binary" for k in columns)), merge, schema)


def _ranked(level: DataFrame, dtype: str, reach: int, size: int, base: DataFrame) -> tuple[DataFrame, str]:
    """``base`` with the ranks of all suffixes of the level's strings (stored together: no later join by bundle)."""
    samples, kind = _sample_ranks(level, dtype, reach, size)
    count, total = level.select(F.count("*"), F.sum(F.octet_length("sym"))).first()
    total //= np.dtype(dtype).itemsize

    def more(r: dict) -> tuple[dict, np.ndarray]:
        n = len(r["sym"]) // np.dtype(dtype).itemsize
        return {"at": np.arange(n)}, np.ones(n, bool)

    def place(t: pa.Table, n: np.ndarray, held: dict[str, np.ndarray], order: np.ndarray) -> list:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        return [t["p"], t["bundle"], t["at"], _packed(rank, np.r_[0, np.cumsum(n)]), np.full(len(n), len(order))]

    out = written(_suffixes(samples, dtype, kind, count, total, place, {"at": "<i4"}, more, "p int, bundle long, at binary, rank binary, n long"), "ranks")
    forget(level.sparkSession, samples)
    offsets, number = _offsets(out)
    wide, columns = _kind(number), base.columns

    def gather(r: dict, found: pa.Table) -> list:
        at, n = _values(found["at"], "<i4")
        own, _ = _values(found["rank"], "<i4")
        rank = np.empty(len(at), np.int64)
        rank[at] = own + np.repeat(np.array([offsets[p] for p in found["p"].to_pylist()], np.int64), n)
        return [*([r[c]] for c in columns), [rank.astype(wide).tobytes()]]

    ranks = written(_bundled(base, out.select("bundle", "p", "at", "rank"), gather, kinds(base) + ", rank binary"), "ranked")
    forget(level.sparkSession, out)
    return ranks, wide


def _sample_ranks(level: DataFrame, dtype: str, reach: int, size: int) -> tuple[DataFrame, str]:
    """The level with the ranks of its sampled suffixes; a symbol stands for ``reach`` bytes."""
    count, total = level.select(F.count("*"), F.sum(F.octet_length("sym"))).first()
    following, kind, distinct = _named(level, dtype, count, total // np.dtype(dtype).itemsize)
    if distinct or 3 * reach >= size:
        ranks = written(level.join(following.select("bundle", F.col("sym").alias("rank")), "bundle"), "ranked")
        forget(level.sparkSession, following)
        return ranks, kind
    ranks, wide = _ranked(following.select("bundle", "sym"), kind, 3 * reach, size, level)
    forget(level.sparkSession, following)
    return ranks, wide


def _hashes(sym: np.ndarray, size: int, salt: int) -> np.ndarray:
    """The polynomial hash of the ``size`` symbols from each position on (0 where there are fewer), with random codes of the symbols."""
    full, n = np.zeros(len(sym), np.uint64), len(sym) - size + 1
    if n > 0:
        base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[salt]
        power, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(sym) - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        total = np.zeros(len(sym) + 1, np.uint64)
        np.cumsum(_mix(np.arange(257, dtype=np.uint64) + np.uint64(salt + 1 << 32))[sym] * power, out=total[1:])
        full[:n] = _mix((total[size:] - total[:-size]) * inverse[:n])
    return full.view(np.int64)


def _new(numbers: np.ndarray) -> np.ndarray:
    """Where a sorted array has a number for the first time."""
    return np.r_[True, numbers[1:] != numbers[:-1]][: len(numbers)]


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers in a sorted array."""
    new = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    return at[new], at[np.r_[new[1:], len(at)] - 1]


def repeated(strings: DataFrame, size: int, keep: bool = True) -> DataFrame:
    """(id, mark, spans): of each string's text, the runs of starts (first * 2^32 + last) of the windows of ``size`` bytes that an earlier place has too.

    ``strings`` come from ``bundles``, written; without ``keep`` they are deleted once their ranks are stored beside them.
    """
    spark = strings.sparkSession
    spans = "id long, mark long, spans array<long>"
    if strings.isEmpty():
        return spark.createDataFrame([], spans)
    samples, kind = _sample_ranks(strings, "<i2", 1, size)
    count, total = strings.select(F.count("*"), F.sum(F.octet_length("sym") / 2).cast("long")).first()
    places = written(strings.select("bundle", "seg"), "places")
    if not keep:
        forget(spark, strings)

    def more(r: dict) -> tuple[dict, np.ndarray]:
        length, sym = np.frombuffer(r["seg"], np.int64).reshape(-1, 4)[:, 3], np.frombuffer(r["sym"], "<i2")
        n = length + 1
        within = np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)
        # more than the symbols that are there are never needed: a window ends within its string
        return {"at": np.arange(len(sym)), "h1": _hashes(sym, size, 0), "h2": _hashes(sym, size, 1)}, within + size <= np.repeat(length, n)

    def compare(t: pa.Table, n: np.ndarray, held: dict[str, np.ndarray], order: np.ndarray) -> list:
        numbers, whose = np.unique(t["bundle"].to_numpy(), return_inverse=True)
        place = (np.repeat(whose, n) << 32 | held["at"])[order]
        h1, h2 = held["h1"][order], held["h2"][order]
        run = np.cumsum(np.r_[False, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        first = np.flatnonzero(np.r_[True, np.diff(run) > 0])
        low = np.minimum.reduceat(place, first)
        edge = (run == 0) | (run == run[-1])  # may go on in the neighbouring partitions
        runs, owns, starts = [], [], []
        for which, chosen in ((-1, ~edge & (place > low[run])), (0, run == 0), (int(run[-1]), (run == run[-1]) & (run > 0))):
            own = np.sort(place[chosen])
            starts.append(np.flatnonzero(_new(own >> 32)) + sum(map(len, owns)))
            owns.append(own)
            runs.append(np.full(len(starts[-1]), which))
        own, start, ends = np.concatenate(owns), np.concatenate(starts), sorted({0, int(run[-1])})
        heads = [{"h1": int(h1[k]), "h2": int(h2[k]), "bundle": int(numbers[head >> 32]), "at": head & 0xFFFFFFFF} for k, head in ((first[w], int(low[w])) for w in ends)]
        return [
            np.full(len(start) + len(ends), t["p"][0].as_py()), np.concatenate([*runs, ends]),
            pa.concat_arrays([pa.array(numbers[own[start] >> 32], pa.int64()), pa.nulls(len(ends), pa.int64())]),
            pa.concat_arrays([_packed((own & 0xFFFFFFFF).astype("<i4"), np.r_[start, len(own)]), pa.nulls(len(ends), pa.binary())]),
            [None] * len(start) + heads,
        ]

    schema = "p int, run int, bundle long, at binary, head struct<h1:long,h2:long,bundle:long,at:long>"
    out = written(_suffixes(samples, "<i2", kind, count, total, compare, {"at": "<i4", "h1": "<i8", "h2": "<i8"}, more, schema), "compared")
    forget(spark, samples)
    # two runs of each range partition at most; a run over many partitions comes down to its earliest member
    ends = out.where("head is not null").select("p", "run", "head.h1", "head.h2", F.struct("head.bundle", "head.at").alias("own"))
    heads = ends.join(ends.groupBy("h1", "h2").agg(F.min("own").alias("first")), ["h1", "h2"]).select("p", "run", "first")
    inner = out.where("head is null and run = -1").select("bundle", "at", F.lit(-1).cast("long").alias("number"), F.lit(-1).cast("long").alias("head"))
    outer = out.where("head is null and run >= 0").join(heads, ["p", "run"]).select("bundle", "at", F.col("first.bundle").alias("number"), F.col("first.at").alias("head"))

    def spread(r: dict, lists: pa.Table) -> list | None:
        seg = np.frombuffer(r["seg"], np.int64).reshape(-1, 4)
        own, n = _values(lists["at"], "<i4")
        number, at = (np.repeat(lists[c].to_numpy(), n) for c in ("number", "head"))  # of the run's earliest member, where that isn't known to be another
        own = np.sort(own[(number != r["bundle"]) | (at != own)].astype(np.int64))
        if not len(own):
            return None
        begin = np.cumsum(seg[:, 3] + 1) - (seg[:, 3] + 1)
        a, z = _runs(own)
        which = np.searchsorted(begin, a, side="right") - 1  # a window ends within its string: so does a run of starts
        shift = seg[which, 2] - begin[which]
        rows, start = which[new := _new(which)], np.flatnonzero(new)
        runs = pa.ListArray.from_arrays(np.r_[start, len(a)].astype(np.int32), pa.array((a + shift) << 32 | (z + shift), pa.int64()))
        return [seg[rows, 0], seg[rows, 1], runs]

    found = written(_bundled(places, inner.unionByName(outer), spread, spans), "sorted")
    forget(spark, out, places)
    return found
