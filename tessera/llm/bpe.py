"""Byte-level BPE through a sentencepiece model that is serialised straight from the ranks.

A rank file (base64 piece, rank) becomes a sentencepiece ``ModelProto``: each byte is mapped
to one printable character, each piece is scored by its negative rank, and normalisation is
the identity. A text is cut into pre-tokens by the vocabulary's pattern; each pre-token that
is not itself a piece is encoded by the model, and ids are decoded by the inverse mapping.

Nulls: a null text counts as empty and gives no ids. Repeated rows, any ids (null too) and
further columns do not matter: each row is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import fresh, kinds, map_rows, small_batches, texts

#: Distinct pre-tokens a worker remembers; beyond it the memory is emptied and refilled.
CACHE_WORDS = 400_000
#: Pre-tokens longer than this are not remembered.
CACHE_CHARS = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes as length-delimited, int as varint, float as fixed32."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        import struct

        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The ``ModelProto``: pieces in the order of their ranks, then the unknown piece.

    Fields (sentencepiece_model.proto): pieces 1 {piece 1, score 2, type 3}, trainer_spec 2
    {model_type 3, vocab_size 4, byte_fallback 35, unk_id 40, bos_id 41, eos_id 42, pad_id 43},
    normalizer_spec 3 {name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5}.
    """
    chars, none = byte_characters(), (1 << 64) - 1
    pieces = b"".join(
        _field(1, _field(1, "".join(map(chars.__getitem__, p)).encode()) + _field(2, float(-r)) + _field(3, 1))
        for p, r in sorted(ranks.items(), key=lambda x: x[1])
    )
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(ranks)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(35, 0) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normal)


class ByteBpe:
    """Encodes and decodes texts by the ranks of one file."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.chars = byte_characters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        order = sorted(ranks.values())
        #: rank of each model id; None where they are the same
        self.ranks = None if order == list(range(len(order))) else order
        self.split = regex.compile(pattern).findall
        self.whole = ranks
        self.pieces = {r: p for p, r in ranks.items()}
        self.names = {r: str(r) for r in ranks.values()}
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.chars)})
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        out, rest = {}, []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            if (r := self.whole.get(data)) is not None:
                out[w] = (r,)
            else:
                rest.append((w, data.decode("latin-1").translate(self.table)))
        if rest:
            for (w, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1), strict=True):
                out[w] = tuple(ids) if self.ranks is None else tuple(self.ranks[i] for i in ids)
        return out

    def encode_batch(self, items: list[str]) -> list[list[int]]:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known, out = self.known, []
        for text in items:
            words = self.split(text)
            new = set(words).difference(known)
            if new:
                found = self._learn(new)
                long = [w for w in found if len(w) > CACHE_CHARS]
                known.update(found)
                out.append(list(chain.from_iterable(map(known.__getitem__, words))))
                for w in long:
                    del known[w]
            else:
                out.append(list(chain.from_iterable(map(known.__getitem__, words))))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Inverse mapping: the pieces' bytes."""
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each Python worker."""
    return ByteBpe(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids): the token ids of each text."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(keys: list, items: list) -> list[tuple]:
        return list(zip(keys, coder(path, pattern).encode_batch(items), strict=True))

    return map_rows(texts(df, key, text=text), run, f"`{key}` {kind}, ids array<int>")


def encode_rows(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All rows and columns with ``n_tokens``, ``ids`` and ``exact`` (decoding gives the text's bytes); names in use get an underscore."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)
    names = [fresh(n, df.columns) for n in ("n_tokens", "ids", "exact")]

    def run(*cols: list) -> list[tuple]:
        c = coder(path, pattern)
        items = [x or "" for x in cols[at]]
        ids = c.encode_batch(items)
        exact = [c.decode_bytes(i) == x.encode("utf-8", "surrogatepass") for i, x in zip(ids, items, strict=True)]
        return list(zip(*cols, map(len, ids), ids, exact, strict=True))

    return map_rows(df, run, f"{kinds(df)}, `{names[0]}` long, `{names[1]}` array<int>, `{names[2]}` boolean")


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text, data): the bytes of each id list, and as UTF-8."""
    kind = df.schema[key].dataType.simpleString()

    def run(keys: list, lists: list) -> list[tuple]:
        data = [coder(path, pattern).decode_bytes(x or []) for x in lists]
        return [(k, d.decode("utf-8", "replace"), d) for k, d in zip(keys, data, strict=True)]

    return map_rows(df.select(key, ids), run, f"`{key}` {kind}, text string, data binary")


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text encoded and its ids decoded again: (key, n_tokens, ids_sha256, decoded_sha256)."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(keys: list, items: list) -> list[tuple]:
        c = coder(path, pattern)
        out = []
        for k, ids in zip(keys, c.encode_batch(items), strict=True):
            written = " ".join(map(c.names.__getitem__, ids)).encode()
            out.append((k, len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(c.decode_bytes(ids)).hexdigest()))
        return out

    return map_rows(texts(df, key, text=text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
