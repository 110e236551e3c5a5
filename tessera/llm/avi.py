"""AVI motion-JPEG columns: RIFF index parsing, intra-frame decoding, shots as timed clip rows.

Reading: ``parse_avi`` walks the RIFF chunks and takes the frames that ``idx1`` lists;
``decode_frames`` decodes each frame by itself (lossless SOF3 with predictor 1, and baseline
SOF0 luma); ``shots`` cuts where the histogram difference of neighbouring frames exceeds an
adaptive threshold (mean plus ``k`` deviations of the differences around it).

Writing: ``payload_avi`` keeps bytes as 8-bit grey samples of 16x12 frames in lossless JPEG.
Its Huffman table gives category s (s magnitude bits follow) a code of 9 - s bits, so that
each sample takes nine bits; frames whose table has such a fixed sum are decoded as arrays.

Nulls: a null text is empty, a null media column gives no clip rows. A container that is
not a valid AVI gives one row with a null clip and the reason in ``error``. Equal inputs
give equal rows; further columns are left aside.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, texts

WIDTH, HEIGHT, FPS = 16, 12, 25
SAMPLES = WIDTH * HEIGHT
BINS = 16
#: Frames on each side that set a cut's threshold, deviations above their mean, least difference (of 2).
WINDOW, DEVIATIONS, LEAST = 12, 2.0, 0.5

#: Code lengths by category: 0 takes nine bits, s takes 9 - s bits before its s magnitude bits.
_LENGTHS = [9, 8, 7, 6, 5, 4, 3, 2, 1]
#: T.81 zig-zag order: fixed values.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]


class BadMedia(ValueError):
    """The bytes are not an AVI (or JPEG) this reader can decode."""


def _canonical(counts: list[int], symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a JPEG Huffman table."""
    code, out, it = 0, {}, iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = next(it)
            code += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _writer_header(width: int, height: int) -> bytes:
    counts = [_LENGTHS.count(n) for n in range(1, 17)]
    symbols = bytes(sorted(range(9), key=lambda s: (_LENGTHS[s], s)))
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + bytes(counts) + symbols)
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


def _code_table() -> np.ndarray:
    """For a difference d at index d + 255: its nine bits."""
    counts = [_LENGTHS.count(n) for n in range(1, 17)]
    codes = {s: c for (_, c), s in _canonical(counts, bytes(sorted(range(9), key=lambda s: (_LENGTHS[s], s)))).items()}
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        out[d + 255] = codes[s] << s | (d if d >= 0 else d + (1 << s) - 1)
    return out


_CODES, _HEADER = _code_table(), _writer_header(WIDTH, HEIGHT)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_frames(samples: bytes) -> list[bytes]:
    """Lossless JPEG frames of 16x12 samples each; the length must be a multiple of 192."""
    a = np.frombuffer(samples, np.uint8).reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    d = np.empty_like(a)
    d[:, :, 1:] = a[:, :, 1:] - a[:, :, :-1]
    d[:, 1:, 0] = a[:, 1:, 0] - a[:, :-1, 0]
    d[:, 0, 0] = a[:, 0, 0] - 128
    c = _CODES[d.reshape(len(a), -1, 8) + 255]
    out = np.empty((len(a), SAMPLES // 8, 9), np.uint8)
    out[:, :, 0] = c[:, :, 0] >> 1
    for j in range(1, 8):
        out[:, :, j] = (c[:, :, j - 1] << (8 - j) & 0xFF) | c[:, :, j] >> (j + 1)
    out[:, :, 8] = c[:, :, 7] & 0xFF
    rows = out.reshape(len(a), -1)
    return [_HEADER + r.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for r in rows]


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """A RIFF AVI with one MJPG stream and an ``idx1`` index."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.fromiter(map(len, frames), np.uint32, len(frames))
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    steps = sizes + (sizes & 1) + 8
    index[1:, 2] = np.cumsum(steps[:-1])
    index[:, 2] += 4
    movi = b"movi" + b"".join(b"00dc%b%b%b" % (struct.pack("<I", len(f)), f, b"\0" * (len(f) & 1)) for f in frames)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes()))


def payload_avi(payload: bytes) -> bytes:
    return write_avi(encode_frames(payload), WIDTH, HEIGHT)


def _chunks(data: bytes, at: int, end: int):
    """(name, start, size) of each RIFF chunk in a range."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise BadMedia(f"chunk {name!r} runs past its parent")
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames of the first video stream in the order of ``idx1``."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("no RIFF AVI header")
    fps, movi, index, stream, video = 0.0, None, None, 0, None
    for name, at, size in _chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n2, a2, s2 in _chunks(data, at + 4, at + size):
                if n2 == b"avih" and s2 >= 4 and (micros := struct.unpack_from("<I", data, a2)[0]):
                    fps = fps or 1e6 / micros
                if n2 == b"LIST" and data[a2 : a2 + 4] == b"strl":
                    for n3, a3, s3 in _chunks(data, a2 + 4, a2 + s2):
                        if n3 == b"strh" and s3 >= 28 and data[a3 : a3 + 4] == b"vids" and video is None:
                            video = stream
                            scale, rate = struct.unpack_from("<II", data, a3 + 20)
                            fps = rate / scale if scale and rate else fps
                    stream += 1
        elif name == b"LIST" and kind == b"movi":
            movi = at
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 16 * 4, at).reshape(-1, 4)
    if movi is None or index is None or video is None:
        raise BadMedia("no movi list, index or video stream")
    ours = {int.from_bytes(b"%02d%b" % (video, t), "little") for t in (b"dc", b"db")}
    rows = [(int(o), int(n)) for k, _, o, n in index.tolist() if k in ours]
    base = movi if not rows or data[movi + rows[0][0] : movi + rows[0][0] + 2] == b"%02d" % video else 0
    frames = []
    for o, n in rows:
        if struct.unpack_from("<I", data, base + o + 4)[0] != n or base + o + 8 + n > len(data):
            raise BadMedia("index and chunk sizes differ")
        frames.append(data[base + o + 8 : base + o + 8 + n])
    return fps or float(FPS), frames


class _Tables:
    """What a frame's header says."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise BadMedia("no JPEG start")
        at, self.huff, self.quant, self.frame, self.restart = 2, {}, {}, None, 0
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise BadMedia("broken JPEG header")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if marker == 0xC4:
                p = 0
                while p < len(body):
                    counts = list(body[p + 1 : p + 17])
                    self.huff[body[p]] = _canonical(counts, body[p + 17 : p + 17 + sum(counts)])
                    p += 17 + sum(counts)
            elif marker == 0xDB:
                p = 0
                while p < len(body):
                    wide = body[p] >> 4
                    self.quant[body[p] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, p + 1).astype(np.int32)
                    p += 1 + 64 * (1 + wide)
            elif marker in (0xC0, 0xC1, 0xC3):
                self.kind = marker
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if bits != 8:
                    raise BadMedia("only 8-bit samples")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise BadMedia(f"JPEG process {marker:#x}")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                self.predictor = body[1 + 2 * body[0]]
                self.start = at + 2 + size
                break
            at += 2 + size
        if not self.frame:
            raise BadMedia("no frame header")
        if self.restart:
            raise BadMedia("restart intervals are not supported")
        self.fixed = None
        if self.kind == 0xC3:
            table = self.huff[self.scan[0][1] << 4]
            sums = {n + s for (n, _), s in table.items()}
            if len(self.frame) == 1 and self.predictor == 1 and len(sums) == 1 and (bits := sums.pop()) == 9:
                lut = np.full(1 << bits, 32767, np.int16)
                for (n, code), s in table.items():
                    for m in range(1 << s):
                        lut[code << s | m] = m if s == 0 or m >> (s - 1) else m - (1 << s) + 1
                self.fixed = lut


def _bits(scan: bytes):
    """A reader of Huffman symbols and magnitudes."""
    n, value, at = len(scan) * 8, int.from_bytes(scan, "big"), 0

    def take(k: int) -> int:
        nonlocal at
        if at + k > n:
            raise BadMedia("scan ends early")
        at += k
        return value >> (n - at) & ((1 << k) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (s := table.get((length, code))) is not None:
                return s
        raise BadMedia("no such code")

    def number(s: int) -> int:
        if not s:
            return 0
        m = take(s)
        return m if m >> (s - 1) else m - (1 << s) + 1

    return symbol, number


def _lossless(t: _Tables, scan: bytes) -> np.ndarray:
    symbol, number = _bits(scan)
    if len(t.frame) != 1:
        raise BadMedia("lossless frames of one component only")
    table, out = t.huff[t.scan[0][1] << 4], np.zeros((t.height, t.width), np.int32)
    for y in range(t.height):
        for x in range(t.width):
            if y == 0:
                p = 128 if x == 0 else out[0, x - 1]
            elif x == 0:
                p = out[y - 1, 0]
            else:
                a, b, c = int(out[y, x - 1]), int(out[y - 1, x]), int(out[y - 1, x - 1])
                p = [0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1][t.predictor]
            out[y, x] = p + number(symbol(table)) & 0xFFFF
    return out.astype(np.uint8)


def _baseline(t: _Tables, scan: bytes) -> np.ndarray:
    """The first component of a baseline frame."""
    symbol, number = _bits(scan)
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    h, v = max(c[1] for c in t.frame), max(c[2] for c in t.frame)
    wide, high = -(-t.width // (8 * h)), -(-t.height // (8 * v))
    luma = t.frame[0]
    out, last = np.zeros((high * 8 * luma[2], wide * 8 * luma[1])), [0] * len(t.frame)
    for my in range(high):
        for mx in range(wide):
            for i, (_, ch, cv, q) in enumerate(t.frame):
                _, dc, ac = t.scan[i]
                for by in range(cv):
                    for bx in range(ch):
                        block = np.zeros(64)
                        last[i] += number(symbol(t.huff[dc]))
                        block[0], p = last[i] * t.quant[q][0], 1
                        while p < 64:
                            s = symbol(t.huff[16 | ac])
                            if s == 0:
                                break
                            p += s >> 4
                            if s & 15:
                                if p > 63:
                                    raise BadMedia("coefficients run over")
                                block[ZIGZAG[p]] = number(s & 15) * t.quant[q][p]
                            p += 1
                        if i == 0:
                            y, x = 8 * (my * cv + by), 8 * (mx * ch + bx)
                            out[y : y + 8, x : x + 8] = basis @ block.reshape(8, 8) @ basis.T + 128
    return np.clip(np.rint(out[: t.height, : t.width]), 0, 255).astype(np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(frames, height, width) of 8-bit luma; every frame is decoded from its own bytes."""
    if not frames:
        return np.zeros((0, 1, 1), np.uint8)
    out: list[np.ndarray] = []
    at = 0
    while at < len(frames):
        t = _Tables(frames[at])
        head, end = frames[at][: t.start], at + 1
        while end < len(frames) and frames[end].startswith(head):
            end += 1
        scans = [f[t.start : f.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff") for f in frames[at:end]]
        n = t.width * t.height
        if t.fixed is not None and n % 8 == 0:
            if any(len(s) != n // 8 * 9 for s in scans):
                raise BadMedia("scan length")
            b = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 9).astype(np.uint16)
            code = np.empty((len(b), 8), np.uint16)
            for j in range(8):
                code[:, j] = (b[:, j] << (j + 1) | b[:, j + 1] >> (7 - j)) & 511
            d = t.fixed[code]
            if (d == 32767).any():
                raise BadMedia("no such code")
            d = d.reshape(len(scans), t.height, t.width).astype(np.int32)
            d[:, 0, 0] += 128
            d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
            out.append((np.cumsum(d, axis=2) & 0xFFFF).astype(np.uint8))
        else:
            one = _lossless if t.kind == 0xC3 else _baseline
            out += [one(t, s)[None] for s in scans]
        at = end
    if len({x.shape[1:] for x in out}) > 1:
        raise BadMedia("frames differ in size")
    return np.concatenate(out)


def shots(pictures: np.ndarray, window: int = WINDOW, deviations: float = DEVIATIONS, least: float = LEAST) -> list[tuple[int, int, float]]:
    """(first frame, end frame, difference at its cut) of each shot.

    A cut stands before frame i when its histogram difference to frame i - 1 is the largest
    within ``window`` frames on each side (the first of equal ones) and above the larger of
    ``least`` and the mean plus ``deviations`` standard deviations of the other differences there.
    """
    n = len(pictures)
    if not n:
        return []
    size = pictures[0].size
    key = (pictures.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(key.ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / size
    cuts = []
    for i in np.flatnonzero(d > least).tolist():
        lo = max(0, i - window)
        near = d[lo : i + window + 1]
        if near.argmax() == i - lo:
            rest = np.delete(near, i - lo)
            if not len(rest) or d[i] > rest.mean() + deviations * rest.std():
                cuts.append(i + 1)
    edges = [0, *cuts, n]
    return [(a, b, float(d[a - 1]) if a else 0.0) for a, b in zip(edges, edges[1:], strict=False)]


CLIPS = "clip long, first_frame long, end_frame long, start_s double, end_s double, cut_difference double, error string"


def clips(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Timed clip rows of a binary AVI column: (key, clip, first_frame, end_frame, start_s, end_s, cut_difference, error)."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(keys: list, blobs: list) -> list[tuple]:
        out = []
        for k, data in zip(keys, blobs, strict=True):
            if data is None:
                continue
            try:
                fps, frames = parse_avi(data)
                out += [(k, i, a, b, a / fps, b / fps, x, None) for i, (a, b, x) in enumerate(shots(decode_frames(frames)))]
            except (BadMedia, struct.error, KeyError, IndexError, ValueError) as e:
                out.append((k, None, None, None, None, None, None, str(e)))
        return out

    return map_rows(df.select(key, media), run, f"`{key}` {kind}, {CLIPS}")


def stored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's payload as an AVI: (key, n_bytes, media). The payload is padded by spaces to whole frames."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(keys: list, items: list) -> list[tuple]:
        return [(k, len(b := t.encode()), payload_avi(pad(b))) for k, t in zip(keys, items, strict=True)]

    return map_rows(texts(df, key, text=text), run, f"`{key}` {kind}, n_bytes long, media binary")


def pad(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // SAMPLES)) * SAMPLES)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored as AVI and read back: sizes, digests, and the shots as ``feature``."""
    kind = df.schema[key].dataType.simpleString()

    def run(keys: list, sizes: list, blobs: list) -> list[tuple]:
        out = []
        for k, n, media in zip(keys, sizes, blobs, strict=True):
            fps, frames = parse_avi(media)
            pictures = decode_frames(frames)
            back = pictures.tobytes()
            found = shots(pictures)
            said = ";".join(f"{a}-{b}@{a / fps:.2f}" for a, b, _ in found)
            feature = f"frames={len(pictures)} fps={fps:g} mean={int(pictures.sum(dtype=np.int64)) // pictures.size} shots={len(found)} {said}"
            out.append((k, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return out

    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(stored(df, key, text).select(F.col(key), "n_bytes", "media"), run, schema)
