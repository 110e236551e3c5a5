"""WARC archives in Zstandard: one frame a record, the dictionary in the leading skippable frame.

Writing packs rows into archives of bounded size in the shared folder; each archive starts with
a skippable frame (magic 0x184D2A5D) that holds its dictionary, fitted on the archive's first
records (at most ``DICT_RECORDS``). Reading loads that dictionary, walks the frames' block
headers, decodes one frame at a time, and validates the version line, header fields, lengths,
the record's end and the payload's digest. A record that breaks the format is returned as an error
with its archive and offset, and reading goes on behind it; only where the frames themselves can't
be told apart does an archive end early. Tasks name their archives by attempt, and what they return
is the manifest that is read: archives of failed attempts are never looked at.

Records with equal payloads: that with the smallest id is a response, the others revisit it. Rows
that repeat the smallest id are responses as well. A null payload is empty; a row with a null id
gets a record, and revisits an equal payload's smallest id if there is one. Empty tables give no
archive and no rows. Further columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, forget, shared_dir, whole_key, written

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Payload bytes after which a new archive begins; records and dictionary bytes for its fitting.
ARCHIVE_BYTES, DICT_RECORDS, DICT_BYTES = 8 << 20, 128, 16 << 10
LEVEL, DATE = 3, "2024-01-01T00:00:00Z"
_ID = re.compile(rb"<urn:x-record:(-?\d*)>\Z")


class BadArchive(ValueError):
    """The archive breaks the format; the message says where."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(key: int | None) -> str:
    return f"<urn:x-record:{'' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of the record ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\s<>]', lambda m: '%%%02X' % ord(m[0]), url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of these records."""
    head = records[:DICT_RECORDS]
    try:
        fitted = zstandard.train_dictionary(DICT_BYTES, head).as_bytes()
        book = zstandard.ZstdCompressionDict(fitted)
    except zstandard.ZstdError:  # too few or too small samples
        fitted = b"".join(head)[-DICT_BYTES:]
        book = zstandard.ZstdCompressionDict(fitted, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_checksum=True, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(fitted)) + fitted + b"".join(map(coder.compress, records))


def _frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts here ends, by its block headers."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        while True:
            head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
            pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
    except IndexError:
        raise BadArchive(f"a frame is cut off, at {at}") from None
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise BadArchive(f"a frame is cut off, at {at}")
    return pos


def frames(data: bytes) -> Iterator[tuple[int, bytes | BadArchive]]:
    """(offset, decoded frame) of an archive, one at a time; a frame that can't be decoded is given as an error."""
    at, decoder = 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise BadArchive(f"rest is no frame, at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise BadArchive(f"a skippable frame is cut off, at {at}")
            if at == 0 and magic == SKIPPABLE:
                raw = data[8 : 8 + size]
                if raw[:4] == struct.pack("<I", FRAME):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                fitted = raw[:4] == struct.pack("<I", 0xEC30A437)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if fitted else zstandard.DICT_TYPE_RAWCONTENT))
            at += 8 + size
            continue
        if magic != FRAME:
            raise BadArchive(f"no frame magic, at {at}")
        end = _frame_end(data, at)
        try:
            yield at, (decoder or zstandard.ZstdDecompressor()).decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            yield at, BadArchive(f"frame: {e}")
        at = end


def parse(data: bytes) -> dict:
    """A record's fields, validated: key, url, type, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise BadArchive("no WARC version line")
    fields: dict[bytes, bytes] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or not k.strip() or k != k.strip():
            raise BadArchive("malformed header field")
        fields[k.lower()] = v.strip()
    for k in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length"):
        if k not in fields:
            raise BadArchive(f"no {k.decode()}")
    if not fields[b"content-length"].isdigit() or len(rest) != (n := int(fields[b"content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("block length differs from Content-Length")
    key = _ID.match(fields[b"warc-record-id"])
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length:\s*(\d+)\s*$", http)
    if not key or not gap or not http.startswith(b"HTTP/") or not length:
        raise BadArchive("record id or HTTP header")
    kind, digest = fields[b"warc-type"].decode(), fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    refers = None
    if kind == "revisit":
        if payload or not (m := _ID.match(fields.get(b"warc-refers-to", b""))) or not m[1]:
            raise BadArchive("a revisit with payload or without reference")
        refers = int(m[1])
    elif kind != "response":
        raise BadArchive(f"record type {kind}")
    elif len(payload) != int(length[1]) or payload_digest(payload) != digest:
        raise BadArchive("payload length or digest")
    return {
        "key": int(key[1]) if key[1] else None, "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "type": kind,
        "refers_to": refers, "payload": None if refers is not None else payload, "payload_bytes": int(length[1]), "payload_digest": digest,
    }


def _store(folder: str):
    """A pyarrow file system and path for a folder of any scheme Spark shares."""
    from pyarrow import fs

    if folder.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def revisits(df: DataFrame, key: str, payload: str, at_least: int = 0) -> DataFrame:
    """(key, digest, refers_to) of the rows that repeat a payload of ``at_least`` bytes; keys are aggregated before any join."""
    own = df.select(F.col(key).alias("key"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= at_least)
    first = own.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null")
    return own.join(first, "digest").where("key is null or key <> refers_to").groupBy("key", "digest").agg(F.min("refers_to").alias("refers_to"))


@dataclass
class Archives:
    """A folder of archives and the manifest (archive, records) of those that count; without one all of the folder count."""

    folder: str
    manifest: DataFrame | None = None


def write(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> Archives:
    """Writes a record for each row; the archives are in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = df.select(whole_key(df, key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    links = written(revisits(rows, "key", "payload", at_least), "revisits")  # its size is known now: Spark broadcasts it only below its threshold
    rows = rows.withColumn("digest", F.sha1("payload")).alias("r").join(
        links.alias("l"), F.col("r.key").eqNullSafe(F.col("l.key")) & (F.col("r.digest") == F.col("l.digest")), "left"
    ).select("r.key", "r.url", "r.payload", "l.refers_to")

    def run(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        pending, size, said = [], 0, []

        def flush() -> None:
            nonlocal pending, size
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(said):05d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(pack(pending))
            said.append((name, len(pending)))
            pending, size = [], 0

        for b in batches_:
            for k, u, p, r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                pending.append(record(k, u, p, r))
                size += len(pending[-1])
                if size >= archive_bytes:
                    flush()
        if pending:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.int64())], names=["archive", "records"])

    with batches(spark):
        manifest = written(rows.mapInArrow(run, "archive string, records long"), "archives")
    forget(spark, links)
    return Archives(folder, manifest)


RECORD = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, error string, archive string, offset long"
#: Archives that one task reads, at least where there are many; records that go to Spark at once.
TASK_ARCHIVES, GIVEN = 4, 64


def records(data: bytes, archive: str, expected: int | None = None) -> Iterator[tuple]:
    """Rows of ``RECORD`` and the payload: the good records of an archive, and an error for each bad one."""
    wrong = lambda at, e: (*[None] * 6, str(e), archive, at, None)
    n = 0
    try:
        for at, raw in frames(data):
            n += 1
            try:
                if isinstance(raw, BadArchive):
                    raise raw
                r = parse(raw)
                yield r["key"], r["url"], r["type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None, archive, at, r["payload"]
            except BadArchive as e:
                yield wrong(at, e)
        if expected is not None and n != expected:
            yield wrong(len(data), f"{n} records where the manifest has {expected}")
    except BadArchive as e:
        yield wrong(None, e)


def read(spark: SparkSession, archives: Archives | str, payloads: bool = False) -> DataFrame:
    """The records of the archives; each bad record is a row with ``error``, ``archive`` and ``offset``."""
    archives = Archives(archives) if isinstance(archives, str) else archives
    schema = RECORD + (", payload binary" if payloads else "")
    store, base = _store(archives.folder)
    from pyarrow import fs
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if store.get_file_info(base).type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    if archives.manifest is None:
        named = [f.base_name for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".warc.zst")]
        names = spark.createDataFrame([(x, None) for x in sorted(named)], "archive string, records long")
    else:
        names = archives.manifest
    folder, arrow = archives.folder, to_arrow_schema(_parse_datatype_string(schema))

    def run(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=False)], schema=arrow)

        for b in batches_:
            for name, expected in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:  # one archive at a time
                    data = f.read()
                held = []
                for row in records(data, name, expected):
                    held.append(row)
                    if len(held) == GIVEN:
                        yield given(held)
                        held = []
                if held:
                    yield given(held)

    tasks = max(spark.sparkContext.defaultParallelism, -(-names.count() // TASK_ARCHIVES))
    return names.select("archive", "records").repartition(tasks).mapInArrow(run, schema)


def remove(spark: SparkSession, archives: Archives) -> None:
    """Delete the archives and their manifest."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(archives.folder)
    path.getFileSystem(conf).delete(path, True)
    if archives.manifest is not None:
        forget(spark, archives.manifest)


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", at_least: int = 0) -> DataFrame:
    """Writes all rows as archives and returns what reading them back says; the archives are deleted after that."""
    spark = df.sparkSession
    archives = write(df, key, url, payload, at_least)
    back = read(spark, archives).select(F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    back = written(back, "records")
    remove(spark, archives)
    return back
