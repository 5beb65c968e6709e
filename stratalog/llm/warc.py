"""WARC records in ZIP packages: written by tasks, read back by byte range.

Every task writes packages of its own: a ZIP with two stored members, the WARC
file (each record gzipped on its own, so that it can be read alone) and an index
of record offsets. A package gets a new name for every attempt, and only names
that a finished task has returned are in the manifest, so a lost executor leaves
at most files that nobody reads.

Reading goes the other way: the end of each package gives the central directory
(ZIP64 where sizes, counts or offsets need it), the directory gives the stored
members, the index member gives each record's range, and those ranges are dealt
to tasks that read just them. Nothing is extracted.

Paths are URIs of the shared folder; files are opened with pyarrow's filesystems.

Defined results: a null payload is empty, a null url, id or reference is left out
of the headers and read back as null; empty tables give an empty manifest and no
records; repeated rows give a record each; further columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import settle_table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/records.jsonl"
PACKAGE_BYTES = 256 << 20
MIN_REVISIT_BYTES = 100
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode()
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(df: DataFrame, page: str = "page_id", payload: str = "payload") -> DataFrame:
    """All columns and payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES``, those with the
    smallest page id are responses and the others revisit it. Rows without an id
    come last; if no row of a payload has one, all are responses.
    """
    sized = df.withColumns({"payload_bytes": F.length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    firsts = sized.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min(page).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # only digests that come more than once: written, so that the join knows how few they are
    firsts = settle_table(firsts.where("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first"), "repeated-payloads")
    joined = sized.join(firsts, sized["payload_digest"] == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col(page).eqNullSafe(F.col("_first"))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_first"))}).drop("_digest", "_first")


def _header(value) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if c >= " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in str(value))


def record_bytes(page, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    block = _HEAD + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Target-URI", url),
        ("X-Page-Id", page),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", len(payload)),
        ("WARC-Profile", _PROFILE if kind == "revisit" else None),
        ("X-Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_header(v)}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one gzipped record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _plain(value: str | None) -> str | None:
    from urllib.parse import unquote

    return None if value is None else unquote(value)


def write_archives(df: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the records of ``df`` (page_id, url, payload and the columns of ``record_types``); gives the manifest: path, records."""
    source = df.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get().partitionId()
        paths, counts = [], []
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(rows, None)
        while row is not None:
            name = f"part-{task:06d}-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{root}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
                index, at = [], 0
                with package.open(ARCHIVE, "w", force_zip64=True) as member:
                    while row is not None and at < package_bytes:
                        record = record_bytes(*row)
                        member.write(record)
                        index.append(json.dumps({"offset": at, "length": len(record)}))
                        at += len(record)
                        row = next(rows, None)
                package.writestr(INDEX, "\n".join(index))
            paths.append(f"{folder.rstrip('/')}/{name}")
            counts.append(len(index))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return settle_table(source.mapInArrow(run, "path string, records long"), "warc-manifest")


@dataclass
class Member:
    """A ZIP member: its name, compression method, packed size and the place of its local header."""

    name: str
    method: int
    size: int
    header: int


def directory(source: io.RawIOBase, size: int) -> list[Member]:
    """The members of a ZIP of ``size`` bytes, from its central directory."""
    tail = min(size, 22 + 0xFFFF + 20)
    source.seek(size - tail)
    end = source.read(tail)
    at = end.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(end[at + 20 : at + 22], "little") != len(end):
        at = end.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", end[at + 10 : at + 20])
    if (count == 0xFFFF or 0xFFFFFFFF in (length, start)) and at >= 20 and end[at - 20 : at - 16] == b"PK\x06\x07":
        (place,) = struct.unpack("<Q", end[at - 12 : at - 4])
        source.seek(place)
        wide = source.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    source.seek(start)
    raw, members, at = source.read(length), [], 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full = struct.unpack("<H8xII", raw[at + 10 : at + 28])
        names, extras, comments = struct.unpack("<HHH", raw[at + 28 : at + 34])
        (header,) = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + names].decode()
        extra, k = raw[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[k : k + 4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[k + 4 : k + 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + n
        members.append(Member(name, method, packed, header))
        at += 46 + names + extras + comments
    return members


def stored_start(source: io.RawIOBase, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed")
    source.seek(member.header)
    local = source.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack("<HH", local[26:30]))


def record_ranges(source: io.RawIOBase, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of each record, from the index member."""
    members = {m.name: m for m in directory(source, size)}
    base, index = stored_start(source, members[ARCHIVE]), members[INDEX]
    source.seek(stored_start(source, index))
    for line in source.read(index.size).decode().splitlines():
        entry = json.loads(line)
        yield base + entry["offset"], entry["length"]


def index_archives(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row per record: path, offset, length."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(name)
                with store.open_input_file(place) as source:
                    ranges = list(record_ranges(source, source.size()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ranges), pa.string()), pa.array([r[0] for r in ranges], pa.int64()), pa.array([r[1] for r in ranges], pa.int64())], names=["path", "offset", "length"])

    return paths.select(path).mapInArrow(run, "path string, offset long, length long")


#: Bytes of records read together, and at most by one task.
READ_BLOCK, READ_TASK = 4 << 20, 128 << 20
_READ = "page_id long, url string, record_type string, refers_to long, payload binary, stated_bytes long, stated_digest string"


def read_records(ranges: DataFrame) -> DataFrame:
    """Read each range of ``ranges`` (path, offset, length) on its own; neighbouring records go to one task.

    The number of tasks follows the bytes of the records, not those of the ranges.
    """
    ranges = settle_table(ranges, "warc-ranges")
    size = ranges.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shuffle = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    tasks = max(1, -(-size // READ_TASK), min(shuffle, -(-size // READ_BLOCK)))
    dealt = ranges.repartition(tasks, "path", F.expr(f"offset div {READ_BLOCK}")).sortWithinPartitions("path", "offset")
    names = [f.split()[0] for f in _READ.split(", ")]

    def run(batches):
        open_path, source, store = None, None, None
        for batch in batches:
            out, held = [], 0
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != open_path:
                    if source is not None:
                        source.close()
                    store, place = fs.FileSystem.from_uri(name)
                    open_path, source = name, store.open_input_file(place)
                fields, payload = parse_record(source.read_at(length, offset))
                number = {k: None if fields.get(k) is None else int(fields[k]) for k in ("X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Length")}
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                out.append((number["X-Page-Id"], _plain(fields.get("WARC-Target-URI")), fields["WARC-Type"], number["X-Refers-To-Page-Id"], payload, number["X-Payload-Length"], digest))
                held += len(payload)
                if held > READ_BLOCK:
                    yield _batch(out, names)
                    out, held = [], 0
            if out:
                yield _batch(out, names)
        if source is not None:
            source.close()

    return dealt.select("path", "offset", "length").mapInArrow(run, _READ)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
