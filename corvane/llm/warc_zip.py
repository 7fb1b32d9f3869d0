"""WARC records in ZIP archives, written and read back by range without extraction.

An archive holds two stored members: ``archive/data.warc.gz``, every record a
gzip member of its own, and ``indexes/index.cdxj``, a line for each record with
its place. The reader finds the end-of-central-directory record (and its ZIP64
form), walks the central directory, locates both members, and then reads
records by the ranges that the index names. Archives live in the shared folder
or any file system that pyarrow opens.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, cut, narrow, new_folder, remove

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of whole records read at once; archives or ranges of a task, about.
READ, EACH = 4 << 20, 8
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"  # pages carry no date
_NO_ID = 1 << 64


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- records


def record_id(page_id: int | None) -> str:
    """A record's URI, from which its page can be told again."""
    return f"<urn:uuid:{uuid.UUID(int=_NO_ID if page_id is None else page_id % _NO_ID)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip().removeprefix("<urn:uuid:").removesuffix(">")).int
    return None if n == _NO_ID else n - _NO_ID if n >= _NO_ID // 2 else n


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None, is_revisit: bool) -> bytes:
    """A response record with its payload, or a revisit of the record that has it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_clean(url)}"]
    if is_revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(revisits)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers by lower-case name, and the payload of a response. Raises ValueError on a broken record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode("latin-1").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k.lower() == "content-length":
            fields["payload-bytes"] = v.strip()
    return fields | {"payload": payload if fields["warc-type"] == "response" else None}


# --- archives


def write_archive(path: str, records: Iterable[tuple[int | None, bytes]]) -> int:
    """Stream (id, record) into a new archive; the number of records."""
    system, place = _open(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    lines, at = [], 0
    with system.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        with archive.open(DATA, "w", force_zip64=True) as member:
            for page_id, record in records:
                packed = gzip.compress(record, 1, mtime=0)
                member.write(packed)
                lines.append(json.dumps({"id": page_id, "offset": at, "length": len(packed)}))
                at += len(packed)
        archive.writestr(INDEX, "".join(f"{line}\n" for line in lines))
    return len(lines)


def members(file) -> dict[str, tuple[int, int, int]]:
    """The central directory, ZIP64 or not: name to (local header's offset, size, method)."""
    size = file.size()
    tail_at = max(0, size - 65_557)  # the end record with the longest comment
    tail = _read(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = tail_at + end - 20
        sign, _, at, _ = struct.unpack("<4sIQI", _read(file, locator, 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        sign, *_, count, length, start = struct.unpack("<4sQHHIIQQQQ", _read(file, at, 56))
        if sign != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
    directory, at, found = _read(file, start, length), 0, {}
    for _ in range(count):
        sign, _, _, flags, method, _, _, _, packed, full, n, extra, comment, _, _, _, offset = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, at)
        if sign != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more = directory[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:
            tag, width = struct.unpack_from("<HH", more)
            if tag == 1:  # what doesn't fit 32 bits, in this order
                wide = list(struct.unpack(f"<{width // 8}Q", more[4 : 4 + width // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            more = more[4 + width :]
        found[name] = (offset, packed, method)
        at += 46 + n + extra + comment
    return found


def locate(file, entry: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many there are."""
    offset, size, method = entry
    if method != 0:
        raise ValueError("a member that isn't stored can't be read by range")
    sign, n, extra = struct.unpack("<4s22xHH", _read(file, offset, 30))
    if sign != b"PK\x03\x04":
        raise ValueError("no local header")
    return offset + 30 + n + extra, size


def _read(file, at: int, n: int) -> bytes:
    data = file.read_at(n, at)
    if len(data) != n:
        raise ValueError("a truncated archive")
    return data


def record_ranges(path: str) -> Iterator[tuple[int, int]]:
    """Offset in the archive and length of runs of whole records, from its index."""
    system, place = _open(path)
    with system.open_input_file(place) as file:
        directory = members(file)
        start, _ = locate(file, directory[DATA])
        first, size = locate(file, directory[INDEX])
        at = length = 0
        for line in _read(file, first, size).splitlines():
            entry = json.loads(line)
            if length and (length + entry["length"] > READ or entry["offset"] != at + length):
                yield start + at, length
                length = 0
            if not length:
                at = entry["offset"]
            length += entry["length"]
        if length:
            yield start + at, length


def read_range(path: str, offset: int, length: int) -> Iterator[bytes]:
    """The records of a range."""
    system, place = _open(path)
    with system.open_input_file(place) as file:
        data = _read(file, offset, length)
    at = 0
    while at < len(data):
        member, parts = zlib.decompressobj(zlib.MAX_WBITS | 16), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("a broken gzip member")
            parts.append(member.decompress(data[at : at + 16384]))
            at = min(at + 16384, len(data)) - len(member.unused_data)
        yield b"".join(parts)


# --- Spark


def _writer(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("warc")
        # A new name for each attempt: only names in the written table count.
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zip"

        def records():
            for batch in batches:
                for row in zip(*(c for c in batch.columns)):
                    page_id, url, payload, sha1, revisits, is_revisit = (v.as_py() for v in row)
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    yield page_id, make_record(page_id, url, payload, digest, revisits, is_revisit)

        rows = records()
        first = next(rows, None)
        if first is not None:
            n = write_archive(path, _chain(first, rows))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return run


def _chain(first, rest):
    yield first
    yield from rest


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row; rows (path, records) of the archives written.

    The payload is the html in UTF-8, null as empty. Of records whose payloads
    of at least min_bytes are equal, the one with the largest id is a response
    and the others revisit it; rows that repeat that id are responses too, and
    rows without an id revisit. The folder must be shared by all machines.
    """
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = narrow(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # Payloads with one SHA-1, which the records carry, may differ; those with one SHA-256 don't.
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("bytes", F.octet_length("payload"))
    groups = rows.filter(F.col("bytes") >= min_bytes).groupBy("same").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.filter("n > 1").drop("n"), "equal")
    rows = rows.join(groups, "same", "left")
    is_revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    rows = rows.select("id", "url", "payload", "sha1", "keeper", is_revisit.alias("is_revisit"))
    return cut(rows.mapInArrow(_writer(folder), "path string, records long"), "archives")


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            found = list(record_ranges(path))
            if found:
                at, length = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(length, pa.int64())], names=["path", "at", "length"])


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _reader(with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for record in read_range(path, at, length):
                    fields = parse_record(record)
                    payload, digest = fields["payload"], fields["warc-payload-digest"].removeprefix("sha1:")
                    n = int(fields["payload-bytes"])
                    if payload is not None and (len(payload) != n or payload_digest(payload) != digest):
                        raise ValueError(f"a damaged payload in {path}")
                    refers = fields.get("warc-refers-to")
                    rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], refers and page_of(refers), n, digest, payload if with_payload else None))
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in the column ``path``, read by range; payloads are checked against their digests.

    Ranges, not archives, are what tasks get, so a large archive is read by many.
    """
    paths = archives.select("path")
    ranges = cut(paths.repartition(_tasks(paths), "path").mapInArrow(_ranges, "path string, at long, length long"), "ranges")
    return ranges.repartition(_tasks(ranges), "path", "at").mapInArrow(_reader(with_payload), _READ)


def _tasks(rows: DataFrame) -> int:
    """Given by number, since rows that stand for megabytes are small themselves and would be merged into one task."""
    return rows.count() // EACH + EACH


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The archives are removed again. An empty table gives no rows, repeated rows
    a record each; rows without an id revisit, and are responses where no row
    with their payload has an id; other columns are ignored.
    """
    folder = new_folder(pages.sparkSession, "warc")
    try:
        records = read_archives(write_archives(pages, folder, min_bytes, **columns), with_payload=False)
        return cut(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    finally:
        remove(pages.sparkSession, folder)
