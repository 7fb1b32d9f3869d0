import base64
import gzip
import hashlib
import io
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import warc_zip as w


def test_round_trip(spark):
    pages = [(1, "http://a/ b", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50_000), (6, "u\r\nX: y", "other\r\n\r\nlines"), (2**62, "u", "same"), (-7, "u", "neg"), (5, "u", "é" * 50_000), (None, "u", "same")]
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, payload int, HTML string").repartition(3)
    found = sorted((tuple(r) for r in w.round_trip(df).collect()), key=repr)
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -(2**63)), -(2**63) if i is None else i)
    expected = []
    for i, _, h in pages:
        raw = (h or "").encode()
        same = best[h or ""] == i
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else best[h or ""]))
    assert found == sorted(expected, key=repr)
    small = w.round_trip(df, min_bytes=100)
    assert small.filter("record_type = 'revisit'").count() == 0
    assert w.round_trip(df.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", "p" * i) for i in range(2000)], "page_id long, url string, html string").repartition(2)
    archives = w.write_archives(df, f"file://{tmp_path}/a")
    rows = w.read_archives(archives).orderBy("page_id").collect()
    assert [(r.page_id, r.url, bytes(r.payload)) for r in rows] == [(i, f"http://x/{i}", b"p" * i) for i in range(2000)]
    path = archives.first()["path"].removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # any ZIP and gzip reader can open it
        assert z.namelist() == [w.DATA, w.INDEX] and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert gzip.decompress(z.read(w.DATA)).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_directories():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr("naïve.txt", b"abc")
        z.comment = b"PK\x05 a comment"
    file = pa.BufferReader(plain.getvalue())
    found = w.members(file)
    at, size = w.locate(file, found["naïve.txt"])
    assert file.read_at(size, at) == b"abc"
    # The same archive with ZIP64 records and every 32-bit field saturated.
    data = b"hello"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 5, 5, 1, 0) + b"m" + data
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = pa.BufferReader(local + central + end64 + locator + end)
    at, size = w.locate(file, w.members(file)["m"])
    assert file.read_at(size, at) == data
    with pytest.raises(ValueError):
        w.members(pa.BufferReader(b"not a zip"))
    with pytest.raises(ValueError):
        w.locate(file, (0, 5, 8))


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "payload " * 50)], "page_id long, url string, html string")
    archives = w.write_archives(df, f"file://{tmp_path}/d")
    record = w.make_record(1, "u", b"abc", w.payload_digest(b"abd"), None, False)
    assert w.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        w.parse_record(record[:-3])
    path = archives.first()["path"].removeprefix("file://")
    w.write_archive(path, [(1, record)])
    with pytest.raises(Exception, match="damaged payload"):
        w.read_archives(archives).select(F.count("page_id"), F.max("payload")).collect()
