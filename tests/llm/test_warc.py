import gzip
import hashlib
import io
import zipfile

import pytest
from llm_helpers import prose
from stratalog.llm import warc
from stratalog.session import scratch


class Pipe(io.RawIOBase):
    """A sink that cannot seek, as object stores give."""

    def __init__(self):
        self.parts = []

    def writable(self):
        return True

    def write(self, data):
        self.parts.append(bytes(data))
        return len(data)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end"])
def test_directory_with_and_without_zip64(monkeypatch, wide, comment):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    sink = Pipe()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        for name, data in (("a.bin", b"x" * 100), ("é.bin", b""), ("c.bin", b"last")):
            with z.open(name, "w", force_zip64=wide) as member:
                member.write(data)
        z.writestr("packed", "z" * 500, zipfile.ZIP_DEFLATED)
    raw = b"".join(sink.parts)
    source = io.BytesIO(raw)
    members = {m.name: m for m in warc.directory(source, len(raw))}
    assert list(members) == ["a.bin", "é.bin", "c.bin", "packed"]
    assert (b"PK\x06\x06" in raw) == wide
    for name, data in (("a.bin", b"x" * 100), ("é.bin", b""), ("c.bin", b"last")):
        start = warc.stored_start(source, members[name])
        assert raw[start : start + members[name].size] == data
    with pytest.raises(ValueError, match="compressed"):
        warc.stored_start(source, members["packed"])
    with pytest.raises(ValueError, match="end of central directory"):
        warc.directory(io.BytesIO(b"no zip"), 6)


def test_one_record_is_readable_on_its_own():
    payload = b"a\r\n\r\nb\x00" * 50
    raw = warc.record_bytes(7, "http://x/\r\nInjected: y %41", payload, hashlib.sha256(payload).hexdigest(), "response", None)
    fields, found = warc.parse_record(raw)
    assert found == payload and warc._plain(fields["WARC-Target-URI"]) == "http://x/\r\nInjected: y %41" and "Injected" not in fields
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_write_and_read_back(spark):
    same, long = "s" * 100, prose(1, 40_000)
    rows = [(5, "u5", same), (3, "u3", same), (9, "u9", same), (1, "u1", "short"), (2, "u2", "short"), (4, None, None), (6, "u6", ""), (7, "u7", long), (8, "u8", long), (None, "n", same), (3, "u3", same)]
    df = spark.createDataFrame([(p, u, None if t is None else bytearray(t.encode()), "x", "y") for p, u, t in rows], "page_id long, url string, payload binary, path string, offset string")
    df = df.fillna({"offset": "x"}).selectExpr("page_id", "url", "coalesce(payload, cast('' as binary)) payload", "path", "offset").repartition(3)
    typed = warc.record_types(df)
    folder = scratch(spark, "warc-test")
    manifest = warc.write_archives(typed, folder, package_bytes=300)
    assert manifest.selectExpr("sum(records)").first()[0] == len(rows) and manifest.count() > 3
    found = sorted(((r.page_id, r.url, r.record_type, r.refers_to, len(r.payload), r.stated_bytes, r.stated_digest) for r in warc.read_records(warc.index_archives(manifest)).collect()), key=str)
    expected = []
    for p, u, t in rows:
        t = t or ""
        ids = [x[0] for x in rows if (x[2] or "") == t and x[0] is not None]
        revisit = len(t) >= 100 and p != min(ids)
        expected.append((p, u, "revisit" if revisit else "response", min(ids) if revisit else None, 0 if revisit else len(t.encode()), len(t.encode()), hashlib.sha256(t.encode()).hexdigest()))
    assert found == sorted(expected, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, payload binary")
    manifest = warc.write_archives(warc.record_types(df), scratch(spark, "warc-test"))
    assert manifest.count() == 0 and warc.read_records(warc.index_archives(manifest)).count() == 0
