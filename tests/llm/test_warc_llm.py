"""ZIP-packaged WARC archives: round trip, ZIP64 records, ranges."""

import hashlib
import io
import zipfile

import pytest

from sitelens.llm import warc
from sitelens.llm.storage import work_dir
from sitelens.llm.ziparchive import data_start, read_directory, zip_chunks

PAGES = "page_id long, url string, html string, digest string, key int"
LONG, OTHER = "<p>équal</p>" * 20, "<p>other</p>" * 30
ROWS = [
    (5, "http://a/", LONG),
    (3, "http://a/b c\r\nX: y", LONG),
    (9, None, LONG),
    (None, "http://n/", LONG),
    (3, "http://a/", LONG),
    (1, "http://s/", "short"),
    (2, "http://s/", "short"),
    (7, "http://e/", ""),
    (8, "http://e/", None),
    (10, "http://o/", OTHER),
    (None, None, "alone" * 30),
]


def expected():
    out = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == body and p is not None]
        first = min(same) if len(body) >= 100 and same else page
        revisit = first != page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, zip64):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], PAGES).repartition(3)
    folder = work_dir(spark, "test-warc")
    archives = warc.write_archives(df, folder, archive_bytes=400, zip64=zip64).collect()
    assert sum(a["records"] for a in archives) == len(ROWS) and len(archives) > 1
    got = warc.read_archives(spark, folder, span_bytes=300)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected()


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_reads_what_a_zip_library_reads(zip64):
    members = [("a/x", [b"12", b"345"]), ("ü", [b""]), ("b", [bytes(range(256)) * 9])]
    data = b"".join(zip_chunks(members, zip64))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == [(n, b"".join(p)) for n, p in members]
    read = lambda at, n: data[at : at + n]
    for member, (name, parts) in zip(read_directory(read, len(data)), members, strict=True):
        start = data_start(read, member)
        assert (member.name, data[start : start + member.size]) == (name, b"".join(parts))


def test_directory_of_a_foreign_archive_with_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("one", "stored")
        z.writestr("two", "deflated " * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it"
    data = out.getvalue()
    read = lambda at, n: data[at : at + n]
    one, two = read_directory(read, len(data))
    assert data[data_start(read, one) :][: one.size] == b"stored"
    with pytest.raises(ValueError):
        data_start(read, two)
    with pytest.raises(ValueError):
        read_directory(lambda at, n: b"no archive"[at : at + n], 10)
