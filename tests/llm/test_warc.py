import zipfile

import pytest
from pyarrow import fs

from retrievo.llm import warc_zip, zip_reader
from retrievo.llm.warc_zip import read_archives, write_archives

LONG = "<p>ü" + "x" * 200


def _rows():
    return [(1, "http://a/", LONG), (2, "http://b/\n", LONG), (0, None, LONG), (3, "u", "short"), (4, "u", "short"), (5, "", None),
            (6, "u", ""), (None, "n", LONG), (7, "m", "\r\n\r\n" * 50), (8, "m", "\r\n\r\n" * 50), (8, "m", "\r\n\r\n" * 50),
            (9, "big", "z" * 3_000_000)]


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, monkeypatch, small):
    if small:  # several archives and ranges
        monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 400)
        monkeypatch.setattr(warc_zip, "RANGE_BYTES", 300)
    pages = spark.createDataFrame([(*r, "x") for r in _rows()], "page_id long, url string, html string, digest string")
    paths = write_archives(pages.repartition(2))
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.html) for r in read_archives(paths).collect())
    size = len(LONG.encode())
    want = sorted([("0", "response", None, size, LONG), ("1", "revisit", 0, size, None), ("2", "revisit", 0, size, None),
                   ("3", "response", None, 5, "short"), ("4", "response", None, 5, "short"), ("5", "response", None, 0, ""),
                   ("6", "response", None, 0, ""), ("None", "revisit", 0, size, None),
                   ("7", "response", None, 200, "\r\n\r\n" * 50), ("8", "revisit", 7, 200, None),
                   ("8", "revisit", 7, 200, None), ("9", "response", None, 3_000_000, "z" * 3_000_000)])
    assert got == want
    path = paths.first().path
    assert {i.filename for i in zipfile.ZipFile(path.removeprefix("file://")).infolist()} == {warc_zip.RECORDS, warc_zip.INDEX}
    assert read_archives(write_archives(pages.where("false"))).count() == 0


def _members(path):
    store, inside = fs.FileSystem.from_uri(str(path))
    with store.open_input_file(inside) as f:
        return [(m, f.seek(m.start) and None or f.read(m.packed)) for m in zip_reader.members(f)]


def test_directories(tmp_path, monkeypatch):
    """Plain, commented and ZIP64 archives as another library writes them."""
    for wide in (False, True):
        path = tmp_path / f"{wide}.zip"
        if wide:  # the limits from which the library writes ZIP64 records
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 5)
        with zipfile.ZipFile(path, "w") as z:
            for i in range(40):
                z.writestr(f"ä/{i}", b"PK\x05\x06" * i)
            z.writestr(zipfile.ZipInfo("packed"), b"a" * 1000, zipfile.ZIP_DEFLATED)
            z.comment = b"PK\x05\x06 comment" * 20
        found = _members(path)
        assert [m.name for m, _ in found] == [f"ä/{i}" for i in range(40)] + ["packed"]
        assert all(data == b"PK\x05\x06" * i and m.method == 0 for i, (m, data) in enumerate(found[:40]))
        assert found[40][0].method == 8 and found[40][0].size == 1000
        raw = path.read_bytes()
        assert (b"PK\x06\x06" in raw) == wide
        (tmp_path / "cut.zip").write_bytes(raw[:-400])
        with pytest.raises(ValueError):
            _members(tmp_path / "cut.zip")
