from __future__ import annotations

import io
import zipfile

import pyarrow as pa
import pytest

from pagemill.llm import warc_zip as wz

PAGES = [(1, "http://a/1", "<p>é</p>"), (None, None, "x"), (3, "http://a/3\r\nEvil: 1", None), (4, "http://a/4", ""), (4, "http://a/4", ""), (5, "http://a/5", "long " * 100_000)]


def pages(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", F.lit("x").alias("path"), F.lit(0).alias("offset"), F.lit("e").alias("error"))


def as_source(raw):
    return pa.BufferReader(raw)


@pytest.mark.parametrize("force64", [False, True])
def test_directory_matches_the_library(force64):
    w = wz.PackageWriter(force64)
    for row in PAGES:
        w.add(*row)
    raw = w.bytes()
    found = wz.central_directory(as_source(raw), len(raw))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert [(m.name, m.method, m.packed, m.size, m.header) for m in found] == [(i.filename, i.compress_type, i.compress_size, i.file_size, i.header_offset) for i in z.infolist()]
        for m in found:
            assert wz.member_bytes(as_source(raw), m) == (z.read(m.name) if not m.name.endswith(".gz") else __import__("gzip").decompress(z.read(m.name)))


def test_zip64_end_record_with_full_fields():
    import struct

    w = wz.PackageWriter()
    w.add(*PAGES[0])
    raw = w.bytes()
    at = raw.rfind(wz.END)
    count, size, start = struct.unpack_from("<HII", raw, at + 10)
    end64 = wz.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start)
    locator = wz.LOCATOR + struct.pack("<IQI", 0, at, 1)
    full = wz.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = raw[:at] + end64 + locator + full
    assert wz.central_directory(as_source(big), len(big)) == wz.central_directory(as_source(raw), len(raw))
    with pytest.raises(wz.BadPackage):
        wz.central_directory(as_source(raw[:at] + full), at + 22)


def test_zip64_entry_fields():
    import struct

    extra = struct.pack("<HHQQQ", 1, 24, 5_000_000_000, 4_999_999_999, 6_000_000_000)
    entry = wz.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 3, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"x.z" + extra
    end = wz.END + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), 0, 4) + b"note"
    raw = entry + end
    assert wz.central_directory(as_source(raw), len(raw)) == [wz.Member("x.z", 0, 4_999_999_999, 5_000_000_000, 6_000_000_000)]


def key(rows):
    return sorted(map(str, map(tuple, rows)))


def test_round_trip_and_defined_results(spark, monkeypatch):
    monkeypatch.setattr(wz, "RANGE_BYTES", 1000)
    assert key(wz.round_trip(pages(spark, PAGES)).collect()) == key(PAGES)
    assert wz.round_trip(pages(spark, [])).collect() == []


def test_without_index_deflated_and_broken(spark, tmp_path):
    w = wz.PackageWriter()
    for row in PAGES:
        w.add(*row)
    archive = w.archive.getvalue()
    plain = b"".join(wz.record_bytes(*p) for p in PAGES)
    for name, member, raw, method in (("noindex", "archive/a.warc.gz", archive, 0), ("deflated", "archive/a.warc.gz", archive, 8), ("plain", "archive/a.warc", plain, 0)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", method) as z:
            z.writestr(member, raw)
    (tmp_path / "broken.zip").write_bytes(b"PK nothing here")
    found = wz.list_packages(spark, str(tmp_path))
    assert found.count() == 4
    rows = wz.read_packages(found).collect()
    good = [(r.page_id, r.url, r.html) for r in rows if r.error is None]
    assert key(good) == key(PAGES * 3)
    assert [r.path.rsplit("/", 1)[-1] for r in rows if r.error] == ["broken.zip"]


def test_bad_and_missing_index_lines_lose_no_record(spark, tmp_path):
    w = wz.PackageWriter()
    for row in PAGES:
        w.add(*row)
    n = len(w.lines)
    for name, lines in (("bad", [*w.lines[:2], "no json", w.lines[3][:-4], *w.lines[4:]]), ("missing", w.lines[1:3] + w.lines[4:5])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("archive/data.warc.gz", w.archive.getvalue())
            z.writestr("indexes/index.cdx", "\n".join(lines))
    rows = wz.read_packages(wz.list_packages(spark, str(tmp_path))).collect()
    assert key((r.page_id, r.url, r.html) for r in rows if r.error is None) == key(PAGES * 2)
    assert [r.path.rsplit("/", 1)[-1] for r in rows if r.error] == ["bad.zip"] * 2 and n == 6


def test_round_trip_drops_no_error(spark, monkeypatch):
    read = wz.read_packages
    from pyspark.sql import functions as F

    monkeypatch.setattr(wz, "read_packages", lambda p: read(p).withColumn("error", F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        wz.round_trip(pages(spark, PAGES)).collect()


def archive_of(rows):
    w = wz.PackageWriter()
    for row in rows:
        w.add(*row)
    return w


def read_folder(spark, folder):
    return wz.read_packages(wz.list_packages(spark, str(folder))).collect()


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    w = archive_of(PAGES)
    with zipfile.ZipFile(tmp_path / "deflated.zip", "w", 8) as z:
        z.writestr("archive/a.warc", b"".join(wz.record_bytes(*p) for p in PAGES[:2]) * 50)
    raw = bytearray((tmp_path / "deflated.zip").read_bytes())
    raw[60:90] = b"\xff" * 30
    (tmp_path / "deflated.zip").write_bytes(raw)
    (tmp_path / "cut.zip").write_bytes(w.bytes()[:-30])
    (tmp_path / "gone.zip").write_bytes(w.bytes())
    with zipfile.ZipFile(tmp_path / "lzma.zip", "w", 14) as z:
        z.writestr("archive/a.warc.gz", w.archive.getvalue())
    found = wz.list_packages(spark, str(tmp_path))
    ranges = wz.plan_ranges(f"file://{tmp_path}/gone.zip")
    rows = wz.read_packages(found).collect()
    assert {r.path.rsplit("/", 1)[-1] for r in rows if r.error} == {"deflated.zip", "cut.zip", "lzma.zip"}
    assert key((r.page_id, r.url, r.html) for r in rows if r.path.endswith("gone.zip")) == key(PAGES)
    (tmp_path / "gone.zip").unlink()  # after the plan was made
    assert all(r[-1] for x in ranges for r in wz.range_records(*x)) and ranges
    assert wz.plan_ranges(f"file://{tmp_path}/gone.zip")[0][-1]


def test_archives_of_one_name_keep_their_own_records(spark, tmp_path):
    a, b = archive_of(PAGES[:2]), archive_of(PAGES[3:])
    for name, calls in (("full", ("archive/x/data.warc.gz", "y/data.warc.gz")), ("bare", ("data.warc.gz", "data.warc.gz"))):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("archive/x/data.warc.gz", a.archive.getvalue())
            z.writestr("archive/y/data.warc.gz", b.archive.getvalue())
            z.writestr("indexes/index.cdx", "\n".join(x.replace('"data.warc.gz"', f'"{call}"') for w, call in zip((a, b), calls, strict=True) for x in w.lines))
    rows = read_folder(spark, tmp_path)
    assert not [r for r in rows if r.error]
    assert key((r.page_id, r.url, r.html) for r in rows) == key((PAGES[:2] + PAGES[3:]) * 2)


def test_an_index_of_an_absent_archive_is_reported(spark, tmp_path):
    w = archive_of(PAGES[:1])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("archive/data.warc.gz", w.archive.getvalue())
        z.writestr("indexes/index.cdx", w.lines[0].replace("data.warc.gz", "other.warc.gz"))
    rows = read_folder(spark, tmp_path)
    assert sum(r.error is None for r in rows) == 1 and [r.error for r in rows if r.error] == ["no archive is called other.warc.gz"]


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
@pytest.mark.parametrize("gz", [False, True])
def test_walk_in_chunks(step, gz):
    records = [wz.record_bytes(*p) for p in PAGES[:5]]
    raw = archive_of(PAGES[:5]).archive.getvalue() if gz else b"".join(records)
    got = list(wz.walk(wz.chunks(as_source(raw), 0, len(raw), step), gz))
    assert [r.rstrip(b"\r\n") for r in got] == [r.rstrip(b"\r\n") for r in records]
    with pytest.raises(wz.BadPackage):
        list(wz.walk(wz.chunks(as_source(raw), 0, len(raw) - 9, step), gz))


def test_a_walk_is_linear():
    import time

    w = archive_of([(k, f"http://a/{k}", "p" * 1000 + str(k) * 50) for k in range(4000)])
    raw = w.archive.getvalue()

    def cost(times):
        began = time.process_time()
        n = sum(1 for _ in wz.walk(wz.chunks(as_source(raw * times), 0, len(raw) * times), True))
        assert n == 4000 * times
        return time.process_time() - began

    cost(1)
    assert cost(16) < 4 * 16 * max(cost(1), 0.02)


def test_records_are_alike_each_time():
    assert archive_of(PAGES).bytes()[:5000] == archive_of(PAGES).bytes()[:5000]
    assert wz.record_bytes(1, "u", None) != wz.record_bytes(1, "u", "")
