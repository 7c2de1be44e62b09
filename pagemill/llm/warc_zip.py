"""Web archives packaged in ZIP files: written from pages, and read back by ranges, without extraction.

A package holds ``archive/*.warc.gz`` (one gzip member a record) and ``indexes/*.cdx`` (a line a record, with
its offset and length), both stored, not deflated. The reader fetches the end of a file, follows the ZIP64
locator if the plain directory's fields are full, parses the central directory, finds where the stored members
begin from their local headers, and turns the index into byte ranges of the package. Executors then read those
ranges, several megabytes at a time, and gunzip single records. An archive member without an index is walked
record by record, as is all of it if a line of an index is bad or places overlap or lie outside, and else the bytes
that no place covers; a deflated one is inflated on the way, as it can't be read by ranges. A walk reads bounded
chunks one after the other and holds one record. A line of an index names its archive by the member's path, with or without
``archive/``; a bare file name counts where one archive alone has it, and else the archives are walked.

Defined results: a null html is a record without payload and comes back null, an empty one empty; null urls and
ids come back null; equal rows are records of their own, alike to the byte; a package that can't be opened or parsed gives one row with
``error``, as does a record, a line of an index or a range that can't; an empty table gives no package and no rows; a very long
html is one record, which its task holds whole; other columns are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

PACKAGE_BYTES, RANGE_BYTES, LEVEL = 48 << 20, 4 << 20, 4
TAIL_BYTES, HEAD_BYTES = 1 << 16, 1 << 20

END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


# ---------------------------------------------------------------- directories


@dataclass(frozen=True)
class Member:
    name: str
    method: int  # 0 is stored
    packed: int
    size: int
    header: int  # offset of the local header


class BadPackage(ValueError):
    pass


BROKEN = (ValueError, LookupError, TypeError, EOFError, struct.error, zlib.error)  # what bytes of any kind may raise


def central_directory(source, length: int) -> list[Member]:
    """Members of a ZIP or ZIP64 file, from ranges at its end. ``source`` has read_at(nbytes, offset)."""
    tail_at = max(0, length - TAIL_BYTES - 22)
    tail = bytes(source.read_at(length - tail_at, tail_at))
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature can stand in a comment
    if at < 0:
        raise BadPackage("no end of central directory")
    _, _, _, count, size, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if at < 20 or tail[at - 20 : at - 16] != LOCATOR:
            raise BadPackage("no ZIP64 locator")
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = bytes(source.read_at(56, where))
        if record[:4] != END64:
            raise BadPackage("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    if start + size > length:
        raise BadPackage("the central directory is out of bounds")
    raw, out, p = bytes(source.read_at(size, start)), [], 0
    for _ in range(count):
        if raw[p : p + 4] != ENTRY:
            raise BadPackage("bad directory entry")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        packed, full, names, extras, comments = struct.unpack_from("<IIHHH", raw, p + 20)
        header = struct.unpack_from("<I", raw, p + 42)[0]
        name = raw[p + 46 : p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        e, stop = p + 46 + names, p + 46 + names + extras
        while e + 4 <= stop:
            kind, n = struct.unpack_from("<HH", raw, e)
            if kind == 1:  # only the fields that are full in the entry, in this order
                q = e + 4
                if full == 0xFFFFFFFF:
                    full, q = struct.unpack_from("<Q", raw, q)[0], q + 8
                if packed == 0xFFFFFFFF:
                    packed, q = struct.unpack_from("<Q", raw, q)[0], q + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", raw, q)[0]
            e += 4 + n
        out.append(Member(name, method, packed, full, header))
        p = stop + comments
    return out


def data_offset(source, member: Member) -> int:
    """Where a member's bytes begin: its local header may hold other extras than the directory."""
    head = bytes(source.read_at(30, member.header))
    if head[:4] != LOCAL:
        raise BadPackage(f"no local header of {member.name}")
    names, extras = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + names + extras


def is_archive(name: str) -> bool:
    return name.lower().endswith((".warc.gz", ".warc"))


def is_index(name: str) -> bool:
    return name.lower().endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz", ".idx.cdxj"))


def index_lines(raw: bytes) -> Iterator[tuple[str, int, int] | str]:
    """(archive's name, offset, length) of every line, or what is wrong with it; header lines are left out."""
    for k, line in enumerate(raw.split(b"\n"), 1):
        if not line.strip() or line.startswith((b"!", b" CDX")):
            continue
        try:
            got = json.loads(line[line.index(b"{") :])
            yield str(got.get("filename", "")), int(got["offset"]), int(got["length"])
        except (ValueError, KeyError, TypeError) as e:
            yield f"index line {k}: {type(e).__name__}: {e}"[:300]


def member_bytes(source, member: Member) -> bytes:
    raw = bytes(source.read_at(member.packed, data_offset(source, member)))
    if member.method == 8:
        raw = zlib.decompress(raw, -15)
    elif member.method != 0:
        raise BadPackage(f"{member.name} is packed by method {member.method}")
    return gzip.decompress(raw) if member.name.endswith(".gz") else raw


# -------------------------------------------------------------------- records


def parse_record(raw: bytes) -> dict:
    """Fields of one record: its headers and payload; of an HTTP response its status and body."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        raise BadPackage("not a WARC record")
    headers = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    body = raw[end + 4 : end + 4 + int(headers.get("content-length", 0))]
    row = json.loads(headers.get("x-row", "{}"))
    out = {"page_id": row.get("page_id"), "url": row["url"] if "url" in row else headers.get("warc-target-uri"), "type": headers.get("warc-type"), "status": None, "html": None}
    if out["type"] == "response":
        head, _, body = body.partition(b"\r\n\r\n")
        parts = head.split(b"\r\n", 1)[0].split(b" ")
        out["status"] = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None
        if b"content-encoding: gzip" in head.lower():
            body = zlib.decompressobj(31).decompress(body)
    if out["type"] != "metadata":
        out["html"] = body.decode("utf-8", "replace")
    return out


def chunks(source, begin: int, size: int, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a range, a chunk at a time."""
    for at in range(begin, begin + size, step):
        yield bytes(source.read_at(min(step, begin + size - at), at))


def inflated(parts: Iterator[bytes], step: int = 1 << 20) -> Iterator[bytes]:
    """A raw deflated stream, inflated by at most ``step`` bytes at a time."""
    d = zlib.decompressobj(-15)
    for part in parts:
        while part and not d.eof:
            yield d.decompress(part, step)
            part = d.unconsumed_tail
    yield d.flush()
    if not d.eof:
        raise BadPackage("a deflated member is cut off")


def _content_length(head: bytes) -> int:
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            n = int(value)
            if n < 0:
                raise BadPackage("a record of negative length")
            return n
    return 0


def walk(parts: Iterator[bytes], gz: bool) -> Iterator[bytes]:
    """The records of an archive member, one after the other, in time linear in its bytes."""
    if gz:
        d, held = None, []
        for part in parts:
            while part:
                d = d or zlib.decompressobj(31)
                held.append(d.decompress(part))
                part = b""
                if d.eof:
                    part = d.unused_data
                    yield b"".join(held)
                    d, held = None, []
        if d is not None:
            raise BadPackage("a record is cut off")
        return
    buffer, seen, need = bytearray(), 0, -1
    for part in parts:
        buffer += part
        at = 0
        while True:
            if need < 0:
                while buffer[at : at + 2] == b"\r\n":
                    at += 2
                end = buffer.find(b"\r\n\r\n", max(at, seen))
                if end < 0:
                    if len(buffer) - at > HEAD_BYTES:
                        raise BadPackage("the head of a record has no end")
                    break
                need = end + 4 - at + _content_length(bytes(buffer[at:end]))
            if len(buffer) - at < need:
                break
            yield bytes(buffer[at : at + need])
            at, need, seen = at + need, -1, 0
        del buffer[:at]
        seen = max(0, len(buffer) - 3) if need < 0 else 0
    if buffer.strip(b"\r\n"):
        raise BadPackage("a record is cut off")


# --------------------------------------------------------------------- writer


def record_bytes(page_id: int | None, url: str | None, html: str | None) -> bytes:
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    if html is None:
        kind, content, body = "metadata", "application/warc-fields", b""
    else:
        payload = html.encode()
        kind, content = "response", "application/http; msgtype=response"
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    # named by its content, so that a task that runs again writes the same bytes
    name = uuid.UUID(bytes=hashlib.sha256(f"{page_id} {url!r} {html is None}".encode() + body).digest()[:16], version=5)
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: {uri}\r\n"
    head += f"X-Row: {json.dumps({'page_id': page_id, 'url': url})}\r\nContent-Type: {content}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _gz(raw: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


class PackageWriter:
    """One package in memory, of bounded size, then in the folder under its final name."""

    def __init__(self, force64: bool = False) -> None:
        self.archive, self.lines, self.force64 = io.BytesIO(), [], force64

    def add(self, page_id: int | None, url: str | None, html: str | None) -> None:
        raw = _gz(record_bytes(page_id, url, html))
        key = json.dumps({"url": url, "filename": "data.warc.gz", "offset": str(self.archive.tell()), "length": str(len(raw))})
        self.lines.append(f"{(url or '-').split('#')[0].replace(' ', '%20')} 20240101000000 {key}".replace("\n", " "))
        self.archive.write(raw)

    def bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, raw in (("archive/data.warc.gz", self.archive.getvalue()), ("indexes/index.cdx", "\n".join(self.lines).encode()), ("datapackage.json", b'{"profile": "data-package"}')):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=self.force64) as f:
                    f.write(raw)
        return out.getvalue()


def _put(folder: str, raw: bytes) -> str:
    system, path = fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.wacz"
    with system.open_output_stream(f"{path}/{name}.part") as f:
        f.write(raw)
    system.move(f"{path}/{name}.part", f"{path}/{name}")
    return f"{folder}/{name}"


def _uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder}"


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, records) of the packages that now hold all rows of pages (page_id, url, html), in ``folder`` or the shared one.

    Only committed tasks' packages are listed; one that a lost task left behind is never read.
    """
    spark = pages.sparkSession
    folder = _uri(folder or f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(writer: PackageWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_put(folder, writer.bytes())]), pa.array([len(writer.lines)], pa.int64())], ["path", "records"])

        writer = PackageWriter()
        for batch in batches:
            for i in range(batch.num_rows):
                writer.add(*(batch.column(k)[i].as_py() for k in range(3)))
                if writer.archive.tell() >= PACKAGE_BYTES:
                    yield done(writer)
                    writer = PackageWriter()
        if writer.lines:
            yield done(writer)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(rows.mapInArrow(run, "path string, records long"))


# --------------------------------------------------------------------- reader

RANGES = "path string, begin long, size long, offsets array<long>, lengths array<long>, mode string, error string"


def plan_ranges(path: str) -> list[tuple]:
    """Byte ranges of a package that hold its records, with the records' places in them."""
    system, local = fs.FileSystem.from_uri(path)
    try:
        length = system.get_file_info(local).size
        with system.open_input_file(local) as source:
            members = central_directory(source, length)
            archives = {m.name: m for m in members if is_archive(m.name)}
            indexed: dict[str, list[tuple[int, int]]] = {}
            bad: list[str] = []
            for m in members:
                if is_index(m.name):
                    for line in index_lines(member_bytes(source, m)):
                        if isinstance(line, str):
                            bad.append(f"{m.name}: {line}"[:300])
                        else:
                            indexed.setdefault(line[0], []).append(line[1:])
            out = [(path, 0, 0, [], [], "", why) for why in bad]
            owners: dict[str, list[str]] = {}  # by what an index may call an archive
            for name in archives:
                for call in {name, name.removeprefix("archive/"), name.rsplit("/", 1)[-1]}:
                    owners.setdefault(call, []).append(name)
            found: dict[str, list[tuple[int, int]]] = {}
            for call, places in indexed.items():
                names = [call] if call in archives else [f"archive/{call}"] if f"archive/{call}" in archives else owners.get(call, [])
                if len(names) == 1:
                    found.setdefault(names[0], []).extend(places)
                elif not names:
                    out.append((path, 0, 0, [], [], "", f"no archive is called {call}"[:300]))
            for name, m in sorted(archives.items()):
                places = sorted(set(found.get(name, [])))
                begin = data_offset(source, m)
                edges = [0, *(x for o, n in places for x in (o, o + n)), m.packed]
                if m.method or not places or bad or edges != sorted(edges):
                    out.append((path, begin, m.packed, [], [], f"{m.method} {name}", None))
                    continue
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    if a < b:
                        out.append((path, begin + a, b - a, [], [], f"0 {name}", None))
                i = 0
                while i < len(places):
                    j, first = i, places[i][0]
                    while j < len(places) and (j == i or places[j][0] + places[j][1] - first <= RANGE_BYTES):
                        j += 1
                    last = max(o + n for o, n in places[i:j])
                    out.append((path, begin + first, last - first, [o - first for o, _ in places[i:j]], [n for _, n in places[i:j]], "gz" if name.endswith(".gz") else "plain", None))
                    i = j
            return out
    except (OSError, *BROKEN) as e:
        return [(path, 0, 0, [], [], "", f"{type(e).__name__}: {e}"[:300])]


RECORDS = "path string, offset long, page_id long, url string, type string, status int, html string, error string"


def range_records(path: str, begin: int, size: int, offsets: list[int], lengths: list[int], mode: str, error: str | None) -> Iterator[tuple]:
    def bad(e: Exception, at: int | None) -> tuple:
        return (path, at, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])

    def good(r: dict, at: int | None) -> tuple:
        return (path, at, r["page_id"], r["url"], r["type"], r["status"], r["html"], None)

    if error:
        yield (path, None, None, None, None, None, None, error)
        return
    try:
        system, local = fs.FileSystem.from_uri(path)
        with system.open_input_file(local) as source:
            if mode in ("gz", "plain"):
                raw = bytes(source.read_at(size, begin))
                for o, n in zip(offsets, lengths, strict=True):
                    try:
                        record = raw[o : o + n]
                        yield good(parse_record(zlib.decompress(record, 31) if mode == "gz" else record), begin + o)
                    except BROKEN as e:
                        yield bad(e, begin + o)
            else:  # no index, or deflated: the whole member, in order
                method, _, name = mode.partition(" ")
                if method not in ("0", "8"):
                    raise BadPackage(f"{name} is packed by method {method}")
                parts = chunks(source, begin, size)
                for record in walk(inflated(parts) if method == "8" else parts, name.endswith(".gz")):
                    try:
                        yield good(parse_record(record), None)
                    except BROKEN as e:
                        yield bad(e, None)
    except (OSError, *BROKEN) as e:
        yield bad(e, None)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_RANGE_SCHEMA = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("size", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("mode", pa.string()), ("error", pa.string())])
_RECORD_SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("error", pa.string())])


def read_packages(packages: DataFrame) -> DataFrame:
    """(path, offset, page_id, url, type, status, html, error) of every record in the packages of (path, ...)."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield _batch(plan_ranges(path), _RANGE_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for r in range_records(*(row[n] for n in _RANGE_SCHEMA.names)):
                    rows.append(r)
                    held += len(r[6] or "")
                    if held >= RANGE_BYTES:
                        yield _batch(rows, _RECORD_SCHEMA)
                        rows, held = [], 0
                yield _batch(rows, _RECORD_SCHEMA)

    found = packages.select("path").filter("path is not null")
    ranges = found.mapInArrow(plan, RANGES)
    # a number of its own: small rows that stand for megabytes each must not be merged into few tasks
    tasks = max(packages.sparkSession.sparkContext.defaultParallelism, found.count())
    return ranges.repartition(tasks, "path", "begin").mapInArrow(read, RECORDS)


def list_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the packages in a folder and below."""
    system, path = fs.FileSystem.from_uri(_uri(folder))
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    scheme = _uri(folder).split("://")[0]
    paths = sorted(f"{scheme}://{f.path}" for f in found if f.path.endswith((".wacz", ".zip")))
    return spark.createDataFrame([(p,) for p in paths], "path string")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) of all pages, as read back from the packages they were written to; a record that can't be ends the job."""
    whole = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean"))
    return read_packages(write_packages(pages)).filter(whole).select("page_id", "url", "html")
