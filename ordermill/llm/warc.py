"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The writer puts one gzip member per record into files of at most ROLL bytes. Each task attempt
writes files of its own names and reports them; only reported files count, so a lost or repeated
task leaves nothing in the result. The reader walks a file member by member, or record by record
where it is not compressed. A record must inflate with the right checksum, have a version line,
a header, the announced length and the announced block digest. Where a check fails the reader
searches for the next gzip signature or version line that starts a valid record, goes on there,
and reports the skipped bytes as a gap. It reads through a window and holds one record at a time,
of at most MOST_BLOCK bytes; what a header announces is believed only as far as the file or member
has it. A number that is none, or too large for a bigint, is read as null.
A member may hold several records; they, and gaps between them, all carry the member's range. Of
such a member that does not inflate to its end, records whose announced digest fits are kept.
Digests may be base32 or hex, of either case.

Defined cases: a null page is an empty payload; a null url becomes ``urn:page:`` and the id. Of
equal payloads those with the largest id are responses, so rows that repeat it are too. A null
id is written as such and never referred to. Other input columns are ignored. An empty table
gives no records; empty files are read as nothing.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.session import scratch_path

LEAST_REVISIT = 1000
ROLL = 64 << 20
WINDOW = 1 << 20
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_starts = re.compile(b"\x1f\x8b\x08|WARC/1\\.")
# Longest header that is searched for its end
MOST_HEADER = 1 << 20
MOST_VERSION = 32
# A block is held whole; no longer one fits into a value
MOST_BLOCK = (1 << 31) - 1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(),
        path,
    )


def _sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """One WARC record, not compressed."""
    kind = "response" if refers_to is None else "revisit"
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
        % len(payload)
    )
    if refers_to is None:
        block += payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page_id is None else str(page_id)),
        ("Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, size, name, records = None, 0, "", 0

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records]})

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, records = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                plain = record(page_id, url, (payload or "").encode("utf-8", "surrogatepass"), digest, refers_to)
                packed = member.compress(plain) + member.flush()
                out.write(packed)
                size, records = size + len(packed), records + 1
                if size >= roll:
                    out.close()
                    out = None
                    yield report()
        if out is not None:
            out.close()
            yield report()

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_revisit: int = LEAST_REVISIT,
    roll: int = ROLL,
) -> DataFrame:
    """Write one record per row under ``folder``; (path, records) of the files that count."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
    )
    # one row per repeated payload; a hot payload has shrunk to one row per task before it moves
    repeated = (
        rows.filter(F.octet_length("html") >= least_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first"))
    return (
        rows.join(repeated, "digest", "left")
        .select("page_id", "url", "html", "digest", refers.alias("refers_to"))
        .mapInArrow(_write(folder, roll), "path string, records long")
        .checkpoint()
    )


class _File:
    """Random access through one window of the file."""

    def __init__(self, handle) -> None:
        self.handle, self.size = handle, handle.size()
        self.start, self.data = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.start, self.data = at, self.handle.read_at(max(n, min(WINDOW, self.size - at)), at)
        return self.data[at - self.start : at - self.start + n]

    def next_start(self, at: int) -> int:
        """The first signature at or behind ``at``; the file's size if there is none."""
        while at < self.size:
            if not self.start <= at <= self.start + len(self.data) - len(VERSION):
                self.start, self.data = at, self.handle.read_at(min(WINDOW, self.size - at), at)
            found = _starts.search(self.data, at - self.start)
            if found:
                return self.start + found.start()
            # a signature may lie across the edge of two windows
            end = self.start + len(self.data)
            at = self.size if end >= self.size else max(end - len(VERSION) + 1, at + 1)
        return self.size


class Damaged(Exception):
    """No valid record here, nor at the next ``skip`` - 1 bytes."""

    def __init__(self, reason: str, skip: int = 1) -> None:
        super().__init__(reason)
        self.skip = skip


class _Inflated:
    """The member at ``begin``, inflated as far as it is asked for; what was dropped is let go."""

    def __init__(self, file: _File, begin: int) -> None:
        self.file, self.begin, self.at, self.error = file, begin, begin, ""
        self.data, self.pos, self.dropped = bytearray(), 0, 0
        self.member = zlib.decompressobj(31)

    def _more(self) -> bytes:
        data = self.file.read(self.at, min(1 << 16, self.file.size - self.at))
        if not data:
            self.error = "member cut off"
            return b""
        before = self.member.copy()
        try:
            out = self.member.decompress(data)
            self.at += len(data) - len(self.member.unused_data)
            return out
        except zlib.error as error:
            self.error = f"member: {error}"
        # what stands before the damage
        parts = []
        for i in range(len(data)):
            try:
                parts.append(before.decompress(data[i : i + 1]))
            except zlib.error:
                break
            self.at += 1
        return b"".join(parts)

    def want(self, n: int) -> bool:
        """Inflate until ``n`` bytes are at hand, if there are as many."""
        while len(self.data) - self.pos < n and not self.error and not self.member.eof:
            self.data += self._more()
        return len(self.data) - self.pos >= n

    def drop(self, n: int) -> None:
        n = min(n, len(self.data) - self.pos)
        self.pos, self.dropped = self.pos + n, self.dropped + n
        if self.pos > WINDOW:
            del self.data[: self.pos]
            self.pos = 0

    def next_version(self, skip: int) -> bool:
        """Drop what stands before the next version line at or behind that byte."""
        self.drop(skip)
        while True:
            found = self.data.find(VERSION, self.pos)
            if found >= 0:
                self.drop(found - self.pos)
                return True
            self.drop(max(len(self.data) - self.pos - len(VERSION) + 1, 0))
            if not self.want(len(self.data) - self.pos + 1):
                return False

    @cached_property
    def whole(self) -> tuple[int, int, str]:
        """(size inflated, end in the file, error) of the member, without keeping what is inflated."""
        rest, size = _Inflated(self.file, self.begin), 0
        while not rest.error and not rest.member.eof:
            size += len(rest._more())
        return size, rest.at, rest.error


_HEADER = re.compile(rb"WARC/1\.[0-9]+\r\n((?:[^\r\n:]+:[^\r\n]*\r\n)*)(\r\n)?")
_LENGTH = re.compile("[0-9]{1,18}")
_NUMBER = re.compile("-?[0-9]{1,19}")


def _header(data: bytes | bytearray, pos: int = 0) -> tuple[dict[str, str], int] | None:
    """Fields by lower-case name, and the size of the header at ``pos``; None if it may go on."""
    found = _HEADER.match(data, pos, pos + MOST_HEADER)
    if not found:
        if len(data) - pos >= MOST_VERSION or b"\n" in data[pos:]:
            raise Damaged("no version line")
        return None
    if not found[2]:
        if data.find(b"\n", found.end(), pos + MOST_HEADER) >= 0:
            # a version line within these lines would lead to the same line
            raise Damaged("header line without a colon", found.end() - pos)
        if len(data) - pos >= MOST_HEADER:
            raise Damaged("header too long")
        return None
    fields = {}
    for line in bytes(found[1]).split(b"\r\n")[:-1]:
        name, _, value = line.partition(b":")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not _LENGTH.fullmatch(fields.get("content-length", "")):
        raise Damaged("no length")
    if int(fields["content-length"]) > MOST_BLOCK:
        raise Damaged("longer than a value can be")
    return fields, found.end() - pos


def _hex(digest: str) -> str:
    """A SHA-1 digest as lower-case hex, given as that or as base32."""
    if len(digest) == 32:
        try:
            return base64.b32decode(digest, casefold=True).hex()
        except binascii.Error:
            pass
    return digest.lower()


def _sha1_field(fields: dict[str, str], name: str) -> str | None:
    kind, _, digest = fields.get(name, "").partition(":")
    return _hex(digest.strip()) if kind.lower() == "sha1" else None


def _checked(fields: dict[str, str], block: bytes, length: int, closing: bytes) -> None:
    if len(block) != length or closing != b"\r\n\r\n":
        raise Damaged("length does not fit")
    announced = _sha1_field(fields, "warc-block-digest")
    if announced is not None and announced != _sha1(block):
        raise Damaged("block digest does not fit")


def _plain_record(file: _File, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the valid record at ``at``, which is not compressed."""
    found, want = None, 1 << 12
    while found is None:
        want = min(2 * want, file.size - at)
        found = _header(file.read(at, want))
        if found is None and want == file.size - at:
            raise Damaged("no header")
    fields, begin = found
    length = int(fields["content-length"])
    if at + begin + length + 4 > file.size:
        raise Damaged("record cut off")
    block = file.read(at + begin, length)
    end = at + begin + length + 4
    _checked(fields, block, length, file.read(end - 4, 4))
    return fields, block, end


def _inflated_record(source: _Inflated) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and length of the valid record at the front of the member's data."""
    want = 1 << 12
    while (found := _header(source.data, source.pos)) is None:
        want *= 2
        if not source.want(want) and _header(source.data, source.pos) is None:
            raise Damaged("no header")
    fields, begin = found
    length = int(fields["content-length"])
    end = begin + length + 4
    # a false length must not bring a whole member into memory
    if length > WINDOW and source.dropped + end > source.whole[0]:
        raise Damaged("length does not fit")
    source.want(end)
    at = source.pos + begin
    block = bytes(source.data[at : at + length])
    _checked(fields, block, length, bytes(source.data[at + length : source.pos + end]))
    return fields, block, end


def _member_records(file: _File, at: int) -> Iterator[tuple]:
    """As ``read_file``, for the member at ``at``; Damaged, at last, if it is not valid."""
    source, stop, error, lost, any_valid = _Inflated(file, at), None, "", "", False
    while True:
        try:
            fields, block, length = _inflated_record(source)
            alone = not any_valid and not source.want(length + 1)
            if stop is None and not alone:
                # several records, or junk behind the first: is the member whole?
                _, stop, error = source.whole
            if alone and source.error:
                raise Damaged(source.error)
            if error and _sha1_field(fields, "warc-block-digest") is None:
                raise Damaged(f"{error}, and no digest")
        except Damaged as damage:
            lost = lost or str(source.error or damage)
            if source.next_version(damage.skip):
                continue
            break
        if lost and not error:
            yield at, source.at if stop is None else stop, None, None, lost
        lost, any_valid = "", True
        source.drop(length)
        yield at, source.at if stop is None else stop, fields, block, None
        if not source.want(1):
            break
    if source.error or error or not any_valid:
        raise Damaged(str(source.error or error or lost))
    if lost:
        yield at, source.at, None, None, lost


def _records_at(file: _File, at: int) -> Iterator[tuple]:
    if file.read(at, min(3, file.size - at)) == GZIP:
        yield from _member_records(file, at)
    else:
        fields, block, end = _plain_record(file, at)
        yield at, end, fields, block, None


def read_file(handle) -> Iterator[tuple]:
    """(start, end, fields, block, None) of records and (start, end, None, None, reason) of gaps."""
    file, at, gap, why = _File(handle), 0, None, ""
    while at < file.size:
        try:
            for found in _records_at(file, at):
                if gap is not None:
                    yield gap, at, None, None, why
                    gap = None
                yield found
            at = found[1]
        except Damaged as error:
            if gap is None:
                gap, why = at, str(error)
            at = file.next_start(at + error.skip)
    if gap is not None:
        yield gap, file.size, None, None, why


_READ = (
    "path string, start long, end long, gap string, page_id long, url string, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)
_NAMES = [part.split()[0] for part in _READ.split(", ")]


def _row(path: str, start: int, end: int, fields: dict | None, block: bytes | None, why: str | None) -> tuple:
    if fields is None:
        return path, start, end, why, *[None] * 7

    def number(name: str) -> int | None:
        text = fields.get(name, "")
        value = int(text) if _NUMBER.fullmatch(text) else None
        return value if value is not None and -(2**63) <= value < 2**63 else None

    kind = fields.get("warc-type")
    url = fields.get("warc-target-uri")
    if kind == "response":
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), _sha1(payload)
    else:
        payload, size = None, number("payload-length")
        digest = _sha1_field(fields, "warc-payload-digest") or fields.get("warc-payload-digest", "")
    return path, start, end, None, number("page-id"), url, size, digest, kind, number("refers-to-page-id"), payload


def _read(with_payload: bool, complete: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                pa.field(n, pa.binary() if n == "payload" else pa.string() if n in TEXT else pa.int64())
                for n in _NAMES
            ]
        )
        for batch in batches:
            for path, written in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as handle:
                    rows, held, records = [], 0, 0
                    for found in read_file(handle):
                        records += found[4] is None
                        row = _row(path, *found)
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(row[-1] or b"") if with_payload else 0
                        if len(rows) >= 1000 or held > WINDOW:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                    if complete and records != written:
                        raise ValueError(f"{path}: {written} records written, {records} read")
                    if rows:
                        yield _batch(rows, schema)

    return run


TEXT = ("path", "gap", "url", "payload_digest", "record_type")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def read_archives(
    files: DataFrame, with_payload: bool = True, complete: bool = False
) -> DataFrame:
    """Records and gaps (``gap`` holds the reason, else null) of the files in column ``path``.

    With ``complete`` a file that does not give as many records as its column ``records`` says
    is an error.
    """
    records = F.col("records") if complete else F.lit(None).cast("bigint").alias("records")
    return files.select("path", records).mapInArrow(_read(with_payload, complete), _READ)


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: path, start, end and reason of every skipped range of bytes."""
    return read.filter("gap IS NOT NULL").select("path", "start", "end", F.col("gap").alias("reason"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages and read them back; an error if a record is missing.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    files = write_archives(pages, scratch_path(spark, "warc"))
    return (
        read_archives(files, with_payload=False, complete=True)
        .filter("gap IS NULL")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), m AS (SELECT payload, max(page_id) AS first FROM p GROUP BY payload)
SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN strlen(payload) >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(payload) >= 1000 AND page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (payload)
"""
