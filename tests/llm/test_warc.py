import base64
import gzip
import hashlib
import io

import pytest

from ordermill.llm import warc


class Bytes:
    """Random access as an Arrow file gives it."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def sha1(data):
    return hashlib.sha1(data).hexdigest()


def plain(i, payload=b"hello"):
    return warc.record(i, f"http://h/{i}", payload, sha1(payload), None)


def member(i, payload=b"hello"):
    return gzip.compress(plain(i, payload), mtime=0)


def read(data):
    found = list(warc.read_file(Bytes(data)))
    ids = [int(f[2]["page-id"]) for f in found if f[2]]
    gaps = [(f[0], f[1]) for f in found if f[4]]
    # records and gaps cover the file without overlap
    at = 0
    for start, end, *_ in found:
        assert start == at
        at = end
    assert at == len(data)
    return ids, gaps


@pytest.mark.parametrize("make", [plain, member])
def test_every_damage_is_salvaged(make):
    parts = [make(i, b"payload %d " % i * 50) for i in range(5)]
    assert read(b"".join(parts)) == ([0, 1, 2, 3, 4], [])
    begin = len(parts[0]) + len(parts[1])
    end = begin + len(parts[2])
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    assert read(b"".join([*parts[:2], bytes(broken), *parts[3:]])) == ([0, 1, 3, 4], [(begin, end)])
    cut = parts[2][: len(parts[2]) // 2]
    assert read(b"".join([*parts[:2], cut, *parts[3:]])) == ([0, 1, 3, 4], [(begin, begin + len(cut))])
    junk = b"junk WARC/1. junk \x1f\x8b\x08 junk" * 3
    assert read(junk + b"".join(parts) + junk)[0] == [0, 1, 2, 3, 4]
    assert read(b"".join(parts)[: -len(parts[4]) // 2])[0] == [0, 1, 2, 3]


def test_damage_across_windows(monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 64)
    parts = [member(0), b"\0" * 200, plain(1), b"x" * 61, member(2)]
    assert read(b"".join(parts))[0] == [0, 1, 2]


def test_nothing():
    assert read(b"") == ([], [])
    assert read(b"no archive") == ([], [(0, 10)])


@pytest.mark.parametrize("form", [str.upper, str.lower])
def test_digests_of_other_writers(form):
    def other(i):
        data = plain(i)
        for line in data.split(b"\r\n"):
            if line.startswith(b"WARC-Block-Digest"):
                digest = bytes.fromhex(line.partition(b"sha1:")[2].decode())
                base32 = form(base64.b32encode(digest).decode()).encode()
                return data.replace(line, b"WARC-Block-Digest: sha1:" + base32)

    assert read(other(1) + gzip.compress(other(2)) + other(3)) == ([1, 2, 3], [])
    assert read(plain(1).replace(sha1(b"hello").encode(), sha1(b"hello").upper().encode()))[0] == [1]
    wrong = other(1).replace(b"hello", b"hallo")
    assert read(wrong + other(2)) == ([2], [(0, len(wrong))])
    row = warc._row("p", 0, 1, {"warc-type": "revisit", "warc-payload-digest": "sha1:" + form("A" * 32)}, b"", None)
    assert row[7] == "0" * 40


def test_members_of_several_records():
    parts = [plain(i, b"%d" % i * 70_000) for i in range(5)]

    def found(data):
        rows = list(warc.read_file(Bytes(data)))
        return [int(r[2]["page-id"]) for r in rows if r[2]], [r[:2] for r in rows if r[4]]

    whole = gzip.compress(b"".join(parts), mtime=0)
    assert found(whole) == ([0, 1, 2, 3, 4], [])
    assert found(member(7) + whole + plain(8)) == ([7, 0, 1, 2, 3, 4, 8], [])
    bad = parts[2].replace(b"2222", b"2322", 1)
    inner = gzip.compress(b"".join([*parts[:2], bad, *parts[3:]]), mtime=0)
    assert found(inner + member(8)) == ([0, 1, 3, 4, 8], [(0, len(inner))])
    cut = whole[: len(whole) * 3 // 4]
    ids, lost = found(cut + member(8))
    assert ids[:3] == [0, 1, 2] and ids[-1] == 8 and lost == [(0, len(cut))]
    first = gzip.compress(bad + parts[3], mtime=0)
    assert found(first) == ([3], [(0, len(first))])


def test_a_record_lost_on_the_way_is_an_error(spark, given, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "scratch_path", lambda *_: f"file://{tmp_path}/warc")
    back = warc.round_trip(spark, given("pages").limit(20))
    path = next((tmp_path / "warc").iterdir())
    data = bytearray(path.read_bytes())
    data[30] ^= 0xFF
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="records written"):
        back.collect()


def test_members_open_with_the_gzip_module():
    data = member(1) + member(2)
    text = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    assert text == plain(1)[:0] + text and text.count(b"WARC/1.1\r\n") == 2


def test_round_trip(spark):
    big, small = "é" * 600, "small"
    rows = [(1, "http://a b/\n", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", small),
            (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS digest", "2 AS first", "'p' AS path"
    )
    got = sorted(
        (tuple(r) for r in warc.round_trip(spark, pages).collect()), key=lambda r: (r[0] or 0, r)
    )
    b, s, e = big.encode(), small.encode(), b""
    assert got == [
        (None, len(b), sha1(b), "revisit", 3),
        (1, len(b), sha1(b), "revisit", 3),
        (2, len(b), sha1(b), "revisit", 3),
        (3, len(b), sha1(b), "response", None),
        (3, len(b), sha1(b), "response", None),
        (4, 5, sha1(s), "response", None),
        (5, 5, sha1(s), "response", None),
        (6, 0, sha1(e), "response", None),
        (7, 0, sha1(e), "response", None),
    ]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_archives_keep_payloads_and_report_gaps(spark, given, tmp_path):
    folder = f"file://{tmp_path}/warc"
    files = warc.write_archives(given("pages"), folder, roll=20_000)
    assert files.count() > 1
    found = warc.read_archives(files)
    assert warc.gaps(found).count() == 0
    stored = {r.page_id: bytes(r.payload).decode() for r in found.filter("payload IS NOT NULL").collect()}
    assert stored == {r.page_id: r.html for r in given("pages").collect()}
    path = next(p for p in (tmp_path / "warc").iterdir())
    data = bytearray(path.read_bytes())
    data[30] ^= 0xFF
    path.write_bytes(bytes(data))
    found = warc.read_archives(files)
    lost = warc.gaps(found).collect()
    assert len(lost) == 1 and lost[0].start == 0 and lost[0].reason
    assert found.filter("gap IS NULL").count() == len(stored) - 1


@pytest.mark.parametrize(
    "line",
    [
        b"Content-Length: " + b"9" * 5000,
        b"Content-Length: 999999999999999999",
        b"Content-Length: \xd9\xa3",
        b"Content-Length: -5",
        b"Page-ID: --1",
        b"Payload-Length: --5",
        b"Page-ID: " + b"9" * 25,
        b"Page-ID: 9223372036854775808",
        b"no colon in this line",
        b": no name",
        b"X: " + b"y" * 3_000_000,
    ],
    ids=lambda b: b[:24].decode("utf-8", "replace"),
)
def test_no_header_ends_the_job(spark, tmp_path, line):
    name = line.partition(b":")[0]
    odd = b"\r\n".join(
        line if x.startswith(name + b":") or (x.startswith(b"WARC-Date") and name not in plain(1)) else x
        for x in plain(1).split(b"\r\n")
    )
    assert odd != plain(1)
    path = tmp_path / "odd.warc"
    path.write_bytes(member(0) + odd + gzip.compress(odd) + plain(2))
    files = spark.createDataFrame([(str(path),)], "path string")
    found = warc.read_archives(files).collect()
    ids = [r.page_id for r in found if r.gap is None]
    assert ids[0] == 0 and ids[-1] == 2
    assert all(r.end > r.start for r in found)


@pytest.mark.parametrize("text", [b"WARC/1.1\r\n", b"WARC/1. no\n", b"a: WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"])
@pytest.mark.parametrize("packed", [True, False])
def test_false_version_lines_take_linear_time(text, packed):
    import time

    data = plain(1) + text * 16_000 + plain(2)
    data = gzip.compress(data, mtime=0) if packed else data
    began = time.process_time()
    rows = list(warc.read_file(Bytes(data)))
    took = time.process_time() - began
    assert [int(r[2]["page-id"]) for r in rows if r[2]] == [1, 2]
    assert len([r for r in rows if r[4]]) == 1
    assert took < 1.5


def test_a_payload_of_many_megabytes():
    big = b"<p>long</p>" * 4_000_000
    data = member(1, big) + plain(2, big) + gzip.compress(plain(3, big) + plain(4))
    rows = list(warc.read_file(Bytes(data)))
    assert [int(r[2]["page-id"]) for r in rows] == [1, 2, 3, 4]
    assert rows[2][3].endswith(big)
