import base64
import gzip
import glob
import hashlib

import pytest

from riskloom.llm import warc as w

PAGES = [
    (1, "http://a.example/x?y#z", "<p>one</p>"),
    (2, "http://a.example/b", "<p>one</p>"),
    (3, "http://a.example", None),
    (4, "https://b.example/ä b", ""),
    (5, None, "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nmore é日😀"),
    (6, "http://c.example/\n", "WARC/1.1\r\n" * 3),
    (7, "http://c.example/", "<p>one</p>"),
    (None, "http://d.example/", "<p>one</p>"),
    (8, "http://e.example/", "x" * 300_000 + "\r\n\r\n"),
    (9, "http://e.example/r", "same"),
    (9, "http://e.example/r", "same"),
]


def brute(pages, min_bytes=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = i is not None and i > first[html or ""] and len(data) >= min_bytes
        out.append((i, len(data), digest, "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(make, min_bytes):
    table = make([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string", 2)
    got = w.archive_pages(table, min_bytes=min_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(PAGES, min_bytes)


def test_records_on_disk(make, spark, tmp_path):
    folder = str(tmp_path / "archive")
    table = make(PAGES[:8], "page_id long, url string, html string", 1)
    w.write_warc(w.transactions(table), folder)
    data = b"".join(gzip.open(f).read() for f in glob.glob(folder + "/*.gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    # Walk the file by Content-Length alone, as any reader does.
    kinds, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = w._headers(data[at:end])
        size = int(head["content-length"])
        assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        kinds.append(head["warc-type"])
        at = end + 8 + size
    assert sorted(set(kinds)) == ["metadata", "request", "response", "revisit"] and len(kinds) == 24
    rows = {r.record_id: r for r in w.assemble(w.read_warc(spark, folder)).collect()}
    assert len(rows) == 8
    payloads = {r.metadata.fields.get("page_id"): bytes(r.capture.block) for r in rows.values()}
    assert payloads["5"].decode() == PAGES[4][2] and payloads["6"].decode() == PAGES[5][2] and payloads["2"] == b""
    one = next(r for r in rows.values() if r.metadata.fields.get("page_id") == "1")
    assert one.request.http_head.startswith("GET /x?y HTTP/1.1\r\nHost: a.example")


def test_foreign_archive(spark, tmp_path):
    """Records of another writer: an info record first, several members, missing parts."""
    def record(kind, name, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"Content-Length: {len(block)}"]
        return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\xfe body"
    records = [
        record("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("response", "r1", http, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://x/"),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Concurrent-To: <r1>"),
        record("response", "r2", http, "Content-Type: application/http; msgtype=response"),
        record("request", "q2", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Concurrent-To: <nowhere>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = {r.record_id: r for r in w.assemble(w.read_warc(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    assert bytes(got["<r1>"].capture.block) == b"\xff\xfe body" and got["<r1>"].capture.payload_bytes == 7
    assert got["<r1>"].request.record_id == "<q1>" and got["<r2>"].request is None and got["<r1>"].metadata is None


def test_empty_table(make):
    assert w.archive_pages(make([], "page_id long, url string, html string")).count() == 0
