import gzip
import hashlib
import os

import pytest

from veilspark.llm import warc
from veilspark.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, value string, k int, d string, n int"


def rows():
    long = "".join(f"<p>{i} é \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" for i in range(60))
    same = "same page " * 20
    out = [(1, "http://a/", same), (2, "http://b/", same), (3, None, same), (4, "http://c/", "x" * 99), (5, "http://d/", "x" * 99),
           (6, "http://e/", None), (7, "http://f/", ""), (8, "http://g/\r\nWARC-Type: x\n", long), (9, "http://h/", long),
           (10, "http://i/", "\r\n" * 60), (11, "", "ends with a line end\r\n" * 9), (12, "u", "\r" * 120 + "\n"),
           (None, "http://n/", "no id " * 30), (None, "http://n/", same), (1, "http://a/", same), (13, "u", "é" * 900)]
    return [(i, u, h, "v", 1, "d", 2) for i, u, h in out]


def expected(rows):
    first = {}
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        refers = first.get(raw) if first.get(raw) != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("chunk", [7, 1000, warc.CHUNK])
def test_round_trip(spark, chunk):
    path = shared_path(spark, "warc")
    data = rows()
    warc.write(spark.createDataFrame(data, SCHEMA), path, chunk=chunk)
    got = warc.read(spark, path).collect()
    last = [r for r in got if r.last]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in last), key=key) == sorted(
        expected(data), key=key)
    assert all(r.intact for r in last if r.record_type == "response")
    texts = {i: (h or "").encode() for i, _, h, *_ in data}
    for page in (6, 8, 10, 11, 12, 13):
        parts = sorted((r for r in got if r.page_id == page), key=lambda r: r.chunk)
        sha, at = hashlib.sha256(), 0
        for n, r in enumerate(parts):
            assert (r.chunk, r.offset) == (n, at) and len(bytes(r.data).decode()) <= chunk
            sha.update(bytes(r.data))
            at += len(r.data)
            assert (r.bytes_so_far, r.sha256_so_far) == (at, sha.hexdigest())
        assert b"".join(bytes(r.data) for r in parts) == texts[page]
    slim = warc.read(spark, path, payload=False).collect()
    assert len(slim) == len(got) and all(r.data is None for r in slim)


def test_archive_is_plain_warc(spark):
    """Read record by record from the Content-Length alone."""
    path = shared_path(spark, "warc")
    warc.write(spark.createDataFrame(rows(), SCHEMA).coalesce(1), path, chunk=1000)
    raw = b"".join(gzip.open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.endswith(".gz"))
    kinds, ids = [], []
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        size = int(fields[b"Content-Length"])
        assert raw[size:size + 4] == b"\r\n\r\n"
        raw = raw[size + 4:]
        kinds.append(fields[b"WARC-Type"])
        ids.append(fields[b"WARC-Record-ID"])
    assert set(kinds) == {b"response", b"revisit", b"continuation"}


def test_damage_is_reported(spark):
    path = shared_path(spark, "warc")
    os.makedirs(path)
    with open(f"{path}/a.warc", "wb") as f:
        f.write(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception, match="ends inside a record|longer than"):
        warc.read(spark, path).collect()


def test_empty(spark):
    path = shared_path(spark, "warc")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0
