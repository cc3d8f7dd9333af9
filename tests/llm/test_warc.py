import base64
import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from triplewright.llm import warc
from triplewright.llm.files import local_path

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def plain(rows, least):
    """The contract in plain Python: (page_id, payload bytes, digest, type, refers_to) of rows (page_id, url, html)."""
    groups = {}
    for i, url, html in rows:
        raw = (html or "").encode()
        groups.setdefault(raw, []).append((i, url or ""))
    out = []
    for raw, pages in groups.items():
        digest = hashlib.sha1(raw).hexdigest()
        pages.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1].encode()))
        for k, (i, _) in enumerate(pages, 1):
            first = len(raw) < least or k == len(pages)
            out.append((i, len(raw), digest, "response" if first else "revisit", None if first else pages[-1][0]))
    return sorted(out, key=str)


def odd_pages(spark):
    """Null and empty pages, shared payloads, rows repeated as a whole, null ids, a long page, line ends in URLs."""
    big, other, long = "é" * 600, "x\r\n\r\nWARC/1.1\r\n" * 100, "<p>long</p>" * 400_000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "u", big), (9, "u", big), (9, "v\r\nX: y", big), (9, "v\r\nX: y", big), (9, "v\r\nX: y", big), (3, None, other), (4, "http://b", "short"), (5, "http://b", "short")]
    rows += [(None, "n", "z" * 2000), (None, "n", "z" * 2000), (None, "m", "z" * 2000), (None, "n", None), (6, "e", ""), (6, "e", None), (7, "l", long), (8, "l", long), (11, "é ü", other)]
    return spark.createDataFrame([(*r, "x", b"y", 3) for r in rows], "page_id long, url string, html string, sha1 string, payload binary, n int"), rows


def found(written):
    return sorted((tuple(r[c] for c in COLUMNS) for r in warc.resolved(warc.read(written)).collect()), key=str)


@pytest.mark.parametrize("least, most", [(1000, 64 << 20), (3, 500)])
def test_equals_plain_python(spark, tmp_path, least, most):
    df, rows = odd_pages(spark)
    written = warc.write(df.repartition(3), str(tmp_path), least=least, most=most)
    assert found(written) == plain(rows, least)
    assert written.count() > (3 if most < 1000 else 0)
    none = warc.write(df.limit(0), str(tmp_path))
    assert none.count() == 0 and found(none) == []


def test_payloads_come_back_and_the_format_is_plain_gzip(spark, tmp_path):
    df, rows = odd_pages(spark)
    written = warc.write(df, str(tmp_path))
    read = warc.read(written, payload=True).collect()
    kept = sorted(r.payload.decode() for r in read if r.record_type == "response")
    shared = {}
    for i, _, html in rows:
        shared.setdefault(html or "", []).append(i)
    assert kept == sorted(html for html, ids in shared.items() for _ in (ids if len(html.encode()) < 1000 else ids[:1]))
    n = 0
    for r in written.collect():
        raw = open(local_path(r.archive), "rb").read()
        assert len(raw) == r.bytes
        whole, at = gzip.decompress(raw), 0
        while at < len(whole):  # framed by content lengths alone
            head, _, _ = whole[at:].partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            start = at + len(head) + 4
            block = whole[start : start + int(fields["Content-Length"])]
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            at = start + len(block) + 4
            assert whole[at - 4 : at] == b"\r\n\r\n"
            n += 1
        members = 0
        while raw:  # a member a record
            inflate = zlib.decompressobj(31)
            inflate.decompress(raw)
            raw, members = inflate.unused_data, members + 1
        assert members == r.records
    assert n == len(rows)


def test_what_is_altered_or_cut_fails(spark):
    sha1 = hashlib.sha1(b"hello" * 9000).digest()
    one = warc.record(1, "u", b"hello" * 9000, sha1, 45000, "<a>", None)
    two = warc.record(2, "u", b"", sha1, 45000, "<b>", "<a>")
    assert [r["record_type"] for r in warc.records(io.BytesIO(one + two))] == ["response", "revisit"]
    text = gzip.decompress(one)
    bad = [one[:-9], one + two[:30], one + b"junk", gzip.compress(text.replace(b"hello", b"jello", 1)), gzip.compress(text[:-2]), gzip.compress(text + b"\r\n"), gzip.compress(text + text), gzip.compress(text.replace(b"Content-Length: 45", b"Content-Length: 44"))]
    bad += [gzip.compress(text.replace(b"WARC/1.1", b"HTTP/1.1")), one[:200] + bytes([one[200] ^ 255]) + one[201:], gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n")]
    for raw in bad:
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(raw)))


def test_records_of_others(spark):
    """Other types, continued fields, plain blocks, digests in hexadecimal or of another kind."""
    body = b"software: x\r\n"
    head = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <i>\r\nWARC-Filename: a\r\n b\r\nWARC-Block-Digest: sha1:" + hashlib.sha1(body).hexdigest().encode() + b"\r\nWARC-Payload-Digest: md5:x\r\nContent-Length: %d\r\n\r\n" % len(body)
    (one,) = warc.records(io.BytesIO(gzip.compress(head + body + b"\r\n\r\n")), keep=True)
    assert one["record_type"] == "warcinfo" and one["payload"] == body and one["payload_digest"] == hashlib.sha1(body).hexdigest() and one["page_id"] is None


def test_lost_records_and_lost_responses_fail(spark, tmp_path):
    df, _ = odd_pages(spark)
    written = warc.write(df, str(tmp_path))
    with pytest.raises(Exception, match="records of"):
        warc.read(written.selectExpr("archive", "records + 1 as records", "bytes")).count()
    read = warc.read(written)
    with pytest.raises(Exception, match="no response"):
        warc.resolved(read.where("record_type = 'revisit'")).collect()


def test_equals_sql(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"create view pages as from '{sf_dir}/pages.parquet'")
    expected = connection.execute(f"select {', '.join(COLUMNS)} from ({warc.OP13_SQL})").fetchall()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in warc.op13_warc(spark, sf_dir).collect()), key=str) == sorted(expected, key=str)
