"""WARC archives: pages written as records, one gzip member each, and read back record by record.

Writing. A payload of at least `least` bytes that several pages share is kept once: the page of the largest id is the response, the others are
revisits of it (identical-payload-digest) that carry the HTTP head alone. Which page that is comes from a table of payload digests, one row
per shared payload, made without moving payloads. Each task writes archives of about ARCHIVE_BYTES, and a table written by Spark names them:
archives of lost or repeated attempts are never read.

Reading. Each archive is read in sequence: blocks of the file go through an incremental decompressor, a new one per member; the record's head
ends at the empty line, its content is as long as Content-Length says, two line ends follow, and a member holds exactly one record. Block and
payload digests are recomputed while the content goes by and must equal the record's. What is cut short, altered or framed wrongly fails the job.
A revisit's reference is resolved by record id to a response of the same digest; one without is an error.

Null html and urls count as empty (an empty URL is left out of the record). Pages whose id is null are archived too; as a response they are last in line, and their revisits refer to null.
Rows repeated as a whole are pages of their own: one is the response, the others revisit it. Other columns are ignored, whatever their names. An empty
table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import shared_dir, stage, table, trimmed
from triplewright.llm.files import create, read_stream

LEAST_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_BLOCK = 1 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")  # UUIDs of object identifiers
#: Extension field: the page's id.
PAGE = "X-Page-ID"


class WarcError(ValueError):
    """An archive that isn't whole or isn't what it says."""


def labelled(sha1: bytes) -> str:
    return f"sha1:{base64.b32encode(sha1).decode()}"


def response_id(page_id: int | None, sha1: bytes) -> str:
    """The record id of a shared payload's response, which its revisits can tell without seeing it."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{sha1.hex()}')}>"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record(page_id: int | None, url: str, payload: bytes, sha1: bytes, n: int, record_id: str, refers_to: str | None) -> bytes:
    """A record as a gzip member: a revisit if it refers to another record (payload is then empty), else a response. n: bytes of the full payload."""
    block = http_head(n) + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", url.translate(_BARE)), (PAGE, page_id),
        ("WARC-Refers-To", refers_to), ("WARC-Profile", refers_to and REVISIT_PROFILE), ("WARC-Payload-Digest", labelled(sha1)), ("WARC-Block-Digest", labelled(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v not in (None, ""))
    zipped = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return zipped.compress(VERSION + b"\r\n" + head.encode() + b"\r\n") + zipped.compress(block) + zipped.compress(b"\r\n\r\n") + zipped.flush()


#: A field is one line: line ends in a URL are escaped.
_BARE = {10: "%0A", 13: "%0D"}


def pages(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, n) without nulls but in page_id; sha1 in hexadecimal."""
    given = df.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    return given.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))


def shared_payloads(given: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(sha1, n, of, of_url, twins) of each payload that several rows have: the response's page_id and url, and how many rows have both.

    An id beats none, the largest wins, and of its rows the last url by its bytes.
    """
    rows = given.where(F.col("n") >= least).groupBy("sha1", "n", "page_id", "url").agg(F.count("*").alias("twins"))
    lead = F.max(F.struct(F.col("page_id").isNotNull().alias("there"), "page_id", "url", "twins")).alias("lead")
    found = rows.groupBy("sha1", "n").agg(F.sum("twins").alias("copies"), lead).where("copies > 1")
    return found.select("sha1", "n", F.col("lead.page_id").alias("of"), F.col("lead.url").alias("of_url"), "lead.twins")


def members(given: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, sha1, n, member): each page as a response."""

    def run(batches):
        for batch in batches:
            made = []
            for page_id, url, payload, sha1, n in zip(*(c.to_pylist() for c in batch.columns)):
                raw = bytes.fromhex(sha1)
                made.append(record(page_id, url, payload, raw, n, response_id(page_id, raw) if n >= least else f"<urn:uuid:{uuid.uuid4()}>", None))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "sha1", "n")), pa.array(made, pa.binary())], ["page_id", "url", "sha1", "n", "member"])

    return given.select("page_id", "url", "payload", "sha1", "n").mapInArrow(lambda batches: trimmed(run(batches)), "page_id long, url string, sha1 string, n long, member binary")


def archives(rows: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, sha1, n, member, of, revisit) and names the archives: (archive, records, bytes)."""

    def run(batches):
        uri, stream, records, size = None, None, 0, 0
        for batch in batches:
            for page_id, url, sha1, n, member, of, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if revisit:
                    raw = bytes.fromhex(sha1)
                    member = record(page_id, url, b"", raw, n, f"<urn:uuid:{uuid.uuid4()}>", response_id(of, raw))
                if stream is None:
                    uri, stream = create(folder, ".warc.gz")
                stream.write(member)
                records, size = records + 1, size + len(member)
                if size >= most:
                    stream.close()
                    yield pa.RecordBatch.from_pydict({"archive": [uri], "records": [records], "bytes": [size]})
                    stream, records, size = None, 0, 0
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"archive": [uri], "records": [records], "bytes": [size]})

    ordered = rows.select("page_id", "url", "sha1", "n", "member", "of", "revisit")
    return stage(ordered.mapInArrow(lambda batches: trimmed(run(batches)), "archive string, records long, bytes long"))


def write(df: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each page as a record of an archive in folder; (archive, records, bytes)."""
    given = pages(df, id, url, html)
    shared = stage(shared_payloads(given, least))
    made = members(given, least)
    # what no other row can share needs no partner: its key is its own
    key = F.when(F.col("n") >= least, F.col("sha1")).otherwise(F.hex(F.xxhash64("page_id", "url")))
    joined = made.withColumn("key", key).join(shared.select(F.col("sha1").alias("key"), "of", "of_url", "twins", F.lit(True).alias("shared")).hint("merge"), "key", "left")
    lead = "page_id <=> of and url = of_url"
    rows = joined.where(f"shared is null or not ({lead} and twins > 1)").withColumn("revisit", F.expr(f"shared is not null and not ({lead})"))
    out = archives(rows, folder, most)
    twins = shared.where("twins > 1")
    if not twins.isEmpty():
        # rows repeated as a whole: one of them is the response, the others its revisits
        once = joined.where(f"{lead} and twins > 1").dropDuplicates(["sha1"]).withColumn("revisit", F.lit(False))
        blocks = twins.select("sha1", "n", "of", "of_url", "twins", F.explode(F.expr("sequence(0, (twins - 2) div 10000)")).alias("block")).repartition("sha1", "block")
        more = blocks.select("sha1", "n", "of", F.col("of").alias("page_id"), F.col("of_url").alias("url"), F.explode(F.expr("sequence(2 + 10000 * block, least(twins, 10001 + 10000 * block))")).alias("copy"))
        more = more.withColumns({"member": F.lit(None).cast("binary"), "revisit": F.lit(True)}).drop("copy")
        out = out.unionByName(archives(once, folder, most)).unionByName(archives(more, folder, most))
    return out


class Member:
    """The bytes of one gzip member, decompressed as they are asked for; what follows it in the file is given back."""

    def __init__(self, take, first: bytes):
        self.take, self.inflate, self.held, self.left = take, zlib.decompressobj(31), bytearray(), first

    def more(self) -> bool:
        """Decompresses a block more; False at the member's end."""
        if self.inflate.eof:
            return False
        data = self.left or self.take()
        if not data:
            raise WarcError("the archive ends within a member")
        self.left = b""
        try:
            self.held += self.inflate.decompress(data)
        except zlib.error as e:
            raise WarcError(f"a member can't be decompressed: {e}") from None
        if self.inflate.eof:
            self.left = self.inflate.unused_data
        return True

    def line(self) -> bytes:
        """Up to the next CR LF, which is dropped."""
        at = 0
        while (end := self.held.find(b"\r\n", at)) < 0:
            at = max(0, len(self.held) - 1)
            if not self.more():
                raise WarcError("a head ends without an empty line")
        found = bytes(self.held[:end])
        del self.held[: end + 2]
        return found

    def content(self, n: int):
        """The next n bytes, in blocks."""
        while n:
            if not self.held and not self.more():
                raise WarcError("a record is shorter than its Content-Length")
            block = bytes(self.held[:n])
            del self.held[: len(block)]
            n -= len(block)
            if block:
                yield block

    def end(self) -> bytes:
        """Checks that two line ends and no more follow; what the file has after the member."""
        tail = b"".join(self.content(4))
        while not self.held and self.more():
            pass
        if tail != b"\r\n\r\n" or self.held:
            raise WarcError("a record is longer than its Content-Length")
        return self.left


def fields(member: Member) -> dict[str, str]:
    """Named fields up to the empty line, names in lower case; continued lines are joined."""
    out, name = {}, None
    while line := member.line():
        if line[:1] in b" \t" and name:
            out[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError(f"not a field: {line[:80]!r}")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def digest_of(value: str | None) -> str | None:
    """SHA-1 of a digest field in hexadecimal; None where there is none or it is of another kind."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return (bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())).hex()
    except ValueError:
        raise WarcError(f"not a digest: {value}") from None


def split_http(blocks):
    """(head, blocks of what follows) of an HTTP message that comes in blocks."""
    held = b""
    for block in blocks:
        at = max(0, len(held) - 3)
        held += block
        if (end := held.find(b"\r\n\r\n", at)) >= 0:
            return held[: end + 4], (x for part in ((held[end + 4 :],), blocks) for x in part)
    return held, iter(())


def read_record(member: Member, keep: bool) -> dict:
    """One record, its digests checked; its payload is kept if asked for."""
    if not member.line().startswith(b"WARC/"):
        raise WarcError("a record doesn't begin with its version")
    given = fields(member)
    if not given.get("content-length", "").isdigit():
        raise WarcError("a record has no Content-Length")
    of_block, of_payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, []

    def seen(blocks):
        for block in blocks:
            of_block.update(block)
            yield block

    blocks, length = seen(member.content(int(given["content-length"]))), None
    if given.get("content-type", "").startswith("application/http"):
        head, blocks = split_http(blocks)
        length = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"), None)
    for block in blocks:
        of_payload.update(block)
        size += len(block)
        if keep:
            kept.append(block)
    stated, revisit = digest_of(given.get("warc-payload-digest")), given.get("warc-type") == "revisit"
    if (d := digest_of(given.get("warc-block-digest"))) and d != of_block.hexdigest():
        raise WarcError(f"the block of {given.get('warc-record-id')} isn't that of its digest")
    if not revisit and ((stated and stated != of_payload.hexdigest()) or (length is not None and length != size)):
        raise WarcError(f"the payload of {given.get('warc-record-id')} isn't that of its digest and length")
    page = given.get(PAGE.lower())
    return {
        "record_type": given.get("warc-type"), "record_id": given.get("warc-record-id"), "url": given.get("warc-target-uri"), "page_id": int(page) if page else None,
        "payload_bytes": length if revisit else size, "payload_digest": stated if revisit else of_payload.hexdigest(), "refers_to_id": given.get("warc-refers-to"), "payload": b"".join(kept) if keep and not revisit else None,
    }


def records(stream, keep: bool = False):
    """The records of an archive, from its first byte to its last."""
    take = lambda: stream.read(1 << 16)  # noqa: E731  what a block of it decompresses to is bounded
    left = take()
    while left:
        member = Member(take, left)
        yield read_record(member, keep)
        left = member.end() or take()


_RECORD = "record_type string, record_id string, url string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, payload binary"


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """A row per record of archives (archive[, records, bytes]); where these say how many records an archive has, it must have so many.

    payload: whether payloads come along (null for revisits).
    """
    given = archives.select("archive", F.col("records") if "records" in archives.columns else F.lit(None).cast("long").alias("records"))
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, held, size = 0, [], 0
                with read_stream(uri) as stream:
                    for one in records(stream, payload):
                        n += 1
                        held.append(one)
                        size += 500 + len(one["payload"] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                            held, size = [], 0
                if expected is not None and n != expected:
                    raise WarcError(f"{uri} has {n} records of {expected}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, _SCHEMA)

    # an archive a task: they are of bounded size
    spread = given.repartition(max(1, archives.count()))
    return spread.mapInArrow(lambda batches: trimmed(run(batches)), _RECORD).select(*(names if payload else names[:-1]))


_SCHEMA = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to_id", pa.string()), ("payload", pa.binary()),
])


def resolved(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of responses and revisits; refers_to is the page_id of the response that a revisit names.

    A revisit whose response isn't there, or has another payload, is an error.
    """
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    plain = found.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    of = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("of"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    revisits = found.where("record_type = 'revisit'").join(of, "refers_to_id", "left")
    same = F.expr("coalesce(of_digest = payload_digest and of_bytes = payload_bytes, false)")
    refers = F.when(same, F.col("of")).otherwise(F.raise_error(F.concat(F.lit("no response of the same payload: "), F.coalesce("refers_to_id", F.lit("")))).cast("long"))
    return plain.unionByName(revisits.select(*columns, refers.alias("refers_to")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write(table(spark, sf_dir, "pages"), shared_dir(spark))
    return resolved(stage(read(written)))


OP13_SQL = """
with given as (select page_id, encode(coalesce(html, '')) as payload from pages),
facts as (select page_id, octet_length(payload) as n, sha1(payload) as digest from given),
leads as (select digest, max(page_id) as lead from facts where n >= 1000 group by digest)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
       case when n < 1000 or page_id = lead then 'response' else 'revisit' end as record_type,
       case when n >= 1000 and page_id <> lead then lead end as refers_to
from facts left join leads using (digest)
"""
