"""Media columns: pages as interleaved sequences of text and media references, payloads resolved by digest.

`interleave` reads HTML into an ordered array of items: texts, and references with a digest, a position and a caption. Payloads lie
in a table by digest, as PNG images of 8-bit samples (three channels, rows of 192 bytes). `resolve` joins references
and payloads on the digest; only what is needed of a payload (features, checksums) is shuffled, never its bytes. A reference whose payload
isn't there, or that names none, stays as a row without features. A payload that doesn't match its digest fails the job.
Null texts count as empty; they too have a payload (192 blanks).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplewright.llm import markup
from triplewright.llm.common import drop_path, shared_dir, stage, table, text_column, trimmed
from triplewright.llm.tokens import slices

ROW = 192
LEVEL = 2
#: Digests a task remembers so as not to store a payload twice.
REMEMBERED = 200_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = T.StructType([T.StructField("kind", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())])
_ITEM = pa.list_(pa.struct([("kind", pa.string()), ("position", pa.int32()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def payload(data: bytes) -> bytes:
    """data and blanks up to a positive multiple of ROW bytes."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png wrote; each part is checked."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts = 8, {}
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        parts[kind] = parts.get(kind, b"") + data
        at += 12 + n
    width, height, depth, colour = struct.unpack_from(">IIBB", parts[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 3 * width + 1)
    if (depth, colour) != (8, 2) or lines[:, 0].any():
        raise ValueError("not an image of unfiltered 8-bit samples")
    return lines[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Size, mean and deviation per channel, and a difference hash over an 8 by 9 grid, all in integers."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, ROW // 3, 3).astype(np.int64)
    n, sums, squares = pixels.shape[0] * pixels.shape[1], pixels.sum(axis=(0, 1)), (pixels**2).sum(axis=(0, 1))
    mean = [int(100 * s // n) for s in sums]
    deviation = [int(100 * (n * q - s * s) // (n * n)) for s, q in zip(sums.tolist(), squares.tolist())]
    grey = pixels.sum(axis=2)
    bands = np.linspace(0, grey.shape[0], 9).astype(int)
    columns = np.linspace(0, grey.shape[1], 10).astype(int)
    grid = [[int(grey[a : max(b, a + 1) if a < grey.shape[0] else None, c:d].sum()) * 1000 // max(1, (max(b, a + 1) - a) * (d - c)) for c, d in zip(columns, columns[1:])] for a, b in zip(np.minimum(bands, grey.shape[0] - 1), bands[1:])]
    bits = "".join("1" if x < y else "0" for line in grid for x, y in zip(line, line[1:]))
    return f"{grey.shape[1]}x{grey.shape[0]} mean {','.join(map(str, mean))} var {','.join(map(str, deviation))} dhash {int(bits, 2):016x}"


class Figure:
    """One figure of a page: its references in order, and its caption's texts as they stand in the sequence."""

    def __init__(self):
        self.references, self.captions = [], []


class Place:
    """Where an element stands: the figure around it, whether in its caption, and the video or audio around it."""

    __slots__ = ("figure", "caption", "media")

    def __init__(self, figure=None, caption=False, media=None):
        self.figure, self.caption, self.media = figure, caption, media


def source_of(attrs: dict) -> str:
    """Where a media element's payload is: its src, else the first of its srcset."""
    return attrs.get("src", "").strip() or (attrs.get("srcset", "").split() or [""])[0].rstrip(",")


def digest_of(source: str) -> str | None:
    """The digest that a source names, else the SHA-256 of the source itself; null without a source."""
    return None if not source else source[7:] if source.startswith("sha256:") else hashlib.sha256(source.encode()).hexdigest()


def items(html: str) -> list[dict]:
    """Texts and media references in page order. A reference's caption is its figure's figcaption, else its alt text.

    A video or audio without a source of its own has that of its first source element, an image without one that of the picture's. Captions of figures
    without media are texts. A reference without any source has no digest.
    """
    out, figures, waiting = [], [], []

    def enter(tag, attrs, outer, _):
        if tag in ("script", "style", "head", "title", "noscript", "template"):
            return markup.HIDDEN
        place = outer or Place()
        if tag == "figure":
            figures.append(Figure())
            return Place(figures[-1])
        if tag == "figcaption" and place.figure:
            return Place(place.figure, True)
        if tag == "picture":
            return Place(place.figure, place.caption, [None])
        if tag in ("video", "audio"):
            return Place(place.figure, place.caption, [digest_of(source_of(attrs))])
        if tag == "source" and place.media and not place.media[0]:
            place.media[0] = digest_of(source_of(attrs))
        return place

    for block in markup.read(html or "", enter):
        place = block.element.state or Place()
        if block.kind == "media":
            attrs = block.element.attributes
            found = {"kind": block.element.tag, "position": 0, "text": None, "digest": digest_of(source_of(attrs)), "caption": attrs.get("alt") or None}
            if not found["digest"] and place.media:
                waiting.append((found, place.media))
            if place.figure:
                place.figure.references.append(found)
        else:
            found = {"kind": "text", "position": 0, "text": block.text, "digest": None, "caption": None}
            if place.caption:
                place.figure.captions.append(found)
        out.append(found)
    for found, media in waiting:
        found["digest"] = media[0]
    as_captions = set()
    for figure in figures:
        if figure.references and figure.captions:
            for found in figure.references:
                found["caption"] = " ".join(c["text"] for c in figure.captions)
            as_captions.update(map(id, figure.captions))
    out = [found for found in out if id(found) not in as_captions]
    for i, found in enumerate(out):
        found["position"] = i
    return out


def _interleaved(batches, rest: list[str], html: str, into: str):
    for batch in batches:
        at = 0
        for part in slices(batch.column(html)):
            rows, found = batch.slice(at, len(part)), pa.array([items(h.as_py()) for h in part], _ITEM)
            at += len(part)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), found], [*rest, into])


def interleave(df: DataFrame, html: str = "html", into: str = "items") -> DataFrame:
    """df with an array of items (kind, position, text, digest, caption) in place of its HTML."""
    rest = [c for c in df.columns if c not in (html, into)]
    return df.mapInArrow(lambda batches: trimmed(_interleaved(batches, rest, html, into)), T.StructType([*(df.schema[c] for c in rest), T.StructField(into, T.ArrayType(ITEM))]))


def store(df: DataFrame, base: str, id: str = "doc_id", text: str = "text") -> None:
    """Writes documents below base: a row each, with its size, its payload's digest, and the payload if the task hasn't stored it yet."""

    def run(batches):
        known = set()
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = (t.as_py() or "").encode()
                whole = payload(data)
                digest = hashlib.sha256(whole).hexdigest()
                fresh = digest not in known
                if fresh and len(known) < REMEMBERED:
                    known.add(digest)
                rows.append((doc, len(data), digest, to_png(whole) if fresh else None))
                if len(rows) == 500:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "digest", "media"])

    source = df.select(F.col(id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    source.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, n_bytes long, digest string, media binary").write.option("compression", "lz4").parquet(base)


def payload_features(stored: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each stored payload, once per digest."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column("digest").to_pylist(), batch.column("media")):
                image = image.as_py()
                data = from_png(image)
                found = hashlib.sha256(data).hexdigest()
                if found != digest:
                    raise ValueError(f"payload {digest} doesn't match its digest")
                rows.append((digest, len(data), found, zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(data)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

    return stored.where("media is not null").select("digest", "media").mapInArrow(lambda batches: trimmed(run(batches)), schema).dropDuplicates(["digest"])


def page_of(text: str, digest: str, n_bytes: int) -> str:
    """A document as a page: its lines as paragraphs, its payload as a figure after the first half of them."""
    lines = [f"<p>{escape(line)}</p>" for line in text.split("\n")]
    figure = f'<figure><img src="sha256:{digest}" alt="samples"><figcaption>{n_bytes} bytes</figcaption></figure>'
    half = (len(lines) + 1) // 2
    return f"<article>{''.join(lines[:half])}{figure}{''.join(lines[half:])}</article>"


def _as_pages(batches):
    for batch in batches:
        at = 0
        for part in slices(batch.column("text")):
            texts = [t or "" for t in part.to_pylist()]
            sizes, html = [], []
            for t in texts:
                data = t.encode()
                sizes.append(len(data))
                html.append(page_of(t, hashlib.sha256(payload(data)).hexdigest(), len(data)))
            docs = batch.column("doc_id").slice(at, len(part))
            at += len(part)
            yield pa.RecordBatch.from_arrays([docs, pa.array(sizes, pa.int64()), pa.array(html, pa.string())], ["doc_id", "n_bytes", "html"])


def pages(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, html): the whole text of each document as the page_of it."""
    source = df.select(F.col(id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    return source.mapInArrow(lambda batches: trimmed(_as_pages(batches)), "doc_id long, n_bytes long, html string")


def sequences(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, items): what interleave gives for pages, by one worker instead of two, which hold pages and their Arrow batches twice.
    """
    source = df.select(F.col(id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    rest = ["doc_id", "n_bytes"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in rest), T.StructField("items", T.ArrayType(ITEM))])
    return source.mapInArrow(lambda batches: trimmed(_interleaved(_as_pages(batches), rest, "html", "items")), schema)


def resolve(df: DataFrame, features: DataFrame) -> DataFrame:
    """A row for each media reference of df (..., items): its position and caption, and what features has for its digest (null if nothing)."""
    rest = [c for c in df.columns if c != "items"]
    return df.select(*rest, F.explode(F.filter("items", lambda x: x.kind != "text")).alias("item")).select(*rest, F.col("item.position").alias("position"), F.col("item.caption").alias("caption"), F.col("item.digest").alias("digest")).join(features, "digest", "left")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features are written before the join, so that both of its sides are dealt for it and a digest of very many references is split.

    n_items and text_sha256 are of the interleaved sequence: its length, and its texts joined by line ends.
    """
    base, documents = shared_dir(spark), table(spark, sf_dir, "documents")
    store(documents, base)
    features = stage(payload_features(spark.read.parquet(base)))
    drop_path(spark, base)
    texts = F.transform(F.filter("items", lambda x: x.kind == "text"), lambda x: x.text)
    found = sequences(documents).withColumns({"n_items": F.size("items").cast("long"), "text_sha256": F.sha2(F.array_join(texts, "\n"), 256)})
    found = resolve(found, features)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "text_sha256")
