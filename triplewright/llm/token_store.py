"""A content-addressed store of token ids.

Layout below one folder, all Parquet:
- chunks: (digest, n, data), each distinct chunk once; data holds n ids as little-endian unsigned integers of
  WIDTH bytes, digest is their BLAKE2b-128. Rolling hashes over a window of ids decide where a stream is cut, so equal passages
  give equal chunks wherever they stand.
- recipes: one row per document in ascending doc_id order: (part, row, doc_id, start, n_tokens, recipe, leaf);
  recipe lists (digest, n); start counts the ids of all documents before; leaf is the SHA-256 of the document's doc_id, length and recipe.
- manifest: (part, root, docs, tokens): the Merkle root of each part's leaves in order, and what the part holds.

Writing: documents are encoded and cut where they are read; each task keeps a chunk it has seen out of its output, then chunks are made
unique by digest in one shuffle. Recipes are sorted by ranges of doc_id and, among equal ids, of the row's number as it was read, so that
an id of very many rows (or null) is shared out too; starts come from running sums within a part and the sums of the parts before it.
Reading: `check_manifest` recomputes each part's root, documents and tokens from the recipes' leaves; `verified` does that first, then checks
every chunk against its digest and every recipe against its leaf, and gives each document's checksum by combining its
chunks' checksums in order. A chunk, recipe or part that is missing or altered fails the job. `read` gives the ids themselves.
Null texts count as empty (one end id). Rows with equal or null doc_id stay separate documents, null ids first. Ids that WIDTH bytes can't
hold are refused.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.llm.common import drop_path, shared_dir, table, text_column, trimmed
from triplewright.llm.tokens import SLICE_BYTES, slices, tokenizer_path, word_encoder

VOCABULARY = "word_bpe_49k.json"
END = 2
WIDTH = 2
#: Ids of the rolling window; a cut where the mixed sum's low bits are zero; least and most ids of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 64, 2048
#: Bytes of a chunk in a leaf: its digest and length.
ENTRY = 16 + 4
#: Digests a task remembers so as not to send a chunk twice; others are made unique later.
REMEMBERED = 200_000
_RECIPE = "array<struct<digest: binary, n: int>>"
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) << np.uint64(1)


def boundaries(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, the last being its length."""
    n, out, at = len(ids), [], 0
    if n > LEAST:
        sums = np.cumsum(_GEAR[ids & 0xFFFF], dtype=np.uint64)
        rolled = sums.copy()
        rolled[WINDOW:] -= sums[:-WINDOW]
        mixed = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CUT_BITS)
        for end in (np.flatnonzero(mixed[WINDOW - 1 :] == 0) + WINDOW).tolist():
            while end - at > MOST:
                at += MOST
                out.append(at)
            if end - at >= LEAST:
                at = end
                out.append(at)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return out + [n] if n > at else out


def leaf(doc: int | None, n_tokens: int, recipe: list[tuple[bytes, int]]) -> bytes:
    return leaf_of(doc, n_tokens, b"".join(d + n.to_bytes(4, "little") for d, n in recipe))


def leaf_of(doc: int | None, n_tokens: int, recipe: bytes) -> bytes:
    """The leaf of a recipe that is packed already: digest and length of each chunk, ENTRY bytes together."""
    head = b"\0" + (b"-" if doc is None else doc.to_bytes(8, "little", signed=True)) + n_tokens.to_bytes(8, "little")
    return hashlib.sha256(head + recipe).digest()


def packed(recipes: pa.ListArray) -> tuple[bytes, list[int]]:
    """Recipes one after the other as leaf_of takes them, and where each begins and the last ends."""
    entries = recipes.flatten()
    digests, sizes = b"".join(entries.field("digest").to_pylist()), entries.field("n").to_numpy(zero_copy_only=False)
    out = np.empty((len(sizes), ENTRY), np.uint8)
    out[:, :-4] = np.frombuffer(digests, np.uint8).reshape(-1, ENTRY - 4)
    out[:, -4:] = sizes.astype("<u4").view(np.uint8).reshape(-1, 4)
    bounds = np.zeros(len(recipes) + 1, np.int64)
    np.cumsum(recipes.value_lengths().to_numpy(zero_copy_only=False), out=bounds[1:])
    return out.tobytes(), (ENTRY * bounds).tolist()


class Merkle:
    """Root over leaves added one by one; holds one digest per level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, digest: bytes) -> None:
        for i, left in enumerate(self.levels):
            if left is None:
                self.levels[i] = digest
                return
            self.levels[i], digest = None, hashlib.sha256(b"\1" + left + digest).digest()
        self.levels.append(digest)

    def root(self) -> bytes:
        out = b""
        for left in self.levels:
            if left is not None:
                out = hashlib.sha256(b"\2" + left + out).digest()
        return out or hashlib.sha256(b"").digest()


@lru_cache(maxsize=8192)
def _zeros(n: int) -> np.ndarray:
    """The linear map, as 32 columns, that CRC-32 undergoes over n zero bytes."""
    if n == 1:
        one = np.array([1 << i for i in range(32)], np.uint32)
        for _ in range(8):
            one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
        return one
    half = _zeros(n // 2)
    out = _apply(half, half)
    return _apply(_zeros(1), out) if n & 1 else out


def _apply(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    bits = (v[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits, matrix[None], np.uint32(0)), axis=1).astype(np.uint32)


@lru_cache(maxsize=8192)
def _columns(n: int) -> tuple[int, ...]:
    return tuple(_zeros(n).tolist())


def combined(crc: int, after: int, n: int) -> int:
    """CRC-32 of two byte strings one after the other, n being the second's length."""
    if not n:
        return crc
    columns = _columns(n)
    while crc:  # plain integers: one number is too little for an array
        low = crc & -crc
        after ^= columns[low.bit_length() - 1]
        crc ^= low
    return after


def _before():
    """Ids of all parts before a part; a manifest has a row for each task that wrote recipes."""
    return F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def write(df: DataFrame, base: str, end: int = END, path: str | None = None) -> None:
    """Writes documents df (doc_id, text) as a store below base."""
    spark, path = df.sparkSession, path or tokenizer_path(VOCABULARY)

    def encoded(batches):
        encoder, known = word_encoder(path), set()
        if max(len(encoder.ends) - 1, end + 1) > 1 << 8 * WIDTH:
            raise ValueError(f"ids of this vocabulary don't fit into {WIDTH} bytes")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for part in slices(batch.column("text"), 2 * SLICE_BYTES):
                ids, offsets = encoder.encode(part)
                n_docs = len(offsets) - 1
                # every document's ids and its end id, one after the other
                stream = np.insert(ids, offsets[1:], end).astype(f"<u{WIDTH}")
                bounds = (offsets + np.arange(n_docs + 1)).tolist()
                raw, digests, sizes, fresh, ends, fresh_ends = stream.tobytes(), [], [], [], [0], [0]
                for a, b in zip(bounds, bounds[1:]):
                    last = a
                    for stop in boundaries(stream[a:b]):
                        stop += a
                        data = raw[WIDTH * last : WIDTH * stop]
                        digest = hashlib.blake2b(data, digest_size=16).digest()
                        if digest not in known:
                            if len(known) < REMEMBERED:
                                known.add(digest)
                            fresh.append((digest, stop - last, data))
                        digests.append(digest)
                        sizes.append(stop - last)
                        last = stop
                    ends.append(len(digests))
                    fresh_ends.append(len(fresh))
                columns = list(zip(*fresh)) or [(), (), ()]
                recipes = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["digest", "n"])
                chunks = pa.StructArray.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["digest", "n", "data"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n_docs), pa.array(range(row, row + n_docs), pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), recipes), pa.ListArray.from_arrays(pa.array(fresh_ends, pa.int32()), chunks),
                    ],
                    ["doc_id", "tie", "n_tokens", "recipe", "chunks"],
                )
                at, row = at + n_docs, row + n_docs

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column())
    staged = source.mapInArrow(lambda batches: trimmed(encoded(batches)), f"doc_id long, tie long, n_tokens long, recipe {_RECIPE}, chunks array<struct<digest: binary, n: int, data: binary>>")
    staged.write.option("compression", "zstd").parquet(f"{base}/staged")
    staged = spark.read.parquet(f"{base}/staged")
    chunks = staged.select(F.explode("chunks").alias("c")).select("c.*").dropDuplicates(["digest"])
    chunks.write.option("compression", "zstd").parquet(f"{base}/chunks")

    def numbered(batches):
        part, row, start, tree, held = TaskContext.get().partitionId(), 0, 0, Merkle(), None
        names = ["part", "row", "doc_id", "local", "n_tokens", "recipe", "leaf", "root"]

        def batch_of(columns, root=None):
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), *columns, pa.array([None] * (n - 1) + [root], pa.binary())], names)

        for batch in (b for b in batches if b.num_rows):
            recipes, leaves, tokens = batch.column("recipe"), [], batch.column("n_tokens").to_numpy()
            raw, bounds = packed(recipes)
            for doc, n, a, b in zip(batch.column("doc_id").to_pylist(), tokens.tolist(), bounds, bounds[1:]):
                leaves.append(leaf_of(doc, n, raw[a:b]))
                tree.add(leaves[-1])
            ends = start + np.cumsum(tokens)
            if held:
                yield batch_of(held)
            held = [pa.array(np.arange(row, row + len(leaves)) + (part << 40)), batch.column("doc_id"), pa.array(ends - tokens), batch.column("n_tokens"), recipes, pa.array(leaves, pa.binary())]
            row, start = row + len(leaves), int(ends[-1])
        if held:
            yield batch_of(held, tree.root())

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = staged.select("doc_id", "tie", "n_tokens", "recipe").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    local = ordered.mapInArrow(numbered, f"part int, row long, doc_id long, local long, n_tokens long, recipe {_RECIPE}, leaf binary, root binary")
    local.write.option("compression", "zstd").parquet(f"{base}/local")
    local = spark.read.parquet(f"{base}/local")
    manifest = local.groupBy("part").agg(F.max("root").alias("root"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    manifest.coalesce(1).write.parquet(f"{base}/manifest")
    manifest = spark.read.parquet(f"{base}/manifest")
    recipes = local.join(manifest.select("part", _before().alias("before")), "part")
    recipes.select("part", "row", "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "recipe", "leaf").write.option("compression", "zstd").parquet(f"{base}/recipes")
    for name in ("staged", "local"):
        drop_path(spark, f"{base}/{name}")


def _pieces(spark: SparkSession, base: str) -> DataFrame:
    recipes = spark.read.parquet(f"{base}/recipes")
    return recipes.select("row", "doc_id", "start", "n_tokens", "leaf", F.posexplode_outer("recipe").alias("pos", "c")).select("row", "doc_id", "start", "n_tokens", "leaf", "pos", "c.digest", "c.n")


def verified(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from the files; whatever is missing or doesn't match its digests fails the job."""
    check_manifest(spark, base)

    def checked(batches):
        for batch in batches:
            found, chunks, at = [], batch.column("data").to_pylist(), 0
            wide = memoryview(np.frombuffer(b"".join(chunks), f"<u{WIDTH}").astype("<u4").tobytes())
            for digest, data in zip(batch.column("digest").to_pylist(), chunks):
                if hashlib.blake2b(data, digest_size=16).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} doesn't match its digest")
                end = at + 4 // WIDTH * len(data)
                found.append(zlib.crc32(wide[at:end]))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.int64())], ["digest", "crc"])

    def assembled(batches):
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        row, head, crc, recipe, total = None, None, 0, [], 0

        def done():
            if leaf_of(head[0], head[2], b"".join(recipe)) != head[3] or total != head[2]:
                raise ValueError(f"the recipe of document {head[0]} doesn't match the manifest's leaf")
            return (*head[:3], crc)

        for batch in batches:
            out = []
            for r, doc, start, n, mark, digest, size, part in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "start", "n_tokens", "leaf", "digest", "n", "crc"))):
                if part is None:
                    raise ValueError(f"document {doc} lacks a chunk")
                if r != row:
                    if row is not None:
                        out.append(done())
                    row, head, crc, recipe, total = r, (doc, start, n, mark), 0, [], 0
                crc = combined(crc, part, 4 * size) if recipe else part
                recipe += digest, size.to_bytes(4, "little")
                total += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(done())], names)

    chunks = spark.read.parquet(f"{base}/chunks").select("digest", "data").mapInArrow(checked, "digest binary, crc long")
    joined = _pieces(spark, base).join(chunks, "digest", "left")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return joined.repartition(parts, "row").sortWithinPartitions("row", "pos").mapInArrow(assembled, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned integers of WIDTH bytes) of each document; a missing chunk fails the job."""
    chunks = spark.read.parquet(f"{base}/chunks").select("digest", "data")
    data = F.coalesce("data", F.raise_error(F.concat(F.lit("no chunk "), F.coalesce(F.hex("digest"), F.lit("at all")))).cast("binary"))
    whole = _pieces(spark, base).join(chunks, "digest", "left").groupBy("row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", data.alias("data")))).alias("c"))
    return whole.select("doc_id", "start", F.expr("unhex(array_join(transform(c, x -> hex(x.data)), ''))").alias("ids"))


def check_manifest(spark: SparkSession, base: str) -> None:
    """Fails unless the recipes' leaves, documents and tokens give the manifest's, part by part, and starts follow each other."""

    def rooted(batches):
        names = ["part", "found", "n", "sum", "first", "gapless"]
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        tree, part, n, total, first, gapless = Merkle(), None, 0, 0, 0, True

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, tree.root(), n, total, first, gapless), kinds)], names)

        for batch in batches:
            for p, start, tokens, mark in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n_tokens", "leaf"))):
                if p != part:
                    if part is not None:
                        yield done()
                    tree, part, n, total, first, gapless = Merkle(), p, 0, 0, start, True
                gapless = gapless and start == first + total
                tree.add(mark)
                n, total = n + 1, total + tokens
        if part is not None:
            yield done()

    leaves = spark.read.parquet(f"{base}/recipes").select("part", "row", "start", "n_tokens", "leaf").repartition("part").sortWithinPartitions("part", "row")
    found = leaves.mapInArrow(rooted, "part int, found binary, n long, sum long, first long, gapless boolean")
    manifest = spark.read.parquet(f"{base}/manifest").select("part", "root", "docs", "tokens", _before().alias("before"))
    same = "root <=> found and docs <=> n and tokens <=> sum and before <=> first and gapless"
    bad = manifest.join(found, "part", "full").where(f"not coalesce({same}, false)").select("part").first()
    if bad:
        raise ValueError(f"part {bad.part} of the recipes doesn't match the manifest")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), base)
    return verified(spark, base)
