"""Two tokenizers aligned: groups between common byte offsets, links between overlapping tokens, and how often each id pair is linked.

A encodes a blank and the text by the byte-level vocabulary, B the text by the piece model, which adds the blank; both cover the same bytes. Where
tokens of both end, a group ends. Between any two neighbouring ends of either lies exactly one A and one B token: a link.

Counting. A pair is one long, B's id above A's. Each task sums the pairs of what it reads (np.unique, several times if they are many), Spark
sorts the partial counts by ranges of the key, and each range adds up its runs into a shard: two files of sorted keys and their counts. A table written
by Spark names the shards, their bounds and each B id's highest count. Looking up maps the shards into memory and searches them; only pages that
are asked for are read, and workers of a machine share them. In a folder that isn't mounted, a shard is read whole, one at a time. The highest
counts per B id are collected: at most as many as B has ids.

Encoding. A text is cut at blanks that follow a character other than white space. No token of either vocabulary has such a place within it, so that each
distinct part of a slice is encoded once. The ids are written as a table of a few bytes a token, from which pairs are counted and groups are told.

Null and empty texts and those whose bytes differ (U+2581 in the text) have no tokens: zeros and ''. Repeated rows are counted as often as they come;
ids are passed on, null or not. Other columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import shared_dir, stage, table, trimmed
from triplewright.llm.files import create, local_path, read_stream
from triplewright.llm.tokens import Memory, byte_encoder, ranges, slices, tokenizer_path

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Longest part that a worker remembers, in characters.
REMEMBERED = 64
#: Partial counts that a task holds before it sends them on.
HELD = 2_000_000
#: Bytes of text encoded at once, and of A's ids aligned at once.
TEXT_SLICE, ID_SLICE = 4 << 20, 1 << 20
_CUT = re.compile(r"(?<=\S) ")
#: A blank at the start or after white space (as Python's \s has it): such a text can't be cut at every blank.
_LOOSE = r"^ |[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
_BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>")


def starts(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each value has."""
    return np.frombuffer(b"".join(values), "<u4").astype(np.int64), np.fromiter(map(len, values), np.int64, len(values)) // 4


def packed(ids: np.ndarray, lengths: np.ndarray, width: str) -> pa.LargeBinaryArray:
    """Runs of ids as binary values."""
    data = ids.astype(width)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(starts(lengths) * data.itemsize), pa.py_buffer(data)])


class Aligner:
    """Both vocabularies, with a bounded memory of the parts already seen."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder, self.library = byte_encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        raw_a = self.encoder.raw
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        raw_b = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) and _BYTE_PIECE.fullmatch(p) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = len(raw_a), len(raw_b)
        self.raw_a, self.raw_b = pa.array(raw_a, pa.large_binary()), pa.array(raw_b, pa.large_binary())
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (raw_a, raw_b))
        texts = [f"{i}{end}" for ends, n in ((",|", self.size_a), (",;", self.size_b)) for end in ends for i in range(n)]
        self.decimals = pa.array([t.encode() for t in texts], pa.large_binary())
        self.width = "<u2" if max(self.size_a, self.size_b) <= 1 << 16 else "<u4"
        self.memory = Memory()

    def ids(self, distinct: list[str]) -> list[tuple[bytes, bytes]]:
        """A's and B's ids of each part, as little-endian unsigned 32-bit integers."""
        known, fresh = self.memory.split(distinct)
        if fresh:
            lists = [self.encoder.pieces_plain(" " + p) for p in fresh]
            of = self.encoder._all(lists).__getitem__
            made = {p: (b"".join(map(of, x)), array("I", y).tobytes()) for p, x, y in zip(fresh, lists, self.library.encode(fresh, num_threads=1))}
            if "" in made:  # the blank at a text's end; alone, the library adds none
                made[""] = made[""][0], array("I", [self.library.piece_to_id("▁")]).tobytes()
            self.memory.add({p: v for p, v in made.items() if len(p) <= REMEMBERED})
            known |= made
        return [known[p] for p in distinct]

    def encode(self, texts: pa.Array) -> tuple[pa.LargeBinaryArray, pa.LargeBinaryArray]:
        """A's and B's ids of non-empty texts, none where the bytes differ."""
        loose = pc.any(pc.match_substring_regex(texts, _LOOSE)).as_py()
        lists = pa.array([_CUT.split(t) for t in texts.to_pylist()], pa.list_(pa.string())) if loose else pc.split_pattern(texts, " ")
        flat, cuts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        codes, distinct, cuts = flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist(), cuts - cuts[0]
        found = self.ids(distinct)
        (a, n_a), (b, n_b) = joined([x for x, _ in found]), joined([x for _, x in found])
        raw = [b" " + p.encode() for p in distinct]
        whole, bad = b"".join(raw), np.zeros(len(distinct), bool)
        if _bytes(self.raw_a, a) != whole or _bytes(self.raw_b, b) != whole:
            # a text that holds a part whose bytes differ has no tokens
            bad[:] = [_bytes(self.raw_a, joined([x])[0]) != r or _bytes(self.raw_b, joined([y])[0]) != r for (x, y), r in zip(found, raw)]
        ends = starts(bad[codes])[cuts]
        good = np.repeat(ends[1:] == ends[:-1], np.diff(cuts))
        out = []
        for ids, n in ((a, n_a), (b, n_b)):
            taken = np.where(good, n[codes], 0)
            at = starts(taken)[cuts]
            out.append(packed(ids[ranges((starts(n)[:-1])[codes], taken)], np.diff(at), self.width))
        return out[0], out[1]


def _bytes(raw: pa.LargeBinaryArray, ids: np.ndarray) -> bytes:
    """The ids' bytes one after the other."""
    data = raw.take(pa.array(ids)).buffers()[2]
    return data.to_pybytes() if data else b""


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def encoded(df: DataFrame, id: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, a, b) of each row: A's and B's ids as little-endian integers of two bytes (four for larger vocabularies)."""
    paths = paths or default_paths()

    def run(batches):
        tool = aligner(*paths)
        for batch in batches:
            given = pc.fill_null(batch.column(1), "")
            full = pc.greater(pc.binary_length(given), 0)
            loose = pc.and_(full, pc.match_substring_regex(given, _LOOSE))
            for kind in (pc.and_(full, pc.invert(loose)), loose):  # apart, as few texts are loose
                rows = batch.filter(kind)
                at = 0
                for part in slices(rows.column(1), TEXT_SLICE):
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(at, len(part)), *(x.cast(pa.binary()) for x in tool.encode(part))], [id, "a", "b"])
                    at += len(part)
            rest = batch.filter(pc.invert(full))
            yield pa.RecordBatch.from_arrays([rest.column(0), *[pa.array([b""] * rest.num_rows, pa.binary())] * 2], [id, "a", "b"])

    return df.select(id, text).mapInArrow(lambda batches: trimmed(run(batches)), f"{id} {df.schema[id].dataType.simpleString()}, a binary, b binary")


class Aligned:
    """Texts' tokens side by side, all in one row of bytes."""

    def __init__(self, tool: Aligner, a: pa.Array, b: pa.Array):
        (self.a, self.n_a), (self.b, self.n_b) = ((np.frombuffer(b"".join(x.to_pylist()), tool.width).astype(np.int64), pc.binary_length(x).to_numpy().astype(np.int64) // int(tool.width[-1])) for x in (a, b))
        a_end, b_end = np.cumsum(tool.length_a[self.a]), np.cumsum(tool.length_b[self.b])
        total = int(a_end[-1]) if len(a_end) else 0
        in_a, in_b = np.zeros(total, bool), np.zeros(total, bool)
        in_a[a_end - 1], in_b[b_end - 1] = True, True
        # how many tokens of either, links and groups have ended before each byte
        links, self.group_end = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b) + 1
        self.keys = self.b[np.searchsorted(b_end, links, side="right")] << 32 | self.a[np.searchsorted(a_end, links, side="right")]
        text_end = np.concatenate([np.zeros(1, np.int64), a_end])[starts(self.n_a)]
        self.links_at, self.groups_at = np.searchsorted(links + 1, text_end, side="right"), np.searchsorted(self.group_end, text_end, side="right")
        self.group_a, self.group_b = np.searchsorted(self.group_end, a_end), np.searchsorted(self.group_end, b_end)
        self.last_a, self.last_b = in_a[a_end - 1] & in_b[a_end - 1], in_a[b_end - 1] & in_b[b_end - 1]

    def written(self, tool: Aligner) -> pa.LargeBinaryArray:
        """Each text's groups, every group ending in a semicolon."""
        which = np.empty(len(self.a) + len(self.b), np.int64)
        which[np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, side="left")] = self.a + self.last_a * tool.size_a
        which[np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, side="right")] = 2 * tool.size_a + self.b + self.last_b * tool.size_b
        text = tool.decimals.take(pa.array(which))
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[starts(self.n_a + self.n_b)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.n_a), [None, pa.py_buffer(offsets), text.buffers()[2]])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _parts(batches):
    """Slices of batches (..., a, b): the rows' other columns, a and b."""
    for batch in batches:
        at = 0
        for a in slices(batch.column("a"), ID_SLICE):
            yield batch.slice(at, len(a)), a, batch.column("b").slice(at, len(a))
            at += len(a)


def partial_counts(tokens: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(key, n): pairs with the links that hold them, summed within each task; tokens as encoded gives them."""

    def run(batches):
        tool, keys, counts, held = aligner(*paths), [], [], 0
        for _, a, b in _parts(batches):
            k, n = np.unique(Aligned(tool, a, b).keys, return_counts=True)
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > HELD:
                k, n = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [k], [n], len(k)
                if held > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
                    keys, counts, held = [], [], 0
        if keys:
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])

    return tokens.select("a", "b").mapInArrow(lambda batches: trimmed(run(batches)), "key long, n long")


_SHARDS = "keys string, counts string, first long, last long, pairs long, best array<struct<b: int, n: long>>"


def shards(partial: DataFrame, folder: str) -> DataFrame:
    """Writes partial counts (key, n) as sorted shards; a row per shard that holds any: its files, bounds, and B ids' highest counts there."""

    def runs(batches):
        """Sorted arrays of whole runs, added up."""
        last: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            k, n = summed(*(np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(last)))
            yield k[:-1], n[:-1]
            last = k[-1:], n[-1:]
        yield last

    def run(batches):
        files, first, last, pairs, best = None, 0, 0, 0, {}
        for k, n in runs(batches):
            if not len(k):
                continue
            if files is None:
                files, first = [create(folder, ".keys"), create(folder, ".counts")], int(k[0])
            for (_, stream), x in zip(files, (k, n)):
                stream.write(x.astype("<i8").tobytes())
            last, pairs = int(k[-1]), pairs + len(k)
            cut = np.flatnonzero(np.diff(k >> 32, prepend=-1))
            for b, most in zip((k[cut] >> 32).tolist(), np.maximum.reduceat(n, cut).tolist()):
                best[b] = max(best.get(b, 0), most)
        if files:
            for _, stream in files:
                stream.close()
            row = {"keys": files[0][0], "counts": files[1][0], "first": first, "last": last, "pairs": pairs, "best": [{"b": b, "n": n} for b, n in best.items()]}
            schema = pa.schema([("keys", pa.string()), ("counts", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("pairs", pa.int64()), ("best", pa.list_(pa.struct([("b", pa.int32()), ("n", pa.int64())])))])
            yield pa.RecordBatch.from_pylist([row], schema)

    return stage(partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, _SHARDS))


class Counts:
    """Corpus-wide counts: the shards' files and bounds, and the highest count of each B id. Small, sent to tasks; files are opened where asked for."""

    def __init__(self, manifest: DataFrame):
        rows = manifest.select("keys", "counts", "first", "pairs").orderBy("first").collect()  # one per range of the sort
        self.files, self.first = [(r.keys, r.counts, r.pairs) for r in rows], np.array([r["first"] for r in rows], np.int64)
        best = manifest.select(F.explode("best").alias("e")).groupBy("e.b").agg(F.max("e.n").alias("n")).collect()  # at most one per id of B
        self.best = np.zeros(max([r.b for r in best], default=0) + 1, np.int64)
        self.best[[r.b for r in best]] = [r.n for r in best]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_mapped"}

    def _shard(self, i: int) -> list[np.ndarray]:
        keys, counts, n = self.files[i]
        if local_path(keys) is None:
            return [np.frombuffer(read_stream(uri).read(), "<i8") for uri in (keys, counts)]
        mapped = self.__dict__.setdefault("_mapped", {})
        if i not in mapped:
            mapped[i] = [np.memmap(local_path(uri), "<i8", "r", shape=(n,)) for uri in (keys, counts)]
        return mapped[i]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; a key that no shard has is an error."""
        distinct, back = np.unique(keys, return_inverse=True)
        out, shard = np.zeros(len(distinct), np.int64), np.searchsorted(self.first, distinct, side="right") - 1
        cuts = np.flatnonzero(np.diff(shard, prepend=-2))
        for lo, hi in zip(cuts, [*cuts[1:], len(distinct)]):
            held, counts = self._shard(int(shard[lo])) if shard[lo] >= 0 else (np.zeros(0), np.zeros(0))
            at = np.searchsorted(held, distinct[lo:hi])
            if (at >= len(held)).any() or (held[at] != distinct[lo:hi]).any():
                raise ValueError("a linked pair has no count: the shards are of other texts")
            out[lo:hi] = counts[at]
        return out[back]


def pair_counts(tokens: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The manifest of shards that hold each pair's count over all of tokens (a, b)."""
    return shards(stage(partial_counts(tokens, paths or default_paths())), shared_dir(tokens.sparkSession))


def read_counts(manifest: DataFrame) -> DataFrame:
    """(a_id, b_id, n): the shards' pairs as a table."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with read_stream(keys) as x, read_stream(counts) as y:
                    while raw := x.read(8 << 20):
                        k, n = np.frombuffer(raw, "<i8"), np.frombuffer(y.read(len(raw)), "<i8")
                        yield pa.RecordBatch.from_arrays([pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array((k >> 32).astype(np.int32)), pa.array(n)], ["a_id", "b_id", "n"])

    return manifest.select("keys", "counts").mapInArrow(run, "a_id int, b_id int, n long")


def default_paths() -> tuple[str, str]:
    return tokenizer_path(VOCABULARIES[0]), tokenizer_path(VOCABULARIES[1])


def align(tokens: DataFrame, id: str = "doc_id", paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, groups) of each row of tokens (id, a, b): the groups in order, each with its A and its B ids."""
    paths = paths or default_paths()

    def run(batches):
        tool = aligner(*paths)
        for rows, a, b in _parts(batches):
            one = Aligned(tool, a, b)
            n = len(one.group_end)
            lists = [pa.ListArray.from_arrays(pa.array(starts(np.bincount(of, minlength=n)).astype(np.int32)), pa.array(ids.astype(np.int32))) for of, ids in ((one.group_a, one.a), (one.group_b, one.b))]
            groups = pa.ListArray.from_arrays(pa.array(one.groups_at.astype(np.int32)), pa.StructArray.from_arrays(lists, ["a", "b"]))
            yield pa.RecordBatch.from_arrays([rows.column(0), groups], [id, "groups"])

    return tokens.select(id, "a", "b").mapInArrow(lambda batches: trimmed(run(batches)), f"{id} {tokens.schema[id].dataType.simpleString()}, groups array<struct<a: array<int>, b: array<int>>>")


def digests(tokens: DataFrame, counts: Counts, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of tokens (doc_id, a, b)."""
    paths = paths or default_paths()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches):
        tool = aligner(*paths)
        for rows, a, b in _parts(batches):
            one = Aligned(tool, a, b)
            n = counts.of(one.keys)
            best, total = (np.diff(starts(x)[one.links_at]) for x in (n == counts.best[one.keys >> 32], n))
            sums = [one.n_a, one.n_b, np.diff(one.groups_at), np.diff(one.links_at), best, total]
            text = one.written(tool)
            data, ends = memoryview(text.buffers()[2] or b""), np.frombuffer(text.buffers()[1], np.int64, len(text) + 1).tolist()
            hashes = [hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x.astype(np.int64)) for x in sums), pa.array(hashes, pa.string())], ["doc_id", *names, "groups_sha256"])

    schema = f"doc_id long, {', '.join(f'{n} long' for n in names)}, groups_sha256 string"
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "a", "b").mapInArrow(lambda batches: trimmed(run(batches)), schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = stage(encoded(table(spark, sf_dir, "documents")))
    return digests(tokens, Counts(pair_counts(tokens)))
