"""Harmonic packing of token documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes. A document is first cut into pieces of the exact sizes C, C/2, C/4,
... down to C/2^CUTS, whose bins hold 1, 2, 4, ... pieces without a gap; the rest, shorter than the smallest of
these, goes to the class k with C/(k+1) < length <= C/k, whose bins take k pieces each. Every worker fills the bins
of every class on its own, so there is no shuffle and no shared counter. What a worker has left over at its end is
laid end to end and cut at powers of two (such sequences need no padding). Sequence ids are the partition's
number in the high bits and a counter in the low ones, so a task that is run again gives the same rows.
Null texts count as empty (one end id). Extra columns are not carried: results are per piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import table, text_column, trimmed
from triplewright.llm.tokens import slices, tokenizer_path, word_encoder

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 1
#: Halvings of the capacity down to which documents are cut.
CUTS = 5
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def cuts(n: int, capacity: int = CAPACITY, halvings: int = CUTS) -> list[int]:
    """Piece lengths of a document of n tokens: whole sequences, then halves, quarters and so on, then the rest."""
    out = [capacity] * (n // capacity)
    n %= capacity
    for j in range(1, halvings + 1):
        if n >= capacity >> j:
            out.append(capacity >> j)
            n -= capacity >> j
    return out + [n] * (n > 0)


class Bins:
    """One worker's open bins: class -> pieces waiting, k of them making a full bin."""

    def __init__(self, partition: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.open = capacity, partition << 32, {}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for p in pieces:
            out.append((*p[:5], self.next, offset))
            offset += p[2]
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """piece: doc_id, start, length, crc, doc_tokens, ids. The rows of a bin that this fills, or none."""
        k = self.capacity // piece[2]
        waiting = self.open.setdefault(k, [])
        waiting.append(piece if k > 1 else piece[:5])
        if len(waiting) < k:
            return []
        del self.open[k]
        return self._close(waiting)

    def rest(self) -> list[tuple]:
        """Rows of all that waits: end to end, in whole sequences as long as they last, then cut at powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        total, out, now = sum(p[2] for p in pieces), [], []
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> b & 1]
        sizes.reverse()
        room = sizes.pop() if sizes else 0
        for doc, start, length, _, tokens, ids in pieces:
            while length:
                take = min(room, length)
                now.append((doc, start, take, zlib.crc32(ids[: 4 * take]), tokens))
                ids, start, length, room = ids[4 * take :], start + take, length - take, room - take
                if not room:
                    out += self._close(now)
                    now, room = [], sizes.pop() if sizes else 0
        self.open = {}
        return out


def pack(df: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece of the documents df (doc_id, text): where it starts, how long it is, its sequence and offset there."""
    path = path or tokenizer_path(VOCABULARY)
    last = np.array([end], "<u4").tobytes()

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], NAMES)

    def run(batches):
        encoder, bins, rows = word_encoder(path), Bins(TaskContext.get().partitionId(), capacity), []
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                ids, offsets = encoder.encode(part)
                raw, bounds = memoryview(ids.astype("<u4").tobytes()), (4 * offsets).tolist()
                docs = batch.column("doc_id").slice(at, len(part)).to_pylist()
                at += len(part)
                for doc, a, b in zip(docs, bounds, bounds[1:]):
                    whole, start = bytes(raw[a:b]) + last, 0
                    n = len(whole) // 4
                    for length in cuts(n, capacity):
                        piece = whole[4 * start : 4 * (start + length)]
                        rows += bins.add((doc, start, length, zlib.crc32(piece), n, piece))
                        start += length
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
        if rows := rows + bins.rest():
            yield batch_of(rows)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).mapInArrow(lambda batches: trimmed(run(batches)), SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
