"""Token counts that follow edits: a tree of pre-tokens per document, re-encoded only where an edit reaches.

A document's pre-tokens with their token counts are the leaves of a tree; a node holds the sums of the leaves below it. A node is
split only when an edit comes by, so that a document costs time in proportion to its length, and an edit to what it touches: no edit copies the text,
which is the leaves' texts one after the other.
Splitting into pre-tokens reads from left to right and looks no more than LOOKAHEAD characters past a pre-token's
end, or as many as the longest special token has; so an edit can change only pre-tokens that end within that distance before it or touch it, and
after it the split is the old one again as soon as a boundary falls on an old boundary. Those pre-tokens are split and counted
anew, special tokens among them; the sums of the nodes above them are updated; everything else stays.

Edits are (start, end, replacement) over the text as it was, not overlapping, ascending; they are applied from the last to the
first so that positions hold. Null texts count as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm import pii
from triplewright.llm.common import table
from triplewright.llm.tokens import ByteEncoder, byte_encoder, slices, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: Characters past a pre-token's end on which its extent can depend: a contraction's letters, or the character after white space.
LOOKAHEAD = 3
#: Pre-tokens of a leaf block.
BLOCK = 32


class Node:
    """A node of the tree: its sums, and its children or, as long as it is not split, its pre-tokens and their counts."""

    __slots__ = ("chars", "n", "tokens", "left", "right", "pieces", "counts")

    def __init__(self, pieces: list[str], counts: list[int]):
        self.set(pieces, counts)

    def set(self, pieces: list[str], counts: list[int]) -> None:
        self.left = self.right = None
        self.pieces, self.counts = pieces, counts
        self.chars, self.n, self.tokens = sum(map(len, pieces)), len(pieces), sum(counts)

    def split(self) -> bool:
        """Whether the node has children, which it gets if it holds more than a block."""
        if self.left is None and self.n > BLOCK:
            half = self.n // 2
            self.left, self.right = Node(self.pieces[:half], self.counts[:half]), Node(self.pieces[half:], self.counts[half:])
            self.pieces = self.counts = None
        return self.left is not None

    def piece_at(self, char: int) -> tuple[int, int]:
        """(index, start) of the pre-token that holds a character; past the end: (number of pre-tokens, chars)."""
        if char >= self.chars:
            return self.n, self.chars
        node, index, start = self, 0, 0
        while node.split():
            if char - start < node.left.chars:
                node = node.left
            else:
                index, start, node = index + node.left.n, start + node.left.chars, node.right
        for piece in node.pieces:
            if char < start + len(piece):
                break
            index, start = index + 1, start + len(piece)
        return index, start

    def text(self, start: int, end: int) -> str:
        """The text between two characters, the first of which begins a pre-token or ends the text."""
        out, wanted, at, waiting = [], end - start, 0, [self]
        while waiting and wanted > 0:
            node = waiting.pop()
            if at + node.chars <= start:
                at += node.chars
            elif node.split():
                waiting += (node.right, node.left)
            else:
                for piece in node.pieces:
                    if at >= start and wanted > 0:
                        out.append(piece)
                        wanted -= len(piece)
                    at += len(piece)
        joined = "".join(out)
        return joined[: end - start]

    def replace(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        """Puts new pre-tokens in place of first..last-1."""
        if not self.split():
            self.set(self.pieces[:first] + pieces + self.pieces[last:], self.counts[:first] + counts + self.counts[last:])
            return
        middle = self.left.n
        if last <= middle:
            self.left.replace(first, last, pieces, counts)
        elif first >= middle:
            self.right.replace(first - middle, last - middle, pieces, counts)
        else:
            self.left.replace(first, middle, pieces, counts)
            self.right.replace(0, last - middle, [], [])
        self.chars, self.n, self.tokens = self.left.chars + self.right.chars, self.left.n + self.right.n, self.left.tokens + self.right.tokens

    def leaves(self) -> list[str]:
        """All pre-tokens in order."""
        out, waiting = [], [self]
        while waiting:
            node = waiting.pop()
            if node.left is None:
                out += node.pieces
            else:
                waiting += (node.right, node.left)
        return out


class Counted:
    """A text as a tree of pre-tokens; edits keep the counts in step."""

    def __init__(self, text: str, encoder: ByteEncoder, pieces: list | None = None, counts: list[int] | None = None):
        self.encoder, self.recounted = encoder, 0
        self.reach = max([LOOKAHEAD, *map(len, encoder.added)])
        if pieces is None:
            pieces = encoder.pieces(text)
            counts = encoder.counts([pieces])[0]
        self.tree = Node(self._texts(pieces), counts)

    def _texts(self, pieces: list) -> list[str]:
        """pieces with special tokens as they are written; they stay pre-tokens of their own."""
        return [self.encoder.raw[p].decode() if p.__class__ is int else p for p in pieces] if int in set(map(type, pieces)) else pieces

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    @property
    def text(self) -> str:
        return "".join(self.tree.leaves())

    def edit(self, start: int, end: int, replacement: str) -> None:
        tree, changed = self.tree, start + len(replacement)
        first, at = tree.piece_at(max(0, start - self.reach))
        head = tree.text(at, start)
        shift = len(replacement) - (end - start)
        length = tree.chars + shift
        # the split after the edit is the old one from the first old boundary that it meets
        ahead, fresh = max(64, 2 * len(replacement)), None
        while fresh is None:
            stop = min(length, changed + ahead)
            _, follows = tree.piece_at(end)
            window = head + replacement + tree.text(follows, stop - shift)[end - follows :]
            pieces, boundary, n = self.encoder.pieces(window), at, 0
            texts = self._texts(pieces)
            for piece in texts:
                old = boundary - shift
                if boundary >= changed and tree.piece_at(old)[1] == old:
                    fresh = old
                    break
                if boundary + len(piece) + self.reach > stop < length:
                    break
                n, boundary = n + 1, boundary + len(piece)
            if fresh is None and n == len(texts) and stop == length:
                fresh = tree.chars
            ahead *= 4
        counts = self.encoder.counts([pieces[:n]])[0]
        tree.replace(first, tree.piece_at(fresh)[0], texts[:n], counts)
        self.recounted += n


def edits_of(text: str, source: str | None) -> list[tuple[int, int, str]]:
    """The edits of the query: each personal-data span becomes its kind in brackets, and a source line is put at the end."""
    out, at = [], 0
    for kind, a, b, _ in pii.all_spans(text):
        if a >= at:
            out.append((a, b, f"[{kind.upper()}]"))
            at = b
        elif b > at:
            out[-1] = (out[-1][0], b, out[-1][2])
            at = b
    return [*out, (len(text), len(text), f"\nSource: {source or 'unknown'}")]


def count_edited(df: DataFrame, edits=edits_of, path: str | None = None) -> DataFrame:
    """Counts of each row of df (doc_id, text, source) before and after its edits."""
    path = path or tokenizer_path(VOCABULARY)
    schema = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_tokens_after long, n_recounted long, text_after_sha256 string"

    def run(batches):
        encoder = byte_encoder(path)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                texts = [t or "" for t in part.to_pylist()]
                sources = batch.column("source").slice(at, len(part)).to_pylist()
                docs = batch.column("doc_id").slice(at, len(part))
                at += len(part)
                lists = [encoder.pieces(t) for t in texts]
                rows = []
                for text, source, pieces, counts in zip(texts, sources, lists, encoder.counts(lists)):
                    counted = Counted(text, encoder, pieces, counts)
                    before, changes = counted.tokens, edits(text, source)
                    for a, b, new in reversed(changes):
                        counted.edit(a, b, new)
                    rows.append((len(pieces), before, len(changes), counted.tokens, counted.recounted, hashlib.sha256(counted.text.encode()).hexdigest()))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([docs, *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], [c.split()[0] for c in schema.split(", ")])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(table(spark, sf_dir, "documents"))
