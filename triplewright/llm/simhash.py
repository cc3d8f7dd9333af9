"""SimHash fingerprints of word shingles, linked within a small Hamming distance by multi-index hashing.

A fingerprint is cut into segments; there is a table of fingerprints by (segment, its value). Of two fingerprints that differ in up to D bits
over m segments, D = r * m + a, at least one of the first a + 1 segments differs in at most r bits or one of the others in at most
r - 1 (else there were more than D differences). So each fingerprint enumerates the Hamming ball of that radius around
its value of a segment, and fetches the table's entries for the ball's members; the complete distance is verified in the join. With more segments
than D the balls have radius 0: the value itself, one look-up a segment, D + 1 of them.

A table entry of more than MOST fingerprints is not joined: the bits in which its fingerprints vary are cut into D + 1 segments, one of which
is equal in two that are within the distance; so they meet under longer keys, until entries are small or vary in few bits. So no
entry makes pairs of a large group, and no pair is lost. Links between texts of equal fingerprints need no pairs: documents
are reduced to distinct fingerprints first. Other columns are ignored, whatever their names; rows repeated as a whole give a row each.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import components, drop_path, shared_dir, stage, table, trimmed

SEED = 42
SHINGLE = 3
BITS = 64
#: Two halves: at a billion fingerprints an entry of 32 bits holds few others, one of 21 bits would hold hundreds.
SEGMENTS = 2
DISTANCE = 2
#: Fingerprints of a table entry that are compared with each other; a larger entry is cut anew.
MOST = 256
_BLOCK = 1 << 15
_ALL = (1 << BITS) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: bit i is set if it is set in over half of the shingles' hashes. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Unsigned: bit i is set if it is set in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        votes += np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint's bits as a signed long. Null texts count as empty."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id, "fp"])

    return df.select(F.col(id).cast("long").alias(id), F.col(text)).mapInArrow(lambda batches: trimmed(run(batches)), f"{id} long, fp long")


def segments_of(free: int, segments: int) -> list[int]:
    """Masks that share out the bits of a mask to so many segments, in order."""
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    cuts = [len(bits) * i // segments for i in range(segments + 1)]
    return [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def radii(segments: int, distance: int) -> list[int]:
    """The radius of the ball in each segment; -1: the segment isn't needed."""
    r, a = divmod(distance, segments)
    return [r if i <= a else r - 1 for i in range(segments)]


def ball(mask: int, radius: int) -> list[int]:
    """What differs between a segment's value and the members of the ball around it."""
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    return [sum(c) for k in range(radius + 1) for c in combinations(bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut_anew(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (fp, mask, value) of large entries under longer keys; parts (mask, value, parts): what each entry is cut into."""
    cut = rows.join(parts, ["mask", "value"]).select("fp", "mask", "value", F.explode("parts").alias("part"))
    return cut.select("fp", F.expr("mask | part").alias("mask"), F.expr("value | (fp & part)").alias("value"))


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = MOST) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (fp) within a distance; a pair may come several times."""
    spark, base = distinct.sparkSession, shared_dir(distinct.sparkSession)
    tables = [(_signed(m), ball(m, r)) for m, r in zip(segments_of(_ALL, segments), radii(segments, distance)) if r >= 0]
    exact = all(len(members) == 1 for _, members in tables)
    entries = ", ".join(f"struct({m}L as mask, fp & {m}L as value)" for m, _ in tables)
    held = distinct.select("fp", F.explode(F.expr(f"array({entries})")).alias("key")).select("fp", "key.*")
    asked = held
    if not exact:
        members = ", ".join(f"transform(array({', '.join(f'{_signed(d)}L' for d in ds)}), d -> struct({m}L as mask, (fp ^ d) & {m}L as value))" for m, ds in tables)
        asked = distinct.select("fp", F.explode(F.expr(f"concat({members})")).alias("key")).select("fp", "key.*")
    few = max(8, distance)  # bits: what varies in so few isn't cut further
    small = f"(n <= {most} or bit_count(vary) <= {few})"
    bits, step = "filter(sequence(0, 63), i -> shiftright(vary, i) & 1 = 1)", f"bit_count(vary) * k div {distance + 1}"
    cut = f"transform(sequence(0, {distance}), k -> aggregate(slice({bits}, int({step}) + 1, int({step.replace('* k', '* (k + 1)')} - {step})), 0L, (a, i) -> a | shiftleft(1L, i)))"
    found: list[DataFrame] = []
    for level in range(BITS):
        # counted before anything is moved; where only a value itself is asked for, entries of one fingerprint are left out
        sizes = held.groupBy("mask", "value").agg(F.count("*").alias("n"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("vary"))
        sizes = stage(sizes.where("n > 1") if exact else sizes, f"{base}/{level}/sizes")
        # exploded rows count as small as what they come from: without a hint millions of look-ups are broadcast
        held = stage(held.hint("merge").join(sizes, ["mask", "value"]), f"{base}/{level}/held")
        asked = held if exact else stage(asked.hint("merge").join(sizes, ["mask", "value"]), f"{base}/{level}/asked")
        a, b = (x.where(small).select(F.col("fp").alias(name), "mask", "value") for x, name in ((asked, "a"), (held, "b")))
        found.append(stage(a.join(b, ["mask", "value"]).where(f"a < b and bit_count(a ^ b) <= {distance}").select("a", "b")))
        large = sizes.where(f"not {small}").select("mask", "value", F.expr(cut).alias("parts"))
        if large.isEmpty():
            break
        held = stage(_cut_anew(held.where(f"not {small}"), large), f"{base}/{level}/cut")
        asked = held if exact else stage(_cut_anew(asked.where(f"not {small}"), large), f"{base}/{level}/asked-cut")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    drop_path(spark, base)
    return out


def group(df: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(id, fingerprint, component_id) for each row of df. Texts without words share fingerprint zero; rows whose id is null take part and never name a group."""
    prints = stage(fingerprints(df, id, text))
    distinct = stage(prints.groupBy("fp").agg(F.min(id).alias("first")))
    joined = components(links(distinct.select("fp"), distance, segments))
    found = distinct.join(joined, distinct.fp == joined.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = found.join(found.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(stage(named), "fp").select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, component_id, lead): groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Fingerprints of those shingles propose first, by the tables above. Alone they don't reach that similarity, at which they differ in about 10 of
    64 bits, too many for tables of segments; so MinHash bands propose what is left, and whole shingle sets decide (see jaccard).
    """
    from triplewright.llm import jaccard

    return jaccard.group(df, id, text)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
