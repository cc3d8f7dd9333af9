"""Texts linked by the Jaccard similarity of their word shingles: SimHash fingerprints propose first, MinHash bands what those can't reach; whole
shingle sets decide.

Equal sets are reduced first; rows and sets are told apart by hashes of 128 bits. Each set has a SimHash fingerprint of its shingles; the fingerprints within
DISTANCE bits are found by multi-index hashing (see simhash), and of each the nearest one is compared first. The other
pairs of fingerprints are compared later, if their sets lie in two components still; so dense groups cost few comparisons.

At similarity LEAST fingerprints differ in about 10 bits, so bands have to propose too. Each set has a key per band; sets of similarity LEAST meet under none of them with a chance of
(1 - LEAST ** ROWS) ** BANDS, about 3e-6. Members of a key are compared in chains, in two rounds, so that dense groups
become one component at few comparisons; a key of many members is shared out to chains of about CHAIN by the members' hashes, which differ
from round to round. After that every pair of a key that still lies in two components is compared. So
groups are those of all pairs that meet, though no pairs are made within a group that is known already. Sets are fetched only
for pairs that pass two necessary conditions: sizes, and parities. The parities of a set's counts in PARITIES classes of hashes differ
between two sets in no more places than the sets differ in members, so that no pair is lost by them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplewright.llm import simhash
from triplewright.llm.common import components, stage, trimmed

SEED = 42
SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
#: Bits in which fingerprints that propose may differ, and the segments of their tables: balls of radius 1, 66 look-ups a fingerprint.
DISTANCE, SEGMENTS = 5, 3
#: Bands of the first chain.
FIRST = 8
#: Members of a key that one chain takes, about.
CHAIN = 256
#: A power of two and a multiple of 64.
PARITIES = 1024
_BLOCK = 1 << 12
_RANDOM = np.random.default_rng(SEED)
_TIMES, _PLUS, _MIX, _BAND = (_RANDOM.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, ROWS, BANDS))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of so many words, in order; of all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def keys(grams: np.ndarray) -> np.ndarray:
    """One key a band; none of an empty set."""
    if not len(grams):
        return grams
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), _BLOCK):
        np.minimum(least, (grams[i : i + _BLOCK] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND


def parities(grams: np.ndarray) -> np.ndarray:
    """Whether each class, by the hashes' high bits, has an odd number of members: bits in longs."""
    return np.packbits(np.bincount(grams >> np.uint64(65 - PARITIES.bit_length()), minlength=PARITIES) & 1).view(np.int64)


def row_hash(df: DataFrame):
    """A hash of all columns in 16 bytes: rows repeated as a whole share it. Nulls are marked, as hash functions pass over them."""
    marked = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *marked)), 16, "0") for seed in (0, 1))))


def rows(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, text), row being row_hash."""
    return df.select(row_hash(df).alias("row"), F.col(id).cast("long").alias(id), F.col(text).alias("text"))


def _arrow(df: DataFrame, schema: str, columns) -> DataFrame:
    """df with text, its last column, replaced by columns(shingle sets): numpy arrays, lists of them, or lists of bytes."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = columns([shingles(t.as_py()) for t in part.column(part.num_columns - 1)])
                made = [pa.array(c) if isinstance(c, np.ndarray) else pa.array(c, pa.binary()) if isinstance(c[0], bytes) else pa.array([x.view(np.int64) for x in c], pa.list_(pa.int64())) for c in made]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)

    return df.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def print_of(grams: np.ndarray) -> bytes:
    """A hash of a set in 16 bytes; zeros for the empty one."""
    return xxhash.xxh3_128_digest(grams.tobytes(), SEED) if len(grams) else bytes(16)


def sketches(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, fp, n, keys, odd, bits): the row's hash, one of its shingle set (zeros: empty), the set's size, keys, parities and fingerprint."""

    def columns(sets):
        bits = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
        return [print_of(s) for s in sets], np.array([len(s) for s in sets], np.int64), [keys(s) for s in sets], [parities(s) for s in sets], bits

    return _arrow(rows(df, id, text), f"row binary, {id} long, fp binary, n long, keys array<long>, odd array<long>, bits long", columns)


def close(a: str, b: str) -> str:
    """Whether sizes and parities allow LEAST: sets of that similarity differ in (1 - LEAST) / (1 + LEAST) of both sizes at most."""
    differ = " + ".join(f"bit_count({a}odd[{i}] ^ {b}odd[{i}])" for i in range(PARITIES // 64))
    return f"{LEAST[1]} * least({a}n, {b}n) >= {LEAST[0]} * greatest({a}n, {b}n) and {LEAST[0] + LEAST[1]} * ({differ}) <= {LEAST[1] - LEAST[0]} * ({a}n + {b}n)"


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("fp").alias(prefix), *(F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "fp"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets (fp, grams) have a similarity of LEAST or more."""
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    joined = pairs.join(_named(sets, "a"), "a").join(_named(sets, "b"), "b")
    return joined.where(LEAST[1] * both >= LEAST[0] * (F.size("a_grams") + F.size("b_grams") - both)).select("a", "b")


def near_prints(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(a, b, apart): sets of distinct (fp, bits) whose fingerprints differ in so many bits.

    Sets that share a fingerprint are paired with the least of them, and this one stands for them.
    """
    prints = distinct.select("fp", "bits")
    firsts = stage(prints.groupBy("bits").agg(F.min("fp").alias("first"), F.count("*").alias("held")))
    equal = prints.join(firsts.where("held > 1"), "bits").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"), F.lit(0).alias("apart"))
    met = simhash.links(firsts.select(F.col("bits").alias("fp")), distance, segments).select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    for name, of in (("x", "a"), ("y", "b")):
        met = met.join(firsts.select(F.col("bits").alias(name), F.col("first").alias(of)), name)
    return equal.unionByName(met.select("a", "b", F.expr("bit_count(x ^ y)").alias("apart")))


def links(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets of distinct (fp, row, n, keys, odd, bits) whose similarity is LEAST or more and that share a key or are near by fingerprint.

    texts: (row, text) of those rows at least.
    """
    near = stage(near_prints(distinct))
    members = distinct.select("fp", F.posexplode("keys").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    members = stage(members.join(shared, "key"))
    met = members.select("fp").unionByName(near.select(F.col("a").alias("fp"))).unionByName(near.select(F.col("b").alias("fp"))).distinct()
    facts = stage(distinct.drop("bits").join(met, "fp"))
    fetched = texts.join(facts.select("row", "fp").hint("merge"), "row").select("fp", "text")
    sets = stage(_arrow(fetched, "fp binary, grams array<long>", lambda sets: [sets]).dropDuplicates(["fp"]))
    facts_of = facts.select("fp", "n", "odd")
    found: list[DataFrame] = []

    def joined() -> DataFrame:
        return stage(components(reduce(DataFrame.unionByName, found)))

    def placed(of: DataFrame) -> DataFrame:
        return stage(members.join(of.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))

    def chain(placed: DataFrame, seed: int) -> None:
        share = F.pmod(F.xxhash64("fp", F.lit(-seed - 1)), F.ceil(F.col("held") / CHAIN))
        order = W.partitionBy("key", "share").orderBy(F.xxhash64("fp", F.lit(seed)), "fp")
        before = placed.withColumn("share", share).select("fp", "component", *(F.lag(c).over(order).alias(f"other_{c}") for c in ("fp", "component")))
        propose(before.where("component <> other_component").select(F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b")).distinct())

    def propose(pairs: DataFrame) -> None:
        found.append(stage(verified(stage(passing(pairs)), sets)))

    def passing(pairs: DataFrame) -> DataFrame:
        return pairs.join(_named(facts_of, "a"), "a").join(_named(facts_of, "b"), "b").where(close("a_", "b_")).select("a", "b")

    propose(near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("of")).select("of.a", "b"))
    chain(members.where(F.col("band") < FIRST).withColumn("component", F.col("fp")), 0)
    chain(placed(joined()), 1)
    of = joined()
    for name in "ab":
        near = near.join(of.select(F.col("id").alias(name), F.col("component").alias(f"in_{name}")), name, "left")
    near = passing(near.where("coalesce(in_a, a) <> coalesce(in_b, b)").select("a", "b"))
    left = placed(of)
    mixed = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = stage(left.join(mixed, "key").join(facts.select("fp", "n", "odd", "keys"), "fp"))
    a, b = (_named(left.select("fp", "component", "n", "odd", "keys", "key"), x) for x in "ab")
    # a pair counts under the first key that it shares
    met = a.join(b, F.expr(f"a_key = b_key and a_component < b_component and {close('a_', 'b_')} and array_intersect(a_keys, b_keys)[0] = a_key"))
    found.append(stage(verified(stage(met.select("a", "b").unionByName(near)), sets)))
    return reduce(DataFrame.unionByName, found)


def group(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, component_id, lead) for each row of df: its hash, the smallest id of its group, the hash of the row that has it (the least of several).

    Texts without words are one group; rows whose id is null take part and never name a group.
    """
    prints = stage(sketches(df, id, text))
    named = F.when(F.col(id).isNotNull(), F.struct(F.col(id).alias("component_id"), F.col("row").alias("lead")))
    firsts = stage(prints.groupBy("fp").agg(F.min(named).alias("first"), F.min("row").alias("row")))
    distinct = stage(prints.select("row", "fp", "n", "keys", "odd", "bits").join(firsts.select("row"), "row").dropDuplicates(["fp"]))
    joined = components(links(distinct, rows(df, id, text).select("row", "text")))
    found = firsts.join(joined, firsts.fp == joined.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    groups = found.join(found.groupBy("root").agg(F.min("first").alias("of")), "root").select("fp", "of.component_id", "of.lead")
    return prints.select("row", id, "fp").join(stage(groups), "fp").select("row", id, "component_id", "lead")
