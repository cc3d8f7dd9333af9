"""Embedding near-duplicates: int8 tile products with error bounds, doubles for what could pass.

Equal vectors of a label are first reduced to one. Each label's distinct vectors are dealt to tiles of a fixed
size; every pair of tiles of a label is one group of the shuffle, so a task holds two tiles whatever the label's size. What is sent to the
groups are int8 codes (a byte a component), a scale and two norms. A unit vector is s * q + e with int8 q; |e| is computed in doubles, so the
cosine of two vectors differs from the int8 product by at most |sq||e'| + |e||s'q'| + |e||e'|. Pairs whose lower bound reaches the threshold are
links, those whose upper bound doesn't are none; vectors with pairs in between are fetched, for that pair of tiles alone, and those
pairs computed again in double precision. A tile pair gives the number of links of each vector and a spanning forest of its links,
never the pairs themselves: a dense group costs rows in proportion to its vectors.

Products of codes are sums of whole numbers; they are added up as float32 over at most EXACT components, where those are exact, and then as doubles.
What rounding is left in bounds and cosines is below slack(), which follows from the dimension. Vectors are scaled by a power of two
before norms are taken, so that very large and very small ones have them too.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows whose label is null;
vectors of different lengths do not link. Rows whose id is null are kept as they are and link with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplewright.llm.common import components, drop_path, shared_dir, stage, table, trimmed

THRESHOLD = 0.93
#: Vectors of a tile.
TILE = 2048
#: Components over which products of int8 codes are exact in float32: 127 * 127 * EXACT < 2 ** 24.
EXACT = 1024
#: Rows of a tile that are compared at once, and pairs computed in doubles at once.
_ROWS, _PAIRS = 512, 1 << 16


def slack(d: int) -> float:
    """More than rounding can add to a bound or a cosine of unit vectors of d components: a few units in the last place for each component."""
    return 16 * (d + 16) * 2.0**-53


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near one; no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as int8 codes, scales, |s*q| and |e|, the norm of the error."""
    x = scaled(x)
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, as doubles."""
    out = np.zeros((len(x), len(y)))
    for at in range(0, x.shape[1], EXACT):
        out += x[:, at : at + EXACT].astype(np.float32) @ y[:, at : at + EXACT].astype(np.float32).T
    return out


def bounds(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The int8 products of quantised rows, and by how much cosines can differ from them."""
    (qx, sx, nx, ex), (qy, sy, ny, ey) = x, y
    return products(qx, qy) * sx[:, None] * sy[None], nx[:, None] * ey[None] + ex[:, None] * (ny + ey)[None] + slack(qx.shape[1])


def compared(x: tuple, y: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices of quantised rows x and y: whether a pair is a link for sure, and whether only doubles can tell."""
    sure, open_ = (np.zeros((len(x[0]), len(y[0])), bool) for _ in range(2))
    for at in range(0, len(x[0]), _ROWS):
        part = slice(at, at + _ROWS)
        product, error = bounds(tuple(c[part] for c in x), y)
        sure[part] = product - error >= threshold
        open_[part] = (product + error >= threshold) & ~sure[part]
    return sure, open_


def decided(open_: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the open pairs whose cosine in doubles reaches the threshold."""
    x, y = scaled(x), scaled(y)
    lx, ly = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    out = np.zeros_like(open_)
    i, j = np.nonzero(open_)
    for at in range(0, len(i), _PAIRS):
        a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) / (lx[a] * ly[b]) >= threshold
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest over a matrix of links between two sets; over one set if it's given with both sides equal.

    Breadth first: a step takes the links of all vertices reached last, so a row or column is looked at once.
    """
    sides, seen = (links, links.T), (~links.any(axis=1), ~links.any(axis=0))
    out = []
    for start in np.flatnonzero(~seen[0]):
        if seen[0][start]:
            continue
        seen[0][start], side, last = True, 0, np.array([start])
        while len(last):
            near = sides[side][last]
            fresh = np.flatnonzero(near.any(axis=0) & ~seen[1 - side])
            parents = last[near[:, fresh].argmax(axis=0)] if len(fresh) else last[:0]
            out += zip(parents.tolist(), fresh.tolist()) if side == 0 else zip(fresh.tolist(), parents.tolist())
            seen[1 - side][fresh] = True
            last, side = fresh, 1 - side
    return out


def _codes(t: pa.Table, side: np.ndarray) -> tuple:
    """Those rows' codes, scales and norms."""
    n = t.num_rows
    q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(n, -1)[side]
    return (q, *(t.column(c).to_numpy()[side] for c in ("s", "nq", "ne")))


FOUND = "x int, y int, a long, b long, n long, side int"


def _tiles(key, t: pa.Table, threshold: float, again: bool) -> pa.Table:
    """One pair of tiles. Rows with n: so many links of a; with b: an edge of the forest; else a vector with open pairs, and its side.

    again: t holds the vectors with open pairs, with their components; the open pairs are decided.
    """
    ids, copies, side = (t.column(c).to_numpy() for c in ("rep", "copies", "side"))
    x, y = key[2].as_py(), key[3].as_py()
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    second = first if x == y else second
    sure, open_ = compared(_codes(t, first), _codes(t, second), threshold)
    if x == y:
        for m in (sure, open_):
            np.fill_diagonal(m, False)
    if again:
        vectors = np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        sure, open_ = decided(open_, vectors[first], vectors[second], threshold), np.zeros_like(open_)
    counts = np.zeros(len(ids), np.int64)
    counts[first] += sure @ copies[second]
    if x != y:
        counts[second] += sure.T @ copies[first]
    some, edges = np.flatnonzero(counts), np.array(forest(sure), np.int64).reshape(-1, 2)
    left, right = first[open_.any(axis=1)], second[open_.any(axis=0)] if x != y else first[:0]
    a = np.concatenate([ids[some], ids[first[edges[:, 0]]], ids[left], ids[right]])
    blank = len(left) + len(right)
    return pa.table({
        "x": pa.array([x] * len(a), pa.int32()), "y": pa.array([y] * len(a), pa.int32()), "a": pa.array(a, pa.int64()),
        "b": pa.array([*[None] * len(some), *ids[second[edges[:, 1]]].tolist(), *[None] * blank], pa.int64()),
        "n": pa.array([*counts[some].tolist(), *[None] * (len(edges) + blank)], pa.int64()),
        "side": pa.array([*[None] * (len(some) + len(edges)), *[0] * len(left), *[1] * len(right)], pa.int32()),
    })


def coded(df: DataFrame) -> DataFrame:
    """df (..., v) with q, s, nq, ne: the codes of v as bytes, their scale and norms."""
    more = [T.StructField("q", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in ("s", "nq", "ne"))]

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            values = np.asarray(lists.flatten(), np.float64)
            ends = np.cumsum(sizes)
            q, numbers = [b""] * len(sizes), np.zeros((3, len(sizes)))
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                codes, *theirs = quantised(values[(ends[rows] - d)[:, None] + np.arange(d)])
                numbers[:, rows] = theirs
                for i, code in zip(rows.tolist(), codes):
                    q[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.binary()), *map(pa.array, numbers)], [*batch.schema.names, "q", "s", "nq", "ne"])

    return df.mapInArrow(lambda batches: trimmed(run(batches)), T.StructType([*df.schema.fields, *more]))


def group(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of df."""
    base = shared_dir(df.sparkSession)
    kind = "array<float>" if df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) else "array<double>"
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.col(label).alias("label"))
    usable = "id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    good = rows.where(usable).select("id", "label", "v", F.xxhash64("v").alias("h"))
    reps = stage(coded(good.groupBy("label", "h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("d", F.size("v"))))
    # dealt by a hash of the vector: tiles of a label have like sizes, and no order over a whole label is needed
    sizes = reps.groupBy("label", "d").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = reps.select("label", "d", "rep", "copies", "q", "s", "nq", "ne", "h").join(sizes, ["label", "d"]).withColumn("t", F.expr("int(pmod(xxhash64(h, rep), tiles))"))
    # a tile pair's codes; within a tile every vector stands on one side
    pairs = dealt.withColumn("p", F.explode(F.expr("transform(sequence(0, tiles - 1), u -> struct(least(t, u) as x, greatest(t, u) as y, if(t <= u, 0, 1) as side))")))
    pairs = pairs.select("label", "d", "p.*", "rep", "copies", "q", "s", "nq", "ne")
    schema = f"{FOUND}, label {reps.schema['label'].dataType.simpleString()}, d int"

    def with_key(key, out: pa.Table) -> pa.Table:
        return out.append_column("label", pa.array([key[0].as_py()] * out.num_rows, key[0].type)).append_column("d", pa.array([key[1].as_py()] * out.num_rows, pa.int32()))

    found = stage(pairs.groupBy("label", "d", "x", "y").applyInArrow(lambda key, t: with_key(key, _tiles(key, t, threshold, False)), schema), f"{base}/sure")
    wanted = found.where("side is not null").select("label", "d", "x", "y", "side", F.col("a").alias("rep"))
    fetched = wanted.join(reps.select("rep", "copies", "q", "s", "nq", "ne", "v"), "rep")
    more = stage(fetched.groupBy("label", "d", "x", "y").applyInArrow(lambda key, t: with_key(key, _tiles(key, t, threshold, True)), schema), f"{base}/open")
    found = found.where("side is null").unionByName(more)
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    named = reps.join(links, reps.rep == links.a, "left").join(joined, reps.rep == joined.id, "left")
    named = stage(named.select("label", "h", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    drop_path(df.sparkSession, base)
    members = good.join(named, ["label", "h", "v"]).select(F.col("id"), "n_links", "component_id")
    alone = rows.where(f"not coalesce({usable}, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return members.unionByName(alone).select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
), root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM linked GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN root r USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""
