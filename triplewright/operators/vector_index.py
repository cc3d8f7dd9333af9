"""Exact nearest vectors by cells around pivots: the triangle inequality tells which cells can't hold any of the k nearest.

Vectors are compared by cosine; of unit vectors the squared distance is 2 - 2 cosine, so that nearest by cosine is nearest by distance. Building takes
some vectors as pivots (a bounded sample: the least by a hash of their id), puts each vector into the cell of its nearest pivot with its distance r to it, and
writes a directory per cell, sorted by r. A query at distance D from a pivot is at least |D - r| away from a vector of its cell.

A query first reads the cells nearest to it that hold k vectors of its scope, which bounds the k-th distance; then those cells whose bound is within it, and
in them only r from D - bound to D + bound, which Parquet's statistics prune too. The answer is that of a full scan, whatever the pivots; they
only decide how much is skipped. Scores are rounded to four places and ties go by id, so the bound takes in what rounds to the k-th score.

Vectors that are null, zero, or hold null or non-finite components are nobody's neighbours and are left out. k nearest of fewer than k vectors are all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplewright.operators.search import cosine
from triplewright.operators.staging import shared_dir

#: Most pivots; fewer for small tables: about the square root of the number of vectors.
PIVOTS = 1024
#: Rounding of scores, and what doubles may be off by.
_SLACK = 6e-5


@dataclass
class Reading:
    """What a query reads: cells in all, cells it can't skip, vectors in all, vectors in the distances that it reads."""

    cells: int
    read: int
    bound: float


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(vector: str) -> Column:
    """Whether a vector has a direction."""
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class VectorIndex:
    """A written index: vectors by cell, and the cells (cell, pivot, n, low, high), at most PIVOTS rows."""

    vectors: DataFrame
    cells: list
    id: str
    vector: str

    @staticmethod
    def build(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", path: str | None = None, pivots: int | None = None) -> VectorIndex:
        """Writes the index of vectors (id, vector and any other columns, which stay) below path, by default in the shared folder."""
        spark, path = vectors.sparkSession, path or shared_dir(vectors.sparkSession)
        given = vectors.where(valid(vector))
        n = pivots or max(1, min(PIVOTS, math.isqrt(given.count())))
        chosen = _unit(np.array([r[0] for r in given.orderBy(F.xxhash64(id), id).select(vector).limit(n).collect()] or [[1.0]], np.float64))
        names = vectors.columns
        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    square = np.maximum(2 - 2 * _unit(_matrix(part.column(vector))) @ chosen.T, 0)
                    cell = square.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(square[np.arange(len(cell)), cell]))], [*names, "cell", "r"])

        placed = given.mapInArrow(run, schema)
        # ranges of (cell, r): a cell that holds many vectors is shared out to many files
        placed.repartitionByRange("cell", "r", id).sortWithinPartitions("cell", "r").write.mode("overwrite").partitionBy("cell").option("parquet.block.size", 8 << 20).parquet(f"{path}/vectors")
        pivot_rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(chosen)], "cell int, pivot array<double>")
        stored = spark.read.schema(schema).parquet(f"{path}/vectors")
        stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).join(pivot_rows, "cell").write.mode("overwrite").parquet(f"{path}/cells")
        return VectorIndex.open(spark, path, schema, id, vector)

    @staticmethod
    def open(spark: SparkSession, path: str, schema: T.StructType | None = None, id: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        reader = spark.read.schema(schema) if schema else spark.read
        return VectorIndex(reader.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells").orderBy("cell").collect(), id, vector)

    def _reach(self, query: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """The query's distance to each cell's pivot, and the least distance that a vector of the cell can have."""
        q = _unit(np.array([query], np.float64))[0]
        d = np.sqrt(np.maximum(2 - 2 * np.array([c.pivot for c in self.cells]) @ q, 0))
        low, high = (np.array([c[x] for c in self.cells]) for x in ("low", "high"))
        return d, np.maximum(0, np.maximum(d - high, low - d))

    def _scored(self, rows: DataFrame, query: list[float]) -> DataFrame:
        return rows.withColumn("score", F.round(cosine(F.col(self.vector), F.array(*(F.lit(float(x)) for x in query))), 4))

    def _within(self, d: np.ndarray, cells: np.ndarray, bound: float) -> DataFrame:
        """Vectors of some cells that can be within a bound."""
        if not len(cells):
            return self.vectors.where(F.lit(False))
        ids = [int(self.cells[i].cell) for i in cells]
        away = self.vectors.sparkSession.createDataFrame([(int(self.cells[i].cell), float(d[i])) for i in cells], "cell int, away double")
        rows = self.vectors.where(F.col("cell").isin(ids)).where(F.col("r").between(float(d[cells].min() - bound), float(d[cells].max() + bound)))
        return rows.join(F.broadcast(away), "cell").where(F.abs(F.col("r") - F.col("away")) <= bound).drop("away")  # a row per cell, at most PIVOTS

    def read(self, query: list[float], k: int, where: Column | None = None) -> tuple[DataFrame, Reading]:
        """Candidates of the k nearest in a scope, and what is read for them."""
        if not self.cells or not any(query):
            return self.vectors.where(F.lit(False)), Reading(len(self.cells), 0, 0.0)
        scope = F.lit(True) if where is None else where
        d, least = self._reach(query)
        order, first = np.lexsort((d, least)), 0
        take, kth = 1, None
        while kth is None and first < len(order):  # cells that hold k vectors, more of them if the scope has few there
            held = np.cumsum([self.cells[i].n for i in order])
            first = min(len(order), max(take, int(np.searchsorted(held, k * take)) + 1))
            near = self._scored(self._within(d, order[:first], math.inf).where(scope), query).orderBy(F.desc("score")).limit(k).select("score").collect()
            kth, take = (near[-1].score if len(near) >= k else None), take * 4
        bound = math.inf if kth is None else math.sqrt(max(0.0, 2 - 2 * (kth - _SLACK))) + 1e-9
        cells = np.flatnonzero(least <= bound)
        return self._within(d, cells, bound).where(scope), Reading(len(self.cells), len(cells), bound)

    def top(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """The k nearest of a scope with their score, nearest first: as search.vector_top over all vectors of it."""
        rows, _ = self.read(query, k, where)
        return self._scored(rows, query).drop("cell", "r", self.vector).orderBy(F.desc("score"), self.id).limit(k)

    def neighbours(self, of: int, k: int, where: Column | None = None) -> DataFrame:
        """The k nearest of a stored vector, itself left out; none if it isn't stored."""
        row = self.vectors.where(F.col(self.id) == of).select(self.vector).first()
        other = F.col(self.id) != of
        return self.top(list(row[0]), k, other if where is None else other & where) if row else self.vectors.where(F.lit(False)).withColumn("score", F.lit(0.0)).drop("cell", "r", self.vector)
