"""The vector index against a full scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from triplewright.operators import search
from triplewright.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, repeated vectors, lengths that differ, and vectors without a direction."""
    rng = random.Random(6)
    rows = []
    for c in range(12):
        centre = [rng.gauss(0, 1) for _ in range(8)]
        for _ in range(40):
            rows.append([(x + rng.gauss(0, 0.1)) * (s := rng.uniform(0.1, 9)) / s * s for x in centre])
    rows += [rows[3], rows[3], [2 * x for x in rows[3]], [0.0] * 8, None, [1.0] * 7 + [None], [1.0] * 7 + [math.nan], [1.0] * 7 + [math.inf]]
    return spark.createDataFrame([(i, v, "ab"[i % 2], 5) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, kind string, r int").drop("r"), rows


@pytest.mark.parametrize("pivots", [None, 1])
def test_equals_the_full_scan(spark, vectors, tmp_path, pivots):
    df, rows = vectors
    index = VectorIndex.build(df, path=str(tmp_path), pivots=pivots)
    good = df.where(f"vec_id < {len(rows) - 5}")
    skipped = 0
    for of in (3, 250):
        for k in (5, 60):
            assert index.neighbours(of, k).select("vec_id", "score").collect() == search.neighbours(good, of, k).collect()
            skipped += index.read(list(rows[of]), k)[1].read < len(index.cells)
        only = F.col("kind") == "b"
        assert index.neighbours(of, 7, only).select("vec_id", "score").collect() == search.neighbours(good.where(only | (F.col("vec_id") == of)), of, 7).where(f"vec_id <> {of}").collect()
    assert skipped >= (3 if pivots != 1 else 0)
    assert index.top([1.0] * 8, 10_000).count() == len(rows) - 5
    again = VectorIndex.open(spark, str(tmp_path))
    assert again.neighbours(3, 4).select("vec_id").collect() == index.neighbours(3, 4).select("vec_id").collect()


def test_empty_and_unknown(spark, vectors):
    df, _ = vectors
    index = VectorIndex.build(df.limit(0))
    assert index.top([1.0, 2.0], 3).count() == 0 and index.neighbours(1, 3).count() == 0
    assert VectorIndex.build(df).neighbours(-1, 3).count() == 0
