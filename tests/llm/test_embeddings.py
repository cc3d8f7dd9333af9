import time

import duckdb
import numpy as np

from triplewright.llm import embeddings


def test_equals_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in embeddings.op7_embeddings(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.execute(embeddings.OP7_SQL).fetchall())


def test_small_tiles_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(160):
        v = centres[i % 6] + rng.normal(size=16) * (0.1 if i % 3 else 0.25)
        rows.append([i, v.tolist(), int(i % 2)])
    rows += [[200 + i, rows[0][1], 0] for i in range(30)]
    bad = [[300, None, 0], [301, [0.0] * 16, 0], [302, [float("nan")] + [1.0] * 15, 0], [303, [None] + [1.0] * 15, 0], [304, rows[0][1], None], [305, [], 0], [306, [float("inf")] + [1.0] * 15, 0], [None, rows[0][1], 0], [307, [1.0, 2.0], 0]]
    df = spark.createDataFrame([tuple(r) + (1,) for r in rows + bad], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: r for r in embeddings.group(df, tile=20).collect() if r.vec_id is not None}
    good = [r for r in rows]
    x = np.array([r[1] for r in good])
    n = np.sqrt((x * x).sum(1))
    links = ((x @ x.T) / n[:, None] / n[None] >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None])
    np.fill_diagonal(links, False)
    root = np.array([r[0] for r in good])
    for _ in range(len(good)):
        new = np.array([min([root[i], *root[links[i]]]) for i in range(len(good))])
        if (new == root).all():
            break
        root = new
    for i, r in enumerate(good):
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (links[i].sum(), root[i], root[i] == r[0])
    assert all((got[b[0]].n_links, got[b[0]].component_id, got[b[0]].kept) == (0, b[0], True) for b in bad if b[0] is not None)
    assert len(got) == len(rows) + len(bad) - 1
    assert embeddings.group(df.limit(0)).count() == 0


def test_bounds_hold_at_many_components():
    """Also where float32 sums wouldn't be exact, and for vectors of any size."""
    rng = np.random.default_rng(1)
    for d in (3, 64, 1040, 1041, 4096):
        x = rng.normal(size=(40, d)) * 10.0 ** rng.integers(-200, 200, 40)[:, None]
        x[1], x[2] = np.abs(x[0]), 1.0
        codes = embeddings.quantised(x)
        assert (embeddings.products(codes[0], codes[0]) == codes[0].astype(np.int64) @ codes[0].astype(np.int64).T).all()
        u = embeddings.scaled(x)
        u /= np.sqrt((u * u).sum(1))[:, None]
        product, error = embeddings.bounds(codes, codes)
        assert (np.abs(u @ u.T - product) <= error).all()


def test_vectors_of_any_size_link(spark):
    rows = [(i, [a * s for a in (1.0, 2.0, 3.0)], 0) for i, s in enumerate((1.0, 1e200, 1e-200, 1e307))] + [(9, [1e200, -1e200, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.group(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 9: (0, 9)}


def test_a_forest_spans_its_links():
    rng = np.random.default_rng(2)
    for n, m, share in ((30, 30, 0.05), (50, 20, 0.1), (40, 40, 0.9), (5, 5, 0.0)):
        links = rng.random((n, m)) < share
        edges = embeddings.forest(links)
        assert all(links[i, j] for i, j in edges)

        def parts(pairs):
            root = list(range(n + m))
            for _ in range(n + m):
                for i, j in pairs:
                    root[i] = root[n + j] = min(root[i], root[n + j])
            return root

        assert parts(edges) == parts(np.argwhere(links).tolist())
    began = time.process_time()
    assert len(embeddings.forest(np.ones((1500, 1500), bool))) == 2999
    assert time.process_time() - began < 1
