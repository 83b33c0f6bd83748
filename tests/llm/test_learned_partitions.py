import numpy as np

from semblance.llm.learned_partitions import balanced_cut, fit_router, nearest, neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int"


def run(spark, rows, queries, **kw):
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, df.where(queries), **kw).collect())


def brute(rows, asked, k=10):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = np.asarray(v, np.float32).astype(float)
    out = []
    for q in asked:
        if q in fine:
            near = sorted((float(np.sqrt(((fine[i] - fine[q]) ** 2).sum())), i) for i in fine if i != q)[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def test_few_rows_are_ranked_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60 + i, rows[3][1]) for i in range(30)] + [rows[5], rows[5]]
    rows += [(200, None), (300, [0.0] * 8), (400, [float("nan")] + [1.0] * 7), (500, [float("inf")] + [1.0] * 7), (600, [1.0, None] + [1.0] * 6), (700, [1.0]), (None, [1.0] * 8)]
    got = run(spark, rows, "vec_id % 10 = 0 or vec_id = 3")
    want = brute(rows, [3, *range(0, 100, 10), 200, 300, 400, 500, 600, 700])
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-15)


def test_recall_over_many_parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(3000)]
    got = run(spark, rows, "vec_id % 50 = 0", rows_per_part=150, sample=1500, rows_per_task=100, queries_per_task=4)
    want = brute(rows, range(0, 3000, 50))
    assert len(got) == len(want)
    hits = len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want})
    assert hits >= 0.9 * len(want)


def test_tiny_and_empty_tables(spark):
    assert run(spark, [], "vec_id = 0") == [] and run(spark, [(1, [0.0])], "vec_id = 1") == []
    assert run(spark, [(0, [1.0] * 8)], "vec_id = 0") == []
    assert [g[:3] for g in run(spark, [(0, [1.0] * 8), (1, [1.0] * 8)], "vec_id = 0")] == [(0, 1, 1)]


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(100, 4)) + 6 * k for k in range(4)])
    near = neighbours(points, points, 5, True)
    where = balanced_cut(near, points, 4, rng)
    assert np.bincount(where, minlength=4).max() <= 110
    assert (where[near] == where[:, None]).mean() > 0.8


def test_few_of_many_parts_are_searched_where_vectors_have_structure():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 16)) * 2
    points = centres[rng.integers(150, size=3200)] + rng.normal(size=(3200, 16)) * 0.3
    router, probes = fit_router(points, 128, 0.95)
    assert probes <= 16
    base, asked = centres[rng.integers(150, size=4000)] + rng.normal(size=(4000, 16)) * 0.3, centres[rng.integers(150, size=200)] + rng.normal(size=(200, 16)) * 0.3
    home, best = router(base).argmax(1), np.argsort(-router(asked), 1)[:, :probes]
    near = neighbours(base, asked, 10, False)
    assert (home[near][:, :, None] == best[:, None, :]).any(2).mean() >= 0.9
