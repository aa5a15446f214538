"""Embedding near-duplicates against all cosines."""

import numpy as np

from tenderloom.llm import vectors


def brute(rows):
    x = [np.array(v if v is not None and None not in v else [np.nan], float) for _, v in rows]
    n, ids = len(rows), [i for i, _ in rows]
    good = [bool(len(v)) and np.isfinite(v).all() and np.abs(v).max() > 0 for v in x]
    x = [v / np.abs(v).max() if g else v for v, g in zip(x, good, strict=True)]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], least[find(i)], ids[i] == least[find(i)]) for i in range(n))


def fixture():
    rng = np.random.default_rng(4)
    out = []
    for size in (1, 2, 5, 30, 3):
        base = rng.standard_normal(24)
        out += [(base + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.33])).tolist() for _ in range(size)]
    out += [rng.standard_normal(24).tolist() for _ in range(80)]
    out += [out[5], out[5], [2 * x for x in out[5]], None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23,
            [1e-200] * 24, [1e200] * 24, [1.0] * 24, [1.0] * 5]
    return [(i * 2, v) for i, v in enumerate(out)]


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_equals_all_pairs(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == brute(rows)


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rows = fixture()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == brute(rows)
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_plan_bounds_the_loss():
    for rows in (10, 10_000, 10_000_000):
        bits, tables = vectors.plan(rows)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 1e-5


def test_long_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(384)
        rows += [(base + rng.standard_normal(384) * s).tolist() for s in (0.0, 0.1)]
    rows = [(i, v) for i, v in enumerate(rows + [rng.standard_normal(768).tolist()])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == brute(rows)
