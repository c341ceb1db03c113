import math
import random

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import topk


def brute(rows, k=5, step=50):
    clean = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q, forms in clean.items():
        if q % step:
            continue
        score = {i: max(sum(a * b for a, b in zip(form, c, strict=False)) for form in forms for c in cs) for i, cs in clean.items() if i != q}
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, **options)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) if rng.random() < 0.6 else 0.0 for _ in range(12)]) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_rows=50, block_rows=3) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [0.0, 0.0]), (6, [-1.0, 1.0]), (6, [-1.0, 1.0]), (7, [0.5]), (50, [])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, []) == []


def test_ids_with_several_vectors(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 50, 100, *range(1, 12)]), [float(rng.randint(-3, 3)) for _ in range(4)]) for _ in range(120)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_rows=20, block_rows=1) == brute(rows)


def test_large_group_of_copies(spark):
    """A third of the rows are one vector: ties by id at the default sizes."""
    rng = random.Random(6)
    rows = [(i, [1.0, -0.5, 0.25] if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(3)]) for i in range(1500)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows)


def test_shard_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    for fill in (0.1, 0.6, 1.0):
        matrix = rng.integers(-3, 4, (5000, 20)) * (rng.random((5000, 20)) < fill)
        shard = topk.Shard(np.arange(5000), matrix, block=300)
        for _ in range(20):
            q = rng.integers(-5, 6, 20) * (rng.random(20) < 0.5)
            want = sorted((-s, i) for i, s in enumerate((matrix @ q).tolist()) if i != 17)[:5]
            assert [(-s, i) for s, i in shard.search(q, 17, 5)] == want


def test_numbers_too_large_for_doubles():
    rng = np.random.default_rng(8)
    matrix = rng.integers(-(1 << 29), 1 << 29, (700, 6))
    shard = topk.Shard(np.arange(700), matrix, block=64)
    q = rng.integers(-(1 << 29), 1 << 29, 6)
    want = sorted((-s, i) for i, s in enumerate((matrix @ q).tolist()) if i != 3)[:5]
    assert [(-s, i) for s, i in shard.search(q, 3, 5)] == want
