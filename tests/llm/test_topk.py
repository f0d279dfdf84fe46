import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgraft.llm import topk


def brute(rows, k=5):
    out = {}
    for i, v in rows:
        if i % 50:
            continue
        scored = sorted((-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(v, w)), j) for j, w in rows if j != i)
        out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("kind", ["random", "skewed norms", "third equal"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8))
    if kind == "skewed norms":
        v *= rng.lognormal(0, 1.5, size=(600, 1))
    if kind == "third equal":
        v[::3] = v[0]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in topk.top_k(spark, df, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {i: sorted(x) for i, x in found.items()} == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, []), (1, [0.0, 0.0]), (2, [0.5, -0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in topk.top_k(spark, df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0), (0, 2, 2, 128 * 256 - 128 * 512)]
    assert topk.top_k(spark, df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rows_that_repeat_a_query_id_are_ranked_each(spark):
    rows = [(0, [1.0]), (0, [-1.0]), (0, [1.0])] + [(i, [float(i)]) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(spark, df, F.col("vec_id") % 50 == 0, k=2, block_rows=2, query_rows=1).collect())
    up, down = [(1, 3, 3 << 16), (2, 2, 2 << 16)], [(1, 1, -1 << 16), (2, 2, -2 << 16)]
    assert got == sorted(up + down + up)


def test_huge_components_are_exact():
    assert [int(x) for x in topk.products(np.array([[2.0**28, 768.0]]), np.array([2.0**30, 256.0]))] == [2**58 + 768 * 256]
