"""Clustering and whitening against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import clustering, queries, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>"


def plain_clusters(vectors, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for _, _, v in hashed[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = sum(d for _, _, d in found)
    return sorted(((i, c, d, sum(x for _, o, x in found if o == c), inertia, centroids[c]) for i, c, d in found), key=repr)


def clusters(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()), key=repr)


def test_clusters_are_those_of_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() + (i % 4) for _ in range(4)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("inf"), 0.0, 0.0, 0.0]), (64, [1.0] * 3), (65, []), (None, [9.0] * 4), (7, rows[7][1]), (7, rows[8][1])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = clusters(clustering.cluster(spark.createDataFrame(rows, KIND), k=5, rounds=6, dims=4, scale=100))
    assert got == plain_clusters(rows, 5, 6, 4, 100, 3)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(x)]) for i, x in enumerate((0, 0, 0, 2, 4, 4))]
    got = clusters(clustering.cluster(spark.createDataFrame(rows, KIND), k=4, rounds=3, dims=1, scale=1))
    assert got == plain_clusters(rows, 4, 3, 1, 1, 3)
    same = [(i, [1.5, -2.5]) for i in range(9)]
    assert clusters(clustering.cluster(spark.createDataFrame(same, KIND), dims=2)) == plain_clusters(same, 8, 10, 2, 1024, 3)


def test_clusters_of_none_or_few_and_clashing_names(spark):
    none = clustering.cluster(spark.createDataFrame([], KIND), dims=2)
    assert none.columns == ["vec_id", "embedding", *clustering.ADDED] and none.count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0], "a", 5), (2, [3.0, 4.0], None, 6)], f"{KIND}, x string, Cluster int")
    got = clustering.cluster(few, dims=2)
    assert got.columns == ["vec_id", "embedding", "x", *clustering.ADDED]
    assert {(r.vec_id, r.x, r.distance) for r in got.collect()} == {(1, "a", 0), (2, None, 0)}
    one = [(3, [0.5, -0.5])]
    assert clusters(clustering.cluster(spark.createDataFrame(one, KIND), dims=2)) == plain_clusters(one, 8, 10, 2, 1024, 3)


def test_a_round_shuffles_a_row_for_each_cluster_and_runs_no_python(spark):
    ints = spark.read.parquet(f"{SF}/embeddings.parquet").select(clustering.integers(F.col("embedding"), 8).alias("x"))
    near = ints.select(clustering.nearest(F.col("x"), [[0] * 64, [9] * 64])["cluster"].alias("c"), "x")
    plan = near.groupBy("c").agg(F.expr("sum(x[0])"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "partial_sum" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("low, high, dims, rows", [(0, 1, 3, 70), (-5, 9, 4, 1), (0, 1 << 20, 3, 130), (-(1 << 40), 1 << 40, 3, 65), (-(1 << 62), 1 << 62, 2, 64), (7, 7, 2, 10)])
def test_scatter_is_exact(low, high, dims, rows):
    rng = random.Random(rows)
    x = [[rng.randint(low, high) for _ in range(dims)] for _ in range(rows)]
    n, sums, products = whitening.scatter(np.array(x, np.int64))
    assert n == rows and sums == [sum(c) for c in zip(*x)]
    assert products == [[sum(r[i] * r[j] for r in x) for j in range(dims)] for i in range(dims)]


def plain_whitening(rows, components):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x)]
    off = [[n * a - s for a, s in zip(r, sums)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in off) / n**3 for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return n, [sum(a * a for a in r) for r in off], np.array(off) / n @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def test_whitening_is_that_of_plain_loops(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 4).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("-inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0])]
    got = sorted(whitening.whiten(spark.createDataFrame(rows + odd, KIND).repartition(5), components=4).collect(), key=lambda r: r.vec_id)
    n, deviation, whitened, explained = plain_whitening(rows, 4)
    assert [r.vec_id for r in got] == list(range(300)) and {r.n for r in got} == {n}
    assert [int(r.deviation) for r in got] == deviation
    mine = np.array([r.whitened for r in got])
    assert np.allclose(mine * np.sign((mine * whitened).sum(axis=0)), whitened, atol=1e-9)
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and all(r.identity_error < 1e-9 for r in got)
    assert np.allclose(np.cov(mine.T, bias=True), np.eye(4), atol=1e-9)


def test_whitening_without_variance_or_rows(spark):
    none = whitening.whiten(spark.createDataFrame([], KIND))
    assert none.columns == ["vec_id", "embedding", *whitening.ADDED] and none.count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], KIND)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(2, 0, [None, None], [0.0, 0.0], 0.0)] * 2
    flat = spark.createDataFrame([(i, [float(i), 3.0], "a", i) for i in range(4)], f"{KIND}, x string, N long")
    got = whitening.whiten(flat).orderBy("vec_id").collect()
    assert got[0].asDict().keys() == {"vec_id", "embedding", "x", *whitening.ADDED}
    assert [r.whitened[1] for r in got] == [None] * 4 and got[0].explained == pytest.approx([1, 0]) and got[0].identity_error < 1e-12
    assert np.allclose(np.abs([r.whitened[0] for r in got]), np.abs(np.array([-1.5, -0.5, 0.5, 1.5]) / np.sqrt(1.25)))


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, deviation, whitened, explained = plain_whitening(rows, 32)
    got = queries.op13_whitening(spark, SF).collect()
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == 32 * len(rows) and {r.component for r in got} == set(range(1, 33))
    assert all(r.n == n and r.deviation == deviation[at[r.vec_id]] and r.identity_error < 1e-4 for r in got)
    assert all(math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-6) for r in got)
    mine = np.zeros((len(rows), 32))
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
    assert np.allclose(mine * np.sign((mine * whitened).sum(axis=0)), whitened, atol=1e-6)
