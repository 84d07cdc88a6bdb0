"""Triangles, forests and greedy dedup against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import graph as G
from loamwork.operators import vectors as V
from loamwork.operators.components import connected_components


@pytest.mark.parametrize("most", [20, 1000, 2_000_000])
def test_triangles(spark, most):
    rng = np.random.default_rng(3)
    a = np.triu(rng.random((90, 90)) < 0.15, 1)
    a[5, 6:] = True  # a hub
    both = (a | a.T).astype(int)
    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for i, j in zip(*np.nonzero(a), strict=True)], "src string, dst string")
    got = {r.id: (r.degree, r.t) for r in G.triangles(edges, most).collect()}
    want = np.diag(both @ both @ both) // 2
    assert got == {f"n{i}": (int(both[i].sum()), int(want[i])) for i in range(90) if both[i].any()}


def test_paths_are_not_joined(spark):
    n = spark.range(60).select("id")
    e = n.crossJoin(n.withColumnRenamed("id", "b")).where("id < b").select(F.col("id").alias("src"), F.col("b").alias("dst"))
    out = G.clustering_coefficient(n, e)
    assert {r.coefficient for r in out.collect()} == {1.0}
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_forest_has_the_components_of_all_links(spark):
    x = np.random.default_rng(4).standard_normal((300, 8))
    links = V.cosine_links(vectors(spark, x), 0.8, tile=40).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    few = V.cosine_forest(vectors(spark, x), 0.8, tile=40)
    rows = lambda e: sorted((r.node, r.component) for r in connected_components(e).collect())
    assert rows(few) == rows(links) and V.cosine_forest(vectors(spark, x), -1.0, tile=40).count() < links.sparkSession.range(300 * 20).count()


def test_tiles_grow_with_the_block():
    assert V.TILES * V.MOST_TILE > 700_000 and V.LEAST_TILE == 2048


@pytest.mark.parametrize(("least", "pivots"), [(0.3, 16), (0.7, 64), (0.99, 50), (0.5, 4096)])
def test_greedy_dedup_is_sequential(spark, least, pivots):
    x = np.random.default_rng(5).standard_normal((260, 6))
    x[7] = 0
    df = vectors(spark, x).unionByName(spark.createDataFrame([(1000, None), (1001, [1.0, 2.0]), (1002, [2.0, 4.0])], "vec_id long, embedding array<double>"))
    kept = []
    for i in range(260):
        if i != 7 and not any(x[i] @ x[j] > least * np.linalg.norm(x[i]) * np.linalg.norm(x[j]) for j in kept):
            kept.append(i)
    got = {r.id: r.kept for r in V.greedy_dedup(df, least, True, pivots).collect()}
    assert len(got) == 263 and {i for i, k in got.items() if k} == {*kept, 7, 1000, 1001}
