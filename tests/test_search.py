"""The inverted file and box tiles against plain comparisons of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import boxes as B
from loamwork.operators import inverted as IV
from loamwork.operators import vectors as V
from loamwork.operators.neighbours import knn_self


def clustered(rng, n, dim=16, clusters=20, spread=0.15):
    centres = rng.standard_normal((clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dim)) / np.sqrt(dim)


def frame(spark, x, more=()):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("slice_rows", [8192, 37])
def test_inverted_file_is_exact(spark, slice_rows):
    rng = np.random.default_rng(3)
    x = np.concatenate([clustered(rng, 700), rng.standard_normal((200, 16))])
    x[50:80] = x[50]
    bad = [(10_001, None), (10_002, [0.0] * 16), (10_003, [float("nan")] * 16), (10_004, [1.0]), (10_005, [float("inf")] * 16)]
    v = frame(spark, x, bad)
    q = v.where("vec_id % 9 = 0 OR vec_id > 10000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    index = IV.build_index(v, 16, cells=25, most=400, slice_rows=slice_rows)
    assert index.rows.count() == 900 and index.n == 900
    got = IV.nearest(index, q, v, 5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for i in range(0, 900, 9):
        s = np.round(np.clip(u @ u[i], -1, 1), 9)
        want += [(i, place, int(j), float(s[j])) for place, j in enumerate(sorted(range(900), key=lambda j: (-s[j], j))[:5], 1)]
    assert [r[:3] for r in want] == sorted((r.query_id, r.place, r.vec_id) for r in got)
    assert np.allclose(sorted(r[3] for r in want), sorted(r.score for r in got), atol=2e-9)
    exact = V.topk(q.where("query_id < 900"), frame(spark, x), 5, "cosine", -1.0)
    assert {r.recall for r in V.recall(IV.nearest(index, q, v, 5), exact).collect()} == {1.0}


def test_cells_and_rows_are_left_out(spark):
    rng = np.random.default_rng(4)
    share = []
    for n in (1000, 8000):
        v = frame(spark, clustered(rng, n, clusters=40))
        q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
        rows = V.ann_search(q, v, 5, 16).collect()
        share.append((np.mean([r.scanned for r in rows]) / n, np.mean([r.ranked for r in rows]) / n))
    assert share[0][0] < 0.3 and share[1][0] < 0.15 and share[1][1] < 0.01


def test_random_vectors_rank_few(spark, small):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), V.doubles("embedding").alias("qv"))
    rows = V.ann_search(q, e, 5, 64).collect()
    assert len(rows) == 100 and max(r.ranked for r in rows) < 0.05 * e.count()


def test_empty_index(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qv array<double>")
    assert V.ann_search(q, none, 3, 2).collect() == []
    v = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.place) for r in V.ann_search(q, v, 3, 2).collect()] == [(1, 1)]
    assert V.ann_search(q.where("false"), v, 3, 2).collect() == []


@pytest.mark.parametrize(("least", "tile"), [(0.85, 40), (0.3, 40), (0.95, 500), (-0.2, 90)])
def test_boxes_lose_no_link(spark, least, tile):
    rng = np.random.default_rng(5)
    x = np.concatenate([clustered(rng, 500), rng.standard_normal((100, 16))])
    x[100:160] = x[100]
    got = {(r.id_a, r.id_b) for r in V.cosine_links(frame(spark, x), least, tile=tile).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.triu(u @ u.T, 1)
    sure = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cos >= least + 1e-12, 1)), strict=True)}
    may = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cos >= least - 1e-12, 1)), strict=True)}
    assert sure <= got <= may


def test_far_tiles_are_not_paired(spark):
    rng = np.random.default_rng(6)
    met = []
    for n in (1500, 6000):
        x = clustered(rng, n, clusters=40, spread=0.1)
        rows = frame(spark, x).select(F.lit("a").alias("k"), F.lit(16).alias("d"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
        places, boxes = B.box_tiles(rows, 50)
        assert places.count() == n and boxes.agg(F.max("n")).first()[0] <= 150
        tiles = boxes.count()
        met.append((tiles, B.close_tiles(boxes, 0.9).count()))
    assert met[1][0] > 3 * met[0][0] and met[1][1] < 0.3 * met[1][0] ** 2 / 2


@pytest.mark.parametrize("score", ["l2", "cosine"])
def test_topk_by_products_of_matrices(spark, score):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 8)) * 40) / 8  # many equal scores, halves at the ninth place
    x[100:140], x[200] = x[100], 1e7
    odd = [(1000, None), (1001, [1.0]), (1002, [None] * 8), (1003, [0.0] * 8), (1004, [])]
    v = frame(spark, x, odd)
    q = v.where("vec_id % 10 = 0 OR vec_id > 999").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    found = V.topk(q, v, 4, score, 0.05, slice_rows=60)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    own = (lambda c: c) if score == "l2" else V.unit
    a, b = own(F.col("qv")), own(F.col("embedding"))
    l2 = 1 / (1 + F.aggregate(F.zip_with(b, a, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))
    plain = l2 if score == "l2" else F.greatest(F.least(V.dot(b, a), F.lit(1.0)), F.lit(-1.0))
    pairs = q.crossJoin(v).where("size(qv) = size(embedding) AND size(qv) > 0 AND query_id <> 1002 AND vec_id <> 1002").select("query_id", "vec_id", F.round(plain, 9).alias("score")).where("score IS NOT NULL").collect()
    want = []
    for i in {r.query_id for r in pairs}:
        best = sorted((-r.score, r.vec_id) for r in pairs if r.query_id == i)[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best) if -s >= 0.05]
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("block", [None, 40])
def test_knn_of_every_row(spark, block):
    """Against a comparison of all rows, with equal and opposite vectors, ties, a zero vector and ones that have no score."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 8)).round(1).astype(np.float32)
    x[20:40], x[50:53], x[60], x[70] = x[3], x[4], 0, -x[3]
    ids = rng.permutation(1000)[:150].tolist()
    df = spark.createDataFrame([*zip(ids, x.tolist(), strict=True), (2000, None), (2001, [])], "vec_id long, embedding array<float>")
    got = knn_self(df, 3, block).collect()
    n = np.sqrt(np.add.accumulate(x.astype(float) ** 2, axis=1)[:, -1:])
    u = x / np.where(n == 0, 1, n)
    want = []
    for i, mine in enumerate(ids):
        scores = [(-round(min(1.0, max(-1.0, float(np.add.accumulate(u[i] * u[j])[-1]))), 9), ids[j]) for j in range(150) if j != i]
        want += [(mine, p, o, -s) for p, (s, o) in enumerate(sorted(scores)[:3], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_knn_self_asks_for_every_row(spark, small):
    from loamwork.plans.queries_vectors import QUERIES, emb

    got = QUERIES["knn_self"](spark, small)
    assert got.select("query_id").distinct().count() == emb(spark, small).count()
