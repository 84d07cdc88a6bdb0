"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.storage import stage
from loamwork.operators.components import connected_components, forest


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, some of them not 0."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(vectors: DataFrame, most: int = 5000, seed: int = 13) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of dimensions: principal axes (columns, by falling variance) and 64 quantile cuts of the first.

    Fitted on about `most` vectors in all, by hash of the id. Any rotation gives exact results; a good one is faster.
    """
    n = max(1, vectors.count())
    draw = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30))
    rows = vectors.where(draw < F.lit(int(min(1.0, most / n) * (1 << 30)))).select("v").toArrow()["v"].to_pylist()
    found = {}
    for d in {len(x) for x in rows}:
        x = np.array([r for r in rows if len(r) == d])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        found[d] = (np.ascontiguousarray(axes), np.quantile(x @ axes[:, 0], np.arange(1, 64) / 64))
    return found


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def linked_pairs(x: np.ndarray, rx: np.ndarray, y: np.ndarray, ry: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of x and y (i < j if they are the same rows) with cosine >= threshold. rx, ry: as unit vectors on the axes.

    Products are summed over the leading axes first. What the others can add is at most the product of the norms of
    the rest of both rows; when no pair can reach the threshold, the block is done, and when few can, only those are
    summed up. Pairs are confirmed in double precision on the vectors as they are.
    """
    d = x.shape[1]
    total = np.zeros((len(x), len(y)))
    cuts = sorted({0, max(1, d // 8), max(1, d // 4), max(1, d // 2), d})
    alive = np.zeros((0, 2), int)
    for a, b in zip(cuts, cuts[1:], strict=False):
        total += rx[:, a:b] @ ry[:, a:b].T
        rest = np.outer(np.linalg.norm(rx[:, b:], axis=1), np.linalg.norm(ry[:, b:], axis=1)) if b < d else 0.0
        can = total + rest >= threshold - 1e-9
        if same:
            can &= np.tri(len(x), len(x), -1, bool).T
        n = int(can.sum())
        if n * 20 <= total.size or b == d:
            alive = np.argwhere(can)
            break
    kept = []
    for part in np.array_split(alive, max(1, len(alive) // 200_000)):
        p, q = x[part[:, 0]], y[part[:, 1]]
        cos = np.einsum("ij,ij->i", p, q) / (np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
        kept.append(part[cos >= threshold])
    found = np.concatenate(kept) if kept else alive
    return found[:, 0], found[:, 1]


def linked_blocks(x: np.ndarray, lhs: np.ndarray, rhs: np.ndarray | None, axes: np.ndarray, threshold: float, block: int = 1024, boxes: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), row numbers of x, of the links between the rows lhs and rhs (within lhs, if rhs is None), block by block.

    Rows are ordered on the first axis and cut to blocks. Two blocks are skipped if the boxes that hold them on the
    first `boxes` axes lie farther apart than two unit vectors of the threshold's cosine can.
    """
    r = unit(x) @ axes
    reach = 2 - 2 * threshold + 1e-9
    cut = lambda rows: [(b, r[b, :boxes].min(0), r[b, :boxes].max(0)) for b in np.array_split(rows[np.argsort(r[rows, 0], kind="stable")], max(1, -(-len(rows) // block))) if len(b)]
    left = cut(lhs)
    right = left if rhs is None else cut(rhs)
    for k, (p, p0, p1) in enumerate(left):
        for q, q0, q1 in right[k if rhs is None else 0 :]:
            gap = np.maximum(0.0, np.maximum(q0 - p1, p0 - q1))
            if gap @ gap <= reach:
                i, j = linked_pairs(x[p], r[p], x[q], r[q], threshold, p is q)
                if len(i):
                    yield p[i], q[j]


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tile: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Rows are compared when their labels are equal and not null and their vectors have as many dimensions. Vectors
    without a direction, null labels and null ids link with nothing. Equal vectors of a label are one class, compared
    once; a repeated row counts as another vector. An id that several vectors have is one node with the links of all.

    A label's classes are dealt to tiles of about `tile` rows by their place on the first principal axis, and pairs of
    tiles are compared unless they lie too far apart on it: the cosine of unit vectors bounds their distance. A tile
    pair is compared in blocks (see linked_blocks) and returns each row's links as a count and a forest in place of its
    pairs, so a dense group stays small. A label of n classes is up to n / tile copies of its rows in the shuffle.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    ok = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = rows.where(ok).groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("m"))
    classes = stage(classes, "vectors")
    axes = rotation(classes)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)  # squares of the number of dimensions

    def first_axis(batches):
        for batch in batches:
            v, names = batch.column(1), batch.schema.names
            q = np.zeros(len(v), np.int32)
            sizes = np.array([len(x) for x in v], int)
            for d in set(sizes.tolist()) & set(shared.value):
                mine = np.flatnonzero(sizes == d)
                x = np.array(v.take(pa.array(mine)).to_pylist(), float)
                a, cuts = shared.value[d]
                q[mine] = np.searchsorted(cuts, unit(x) @ a[:, 0], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype("i4")), pa.array(q)], [*names, "d", "q"])

    placed = stage(classes.mapInArrow(first_axis, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", d int, q int"), "placed")
    # tiles: quantile ranges of the first axis for labels of more than a tile, cut by hash where one is still too large
    sizes = stage(placed.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")), "sizes")
    placed = sized_join(placed, sizes, ["label", "d"])
    ranges = F.least(F.lit(64), F.ceil(F.col("n") / tile).cast("int"))
    placed = placed.withColumn("b", F.floor(F.col("q") * ranges / 64).cast("int"))
    cells = stage(placed.groupBy("label", "d", "b").agg(F.count(F.lit(1)).alias("c"), F.min("q").alias("q0"), F.max("q").alias("q1")), "cells")
    parts = cells.withColumn("parts", F.ceil(F.col("c") / tile).cast("int"))
    placed = sized_join(placed, parts.select("label", "d", "b", "parts"), ["label", "d", "b"])
    placed = placed.withColumn("p", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select("label", "d", "b", "p", "rep", "m", "v")
    tiles = parts.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    gaps = [(d, i, j) for d, (_, cuts) in axes.items() for i in range(64) for j in range(i + 2, 65) if j < 65 and i < 63 and j <= 63 and cuts[j - 1] - cuts[i] <= reach]
    near = vectors.sparkSession.createDataFrame(gaps or [(-1, 0, 0)], "d int, q1 int, q0 int")  # 64 * 64 for each d
    one = tiles.select("label", "d", F.col("b").alias("b1"), F.col("p").alias("p1"), "q1")
    two = tiles.select("label", "d", F.col("b").alias("b2"), F.col("p").alias("p2"), "q0")
    pairs = one.join(two, ["label", "d"]).where("b1 < b2 OR (b1 = b2 AND p1 <= p2)")
    close = pairs.where("q0 <= q1 + 1").unionByName(pairs.where("q0 > q1 + 1").join(F.broadcast(near), ["d", "q1", "q0"], "left_semi").select(*pairs.columns))
    close = stage(close.select("label", "d", "b1", "p1", "b2", "p2").withColumn("pair", F.xxhash64("label", "d", "b1", "p1", "b2", "p2")), "tiles")
    key = ["label", "d", "pair"]
    close = close.withColumn("own", F.expr("b1 = b2 AND p1 = p2"))
    left = placed.join(close.select(*key, "own", F.col("b1").alias("b"), F.col("p1").alias("p")), ["label", "d", "b", "p"]).select(*key, "own", F.lit(0).alias("side"), "rep", "m", "v")
    right = placed.join(close.where("NOT own").select(*key, "own", F.col("b2").alias("b"), F.col("p2").alias("p")), ["label", "d", "b", "p"]).select(*key, "own", F.lit(1).alias("side"), "rep", "m", "v")

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        rep, m = table["rep"].to_numpy(), table["m"].to_numpy()
        v = table["v"].combine_chunks()
        d = table["d"][0].as_py()
        x = (v.values if isinstance(v, pa.ListArray) else v.chunk(0).values).to_numpy(zero_copy_only=False).reshape(-1, d)
        a = shared.value[d][0] if d in shared.value else np.eye(d)
        lhs, rhs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        order = np.argsort(rep, kind="stable")  # so that the forest's roots are the smallest ids
        place, every = np.empty(len(rep), int), np.arange(len(rep))
        place[order] = every
        links, low = np.zeros(len(rep), np.int64), every
        for i, j in linked_blocks(x, lhs, None if table["own"][0].as_py() else rhs, a, threshold):  # a block's pairs at a time
            links += (np.bincount(i, m[j], len(rep)) + np.bincount(j, m[i], len(rep))).astype("i8")
            low = forest(len(rep), np.r_[place[i], every], np.r_[place[j], low])
        low = rep[order][low][place]
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "low": low[some]})

    told = stage(left.unionByName(right).groupBy(*key).applyInArrow(compare, "rep long, links long, low long"), "links")
    links = told.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(told.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    known = classes.join(links, "rep", "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select(F.col("label").alias("_l"), F.col("v").alias("_v"), "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.withColumn("ok", ok).join(known, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")) & F.col("ok"), "left")
    comp = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
