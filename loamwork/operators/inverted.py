"""An inverted file over unit vectors: k-means cells, short codes, and bounds that say which cells and rows can matter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.storage import arrow_batches, stage

#: Scores are told to nine places, so bounds give way by a little more.
SLACK = 2e-9
MOST_CELLS = 1024


def unit_rows(v: list) -> np.ndarray:
    x = np.array(v, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit vectors around which the unit vectors x gather; a centre that loses all its rows moves to the worst-placed row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        score = x @ centres.T
        near = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(size < 1e-9)
        sums[lost], size[lost] = x[np.argsort(score.max(1))[: len(lost)]], 1.0
        centres = sums / size[:, None]
    return centres


@dataclass(frozen=True)
class CellIndex:
    """rows: vec_id, cell, slice, code, scale; sorted by cell. centres, and each cell's least cosine to its centre and slices."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    slices: np.ndarray
    n: int


def build_index(vectors: DataFrame, dim: int, cells: int | None = None, most: int = 20_000, slice_rows: int = 8192, seed: int = 7) -> CellIndex:
    """The index of all vectors (vec_id, embedding) of `dim` finite components that are not all zero; others are left out.

    The centres (about sqrt(n), MOST_CELLS at most) are fitted on about `most` rows, chosen by a hash of vec_id; every row
    then goes to its nearest cell with a code of two bytes a component. Cells are written in order, a large one as several
    slices. Of the rows, only sizes and radii of cells meet the driver.
    """
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v"))
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30))
    some = rows.where(draw < F.lit(int(min(1.0, most / max(1, n)) * (1 << 30)))).select("v").toArrow()["v"].to_pylist() or [[1.0] + [0.0] * (dim - 1)]
    centres = k_means(unit_rows(some), cells or min(MOST_CELLS, max(1, round(n**0.5))), seed=seed)

    def assign(batches):
        for b in batches:
            if not len(b):
                continue
            x = unit_rows(b.column(1).to_pylist())
            score = x @ centres.T
            near = score.argmax(1)
            top = np.abs(x).max(1) / 32767
            codes = np.rint(x / top[:, None]).astype("<i2")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype("i4")), pa.array(score[np.arange(len(x)), near]), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(top)], ["vec_id", "cell", "near", "code", "scale"])

    with arrow_batches(vectors.sparkSession, 4000):
        placed = stage(rows.mapInArrow(assign, "vec_id long, cell int, near double, code binary, scale double"), "cell-codes")
    radius, slices = np.ones(len(centres)), np.zeros(len(centres), int)
    for r in placed.groupBy("cell").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n")).collect():  # MOST_CELLS rows
        radius[r["cell"]], slices[r["cell"]] = min(1.0, r["near"]), -(-r["n"] // slice_rows)
    parts = F.element_at(F.array(*(F.lit(int(x)) for x in slices)), F.col("cell") + 1)
    dealt = placed.withColumn("slice", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).select("vec_id", "cell", "slice", "code", "scale")
    return CellIndex(stage(dealt.repartitionByRange("cell", "slice").sortWithinPartitions("cell", "slice"), "inverted-file"), centres, radius, slices, n)


def cell_bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that the cosine of each query and any row of each cell can be: the angle between a query and a row is at
    least that to the centre less the cell's radius."""
    far = np.arccos(np.clip(q @ centres.T, -1, 1)) - np.arccos(np.clip(radius, -1, 1))[None]
    return np.where(far <= 0, 1.0, np.cos(np.minimum(np.maximum(far, 0), np.pi)))


def _scan(index: CellIndex, probes: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, low, high: rows of the probed cells that may be among a query's best k, with bounds of their cosine.

    probes: query_id, qv, floor, cell, slice. Each slice of a cell meets the queries that probe it in a task of its own; a row
    stays if its high is not under the floor or the k-th best low of the slice.
    """

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), "<i2").reshape(len(rows), -1).astype("f8")
        scale, ids = rows["scale"].to_numpy(), rows["vec_id"].to_numpy()
        qid, floor = asked["query_id"].to_numpy(), asked["floor"].to_numpy()
        q = np.array(asked["qv"].to_pylist(), float)
        spread = np.abs(q).sum(1)
        out = []
        for part in np.array_split(np.arange(len(q)), -(-len(q) // 128)):
            about = (codes @ q[part].T).T * scale[None]
            error = spread[part, None] * scale[None] / 2 + SLACK
            low, high = about - error, about + error
            least = floor[part]
            if len(rows) >= k:
                least = np.maximum(least, np.partition(low, len(rows) - k, axis=1)[:, len(rows) - k])
            i, j = np.nonzero(high >= least[:, None])
            out.append((qid[part][i], ids[j], low[i, j], high[i, j]))
        a, b, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "low": c, "high": d})

    left = index.rows.groupBy("cell", "slice")
    return left.cogroup(probes.groupBy("cell", "slice")).applyInArrow(run, "query_id long, vec_id long, low double, high double")


def _best_low(found: DataFrame, k: int) -> DataFrame:
    """query_id, floor: the k-th best low of each query that has k rows."""
    w = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    return found.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).groupBy("query_id").agg(F.min("low").alias("floor"), F.count(F.lit(1)).alias("_c")).where(F.col("_c") == k).drop("_c")


def nearest(index: CellIndex, queries: DataFrame, vectors: DataFrame, k: int, first: int = 4) -> DataFrame:
    """query_id, place, vec_id, score, scanned, ranked: the k rows of the greatest cosine for each query (query_id, qv), exactly.

    A query first probes its `first` nearest cells: the k-th best lower bound there is its floor. Then it probes the other
    cells whose bound reaches the floor, and only rows whose own upper bound reaches the final floor are fetched and
    ranked by their vectors. scanned and ranked: how many rows' codes and vectors were looked at. Null, zero and
    non-finite queries, and those of other dimensions, have no rows; a query_id stands for one query; vec_ids are unique. Scores
    have nine places, ties go by vec_id.
    """
    centres, radius, slices = index.centres, index.radius, index.slices
    qv = F.col("qv").cast("array<double>")
    good = F.coalesce((F.size(qv) == centres.shape[1]) & F.forall(qv, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(qv, lambda x: x != 0), F.lit(False))
    q = stage(queries.where(good).select(F.col("query_id").cast("long"), qv.alias("qv")).withColumn("floor", F.lit(-2.0)), "queries")

    def probes(asked: DataFrame, near: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                x = unit_rows(b.column(1).to_pylist())
                order = np.argsort(-(x @ centres.T), axis=1)[:, :first]
                seeds = np.zeros((len(x), len(centres)), bool)
                np.put_along_axis(seeds, order, True, axis=1)
                want = seeds if near else ~seeds & (cell_bounds(x, centres, radius) >= b.column(2).to_numpy()[:, None] - SLACK)
                rows, cells = np.nonzero(want & (slices > 0)[None])
                rows, cells = np.repeat(rows, slices[cells]), np.repeat(cells, slices[cells])
                part = np.concatenate([np.arange(n) for n in slices[cells[np.flatnonzero(np.diff(np.r_[-1, rows * len(centres) + cells]))]]]) if len(rows) else rows
                flat = pa.array(list(x[rows]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), flat, b.column(2).take(pa.array(rows)), pa.array(cells.astype("i4")), pa.array(part.astype("i4"))], ["query_id", "qv", "floor", "cell", "slice"])

        return asked.select("query_id", "qv", "floor").mapInArrow(run, "query_id long, qv array<double>, floor double, cell int, slice int")

    with arrow_batches(queries.sparkSession, 200):
        seeds = stage(probes(q, True), "probes")
    one = stage(_scan(index, seeds, k), "found")
    floors = stage(_best_low(one, k), "floors")
    with_floor = sized_join(q.drop("floor"), floors, ["query_id"], "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    with arrow_batches(queries.sparkSession, 200):
        more = stage(probes(with_floor, False), "probes")
    every = stage(one.unionByName(_scan(index, more, k)), "found")
    last = stage(_best_low(every, k), "floors")
    picked = sized_join(every, last, ["query_id"], "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("query_id", "vec_id")
    sizes = stage(index.rows.groupBy("cell", "slice").count(), "cell-sizes")
    scanned = sized_join(seeds.unionByName(more).select("query_id", "cell", "slice"), sizes, ["cell", "slice"]).groupBy("query_id").agg(F.sum("count").alias("scanned"))
    told = stage(scanned.join(picked.groupBy("query_id").agg(F.count(F.lit(1)).alias("ranked")), "query_id"), "effort")
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    pairs = sized_join(stage(picked, "picked").join(v, "vec_id"), q.select("query_id", "qv"), ["query_id"], most=50_000)
    rated = pairs.select("query_id", "vec_id", F.round(F.greatest(F.least(dot / (size(F.col("v")) * size(F.col("qv"))), F.lit(1.0)), F.lit(-1.0)), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = rated.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)
    return sized_join(best, told, ["query_id"]).select("query_id", "place", "vec_id", "score", "scanned", "ranked")
