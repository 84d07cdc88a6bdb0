"""Quality scores by naive Bayes support vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.folds import bounded_sample, held_out
from loamwork.llm.shingles import U, shingles, slices, text_buffers

#: Byte classes of a text's shape: 16 of them, so that four make a number under 65,536.
MARKS = {ord(c): k for k, c in enumerate("*#$%&!|<>", 6)}
SHAPE = np.full(256, 15, np.uint8)
SHAPE[[32, 9, 11, 12, 13]] = 0
SHAPE[10] = 1
SHAPE[97:123] = 2
SHAPE[128:] = 2
SHAPE[65:91] = 3
SHAPE[48:58] = 4
SHAPE[[44, 46, 59, 58, 63, 39, 34, 45]] = 5
for _b, _k in MARKS.items():
    SHAPE[_b] = _k
PAIRS, FOURS, ECHOES, WORDS = 256, 65_536, 16, 1 << 17
DIMS = PAIRS + FOURS + ECHOES + WORDS


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct n-grams of each row, as numbers under DIMS: pairs and runs of four of the bytes' shapes, runs of
    five words by which of them equal the word before, and words.

    Null or empty: none. Words are hashed; two that share a number are one feature.
    """
    raw, at = text_buffers(column)
    mark2, mark4 = np.zeros(PAIRS, bool), np.zeros(FOURS, bool)
    for i, j in slices(at):
        part, cuts = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        shape = SHAPE[part].astype(np.int32)
        two = shape[:-1] * 16 + shape[1:] if len(part) > 1 else np.zeros(0, np.int32)
        four = two[:-2] * 256 + two[2:] if len(part) > 3 else np.zeros(0, np.int32)
        h, r = shingles(part, cuts, 1)
        same = np.zeros(len(h), np.int32)
        same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        echo = same[:-3] * 8 + same[1:-2] * 4 + same[2:-1] * 2 + same[3:] if len(h) > 3 else same[:0]
        h = (h >> U(47)).astype(np.int64)
        ends = np.searchsorted(r, np.arange(j - i + 1))
        for k in range(j - i):
            a, b = cuts[k], cuts[k + 1]
            x, y = two[a : max(a, b - 1)], four[a : max(a, b - 3)]
            mark2[x] = mark4[y] = True
            s, t = ends[k], ends[k + 1]
            out = [np.flatnonzero(mark2), np.flatnonzero(mark4) + PAIRS, np.unique(echo[s : max(s, t - 3)]) + PAIRS + FOURS]
            out.append(np.unique(h[s:t]) + PAIRS + FOURS + ECHOES)
            mark2[x] = mark4[y] = False
            yield np.concatenate(out)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0, least: int = 4) -> np.ndarray:
    """log of the ratio of the features' shares in the two classes; 0 for features of under `least` rows."""
    count = {c: np.bincount(np.concatenate([np.zeros(0, int), *(x for x, v in zip(rows, y, strict=True) if v == c)]), minlength=DIMS) for c in (1, -1)}
    p, q = count[1] + smooth, count[-1] + smooth
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[count[1] + count[-1] < least] = 0
    return r


def dual_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of a linear hinge-loss model over rows r[x] / sqrt(len(x)), by dual coordinate descent.

    One dual variable at a time is set to its best value in [0, c]; the primal weights follow.
    """
    w, a = np.zeros(DIMS + 1), np.zeros(len(rows))
    values = [r[x] / np.sqrt(max(1, len(x))) for x in rows]
    q = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(a[i] - g / q[i], 0.0), c[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[x] += step * v
                w[-1] += step
                a[i] = new
    w[:-1] *= r
    return w


def margins(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    return np.array([w[x].sum() / np.sqrt(max(1, len(x))) + w[-1] for x in rows])


def sigmoid_fit(m: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of P(label 1) = 1 / (1 + exp(-(slope * margin + offset))), by damped Newton steps."""
    t = np.where(y > 0, 0.99, 0.01)
    x = np.stack([m, np.ones(len(m))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b + np.linalg.solve(h, x.T @ (weight * (t - p)) - 1e-3 * b)
        b = np.clip(b, -50, 50)
    return max(float(b[0]), 1e-3), float(b[1])


class QualityModel:
    """Weights and calibration. Without two classes to learn from, every score is the share of label 1 (0.5 for none)."""

    def __init__(self, w: np.ndarray, slope: float, offset: float):
        self.w, self.slope, self.offset = w.astype("f4"), slope, offset

    def scores(self, column: pa.Array) -> np.ndarray:
        m = margins(list(indicators(column)), self.w)
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 3000) -> QualityModel:
    """Fit on about `most_rows` labelled rows of each class that are not held out; a fifth of them calibrates.

    Only `quality` of labels is read (0 or 1; others and null are left out). A document that labels call both 0 and 1 is
    a row of each class; repeated labels count once. The sample meets the driver as lists of
    feature numbers; it is bounded by most_rows, whatever the size of docs.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    share = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    chosen = bounded_sample(marked, "quality", most_rows).dropDuplicates()
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about 2 * most_rows rows

    def featured(batches):
        for batch in batches:
            x = [v.astype("i4") for v in indicators(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "quality", "x"])

    got = pairs.select("doc_id", "quality", "text").mapInArrow(featured, "doc_id long, quality int, x array<int>").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    y = np.where(np.array(got["quality"].to_pylist(), int) == 1, 1, -1)
    rows = [np.asarray(x.values) for x in got["x"].combine_chunks()] if len(y) else []
    if len(set(y)) < 2:
        p = np.clip((y > 0).mean() if len(y) else 0.5, 0.01, 0.99)
        return QualityModel(np.zeros(DIMS + 1), 1.0, float(np.log(p / (1 - p))))
    seen = np.array([c.sum() for c in (y > 0, y < 0)])
    true = np.array([share[1], share[0]]) / sum(share.values())
    weight = np.where(y > 0, true[0] / seen[0], true[1] / seen[1]) * len(y)  # as common as in labels
    test = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.ones(len(y), bool)
    fit = ~test if len(set(y[~test])) == 2 and len(set(y[test])) == 2 else np.ones(len(y), bool)
    mine = [x for x, f in zip(rows, fit, strict=True) if f]
    r = log_count_ratios(mine, y[fit])
    w = dual_descent(mine, r, y[fit], np.full(int(fit.sum()), 1.0))
    judged = test if not fit.all() else fit
    slope, offset = sigmoid_fit(margins([x for x, f in zip(rows, judged, strict=True) if f], w), y[judged], weight[judged])
    return QualityModel(w, slope, offset)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text of docs; null is empty, and an empty text scores what the bias says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def decided(score_: Column, threshold: float = 0.3) -> Column:
    return (score_ >= threshold).cast("int")


def score_documents(docs: DataFrame, labels: DataFrame, most_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where score is 0.3 at least) of every document."""
    out = score(docs, train(docs, labels, most_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", decided(F.col("score")).alias("predicted"))
