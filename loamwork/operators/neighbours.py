"""The nearest others of every row of an embedding table, exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.storage import BLOBS, stage
from loamwork.operators.vectors import _matrix, _round9

#: Rows of one block and numbers of its vectors, at most; a table is cut to so many blocks if that makes smaller ones.
LEAST_BLOCK, MOST_BLOCK, MOST_NUMBERS, BLOCKS = 2048, 32768, 1 << 22, 12
#: Rows that meet a block at once, pairs that are scored at once, and pairs that are held until only the best stay.
STEP, PAIRS, HELD = 256, 1 << 16, 1 << 22


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, summed in the order of their components; zero vectors stay."""
    n = np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1:])
    return np.divide(x, n, out=x.copy(), where=n != 0)


def _exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows a of x and b of y as topk has them: summed in order, clipped, of nine places, 1 if NaN."""
    out = np.empty(len(a))
    for at in range(0, len(a), PAIRS):
        s = np.add.accumulate(x[a[at : at + PAIRS]] * y[b[at : at + PAIRS]], axis=1)[:, -1]
        out[at : at + PAIRS] = _round9(np.where(np.isnan(s), 1.0, np.clip(s, -1.0, 1.0)))
    return out


def _first(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (by score, then id) of each of `who`, in that order."""
    order = np.lexsort((ids, -scores, who))
    w = who[order]
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, int)
    rank = np.arange(len(w)) - np.repeat(starts, np.diff(np.r_[starts, len(w)]))
    return order[rank < k]


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells of a mask, most of which are false."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    eight = np.flatnonzero(flat[:whole].view(np.uint64))
    cells = (eight[:, None] * 8 + np.arange(8)).reshape(-1)
    cells = np.r_[cells[flat[cells]], whole + np.flatnonzero(flat[whole:])]
    return cells // mask.shape[1], cells % mask.shape[1]


class _Block:
    """A block's unit vectors, in double and, for products of matrices, in single precision; NaN vectors as zeros there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, _unit(vectors.astype(float))
        self.bad = ~np.isfinite(self.x).all(axis=1)
        self.rough = np.where(self.bad[:, None], 0, self.x).astype(np.float32)
        #: What single precision may change in a product, and the half of the last place of a score.
        self.slack = (self.x.shape[1] + 8) * 2.0**-23 + 2e-9

    def products(self, other: _Block):
        """(first row, products of the next rows with all of other)."""
        columns = np.ascontiguousarray(other.rough.T)
        for at in range(0, len(self.ids), STEP):
            r = self.rough[at : at + STEP] @ columns
            r[self.bad[at : at + STEP]] = 1
            if other.bad.any():
                r[:, other.bad] = 1
            yield at, r


def _within(own: _Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and scores of the k best rows of a block for each of its own, itself among them."""
    found = []
    for at, r in own.products(own):
        groups = r.shape[1] // 32
        some = r[:, : groups * 32].reshape(len(r), 32, groups).max(axis=1) if groups >= k else r
        n = some.shape[1]
        cut = np.partition(some, n - k, axis=1)[:, n - k, None] - np.float32(2 * own.slack) if n >= k else np.full((len(r), 1), -2, "f4")
        a, b = _places(r >= cut)
        s = _exact(own.x[at : at + STEP], own.x, a, b)
        keep = _first(a, own.ids[b], s, k)
        found.append((a[keep] + at, own.ids[b[keep]], s[keep]))
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, s


def _across(one: _Block, two: _Block, low1: np.ndarray, low2: np.ndarray, k: int):
    """For the rows of each block: (ids, ids of the other block, scores) of the k best there that may reach the row's bound."""
    left, right, held = [], [], 0

    def best(found):
        who, ids, s = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = _first(who, ids, s, k)
        return who[keep], ids[keep], s[keep]

    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for at, r in one.products(two):
        mask = r >= low1[at : at + STEP, None]
        mask |= r >= low2[None, :]
        a, b = _places(mask)
        s = _exact(one.x[at : at + STEP], two.x, a, b)
        mine = r[a, b] >= low1[at : at + STEP][a]
        theirs = r[a, b] >= low2[b]
        a += at
        left.append(best([(one.ids[a[mine]], two.ids[b[mine]], s[mine])]))
        right.append((two.ids[b[theirs]], one.ids[a[theirs]], s[theirs]))
        held += int(theirs.sum())
        if held > HELD:
            right = [best(right)]
            held = len(right[0][0])
    return best([none, *left]), best([none, *right])


def _blob(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


_FOUND = "d int, block int, who binary, other binary, score binary"
_FOUND_ARROW = pa.schema([("d", pa.int32()), ("block", pa.int32()), ("who", pa.binary()), ("other", pa.binary()), ("score", pa.binary())])


def _found(d: int, block: int, who: np.ndarray, other: np.ndarray, score: np.ndarray) -> dict:
    return {"d": d, "block": block, "who": _blob(who, "<i8"), "other": _blob(other, "<i8"), "score": _blob(score, "<f8")}


def _all_best(rows: DataFrame, n: int, k: int, block: int | None) -> DataFrame:
    """c, o, score: the k best rows o for every row c of rows (c, v: different vectors), itself among them."""
    kind = "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    block = block or max(1, min(MOST_BLOCK, MOST_NUMBERS // width, max(LEAST_BLOCK, -(-n // BLOCKS))))
    p = max(1, -(-n // block))
    dealt = rows.withColumns({"d": F.size("v"), "block": F.pmod(F.xxhash64("c"), F.lit(p)).cast("int")})

    def within(table: pa.Table) -> pa.Table:
        d, at = table["d"][0].as_py(), table["block"][0].as_py()
        ids, x = table["c"].to_numpy(), _matrix(table["v"], table["d"][0].as_py())
        who, other, score = _within(_Block(ids, x), k)
        count = np.bincount(who, minlength=len(ids))
        low = np.where(count >= k, score[np.cumsum(count) - 1], -2.0)  # the k-th best here bounds what other blocks may add
        row = _found(d, at, ids[who], other, score) | {"ids": _blob(ids, "<i8"), "vectors": _blob(x, kind), "low": _blob(low, "<f8")}
        return pa.Table.from_pylist([row], own_arrow)

    more = [("ids", pa.binary()), ("vectors", pa.binary()), ("low", pa.binary())]
    own_arrow = pa.schema([*_FOUND_ARROW, *more])
    own = dealt.repartition(4 * p, "d", "block").groupBy("d", "block").applyInArrow(within, _FOUND + ", ids binary, vectors binary, low binary")
    own = stage(own, "blocks", BLOBS)
    found = own.select("d", "block", "who", "other", "score")
    if p > 1:
        blobs = ["ids", "vectors", "low"]
        one = own.where(F.col("block") < p - 1).select("d", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.lit(p - 1))).alias("j"), F.lit(0).alias("side"), *blobs)
        two = own.where("block > 0").select("d", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), *blobs)

        def across(table: pa.Table) -> pa.Table:
            if len(table) < 2:  # no vectors of this width in the other block
                return _FOUND_ARROW.empty_table()
            d, sides = table["d"][0].as_py(), table["side"].to_pylist()
            blocks, lows = [], []
            for at in (sides.index(0), sides.index(1)):
                ids = np.frombuffer(table["ids"][at].as_buffer(), "<i8")
                blocks.append(_Block(ids, np.frombuffer(table["vectors"][at].as_buffer(), kind).reshape(-1, d)))
                lows.append((np.frombuffer(table["low"][at].as_buffer(), "<f8") - blocks[-1].slack).astype("f4"))
            left, right = _across(*blocks, *lows, k)
            return pa.Table.from_pylist([_found(d, table["i"][0].as_py(), *left), _found(d, table["j"][0].as_py(), *right)], _FOUND_ARROW)

        pairs = one.unionByName(two).repartition(p * (p - 1), "d", "i", "j")
        found = found.unionByName(stage(pairs.groupBy("d", "i", "j").applyInArrow(across, _FOUND), "found", BLOBS))

    def best(table: pa.Table) -> pa.Table:
        who, other, score = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]) for c, t in (("who", "<i8"), ("other", "<i8"), ("score", "<f8")))
        keep = _first(who, other, score, k)
        return pa.table({"c": who[keep], "o": other[keep], "score": score[keep]})

    return found.repartition(4 * p, "d", "block").groupBy("d", "block").applyInArrow(best, "c long, o long, score double")


def knn_self(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """query_id, place, vec_id, score: the k best other rows by cosine (of nine places, then by id) for every row of vectors.

    vectors: vec_id, embedding; ids are unique. Rows whose vectors are null, empty or have null components have and are no
    neighbours. Equal vectors are compared once and answered by their first ids. Different ones are dealt to blocks. Each block
    finds its own rows' best, whose last scores are bounds; then each pair of blocks meets in one task, by products of matrices
    in single precision with a bound on their error, and rows that may pass a bound are scored in full. A block is sent once for
    each other block, packed; the work is half the square of the rows.
    """
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    own = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    v = stage(vectors.where(good).select(F.col("vec_id").cast("long").alias("id"), own.alias("v")), "vectors")
    classes = stage(v.groupBy("v").agg(F.min("id").alias("c")), "classes")
    told = stage(_all_best(classes, classes.count(), k + 1, block), "neighbours")
    members = stage(v.join(classes, "v").select("id", "c"), "members")
    few = members.withColumn("_rn", F.row_number().over(Window.partitionBy("c").orderBy("id"))).where(F.col("_rn") <= k + 1)
    some = told.join(few.select(F.col("c").alias("o"), F.col("id").alias("vec_id")), "o").select("c", "vec_id", "score")
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "vec_id"))
    lists = some.withColumn("_rn", place).where(F.col("_rn") <= k + 1).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("_rn", "vec_id", "score"))).alias("x"))
    others = F.slice(F.filter("x", lambda y: y["vec_id"] != F.col("id")), 1, k)
    out = members.join(lists, "c").select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "y"))
    return out.select("query_id", (F.col("at") + 1).cast("long").alias("place"), "y.vec_id", "y.score")
