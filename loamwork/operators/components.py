"""Connected components by hooking and contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.joins import MOST_ROWS
from loamwork.functions.storage import stage

#: Edges that one task may join: 16 bytes each, so 3 MB.
REST = 200_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links (i, j): the smallest node that each can reach.

    Each round hooks every root to its smallest neighbour, flattens the hooks and contracts the links, so a long path takes
    a few rounds too.
    """
    low = np.arange(n)
    while len(i):
        np.minimum.at(low, i, j)
        np.minimum.at(low, j, i)
        while (low[low] != low).any():
            low = low[low]
        i, j = low[i], low[j]
        apart = i != j
        i, j = i[apart], j[apart]
    return low


def _rest(e: DataFrame) -> DataFrame:
    """u, p: every node of e (a, b: whole numbers; REST rows at most) and the smallest node that it can reach."""

    def join(batches):
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if rows:
            a, b = (np.concatenate(x) for x in zip(*rows, strict=True))
            nodes, at = np.unique(np.r_[a, b], return_inverse=True)
            low = forest(len(nodes), at[: len(a)], at[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], ["u", "p"])

    kind = e.schema["a"].dataType.simpleString()
    return e.coalesce(1).mapInArrow(join, f"u {kind}, p {kind}")


def connected_components(edges: DataFrame, rest: int = REST) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b of one type): component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, flattens the hooks by pointer doubling, and contracts the
    edges; self-loops and repeats go, so at least half of the nodes go each round. Nothing is gathered on the driver, and
    every round is a written table; hooks are broadcast once there are few enough. Null ends are dropped. Once at most
    `rest` edges are left and nodes are whole numbers, one task joins them: a round is some ten jobs and four broadcasts,
    which fill the driver's memory where components are asked for again and again.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    loops = e.where("a = b").select(F.col("a").alias("node")).distinct()
    e = stage(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    whole = e.schema["a"].dataType.simpleString() in ("int", "bigint")
    hooks: list[DataFrame] = []
    while n := e.count():
        if whole and n <= rest:
            hooks.append(stage(_rest(e), "hooks"))
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        h = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "hooks")
        sent = F.broadcast if 2 * n <= MOST_ROWS else (lambda x: x)  # an edge has two nodes
        moved = True
        while moved:
            jump = h.join(sent(h.select(F.col("u").alias("p"), F.col("p").alias("pp"))), "p").select("u", "p", "pp")
            far = jump.join(sent(h.select(F.col("u").alias("pp"), F.col("p").alias("q"))), "pp").select("u", "p", "q")
            h2 = stage(far, "hooks")
            h, moved = h2.select("u", F.col("q").alias("p")), not h2.where("q < p").isEmpty()
        hooks.append(h)
        ha, hb = h.select(F.col("u").alias("a"), F.col("p").alias("pa")), h.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        left = e.join(sent(ha), "a").join(sent(hb), "b").where("pa <> pb")
        e = stage(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not hooks:
        return loops.select("node", F.col("node").alias("component"))
    out = hooks[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for h in hooks[1:]:
        out = out.join(h.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    alone = loops.join(out, "node", "left_anti").select("node", F.col("node").alias("component"))
    return out.unionByName(alone)


def component_sizes(components: DataFrame, n: int = 5) -> DataFrame:
    """node, component, size, place (of the n largest components, ties by the smaller; else null), n_components.

    components: node, component; a staged table, for it is read three times.
    """
    z = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = z.orderBy(F.desc("size"), "component").limit(n)  # n rows
    top = top.select("component", F.row_number().over(Window.orderBy(F.desc("size"), "component")).cast("long").alias("place"))
    total = z.agg(F.count(F.lit(1)).alias("n_components"))  # one row
    return components.join(z, "component").join(F.broadcast(top), "component", "left").crossJoin(F.broadcast(total)).select("node", "component", "size", "place", "n_components")
