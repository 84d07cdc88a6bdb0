"""A weighted topic graph as two tables: nodes (id, type, name, content, updated_at) and undirected edges (src, dst, relation, weight)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.histograms import any_of
from loamwork.functions.joins import sized_join
from loamwork.functions.numbering import number_rows
from loamwork.functions.storage import stage


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with src <= dst."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


def ends(edges: DataFrame) -> DataFrame:
    """A row for each end of each edge: id, other, and the edge's columns. A self-loop has two."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    pair = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    return edges.select(pair.alias("x"), *rest).select("x.id", "x.other", *rest)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def topic_name(nodes: DataFrame) -> Column:
    return F.coalesce("name", F.regexp_replace("id", "^topic_", ""))


def topics(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'topic'").select("id", topic_name(nodes).alias("topic"), "updated_at")


def chunk_weight(confidence: Column, length: Column, has_points: Column) -> Column:
    bonus = F.when(length > 2000, 0.3).when(length > 1000, 0.2).when(length > 500, 0.1).otherwise(0.0)
    return F.least(F.greatest(F.coalesce(confidence, F.lit(0.5)) + bonus + F.when(has_points, 0.2).otherwise(0.0), F.lit(0.3)), F.lit(1.5))


def build_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chunks (topic, chunk_id, confidence, length, has_points): one node a topic, one a chunk."""
    t = chunks.select(F.concat(F.lit("topic_"), "topic").alias("id"), F.lit("topic").alias("type"), F.col("topic").alias("name")).distinct()
    c = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type"), F.lit(None).cast("string").alias("name")).distinct()
    w = chunk_weight(F.col("confidence"), F.col("length"), F.col("has_points"))
    return t.unionByName(c), chunks.select(F.concat(F.lit("topic_"), "topic").alias("src"), F.col("chunk_id").alias("dst"), F.lit("contains").alias("relation"), w.alias("weight"))


def add_relations(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new entity nodes, new edges) of relations (source, target, type, chunk_id, seq); blanks are skipped, the last write of a pair wins."""
    r = relations.where("trim(coalesce(source, '')) <> '' AND trim(coalesce(target, '')) <> ''")
    found = r.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    new = found.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("entity").alias("type"))
    own = r.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce("type", F.lit("related")).alias("relation"), F.lit(0.8).alias("weight"), "seq")
    held = r.select(F.col("chunk_id").alias("src"), F.explode(F.array("source", "target")).alias("dst"), F.lit("contains_entity").alias("relation"), F.lit(1.0).alias("weight"), "seq")
    every = canonical(own.unionByName(held))
    last = every.groupBy("src", "dst").agg(F.max(F.struct("seq", "relation", "weight")).alias("x"))
    return new, last.select("src", "dst", "x.relation", "x.weight")


def merge_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of points (topic, kind, text, seq): kinds point, insight and update; topics count their updates."""
    t = points.groupBy("topic").agg(F.count(F.when(F.col("kind") == "update", 1)).alias("update_count"), F.max("seq").alias("updated_at"))
    top = t.select(F.concat(F.lit("topic_"), "topic").alias("id"), F.lit("topic").alias("type"), "update_count", "updated_at")
    pid = F.concat_ws("_", "kind", F.md5(F.concat_ws("|", "topic", "text")))
    own = points.select(pid.alias("id"), F.col("kind").alias("type"), F.lit(0).cast("long").alias("update_count"), "seq").groupBy("id", "type", "update_count").agg(F.max("seq").alias("updated_at"))
    rel = F.when(F.col("kind") == "point", "has_point").when(F.col("kind") == "insight", "has_insight").otherwise("updated")
    edges = points.select(F.concat(F.lit("topic_"), "topic").alias("src"), pid.alias("dst"), rel.alias("relation")).distinct()
    return top.unionByName(own), edges


def reinforce_edges(edges: DataFrame, usage: DataFrame, step: float = 0.1, most: float = 2.0) -> DataFrame:
    """src, dst, relation, weight, usage_count, last_used after a usage log (src, dst, seq) in either direction."""
    uses = canonical(usage).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("usage_count"), F.max("seq").alias("last_used"))
    w = F.least(F.lit(most), F.coalesce("weight", F.lit(1.0)) + step * F.coalesce("usage_count", F.lit(0)))
    out = canonical(edges).join(uses, ["src", "dst"], "left")
    return out.select("src", "dst", "relation", w.alias("weight"), F.coalesce("usage_count", F.lit(0)).cast("long").alias("usage_count"), "last_used")


def shared_neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, via: tuple[str, ...]) -> DataFrame:
    """seed, topic, shared, weight: topics that share neighbours of the types `via` with a seed (ids in `seed`).

    Two equi-joins from the seeds' own neighbours; a seed's neighbours are read once.
    """
    kinds = nodes.select(F.col("id").alias("mid"), F.col("type").alias("mid_type"))
    e = ends(edges.select("src", "dst", "weight")).where("id <> other")
    first = sized_join(e, seeds.select(F.col("seed").alias("id")), ["id"]).select(F.col("id").alias("seed"), F.col("other").alias("mid"), F.col("weight").alias("w1"))
    mids = first.join(kinds.where(F.col("mid_type").isin(*via)), "mid")
    second = mids.join(e.select(F.col("id").alias("mid"), F.col("other").alias("topic"), F.col("weight").alias("w2")), "mid").where("topic <> seed")
    t = nodes.where("type = 'topic'").select(F.col("id").alias("topic"))
    weight = F.sum(F.coalesce("w1", F.lit(1.0)) + F.coalesce("w2", F.lit(1.0)))
    return second.join(t, "topic").groupBy("seed", "topic").agg(F.count_distinct("mid").alias("shared"), weight.alias("weight"))


def related_topics(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, n: int = 3, via: tuple[str, ...] = ("chunk", "entity", "key_point")) -> DataFrame:
    """seed, place, topic, shared: neighbouring topics and those two hops away; most shared neighbours first, then by id."""
    direct = sized_join(ends(edges.select("src", "dst")), seeds.select(F.col("seed").alias("id")), ["id"]).select(F.col("id").alias("seed"), F.col("other").alias("topic"))
    direct = direct.join(nodes.where("type = 'topic'").select(F.col("id").alias("topic")), "topic").where("topic <> seed").select("seed", "topic", F.lit(0).cast("long").alias("shared"))
    every = direct.unionByName(shared_neighbours(nodes, edges, seeds, via).select("seed", "topic", "shared")).groupBy("seed", "topic").agg(F.max("shared").alias("shared"))
    w = Window.partitionBy("seed").orderBy(F.desc("shared"), "topic")
    return every.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def related_by_weight(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, n: int = 3) -> DataFrame:
    """seed, place, topic, weight: topics that share a chunk, by the summed weight of the shared edges."""
    w = Window.partitionBy("seed").orderBy(F.desc(F.round("weight", 6)), "topic")
    return shared_neighbours(nodes, edges, seeds, ("chunk",)).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select("seed", "place", "topic", "weight")


def weak_by_degree(nodes: DataFrame, edges: DataFrame, failures: DataFrame, n: int = 5) -> DataFrame:
    """topic, degree: under two edges and three failures, fewest edges first."""
    t = topics(nodes).join(degrees(edges), "id", "left").join(failures, "topic", "left")
    d = F.coalesce("degree", F.lit(0)).cast("long")
    return t.where((d < 2) & (F.coalesce("failed_attempts", F.lit(0)) < 3)).select("topic", d.alias("degree")).orderBy("degree", "topic").limit(n)


def weak_by_weight(nodes: DataFrame, edges: DataFrame, limit: float = 0.7, n: int = 5) -> DataFrame:
    """topic, mean_weight of its `contains` edges (1 where missing) under limit, least first."""
    held = ends(edges.where("relation = 'contains'").select("src", "dst", "weight"))
    mean = held.join(topics(nodes), "id").groupBy("topic").agg(F.avg(F.coalesce("weight", F.lit(1.0))).alias("mean_weight"))
    return mean.where(F.col("mean_weight") < limit).orderBy(F.round("mean_weight", 6), "topic").limit(n)


DAY = 86_400
LONG_AGO = 946_684_800  # 2000-01-01


def weakness_score(nodes: DataFrame, edges: DataFrame, as_of: int) -> DataFrame:
    """topic, score = 10 / (degree + 1) + 0.1 for each full day since updated_at (epoch seconds; 2000-01-01 if null)."""
    t = topics(nodes).join(degrees(edges), "id", "left")
    days = F.floor((F.lit(as_of) - F.coalesce("updated_at", F.lit(LONG_AGO))) / DAY)
    return t.select("topic", (10 / (F.coalesce("degree", F.lit(0)) + 1) + 0.1 * days).alias("score"))


def old_topics(nodes: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """topic, days: not updated for more than `days` full days."""
    age = F.floor((F.lit(as_of) - F.coalesce("updated_at", F.lit(LONG_AGO))) / DAY).cast("long")
    return topics(nodes).select("topic", age.alias("days")).where(F.col("days") > days)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    density = F.when(F.col("nodes") < 2, 0.0).otherwise(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)))
    return n.crossJoin(e).select("nodes", "edges", density.alias("density"))  # one row each


def type_distributions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.lit("node").alias("kind"), F.coalesce("type", F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.coalesce("relation", F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def degree_centrality(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """id, centrality = degree / (N - 1): the n highest, ties by id."""
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    d = degrees(edges).crossJoin(F.broadcast(total))  # one row
    return d.select("id", (F.col("degree") / (F.col("total") - 1)).alias("centrality")).orderBy(F.desc("centrality"), "id").limit(n)


def _packed(one: np.ndarray, two: np.ndarray) -> list[bytes]:
    """Pairs of small numbers, sorted, as zipped differences of 250,000 pairs each."""
    order = np.lexsort((two, one))
    one, two = one[order].astype("<i4"), two[order].astype("<i4")
    return [zlib.compress(np.concatenate([np.diff(a, prepend=np.int32(0)), np.diff(b, prepend=np.int32(0))]).tobytes(), 1) for a, b in ((one[at : at + 250_000], two[at : at + 250_000]) for at in range(0, len(one), 250_000))]


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(zlib.decompress(b), "<i4").reshape(2, -1).cumsum(axis=1, dtype="<i4") for b in blobs]
    one, two = np.concatenate([np.zeros((2, 0), "<i4"), *parts], axis=1)
    order = np.lexsort((two, one))
    return one[order], two[order]


def _closed(uv: tuple, vw: tuple, uw: tuple, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """u, v, w of the triangles of three lists of edges, each sorted; about `most` paths u, v, w are looked at in a step."""
    top = int(max(uv[1].max(initial=-1), vw[0].max(initial=-1))) + 1
    start = np.searchsorted(vw[0], np.arange(top + 1))
    long = (start[1:] - start[:-1])[uv[1]]
    width = int(max(vw[1].max(initial=-1), uw[1].max(initial=-1))) + 1
    some = long > 0
    u, v, long = uv[0][some], uv[1][some], long[some]
    upto = np.cumsum(long)
    at = 0
    while at < len(u):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        n = long[at:end]
        edge = np.repeat(np.arange(at, end), n)
        first = np.cumsum(n) - n
        w = vw[1][np.arange(len(edge)) + np.repeat(start[v[at:end]] - first, n)]
        low, high = int(u[at]), int(u[end - 1]) + 1
        lo, hi = np.searchsorted(uw[0], [low, high])
        if (high - low) * width <= 1 << 26:
            mark = np.zeros((high - low) * width, bool)
            mark[(uw[0][lo:hi].astype(np.int64) - low) * width + uw[1][lo:hi]] = True
            hit = mark[(u[edge].astype(np.int64) - low) * width + w]
        else:
            keys, asked = uw[0][lo:hi].astype(np.int64) * width + uw[1][lo:hi], u[edge].astype(np.int64) * width + w
            place = np.searchsorted(keys, asked)
            hit = np.r_[keys, -1][place] == asked
        yield u[edge[hit]], v[edge[hit]], w[hit]
        at = end


def triangles(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """id, degree, t: neighbours and triangles of every node of edges (src, dst; each once, no loops; a staged table).

    Edges are directed from the end of lower degree to the higher, so no node sends out more than about the root of all
    edges. Nodes have one of p colours; a triangle u, v, w is found in the task of its three colours, which is sent the edges u-v,
    v-w and u-w of these colours, packed. So an edge is sent 3 p times, `most` edges of a kind to a task, and the paths u, v, w,
    of which there are far more, are neither shuffled nor kept.
    """
    d = stage(degrees(edges), "degrees")
    d = stage(number_rows(d, ["id"], "at"), "numbered")
    p = max(1, math.ceil(math.sqrt(edges.count() / most)))
    a = sized_join(edges, d.select(F.col("id").alias("src"), F.struct("degree", "at").alias("s")), ["src"])
    a = sized_join(a, d.select(F.col("id").alias("dst"), F.struct("degree", "at").alias("e")), ["dst"])
    o = a.select(F.least("s", "e")["at"].alias("u"), F.greatest("s", "e")["at"].alias("v"))
    o = o.select("u", "v", F.pmod("u", F.lit(p)).cast("int").alias("cu"), F.pmod("v", F.lit(p)).cast("int").alias("cv"))

    def pack(table: pa.Table) -> pa.Table:
        blobs = _packed(table["u"].to_numpy() // p, table["v"].to_numpy() // p)
        return pa.table({"cu": pa.array([table["cu"][0].as_py()] * len(blobs), pa.int32()), "cv": pa.array([table["cv"][0].as_py()] * len(blobs), pa.int32()), "edges": pa.array(blobs, pa.binary())})

    packed = stage(o.groupBy("cu", "cv").applyInArrow(pack, "cu int, cv int, edges binary"), "packed-edges")
    other = F.explode(F.sequence(F.lit(0), F.lit(p - 1)))
    ij = packed.select(F.col("cu").alias("i"), F.col("cv").alias("j"), other.alias("k"), F.lit(0).alias("kind"), "edges")
    jk = packed.select(other.alias("i"), F.col("cu").alias("j"), F.col("cv").alias("k"), F.lit(1).alias("kind"), "edges")
    ik = packed.select(F.col("cu").alias("i"), other.alias("j"), F.col("cv").alias("k"), F.lit(2).alias("kind"), "edges")

    def count(table: pa.Table) -> pa.Table:
        kind, blobs = table["kind"].to_numpy(), table["edges"].to_pylist()
        lists = [_unpacked([blobs[x] for x in np.flatnonzero(kind == r)]) for r in range(3)]
        size = int(max((x.max(initial=-1) for pair in lists for x in pair), default=-1)) + 1
        t = np.zeros((3, size), np.int64)
        for found in _closed(*lists):
            for r in range(3):
                t[r] += np.bincount(found[r], minlength=size)
        hits = [np.flatnonzero(x) for x in t]
        colours = [table[c][0].as_py() for c in ("i", "j", "k")]
        return pa.table({"at": np.concatenate([h * p + c for h, c in zip(hits, colours, strict=True)]), "t": np.concatenate([x[h] for x, h in zip(t, hits, strict=True)])})

    told = ij.unionByName(jk).unionByName(ik).repartition(p**3, "i", "j", "k").groupBy("i", "j", "k").applyInArrow(count, "at long, t long")
    return d.join(told.groupBy("at").agg(F.sum("t").alias("t")), "at", "left").select("id", "degree", F.coalesce("t", F.lit(0)).alias("t"))


def clustering_coefficient(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, coefficient = 2 T / (d (d - 1)) of every node (0 under degree 2; loops and repeats ignored). See triangles."""
    e = stage(canonical(edges.select("src", "dst")).where("src <> dst").distinct(), "edges")
    out = nodes.select("id").join(triangles(e), "id", "left")
    c = F.when(F.col("degree") >= 2, 2.0 * F.col("t") / (F.col("degree") * (F.col("degree") - 1.0))).otherwise(0.0)
    return out.select("id", c.alias("coefficient"))


def optimize_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with an edge, a self-loop included; edges that are no self-loops)."""
    return nodes.join(degrees(edges).select("id"), "id", "left_semi"), edges.where("src <> dst")


def search_nodes(nodes: DataFrame, text: str, n: int = 20) -> DataFrame:
    """The first n nodes by id whose id, name or content holds text, whatever the case."""
    hit = any_of([F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in ("id", "name", "content")])
    return nodes.where(hit).orderBy("id").limit(n)


def filter_edges(edges: DataFrame, topic: str | None = None, relation: str | None = None, n: int = 50) -> DataFrame:
    out = edges
    if topic:
        out = out.where((F.col("src") == topic) | (F.col("dst") == topic))
    if relation:
        out = out.where(F.col("relation") == relation)
    return out.orderBy("src", "dst", "relation").limit(n)


def ego_subgraph(edges: DataFrame, centre: str) -> DataFrame:
    """All edges among a node and its neighbours."""
    near = ends(edges.where((F.col("src") == centre) | (F.col("dst") == centre)).select("src", "dst")).select("id").distinct()
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")


def list_topics(nodes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    t = topics(nodes).select("topic")
    return (t if keys is None else t.unionByName(keys.select(F.col("key").alias("topic")))).distinct()


def failed_topics(nodes: DataFrame, edges: DataFrame, attempts: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failures by topic, nodes and edges left when topics of `limit` failures or more go). attempts: topic, ok."""
    f = attempts.where("NOT ok").groupBy("topic").agg(F.count(F.lit(1)).alias("failures"))
    gone = topics(nodes).join(f.where(F.col("failures") >= limit), "topic", "left_semi").select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return f, nodes.join(gone, "id", "left_anti"), left


def map_types(values: DataFrame, column: str, mapping: dict[str, str], default: str) -> DataFrame:
    """old, new, n: names under a mapping, `default` for unknown ones."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    new = F.coalesce(F.try_element_at(pairs, F.coalesce(column, F.lit(""))), F.lit(default))
    return values.groupBy(F.col(column).alias("old"), new.alias("new")).agg(F.count(F.lit(1)).alias("n"))


def decayed_weight(confidence: Column, priority: Column, low_trust: Column, usage: Column, days: Column) -> Column:
    base = confidence + F.when(priority, 0.2).otherwise(0.0) - F.when(low_trust, 0.3).otherwise(0.0) + F.least(F.lit(0.5), usage * 0.1)
    return F.least(F.greatest(base * F.greatest(F.lit(0.5), 1 - days * 0.01), F.lit(0.1)), F.lit(2.0))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The row of the greatest id, found as an aggregate."""
    return snapshots.agg(F.max(F.struct("id", *(c for c in snapshots.columns if c != "id"))).alias("x")).where("x IS NOT NULL").select("x.*")


def list_snapshots(snapshots: DataFrame, n: int = 5) -> DataFrame:
    return snapshots.select("id", "version", F.length("payload").alias("payload_len")).orderBy(F.desc("id")).limit(n)


def graph_export(nodes: DataFrame, edges: DataFrame, what: str = "all") -> DataFrame:
    """kind, json: nodes as {id, type, attributes}, edges as {source, target, relation, attributes}; for `all`, stats too.

    Attributes are the other columns, nulls included; a missing type or relation is unknown; density has nine places.
    """
    text = lambda **fields: F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"}).alias("json")
    other = lambda df, own: F.struct(*(c for c in df.columns if c not in own))
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    n = nodes.select(F.lit("node").alias("kind"), text(id=F.col("id"), type=unknown("type"), attributes=other(nodes, ("id", "type"))))
    e = edges.select(F.lit("edge").alias("kind"), text(source=F.col("src"), target=F.col("dst"), relation=unknown("relation"), attributes=other(edges, ("src", "dst", "relation"))))
    if what != "all":
        return n if what == "nodes" else e
    s = graph_summary(nodes, edges)
    return n.unionByName(e).unionByName(s.select(F.lit("stats").alias("kind"), text(nodes=F.col("nodes"), edges=F.col("edges"), density=F.format_string("%.9f", "density"))))
