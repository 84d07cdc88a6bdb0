"""Queries on the topic graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions.storage import stage
from loamwork.operators import graph as G
from loamwork.operators.components import component_sizes, connected_components
from loamwork.operators.vectors import cosine_forest, cosine_links
from loamwork.plans.fixtures import oracle, table
from loamwork.plans.queries_activity import rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


N, E = (lambda s, d: table(s, d, "fx_nodes")), (lambda s, d: table(s, d, "fx_edges"))
AS_OF = 1706745600
ENDS = "ends AS (SELECT src AS id, dst AS other, relation, weight FROM {fx_edges} UNION ALL SELECT dst, src, relation, weight FROM {fx_edges})"
DEG = "deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"
TOP = "top AS (SELECT id, coalesce(name, regexp_replace(id, '^topic_', '')) AS topic, updated_at FROM {fx_nodes} WHERE type = 'topic')"
SEEDS = "seeds AS (SELECT 'topic_src3' AS seed UNION ALL SELECT 'topic_fr')"
CHUNKS = "c AS (SELECT topic, chunk_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 0.3 + (doc_id % 10) / 10.0 END AS confidence, length, doc_id % 3 = 0 AS has_points FROM {fx_chunks})"


def chunks(s, d):
    c = table(s, d, "fx_chunks")
    conf = F.when(F.col("doc_id") % 7 == 0, None).otherwise(0.3 + (F.col("doc_id") % 10) / 10.0)
    return c.select("topic", "chunk_id", conf.alias("confidence"), "length", (F.col("doc_id") % 3 == 0).alias("has_points"))


def seeds(s):
    return s.createDataFrame([("topic_src3",), ("topic_fr",)], "seed string")


@query("build_graph", f"WITH {CHUNKS} SELECT concat('topic_', topic) AS src, chunk_id AS dst, 'contains' AS relation, round(CAST(least(greatest(coalesce(confidence, 0.5) + CASE WHEN length > 2000 THEN 0.3 WHEN length > 1000 THEN 0.2 WHEN length > 500 THEN 0.1 ELSE 0 END + CASE WHEN has_points THEN 0.2 ELSE 0 END, 0.3), 1.5) AS DOUBLE), 6) AS weight, (SELECT count(DISTINCT topic) + count(DISTINCT chunk_id) FROM c) AS n_nodes FROM c")
def _(s, d):
    nodes, edges = G.build_graph(chunks(s, d))
    return rounded(edges.crossJoin(nodes.agg(F.count(F.lit(1)).alias("n_nodes"))))


REL = "r AS (SELECT CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE concat('e', doc_id // 2) END AS source, concat('e', doc_id // 3) AS target, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'uses' END AS type, concat('chunk_', doc_id) AS chunk_id, doc_id AS seq FROM documents)"


@query("add_relations", f"WITH {REL}, k AS (SELECT * FROM r WHERE trim(source) <> ''), a AS (SELECT source AS src, target AS dst, coalesce(type, 'related') AS relation, 0.8 AS weight, seq FROM k UNION ALL SELECT chunk_id, source, 'contains_entity', 1.0, seq FROM k UNION ALL SELECT chunk_id, target, 'contains_entity', 1.0, seq FROM k), z AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max((seq, relation, weight)) AS x FROM a GROUP BY 1, 2) SELECT src, dst, x[2] AS relation, CAST(x[3] AS DOUBLE) AS weight, (SELECT count(*) FROM (SELECT source FROM k UNION SELECT target FROM k)) AS n_new FROM z")
def _(s, d):
    i = F.col("doc_id")
    r = table(s, d, "documents").select(F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit("e"), F.floor(i / 2))).alias("source"), F.concat(F.lit("e"), F.floor(i / 3)).alias("target"), F.when(i % 4 == 0, None).otherwise("uses").alias("type"), F.concat(F.lit("chunk_"), i).alias("chunk_id"), i.alias("seq"))
    new, edges = G.add_relations(N(s, d), r)
    return edges.crossJoin(new.agg(F.count(F.lit(1)).alias("n_new")))


@query("merge_topic_points", "WITH p AS (SELECT source AS topic, (['point', 'insight', 'update'])[doc_id % 3 + 1] AS kind, text, doc_id AS seq FROM documents), t AS (SELECT concat('topic_', topic) AS id, 'topic' AS type, count(*) FILTER (kind = 'update') AS update_count, max(seq) AS updated_at FROM p GROUP BY topic), q AS (SELECT concat_ws('_', kind, md5(concat_ws('|', topic, text))) AS id, kind AS type, CAST(0 AS BIGINT) AS update_count, max(seq) AS updated_at FROM p GROUP BY 1, 2) SELECT * FROM t UNION ALL SELECT * FROM q")
def _(s, d):
    i = F.col("doc_id")
    p = table(s, d, "documents").select(F.col("source").alias("topic"), F.element_at(F.array(F.lit("point"), F.lit("insight"), F.lit("update")), (i % 3 + 1).cast("int")).alias("kind"), "text", i.alias("seq"))
    return G.merge_points(p)[0]


@query("reinforce_edges", "WITH u AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS usage_count, max(seq) AS last_used FROM (SELECT concat('topic_', source) AS a, concat('chunk_', doc_id) AS b, doc_id AS seq FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT concat('chunk_', doc_id), concat('topic_', source), doc_id + 5 FROM documents WHERE doc_id % 4 = 0) GROUP BY 1, 2) SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst, relation, round(CAST(least(2, coalesce(weight, 1) + 0.1 * coalesce(usage_count, 0)) AS DOUBLE), 6) AS weight, coalesce(usage_count, 0) AS usage_count, last_used FROM {fx_edges} e LEFT JOIN u ON u.src = least(e.src, e.dst) AND u.dst = greatest(e.src, e.dst)")
def _(s, d):
    t = table(s, d, "documents")
    a, b = F.concat(F.lit("topic_"), "source"), F.concat(F.lit("chunk_"), "doc_id")
    u = t.where("doc_id % 2 = 0").select(a.alias("src"), b.alias("dst"), F.col("doc_id").alias("seq")).unionByName(t.where("doc_id % 4 = 0").select(b.alias("src"), a.alias("dst"), (F.col("doc_id") + 5).alias("seq")))
    return rounded(G.reinforce_edges(E(s, d), u).withColumn("weight", F.col("weight").cast("double")))


SHARED = f"{ENDS}, {SEEDS}, sh AS (SELECT seed, b.other AS topic, count(DISTINCT a.other) AS shared, sum(coalesce(a.weight, 1) + coalesce(b.weight, 1)) AS weight FROM seeds JOIN ends a ON a.id = seed AND a.id <> a.other JOIN {{fx_nodes}} m ON m.id = a.other AND m.type IN ('chunk', 'entity', 'key_point') JOIN ends b ON b.id = m.id AND b.id <> b.other AND b.other <> seed JOIN {{fx_nodes}} t ON t.id = b.other AND t.type = 'topic' GROUP BY 1, 2)"
RANKED = "SELECT seed, place, topic, shared FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY shared DESC, topic) AS place FROM sh) WHERE place <= 3"


@query("related_topics_2hop", f"WITH {SHARED} {RANKED}")
def _(s, d):
    return G.related_topics(N(s, d), E(s, d), seeds(s)).select("seed", "place", "topic", "shared")


@query("related_by_shared_chunk", f"WITH {SHARED.replace(''', 'entity', 'key_point')''', ')')} SELECT seed, topic, shared FROM sh")
def _(s, d):
    return G.shared_neighbours(N(s, d), E(s, d), seeds(s), ("chunk",)).select("seed", "topic", "shared")


@query("related_by_weight", f"WITH {SHARED} SELECT seed, place, topic, round(CAST(weight AS DOUBLE), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(weight, 6) DESC, topic) AS place FROM sh) WHERE place <= 3")
def _(s, d):
    return rounded(G.related_by_weight(N(s, d), E(s, d).withColumn("weight", F.col("weight").cast("double")), seeds(s)))


@query("weak_topics_by_degree", f"WITH {ENDS}, {DEG}, {TOP}, x AS (SELECT id, topic FROM top UNION ALL SELECT concat('topic_', r_name), r_name FROM region) SELECT topic, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM x LEFT JOIN deg USING (id) WHERE coalesce(degree, 0) < 2 AND topic <> 'ASIA' ORDER BY degree, topic LIMIT 5")
def _(s, d):
    more = table(s, d, "region").select(F.concat(F.lit("topic_"), "r_name").alias("id"), F.lit("topic").alias("type"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("updated_at"))
    return G.weak_by_degree(N(s, d).unionByName(more), E(s, d), s.createDataFrame([("ASIA", 3)], "topic string, failed_attempts int"))


@query("weak_topics_by_weight", f"WITH {ENDS}, {TOP} SELECT topic, round(avg(CAST(coalesce(weight, 1) AS DOUBLE)), 6) AS mean_weight FROM ends JOIN top USING (id) WHERE relation = 'contains' GROUP BY topic HAVING avg(coalesce(weight, 1)) < 0.72 ORDER BY 2, topic LIMIT 5")
def _(s, d):
    return rounded(G.weak_by_weight(N(s, d), E(s, d).withColumn("weight", F.col("weight").cast("double")), 0.72))


@query("weakness_score", f"WITH {ENDS}, {DEG}, {TOP} SELECT topic, round(10 / (coalesce(degree, 0) + 1) + 0.1 * floor(({AS_OF} - coalesce(updated_at, 946684800)) / 86400), 6) AS score FROM top LEFT JOIN deg USING (id)")
def _(s, d):
    return rounded(G.weakness_score(N(s, d), E(s, d), AS_OF))


@query("old_topics", f"WITH {TOP} SELECT topic, days FROM (SELECT topic, CAST(floor(({AS_OF} - coalesce(updated_at, 946684800)) / 86400) AS BIGINT) AS days FROM top) WHERE days > 20")
def _(s, d):
    return G.old_topics(N(s, d), AS_OF, 20)


@query("graph_summary", "WITH n AS (SELECT count(*) AS nodes FROM {fx_nodes}), e AS (SELECT count(*) AS edges FROM {fx_edges}) SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1.0)), 9) AS density FROM n, e")
def _(s, d):
    return rounded(G.graph_summary(N(s, d), E(s, d)), 9)


@query("type_distributions", "SELECT 'node' AS kind, coalesce(type, 'unknown') AS value, count(*) AS n FROM {fx_nodes} GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM {fx_edges} GROUP BY 2")
def _(s, d):
    return G.type_distributions(N(s, d), E(s, d))


@query("degree_centrality", f"WITH {ENDS}, {DEG} SELECT id, round(degree / ((SELECT count(*) FROM {{fx_nodes}}) - 1), 9) AS centrality FROM deg ORDER BY degree DESC, id LIMIT 5")
def _(s, d):
    return rounded(G.degree_centrality(N(s, d), E(s, d)), 9)


SIM = "u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS n FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.n, b.n) > 0.3), f AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)"


def similar(s, d):
    """All pairs of embeddings with a cosine over 0.3."""
    return stage(cosine_links(table(s, d, "embeddings"), 0.3, strict=True).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "similar")


@query("connected_components", f"WITH RECURSIVE {SIM}, r AS (SELECT vec_id AS node, vec_id AS component FROM u UNION SELECT f.b, r.component FROM r JOIN f ON f.a = r.node), c AS (SELECT node, min(component) AS component FROM r GROUP BY node), z AS (SELECT component, count(*) AS size FROM c GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS place FROM z) SELECT node, component, size, CASE WHEN place <= 5 THEN place END AS place, (SELECT count(*) FROM z) AS n_components FROM c JOIN t USING (component)")
def _(s, d):
    alone = table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("a"), F.col("vec_id").cast("long").alias("b"))
    similar = stage(cosine_forest(table(s, d, "embeddings"), 0.3, strict=True), "similar")
    return component_sizes(stage(connected_components(similar.unionByName(alone)), "components"), 5)


@query("clustering_coefficient", f"WITH {SIM}, dg AS (SELECT a AS id, count(*) AS d FROM f GROUP BY a), t AS (SELECT x.a AS id, count(*) AS t FROM f x JOIN f y ON x.b = y.a JOIN f z ON y.b = z.a AND z.b = x.a GROUP BY 1), c AS (SELECT vec_id AS id, CASE WHEN d >= 2 THEN coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS coefficient FROM u LEFT JOIN dg ON dg.id = vec_id LEFT JOIN t ON t.id = vec_id) SELECT id, round(coefficient, 9) AS coefficient, round(avg(coefficient) OVER (), 9) AS average FROM c")
def _(s, d):
    e = similar(s, d).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    c = stage(G.clustering_coefficient(table(s, d, "embeddings").select(F.col("vec_id").alias("id")), e), "coefficients")
    return rounded(c.crossJoin(F.broadcast(c.agg(F.avg("coefficient").alias("average")))), 9)  # one row


@query("optimize_graph", "WITH k AS (SELECT src AS id FROM {fx_edges} UNION SELECT dst FROM {fx_edges}) SELECT (SELECT count(*) FROM {fx_nodes}) - (SELECT count(*) FROM {fx_nodes} WHERE id IN (SELECT id FROM k)) AS isolated, (SELECT count(*) FROM {fx_edges} WHERE src = dst) AS loops")
def _(s, d):
    n, e = N(s, d), E(s, d)
    a, b = G.optimize_graph(n, e)
    c = lambda x, y: x.agg(F.count(F.lit(1)).alias("p")).crossJoin(y.agg(F.count(F.lit(1)).alias("q"))).select((F.col("p") - F.col("q")).alias("x"))
    return c(n, a).withColumnRenamed("x", "isolated").crossJoin(c(e, b).withColumnRenamed("x", "loops"))


@query("search_nodes", "SELECT id, type FROM {fx_nodes} WHERE contains(lower(id), 'the') OR contains(lower(coalesce(name, '')), 'the') OR contains(lower(coalesce(content, '')), 'the') ORDER BY id LIMIT 20")
def _(s, d):
    return G.search_nodes(N(s, d), "The").select("id", "type")


@query("filter_edges", "SELECT src, dst, relation FROM {fx_edges} WHERE (src = 'topic_src4' OR dst = 'topic_src4') AND relation = 'contains' ORDER BY src, dst, relation LIMIT 30")
def _(s, d):
    return G.filter_edges(E(s, d), "topic_src4", "contains", 30).select("src", "dst", "relation")


@query("ego_subgraph", "WITH k AS (SELECT src AS id FROM {fx_edges} WHERE src = 'topic_src2' OR dst = 'topic_src2' UNION SELECT dst FROM {fx_edges} WHERE src = 'topic_src2' OR dst = 'topic_src2') SELECT src, dst, relation FROM {fx_edges} WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def _(s, d):
    return G.ego_subgraph(E(s, d), "topic_src2").select("src", "dst", "relation")


@query("list_topics", f"WITH {TOP} SELECT topic FROM top UNION SELECT key FROM {{fx_memory}}")
def _(s, d):
    return G.list_topics(N(s, d), table(s, d, "fx_memory"))


ATT = "f AS (SELECT source AS topic, count(*) AS failures FROM documents WHERE doc_id % 9 = 0 GROUP BY source)"


@query("failed_topics", f"WITH {ATT}, {TOP}, gone AS (SELECT id FROM top JOIN f USING (topic) WHERE failures >= 6) SELECT topic, failures, (SELECT count(*) FROM {{fx_nodes}} WHERE id NOT IN (SELECT id FROM gone)) AS nodes_left, (SELECT count(*) FROM {{fx_edges}} WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) AS edges_left FROM f")
def _(s, d):
    att = table(s, d, "documents").select(F.col("source").alias("topic"), (F.col("doc_id") % 9 != 0).alias("ok"))
    f, n, e = G.failed_topics(N(s, d), E(s, d), att, 6)
    return f.crossJoin(n.agg(F.count(F.lit(1)).alias("nodes_left"))).crossJoin(e.agg(F.count(F.lit(1)).alias("edges_left")))


@query("map_legacy_types", "SELECT event_type AS old, CASE event_type WHEN 'click' THEN 'chunk' WHEN 'view' THEN 'topic' ELSE 'concept' END AS new, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return G.map_types(table(s, d, "events"), "event_type", {"click": "chunk", "view": "topic"}, "concept")


@query("decayed_edge_weight", "SELECT p_partkey, round(CAST(least(greatest((confidence + CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 0 END - CASE WHEN p_partkey % 5 = 0 THEN 0.3 ELSE 0 END + least(0.5, (p_partkey % 9) * 0.1)) * greatest(0.5, 1 - (p_partkey % 80) * 0.01), 0.1), 2) AS DOUBLE), 6) AS weight FROM {fx_memory}")
def _(s, d):
    k = F.col("p_partkey")
    return rounded(table(s, d, "fx_memory").select("p_partkey", G.decayed_weight(F.col("confidence").cast("double"), k % 2 == 0, k % 5 == 0, k % 9, k % 80).alias("weight")))


SNAP = "SELECT o_orderkey AS id, concat('v', o_orderkey % 7) AS version, o_orderpriority AS payload FROM orders"


@query("latest_snapshot", f"SELECT * FROM ({SNAP}) ORDER BY id DESC LIMIT 1")
def _(s, d):
    return G.latest_snapshot(snapshots(s, d))


def snapshots(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("v"), F.col("o_orderkey") % 7).alias("version"), F.col("o_orderpriority").alias("payload"))


@query("list_snapshots", f"SELECT id, version, CAST(length(payload) AS INTEGER) AS payload_len FROM ({SNAP}) ORDER BY id DESC LIMIT 5")
def _(s, d):
    return G.list_snapshots(snapshots(s, d))


NODE_JSON = "json_object('id', id, 'type', coalesce(type, 'unknown'), 'attributes', json_object('name', name, 'content', content, 'updated_at', updated_at))"
EDGE_JSON = "json_object('source', src, 'target', dst, 'relation', coalesce(relation, 'unknown'), 'attributes', json_object('weight', CAST(weight AS DOUBLE)))"


@query("graph_export", f"WITH n AS (SELECT count(*) AS nodes FROM {{fx_nodes}}), e AS (SELECT count(*) AS edges FROM {{fx_edges}}) SELECT 'node' AS kind, CAST({NODE_JSON} AS VARCHAR) AS json FROM {{fx_nodes}} UNION ALL SELECT 'edge', CAST({EDGE_JSON} AS VARCHAR) FROM {{fx_edges}} UNION ALL SELECT 'stats', CAST(json_object('nodes', nodes, 'edges', edges, 'density', printf('%.9f', 2.0 * edges / (nodes * (nodes - 1.0)))) AS VARCHAR) FROM n, e")
def _(s, d):
    return G.graph_export(N(s, d), E(s, d).withColumn("weight", F.col("weight").cast("double")))
