"""Queries on embeddings and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions.storage import new_path, stage
from loamwork.operators import vectors as V
from loamwork.operators.neighbours import knn_self
from loamwork.operators.postings import TermIndex
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


EMB = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
UNIT = f"{EMB}, u AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS n FROM v)"
Q = "q AS (SELECT vec_id AS query_id, e AS qv FROM v WHERE vec_id % 100 = 0)"
L2 = "round(1 / (1 + list_sum(list_transform(list_zip(e, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9)"
COS = "round(list_dot_product(e, qv) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qv, qv))), 9)"


def emb(s, d):
    return table(s, d, "embeddings")


def few(s, d):
    """The query set: every vector whose id is divisible by 100."""
    return emb(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), V.doubles("embedding").alias("qv"))


@query("embed_corpus")
def _(s, d):
    out = V.embed_corpus(table(s, d, "documents"), "doc_id", "text", V.hashed_words(16))
    return out.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 4).cast("string")), ",").alias("embedding"))


@query("normalize_vectors", f"WITH {UNIT} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(n[1], 6) AS first, round(list_sum(n), 6) AS total FROM u")
def _(s, d):
    n = V.normalize_vectors(emb(s, d))
    return rounded(n.select("vec_id", "norm", F.col("embedding")[0].alias("first"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("validate_embeddings", "SELECT CASE WHEN e IS NULL THEN 'missing' WHEN len(e) <> 64 THEN 'dimension' WHEN len(list_filter(e, lambda x: isnan(x))) > 0 THEN 'nan' WHEN len(list_filter(e, lambda x: abs(x) >= 1e-10)) = 0 THEN 'zero' ELSE 'ok' END AS reason, count(*) AS n FROM (SELECT CASE WHEN vec_id % 10 = 1 THEN NULL WHEN vec_id % 10 = 2 THEN embedding[1:32] WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: x * 0) WHEN vec_id % 10 = 4 THEN list_transform(embedding, lambda x: 'nan'::FLOAT) ELSE embedding END AS e FROM embeddings) GROUP BY 1")
def _(s, d):
    k, e = F.col("vec_id") % 10, F.col("embedding")
    bad = F.when(k == 1, None).when(k == 2, F.slice(e, 1, 32)).when(k == 3, F.transform(e, lambda x: (x * 0).cast("float"))).when(k == 4, F.transform(e, lambda x: F.lit(float("nan")).cast("float"))).otherwise(e)
    return V.validate_embeddings(emb(s, d).withColumn("embedding", bad), 64)


@query("pairwise_cosine", f"WITH {UNIT} SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.n, b.n), 6) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.n, b.n) >= 0.3")
def _(s, d):
    return rounded(V.pairwise_cosine(emb(s, d), "label", 0.3))


@query("topk_l2_score", f"WITH {EMB}, {Q}, r AS (SELECT query_id, vec_id, {L2} AS score FROM v, q), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM r) SELECT query_id, place, vec_id, score FROM p WHERE place <= 5 AND score >= 0.1")
def _(s, d):
    return V.topk(few(s, d), emb(s, d), 5, "l2", 0.1)


@query("filtered_search", f"WITH {EMB}, {Q}, r AS (SELECT query_id, vec_id, {L2} AS score FROM v, q WHERE label = 3), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM r) SELECT query_id, place, vec_id, score FROM p WHERE place <= 5 AND score >= 0.1")
def _(s, d):
    return V.topk(few(s, d), emb(s, d), 5, "l2", 0.1, F.col("label") == 3)


@query("topk_cosine_threshold", f"WITH {EMB}, {Q}, r AS (SELECT query_id, vec_id, {COS} AS score FROM v, q), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM r) SELECT query_id, place, vec_id, score FROM p WHERE place <= 10 AND score >= 0.25")
def _(s, d):
    return V.topk(few(s, d), emb(s, d), 10, "cosine", 0.25)


KQ = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark), qt AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}_]+')) AS w FROM q), t AS (SELECT query_id, w, count(*) OVER (PARTITION BY query_id) AS n FROM qt WHERE length(w) >= 3 AND w NOT IN ('the', 'and')), dt AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM documents), h AS (SELECT query_id, doc_id, count(DISTINCT w) / max(n) AS score FROM dt JOIN t USING (w) GROUP BY 1, 2), kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM h)"


def bench(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict[tuple[str, str], TermIndex] = {}


def shared_index(s, d) -> TermIndex:
    """The term index of the documents: built once in an application, read by every query on words."""
    at = (s.sparkContext.applicationId, d)
    if at not in _INDEXES:
        index = TermIndex(s, new_path(s, "term-index"))
        index.add(table(s, d, "documents").select("doc_id", "text"))
        _INDEXES[at] = index
    return _INDEXES[at]


@query("keyword_search", f"WITH {KQ} SELECT query_id, place, doc_id, round(score, 6) AS score FROM kw WHERE place <= 5")
def _(s, d):
    return rounded(shared_index(s, d).search(bench(s, d), 5, ("the", "and")))


@query("hybrid_search", f"WITH {KQ}, {EMB}, qv AS (SELECT item_id AS query_id, e AS qv FROM benchmark JOIN v ON vec_id = item_id), s AS (SELECT query_id, vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, vec_id) AS place FROM v, qv), b AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM s WHERE place <= 10 UNION ALL SELECT query_id, doc_id, score FROM kw WHERE place <= 5) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM b) SELECT query_id, place, id, round(score, 6) AS score FROM r WHERE place <= 5")
def _(s, d):
    q = emb(s, d).join(bench(s, d).select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), V.doubles("embedding").alias("qv"))
    sem = V.topk(q, emb(s, d), 10, "cosine", -1.0).select("query_id", F.col("vec_id").alias("id"), "score")
    key = shared_index(s, d).search(bench(s, d), 5, ("the", "and")).select("query_id", F.col("doc_id").alias("id"), "score")
    return rounded(V.hybrid(sem, key, 5))


@query("ann_search", f"WITH {EMB}, {Q}, r AS (SELECT query_id, vec_id, {COS} AS score FROM v, q), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM r) SELECT query_id, place, vec_id, score, CAST(1 AS DOUBLE) AS recall FROM p WHERE place <= 5")
def _(s, d):
    found = stage(V.ann_search(few(s, d), emb(s, d), 5, 64), "found")
    exact = V.topk(few(s, d), emb(s, d), 5, "cosine", -1.0)
    return found.select("query_id", "place", "vec_id", "score").join(V.recall(found, exact), "query_id")


@query("knn_self", f"WITH {UNIT}, p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.n, b.n), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.n, b.n), 9) DESC, b.vec_id) AS place FROM u a JOIN u b ON a.vec_id <> b.vec_id) SELECT query_id, place, vec_id, score FROM p WHERE place <= 3")
def _(s, d):
    return knn_self(emb(s, d), 3)


@query("reuse_embeddings", "WITH k AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 3 = 0), h AS (SELECT sha256(text) IN (SELECT key FROM k) AS hit FROM documents) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM h")
def _(s, d):
    t = table(s, d, "documents")
    return rounded(V.reuse_embeddings(t, t.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("key"))))


@query("collection_stats", "SELECT source, count(*) AS n, round(avg(length(text)), 6) AS average_length, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM documents GROUP BY source")
def _(s, d):
    return rounded(V.collection_stats(table(s, d, "documents")))


@query("semantic_dedup", f"WITH RECURSIVE {UNIT}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.n, b.n) > 0.3), o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS k FROM v), r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT o.k, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.b = o.id AND list_contains(r.kept, l.a)) THEN r.kept ELSE list_append(r.kept, o.id) END FROM r JOIN o ON o.k = r.k + 1) SELECT id, list_contains((SELECT arg_max(kept, k) FROM r), id) AS kept FROM o")
def _(s, d):
    return V.greedy_dedup(emb(s, d), 0.3, strict=True)


@query("related_terms", f"WITH {KQ}, w AS (SELECT query_id, place AS hit, unnest(list_slice(regexp_extract_all(lower(text), '[a-zа-я]{{4,}}'), 1, 10)) AS term, generate_subscripts(list_slice(regexp_extract_all(lower(text), '[a-zа-я]{{4,}}'), 1, 10), 1) AS pos FROM kw JOIN documents USING (doc_id) WHERE place <= 5), f AS (SELECT query_id, term, min((hit, pos)) AS x FROM w WHERE NOT contains('the thing', term) AND NOT regexp_matches(term, 'with|from') GROUP BY 1, 2), r AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY x) AS place FROM f) SELECT query_id, place, term FROM r WHERE place <= 5")
def _(s, d):
    hits = shared_index(s, d).search(bench(s, d), 5, ("the", "and"))
    return V.related_terms(hits, table(s, d, "documents"), "The thing", ("with", "from"))
