"""Queries on the quality gate, facts and search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions.joins import sized_join
from loamwork.functions.storage import stage
from loamwork.operators import facts as A
from loamwork.operators import quality_gate as Q
from loamwork.operators import results as R
from loamwork.operators.ingest import chunk_paragraphs
from loamwork.operators.vectors import doubles
from loamwork.plans.fixtures import oracle, table
from loamwork.plans.queries_activity import rounded
from loamwork.plans.queries_vectors import bench, shared_index

QUERIES, SQL = {}, {}
PRIO, LOW, BLACK = ("ththre.example.com", "thth.example.net"), ("cheap-pills.example.com", "m."), ("ersh",)
ADS, STOP, ASK = ("worthless", "trash"), ("the", "of", "and", "la", "de"), ("the", "was")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


def has(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"coalesce(contains({text}, '{p}'), false)" for p in phrases) + ")"


HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> '')"
MATCH = lambda t: f"CASE WHEN contains(lower({t}), lower(query)) THEN 1.0 ELSE len(list_intersect(list_distinct({WORDS('lower(query)')}), {WORDS(f'lower({t})')})) / len(list_distinct({WORDS('lower(query)')})) END"


@query("score_relevance", f"SELECT page_id, query, round(CAST(0.4 * {MATCH('title')} + 0.3 * {MATCH('snippet')} + CASE WHEN {has(HOST, PRIO)} THEN 0.2 ELSE 0 END AS DOUBLE), 6) AS relevance FROM {{fx_search_results}}")
def _(s, d):
    from loamwork.functions.text import host

    r = table(s, d, "fx_search_results")
    return rounded(r.select("page_id", "query", Q.relevance(F.col("query"), F.col("title"), F.col("snippet"), host(F.col("url")), PRIO).alias("relevance")))


# a blank that ends a sentence is marked first, for the engine has no look-behind
SENT = lambda t: f"list_transform(regexp_split_to_array(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x))"
QUAL = f"""s0 AS (SELECT doc_id, text AS content, source AS title, {WORDS('text')} AS w, list_filter({SENT('text')}, lambda x: length(x) >= 20) AS ss FROM documents), s1 AS (SELECT *, len(ss) AS k, coalesce(list_sum(list_transform(ss, lambda x: len({WORDS('x').replace('lambda x: x', 'lambda y: y')}))), 0) / greatest(len(ss), 1) AS mean FROM s0),
 s2 AS (SELECT *, least(1, CASE WHEN length(content) >= 3000 THEN 1.0 WHEN length(content) >= 1500 THEN 0.9 WHEN length(content) >= 800 THEN 0.8 WHEN length(content) >= 400 THEN 0.6 WHEN length(content) >= 200 THEN 0.5 ELSE 0.3 END * 0.3::DOUBLE + CASE WHEN k >= 3 THEN least(k / 8, 1) ELSE k / 3 END * 0.2 + CASE WHEN len(w) > 0 THEN least(len(list_distinct(w)) / len(w) * 1.2, 1) ELSE 0 END * 0.15
 + CASE WHEN mean BETWEEN 10 AND 25 THEN 1 WHEN mean < 5 OR mean > 40 THEN 0.5 ELSE 1 - abs(mean - 17) / 35 END * 0.15 + greatest(0, 1 - 0.1 * (CAST(regexp_matches(lower(content), 'http\\S+') AS INT) + CAST(regexp_matches(lower(content), 'www\\.\\S+') AS INT) + CAST(regexp_matches(lower(content), '\\[\\d+\\]') AS INT) + CAST(contains(content, '↑') AS INT) + CAST(contains(lower(content), 'архивная копия') AS INT))) * 0.2
 + CASE WHEN length(title) > 5 THEN 1 WHEN length(title) > 0 THEN 0.6 ELSE 0.3 END * 0.1) AS quality FROM s1)"""


@query("score_quality", f"WITH {QUAL} SELECT doc_id, round(quality, 6) AS quality FROM s2")
def _(s, d):
    return rounded(Q.with_quality(table(s, d, "documents"), "text", "source").select("doc_id", "quality"))


UNI = "SELECT doc_id, concat('u', doc_id % 700) AS url, text AS content, doc_id AS seq FROM documents"


@query("score_uniqueness", f"SELECT doc_id, round(CAST(CASE WHEN rn > 1 THEN 0.3 ELSE 1.0 END * CASE WHEN length(content) < 500 THEN 0.7 ELSE 1.0 END * CASE WHEN rn > 1 THEN 0.9 ELSE 1.0 END AS DOUBLE), 6) AS uniqueness FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM ({UNI}))")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", F.concat(F.lit("u"), F.col("doc_id") % 700).alias("url"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return rounded(Q.uniqueness(t).select("doc_id", "uniqueness"))


LINKS = "(length(html) - length(replace(html, 'http', ''))) / 4 + (length(html) - length(replace(html, 'www.', ''))) / 4"
SPAM = f"CASE WHEN {has(HOST, BLACK)} THEN 0.2 ELSE 1.0 END * CASE WHEN {has(HOST, LOW)} THEN 0.3 ELSE 1.0 END * CASE WHEN contains(lower(html), 'worthless') THEN 0.7 ELSE 1.0 END * CASE WHEN contains(lower(html), 'trash') THEN 0.7 ELSE 1.0 END * CASE WHEN contains(lower(html), 'idiot') THEN 0.7 ELSE 1.0 END * CASE WHEN NOT contains(lower(html), 'the') THEN 0.5 ELSE 1.0 END * CASE WHEN {LINKS} > 5 THEN 0.8 ELSE 1.0 END"


@query("score_spam", f"SELECT page_id, round(CAST({SPAM} AS DOUBLE), 6) AS spam FROM pages")
def _(s, d):
    from loamwork.functions.text import host

    p = table(s, d, "pages")
    return rounded(p.select("page_id", Q.spam(host(F.col("url")), F.lit(""), F.col("html"), BLACK, LOW, ADS, ("idiot",), ("the",)).alias("spam")))


def judged(s, d):
    t = table(s, d, "documents").select("doc_id", F.concat(F.lit("u"), F.col("doc_id") % 700).alias("url"), F.col("text").alias("content"), F.col("source").alias("title"), F.col("doc_id").alias("seq"))
    rated = Q.with_quality(t, "content", "title").withColumn("quality", F.round("quality", 6))
    scored = Q.uniqueness(rated).withColumn("relevance", F.round((F.col("doc_id") % 100) / 100, 6)).withColumn("spam", F.round((F.col("doc_id") % 37) / 36, 6))
    return Q.verdict(scored)


J = f"{QUAL}, j AS (SELECT doc_id, round(quality, 6) AS quality, round((doc_id % 100) / 100, 6) AS relevance, round((doc_id % 37) / 36, 6) AS spam, CAST(CASE WHEN row_number() OVER (PARTITION BY doc_id % 700 ORDER BY doc_id) > 1 THEN 0.27 ELSE 1.0 END * CASE WHEN length(content) < 500 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS uniqueness FROM s2), k AS (SELECT *, list_filter([CASE WHEN relevance < 0.65 THEN printf('relevance: %.2f', relevance) END, CASE WHEN quality < 0.7 THEN printf('quality: %.2f', quality) END, CASE WHEN uniqueness < 0.6 THEN printf('uniqueness: %.2f', uniqueness) END, CASE WHEN spam < 0.5 THEN printf('spam: %.2f', spam) END], lambda x: x IS NOT NULL) AS reasons FROM j), v AS (SELECT *, len(reasons) = 0 AS approved FROM k)"


@query("committee_verdict", f"WITH {J} SELECT doc_id, approved, array_to_string(list_transform(reasons, lambda x: split_part(x, ':', 1)), '; ') AS reasons FROM v")
def _(s, d):
    return judged(s, d).select("doc_id", "approved", F.array_join(F.transform("reasons", lambda x: F.split(x, ":")[0]), "; ").alias("reasons"))


@query("committee_stats", f"WITH {J} SELECT count(*) AS evaluated, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected, round(count(*) FILTER (approved) / count(*), 6) AS approval_rate, round(avg((relevance + quality + uniqueness) / 3), 5) AS average_score FROM v")
def _(s, d):
    return rounded(rounded(Q.committee_stats(judged(s, d))).withColumn("average_score", F.round("average_score", 5)))


@query("rejection_top10", f"WITH {J} SELECT split_part(r, ':', 1) AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS r FROM v) GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def _(s, d):
    return Q.rejection_top(judged(s, d))


@query("approved_documents", f"WITH {J} SELECT doc_id, quality, relevance FROM v WHERE approved")
def _(s, d):
    return judged(s, d).where("approved").select("doc_id", "quality", "relevance")


FS = f"fs AS (SELECT seq AS doc_id, topic, source_url, generate_subscripts({SENT('text')}, 1) - 1 AS pos, unnest({SENT('text')}) AS sentence FROM {{fx_chunks}})"
W2 = WORDS("sentence")
inlist = lambda x, v: f"{x} IN (" + ", ".join(f"'{i}'" for i in v) + ")"
FC = f"""{FS}, fw AS (SELECT *, {W2} AS w FROM fs), fr AS (SELECT *, CASE WHEN NOT length(sentence) BETWEEN 40 AND 600 THEN 'length' WHEN contains(lower(sentence), 'idiot') THEN 'junk' WHEN {has('lower(sentence)', ADS)} THEN 'ad' WHEN regexp_matches(sentence, 'https?://|www\\.') THEN 'url'
 WHEN length(sentence) - length(replace(sentence, '!', '')) > 2 THEN 'shouting' WHEN len(w) >= 3 AND len(list_filter(w[2:], lambda x: substring(x, 1, 1) <> lower(substring(x, 1, 1)))) / greatest(len(w) - 1, 1) > 0.4 THEN 'capitals' WHEN len(list_filter(w, lambda x: {inlist('lower(x)', STOP)})) / greatest(len(w), 1) > 0.6 THEN 'stop_words'
 WHEN coalesce({inlist('lower(w[1])', ASK)}, false) AND length(sentence) < 100 THEN 'question' END AS why FROM fw), fc AS (SELECT doc_id, topic, source_url, pos, sentence FROM fr WHERE why IS NULL)"""
RULES = {"junk": ("idiot",), "ads": ADS, "stop": STOP, "asks": ASK}


def parts(s, d):
    """Chunks by their own number: in facts, doc_id is a chunk's."""
    return table(s, d, "fx_chunks").withColumn("doc_id", F.col("seq"))


@query("fact_candidates", f"WITH {FC} SELECT topic, coalesce(why, 'kept') AS why, count(*) AS n FROM fr GROUP BY 1, 2")
def _(s, d):
    f = A.fact_sentences(parts(s, d)).withColumn("why", F.coalesce(A.drop_reason(F.col("sentence"), **RULES), F.lit("kept")))
    return f.groupBy("topic", "why").agg(F.count(F.lit(1)).alias("n"))


SC = f"""sc AS (SELECT *, (CAST(contains(lower(sentence), 'tion') AS INT) + CAST(contains(lower(sentence), 'with') AS INT) + 0.5 + CASE WHEN length(sentence) BETWEEN 80 AND 250 THEN 0.5 WHEN length(sentence) BETWEEN 251 AND 400 THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(sentence, '(^|[^\\p{{L}}\\p{{N}}_])\\d+($|[^\\p{{L}}\\p{{N}}_])') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(sentence, '(^|[^\\p{{L}}\\p{{N}}_])\\d{{4}}($|[^\\p{{L}}\\p{{N}}_])') OR contains(lower(sentence), 'млн лет') THEN 0.5 ELSE 0 END
 + CASE WHEN regexp_matches(lower(sentence), '—| это | является |определяет') THEN 0.3 ELSE 0 END) * CASE WHEN topic IN ('src1', 'src2') THEN 1.2 WHEN topic = 'src5' THEN 0.5 ELSE 1.0 END AS total_score FROM fc)"""
HOSTS = {"priority": ("src1.example.org", "src2.example.org"), "low_trust": ("src5.example.org",)}


def scored(s, d):
    return A.score_facts(A.fact_candidates(parts(s, d), **RULES), ["tion", "with"], F.lit(0.5), **HOSTS)


@query("score_facts", f"WITH {FC}, {SC} SELECT doc_id, pos, round(CAST(total_score AS DOUBLE), 6) AS total_score FROM sc")
def _(s, d):
    return rounded(scored(s, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "total_score"))


@query("dedup_facts_prefix", f"WITH {FC} SELECT topic, count(*) AS n FROM (SELECT topic, row_number() OVER (PARTITION BY topic, substring(lower(sentence), 1, 100) ORDER BY doc_id, pos) AS rn FROM fc) WHERE rn = 1 GROUP BY 1")
def _(s, d):
    f = A.first_by_prefix(A.fact_candidates(parts(s, d), **RULES), "sentence", ["topic"], ["doc_id", "pos"], 100)
    return f.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


TOPF = "tf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(total_score, 6) DESC, doc_id, pos) AS place FROM sc) WHERE place <= 50)"


def top(s, d):
    return A.best_per(scored(s, d), "topic", [F.desc(F.round("total_score", 6)), F.col("doc_id"), F.col("pos")], 50)


@query("top_facts", f"WITH {FC}, {SC}, {TOPF} SELECT topic, place, doc_id, pos FROM tf")
def _(s, d):
    return top(s, d).select("topic", "place", "doc_id", F.col("pos").cast("long").alias("pos"))


PAT = {"factoid": "^the |^of ", "how_why": "tion", "evaluation": "la |de "}


@query("detect_profile", "SELECT CASE WHEN regexp_matches(lower(question), '^the |^of ') THEN 'factoid' WHEN regexp_matches(lower(question), 'tion') THEN 'how_why' WHEN regexp_matches(lower(question), 'la |de ') THEN 'evaluation' ELSE 'default' END AS profile, count(*) AS n FROM {fx_questions} GROUP BY 1")
def _(s, d):
    return table(s, d, "fx_questions").groupBy(A.profile_of(F.col("question"), PAT).alias("profile")).agg(F.count(F.lit(1)).alias("n"))


@query("domain_credit", f"SELECT page_id, CASE WHEN {has(HOST, PRIO)} THEN 1.0 WHEN {has(HOST, LOW)} THEN 0.3 ELSE 0.6 END::DOUBLE AS credit FROM pages")
def _(s, d):
    from loamwork.functions.text import host

    return table(s, d, "pages").select("page_id", A.domain_credit(host(F.col("url")), PRIO, LOW).alias("credit"))


@query("rank_facts", f"""WITH {FC}, {SC}, {TOPF}, p(p, a, b, c, n, l, x, o, st) AS (VALUES ('default', 0.35, 0.30, 0.10, 0.15, 0.05, 0.10, 120, 0.08), ('factoid', 0.30, 0.35, 0.05, 0.35, 0.0, 0.0, 100, 0.1), ('how_why', 0.30, 0.20, 0.10, 0.0, 0.0, 0.40, 150, 0.08), ('evaluation', 0.50, 0.25, 0.05, 0.10, 0.0, 0.10, 150, 0.08), ('mathematical_theorem', 0.35, 0.2, 0.0, 0.1, 0.0, 0.35, 150, 0.08), ('scientific_concept', 0.35, 0.2, 0.0, 0.1, 0.0, 0.35, 150, 0.08), ('quantum_physics_deep', 0.35, 0.2, 0.0, 0.1, 0.0, 0.35, 150, 0.08), ('philosophical_concept', 0.3, 0.2, 0.0, 0.1, 0.0, 0.4, 150, 0.08), ('biological_system', 0.3, 0.2, 0.0, 0.1, 0.0, 0.4, 150, 0.08), ('programming_concept', 0.4, 0.2, 0.0, 0.1, 0.0, 0.3, 120, 0.08), ('ai_concept', 0.35, 0.2, 0.0, 0.15, 0.0, 0.3, 120, 0.08), ('historical_event', 0.3, 0.2, 0.1, 0.35, 0.0, 0.05, 150, 0.08))
 SELECT doc_id, pos, round(CAST(a * least(total_score / 5, 1) + b * 0.6 + c * 0.5 + n * least((doc_id % 30) / 20, 1) + l / (1 + exp(-(length(sentence) - o) * st)) + x * (CASE WHEN regexp_matches(lower(sentence), '—| это | является |определяет') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(lower(sentence), 'потому что|так как|следовательно|поэтому|из-за|вследствие') THEN 0.2 ELSE 0 END) AS DOUBLE), 6) AS score FROM tf JOIN p ON p = (['default', 'factoid', 'how_why', 'evaluation', 'mathematical_theorem', 'scientific_concept', 'quantum_physics_deep', 'philosophical_concept', 'biological_system', 'programming_concept', 'ai_concept', 'historical_event', 'default'])[doc_id % 13 + 1]""")
def _(s, d):
    names = F.array(*map(F.lit, (*A.PROFILES, "unknown")))
    f = top(s, d).select("*", F.element_at(names, (F.col("doc_id") % 13 + 1).cast("int")).alias("profile"), F.least(F.col("total_score") / 5, F.lit(1.0)).alias("relevance"), F.lit(0.6).alias("credit"), F.lit(0.5).alias("position"), (F.col("doc_id") % 30).alias("ner"))
    return rounded(A.rank_facts(f).select("doc_id", F.col("pos").cast("long").alias("pos"), "score"))


@query("mmr_rerank")
def _(s, d):
    e = table(s, d, "embeddings")
    rows = e.select(F.col("label").alias("query_id"), "vec_id", ((F.col("vec_id") * 37 % 101) / 100).alias("score"), doubles("embedding").alias("v"))
    return A.mmr_rerank(A.best_per(rows, "query_id", [F.desc("score"), F.col("vec_id")], 50))


@query("dynamic_selection", f"WITH {FC}, {SC}, {TOPF}, m AS (SELECT topic, doc_id, pos, round(CAST(total_score AS DOUBLE), 6) AS score, place, max(round(total_score, 6)) OVER (PARTITION BY topic) AS best FROM tf) SELECT topic, doc_id, pos, score FROM m WHERE place <= 20 AND (score >= best * 0.6 OR place <= 2)")
def _(s, d):
    t = top(s, d).withColumn("score", F.round("total_score", 6)).withColumn("key", F.col("doc_id") * 1_000_000 + F.col("pos")).drop("place")
    return A.dynamic_selection(t, "topic", "key").select("topic", "doc_id", F.col("pos").cast("long").alias("pos"), "score")


def rated(s, d):
    c = table(s, d, "fx_chunks")
    return c.withColumn("quality", A.length_quality(F.col("length"))).withColumn("trust", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.6))


LQ = "CASE WHEN length >= 800 THEN 0.8 WHEN length >= 500 THEN 0.6 WHEN length >= 300 THEN 0.4 ELSE 0.2 END"


@query("answer_confidence", f"""WITH {FC}, {SC}, {TOPF}, c AS (SELECT topic, avg({LQ}) AS q, avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.6 END) AS t, count(DISTINCT source_url) AS n FROM {{fx_chunks}} GROUP BY 1), u AS (SELECT topic, w, count(*) AS k FROM (SELECT topic, unnest(regexp_extract_all(lower(sentence), '[a-z0-9_]{{4,}}')) AS w FROM tf WHERE place <= 10) GROUP BY 1, 2), o AS (SELECT topic, count(*) FILTER (k >= 3) AS often FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY k DESC, w) AS r FROM u) WHERE r <= 5 GROUP BY 1), f AS (SELECT topic, count(*) AS facts FROM tf GROUP BY 1),
 z AS (SELECT topic, n, q * 0.3 + t * 0.25 + least(n / 5, 1) * 0.2 + CASE WHEN coalesce(facts, 0) < 3 THEN 0.5 WHEN coalesce(often, 0) = 0 THEN 0.4 ELSE least(often / 3, 1) END * 0.15 AS x FROM c LEFT JOIN o USING (topic) LEFT JOIN f USING (topic)) SELECT topic, round(CAST(least(CASE WHEN n = 1 THEN x * 0.8 WHEN n = 0 THEN x * 0.5 ELSE x END, 1) AS DOUBLE), 6) AS confidence FROM z""")
def _(s, d):
    return rounded(A.answer_confidence(rated(s, d), top(s, d)))


@query("best_chunk", f"SELECT topic, x[2] AS chunk_id, CAST(-x[1] AS DOUBLE) AS quality FROM (SELECT topic, min((-{LQ}, chunk_id)) AS x FROM {{fx_chunks}} GROUP BY 1)")
def _(s, d):
    return A.best_chunk(rated(s, d))


@query("fact_pipeline")
def _(s, d):
    asked = bench(s, d)
    pairs = stage(shared_index(s, d).search(asked, 5, ("the", "and")).select("query_id", "doc_id"), "pairs")
    docs = sized_join(table(s, d, "documents"), stage(pairs.select("doc_id").distinct(), "asked-docs"), ["doc_id"], "left_semi")  # the others have no pair
    chunks = chunk_paragraphs(docs.select("doc_id", F.col("text").alias("content"))).withColumn("idx", F.col("idx").cast("long") * 100_000 + F.col("part"))
    url = docs.select("doc_id", F.concat(F.lit("http://"), "source", F.lit(".example.org/"), "doc_id").alias("source_url"))
    return A.answer_queries(asked, pairs, chunks.join(url, "doc_id"), unasked=("the", "and"), patterns=PAT, **RULES)


KIN = {"factual": ("the ", "of "), "how_to": ("tion",), "news": ("la ",)}
KW = f"list_filter(list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')), lambda x: length(x) > 2 AND NOT {inlist('x', STOP)})"


@query("analyze_queries", f"SELECT CASE WHEN {has('lower(question)', KIN['factual'])} THEN 'factual' WHEN {has('lower(question)', KIN['how_to'])} THEN 'how_to' WHEN {has('lower(question)', KIN['news'])} THEN 'news' ELSE 'general' END AS kind, 'en' AS language, CASE WHEN len({KW}) > 3 THEN 'high' WHEN len({KW}) > 1 THEN 'medium' ELSE 'low' END AS complexity, count(*) AS n, round(avg(len({KW})), 6) AS n_keywords FROM {{fx_questions}} GROUP BY 1, 2, 3")
def _(s, d):
    return rounded(R.analyze_queries(table(s, d, "fx_questions").withColumnRenamed("question", "query"), kinds=KIN, stop=STOP))


SW = {"alpha": 0.4, "beta": 0.3, "beta_api": 0.2, "alpha_html": 0.25, "fallback": 0.1}


@query("score_results", f"WITH s AS (SELECT query, url, round(CAST(greatest(least(relevance + CASE WHEN {has(HOST, PRIO)} THEN 0.2 ELSE 0 END + 0.05 * len(list_filter(list_distinct(regexp_extract_all(query, '[a-z]+')), lambda k: length(k) > 2 AND k NOT IN ('of') AND contains(lower(title), k))) + CASE source WHEN 'alpha' THEN 0.4 WHEN 'beta' THEN 0.3 WHEN 'beta_api' THEN 0.2 WHEN 'alpha_html' THEN 0.25 ELSE 0.1 END - CASE WHEN {has(HOST, BLACK)} THEN 0.5 ELSE 0 END, 1), 0) AS DOUBLE), 6) AS score FROM {{fx_search_results}}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, url) AS place FROM s) SELECT query, place, url, score FROM r WHERE place <= 10")
def _(s, d):
    return R.score_results(table(s, d, "fx_search_results"), 10, SW, PRIO, BLACK, ("of",))


@query("merge_sources", "WITH r AS (SELECT *, CASE source WHEN 'fallback' THEN 1 WHEN 'beta_api' THEN 2 ELSE 9 END AS at_ FROM {fx_search_results}) SELECT DISTINCT query, source, url FROM (SELECT *, min(at_) OVER (PARTITION BY query) AS best FROM r) WHERE at_ = best")
def _(s, d):
    return R.merge_sources(table(s, d, "fx_search_results"), ["fallback", "beta_api"])


@query("filter_results", f"SELECT page_id, query FROM {{fx_search_results}} WHERE NOT {has(HOST, ('m.',))} AND NOT {has(HOST, BLACK)}")
def _(s, d):
    return R.filter_results(table(s, d, "fx_search_results"), ("m.",), BLACK, ("wiki",)).select("page_id", "query")


def seqd(s, d):
    return table(s, d, "fx_search_results").withColumn("seq", F.col("page_id"))


@query("pick_urls", f"WITH g AS (SELECT query, url, page_id AS seq, {has(HOST, PRIO)} AS top FROM {{fx_search_results}} WHERE NOT {has(HOST, BLACK)}), a AS (SELECT *, row_number() OVER (PARTITION BY query, top ORDER BY seq) AS k FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY top DESC, k) AS place FROM a WHERE NOT top OR k <= 2) SELECT query, place, url FROM b WHERE place <= 3")
def _(s, d):
    return R.pick_urls(seqd(s, d), BLACK, PRIO)


@query("priority_first", f"SELECT query, place, url FROM (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY {has(HOST, PRIO)} DESC, page_id) AS place FROM {{fx_search_results}}) WHERE place <= 7")
def _(s, d):
    return R.priority_first(seqd(s, d), 7, PRIO)


@query("snippet_digest", "SELECT query, string_agg(concat(place, '. ', title, ': ', substring(snippet, 1, 50)), chr(10) ORDER BY place) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY page_id) AS place FROM {fx_search_results}) WHERE place <= 3 GROUP BY query")
def _(s, d):
    return R.snippet_digest(seqd(s, d), 3, 50)
