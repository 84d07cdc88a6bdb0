"""Views over the given tables that stand in for an application's inputs: one text for Spark and for the checking SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CHUNK_COLUMNS = "SELECT doc_id, concat(source, '_', doc_id, '_', idx) AS chunk_id, source AS topic, concat('http://', source, '.example.org/', doc_id) AS source_url, trim(p) AS text, length(trim(p)) AS length, doc_id * 100000 + idx AS seq"

#: Pages as results of five queries, with the first 200 characters of their text. Fallback results come for one query only.
RESULT_COLUMNS = "SELECT page_id, q AS query, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, substring([snippet], 1, 200) AS snippet, CASE page_id % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'beta_api' WHEN 3 THEN 'alpha_html' ELSE 'fallback' END AS source, CASE page_id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 WHEN 2 THEN 0.6 WHEN 3 THEN 0.7 ELSE 0.6 END AS relevance FROM {pages} CROSS JOIN (SELECT 'the' AS q UNION ALL SELECT 'of the' UNION ALL SELECT 'tion and' UNION ALL SELECT 'la vie' UNION ALL SELECT 'der Stadt') AS qs WHERE page_id % 5 <> 4 OR q = 'the'"

#: {name} stands for a table or another view. Chunks are whole paragraphs (lines of over 10 characters), however long.
VIEWS = {
    "fx_messages": "SELECT conv_id, turn, role, text, concat('s', conv_id) AS session_id, 1704067200 + conv_id * 3600 + turn * 60 AS created_at FROM {conversations}",
    "fx_conversations": "SELECT conv_id AS id, concat('s', conv_id % 40) AS session_id, min(created_at) AS created_at, count(*) AS message_count FROM {fx_messages} GROUP BY conv_id",
    "fx_events": "SELECT event_id, user_id, event_type, value, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, ts FROM {events}",
    "fx_feedback": "SELECT event_id AS id, user_id AS conversation_id, event_id % 8 AS message_id, 1 + k % 5 AS rating, CASE WHEN event_type = 'purchase' THEN true WHEN event_type = 'error' THEN false END AS helpful, CASE WHEN event_type = 'click' THEN repeat(props, CAST(1 + k % 12 AS INT)) END AS comment, ts AS created_at FROM {fx_events}",
    "fx_feedback_raw": "SELECT event_id AS id, k % 8 AS rating, CASE WHEN event_type = 'click' THEN repeat(props, CAST(1 + k AS INT)) END AS comment FROM {fx_events}",
    "fx_requests": "SELECT event_id, event_type AS endpoint, value / 50 AS seconds, k % 3 = 0 AS from_cache, event_type = 'error' AS error, concat('e', k % 4) AS error_type, ts FROM {fx_events}",
    "fx_questions": "SELECT conv_id, turn, concat(text, CASE WHEN conv_id % 2 = 0 THEN '?' ELSE '' END) AS question FROM {conversations} WHERE role = 'user'",
    "fx_question_log": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('  Topic ', k % 20, ' ?') ELSE concat('topic  ', k % 20, ' ? ') END AS question, ts FROM {fx_events}",
    "fx_memory": "SELECT p_partkey, p_name AS key, p_type AS content, (p_size % 10) / 10.0 AS confidence, 1704067200 + p_partkey * 60 AS created_at FROM {part}",
    "fx_experiment_events": "SELECT event_id, user_id, event_type = 'purchase' AS converted, event_type = 'click' AS engaged, 1 + k % 5 AS rating, ts FROM {fx_events}",
    "fx_nodes": "SELECT concat('topic_', source) AS id, 'topic' AS type, source AS name, CAST(NULL AS VARCHAR(9)) AS content, 1704067200 + 86400 * CAST(substring(source, 4) AS BIGINT) AS updated_at FROM {documents} GROUP BY source UNION ALL SELECT concat('topic_', lang), 'topic', lang, NULL, NULL FROM {documents} GROUP BY lang UNION ALL SELECT concat('chunk_', doc_id), CASE WHEN doc_id % 50 = 3 THEN NULL ELSE 'chunk' END, NULL, text, NULL FROM {documents}",
    "fx_edges": "SELECT concat('topic_', source) AS src, concat('chunk_', doc_id) AS dst, 'contains' AS relation, CASE WHEN doc_id % 40 = 1 THEN NULL ELSE round(0.3 + (doc_id % 9) / 10.0, 2) END AS weight FROM {documents} WHERE doc_id % 25 <> 7 UNION ALL SELECT concat('topic_', lang), concat('chunk_', doc_id), 'mentions', 0.5 FROM {documents} WHERE doc_id % 3 = 0 AND doc_id % 25 <> 7 UNION ALL SELECT concat('chunk_', doc_id), concat('chunk_', doc_id), 'self', 1.0 FROM {documents} WHERE doc_id % 100 = 7",
    "fx_task_log": "SELECT event_id, event_type AS type, event_type <> 'error' AS success, value AS processing_time, ts FROM {events}",
    "fx_chunks": CHUNK_COLUMNS + " FROM (SELECT doc_id, source, generate_subscripts(ps, 1) - 1 AS idx, unnest(ps) AS p FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ps FROM {documents})) WHERE length(trim(p)) > 10",
    "fx_raw_files": "SELECT doc_id, translate(CASE doc_id % 9 WHEN 0 THEN concat('[«\"question\": \"What is ', source, '?\", \"answer\": \"A source of ', lang, '\"», \"plain ', doc_id, '\", [1, 2], ', doc_id, ']') WHEN 1 THEN concat('«\"id\": ', doc_id, ', \"text\": \"', source, '\"»') WHEN 2 THEN concat('«\"q\": \"why ', doc_id, '\", \"a\": \"so it is\"»', chr(10), chr(10), 'no json at all here', chr(10), '«\"q\": \"how\", \"a\": \"thus ', source, '\"»', chr(10), doc_id, chr(10), '«\"q\": \"x\", \"a\": \"y\"»') WHEN 3 THEN concat('name,lang,id', chr(10), source, ', ', lang, ',', doc_id, chr(10), chr(10), 'x,y,z') WHEN 4 THEN concat('name;id', chr(10), source, '; ', doc_id) WHEN 5 THEN concat('Question: what is ', source, '?', chr(10), 'Answer: it is a source', chr(10), 'Question: which language?', chr(10), 'Answer: ', lang) WHEN 6 THEN '' ELSE text END, '«»', concat(chr(123), chr(125))) AS content FROM {documents}",
    "fx_search_results": RESULT_COLUMNS.replace("[snippet]", r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"),
}

#: The views that Spark's dialect says otherwise.
SPARK_VIEWS = {
    "fx_search_results": RESULT_COLUMNS.replace("[snippet]", r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' '), '<[^>]+>', ' '), '[ \\t\\n\\r]+', ' '))"),
    "fx_chunks": CHUNK_COLUMNS + " FROM (SELECT doc_id, source, posexplode(split(text, '\n')) AS (idx, p) FROM {documents}) WHERE length(trim(p)) > 10",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SPARK_VIEWS.get(name, VIEWS[name])
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in _names(sql)})


def oracle(sql: str) -> str:
    """Checking SQL with the views that it names in braces as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    plain = lambda s: re.sub(r"\{([a-z]\w*)\}", r"\1", s)
    views = [f"{n} AS ({plain(VIEWS[n])})" for n in order]
    body = plain(sql)
    if not views:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(views)}, {body.lstrip()[14:]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {', '.join(views)}, {body.lstrip()[4:]}"
    return f"WITH {', '.join(views)} {body}"
