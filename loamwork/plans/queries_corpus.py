"""Queries on cleaning, pages, ingest, chunking and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions.storage import new_path
from loamwork.operators import cleaning as T
from loamwork.operators import facts as A
from loamwork.operators import ingest as I
from loamwork.plans.fixtures import oracle, table
from loamwork.plans.queries_activity import rounded
from loamwork.plans.queries_rules import HOST, LOW, PRIO, SENT, has
from loamwork.sources import tables as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


JUNK = ("trash", "worthless", "idiot")
DOCS = lambda s, d: table(s, d, "documents")
PAGES = lambda s, d: table(s, d, "pages")
RAW = lambda s, d: table(s, d, "fx_raw_files")
CONTENT = lambda s, d: DOCS(s, d).select("doc_id", F.col("text").alias("content"))
UNESC = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({UNESC(x)}, '<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', '', 'g'), '\\[[^\\]]+\\]', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), 'trash|worthless|idiot', '', 'gi'))"


@query("clean_corpus", f"SELECT doc_id, source, {CLEAN('text')} AS clean_text, CAST(length(text) - length({CLEAN('text')}) AS BIGINT) AS chars_removed FROM documents")
def _(s, d):
    return T.clean_corpus(DOCS(s, d), JUNK)


@query("explode_sentences", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM (SELECT doc_id, generate_subscripts({SENT('text')}, 1) - 1 AS pos, unnest({SENT('text')}) AS sentence FROM documents) WHERE length(sentence) >= 20")
def _(s, d):
    return T.explode_sentences(DOCS(s, d))


@query("normalize_nfkc")
def _(s, d):
    return T.normalize_nfkc(DOCS(s, d))


@query("remove_repetitions", f"WITH x AS (SELECT doc_id, list_filter({SENT('text')}, lambda x: length(x) >= 10) AS s FROM documents), u AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS t FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substring(lower(t), 1, 50) ORDER BY i) AS rn FROM u), g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS text, count(*) AS n_kept FROM k WHERE rn = 1 GROUP BY doc_id) SELECT x.doc_id, coalesce(g.text, '') AS text, coalesce(n_kept, 0) AS n_kept, len(s) - coalesce(n_kept, 0) AS n_dropped FROM x LEFT JOIN g USING (doc_id)")
def _(s, d):
    return T.remove_repetitions(DOCS(s, d))


BLOCK = f"trim(regexp_replace({UNESC('''regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')''')}, '\\s+', ' ', 'g'))"


@query("extract_main_content", f"SELECT page_id, 'article' AS container, {BLOCK} AS content FROM pages")
def _(s, d):
    return T.extract_main_content(PAGES(s, d))


LINE = "trim(regexp_replace(regexp_replace(line, '\\[\\[[^\\]]+\\]\\]|\\{\\{[^}]+\\}\\}|={2,}|\\[\\d+\\]', '', 'g'), '^[*#|]\\s*', ''))"


@query("strip_boilerplate_lines", f"WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, pos, {LINE} AS line FROM l), k AS (SELECT * FROM m WHERE length(line) > 40 AND NOT {has('line', ('Licensed', 'license'))}), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substring(lower(line), 1, 100) ORDER BY pos) AS rn FROM k), g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS content, count(*) AS kept FROM f WHERE rn = 1 GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) SELECT doc_id, coalesce(content, '') AS content, coalesce(kept, 0) AS kept, n - coalesce(kept, 0) AS dropped FROM n LEFT JOIN g USING (doc_id)")
def _(s, d):
    return T.strip_boilerplate_lines(DOCS(s, d), ("Licensed", "license"))


@query("detect_script_language", "SELECT lang, CASE WHEN regexp_matches(lower(text), '[а-яё]') THEN 'ru' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY 1, 2")
def _(s, d):
    return T.detect_script_language(DOCS(s, d))


TITLE = "substring(CASE WHEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) ELSE trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) END, 1, 200)"


@query("page_titles", f"SELECT page_id, {TITLE} AS title FROM pages")
def _(s, d):
    return T.page_titles(PAGES(s, d))


@query("domain_stats", f"SELECT domain, count(*) AS n_pages, CASE WHEN {has('domain', PRIO)} THEN 'high' WHEN {has('domain', LOW)} THEN 'low' ELSE 'medium' END AS trust FROM (SELECT {HOST} AS domain FROM pages) GROUP BY domain")
def _(s, d):
    return T.domain_stats(PAGES(s, d), PRIO, LOW)


@query("page_quality", f"WITH p AS (SELECT page_id, lower({TITLE}) AS t, length({BLOCK}) AS n FROM pages) SELECT page_id, round(CAST(least(CASE WHEN n >= 3000 THEN 0.4 WHEN n >= 1500 THEN 0.3 WHEN n >= 800 THEN 0.2 WHEN n >= 300 THEN 0.1 ELSE 0 END + CASE WHEN contains(t, 'of the') THEN 0.3 WHEN contains(t, 'of') OR contains(t, 'the') THEN 0.2 ELSE 0 END, 1) AS DOUBLE), 6) AS quality_score, n >= 800 AS accepted, CASE WHEN n < 800 THEN 'too_short' END AS reason FROM p")
def _(s, d):
    p = T.page_titles(PAGES(s, d)).join(T.extract_main_content(PAGES(s, d)).select("page_id", "content"), "page_id")
    return rounded(T.page_quality(p, "of the"))


FACT = "trim(regexp_replace(regexp_replace(regexp_replace(sentence, '\\(значения\\)|\\[[^\\]]*\\]|\\{\\{[^}]*\\}\\}', '', 'g'), '^(см\\.|также)\\s*', ''), '\\s+([.,;:!?])', '\\1', 'g'))"


@query("clean_facts", f"WITH s AS (SELECT doc_id, source AS topic, generate_subscripts({SENT('text')}, 1) - 1 AS pos, unnest({SENT('text')}) AS sentence FROM documents), c AS (SELECT doc_id, topic, pos, {FACT} AS fact FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY topic, regexp_replace(lower(fact), '[.,;:!?]+$', '') ORDER BY doc_id, pos) AS r FROM c WHERE length(fact) >= 30 AND NOT {has('lower(fact)', JUNK)} AND regexp_matches(fact, '[\\p{{L}}\\p{{N}}]')), p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id, pos) AS place FROM k WHERE r = 1) SELECT topic, place, fact FROM p WHERE place <= 15")
def _(s, d):
    f = DOCS(s, d).select("doc_id", F.col("source").alias("topic"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "fact"))
    return T.clean_facts(f, JUNK)


@query("fallback_sentences", f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq) AS c FROM {{fx_chunks}}), s AS (SELECT topic, c, generate_subscripts({SENT('text')}, 1) AS pos, unnest({SENT('text')}) AS sentence FROM c WHERE c <= 3), k AS (SELECT *, row_number() OVER (PARTITION BY topic, c ORDER BY pos) AS k FROM s WHERE length(sentence) > 30 AND length(sentence) < 500 AND NOT {has('lower(sentence)', ('http', '©', 'фото', 'купить'))}), p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c, pos) AS place FROM k WHERE k <= 3) SELECT topic, place, sentence FROM p WHERE place <= 10")
def _(s, d):
    return T.fallback_sentences(table(s, d, "fx_chunks"))


STRIP = "trim(content, ' ' || chr(9) || chr(10) || chr(13))"
LINES = f"string_split({STRIP}, chr(10))"
QA = "(regexp_matches(trim(content), '(?is)(Вопрос|Question|Q)\\s*:.*?(Ответ|Answer|A)\\s*:') OR regexp_matches(trim(content), '(?is)(В|Q)\\s*\\..*?(О|A)\\s*\\.\\s*\\S') OR regexp_matches(trim(content), '(?is)\\bFAQ\\b.*?\\?') OR regexp_matches(trim(content), '(?im)^\\s*\\d+[.)]\\s*[^\\n]*\\?\\s*$'))".replace("trim(content)", STRIP)
FORMAT = f"CASE WHEN content IS NULL OR trim(content) = '' THEN 'empty' WHEN trim(content) LIKE '[%]' AND json_valid(trim(content)) THEN 'json_array' WHEN trim(content) LIKE chr(123) || '%' || chr(125) AND json_valid(trim(content)) THEN 'json_object' WHEN len(list_filter({LINES}[1:20], lambda x: trim(x) LIKE chr(123) || '%' || chr(125) AND json_valid(x))) >= 2 THEN 'jsonl' WHEN len({LINES}) >= 2 AND regexp_matches({LINES}[1], '[,;]') AND regexp_matches({LINES}[1], '\\p{{L}}') THEN 'csv' WHEN {QA} THEN 'qa_text' ELSE 'text' END".replace("{{L}}", "{L}").replace("trim(content)", STRIP)


@query("detect_formats", f"SELECT doc_id, {FORMAT} AS format FROM {{fx_raw_files}}")
def _(s, d):
    return I.detect_formats(RAW(s, d))


def keyed(item: str, keys: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(CASE WHEN json_valid({item}) THEN {item} END, '$.{k}')" for k in keys) + ") IS NOT NULL"


T5 = "trim(substring(content, 1, 5000), ' ' || chr(9) || chr(10) || chr(13))"
ITEM = f"json_extract(CASE WHEN json_valid({T5}) THEN {T5} END, '$[0]')"
JL = f"len(list_filter(string_split({T5}, chr(10))[1:10], lambda x: trim(x) LIKE chr(123) || '%' || chr(125) AND json_valid(x) AND {keyed('x', I.QUESTION_KEYS)} AND {keyed('x', I.ANSWER_KEYS)})) >= 3"
MARKS = f"({has(f'lower({T5})', ('вопрос:', 'question:', 'q:', 'в:'))} AND {has(f'lower({T5})', ('ответ:', 'answer:', 'a:', 'о:'))})"
ROUTE = f"CASE WHEN coalesce(({T5} LIKE '[%' AND {keyed(ITEM, I.QUESTION_KEYS)} AND {keyed(ITEM, I.ANSWER_KEYS)}) OR {JL} OR {QA.replace(STRIP, T5)} OR {MARKS}, false) THEN 'qa' ELSE 'universal' END"


@query("route_processor", f"SELECT doc_id, {ROUTE} AS route FROM {{fx_raw_files}}")
def _(s, d):
    return I.route_processor(RAW(s, d))


@query("chunk_json_array", f"WITH f AS (SELECT doc_id, json(content) AS j FROM {{fx_raw_files}} WHERE {FORMAT} = 'json_array'), x AS (SELECT doc_id, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS idx, j FROM f), y AS (SELECT doc_id, idx, json_extract(j, '$[' || idx || ']') AS e FROM x) SELECT doc_id, CAST(idx AS INTEGER) AS idx, CASE WHEN json_type(e) = 'OBJECT' THEN CAST(json(e) AS VARCHAR) ELSE json_extract_string(e, '$') END AS text, CASE WHEN json_type(e) = 'OBJECT' THEN 'object' ELSE 'primitive' END AS json_type FROM y WHERE json_type(e) <> 'ARRAY'")
def _(s, d):
    c = I.chunk_json_array(RAW(s, d))
    # a variant orders keys by name; the checking SQL keeps the order of the text
    fixed = F.to_json(F.from_json("text", "question string, answer string"))
    return c.withColumn("text", F.when(F.col("json_type") == "object", fixed).otherwise(F.col("text")))


@query("chunk_jsonl", f"WITH l AS (SELECT doc_id, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS idx, trim(unnest(string_split(content, chr(10)))) AS line FROM {{fx_raw_files}} WHERE {FORMAT} = 'jsonl') SELECT doc_id, CAST(idx AS INTEGER) AS idx, line AS text, CASE WHEN json_valid(line) THEN CASE WHEN line LIKE chr(123) || '%' THEN 'jsonl' ELSE 'jsonl_primitive' END ELSE 'text_line' END AS json_type FROM l WHERE line <> '' AND (json_valid(line) OR length(line) > 10)")
def _(s, d):
    return I.chunk_jsonl(RAW(s, d))


@query("chunk_csv", f"WITH f AS (SELECT doc_id, {STRIP} AS c, CASE WHEN contains({LINES}[1], ',') THEN ',' WHEN contains({LINES}[1], ';') THEN ';' ELSE ',' END AS delimiter FROM {{fx_raw_files}} WHERE {FORMAT} = 'csv'), l AS (SELECT doc_id, delimiter, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS row_idx, unnest(string_split(c, chr(10))) AS line FROM f) SELECT doc_id, CAST(row_idx AS INTEGER) AS row_idx, concat('Строка ', row_idx + 1, ': ', array_to_string(list_transform(string_split(line, delimiter), lambda x: trim(x)), ', ')) AS text, delimiter FROM l WHERE trim(line) <> ''")
def _(s, d):
    return I.chunk_csv(RAW(s, d))


@query("extract_qa_pairs", f"WITH q AS (SELECT doc_id, string_split(content, 'Question: ') AS p FROM {{fx_raw_files}} WHERE {FORMAT} = 'qa_text'), u AS (SELECT doc_id, generate_subscripts(p, 1) - 2 AS idx, unnest(p) AS t FROM q) SELECT doc_id, CAST(idx AS INTEGER) AS idx, trim(split_part(t, chr(10) || 'Answer: ', 1)) AS question, trim(rtrim(split_part(t, 'Answer: ', 2), chr(10))) AS answer, concat('Вопрос: ', trim(split_part(t, chr(10) || 'Answer: ', 1)), chr(10), chr(10), 'Ответ: ', trim(rtrim(split_part(t, 'Answer: ', 2), chr(10)))) AS content FROM u WHERE idx >= 0 AND length(trim(split_part(t, 'Answer: ', 2))) > 3")
def _(s, d):
    found = I.extract_qa_pairs(RAW(s, d).join(I.detect_formats(RAW(s, d)).where("format = 'qa_text'"), "doc_id", "left_semi"))
    return found.withColumn("content", I.qa_text())


@query("qa_records", "WITH n AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), a AS (SELECT conv_id, turn, text AS question, CASE WHEN r2 = 'assistant' THEN t2 END AS answer FROM n WHERE role = 'user') SELECT conv_id, turn, CASE WHEN length(question) >= 5 AND length(answer) >= 5 THEN 'qa_pair' WHEN length(question) >= 5 THEN 'question_only' WHEN length(answer) >= 5 THEN 'answer_only' ELSE 'neither' END AS kind, question, answer FROM a")
def _(s, d):
    return I.qa_records(table(s, d, "conversations"))


WIN = lambda t, extra="": f"SELECT doc_id{extra}, off AS \"offset\", substring({t}, CAST(off AS INT) + 1, 1000) AS text FROM (SELECT doc_id{extra}, {t}, unnest(range(0, greatest(length({t}), 1), 900)) AS off FROM src)"


@query("chunk_fixed", f"WITH src AS (SELECT doc_id, text AS content FROM documents WHERE length(text) > 0), w AS ({WIN('content')}) SELECT doc_id, CAST(\"offset\" AS INTEGER) AS \"offset\", text FROM w")
def _(s, d):
    return I.chunk_fixed(CONTENT(s, d))


PARA = "src AS (SELECT doc_id, idx, trim(p) AS p FROM (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS idx, unnest(ps) AS p FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: length(trim(x)) > 20) END AS ps FROM documents)) WHERE length(trim(p)) > 10), pieces AS (SELECT doc_id, idx, 0 AS part, p AS text FROM src WHERE length(p) <= 1000 UNION ALL SELECT doc_id, idx, off // 900, substring(p, CAST(off AS INT) + 1, 1000) FROM (SELECT doc_id, idx, p, unnest(range(0, length(p), 900)) AS off FROM src WHERE length(p) > 1000)), par AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(part AS INTEGER) AS part, substring(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 5000) AS text FROM pieces)"


@query("chunk_paragraphs", f"WITH {PARA} SELECT doc_id, idx, part, text FROM par")
def _(s, d):
    return I.chunk_paragraphs(CONTENT(s, d))


@query("chunk_packed", """WITH RECURSIVE p0 AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, length(unnest(ps)) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents)),
 r AS (SELECT doc_id, CAST(1 AS BIGINT) AS i, k, CAST(0 AS BIGINT) AS c, CAST(k AS BIGINT) AS len, k >= 1050 AS alone FROM p0 WHERE i = 1 UNION ALL SELECT p0.doc_id, CAST(p0.i AS BIGINT), p0.k, CASE WHEN p0.k >= 1050 OR r.alone OR r.len + p0.k > 1500 THEN r.c + 1 ELSE r.c END, CAST(CASE WHEN p0.k >= 1050 OR r.alone OR r.len + p0.k > 1500 THEN p0.k ELSE r.len + p0.k END AS BIGINT), p0.k >= 1050 FROM r JOIN p0 ON p0.doc_id = r.doc_id AND p0.i = r.i + 1)
 SELECT doc_id, CAST(c AS INTEGER) AS chunk_idx, CAST(count(*) AS INTEGER) AS n_paragraphs, CAST(sum(k) AS INTEGER) AS length FROM r GROUP BY doc_id, c""")
def _(s, d):
    return I.chunk_packed(CONTENT(s, d))


@query("chunk_page_blocks", f"WITH c AS (SELECT page_id, url, {BLOCK} AS content FROM pages), b AS (SELECT page_id, url, list_filter(regexp_split_to_array(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 80)[1:8] AS s, length(content) AS n, content FROM c), x AS (SELECT page_id, url, CASE WHEN n > 100 THEN [content] ELSE s END AS t FROM b), u AS (SELECT page_id, url, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS t FROM x) SELECT concat(substring(md5(url), 1, 8), '_', i) AS chunk_id, page_id, CAST(least(length(t), 8000) AS INTEGER) AS length FROM u WHERE length(t) >= 50 AND regexp_matches(t, '\\p{{L}}')")
def _(s, d):
    p = T.extract_main_content(PAGES(s, d)).join(PAGES(s, d).select("page_id", "url"), "page_id")
    return I.chunk_page_blocks(p)


@query("chunk_quality_gate", f"WITH {PARA}, g AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total_chunks, CASE WHEN length(text) >= 800 THEN 0.8 WHEN length(text) >= 500 THEN 0.6 WHEN length(text) >= 300 THEN 0.4 ELSE 0.2 END::DOUBLE AS quality_score FROM par), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, part) AS chunk_index FROM g WHERE quality_score >= 0.5) SELECT doc_id, idx, part, chunk_index, total_chunks, quality_score FROM k WHERE chunk_index <= 50")
def _(s, d):
    c = I.chunk_paragraphs(CONTENT(s, d))
    return I.chunk_quality_gate(c).select("doc_id", "idx", "part", "chunk_index", "total_chunks", "quality_score")


@query("dedup_chunks_prefix", "SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY substring(text, 1, 200) ORDER BY seq) AS rn FROM {fx_chunks}) WHERE rn = 1")
def _(s, d):
    return A.first_by_prefix(table(s, d, "fx_chunks"), "text", [], ["seq"], 200, False).select("doc_id", "topic")


@query("fallback_chunks", f"WITH {PARA}, n AS (SELECT doc_id, count(*) AS n FROM par WHERE length(text) > 400 GROUP BY doc_id) SELECT doc_id, CASE WHEN n IS NULL AND length(text) > 10 THEN 1 ELSE coalesce(n, 0) END AS n_chunks, n IS NULL AND length(text) > 10 AS fallback FROM documents LEFT JOIN n USING (doc_id)")
def _(s, d):
    c = I.chunk_paragraphs(CONTENT(s, d)).where(F.length("text") > 400)
    return I.fallback_chunks(CONTENT(s, d), c)


@query("ingest_summary", f"WITH n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(range(0, length(content), 900)) FROM {{fx_raw_files}}) GROUP BY 1) SELECT {FORMAT} AS format, {ROUTE} AS route, count(*) AS n_files, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS total_length, min(coalesce(n, 0) > 0) AS success FROM {{fx_raw_files}} LEFT JOIN n USING (doc_id) GROUP BY 1, 2")
def _(s, d):
    return I.ingest_summary(RAW(s, d), I.chunk_fixed(RAW(s, d)))


def one_file_each(s, d) -> str:
    """A folder with a text file for each raw document that is not empty, and a line feed after it."""
    path, rows = new_path(s, "raw"), RAW(s, d).where("content <> ''")
    S.text_files(rows, "doc_id", "content", path)
    return path


@query("read_corpus_files", "SELECT CAST(strlen(content) + 1 AS BIGINT) AS size_bytes, CASE WHEN strlen(content) < 8192 THEN length(content) + 1 END AS length, CASE WHEN strlen(content) >= 8192 THEN 'too large' END AS problem FROM {fx_raw_files} WHERE content <> ''")
def _(s, d):
    found = S.read_corpus_files(s, one_file_each(s, d), most_bytes=8192)  # so that some are over the limit
    return found.select("size_bytes", F.length("content").cast("long").alias("length"), "problem")


@query("load_tables", "SELECT (SELECT count(*) FROM conversations) AS conversations, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM conversations c JOIN labels l ON l.doc_id = c.conv_id) AS joined")
def _(s, d):
    t = S.load_tables(s, d, ("conversations", "documents", "events", "labels"))
    n = lambda x, c: x.agg(F.count(F.lit(1)).alias(c))
    j = t["conversations"].join(t["labels"], F.col("doc_id") == F.col("conv_id"))
    return n(t["conversations"], "conversations").crossJoin(n(t["documents"], "documents")).crossJoin(n(t["events"], "events")).crossJoin(n(j, "joined"))


@query("knowledge_export", "SELECT doc_id, topic, CAST(length AS INTEGER) AS length, text FROM {fx_chunks}")
def _(s, d):
    path = new_path(s, "export")
    S.knowledge_export(table(s, d, "fx_chunks").select("doc_id", "topic", "length", "text"), path)
    return s.read.schema("doc_id long, topic string, length int, text string").json(path)


METRICS = "SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('# HELP m', event_id % 50) WHEN 2 THEN concat('m', event_id % 50, '   ', value, ' 17') WHEN 3 THEN concat(' m', event_id % 50, ' x', value) WHEN 4 THEN concat('m', event_id % 50, '_total ', event_id) ELSE concat('m', event_id % 50) END AS value FROM events"


@query("parse_metric_text", f"WITH r AS (SELECT seq, regexp_split_to_array(trim(value), '\\s+') AS w FROM ({METRICS}) WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')), k AS (SELECT seq, w[1] AS name, try_cast(w[2] AS DOUBLE) AS x FROM r) SELECT name, arg_max(x, seq) AS value FROM k WHERE x IS NOT NULL GROUP BY name")
def _(s, d):
    return S.parse_metric_text(s.sql(METRICS.replace("FROM events", "FROM {events}"), events=table(s, d, "events")))


@query("upsert_chunks", "WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN source ELSE concat('new ', lang) END AS text, lang, concat('v', doc_id % 3) AS kind, 'update' AS origin FROM documents WHERE doc_id % 4 = 0 AND doc_id % 10 <> 0) SELECT doc_id AS id, source AS text, lang, 'doc' AS kind, NULL AS origin FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 10 <> 0 UNION ALL SELECT * FROM a")
def _(s, d):
    t, i = DOCS(s, d), F.col("doc_id")
    meta = F.create_map(F.lit("kind"), F.concat(F.lit("v"), i % 3), F.lit("origin"), F.lit("update"))
    new = t.where("doc_id % 4 = 0").select(i.alias("id"), F.when(i % 8 != 0, F.concat(F.lit("new "), "lang")).alias("text"), meta.alias("metadata"), F.lit(2).alias("seq"))
    old = new.withColumn("text", F.lit("older")).withColumn("seq", F.lit(1))
    current = t.select(i.alias("id"), F.col("source").alias("text"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("kind"), F.lit("doc")).alias("metadata"))
    out = S.upsert_chunks(current, new.unionByName(old), t.where("doc_id % 10 = 0").select(i.alias("id")))
    return out.select("id", "text", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("lang", "kind", "origin")))


@query("recent_logs", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'ERROR' AS level, event_type AS logger, concat('m', event_id) AS message FROM events WHERE event_type = 'error' ORDER BY 1 DESC, 4 LIMIT 100")
def _(s, d):
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), level.alias("level"), F.col("event_type").alias("logger"), F.concat(F.lit("m"), "event_id").alias("message")))
    return S.recent_logs(table(s, d, "events").select(line.alias("value")))


@query("flatten_metadata", "SELECT event_id, CAST(k AS VARCHAR) AS k, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, concat('[', user_id, ',', event_id % 7, ']') AS pair FROM {fx_events}")
def _(s, d):
    e = table(s, d, "fx_events").select("event_id", "k", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"), F.array("user_id", F.col("event_id") % 7).alias("pair"))
    m = S.flatten_metadata(e, "event_id", ["k", "kind", "pair"])
    return m.select("event_id", *(F.try_element_at("metadata", F.lit(c)).alias(c) for c in ("k", "kind", "pair")))
