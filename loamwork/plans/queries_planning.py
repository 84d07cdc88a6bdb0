"""Queries on questions, planning and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.storage import new_path, small_files
from loamwork.operators import cleaning as T
from loamwork.operators import graph as G
from loamwork.operators import ingest as I
from loamwork.operators import planning as W
from loamwork.operators import questions as N
from loamwork.plans.fixtures import oracle, table
from loamwork.plans.queries_activity import LOG, QT, RULES, alert_sql, policy_log, rounded
from loamwork.plans.queries_corpus import CLEAN, JUNK, one_file_each
from loamwork.plans.queries_rules import SENT, WORDS, has
from loamwork.sources.tables import stream_corpus_files
from loamwork.streaming import jobs as X

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


TEMPLATE_ROWS = ", ".join(f"('{k}', '{t}')" for k in N.DEPTHS[2] for t in N.TEMPLATES[k]).replace("{topic}", "[t]").replace("{related}", "[r]")
MD5T = "md5(concat_ws(':', 'q', topic, replace(replace(template, '[t]', chr(123) || 'topic' || chr(125)), '[r]', chr(123) || 'related' || chr(125))))"


@query("research_questions", f"WITH t(kind, template) AS (VALUES {TEMPLATE_ROWS}), p AS (SELECT DISTINCT name AS topic FROM {{fx_nodes}} WHERE type = 'topic'), c AS (SELECT topic, kind, template, row_number() OVER (PARTITION BY topic, kind ORDER BY {MD5T}) AS r FROM p, t), rel AS (SELECT DISTINCT source AS topic, lang AS related FROM documents), o AS (SELECT c.topic, kind, r, replace(replace(template, '[t]', c.topic), '[r]', coalesce(related, 'similar concepts')) AS question FROM c LEFT JOIN rel ON rel.topic = c.topic WHERE r <= 2), ov AS (SELECT topic, kind, r, 0 AS v, question FROM o UNION ALL SELECT topic, kind, r, i, concat(x, topic) FROM o, (VALUES (1, 'Расскажи о '), (2, 'Информация о '), (3, 'Подробнее о ')) AS z(i, x) WHERE contains(question, 'What is')), f AS (SELECT topic, question, min((kind, r, v)) AS at_ FROM ov WHERE length(question) BETWEEN 10 AND 200 AND NOT contains(lower(question), 'better') GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY at_, question) AS place FROM f) SELECT topic, place, question FROM z WHERE place <= 6")
def _(s, d):
    topics = table(s, d, "fx_nodes").where("type = 'topic'").select(F.col("name").alias("topic"))
    rel = table(s, d, "documents").select(F.col("source").alias("topic"), F.col("lang").alias("related")).distinct()
    return N.research_questions(topics, rel, 2, 6, stop=("better",), varied=("What is",))


@query("clean_topics", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(concat(CASE turn % 3 WHEN 0 THEN 'What is ' WHEN 1 THEN 'why ' ELSE '' END, question)), '\\?+$', ''), '^(что такое |кто такой |кто такая |как |почему |зачем |what is |who is |how to |why )', '', 'i')) AS topic FROM {fx_questions}")
def _(s, d):
    q = table(s, d, "fx_questions")
    pre = F.when(F.col("turn") % 3 == 0, "What is ").when(F.col("turn") % 3 == 1, "why ").otherwise("")
    return q.select("conv_id", "turn", N.clean_topic(F.concat(pre, "question")).alias("topic"))


STRIP = "regexp_replace(raw, '^[.,!?;:()\\[\\]{}«»\"]+|[.,!?;:()\\[\\]{}«»\"]+$', '', 'g')"


@query("deepening_questions", f"WITH r AS (SELECT source AS topic, doc_id AS seq, text FROM documents), w AS (SELECT topic, seq, generate_subscripts({WORDS('text')}, 1) AS pos, unnest({WORDS('text')}) AS raw FROM r), c AS (SELECT *, {STRIP} AS c FROM w), g AS (SELECT topic, 0 AS k, seq, pos, c AS term FROM c WHERE length(c) >= 5 AND (substring(c, 1, 1) <> lower(substring(c, 1, 1)) OR length(c) >= 7) AND regexp_full_match(c, '\\p{{L}}+')), n AS (SELECT topic, count(*) AS n FROM g GROUP BY 1), m AS (SELECT w.topic, 1 AS k, seq, pos, raw AS term FROM w LEFT JOIN n USING (topic) WHERE coalesce(n, 0) < 3 AND length(raw) > 5 AND regexp_full_match(raw, '\\p{{L}}+')), f AS (SELECT topic, term, min((k, seq, pos)) AS at_ FROM (SELECT * FROM g UNION ALL SELECT * FROM m) GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY at_) AS place FROM f) SELECT topic, place, concat('Как работает ', term, '?') AS question FROM z WHERE place <= 5")
def _(s, d):
    r = table(s, d, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("seq"), "text")
    return N.deepening_questions(r, 1)


MARK = ((("with", "from"), "Why {}?"), (("tion",), "Which {}?"), (("the",), "Where {}?"), (("of",), "More {}?"))
TOPIC = "trim(regexp_replace(regexp_replace(trim(question), '\\?+$', ''), '^(что такое |кто такой |кто такая |как |почему |зачем |what is |who is |how to |why )', '', 'i'))"


@query("answer_followups", f"WITH p AS (SELECT conv_id * 100 + turn AS id, question, question AS answer FROM {{fx_questions}}) SELECT id, array_to_string(list_filter([CASE WHEN {has('answer', ('with', 'from'))} THEN concat('Why ', {TOPIC}, '?') END, CASE WHEN contains(answer, 'tion') THEN concat('Which ', {TOPIC}, '?') END, CASE WHEN contains(answer, 'the') THEN concat('Where ', {TOPIC}, '?') END, CASE WHEN contains(answer, 'of') THEN concat('More ', {TOPIC}, '?') END], lambda x: x IS NOT NULL)[1:3], ' | ') AS questions FROM p")
def _(s, d):
    q = table(s, d, "fx_questions").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "question", F.col("question").alias("answer"))
    return N.answer_followups(q, 3, MARK)


QW = WORDS("lower(question)")
TOP_OF = f"CASE WHEN len(af) > 0 THEN array_to_string(af[greatest(len(af) - 1, 1):], ' ') ELSE list_filter(w, lambda x: length(x) > 3 AND NOT regexp_matches(x, '[?!.]$'))[1] END"
QT_SQL = f"qw AS (SELECT conv_id * 100 + turn AS id, {QW} AS w FROM {{fx_questions}}), qa AS (SELECT id, w, list_filter(list_transform(w, lambda x, i: CASE WHEN i > 1 AND w[i - 1] IN ('the', 'of', 'la') AND length(x) > 2 THEN x END), lambda x: x IS NOT NULL) AS af FROM qw), qt AS (SELECT id, {TOP_OF} AS topic FROM qa)"
KEYS = ("the", "of", "la")


def asked(s, d) -> DataFrame:
    return table(s, d, "fx_questions").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "question")


@query("question_topics", f"WITH {QT_SQL}, ty AS (SELECT conv_id * 100 + turn AS id, CASE WHEN {has('lower(question)', ('tion',))} THEN 'how_to' WHEN {has('lower(question)', ('that', 'with'))} THEN 'comparison' WHEN contains(question, '?') THEN 'factual' ELSE 'general' END AS type FROM {{fx_questions}}) SELECT topic, count(*) AS n, count(*) FILTER (type = 'how_to') AS how_to, count(*) FILTER (type = 'comparison') AS comparison, count(*) FILTER (type = 'factual') AS factual, count(*) FILTER (type = 'general') AS general FROM qt JOIN ty USING (id) WHERE topic IS NOT NULL GROUP BY 1 ORDER BY n DESC, topic LIMIT 10")
def _(s, d):
    return N.question_topics(asked(s, d), KEYS, 10, ("tion",), ("that", "with"))


@query("followups", f"WITH {QT_SQL}, rel AS (SELECT topic, max(topic2) AS related FROM (SELECT a.topic, b.topic AS topic2 FROM (SELECT DISTINCT topic FROM qt) a JOIN (SELECT DISTINCT topic FROM qt) b ON substring(a.topic, 1, 3) = substring(b.topic, 1, 3) AND a.topic <> b.topic) GROUP BY 1), a AS (SELECT id, 0 AS k, topic AS o, concat('Tell more about ', topic) AS question FROM qt WHERE topic IS NOT NULL UNION ALL SELECT id, 1, related, concat('What is ', related, '?') FROM qt JOIN rel USING (topic) UNION ALL SELECT id, 2, '000', 'What else?' FROM qt UNION ALL SELECT id, 2, '001', 'Any examples?' FROM qt UNION ALL SELECT id, 2, '002', 'Why so?' FROM qt), f AS (SELECT id, question, min((k, o)) AS at_ FROM a GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_, question) AS place FROM f) SELECT id, place, question FROM z WHERE place <= 3")
def _(s, d):
    t = asked(s, d).select(N.topic_of(F.col("question"), KEYS).alias("topic")).where("topic IS NOT NULL")
    return N.followups(asked(s, d), N.last_alike(t, 3), KEYS, ("What else?", "Any examples?", "Why so?"))


@query("statement_questions", f"WITH a AS (SELECT conv_id * 100 + turn AS id, list_filter({SENT('text')}, lambda x: length(x) > 20 AND len({WORDS('x').replace('lambda x: x', 'lambda y: y')}) > 3)[1:2] AS s FROM conversations WHERE role = 'assistant') SELECT id, array_to_string(list_transform(s, lambda x: concat('Правда ли, что ', lower(regexp_replace(x, '[.!?]+$', '')), '?')), ' | ') AS questions FROM a WHERE len(s) > 0")
def _(s, d):
    a = table(s, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("answer"))
    return N.statement_questions(a)


@query("popular_questions", "SELECT trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS question, count(*) AS n FROM {fx_question_log} WHERE contains(lower(question), 'topic') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def _(s, d):
    return N.popular_questions(table(s, d, "fx_question_log"), "topic")


ENDS = "ends AS (SELECT src AS id, weight, relation FROM {fx_edges} UNION ALL SELECT dst, weight, relation FROM {fx_edges})"


@query("candidate_topics", f"WITH {ENDS}, top AS (SELECT id, name AS topic, updated_at FROM {{fx_nodes}} WHERE type = 'topic'), wk AS (SELECT topic, avg(coalesce(weight, 1)) AS m FROM ends JOIN top USING (id) WHERE relation = 'contains' GROUP BY 1 HAVING avg(coalesce(weight, 1)) < 0.72 ORDER BY round(m, 6), topic LIMIT 5), c AS (SELECT topic, 0.8 AS p FROM wk UNION ALL SELECT topic, 0.6 FROM top WHERE floor((1706745600 - coalesce(updated_at, 946684800)) / 86400) > 20 UNION ALL SELECT key, 0.5 FROM {{fx_memory}} WHERE confidence < 0.6) SELECT topic, CAST(max(p) AS DOUBLE) AS priority FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _(s, d):
    n, e = table(s, d, "fx_nodes"), table(s, d, "fx_edges").withColumn("weight", F.col("weight").cast("double"))
    unsure = table(s, d, "fx_memory").where("confidence < 0.6").select(F.col("key").alias("topic"))
    return W.candidate_topics(G.weak_by_weight(n, e, 0.72), G.old_topics(n, 1706745600, 20), unsure, 12)


@query("meta_analysis", "SELECT c AS chunks, n AS nodes, e AS edges, round(m, 6) AS confidence, concat_ws(',', CASE WHEN c < 100 THEN 'more_chunks' END, CASE WHEN e < n * 0.5 THEN 'more_links' END, CASE WHEN m < 0.4 THEN 'more_confidence' END) AS advice FROM (SELECT (SELECT count(*) FROM {fx_chunks}) AS c, (SELECT count(*) FROM {fx_nodes}) AS n, (SELECT count(*) FROM {fx_edges}) AS e, (SELECT avg(CAST(confidence AS DOUBLE)) FROM {fx_memory}) AS m)")
def _(s, d):
    m = table(s, d, "fx_memory").withColumn("confidence", F.col("confidence").cast("double"))
    return rounded(W.meta_analysis(table(s, d, "fx_chunks"), table(s, d, "fx_nodes"), table(s, d, "fx_edges"), m))


@query("cycle_stats", "SELECT type, count(*) AS executions, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, round(avg(processing_time), 6) AS mean_duration, max(event_id) AS last_run FROM {fx_task_log} GROUP BY type")
def _(s, d):
    return rounded(W.cycle_stats(table(s, d, "fx_task_log")))


@query("adaptive_priorities", "WITH x AS (SELECT event_type AS type, count(*) FILTER (k % 3 > 0) * ln(1.1) + count(*) FILTER (k % 3 = 0) * ln(0.9) AS x FROM {fx_events} GROUP BY 1), y AS (SELECT type, exp(x - max(x) OVER ()) AS p FROM x) SELECT type, round(p / sum(p) OVER (), 6) AS priority FROM y")
def _(s, d):
    t = table(s, d, "fx_events").select(F.col("event_type").alias("type"), (F.col("k") % 3 > 0).alias("success"))
    return rounded(W.adaptive_priorities(t))


@query("store_topic_knowledge", f"WITH f AS (SELECT source AS topic, doc_id AS place, text AS sentence FROM documents), c AS (SELECT DISTINCT source AS topic, (CAST(substring(source, 4) AS INT) % 10) / 10 AS confidence FROM documents), j AS (SELECT * FROM f JOIN c USING (topic)), o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY place) AS r FROM j), s AS (SELECT topic, confidence, substring(string_agg(sentence, ' ' ORDER BY place), 1, 300) AS text FROM o WHERE r <= 3 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY place) AS q FROM j WHERE length(sentence) > 50) SELECT 'memory' AS kind, topic, text FROM s WHERE confidence >= 0.5 UNION ALL SELECT 'graph', topic, text FROM s WHERE confidence >= 0.6 UNION ALL SELECT 'document', topic, sentence FROM k WHERE q <= 5")
def _(s, d):
    t = table(s, d, "documents")
    f = t.select(F.col("source").alias("topic"), F.col("doc_id").alias("place"), F.col("text").alias("sentence"))
    c = t.select(F.col("source").alias("topic"), ((F.substring("source", 4, 9).cast("int") % 10) / 10).alias("confidence")).distinct()
    return W.store_topic_knowledge(f, c)


@query("link_topics", "WITH t(topic) AS (VALUES ('the'), ('tion'), ('was'), ('la'), ('der'), ('con')), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS topic FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g') AS text FROM documents)), m AS (SELECT * FROM w JOIN t USING (topic)) SELECT a.topic AS a, b.topic AS b, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.topic < b.topic GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    topics = s.createDataFrame([(x,) for x in ("the", "tion", "was", "la", "der", "con")], "topic string")
    return W.link_topics(W.mentions(table(s, d, "documents"), topics, F.regexp_replace("text", r"[^\x00-\x7f]", " ")), 2)


def as_stream(df: DataFrame, order: str, batches: int = 4, per_batch: int = 4) -> DataFrame:
    """df as a stream in order of a column (null first): `batches` slices of it, each written by several tasks.

    Files are read in the order they were written, `per_batch` at a time; every slice is as many files.
    """
    s, path = df.sparkSession, new_path(df.sparkSession, "stream")
    at = F.col(order).cast("double") if dict(df.dtypes)[order] != "timestamp" else F.unix_micros(order).cast("double")
    rows = df.withColumn("_at", F.coalesce(at, F.lit(float("-inf"))))
    cuts = rows.where("_at > double('-inf')").approxQuantile("_at", [i / batches for i in range(1, batches)], 0.001) or [0.0]
    for a, b in zip([None, *cuts], [*cuts, float("inf")], strict=True):
        mine = rows.where((F.lit(True) if a is None else F.col("_at") > a) & (F.col("_at") <= b)).drop("_at")
        mine.repartition(per_batch, F.xxhash64(*(c for c in df.columns if dict(df.dtypes)[c] != "map"))).write.mode("append").parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def streamed(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream in order of time."""
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    return as_stream(e, "ts")


def drained(s: SparkSession, stream: DataFrame, mode: str, batch=None) -> DataFrame:
    """Run a stream over what is there and return the table of its output."""
    check, out = new_path(s, "stream-state"), new_path(s, "stream-out")
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", check).outputMode(mode)
    if batch is not None:
        w.foreachBatch(batch).start().awaitTermination()
        return None
    if mode == "append":
        w.format("parquet").option("path", out).start().awaitTermination()
        return s.read.schema(stream.schema).parquet(out)
    w.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")).start().awaitTermination()
    return s.read.option("basePath", out).parquet(out)


FINAL = "(SELECT max(ts) FROM events)"
WINDOWS = f"SELECT * FROM (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) / 300.0, 6) AS per_second, round(avg(value), 6) AS mean_value FROM events GROUP BY 1) WHERE start + 300 <= epoch({FINAL}) - 600"


def windows_sql(kind: str, by: str, width: int, start: str, source: str = "events") -> str:
    return f"SELECT '{kind}' AS kind, * FROM (SELECT {start} AS start, {by} AS type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) / {width}.0, 6) AS per_second, round(avg(value), 6) AS mean_value FROM {source} GROUP BY 1, 2) WHERE start + {width} <= epoch({FINAL}) - 600"


FIVE = "CAST(floor(epoch(ts) / 300) AS BIGINT) * 300"


@query("stream_metric_windows", " UNION ALL ".join((windows_sql("tumbling", "'all'", 300, FIVE), windows_sql("by_type", "event_type", 300, FIVE), windows_sql("sliding", "'all'", 600, f"{FIVE} - 300 * back", "events, (VALUES (0), (1)) AS z(back)"))))
def _(s, d):
    run = lambda kind, **how: drained(s, X.metric_windows(streamed(s, d), **how), "append").select(F.lit(kind).alias("kind"), "*")
    return rounded(run("tumbling").unionByName(run("by_type", by_type=True)).unionByName(run("sliding", minutes=10, slide=5)))


STREAM_CLEAN = CLEAN("text")
RETOLD = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(source, ' was told again in ', coalesce(lang, 'no language'), ' by ', doc_id, '.') ELSE text END AS text"


@query("stream_ingest", f"WITH c AS (SELECT doc_id, {STREAM_CLEAN} AS t FROM ({RETOLD} FROM documents)), w AS (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 900)) AS off FROM c WHERE length(t) > 0) SELECT concat(doc_id, '_', off) AS id, substring(t, CAST(off AS INT) + 1, 1000) AS text FROM w")
def _(s, d):
    target, docs = new_path(s, "stream-table"), table(s, d, "documents")

    def chunker(batch):
        last = batch.groupBy("doc_id").agg(F.max(F.struct("seq", "text", "source")).alias("x")).select("doc_id", "x.*")
        clean = T.clean_corpus(last, JUNK).select("doc_id", F.col("clean_text").alias("content"))
        made = I.chunk_fixed(clean).join(last.select("doc_id", "seq"), "doc_id")
        return made.select(F.col("doc_id").alias("doc"), F.concat_ws("_", "doc_id", "offset").alias("id"), "text", "seq")

    later = s.sql(RETOLD + ", source, doc_id + 1000000000 AS seq FROM {documents} WHERE doc_id % 5 = 0", documents=docs)  # a second version, of another length
    rows = docs.select("doc_id", "text", "source", F.col("doc_id").alias("seq")).unionByName(later)
    drained(s, as_stream(rows, "seq"), "append", X.ingest_batch(target, chunker))
    return X.stored(s, target).select("id", "text")


@query("stream_files")
def _(s, d):
    target, folder = new_path(s, "stream-table"), one_file_each(s, d)
    with small_files(s):
        drained(s, X.file_pieces(stream_corpus_files(s, folder)), "append", X.ingest_batch(target, X.file_chunks))
    return X.stored(s, target).groupBy("kind").agg(F.count_distinct("doc").alias("n_files"), F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("total_length"))


@query("stream_dedup")
def _(s, d):
    out = drained(s, X.first_seen(streamed(s, d).select("ts", "user_id", "event_type", "event_id"), ["user_id", "event_type"], "1 hour"), "append")
    return out.select("event_id", "user_id", "event_type")


@query("stream_sessions", f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS \"end\", count(*) AS n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {FINAL} - INTERVAL 1 HOUR")
def _(s, d):
    return drained(s, X.sessions(streamed(s, d)), "append")


@query("stream_q_update", f"WITH {LOG}, {QT} SELECT state, action, n, round(q, 6) AS q FROM q")
def _(s, d):
    target = new_path(s, "stream-values")
    drained(s, as_stream(policy_log(s, d).select("state", "action", "reward", "seq"), "seq"), "append", X.q_batch(target))
    return rounded(X.stored(s, target).select("state", "action", "n", "q"))


@query("stream_feedback_stats", f"SELECT 'rating' AS kind, CAST(rating AS BIGINT) AS slot, count(*) AS n, count(*) FILTER (helpful) AS helpful, round(avg(rating), 6) AS average FROM {{fx_feedback}} GROUP BY rating UNION ALL SELECT 'day', * FROM (SELECT CAST(floor(epoch(created_at) / 86400) AS BIGINT) * 86400 AS slot, count(*), count(*) FILTER (helpful), round(avg(rating), 6) FROM {{fx_feedback}} GROUP BY 1) WHERE slot + 86400 <= epoch({FINAL}) - 3600")
def _(s, d):
    f = table(s, d, "fx_feedback").select("id", "rating", "helpful", F.col("created_at").cast("timestamp").alias("created_at"))
    out = drained(s, X.feedback_totals(as_stream(f, "id")), "complete")
    last = out.groupBy("rating").agg(F.max(F.struct("batch", "n", "helpful")).alias("x"))
    totals = last.select(F.lit("rating").alias("kind"), F.col("rating").cast("long").alias("slot"), "x.n", "x.helpful", F.col("rating").cast("double").alias("average"))
    days = drained(s, X.feedback_windows(as_stream(f, "created_at")), "append")
    return rounded(totals.unionByName(days.select(F.lit("day").alias("kind"), F.col("start").alias("slot"), "n", "helpful", "average")))


@query("stream_rate_alerts", f"SELECT start, n, errors FROM ({WINDOWS}) WHERE errors > 0.004 * 300")
def _(s, d):
    w = X.metric_windows(streamed(s, d))
    return X.rate_alerts(drained(s, w, "append"), 0.004).select("start", "n", "errors")


PASSED = f"(bin + 1) * 300 <= epoch({FINAL}) - 600"
MOVES = " UNION ALL ".join(f"SELECT rule, endpoint, '{x}' AS state, {x} AS at FROM {alert_sql(r, until=PASSED)} WHERE {x} IS NOT NULL" for r in RULES for x in ("pending", "firing", "resolved"))


@query("stream_timed_alerts", MOVES)
def _(s, d):
    r = table(s, d, "fx_requests").select("event_id", "endpoint", "seconds", "error", F.col("ts").cast("timestamp").alias("ts"))
    with X.rocksdb_state(s):
        return drained(s, X.timed_alerts(as_stream(r, "ts"), list(RULES), 5, "endpoint"), "append")
