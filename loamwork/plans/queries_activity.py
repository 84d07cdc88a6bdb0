"""Queries on feedback, experiments, policies, metrics and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions.storage import stage
from loamwork.operators import experiments as E
from loamwork.operators import feedback as K
from loamwork.operators import metrics as P
from loamwork.operators import policy as L
from loamwork.operators import sessions as M
from loamwork.plans.fixtures import oracle, table

QUERIES, SQL = {}, {}
AB = ["A", "B", "C"]
AS_OF = "2024-01-30 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles to n places, as the checking SQL has them."""
    return df.select(*(F.round(c, n).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c) for c, t in ((c, t) for c, t in df.dtypes)))


@query("validate_feedback", "SELECT id, CASE WHEN NOT coalesce(rating BETWEEN 1 AND 5, false) THEN 'bad_rating' WHEN length(comment) > 1000 THEN 'long_comment' END AS reason FROM {fx_feedback_raw}")
def _(s, d):
    return K.validate_feedback(table(s, d, "fx_feedback_raw"))


@query("feedback_statistics", """SELECT count(*) AS total, round(avg(rating), 6) AS average_rating, count(*) FILTER (rating = 1) AS rating_1, count(*) FILTER (rating = 2) AS rating_2, count(*) FILTER (rating = 3) AS rating_3,
 count(*) FILTER (rating = 4) AS rating_4, count(*) FILTER (rating = 5) AS rating_5, count(*) FILTER (helpful) AS helpful, count(*) FILTER (NOT helpful) AS not_helpful, count(*) FILTER (helpful IS NULL) AS unknown,
 count(*) FILTER (created_at >= TIMESTAMP '2024-01-23 00:00:00') AS recent_total, round(avg(rating) FILTER (created_at >= TIMESTAMP '2024-01-23 00:00:00'), 6) AS recent_average FROM {fx_feedback}""")
def _(s, d):
    return rounded(K.feedback_statistics(table(s, d, "fx_feedback"), AS_OF))


@query("rating_distribution", "SELECT r AS rating, count(id) AS n, round(count(id) * 100.0 / (SELECT count(*) FROM {fx_feedback} WHERE rating BETWEEN 1 AND 5), 6) AS percent FROM range(1, 6) AS t(r) LEFT JOIN {fx_feedback} ON rating = r GROUP BY r")
def _(s, d):
    return rounded(K.rating_distribution(table(s, d, "fx_feedback")))


@query("helpful_distribution", "SELECT count(*) FILTER (helpful) AS helpful, count(*) FILTER (NOT helpful) AS not_helpful, count(*) FILTER (helpful IS NULL) AS unknown, round(count(*) FILTER (helpful) / count(helpful), 6) AS helpful_rate FROM {fx_feedback}")
def _(s, d):
    return rounded(K.helpful_distribution(table(s, d, "fx_feedback")))


def hist(src: str, value: str, bounds: list, by: str = "") -> str:
    one = [f"SELECT {by + ', ' if by else ''}'{b:g}' AS le, count(*) FILTER ({value} <= {b}) AS n, sum({value}) AS total FROM {src}{' GROUP BY ' + by if by else ''}" for b in bounds]
    every = f"SELECT {by + ', ' if by else ''}'+Inf' AS le, count({value}) AS n, sum({value}) AS total FROM {src}{' GROUP BY ' + by if by else ''}"
    return f"SELECT {by + ', ' if by else ''}le, n, round(CAST(total AS DOUBLE), 6) AS total FROM ({' UNION ALL '.join([*one, every])})"


@query("comment_length_histogram", hist("(SELECT * FROM {fx_feedback} WHERE comment IS NOT NULL)", "length(comment)", [10, 50, 100, 200, 500, 1000]))
def _(s, d):
    return rounded(K.comment_length_histogram(table(s, d, "fx_feedback")))


@query("conversation_feedback", "SELECT conversation_id, position, id, rating, total, total > 12 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS position, count(*) OVER (PARTITION BY conversation_id) AS total FROM {fx_feedback}) WHERE position BETWEEN 3 AND 12")
def _(s, d):
    return K.conversation_feedback(table(s, d, "fx_feedback"), 10, 2)


@query("feedback_lookup", "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(s, d):
    return K.feedback_lookup(table(s, d, "events"), "props", "$.k", "7").select("event_id", "event_type")


REWARD = "CASE WHEN helpful THEN 1.0 WHEN NOT helpful THEN -1.0 WHEN rating = 1 THEN -0.8 WHEN rating = 2 THEN -0.4 WHEN rating = 3 THEN 0.0 WHEN rating = 4 THEN 0.6 WHEN rating = 5 THEN 1.0 ELSE 0.0 END"


@query("feedback_rewards", f"SELECT rating, helpful, count(*) AS n, round(avg(CAST({REWARD} AS DOUBLE)), 6) AS mean_reward FROM {{fx_feedback}} GROUP BY rating, helpful")
def _(s, d):
    return rounded(K.feedback_rewards(table(s, d, "fx_feedback")))


def trend_sql(unit: str, form: str) -> str:
    return f"""(WITH d AS (SELECT strftime(created_at, '{form}') AS slot, count(*) AS n, avg(rating) AS average, count(*) FILTER (rating >= 4) AS good FROM {{fx_feedback}} GROUP BY 1),
 h AS (SELECT *, row_number() OVER (ORDER BY slot) > count(*) OVER () // 2 AS second FROM d)
 SELECT '{unit}' AS unit, slot, n, round(average, 6) AS average, round(good / n, 6) AS rate, CAST(sign((SELECT sum(good) / sum(n) FROM h WHERE second) - (SELECT sum(good) / sum(n) FROM h WHERE NOT second)) AS INTEGER) AS trend FROM h)"""


@query("satisfaction_trend", f"SELECT * FROM {trend_sql('day', '%Y-%m-%d')} UNION ALL SELECT * FROM {trend_sql('hour', '%Y-%m-%d %H')}")
def _(s, d):
    f = table(s, d, "fx_feedback")
    return rounded(K.satisfaction_trend(f).unionByName(K.satisfaction_trend(f, "hour")))


HEX = lambda x: f"CAST(concat('0x', substring(md5({x}), 1, 8)) AS BIGINT)"
VARIANT = lambda u, e: f"(['A', 'B', 'C'])[{HEX(f'''concat({u}, ':{e}')''')} % 3 + 1]"


@query("assign_variants", f"SELECT DISTINCT user_id, {VARIANT('user_id', 'template')} AS variant FROM events")
def _(s, d):
    return E.assign_variants(table(s, d, "events"), "template", AB)


@query("assign_weighted", f"SELECT event_id, CASE WHEN x <= 0.5 THEN 'A' WHEN x <= 0.8 THEN 'B' ELSE 'C' END AS variant FROM (SELECT event_id, {HEX('''concat('w:', event_id)''')} / 4294967296.0 AS x FROM events)")
def _(s, d):
    return E.assign_weighted(table(s, d, "events"), "event_id", {"A": 5, "B": 3, "C": 2})


@query("exposure_events", f"SELECT event_id, 'template' AS experiment, {VARIANT('user_id', 'template')} AS variant, CAST(user_id AS VARCHAR) AS user_id FROM events")
def _(s, d):
    return E.exposure_events(table(s, d, "events"), "template", AB)


@query("experiment_results", f"""WITH p AS (SELECT {VARIANT('user_id', 'template')} AS variant, count(*) AS n, avg(CAST(converted AS INT)) AS conversion, avg(rating) AS satisfaction, avg(CAST(engaged AS INT)) AS engagement FROM {{fx_experiment_events}} WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 21 DAY AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1),
 z AS (SELECT p.*, (p.conversion - a.conversion) / nullif(sqrt(((a.conversion * a.n + p.conversion * p.n) / (a.n + p.n)) * (1 - (a.conversion * a.n + p.conversion * p.n) / (a.n + p.n)) * (1 / a.n + 1 / p.n)), 0) AS z FROM p, (SELECT * FROM p WHERE variant = 'A') a)
 SELECT variant, n, round(conversion, 6) AS conversion, round(satisfaction, 6) AS satisfaction, round(engagement, 6) AS engagement, round(coalesce(z, 0), 6) AS z, abs(coalesce(z, 0)) > 1.96 AS significant, conversion = max(conversion) OVER () AS best FROM z""")
def _(s, d):
    return rounded(E.experiment_results(E.last_days(table(s, d, "fx_experiment_events"), "ts", "2024-01-31", 21), "template", AB))


def policy_log(s, d, days: int | None = None) -> DataFrame:
    f = table(s, d, "fx_feedback")
    f = f if days is None else E.last_days(f, "created_at", "2024-01-31", days)
    st = F.element_at(F.array(*map(F.lit, L.STATES)), (F.col("conversation_id") % 5 + 1).cast("int"))
    ac = F.element_at(F.array(*map(F.lit, L.ACTIONS)), (F.col("id") % 4 + 1).cast("int"))
    return f.select(F.col("id").alias("event_id"), st.alias("state"), ac.alias("action"), K.reward(F.col("helpful"), F.col("rating")).alias("reward"), F.col("id").alias("seq"))


LOG = f"log AS (SELECT id AS event_id, (['factual_known', 'factual_unknown', 'conversational_known', 'conversational_unknown', 'ambiguous'])[conversation_id % 5 + 1] AS state, (['high', 'medium', 'low', 'cautious'])[id % 4 + 1] AS action, CAST({REWARD} AS DOUBLE) AS reward, id AS seq FROM {{fx_feedback}})"
QT = "w AS (SELECT *, row_number() OVER (PARTITION BY state, action ORDER BY seq DESC) - 1 AS back FROM log), q AS (SELECT state, action, count(*) AS n, pow(0.9, count(*)) * CASE WHEN action = 'medium' THEN 0.5 ELSE 0.3 END + sum(pow(0.9, back) * 0.1 * reward) AS q FROM w GROUP BY state, action)"


@query("policy_states", "SELECT conv_id, turn, concat(CASE WHEN contains(question, '?') THEN 'factual' ELSE 'conversational' END, CASE WHEN turn % 2 = 0 THEN '_known' ELSE '_unknown' END) AS state FROM {fx_questions}")
def _(s, d):
    return table(s, d, "fx_questions").select("conv_id", "turn", L.state_of(F.col("question"), F.col("turn") % 2 == 0).alias("state"))


@query("policy_actions", f"WITH {LOG}, {QT}, b AS (SELECT state, arg_min(action, (-q, CASE action WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END)) AS best FROM q GROUP BY state), x AS (SELECT event_id, state, {HEX('''concat('e:', event_id)''')} / 4294967296.0 AS x, {HEX('''concat('e2:', event_id)''')} / 4294967296.0 AS y FROM log) SELECT event_id, state, x < 0.3 AS explored, CASE WHEN x < 0.3 THEN (['high', 'medium', 'low', 'cautious'])[CAST(floor(y * 4) AS INT) + 1] ELSE best END AS action FROM x JOIN b USING (state)")
def _(s, d):
    log = policy_log(s, d)
    return L.choose_actions(log.select("event_id", "state"), L.q_table(log))


@query("adjusted_confidence", "SELECT p_partkey, action, round(least(greatest(CASE WHEN known THEN base * (0.5 + 0.5 * score) ELSE base * 0.5 END, 0), 1), 6) AS confidence FROM (SELECT p_partkey, (['high', 'medium', 'low', 'cautious', 'other'])[p_partkey % 5 + 1] AS action, ([0.9, 0.7, 0.4, 0.2, 0.5])[p_partkey % 5 + 1]::DOUBLE AS base, CAST(confidence AS DOUBLE) AS score, p_partkey % 3 > 0 AS known FROM {fx_memory})")
def _(s, d):
    m = table(s, d, "fx_memory")
    a = F.element_at(F.array(*map(F.lit, (*L.ACTIONS, "other"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return rounded(m.select("p_partkey", a.alias("action"), L.adjusted_confidence(a, F.col("confidence").cast("double"), F.col("p_partkey") % 3 > 0).alias("confidence")))


@query("answer_band", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'greeting' WHEN confidence > 0.7 THEN 'sure' WHEN confidence > 0.4 THEN 'likely' ELSE 'unsure' END AS band, count(*) AS n FROM {fx_memory} GROUP BY 1")
def _(s, d):
    return table(s, d, "fx_memory").groupBy(L.answer_band(F.col("confidence"), F.col("p_partkey") % 3 > 0).alias("band")).agg(F.count(F.lit(1)).alias("n"))


RECENT = LOG[:-1] + " WHERE created_at > TIMESTAMP '2024-01-31' - INTERVAL 21 DAY AND created_at <= TIMESTAMP '2024-01-31')"


@query("train_q_table", f"WITH {RECENT}, {QT} SELECT state, action, n, round(q, 6) AS q FROM q")
def _(s, d):
    return rounded(L.q_table(policy_log(s, d, 21)))


@query("policy_report", f"WITH {LOG}, {QT} SELECT state, action, round(avg(reward), 6) AS mean_reward, round(avg(CAST(reward > 0 AS INT)), 6) AS success_rate, any_value(q.n) AS n, round(any_value(q), 6) AS q, round(any_value(q.n) / sum(any_value(q.n)) OVER (PARTITION BY state), 6) AS share FROM log JOIN q USING (state, action) GROUP BY state, action")
def _(s, d):
    return rounded(L.policy_report(policy_log(s, d)))


@query("system_stats", "SELECT count(*) AS questions, count(*) FILTER (error) AS errors, count(*) FILTER (from_cache) AS cache_hits, round(coalesce(avg(seconds), 0), 6) AS mean_seconds FROM {fx_requests}")
def _(s, d):
    return rounded(P.system_stats(table(s, d, "fx_requests")))


@query("latency_histogram", hist("{fx_requests}", "seconds", [0.1, 0.5, 1, 2, 5], "endpoint"))
def _(s, d):
    return rounded(P.latency_histogram(table(s, d, "fx_requests"), (0.1, 0.5, 1, 2, 5), ["endpoint"]))


@query("error_counts", "SELECT error_type, count(*) AS n FROM {fx_requests} WHERE error GROUP BY error_type")
def _(s, d):
    return P.error_counts(table(s, d, "fx_requests"))


@query("labelled_counters", "SELECT endpoint, from_cache, count(*) AS n, round(arg_max(seconds, (ts, event_id)), 6) AS last FROM {fx_requests} GROUP BY endpoint, from_cache")
def _(s, d):
    return rounded(P.labelled_counters(table(s, d, "fx_requests")))


@query("reward_histogram", hist(f"(SELECT CAST({REWARD} AS DOUBLE) AS reward FROM {{fx_feedback}})", "reward", [-1, -0.5, 0, 0.5, 1]))
def _(s, d):
    from loamwork.functions.histograms import cumulative_buckets

    return rounded(cumulative_buckets(table(s, d, "fx_feedback"), K.reward(F.col("helpful"), F.col("rating")), [-1, -0.5, 0, 0.5, 1]))


@query("query_duration_histogram", hist("(SELECT endpoint, seconds / 10 AS seconds FROM {fx_requests})", "seconds", [0.001, 0.005, 0.01, 0.05, 0.1, 0.5], "endpoint"))
def _(s, d):
    return rounded(P.latency_histogram(table(s, d, "fx_requests").withColumn("seconds", F.col("seconds") / 10), (0.001, 0.005, 0.01, 0.05, 0.1, 0.5), ["endpoint"]))


@query("windowed_rates", "SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS start, count(*) AS n, round(count(*) / 300.0, 6) AS per_second, round(avg(seconds), 6) AS mean_seconds, round(avg(CAST(from_cache AS INT)), 6) AS hit_ratio FROM {fx_requests} GROUP BY 1")
def _(s, d):
    return rounded(P.windowed_rates(table(s, d, "fx_requests")))


@query("moving_average", "SELECT event_type, event_id, value, CASE WHEN count(*) OVER w = 5 AND count(*) OVER (PARTITION BY event_type) > 5 THEN round(avg(value) OVER w, 6) END AS average FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return rounded(P.moving_average(table(s, d, "events"), "event_type", ["event_id"], "value"))


@query("task_ewma", "WITH w AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC, event_id DESC) - 1 AS back, count(*) OVER (PARTITION BY type) AS n FROM {fx_task_log}) SELECT type, count(*) FILTER (success) AS processed, count(*) FILTER (NOT success) AS failed, round(sum(pow(0.9, back) * CASE WHEN back = n - 1 THEN 1 ELSE 0.1 END * processing_time), 6) AS avg_time FROM w GROUP BY type")
def _(s, d):
    return rounded(P.task_ewma(table(s, d, "fx_task_log")))


@query("running_mean", "SELECT event_type, event_id, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id) AS running_mean FROM events")
def _(s, d):
    return P.running_mean(table(s, d, "events").withColumn("value", F.round(F.col("value") * 100).cast("long")), "event_type", ["event_id"], "value")


@query("hourly_profile", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(avg(seconds), 6) AS mean_seconds FROM {fx_requests} GROUP BY 1")
def _(s, d):
    return rounded(P.hourly_profile(table(s, d, "fx_requests")))


@query("value_histogram", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM events, e GROUP BY 1")
def _(s, d):
    return P.value_histogram(table(s, d, "events"), "value")


RULES = (P.AlertRule("errors", "errors", 0.0005, 60, 60), P.AlertRule("silent", "silent", 0, 60, 30), P.AlertRule("gauge", "gauge", 8.0, 60, 30))
HOLDS = {"errors": "coalesce(sum(errors) OVER s, 0) / {w} > {limit}", "silent": "coalesce(sum(n) OVER s, 0) = 0", "gauge": "coalesce(last_value(last IGNORE NULLS) OVER s > {limit}, false)"}


def alert_sql(rule: P.AlertRule, step: int = 5, until: str = "true") -> str:
    width, hold = step * 60, -(-rule.hold // step)
    holds = HOLDS[rule.kind].format(w=rule.window * 60, limit=rule.limit)
    return f"""(WITH c AS (SELECT endpoint, CAST(floor(epoch(ts) / {width}) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (error) AS errors, arg_max(seconds, (ts, event_id)) AS last FROM {{fx_requests}} GROUP BY 1, 2),
 k AS (SELECT * FROM c WHERE {until}), e AS (SELECT endpoint, min(bin) AS a, max(bin) AS b FROM k GROUP BY 1), g AS (SELECT endpoint, b, unnest(range(a, b + 1)) AS bin FROM e),
 h AS (SELECT g.endpoint, g.bin, b, {holds} AS holds FROM g LEFT JOIN k ON k.endpoint = g.endpoint AND k.bin = g.bin WINDOW s AS (PARTITION BY g.endpoint ORDER BY g.bin ROWS BETWEEN {rule.window // step - 1} PRECEDING AND CURRENT ROW)),
 r AS (SELECT *, bin - row_number() OVER (PARTITION BY endpoint ORDER BY bin) AS run FROM h WHERE holds), x AS (SELECT endpoint, b, min(bin) AS first, max(bin) AS last FROM r GROUP BY endpoint, b, run)
 SELECT '{rule.name}' AS rule, endpoint, (first + 1) * {width} AS pending, CASE WHEN first + {hold} <= last THEN (first + {hold} + 1) * {width} END AS firing, CASE WHEN last < b THEN (last + 2) * {width} END AS resolved FROM x)"""


@query("alert_intervals", " UNION ALL ".join(f"SELECT * FROM {alert_sql(r)}" for r in RULES))
def _(s, d):
    bins = stage(P.metric_bins(table(s, d, "fx_requests"), 5, ["endpoint"]), "bins")
    one, two, three = (P.alert_intervals(bins, r, 5, ["endpoint"]) for r in RULES)
    return one.unionByName(two).unionByName(three)


@query("topic_engagement", """WITH p AS (SELECT event_type AS topic, count(*) AS n, count(*) / count(DISTINCT user_id) AS engagement, avg(CAST(event_type = 'click' AS INT)) AS ctr FROM events GROUP BY 1 ORDER BY n DESC, topic LIMIT 3)
 SELECT topic, n, round(engagement, 6) AS engagement, round(ctr, 6) AS ctr, round(n / max(n) OVER (), 6) AS relative, CASE WHEN n / max(n) OVER () >= 0.9 THEN 'high' WHEN n / max(n) OVER () >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM p""")
def _(s, d):
    return rounded(P.topic_engagement(table(s, d, "events"), "event_type", 3))


@query("source_breakdown", "SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY source")
def _(s, d):
    return rounded(P.source_breakdown(table(s, d, "documents")))


LINE = "concat(CASE role WHEN 'user' THEN 'Пользователь' WHEN 'assistant' THEN 'Ассистент' WHEN 'system' THEN 'Система' ELSE role END, ': ', text)"
BACK = "row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, conv_id DESC, turn DESC)"
BYSESSION = "m AS (SELECT * REPLACE (concat('s', conv_id // 4) AS session_id) FROM {fx_messages})"
CTX = f"{BYSESSION}, b AS (SELECT *, {BACK} AS back, {LINE} AS line FROM m), c AS (SELECT *, sum(length(line)) OVER (PARTITION BY session_id ORDER BY back DESC) AS upto FROM b WHERE back <= 10), ctx AS (SELECT session_id, count(*) AS n, string_agg(line, chr(10) ORDER BY back DESC) AS context FROM c WHERE upto <= 2000 GROUP BY session_id)"


def by_session(s, d) -> DataFrame:
    return table(s, d, "fx_messages").withColumn("session_id", F.concat(F.lit("s"), F.floor(F.col("conv_id") / 4).cast("string")))


@query("session_history", f"WITH {BYSESSION} SELECT session_id, ordinal, message_count, role, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, conv_id, turn) AS ordinal, count(*) OVER (PARTITION BY session_id) AS message_count FROM m) WHERE ordinal > message_count - 50")
def _(s, d):
    return M.session_history(by_session(s, d))


@query("context_window", f"WITH {BYSESSION} SELECT session_id, back, role, conv_id, turn FROM (SELECT *, {BACK} AS back FROM m) WHERE back <= 4")
def _(s, d):
    return M.context_window(by_session(s, d), 10, 4).select("session_id", "back", "role", "conv_id", "turn")


@query("conversation_context", f"WITH {CTX} SELECT session_id, n, context FROM ctx")
def _(s, d):
    return M.conversation_context(by_session(s, d))


@query("enriched_questions", f"WITH {CTX} SELECT session_id, conv_id, turn, CASE WHEN length(coalesce(context, '')) >= 20 THEN concat('Контекст:', chr(10), right(context, 2000), chr(10), chr(10), 'Вопрос: ', question) ELSE question END AS prompt FROM (SELECT *, concat('s', conv_id // 4) AS session_id FROM {{fx_questions}}) LEFT JOIN ctx USING (session_id)")
def _(s, d):
    q = table(s, d, "fx_questions").withColumn("session_id", F.concat(F.lit("s"), F.floor(F.col("conv_id") / 4).cast("string")))
    return M.enriched_questions(q, M.conversation_context(by_session(s, d)))


@query("analyze_questions", "SELECT CASE WHEN contains(question, '?') THEN 'factual' ELSE 'conversational' END AS kind, CASE WHEN regexp_matches(question, '[а-яё]') THEN 'ru' ELSE 'en' END AS language, len(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) > 3 AS requires_knowledge, contains(question, '...') AS has_context, count(*) AS n, round(avg(length(question)), 6) AS mean_length FROM {fx_questions} GROUP BY 1, 2, 3, 4")
def _(s, d):
    return rounded(M.analyze_questions(table(s, d, "fx_questions")))


@query("latest_conversation", "WITH n AS (SELECT session_id, max((created_at, id))[2] AS id FROM {fx_conversations} GROUP BY session_id) SELECT n.session_id, n.id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS messages FROM n JOIN conversations ON conv_id = n.id GROUP BY 1, 2")
def _(s, d):
    return M.latest_conversation(table(s, d, "fx_conversations"), table(s, d, "fx_messages"))


@query("history_page", "SELECT conv_id, position, turn, role, total, total > 5 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS position, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE position BETWEEN 3 AND 5")
def _(s, d):
    return M.history_page(table(s, d, "conversations"), 3, 2)


@query("session_stats", "SELECT session_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_users, min(created_at) AS first, max(created_at) AS last, 1704412800 - max(created_at) <= 86400 AS active, 1704412800 - max(created_at) > 86400 AS expired FROM {fx_messages} GROUP BY session_id")
def _(s, d):
    return M.session_stats(table(s, d, "fx_messages"), 1704412800)


@query("clear_sessions", "SELECT id, c.session_id, CASE WHEN c.id % 40 < 5 THEN 0 ELSE message_count END AS message_count, (SELECT count(*) FROM conversations WHERE conv_id % 40 >= 5) AS left_messages FROM {fx_conversations} c")
def _(s, d):
    c = table(s, d, "fx_conversations")
    m = table(s, d, "fx_messages").withColumn("session_id", F.concat(F.lit("s"), (F.col("conv_id") % 40).cast("string")))
    a, b = M.clear_sessions(c, m, c.where(F.col("id") % 40 < 5))
    return a.select("id", "session_id", "message_count").crossJoin(b.agg(F.count(F.lit(1)).alias("left_messages")))


@query("merge_session_metadata", "SELECT event_id, json_object('event', event_type, 'k', k, 'user', user_id)::VARCHAR AS metadata FROM {fx_events}")
def _(s, d):
    old = F.create_map(F.lit("event"), F.col("event_type"), F.lit("k"), F.lit("0"))
    new = F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("user"), F.col("user_id").cast("string"))
    m = M.merge_metadata(old, new)
    one = F.struct(m["event"].alias("event"), m["k"].cast("long").alias("k"), m["user"].cast("long").alias("user"))
    return table(s, d, "fx_events").select("event_id", F.to_json(one).alias("metadata"))


@query("cache_hit_replay", "WITH k AS (SELECT event_id, md5(trim(regexp_replace(lower(question), '\\s+', ' ', 'g'))) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM {fx_question_log}) SELECT event_id, coalesce(t - lag(t) OVER (PARTITION BY key ORDER BY t, event_id) <= 3600, false) AS hit FROM k")
def _(s, d):
    return M.cache_replay(table(s, d, "fx_question_log"))


@query("live_entries", "WITH x AS (SELECT key, max((created_at, content, concat('t', p_partkey % 7))) AS x FROM {fx_memory} GROUP BY key) SELECT key, x[2] AS content, 1704167200 - x[1] > 86400 AS expired FROM x WHERE x[3] NOT IN ('t3', 't5')")
def _(s, d):
    m = table(s, d, "fx_memory").withColumn("tag", F.concat(F.lit("t"), F.col("p_partkey") % 7))
    return M.live_entries(m, 1704167200, 86_400, s.createDataFrame([("t3",), ("t5",)], "tag string"))


LOOK = "q AS (SELECT DISTINCT key AS query FROM {fx_memory} WHERE p_partkey % 100 = 0 UNION SELECT 'ed' UNION SELECT 'part 1')"


@query("memory_lookup", f"WITH {LOOK}, g AS (SELECT key, CAST(confidence AS DOUBLE) AS confidence FROM {{fx_memory}} WHERE confidence >= 0.3), e AS (SELECT query, key, confidence FROM q JOIN g ON query = key), p AS (SELECT query, key, confidence * 0.9 AS confidence FROM q JOIN g ON contains(lower(key), lower(query)) WHERE query NOT IN (SELECT query FROM e)), a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY key, confidence DESC) AS place FROM (SELECT * FROM e UNION ALL SELECT * FROM p)) SELECT query, place, key, round(confidence, 6) AS confidence, count(*) OVER (PARTITION BY key) AS accesses, round((SELECT count(DISTINCT query) FROM a) / (SELECT count(*) FROM q), 6) AS hit_rate FROM a WHERE place <= 3")
def _(s, d):
    m = table(s, d, "fx_memory")
    q = m.where("p_partkey % 100 = 0").select(F.col("key").alias("query")).unionByName(s.createDataFrame([("ed",), ("part 1",)], "query string"))
    return rounded(M.lookup_counts(M.memory_lookup(m, q), q))


@query("memory_upsert", "WITH x AS (SELECT content AS key, max((created_at, key, confidence)) AS x FROM {fx_memory} GROUP BY content) SELECT key, x[2] AS content, round(CAST(x[3] AS DOUBLE), 6) AS confidence, CAST(0 AS BIGINT) AS access_count FROM x")
def _(s, d):
    m = table(s, d, "fx_memory").select(F.col("content").alias("key"), F.col("key").alias("content"), F.col("confidence").cast("double").alias("confidence"), "created_at")
    return rounded(M.memory_upsert(m))


@query("lru_trim", "SELECT p_partkey FROM {fx_memory} WHERE p_partkey NOT IN (SELECT p_partkey FROM {fx_memory} ORDER BY created_at, p_partkey LIMIT (SELECT greatest(count(*) - 800, 0) FROM part)) OR (SELECT count(*) FROM part) <= 1000")
def _(s, d):
    return M.lru_trim(table(s, d, "fx_memory"), 1000, ["created_at", "p_partkey"]).select("p_partkey")
